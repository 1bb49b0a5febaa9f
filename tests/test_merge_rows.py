"""merge_layers: keys with few rows are merged in their row, those with many by their paths."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sylva.operators import trees
from sylva.operators.merge import FEW, UNROLLED, merge_layers, merge_variants


def tree(rng, depth):
    pick = rng.random()
    if depth == 0 or pick < 0.15:
        return rng.choice([None, 1, "x"])
    if pick < 0.75:
        return {k: tree(rng, depth - 1) for k in rng.sample(["a", "b", "0"], rng.randrange(0, 3))}
    return [tree(rng, depth - 1) for _ in range(rng.randrange(0, 3))]


def deep(k, inner):
    for i in range(k):
        inner = {"a": inner} if i % 2 else [inner]
    return inner


def canon(x):
    return json.dumps(x, sort_keys=True)


def written(spark):
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_few_rows_are_shuffled_once_and_not_written(spark):
    doc = F.parse_json(F.concat(F.lit('{"a":{"x'), "layer", F.lit('":"'), F.sha2(F.col("id").cast("string"), 256), F.lit('","same":'), "layer", F.lit("}}")))
    rows = spark.range(5000).select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("layer")).withColumn("doc", doc)
    before = written(spark)
    made = merge_layers(rows, ["id"], ["layer"], "doc")
    made.collect()
    assert written(spark) - before < 100_000
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    r = json.loads(made.where("id = 7").select(F.to_json("doc")).first()[0])
    assert sorted(r["a"]) == ["same", "x1", "x2", "x3"] and r["a"]["same"] == 3


@pytest.mark.parametrize("maxdepth", [None, UNROLLED - 1, UNROLLED, UNROLLED + 1])
def test_keys_with_few_and_many_rows(spark, maxdepth):
    rng = random.Random(3)
    cases = [[tree(rng, 7) for _ in range(n)] for n in [1, 2, 3, 3, 5, 5, 8, 8, FEW - 1, FEW, FEW + 1, 2 * FEW]]
    cases += [[deep(k, {"b": 1, "c": [1, {"d": 2}]}), deep(k, x), deep(k, {"c": [{"e": 3}]})] for k in range(2, 9) for x in (5, {"c": {"0": 1}}, {}, [])]
    want = {i: canon(trees.merge(json.loads(json.dumps(c)), maxdepth)) for i, c in enumerate(cases)}
    rows = [(i, k, json.dumps(d)) for i, c in enumerate(cases) for k, d in enumerate(c)] + [(-1, 0, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, k int, j string").select("i", "k", F.parse_json("j").alias("d"))
    got = {r.i: canon(json.loads(r.j)) for r in merge_layers(df, ["i"], ["k"], "d", maxdepth).select("i", F.to_json("d").alias("j")).collect()}
    assert got == want
    few = [c for c in cases if len(c) <= 8]
    wide = spark.createDataFrame([(i, *(json.dumps(c[k]) if k < len(c) else None for k in range(8))) for i, c in enumerate(few)], "i int, " + ", ".join(f"c{k} string" for k in range(8)))
    made = wide.select("i", F.to_json(merge_variants([F.parse_json(f"c{k}") for k in range(8)], maxdepth)).alias("j")).collect()
    assert {r.i: canon(json.loads(r.j)) for r in made} == {i: canon(trees.merge(json.loads(json.dumps(c)), maxdepth)) for i, c in enumerate(few)}
