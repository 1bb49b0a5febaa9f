"""Condensed values read in columns against the plain functions, and condensed tables against what they were made of."""

import json
import random

from pyspark.sql import functions as F

from sylva.operators import condense, trees


def tree(rng, depth):
    pick = rng.random()
    if depth == 0 or pick < 0.35:
        return rng.choice([None, True, False, 1, -2.5, "", "x y", "é", 10**12])
    n = rng.randrange(0, 4)
    if pick < 0.7:
        return {rng.choice(["a", "b", "c=1,", "0", "é", " "]): tree(rng, depth - 1) for _ in range(n)}
    return [tree(rng, depth - 1) for _ in range(n)]


DOCS = [tree(random.Random(k), 4) for k in range(50)] + [{}, [], None, "s", 0, [[[]]], {"a": {"b": [1, {"c": "x"}]}, "z": [{"c": "x"}, {"c": "x"}]}, 1.0, 1]


def canon(x):
    return json.dumps(trees.plain(x), sort_keys=True)


def test_reading_condensed_values(spark):
    rows = [(i, json.dumps(trees.condense(d))) for i, d in enumerate(DOCS)] + [(90, '{"$condense":2,"sym":[],"node":[],"root":0}'), (91, "[1]"), (92, None)]
    df = spark.createDataFrame(rows, "i int, j string").select("i", F.parse_json("j").alias("v"))
    read = ["", "a", "a.b", "a.b.0", "a.b.1.c", "z.1", "0", "0.0", "é", "zz"]
    one = df.select("i", F.to_json(condense.expand(F.col("v"))).alias("x"), condense.iscondensed(F.col("v")).alias("is"), *(F.to_json(condense.getpath_condensed(F.col("v"), p)).alias(f"c{k}") for k, p in enumerate(read)))
    assert "Python" not in one._jdf.queryExecution().executedPlan().toString()
    for r in one.where("i < 90").collect():
        d = DOCS[r.i]
        assert getattr(r, "is") and canon(json.loads(r.x)) == canon(d)
        for k, p in enumerate(read):
            want = trees.getpath(d, p)
            got = r[f"c{k}"]
            assert (None if got is None else canon(json.loads(got))) == (None if want in (None, trees.ABSENT) and not isinstance(want, (int, float)) else canon(want)), (d, p)
    assert {r.i: getattr(r, "is") for r in one.where("i >= 90").collect()} == {90: False, 91: False, 92: False}


def test_tables_are_condensed_and_expanded(spark):
    docs = [*DOCS, *DOCS[:9]]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(None, '{"a":1}'), (999, None)], "i int, j string").repartition(5).select("i", F.parse_json("j").alias("d"))
    symbols, nodes, roots = condense.condense_table(df, ["i"], "d")
    assert {r.i: canon(json.loads(r.x)) for r in condense.expand_table(symbols, nodes, roots).select("i", F.to_json("doc").alias("x")).collect()} == {i: canon(d) for i, d in enumerate(docs)} | {None: '{"a": 1}'}
    texts, distinct = set(), set()

    def collect(x):
        distinct.add(canon(x))
        if isinstance(x, str):
            texts.add(x)
        for k, y in trees.items(x) if trees.is_node(x) else ():
            if isinstance(x, dict):
                texts.add(k)
            collect(y)

    for d in [*docs, {"a": 1}]:
        collect(d)
    assert [(r.sym, r.text) for r in symbols.orderBy("sym").collect()] == list(enumerate(sorted(texts)))
    rows = nodes.collect()
    assert sorted(r.node for r in rows) == list(range(len(distinct)))
    assert all(c.node < r.node for r in rows for c in r.children)


def test_no_documents(spark):
    df = spark.createDataFrame([], "i int, j string").select("i", F.parse_json("j").alias("d"))
    symbols, nodes, roots = condense.condense_table(df, ["i"], "d")
    assert symbols.count() == nodes.count() == roots.count() == condense.expand_table(symbols, nodes, roots).count() == 0


def test_numbers_follow_the_order(spark):
    df = spark.range(0, 5000, 1, 7).select((F.hash("id") % 100_000).alias("h"), "id")
    got = [r.h for r in condense.numbered(df, ["h", "id"], "n").orderBy("n").collect()]
    assert got == sorted(got) and len(got) == 5000
    assert [r.n for r in condense.numbered(df, ["h", "id"], "n").orderBy("h", "id").collect()] == list(range(5000))
