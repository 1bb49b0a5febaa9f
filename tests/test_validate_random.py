"""Compiled shapes against the tree engine on random shapes and documents; plan size; checkers that don't exist."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sylva.operators import shapes, trees
from sylva.operators.validate import validate

LEAVES = ["`$STRING`", "`$NUMBER`", "`$INTEGER`", "`$DECIMAL`", "`$BOOLEAN`", "`$NULL`", "`$MAP`", "`$LIST`", "`$ANY`", "`$NIL`", 1, "x", True, None, 2.5, {}]
KEYS = ["a", "b", "c d", "0"]


def document(rng, depth):
    pick = rng.random()
    if depth == 0 or pick < 0.4:
        return rng.choice([None, True, 1, 2.5, "", "x", {}, []])
    if pick < 0.8:
        return {k: document(rng, depth - 1) for k in rng.sample(KEYS, rng.randrange(0, 4))}
    return [document(rng, depth - 1) for _ in range(rng.randrange(0, 3))]


def shape(rng, depth):
    pick = rng.random()
    if depth == 0 or pick < 0.3:
        return rng.choice(LEAVES)
    if pick < 0.65:
        out = {k: shape(rng, depth - 1) for k in rng.sample(KEYS, rng.randrange(1, 4))}
        if rng.random() < 0.4:
            out[rng.choice(["`$OPEN`", "`$CHILD`"])] = True
        return {k: shape(rng, depth - 1) if k == "`$CHILD`" else v for k, v in out.items()}
    if pick < 0.75:
        return ["`$CHILD`", shape(rng, depth - 1)]
    if pick < 0.85:
        return ["`$ONE`", shape(rng, 0), shape(rng, depth - 1)]
    if pick < 0.92:
        return ["`$EXACT`", document(rng, 1), document(rng, 2)]
    return [shape(rng, depth - 1) for _ in range(rng.randrange(0, 3))]


def tidy(x):
    return json.dumps(x, sort_keys=True)


@pytest.mark.parametrize("seed", range(10))
def test_random_shapes(spark, seed):
    rng = random.Random(seed)
    wanted = {k: shape(rng, 2) for k in ("a", "b")} | {"`$OPEN`": True}
    docs = [{k: document(rng, 3) for k in rng.sample(["a", "b", "z"], rng.randrange(0, 4))} for _ in range(25)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string").select("i", F.parse_json("j").alias("d"))
    rows = validate(df, wanted, doc="d", out="o").select("i", "errs", F.to_json("o").alias("o")).orderBy("i").collect()
    for d, r in zip(docs, rows, strict=True):
        s = shapes.Shape(json.loads(json.dumps(d)), wanted)
        made = s.run()
        assert r.errs == s.errors, (wanted, d)
        if not s.errors:
            assert tidy(trees.plain(json.loads(r.o))) == tidy(trees.plain(made)), (wanted, d)


def test_plans_grow_with_the_shape(spark):
    df = spark.createDataFrame([("{}",)], "j string").select(F.parse_json("j").alias("d"))
    sizes = []
    for depth in (2, 4, 8, 16):
        s = {"x": 1}
        for _ in range(depth):
            s = {"n": s}
        began = time.perf_counter()
        v = validate(df, s, doc="d", out="o")
        sizes.append(len(v._jdf.queryExecution().analyzed().toString()))
        assert time.perf_counter() - began < 20
    assert sizes[3] - sizes[2] < 2.6 * (sizes[2] - sizes[1]) < 2.6 * 2.6 * (sizes[1] - sizes[0])
    assert v.collect()[0].errs == []


def test_unknown_checkers_raise_at_plan_time(spark):
    df = spark.createDataFrame([(1,)], "a int")
    for s in ({"a": "`$FOO`"}, {"a": ["`$CHILD`", {"b": ["`$ONE`", "`$STRING`", "`$BAR`"]}]}):
        with pytest.raises(ValueError, match="unknown checker"):
            validate(df, s, extra={"$MINE": lambda v, p, e: v})


def test_meta_is_compiled(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    v = validate(df, {"a": "`q$=n.k`", "b": "`q$~d`"}, meta={"q": {"n": {"k": 1}, "d": "web"}}, out="o")
    assert [(r.errs, json.loads(r.o)) for r in v.select("errs", F.to_json("o").alias("o")).collect()] == [([], {"a": 1, "b": "x"}), (["Expected field a to be exactly equal to 1, but found integer: 2."], {"a": 2, "b": "web"})]
    assert "Python" not in v._jdf.queryExecution().executedPlan().toString()
