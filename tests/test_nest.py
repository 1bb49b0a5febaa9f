"""walk and its inverse, rewriting walks and the relational merge against the plain functions over values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sylva.functions import kinds
from sylva.operators import trees
from sylva.operators.merge import merge, merge_agg, merge_layers, merge_variants
from sylva.operators.nest import nest
from sylva.operators.walk import rewrite, walk


def tree(rng, depth):
    pick = rng.random()
    if depth == 0 or pick < 0.35:
        return rng.choice([None, True, 1, -2.5, "", "x y", "é"])
    n = rng.randrange(0, 4)
    if pick < 0.7:
        return {rng.choice(["a", "b", "c.d", "0", "1", "é", " "]): tree(rng, depth - 1) for _ in range(n)}
    return [tree(rng, depth - 1) for _ in range(n)]


def frame(spark, docs, names="i int, j string"):
    return spark.createDataFrame([(i, None if d is Ellipsis else json.dumps(d)) for i, d in enumerate(docs)], names).select("i", F.parse_json("j").alias("d"))


def canon(x):
    return json.dumps(x, sort_keys=True)


def got(df, doc="d", key="i"):
    return {r[0]: None if r[1] is None else canon(json.loads(r[1])) for r in df.select(key, F.to_json(doc)).collect()}


DEEP = {"k": 1}
for _ in range(20):
    DEEP = {"a": DEEP, "l": [1, [], {}]}
DOCS = [tree(random.Random(k), 4) for k in range(60)] + [{}, [], None, "s", 0, [[[]]], {"": {"": 1}}, list(range(12)), DEEP]


def test_nest_is_the_inverse_of_walk(spark):
    df = frame(spark, DOCS)
    assert got(nest(walk(df, "d", ["i"]), ["i"], out="d")) == {i: canon(d) for i, d in enumerate(DOCS)}
    assert nest(walk(df.limit(0), "d", ["i"]), ["i"]).count() == 0


def test_nest_of_leaves_alone_and_odd_rows(spark):
    rows = [(1, ["a", "b"], "1"), (1, ["a", "c"], "2"), (1, ["a", "c"], "2"), (None, ["x"], "null"), (2, [], '"whole"'), (3, [], "[]"), (3, ["10"], "10"), (3, ["2"], "2")]
    df = spark.createDataFrame(rows, "i int, path array<string>, t string").select("i", "path", F.parse_json("t").alias("value"), F.lit(7).alias("depth"), F.lit("clash").alias("kids"))
    assert got(nest(df, ["i"], out="d")) == {1: canon({"a": {"b": 1, "c": 2}}), None: canon({"x": None}), 2: canon("whole"), 3: canon([2, 10])}


def test_walk_has_kinds_and_order(spark):
    df = frame(spark, [{"b": [1, {}], "a": "x"}])
    rows = [(".".join(r.path), r.depth, r.kind, r.key) for r in walk(df, "d", ["i"]).orderBy("ord").collect()]
    assert rows == [("", 0, "map", None), ("a", 1, "scalar", "a"), ("b", 1, "list", "b"), ("b.0", 2, "scalar", "0"), ("b.1", 2, "map", "1")]
    assert {r.kind for r in walk(df, "d", ["i"], maxdepth=0).collect()} == {"scalar"}
    assert walk(df, "d", ["i"], maxdepth=1).count() == 3


def test_rewrite_is_walk_over_values(spark):
    df = frame(spark, DOCS)
    number = lambda v: F.try_variant_get(v, "$", "double")
    as_variant = lambda c: F.parse_json(F.to_json(F.struct(c.alias("x"))))

    def before(key, v, parent, path):  # numbers grow with their depth, texts become lists, which are then visited
        grown = F.variant_get(as_variant(number(v) + F.size(path)), "$.x", "variant")
        return F.when(kinds.is_number(v), grown).when(kinds.string(v) == "x y", F.parse_json(F.lit('[1,"q"]'))).otherwise(v)

    def after(key, v, parent, path):  # keys named b go, empty maps become their path
        told = F.variant_get(as_variant(F.array_join(path, "/")), "$.x", "variant")
        return F.when(key == "b", F.lit(None).cast("variant")).when(F.to_json(v) == "{}", told).otherwise(v)

    def before_value(key, v, parent, path):
        return v + len(path) if isinstance(v, (int, float)) and not isinstance(v, bool) else [1, "q"] if v == "x y" else v

    def after_value(key, v, parent, path):
        return trees.ABSENT if key == "b" else "/".join(path) if v == {} else v

    made = got(df.select("i", rewrite(F.col("d"), before, after).alias("d")))
    plain = lambda x: json.loads(json.dumps(x), parse_int=float)
    want = {i: trees.walk(d, before_value, after_value) for i, d in enumerate(DOCS)}
    assert {i: canon(plain(json.loads(x))) for i, x in made.items()} == {i: canon(plain(x)) for i, x in want.items()}
    same = df.select("i", rewrite(F.col("d")).alias("d"))
    assert got(same) == {i: canon(d) for i, d in enumerate(DOCS)}
    limited = got(df.select("i", rewrite(F.col("d"), None, lambda k, v, p, q: F.parse_json(F.lit("0")), maxdepth=1).alias("d")))
    assert limited == {i: canon(trees.walk(d, None, lambda k, v, p, q: 0, 1)) for i, d in enumerate(DOCS)}
    assert "Python" not in same._jdf.queryExecution().executedPlan().toString()


LAYERS = [
    [{"a": 1, "x": {"y": 5, "z": 6}, "k": [1, 2]}, {"a": 3, "x": {"y": 7}, "k": [9]}],
    [{"a": {"b": 1}}, {"a": 2}, {"a": {"c": 3}}],
    [{"a": {"b": {"p": 1}, "q": 1}}, {"a": {"b": 5}}, {"a": {"b": {"r": 2}}}],
    [{"a": [1, {"u": 1}, 3]}, {"a": {"0": 2}}, {"a": [{"v": 1}]}],
    [{"a": {"b": {"c": 1}}}, {"a": []}, {"a": {"b": {"d": 2}}}, {"a": {}}],
    [{"a": {"b": 1}}, None, {"a": {"c": 1}}],
    [{}, []],
    [[], {}],
    ["s", {"a": None}],
    [{"a": 1}, {"a": None}],
    [[1, [2, 3]], [[4], [5]], [{"x": 1}]],
    [[4], [5, 6], []],
    [7],
    [None],
]


@pytest.mark.parametrize("maxdepth", [None, 0, 1, 2])
def test_merges_are_those_of_values(spark, maxdepth):
    rng = random.Random(9)
    cases = LAYERS + [[tree(rng, 4) for _ in range(rng.randrange(1, 6))] for _ in range(60)]
    want = {i: canon(trees.merge(json.loads(json.dumps(c)), maxdepth)) for i, c in enumerate(cases)}
    rows = [(i, k, json.dumps(d)) for i, c in enumerate(cases) for k, d in enumerate(c)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "i int, k int, j string").select("i", "k", F.parse_json("j").alias("d"))
    assert got(merge_layers(df, ["i"], ["k"], "d", maxdepth)) == want
    wide = spark.createDataFrame([(i, *(json.dumps(c[k]) if k < len(c) else None for k in range(6))) for i, c in enumerate(cases)], "i int, " + ", ".join(f"c{k} string" for k in range(6)))
    made = wide.select("i", merge_variants([F.parse_json(f"c{k}") for k in range(6)], maxdepth).alias("d"))
    assert got(made) == want
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()


def test_merge_of_texts(spark):
    row = spark.range(1).select(merge([F.lit('{"b":1,"a":{"x":1}}'), F.lit(None).cast("string"), F.lit('{"a":{"y":2}}')]).alias("m")).first()
    assert row.m == '{"a":{"x":1,"y":2},"b":1}'


def test_one_key_with_a_million_rows(spark):
    """Rows are summed up before the shuffle: one key is no more work than many."""
    rows = spark.range(0, 1_000_000, 1, 4).select(F.lit("k").alias("k"), "id", F.parse_json(F.concat(F.lit('{"last":'), F.col("id").cast("string"), F.lit(',"seen":{"s'), (F.col("id") % 7).cast("string"), F.lit('":'), F.col("id").cast("string"), F.lit("}}"))).alias("doc"), F.col("id").alias("n"))
    m = merge_agg(rows, ["k"], "id", ["n", "doc"])
    r = m.select("k", "n", F.to_json("doc").alias("doc")).collect()
    assert len(r) == 1 and r[0].n == 999_999
    assert json.loads(r[0].doc) == {"last": 999_999, "seen": {f"s{k}": max(x for x in range(999_990, 1_000_000) if x % 7 == k) for k in range(7)}}
    assert "Python" not in m._jdf.queryExecution().executedPlan().toString()
