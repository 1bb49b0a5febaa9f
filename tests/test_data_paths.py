"""Paths, keys and indexes from the row; hooks of templates; collections that are tables."""

import json

import pytest
from pyspark.sql import functions as F

from sylva.functions import nodes, paths, scalars
from sylva.operators.tables import each_table, pack_table, transform_tables
from sylva.operators.transform import inject, transform
from sylva.plans.node import Node

DOC = {"a": {"b": [1, {"c": None}, "x"], "$k": 5, "0": "zero"}, "l": [[10], 20], "n": None, "": 3, "a.b": 4}
PATHS = [None, "", ".", "..", "a", ".a", "..a", "a.b", "a.b.0", "a.b.1", "a.b.1.c", "a.b.2", "a.b.3", "a.b.-1", "a.b.01", "a.$$k", "a.0", "l.0.0", "l.1.0", "n", "n.x", "zz", "a.", "a..l", "a..l.1", "a...l", "a..", "a.b.0.x"]


def frame(spark, paths_):
    return spark.createDataFrame([(i, p, json.dumps(DOC)) for i, p in enumerate(paths_)], "i int, p string, j string").select("i", "p", F.parse_json("j").alias("v"))


def test_paths_that_are_data(spark):
    df = frame(spark, PATHS)
    got = {r.p: r.x for r in df.select("p", F.to_json(nodes.getpath_at(F.col("v"), F.col("p"))).alias("x")).collect()}
    one = df.limit(1)
    want = one.select(*(F.to_json(paths.getpath(F.col("v"), p)).alias(f"c{k}") for k, p in enumerate(PATHS))).first()
    assert got == dict(zip(PATHS, want, strict=True))
    assert df.where("p = 'zz'").select(F.to_json(nodes.getpath_at(F.col("v"), F.col("p"), F.parse_json(F.lit("0"))))).first()[0] == "0"


def test_keys_and_indexes_that_are_data(spark):
    df = spark.createDataFrame([(k, i) for k, i in (("b", 0), ("0", -1), ("", 5), (None, None), ("zz", -9), ("$k", 2))], "k string, i int").withColumn("v", F.parse_json(F.lit(json.dumps(DOC))))
    a = paths.getpath(F.col("v"), "a")
    rows = df.select(F.to_json(nodes.getprop_at(a, F.col("k"))), F.to_json(nodes.getelem_at(paths.getpath(F.col("v"), "a.b"), F.col("i"))), F.to_json(nodes.getelem_at(paths.getpath(F.col("v"), "l"), F.col("i"), lambda v: nodes.getelem(v, 1)))).collect()
    assert [tuple(r) for r in rows] == [('[1,{"c":null},"x"]', "1", "[10]"), ('"zero"', '"x"', "20"), (None, None, "20"), (None, None, "20"), (None, None, "20"), ("5", '"x"', "20")]
    floored = spark.createDataFrame([(1.9,), (0.0,), (-0.5,)], "k double").select(F.to_json(nodes.getprop_at(F.parse_json(F.lit("[7,8]")), F.col("k"), number=True))).collect()
    assert [r[0] for r in floored] == ["8", "7", None]


def test_modify_and_handler(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, 3.5)], "a int, b string, c double")
    seen = []

    def modify(leaf, key, cx):
        seen.append(key)
        return F.concat(F.lit(f"{key}="), F.coalesce(leaf.text(), F.lit("-"))) if key != "a" else leaf

    made = transform(df, {"a": "`a`", "b": "`b`", "m": {"c": "`c`", "k": 7}, "l": ["`b`", "t"]}, modify=modify)
    assert seen == ["a", "b", "c", "k", "0", "1"]
    assert [json.loads(r[0]) for r in made.select(F.to_json(F.struct("*"))).collect()] == [{"a": 1, "b": "b=x", "m": {"c": "c=-", "k": "k=7"}, "l": ["0=x", "1=t"]}, {"a": 2, "b": "b=-", "m": {"c": "c=3.5", "k": "k=7"}, "l": ["0=-", "1=t"]}]

    def handler(value, ref, cx):
        return F.concat(F.lit(f"{ref}:"), F.coalesce(value.text(), F.lit("none")))

    one = df.select(F.to_json(inject({"x": "`b`", "y": "<`a`,`zz`>", "z": ["`c`"], "n": 1}, df, handler=handler))).collect()
    assert [json.loads(r[0]) for r in one] == [{"x": "b:x", "y": "<a:1,zz:none>", "z": ["c:none"], "n": 1}, {"x": "b:none", "y": "<a:2,zz:none>", "z": ["c:3.5"], "n": 1}]
    assert df.select(inject("`b`!", df, handler=lambda v, r, cx: Node(F.upper(v.col), v.kind))).first()[0] == "X!"
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()


def test_packed_tables(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("", 1, "e"), (None, 1, "n"), ("m", 1, "y"), ("m", 1, "x"), ("q", None, None)], "k string, o int, v string")
    packed = pack_table(rows, {"`$KEY`": "k", "v": "`.v`", "at": "`.o`"}, ["o"])
    assert {r.key: tuple(r.value) for r in packed.collect()} == {"k": ("c", 3), "m": ("y", 1), "q": (None, None)}
    values = pack_table(rows, {"`$KEY`": "<`.k`>", "`$VAL`": "`.v`"}, ["o"])
    assert {r.key: r.value for r in values.collect()} == {"<k>": "c", "<m>": "y", "<q>": None, "<>": "n"}
    assert each_table(rows, {"v": "`.v`", "t": "`.k`-`.o`"}).where("v = 'c'").first().t == "k-3"
    left = spark.createDataFrame([(1, "k"), (2, "zz"), (3, None), (4, "m")], "id int, who string")
    made = transform_tables(left, {"id": "`id`", "v": "`t.$GET:who$.v`", "text": "<`t.$GET:who$.at`>", "fix": "`t.m.v`", "n": "`u.$GET:who$`"}, {"t": packed, "u": pack_table(rows, {"`$KEY`": "k", "`$VAL`": "`.v`"}, ["o"])})
    assert sorted(map(tuple, made.collect())) == [(1, "c", "<3>", "y", "c"), (2, None, "<>", "y", None), (3, None, "<>", "y", None), (4, "y", "<1>", "y", "y")]
    assert made._jdf.queryExecution().analyzed().toString().count("Join LeftOuter") == 3


PARTS = [["a", "b.c", 3, 44.4], ["11", 22, "55.5"], ["a", True, None, [], {}, 1], [], ["A"], "a", 1, True, {}, None, Ellipsis, ["A", True, 2.9], [None]]


@pytest.mark.parametrize(("start", "end"), [(0, 0), (1, 0), (0, 1), (1, 1)])
def test_pathify_of_mixed_parts(spark, start, end):
    df = spark.createDataFrame([(None if p is Ellipsis else json.dumps(p),) for p in PARTS], "j string").select(F.parse_json("j").alias("v"))
    got = [r[0] for r in df.select(scalars.pathify_mixed(F.col("v"), start, end)).collect()]
    dotted = lambda ps: ".".join(p.replace(".", "") if isinstance(p, str) else str(int(p)) for p in ps if not isinstance(p, bool) and isinstance(p, (str, int, float)))
    want = []
    for p in PARTS:
        parts = p if isinstance(p, list) else [p] if isinstance(p, (str, int, float)) and not isinstance(p, bool) else None
        kept = parts[start : len(parts) - end] if parts is not None else None
        want.append("<unknown-path>" if p is Ellipsis else f"<unknown-path:{json.dumps(p)}>" if parts is None else dotted(kept) if kept else "<root>")
    assert got == want


def test_misplaced_commands(spark):
    with pytest.raises(ValueError, match="invalid placement"):
        transform_tables(spark.range(1), {"x": "`$APPLY`"}, {})
