"""References of a template to itself over VARIANT, as deep as the data goes, against the plain functions."""

import json

import pytest
from pyspark.sql import functions as F

from sylva.operators import trees
from sylva.operators.transform import transform

DEEP = {"name": "n0"}
for k in range(1, 25):
    DEEP = {"name": f"n{k}", "of": DEEP, "n": k}
DOCS = [
    {"part": {"name": "bike", "of": {"name": "wheel", "of": {"name": "rim", "n": 2.5}}}},
    {"part": {"name": "bell"}},
    {"part": {"of": {"of": {}}}},
    {},
    {"part": DEEP},
]


def frame(spark, docs):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string").select("i", F.parse_json("j").alias("d"))


def tidy(x):
    if isinstance(x, dict):
        made = {k: tidy(v) for k, v in x.items()}
        return {k: v for k, v in made.items() if v is not None and v != {}}
    return [tidy(v) for v in x] if isinstance(x, list) else trees.plain(x)


def run(spark, docs, spec):
    made = transform(frame(spark, docs), spec, doc="d")
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    return [tidy(json.loads(r[0])) for r in made.select(F.to_json(F.struct("*"))).collect()]


def test_one_part_inside_another(spark):
    spec = {"part": {"title": "<`.name`>", "name": "`.name`", "n": "`.n`", "kind": "part", "of": ["`$REF`", "part"]}}
    got = run(spark, DOCS, spec)
    assert got[0] == {"part": {"title": "<bike>", "name": "bike", "kind": "part", "of": {"title": "<wheel>", "name": "wheel", "kind": "part", "of": {"title": "<rim>", "name": "rim", "n": 2.5, "kind": "part"}}}}
    assert got[1] == {"part": {"title": "<bell>", "name": "bell", "kind": "part"}} and got[3] == tidy(trees.transform({}, spec))
    assert got[2] == {"part": {"title": "<>", "kind": "part", "of": {"title": "<>", "kind": "part", "of": {"title": "<>", "kind": "part"}}}}
    deep, at = got[4]["part"], 24
    while deep:
        assert deep["name"] == f"n{at}" and deep.get("n") == (at or None)
        deep, at = deep.get("of"), at - 1
    assert at == -1


def test_lists_of_parts(spark):
    spec = {"tree": {"id": "`.id`", "kids": ["`$EACH`", ".", ["`$REF`", "tree"]]}}
    tree = lambda n, depth: {"id": n, "kids": [tree(n * 10 + k, depth - 1) for k in range(3)]} if depth else {"id": n}
    want = lambda t: {"id": t["id"]} | ({"kids": [want(k) for k in t["kids"]]} if "kids" in t else {})
    docs = [{"tree": tree(1, 4)}, {"tree": {"id": 7, "kids": []}}]
    assert run(spark, docs, spec) == [{"tree": want(d["tree"])} for d in docs]


def test_what_cannot_be_compiled_says_so(spark):
    for spec in ({"a": {"x": "`...y`", "of": ["`$REF`", "a"]}}, {"a": {"b": {"c": ["`$REF`", "a"]}}}):
        with pytest.raises(ValueError, match="over VARIANT"):
            transform(frame(spark, DOCS), spec, doc="d")


def test_copy_keeps_a_stored_null(spark):
    made = transform(frame(spark, [{"a": None}, {"a": 1}, {}]), {"a": "`$COPY`"}, doc="d")
    assert [r[0] for r in made.select(F.coalesce(F.to_json("a"), F.lit("absent"))).collect()] == ["null", "1", "absent"]
