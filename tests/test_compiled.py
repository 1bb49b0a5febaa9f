"""The compiled forms against the tree engine, over VARIANT documents and typed rows."""

import json

import pytest
from pyspark.sql import functions as F

from sylva.functions import kinds, nodes, paths, scalars
from sylva.operators import shapes, trees
from sylva.operators.merge import merge_agg
from sylva.operators.select import select_children
from sylva.operators.transform import transform
from sylva.operators.validate import validate
from sylva.operators.walk import walk

S, N, I, ONE, EXACT, CHILD, OPEN = "`$STRING`", "`$NUMBER`", "`$INTEGER`", "`$ONE`", "`$EXACT`", "`$CHILD`", "`$OPEN`"
DOCS = [
    {"user": "kim", "lines": [{"sku": "p1", "qty": 2}, {"sku": "p9", "qty": 5}], "by": {"web": {"n": 4}, "app": {"n": 6}}, "tags": ["new", "eu"], "which": "web"},
    {"user": "", "lines": [{"sku": "p1", "qty": 2.5}, {"sku": "p1", "qty": "x"}, {"qty": 1, "note": None}], "by": {}, "tags": [1, None, True]},
    {"user": 7, "lines": {"one": {"sku": "k"}}, "by": {"app": {"n": 6.0}}, "which": "app", "tags": []},
    {"lines": [], "by": {"web": {"n": "4"}, "app": None}},
    {},
]


def table(spark, docs):
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "i int, j string").select("i", "j", F.parse_json("j").alias("d"))


def sorted_json(x):
    return json.dumps(x, sort_keys=True)


@pytest.mark.parametrize(
    "spec",
    [
        {"a": "`user`", "b": "<`user`>"},
        {"x": ["`$EACH`", "lines", {"s": "`.sku`", "who": "`...user`", "k": "`$KEY`"}]},
        {"x": ["`$EACH`", "lines", {"in": {"s": "`..sku`"}}]},
        {"x": ["`$EACH`", "tags", "`$COPY`"]},
        {"x": ["`$EACH`", "by", {"k": "`$KEY`", "n": "`$COPY`"}]},
        {"x": {"`$PACK`": ["lines", {"`$KEY`": "sku", "q": "`.qty`", "who": "`...user`"}]}},
        {"x": {"`$PACK`": ["by", {"`$VAL`": {"n": "`.n`"}}]}},
        {"x": "`by.$GET:which$.n`", "y": "`by.$META:pick$.n`", "t": "`$TOP.user`"},
        {"by": {"web": {"n": "`$COPY`", "at": "`$KEY`"}}},
        {"x": {"`$MERGE`": "`by`", "more": 1}},
        {"lines": ["`$EACH`", ".", {"sku": "`$COPY`"}]},
    ],
)
def test_transform_is_that_of_trees(spark, spec):
    docs = [d for d in DOCS if isinstance(d.get("lines", []), list)] if "lines" in json.dumps(spec) else DOCS
    made = transform(table(spark, docs), spec, doc="d", meta={"pick": "app"})
    got = [json.loads(r[0]) for r in made.select(F.to_json(F.struct("*"))).collect()]

    def tidy(x):  # the fields of a column type are fixed: NULL stands for absent
        return {k: tidy(v) for k, v in x.items() if v is not None and tidy(v) != {}} if isinstance(x, dict) else [tidy(v) for v in x] if isinstance(x, list) else trees.plain(x)

    want = [trees.transform(d, spec, meta={"pick": "app"}) for d in docs]
    assert [sorted_json(tidy(x)) for x in got] == [sorted_json(tidy(x)) for x in want]


def test_recursive_template_over_a_schema(spark):
    schema = "part struct<name: string, of: struct<name: string, of: struct<name: string>>>"
    rows = [({"name": "bike", "of": {"name": "wheel", "of": None}},), ({"name": "bell", "of": None},)]
    made = transform(spark.createDataFrame(rows, schema), {"part": {"title": "`.name`", "of": ["`$REF`", "part"]}})
    got = [json.loads(r[0]) for r in made.select(F.to_json(F.struct("*"))).collect()]
    assert got == [{"part": {"title": "bike", "of": {"title": "wheel"}}}, {"part": {"title": "bell"}}]


def test_misplaced_commands_raise_at_plan_time(spark):
    with pytest.raises(ValueError, match="invalid placement in parent map, expected: list"):
        transform(table(spark, DOCS), {"x": "`$APPLY`"}, doc="d")
    with pytest.raises(ValueError, match="invalid placement as key"):
        transform(table(spark, DOCS), {"`$EACH`": 1}, doc="d")


SHAPES = [
    {"user": S, OPEN: True},
    {"user": S, "lines": [CHILD, {"sku": S, "qty": 1}], "by": {}, "tags": "`$ANY`", "which": "web"},
    {"user": "someone", CHILD: "`$MAP`"},
    {"by": {"web": {"n": N}, CHILD: {"n": I}}, OPEN: True},
    {"by": {CHILD: {"n": 1}}, OPEN: True},
    {"tags": [ONE, [CHILD, S], [], [1, 2]], OPEN: True},
    {"tags": ["x", "y", "z"], OPEN: True},
    {"by": [EXACT, {"app": {"n": 6}}, {}], OPEN: True},
    {"user": [EXACT, "kim", 7], "lines": "`$LIST`", OPEN: True},
    {"user": "`$NIL`", "which": "`$NIL`", OPEN: True},
    {"which": "`user`", OPEN: True},
    {"which": ["`$REF`", "user"], "user": S, OPEN: True},
    {"which": "`lim$~which`", OPEN: True},
    {"which": "`lim$=which`", OPEN: True},
    {"user": "`$SHORT`", OPEN: True},
]


@pytest.mark.parametrize("k", range(len(SHAPES)))
def test_validate_is_that_of_trees(spark, k):
    shape, outside = SHAPES[k], {}

    def short(x, path, errs):
        if not isinstance(x, str) or len(x) > 2:
            errs.append(f"not short at {path[0]}")
        return x

    if "lim$" in str(shape):
        outside = {"meta": {"lim": {"which": "web"}}}
    if "SHORT" in str(shape):
        outside = {"extra": {"$SHORT": short}}
    rows = validate(table(spark, DOCS), shape, doc="d", out="o", **outside).select("i", "errs", F.to_json("o").alias("o")).orderBy("i").collect()
    for r, d in zip(rows, DOCS, strict=True):
        errs = []
        want = shapes.validate(d, shape, errs=errs, **outside)
        assert r.errs == errs, (shape, d)
        if not errs:
            assert sorted_json(json.loads(r.o)) == sorted_json(trees._tidy(want)), (shape, d)


def test_exact_meta(spark):
    rows = validate(table(spark, [{"n": 1}, {"n": 2}]), {"n": 1}, doc="d", meta={"`$EXACT`": True}).orderBy("i").collect()
    assert [r.errs for r in rows] == [[], ["Value at field n: 2 should equal 1."]]


def test_unknown_checkers_raise(spark):
    with pytest.raises(Exception, match="unknown checker"):
        validate(table(spark, [{}]), {"a": "`$NOPE`"}, doc="d").collect()


def test_typed_rows(spark):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, None)], "n int, s string, l array<int>")
    got = validate(df, {"n": 5, "s": "none", "l": [CHILD, 0]}, out="o").select("errs", F.to_json("o").alias("o")).collect()
    assert [(r.errs, json.loads(r.o)) for r in got] == [([], {"n": 1, "s": "a", "l": [1, 2]}), ([], {"n": 2, "s": "none", "l": []})]


@pytest.mark.parametrize(
    ("query", "want"),
    [({"n": {"`$GTE`": 5}}, [["app"], [], ["app"], [], []]), ({"$KEY": "web"}, [["web"], [], [], ["web"], []]), ({"`$OR`": [{"$KEY": "app"}, {"n": 4}]}, [["app", "web"], [], ["app"], [], []])],
)
def test_select_children(spark, query, want):
    df = table(spark, DOCS)
    by = nodes.getprop(F.col("d"), "by")
    found = select_children(by, df.schema["d"].dataType, query)
    got = df.select("i", F.transform(found, lambda x: x["key"]).alias("keys")).orderBy("i").collect()
    assert [r["keys"] or [] for r in got] == want
    assert want == [[x["$KEY"] for x in shapes.select(d.get("by"), query)] for d in DOCS]


def test_empty_text_counts_as_zero(spark):
    from sylva.operators.select import select

    df = table(spark, [{"ms": ""}, {"ms": "12"}, {"ms": "x"}, {"ms": 3}])
    assert [r.i for r in select(df, {"d": {"ms": {"`$LT`": 5}}}).orderBy("i").collect()] == [0, 3]


def test_paths_and_setters(spark):
    df = table(spark, DOCS)
    d = F.col("d")
    names = ["user", "lines.1.sku", "by.app.n", "tags.0", "lines.one.sku", "gone.x", "lines.01"]
    rows = df.select("i", *(F.to_json(paths.getpath(d, p)).alias(p) for p in names)).orderBy("i").collect()
    for r, doc in zip(rows, DOCS, strict=True):
        for p in names:
            want = trees.getpath(doc, p)
            assert (None if r[p] is None else json.loads(r[p])) == (None if want is trees.ABSENT else trees._tidy(want)), (p, doc)
    deep = "a.b.c.d.e.f"
    made = paths.setpath(d, deep, F.parse_json(F.lit("5")))
    assert len(made._jc.toString()) < 40_000
    got = df.select("i", F.to_json(made).alias("o")).orderBy("i").collect()
    assert [sorted_json(json.loads(r.o)) for r in got] == [sorted_json(trees._tidy(trees.setpath(x, deep, 5))) for x in DOCS]
    got = df.select("i", F.to_json(paths.setpath(d, "by.app", None)).alias("o")).orderBy("i").collect()
    assert [sorted_json(json.loads(r.o)) for r in got] == [sorted_json(trees._tidy(trees.setpath(x, "by.app", trees.DELETE))) for x in DOCS]


def test_condensed_columns_are_not_written(spark):
    df = table(spark, [trees.condense({"a": 1})])
    with pytest.raises(Exception, match="condensed"):
        df.select(nodes.setprop(F.col("d"), "a", F.parse_json(F.lit("2")))).collect()


def test_text_functions(spark):
    df = table(spark, [[1, [2, [3, {"a": [4]}]], "x"], {"b": {"c": []}, "a": '"{,}"', "e": [{}, [1]]}])
    flat = df.select("i", F.to_json(F.to_variant_object(scalars.flatten_mixed(F.col("d"), 2))).alias("f")).orderBy("i").collect()
    assert json.loads(flat[0].f) == [1, 2, 3, {"a": [4]}, "x"]
    pretty = df.select("i", kinds.pretty(F.col("d")).alias("p"), "j").orderBy("i").collect()
    assert [r.p for r in pretty] == [json.dumps(json.loads(r.j), indent=2, sort_keys=True) for r in pretty]
    called = spark.createDataFrame([("a1 b22 c",), ("",), (None,)], "s string").select(scalars.re_replace("([a-z])([0-9]+)", F.col("s"), lambda m: F.concat(m[2], F.lit("-"), F.upper(m[1]))).alias("r")).collect()
    assert [r.r for r in called] == ["1-A 22-B c", "", None]
    mapped = df.select("i", F.array_join(nodes.items(F.col("d"), lambda k, v: F.concat(k, F.lit("="), kinds.typename(kinds.typify(v)))), ",").alias("m")).orderBy("i").collect()
    assert [r.m for r in mapped] == ["0=integer,1=list,2=string", "a=string,b=map,e=list"]


def test_merge_agg_merges(spark):
    rows = [("k", 2, "x", {"b": 2, "l": [9]}), ("k", 1, "y", {"a": 1, "l": [1, 2]}), ("k", 3, None, None), ("m", 1, "p", {"z": {"q": 1}}), ("m", 1, "r", {"z": {"w": 2}}), (None, 1, "n", {"c": 3})]
    df = spark.createDataFrame([(a, b, c, None if d is None else json.dumps(d)) for a, b, c, d in rows], "k string, o int, s string, j string").select("k", "o", "s", F.parse_json("j").alias("d"))
    got = {r.k: (r.s, json.loads(r.d)) for r in merge_agg(df, ["k"], "o", ["s", "d"]).select("k", "s", F.to_json("d").alias("d")).collect()}
    assert got == {"k": ("x", {"a": 1, "b": 2, "l": [9, 2]}), "m": ("r", {"z": {"q": 1, "w": 2}}), None: ("n", {"c": 3})}
    assert [r.s for r in merge_agg(df, ["k"], "o", ["s"]).orderBy("k").collect()] == ["n", "x", "r"]


def test_walk_leaves_no_view(spark):
    before = len(spark.catalog.listTables())
    assert walk(table(spark, DOCS), "d", ["i"]).count() > len(DOCS)
    assert len(spark.catalog.listTables()) == before
