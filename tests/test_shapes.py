"""Shapes, queries and functions over Python values: cases with their results as the survey states them."""

import pytest

from sylva.operators import trees as t
from sylva.operators import values as v

S, N, I, ONE, EXACT, CHILD, OPEN = "`$STRING`", "`$NUMBER`", "`$INTEGER`", "`$ONE`", "`$EXACT`", "`$CHILD`", "`$OPEN`"


ORDER = {"id": 7, "status": "open", "lines": [{"part": 11, "qty": 3}, {"part": 12, "qty": 1}], "ship": {"city": "Oslo", "fee": 4.5}}


@pytest.mark.parametrize(
    ("data", "shape", "want"),
    [
        (ORDER, {"id": I, "status": S, "lines": "`$LIST`", "ship": "`$MAP`"}, ORDER),
        (250, 100, 250),  # a literal fixes the type only
        ({"id": 7}, {"id": I, "status": "new"}, {"id": 7, "status": "new"}),
        ({"id": 7}, {"id": I, "ship": {"fee": 0.5}}, {"id": 7, "ship": {"fee": 0.5}}),
        ({"id": 7}, {"id": I, "coupon": "`$NIL`"}, {"id": 7}),
        ({"id": 7, "note": None}, {"id": I, "note": "`$ANY`"}, {"id": 7, "note": None}),
        ({"ship": {"city": "Oslo"}}, {"ship": {}}, {"ship": {"city": "Oslo"}}),
        ({"ship": {"city": "Oslo", "fee": 9}}, {"ship": {"fee": 0, OPEN: True}}, {"ship": {"fee": 9, "city": "Oslo"}}),
        ({"status": ""}, {"status": [ONE, S, ""]}, {"status": ""}),
        ({}, {"tags": {CHILD: 1}, "lines": [CHILD, {"qty": 1}]}, {"tags": {}, "lines": []}),
        ({"lines": [{"part": 5}, {"part": 6, "qty": 2}]}, {"lines": [CHILD, {"part": I, "qty": 1}]}, {"lines": [{"part": 5, "qty": 1}, {"part": 6, "qty": 2}]}),
        ({"jan": 10, "feb": 20}, {OPEN: True, CHILD: N}, {"jan": 10, "feb": 20}),
        ({"label": "q1", "jan": 10}, {"label": S, CHILD: N}, {"label": "q1", "jan": 10}),
        ({"user": {"id": 3}}, [ONE, {"user": I}, {"user": "`$MAP`"}], {"user": {"id": 3}}),
        ({"ship": {"days": [1, 2]}}, [EXACT, {"ship": {"days": [1, 2.0]}}], {"ship": {"days": [1, 2]}}),
        (None, [EXACT, None], None),
        ({"gross": 40}, {"gross": N, "net": "`gross`"}, {"gross": 40, "net": 40}),
        ({"gross": 40, "net": 31}, {"gross": N, "net": "`gross`"}, {"gross": 40, "net": 31}),
        ({"billed": 5, "paid": 2}, {"billed": N, "paid": ["`$REF`", "billed"]}, {"billed": 5, "paid": 2}),
        ({"days": [4]}, {"days": [1, 2, 3]}, {"days": [4, 2, 3]}),
        ({"days": [4, 5, 6]}, {"days": [1]}, {"days": [4]}),
    ],
)
def test_validate(data, shape, want):
    assert v.validate(data, shape) == want


@pytest.mark.parametrize(
    ("data", "shape", "want"),
    [
        (250, S, "Expected string, but found integer: 250."),
        (None, S, "Expected string, but found no value."),
        ({"id": "seven", "status": 7}, {"id": I, "status": S}, "Expected field id to be integer, but found string: seven. | Expected field status to be string, but found integer: 7."),
        ({"id": 7, "zip": 1, "fax": 2}, {"id": I}, "Unexpected keys at field <root>: fax, zip"),
        ({"ship": {"city": "Oslo", "fax": 2}}, {"ship": {"city": S}}, "Unexpected keys at field ship: fax"),
        ({"status": ""}, {"status": S}, "Empty string at status"),
        ({"lines": {"part": 1}}, {"lines": []}, "Expected field lines to be list, but found map: {part:1}."),
        (2.75, I, "Expected integer, but found decimal: 2.75."),
        ({"stock": {"oslo": {"qty": "few"}}}, {"stock": {CHILD: {"qty": N}}}, "Expected field stock.oslo.qty to be number, but found string: few."),
        ({"days": [12, "may"]}, {"days": [CHILD, N]}, "Expected field days.1 to be number, but found string: may."),
        (False, [ONE, S, N], "Expected one of string, number, but found boolean: false."),
        ({"id": 7}, {"id": I, "ship": [ONE, "`$MAP`", "`$LIST`"]}, "Expected field ship to be one of map, list, but found no value."),
        ("red", [EXACT, "blue", True, 8], "Expected value exactly equal to one of blue, true, 8, but found string: red."),
        ({"ship": {"fee": 2, "city": "Oslo"}}, {"ship": [EXACT, {"fee": 3, "city": "Oslo"}]}, "Expected field ship to be exactly equal to {city:Oslo,fee:3}, but found map: {city:Oslo,fee:2}."),
        (t.ABSENT, {"id": [EXACT, 8]}, "Expected field id to be exactly equal to 8, but found no value."),
    ],
)
def test_validate_errors(data, shape, want):
    with pytest.raises(ValueError) as e:
        v.validate(data, shape)
    assert str(e.value) == want


def test_validate_meta_and_custom():
    meta = {"limits": {"qty": 60}}
    assert v.validate({"qty": 12}, {"qty": "`limits$~qty`"}, meta=meta) == {"qty": 12}
    assert v.validate({}, {"qty": "`limits$~qty`"}, meta=meta) == {"qty": 60}
    errs = []
    v.validate({"qty": "many"}, {"qty": "`limits$=qty`"}, meta=meta, errs=errs)
    v.validate({"ship": {"fee": 45}}, {"ship": {"fee": 54}}, meta={"`$EXACT`": True}, errs=errs)
    v.validate({"qty": 7}, {"qty": "`$EVEN`"}, {"$EVEN": lambda x, path, errs: errs.append(f"odd at {path[0]}")}, errs=errs)
    assert errs == ["Expected field qty to be exactly equal to 60, but found string: many.", "Value at field ship.fee: 45 should equal 54.", "odd at qty"]


def test_recursive_shape_ends_with_the_data():
    part = {"name": "bike", "of": {"name": "wheel", "of": {"name": 26}}}
    errs = []
    v.validate({"part": part}, {"part": {"name": S, "of": ["`$REF`", "part"]}}, errs=errs)
    assert errs == ["Expected field part.of.of.name to be string, but found integer: 26."]


EVENTS = {"e1": {"kind": "click", "ms": 120}, "e2": {"kind": "view", "ms": 45}}


@pytest.mark.parametrize(
    ("children", "query", "want"),
    [
        (EVENTS, {"ms": 45}, ["e2"]),
        (EVENTS, {}, ["e1", "e2"]),
        (EVENTS, {"$KEY": "e1"}, ["e1"]),
        (EVENTS, {"`$NOT`": {"user": 3}}, ["e1", "e2"]),
        (EVENTS, {"kind": {"`$LIKE`": "ck$"}}, ["e1"]),
        ([{"ms": x} for x in (8, 40, 65, 90, 200)], {"ms": {"`$AND`": [{"`$GT`": 40}, {"`$LTE`": 90}]}}, [2, 3]),
        ([{"ok": 0}, {"ok": False}, {"ok": "0"}, {"ok": 0.0}], {"ok": 0}, [0, 3]),
        ([{"path": ["home", "cart", "pay"]}, {"path": ["home"]}], {"path": ["home", "cart"]}, [0]),
        ([{"ms": 8}], {"`$OR`": []}, []),
        ([{"ms": 8}, {"ms": 9}], {"`$OR`": [{"`$AND`": []}, {"ms": 8}]}, [0, 1]),
        ([{"ms": ""}, {"ms": "12"}, {"ms": "x"}], {"ms": {"`$LT`": 5}}, [0]),
        ("click", {"ms": 8}, []),
        (None, {}, []),
    ],
)
def test_select(children, query, want):
    assert [x["$KEY"] for x in v.select(children, query)] == want


def test_select_scalars():
    assert v.select({"mon": "rain", "tue": "sun", "wed": "snow"}, {"`$OR`": ["snow", "rain"]}) == ["rain", "snow"]
    assert v.select([300, 250, 410], {"`$NOT`": 250}) == [300, 410]


def test_hooks():
    assert t.transform({"a": 1}, {"x": "`a`", "y": "`b`"}, handler=lambda got, ref, here: ref if got is t.ABSENT else got) == {"x": 1, "y": "b"}
    assert t.transform({"a": 1}, {"x": "`a`"}, modify=lambda x, k, path: x + 1 if k == "x" else x) == {"x": 2}


def test_walk_and_merge_leave_their_input():
    a, b = {"x": [1, {"y": 2}]}, {"x": [9]}
    assert t.merge([a, b]) == {"x": [9, {"y": 2}]}
    assert t.walk(a, lambda k, x, p, q: x * 10 if isinstance(x, int) else x) == {"x": [10, {"y": 20}]}
    assert t.walk({"a": 1, "b": 2}, lambda k, x, p, q: t.ABSENT if k == "a" else x) == {"b": 2}
    assert (a, b) == ({"x": [1, {"y": 2}]}, {"x": [9]})


@pytest.mark.parametrize(
    ("got", "want"),
    [
        (v.slice("abcdef", -2), "abcd"),
        (v.slice([1, 2, 3, 4], 1, -1), [2, 3]),
        (v.slice(9, 1, 5), 4),
        (v.slice("abc", None, 2), "ab"),
        (v.pad("a", 3), "a  "),
        (v.pad(7, -3, "0"), "007"),
        (v.join(["a/", "/b", 1, "", "c"], "/"), "a/b/c"),
        (v.join(["http://x.y/", "/z/"], "/", True), "http://x.y/z/"),
        (v.flatten([1, [2, [3]]]), [1, 2, [3]]),
        (v.filter([1, 4, 5], lambda kx: kx[1] > 3), [4, 5]),
        (v.size(2.7), 2),
        (v.size(True), 1),
        (v.isempty(0), False),
        (v.escurl("a b!*'()"), "a%20b!*'()"),
        (v.escre("a.b"), r"a\.b"),
        (v.jm("a", 1, 2, None, "b"), {"a": 1, "2": None, "b": None}),
        (v.re_replace("(a)(b)?", "ab a", "<$1$2$&>"), "<abab> <aa>"),
        (v.re_replace("a", "aba", lambda m: m[0].upper()), "AbA"),
        (v.re_find_all("x*", "axb"), [[""], ["x"], [""], [""]]),
        (v.getdef(None, 1), None),
        (v.haskey({"a": None}, "a"), False),
    ],
)
def test_functions(got, want):
    assert got == want
