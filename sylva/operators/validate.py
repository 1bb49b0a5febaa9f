"""validate: by-example shapes compiled to an array of error texts and the completed document.

A literal leaf gives a default and fixes the type; `$STRING` and the like fix it without a default;
a map is closed unless it is empty or has `$OPEN`. Paths in texts leave out the root. Shapes that refer to the
data or to themselves, the exact mode, and checkers of one's own are run by the tree engine instead, with the same results.
The plan grows with the shape: a VARIANT place is one read from the document, and error texts are made once, of failures.
"""

from __future__ import annotations

import json
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, NumericType, StringType, StructType, VariantType

from ..functions import kinds, nodes
from ..plans.node import Node, equals, typecode
from . import shapes, trees

_CHECKS = {"`$NUMBER`": "number", "`$INTEGER`": "integer", "`$DECIMAL`": "decimal", "`$BOOLEAN`": "boolean", "`$NULL`": "null", "`$MAP`": "map", "`$LIST`": "list", "`$STRING`": "string", "`$FUNCTION`": "function", "`$INSTANCE`": "instance"}
_BITS = {"number": kinds.T_number, "integer": kinds.INTEGER, "decimal": kinds.DECIMAL, "boolean": kinds.BOOLEAN, "map": kinds.MAP, "list": kinds.LIST, "string": kinds.STRING}
_NAMES = {kinds.INTEGER: "integer", kinds.DECIMAL: "decimal", kinds.BOOLEAN: "boolean", kinds.STRING: "string", kinds.MAP: "map", kinds.LIST: "list"}


class NeedsTree(ValueError):
    """A shape that only the tree engine can run."""


#: What is wrong at a place: the text up to what was found there, and the value; texts are made of failures only, once for the whole shape.
_ERROR = "array<struct<head:string,value:variant,shown:boolean>>"


def _none() -> Column:
    return F.array().cast(_ERROR)


def texts(found: Column) -> Column:
    """array<string> of errors()."""

    def text(e: Column) -> Column:
        v = e["value"]
        was = F.when(kinds.is_missing(v), F.lit("no value")).otherwise(F.concat(_kind_name(v), F.lit(": "), kinds.stringify(v)))
        return F.when(e["shown"], F.concat(e["head"], was, F.lit("."))).otherwise(e["head"])

    return F.transform(found, text)


def _kind_name(v: Column) -> Column:
    number = F.when(kinds.number(v) % 1 == 0, "integer").otherwise("decimal")
    return F.when(kinds.ismap(v), "map").when(kinds.islist(v), "list").when(kinds.is_string(v), "string").when(kinds.is_boolean(v), "boolean").when(kinds.is_number(v), number).otherwise("any")


def _fault(head: Column, node: Node | None) -> Column:
    """One entry of errors(); node is what the text shows."""
    value = F.lit(None).cast("variant") if node is None else node.as_variant()
    return F.struct(head.alias("head"), value.alias("value"), F.lit(node is not None).alias("shown"))


def _expected(path: Column | None, what: str, node: Node) -> Column:
    end = f"{what}, but found "
    return _fault(F.lit(f"Expected {end}") if path is None else F.concat(F.lit("Expected field "), path, F.lit(f" to be {end}")), node)


def _when(bad: Column, fault: Column) -> Column:
    return F.when(bad, F.array(fault)).otherwise(_none())


def _join(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _none()


def _sub(path: Column | None, key: str | Column) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return key if path is None else F.concat(path, F.lit("."), key)


def errors(node: Node, shape, path: Column | None = None) -> Column:
    """What is wrong (see texts()), in order of traversal (plain keys sorted, commands last)."""
    if isinstance(shape, str) and shape in _CHECKS:
        name = _CHECKS[shape]
        if name == "null":
            ok = F.coalesce(F.is_variant_null(node.col), F.lit(False)) if node.is_variant else node.missing()
        else:
            ok = node.is_kind(_BITS[name]) if name in _BITS else F.lit(False)
        out = _when(~F.coalesce(ok, F.lit(False)), _expected(path, name, node))
        if name == "string":
            empty = F.coalesce(node.string() == "", F.lit(False))
            out = F.when(empty, F.array(_fault(F.concat(F.lit("Empty string at "), path if path is not None else F.lit("<root>")), None))).otherwise(out)
        return out
    if shape == "`$NIL`":
        return _when(~node.missing(), _expected(path, "nil", node))
    if shape == "`$ANY`":
        return _none()
    if isinstance(shape, str) and shapes._REF.fullmatch(shape):
        raise NeedsTree(shape)
    if isinstance(shape, dict):
        return _map_errors(node, shape, path)
    if isinstance(shape, (list, tuple)):
        return _list_errors(node, list(shape), path)
    if shape is None:
        return _when(node.is_kind(kinds.MAP) | node.is_kind(kinds.LIST), _expected(path, "null", node))
    want = typecode(shape)
    return _when(~(node.missing() | F.coalesce(node.is_kind(want), F.lit(False))), _expected(path, _NAMES[want], node))


def _each_child(node: Node, shape, path: Column | None, known: tuple[str, ...] = ()) -> Column:
    """Errors of all children but the known ones against one shape."""
    t = node.kind
    if isinstance(t, ArrayType):
        lists = F.transform(node.column, lambda x, i: errors(Node(x, t.elementType), shape, _sub(path, i.cast("string"))))
    elif isinstance(t, StructType):
        return _join([errors(node.get(f.name), shape, _sub(path, f.name)) for f in sorted(t.fields, key=lambda f: f.name) if f.name not in known])
    else:
        entries = nodes.entries(node.column) if isinstance(t, MapType) else nodes.items(node.as_variant())
        entries = F.filter(entries, lambda x: ~x["key"].isin(*known)) if known else entries
        value = (lambda x: Node(x["value"], t.valueType)) if isinstance(t, MapType) else (lambda x: Node.variant(x["value"]))
        lists = F.transform(entries, lambda x: errors(value(x), shape, _sub(path, x["key"])))
    # children without errors are gone before their lists are joined
    return F.coalesce(F.flatten(F.filter(lists, lambda e: F.size(e) > 0)), _none())


def _map_errors(node: Node, shape: dict, path: Column | None) -> Column:
    is_row = node.col is None and not node.absent
    wrong = F.lit(False) if is_row else ~(node.missing() | F.coalesce(node.is_kind(kinds.MAP), F.lit(False)))
    none = _none()
    out = [_when(wrong, _expected(path, "map", node))]
    plain = sorted(k for k in shape if k not in (shapes.OPEN, shapes.CHILD))
    body = [errors(node.child(k), shape[k], _sub(path, k)) for k in plain]
    if shapes.CHILD in shape:
        there = F.lit(True) if is_row else F.coalesce(node.is_kind(kinds.MAP), F.lit(False))
        body.append(F.when(there, _each_child(node, shape[shapes.CHILD], path, tuple(plain))).otherwise(none))
    elif plain and shape.get(shapes.OPEN) is not True:
        body.append(_unexpected(node, plain, path))
    if body:
        out.append(_join(body) if is_row else F.when(wrong, none).otherwise(_join(body)))
    return _join(out)


def _unexpected(node: Node, known: list[str], path: Column | None) -> Column:
    where = F.lit("<root>") if path is None else path
    if isinstance(node.kind, StructType):
        more = sorted({f.name for f in node.kind.fields} - set(known))
        return F.array(_fault(F.concat(F.lit("Unexpected keys at field "), where, F.lit(": " + ", ".join(more))), None)) if more else _none()
    if node.absent:
        return _none()
    have = F.map_keys(node.column if isinstance(node.kind, MapType) else kinds.as_map(node.as_variant()))
    more = F.array_sort(F.array_except(F.coalesce(have, F.array().cast("array<string>")), F.array(*map(F.lit, known))))
    return _when(F.size(more) > 0, _fault(F.concat(F.lit("Unexpected keys at field "), where, F.lit(": "), F.array_join(more, ", ")), None))


def _list_errors(node: Node, shape: list, path: Column | None) -> Column:
    head = shape[0] if shape and isinstance(shape[0], str) else ""
    if head == "`$ONE`":
        if len(shape) < 2:
            raise ValueError("$ONE: needs at least one alternative")
        ok = F.lit(False)
        for s in shape[1:]:
            ok = ok | (F.size(errors(node, s, path)) == 0)
        names = ", ".join(_describe(s) for s in shape[1:])
        return _when(~ok, _expected(path, f"one of {names}" if len(shape) > 2 else names, node))
    if head == "`$EXACT`":
        ok = F.lit(False)
        for s in shape[1:]:
            same = equals(node, s) if not isinstance(s, (dict, list)) else _same_tree(Node.variant(node.as_variant()) if not node.is_variant else node, s)
            ok = ok | F.coalesce(same, F.lit(False))
        names = ", ".join(_plain(s) for s in shape[1:])
        what = f"exactly equal to {'one of ' if len(shape) > 2 else ''}{names}"
        return _when(~ok, _expected(path, what, node) if path is not None else _fault(F.lit(f"Expected value {what}, but found "), node))
    if head == "`$REF`":
        raise NeedsTree(head)
    wrong = ~(node.missing() | F.coalesce(node.is_kind(kinds.LIST), F.lit(False)))
    out = [_when(wrong, _expected(path, "list", node))]
    if head == "`$CHILD`":
        out.append(F.when(F.coalesce(node.is_kind(kinds.LIST), F.lit(False)), _each_child(node, shape[1], path)).otherwise(_none()))
    elif shape:
        body = _join([errors(node.child(i, True), s, _sub(path, str(i))) for i, s in enumerate(shape)])
        out.append(F.when(wrong, _none()).otherwise(body))
    return _join(out)


def _plain(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, sort_keys=True, separators=(",", ":")).replace('"', "")


def _describe(shape) -> str:
    return _CHECKS.get(shape, shape.strip("`$").lower()) if isinstance(shape, str) else _plain(shape)


def _same_tree(node: Node, value) -> Column:
    """Whether a VARIANT value equals a literal map or list: 1 is 1.0, and keys come in any order."""
    if isinstance(value, dict):
        parts = [_same_tree(node.child(k), x) for k, x in value.items()]
        size = F.size(F.try_variant_get(node.column, "$", "map<string,variant>"))
        return reduce(operator.and_, parts, F.coalesce(size == len(value), F.lit(False)))
    if isinstance(value, (list, tuple)):
        size = F.size(F.try_variant_get(node.column, "$", "array<variant>"))
        return reduce(operator.and_, (_same_tree(node.child(i, True), x) for i, x in enumerate(value)), F.coalesce(size == len(value), F.lit(False)))
    if node.absent:
        return F.lit(False)
    if value is None:
        return F.coalesce(F.is_variant_null(node.col), F.lit(False))
    return F.coalesce(equals(node, value), F.lit(False))


def _literal(value) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def _as_map(entries: Column) -> Column:
    return F.to_variant_object(F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull())))


def completed(node: Node, shape) -> Column:
    """The document with the shape's defaults, as VARIANT; absent is NULL. Values of a wrong kind stay."""
    own = node.as_variant()
    if isinstance(shape, dict):
        return _completed_map(node, own, shape)
    if isinstance(shape, (list, tuple)):
        return _completed_list(node, own, list(shape))
    if shape is None or isinstance(shape, str) and shapes._REF.fullmatch(shape):
        return own
    return F.when(node.missing(), _literal(shape)).otherwise(own)


def _completed_map(node: Node, own: Column, shape: dict) -> Column:
    plain = sorted(k for k in shape if k not in (shapes.OPEN, shapes.CHILD))
    entry = "array<struct<key:string,value:variant>>"
    fields = [F.struct(F.lit(k).alias("key"), completed(node.child(k), shape[k]).alias("value")) for k in plain]
    made = F.array(*fields).cast(entry) if fields else F.array().cast(entry)
    if shapes.CHILD in shape or not shape or shape.get(shapes.OPEN) is True:
        more = F.coalesce(nodes.entries(kinds.as_map(own)), F.array().cast(entry))
        more = F.filter(more, lambda x: ~x["key"].isin(*plain)) if plain else more
        if shapes.CHILD in shape:
            more = F.transform(more, lambda x: F.struct(x["key"].alias("key"), completed(Node.variant(x["value"]), shape[shapes.CHILD]).alias("value")))
        made = F.concat(made, more)
    is_row = node.col is None and not node.absent
    fits = F.lit(True) if is_row else node.missing() | F.coalesce(node.is_kind(kinds.MAP), F.lit(False))
    return F.when(fits, _as_map(made)).otherwise(own)


def _completed_list(node: Node, own: Column, shape: list) -> Column:
    head = shape[0] if shape and isinstance(shape[0], str) else ""
    if head == "`$ONE`":
        return F.coalesce(*(F.when(F.size(errors(node, x)) == 0, completed(node, x)) for x in shape[1:]), own)
    if head == "`$EXACT`":
        return own
    if head == shapes.CHILD:
        made = F.transform(kinds.as_list(own), lambda x: completed(Node.variant(x), shape[1]))
    elif shape:
        made = F.array(*(completed(node.child(i, True), x) for i, x in enumerate(shape)))
        made = F.filter(made, lambda x: x.isNotNull())
    else:
        made = kinds.as_list(own)
    fits = node.missing() | F.coalesce(node.is_kind(kinds.LIST), F.lit(False))
    return F.when(fits, F.to_variant_object(F.coalesce(made, F.array().cast("array<variant>")))).otherwise(own)


def _by_trees(df: DataFrame, node: Node, shape, extra: dict | None, meta: dict | None) -> Column:
    """Row (out: JSON text, errs) of the tree engine over the document's JSON text."""
    v = node.column if isinstance(node.kind, (StructType, MapType, ArrayType, VariantType)) else node.as_variant()
    return shapes.checked_udf(shape, extra, meta)(F.to_json(v))


def _checked(shape, extra: dict) -> None:
    """Unknown checkers raise while a shape is compiled."""
    if isinstance(shape, dict):
        for x in (v for k, v in shape.items() if k != shapes.OPEN):
            _checked(x, extra)
    elif isinstance(shape, (list, tuple)):
        head = shape[0] if shape and isinstance(shape[0], str) else ""
        for x in () if head in ("`$EXACT`", "`$REF`") else shape[1:] if head in ("`$ONE`", shapes.CHILD) else shape:
            _checked(x, extra)
    elif isinstance(shape, str) and (m := shapes._REF.fullmatch(shape)) and m[1].startswith("$"):
        if shape not in _CHECKS and m[1] not in ("$ANY", "$NIL") and m[1] not in extra and not shapes._META.fullmatch(m[1]):
            raise ValueError(f"unknown checker: {m[1]}")


def _with_meta(shape, meta: dict):
    """The shape with the constants that `name$=path` (exactly) and `name$~path` (as a default) read from meta."""
    if isinstance(shape, dict):
        return {k: _with_meta(v, meta) for k, v in shape.items()}
    if isinstance(shape, (list, tuple)):
        return list(shape) if shape and shape[0] == "`$EXACT`" else [_with_meta(x, meta) for x in shape]
    if isinstance(shape, str) and (m := shapes._REF.fullmatch(shape)) and (how := shapes._META.fullmatch(m[1])):
        want = trees.getpath({}, m[1], meta=meta)
        if want is trees.ABSENT or want is None or trees.is_node(want):
            raise NeedsTree(shape)
        return ["`$EXACT`", want] if how[1] == "=" else want
    return shape


def validate(df: DataFrame, shape, doc: str | None = None, strict: bool = False, out: str | None = None, extra: dict | None = None, meta: dict | None = None) -> DataFrame:
    """df with errs (array of texts); strict raises the texts of a bad row, joined by ' | '.

    out names a VARIANT column for the completed document. extra has checkers of one's own by `$NAME` ((value, path, errors) ->
    value) and values under the data; meta has what `name$=path` and `name$~path` read, and `$EXACT`.
    """
    node = Node.row(df) if doc is None else Node(F.col(doc), df.schema[doc].dataType)
    made = None
    _checked(shape, extra or {})
    given = shape
    try:
        if extra or (meta or {}).get("`$EXACT`") is True:
            raise NeedsTree("names from outside")
        shape = _with_meta(shape, meta) if meta else shape
        errs = texts(errors(node, shape))
        made = completed(node, shape) if out else None
    except NeedsTree:
        both = _by_trees(df, node, given, extra, meta)
        errs, made = both["errs"], F.parse_json(both["out"])
    if strict:
        errs = F.when(F.size(errs) > 0, F.raise_error(F.array_join(errs, " | ")).cast("array<string>")).otherwise(errs)
    more = {"errs": errs} | ({out: made} if out else {})
    return df.withColumns(more)
