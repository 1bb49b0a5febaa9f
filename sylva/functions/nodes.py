"""Reading and changing nodes (VARIANT columns); all functions are pure."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kinds

_INDEX = re.compile(r"0|[1-9][0-9]*")


def _key(key: str | int | float) -> str:
    return str(int(key // 1)) if isinstance(key, (int, float)) and not isinstance(key, bool) else key


def lookup(v: Column, key: str | int | float) -> Column:
    """v[key] as it is, null kept; absent is SQL NULL."""
    k = _key(key)
    if k == "":
        return F.lit(None).cast("variant")
    if '"' in k or "\\" in k:
        named = F.try_element_at(kinds.as_map(v), F.lit(k))
    else:
        named = F.variant_get(v, f'$["{k}"]', "variant")
    if _INDEX.fullmatch(k):
        return F.coalesce(named, F.variant_get(v, f"$[{k}]", "variant"))
    return named


def getprop(v: Column, key: str | int | float, alt: Column | None = None) -> Column:
    """v[key]; absent and null give alt."""
    found = kinds.present(lookup(v, key))
    return found if alt is None else F.coalesce(found, alt)


def getelem(v: Column, index: int, alt: Column | None = None) -> Column:
    """Element of a list; negative indexes count from the end."""
    found = kinds.present(F.try_element_at(kinds.as_list(v), F.lit(index + 1 if index >= 0 else index)))
    return found if alt is None else F.coalesce(found, alt)


def _step(v: Column, key: Column) -> Column:
    """v[key] with a key that is text of the row, null kept."""
    named = F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), key)
    index = F.when(key.rlike(f"^({_INDEX.pattern})$"), key.try_cast("int"))
    return F.coalesce(named, F.get(F.try_variant_get(v, "$", "array<variant>"), index))


def getprop_at(v: Column, key: Column, alt: Column | None = None, number: bool = False) -> Column:
    """getprop with a key from the row: text, or (number) a number, which is floored; a null or empty key has no value."""
    text = key.cast("string")
    text = F.when(text.rlike(r"^-?[0-9]+\.[0-9]+$"), F.floor(text.try_cast("double")).cast("string")).otherwise(text) if number else text
    found = F.when(text != "", bind(text, lambda k: kinds.present(_step(v, k))))
    return found if alt is None else F.coalesce(found, alt)


def getelem_at(v: Column, index: Column, alt: Column | None = None) -> Column:
    """getelem with an index from the row; negative ones count from the end. alt can be a function of the list (a default made when needed)."""
    at = index.try_cast("int")
    place = F.when(at >= 0, at + 1).otherwise(at)
    found = bind(F.try_variant_get(v, "$", "array<variant>"), lambda a: kinds.present(F.try_element_at(a, place)))
    return found if alt is None else F.coalesce(found, alt(v) if callable(alt) else alt)


def getpath_at(v: Column, path: Column, alt: Column | None = None) -> Column:
    """The value at a dotted path that is a column, as paths.getpath() finds a constant one; a null or empty path is the root.

    An empty step starts again at the root; two in a row lead above it, where nothing is. $$ is a plain $.
    """
    steps = F.transform(F.split(F.regexp_replace(path, r"(?s)^.*\.\.|^\.", ""), "\\."), lambda s: F.replace(s, F.lit("$$"), F.lit("$")))
    walked = kinds.present(F.aggregate(steps, v, lambda at, s: F.when(s != "", _step(at, s))))
    root = path.isNull() | path.isin("", ".")
    found = F.when(root, v).when(path.rlike(r"^\.\.|\.\.\.|\.\.$"), F.lit(None).cast("variant")).when(path.endswith("."), v).otherwise(walked)
    return found if alt is None else F.coalesce(found, alt)


def getdef(v: Column, alt: Column) -> Column:
    """alt only where v is absent (null stays)."""
    return F.coalesce(v, alt)


def haskey(v: Column, key: str | int | float) -> Column:
    return ~kinds.is_missing(lookup(v, key))


def keysof(v: Column) -> Column:
    """Sorted keys of a map, indexes of a list, else nothing."""
    n = F.size(kinds.as_list(v))
    indexes = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("string")))
    return F.coalesce(F.array_sort(F.map_keys(kinds.as_map(v))), indexes, F.array().cast("array<string>"))


def entries(m: Column) -> Column:
    """Entries of a map column in order of their keys; one pass and one sort."""
    return F.array_sort(F.map_entries(m), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def items(v: Column, to=None) -> Column:
    """array<struct<key, value>> in the order of keysof; or what to(key, value) makes of each."""
    listed = F.transform(kinds.as_list(v), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
    out = F.coalesce(entries(kinds.as_map(v)), listed, F.array().cast("array<struct<key:string,value:variant>>"))
    return out if to is None else F.transform(out, lambda x: to(x["key"], x["value"]))


def filter_values(v: Column, check) -> Column:
    """Values of the items for which check(key, value) holds."""
    return F.transform(F.filter(items(v), lambda x: check(x["key"], x["value"])), lambda x: x["value"])


def jm(**pairs: Column) -> Column:
    """A map of named values."""
    return F.to_variant_object(F.struct(*(c.alias(k) for k, c in pairs.items())))


def jt(*values: Column) -> Column:
    """A list of values."""
    return F.to_variant_object(F.array(*(as_variant(v) for v in values)))


def as_variant(c: Column) -> Column:
    return F.variant_get(F.to_variant_object(F.struct(c.alias("v"))), "$.v", "variant")


def bind(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def writable(v: Column) -> Column:
    """v; a condensed value raises, as it must be expanded before it can be changed."""
    condensed = F.coalesce(F.try_variant_get(v, "$['$condense']", "int") == 1, F.lit(False)) & islist_at(v, "sym") & islist_at(v, "node")
    return F.when(condensed, F.raise_error(F.lit("a condensed value cannot be changed; expand it first")).cast("variant")).otherwise(v)


def islist_at(v: Column, key: str) -> Column:
    return kinds.islist(F.variant_get(v, f"$['{key}']", "variant"))


def setprop(v: Column, key: str | int, value: Column) -> Column:
    """A copy with v[key] = value; in lists an index past the end appends, a negative one prepends."""
    return v if _key(key) == "" else bind(writable(v), lambda x: _set(x, key, value))


def _set(v: Column, key: str | int, value: Column) -> Column:
    k = _key(key)
    m, a = kinds.as_map(v), kinds.as_list(v)
    named = F.to_variant_object(F.map_concat(F.map_filter(m, lambda n, _: n != k), F.create_map(F.lit(k), value)))
    if not re.fullmatch(r"-?\d+", k):
        return F.when(kinds.ismap(v), named).otherwise(v)
    i = int(k)
    if i < 0:
        listed = F.concat(F.array(value), a)
    else:
        listed = F.when(F.size(a) <= i, F.concat(a, F.array(value))).otherwise(F.transform(a, lambda x, n: F.when(n == i, value).otherwise(x)))
    return F.when(kinds.ismap(v), named).when(kinds.islist(v), F.to_variant_object(listed)).otherwise(v)


def delprop(v: Column, key: str | int) -> Column:
    """A copy without v[key]; later list elements move up."""
    return bind(writable(v), lambda x: _without(x, key))


def _without(v: Column, key: str | int) -> Column:
    k = _key(key)
    named = F.to_variant_object(F.map_filter(kinds.as_map(v), lambda n, _: n != k))
    if not _INDEX.fullmatch(k):
        return F.when(kinds.ismap(v), named).otherwise(v)
    listed = F.to_variant_object(F.filter(kinds.as_list(v), lambda _, i: i != int(k)))
    return F.when(kinds.ismap(v), named).when(kinds.islist(v), listed).otherwise(v)
