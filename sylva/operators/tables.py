"""Templates whose collections are tables: `$EACH` and `$PACK` over all rows, and references into another table's packed map.

A table's row is an element of the collection: `.name` reads its column. `$EACH` is a projection, `$PACK` keeps the last row of each key
by an aggregation before the shuffle, and `customers.$GET:o_custkey$.c_name` becomes a join; whether a side is broadcast is left to Spark,
which knows their sizes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.node import Node
from .transform import Context, _column, _text, compile_map, compile_spec, paths, transform

_ACROSS = re.compile(r"([^.`$]+)\.(?:\$GET:([^$`]*)\$|([^.`$]+))((?:\.[^`]*)?)")


def each_table(df: DataFrame, spec: dict, extra: dict | None = None) -> DataFrame:
    """`$EACH`: one row of spec's fields for each row of the table."""
    row = Node.row(df)
    fields = compile_map(spec, Context(row, row, spec, extra=extra or {}))
    return df.select(*(c.alias(k) for k, c in fields.items()))


def pack_table(df: DataFrame, spec: dict, order: list[str], extra: dict | None = None) -> DataFrame:
    """`$PACK`: key (text) and value, one row for each key; of equal keys the last row by the order columns stays.

    spec has `$KEY` (a column, or text with references) and either fields or `$VAL`. Rows whose key is absent or empty are left out; rows equal
    in all order columns are told apart by the text of what they give.
    """
    row = Node.row(df)
    cx = Context(row, row, spec, extra=extra or {})
    name = spec["`$KEY`"]
    body = {k: v for k, v in spec.items() if k != "`$KEY`"}
    made = compile_spec(body["`$VAL`"] if set(body) == {"`$VAL`"} else body, cx)
    key = _text(compile_spec(name, cx)) if "`" in name else row.path(paths.resolve(name)).text()
    rows = df.select(key.alias("key"), _column(made).alias("value"), F.struct(*(F.col(f"`{c}`") for c in order)).alias("at")).where("key <> ''")
    return rows.groupBy("key").agg(F.max_by("value", F.struct("at", F.to_json(F.struct("value")))).alias("value"))


def transform_tables(df: DataFrame, spec: dict, tables: dict[str, DataFrame], extra: dict | None = None) -> DataFrame:
    """transform() whose references may begin with the name of a packed table (key, value: see pack_table).

    The next step is the key: `$GET:path$` reads it from the row, other text is the key itself. A key that the table does not have gives NULL. One
    join is made for each table and key, however many references use it.
    """
    joins: dict[tuple, str] = {}

    def across(ref: str) -> str:
        m = _ACROSS.fullmatch(ref)
        if not m or m[1] not in tables:
            return ref
        place = joins.setdefault((m[1], m[2], m[3]), f"__t{len(joins)}")
        return f"{place}.value{m[4]}"

    def renamed(part):
        if isinstance(part, dict):
            return {k: renamed(v) for k, v in part.items()}
        if isinstance(part, (list, tuple)):
            return [renamed(v) for v in part]
        return re.sub(r"`([^`]*)`", lambda m: f"`{across(m[1])}`", part) if isinstance(part, str) else part

    spec = renamed(spec)
    row = Node.row(df)
    keys: dict[str, Column] = {at: F.lit(text) if path is None else row.path(paths.resolve(path)).text() for (_, path, text), at in joins.items()}
    out = df.select("*", *(key.alias(f"{at}_key") for at, key in keys.items()))
    for (name, _, _), at in joins.items():
        other = tables[name].select(F.col("key").alias(f"{at}_k"), F.struct("value").alias(at))
        out = out.join(other, F.col(f"{at}_key") == F.col(f"{at}_k"), "left")
    return transform(out, spec, extra=extra)
