"""select: predicate documents compiled to one boolean column.

Equality needs the same type; nested maps match subsets, lists match by index as a prefix. `$AND`, `$OR`, `$NOT`
combine queries; `$GT`, `$GTE`, `$LT`, `$LTE` compare the value at their place, `$LIKE` searches its text.
All results are two-valued: a comparison with a missing value fails and its negation holds.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, MapType, NumericType, StringType

from ..functions import kinds, nodes
from ..functions.scalars import re_compile
from ..plans.node import Node, equals

_COMPARE = {"`$GT`": operator.gt, "`$GTE`": operator.ge, "`$LT`": operator.lt, "`$LTE`": operator.le}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _compare(node: Node, op, value) -> Column:
    if node.absent:
        return F.lit(False)
    if isinstance(node.kind, NumericType) and isinstance(value, (int, float)) and not isinstance(value, bool):
        return op(node.col, F.lit(value))
    if isinstance(node.kind, StringType) and isinstance(value, str):
        return op(node.col, F.lit(value))
    # mixed kinds compare as numbers; two strings as text
    text = node.string()
    blank = F.when(F.trim(text) == "", F.lit(0.0))  # text without a mark counts as 0
    number = F.coalesce(node.number(), F.expr("CAST(NULL AS DOUBLE)") if not node.is_variant else kinds.boolean(node.col).cast("double"), blank, text.try_cast("double"))
    if isinstance(value, str):
        try:
            as_number = float(value) if value.strip() else 0.0
        except ValueError:
            as_number = None
        mixed = op(number, F.lit(as_number)) if as_number is not None else F.lit(False)
        return _sure(F.when(text.isNotNull(), op(text, F.lit(value))).otherwise(mixed))
    return F.lit(False) if value is None else _sure(op(number, F.lit(float(value))))


def predicate(node: Node, query, key: Node | None = None) -> Column:
    """Whether the document matches; key is what `$KEY` names, the place of a child among its siblings."""
    if key is not None and isinstance(query, dict) and "$KEY" in query:
        rest = {k: v for k, v in query.items() if k != "$KEY"}
        return predicate(key, query["$KEY"]) & node.is_kind(kinds.MAP) & (predicate(node, rest, key) if rest else F.lit(True))
    if isinstance(query, dict):
        tests = []
        plain = {k: v for k, v in query.items() if not k.startswith("`$")}
        for name, arg in query.items():
            if name in _COMPARE:
                tests.append(_compare(node, _COMPARE[name], arg))
            elif name == "`$LIKE`":
                tests.append(F.regexp_like(F.coalesce(node.text(), F.lit("")), F.lit(re_compile(str(arg)))))
            elif name == "`$AND`":
                tests.append(reduce(operator.and_, (predicate(node, q, key) for q in arg), F.lit(True)))
            elif name == "`$OR`":
                tests.append(reduce(operator.or_, (predicate(node, q, key) for q in arg), F.lit(False)))
            elif name == "`$NOT`":
                tests.append(~_sure(predicate(node, arg, key)))
            elif name not in plain and name != "`$OPEN`":
                raise ValueError(f"unknown operator: {name}")
        if plain or not query:
            if node.col is not None or node.absent:  # a row is a map anyway
                tests.append(node.is_kind(kinds.MAP))
            tests += [predicate(node.get(k), v) for k, v in plain.items()]
        return reduce(operator.and_, tests, F.lit(True))
    if isinstance(query, (list, tuple)):
        return reduce(operator.and_, (predicate(node.get(i), q) for i, q in enumerate(query)), node.is_kind(kinds.LIST))
    return equals(node, query)


def select(df: DataFrame, query, doc: str | None = None) -> DataFrame:
    """Rows that match; doc names a column with the documents (else the row is the document)."""
    node = Node.row(df) if doc is None else Node(F.col(doc), df.schema[doc].dataType)
    return df.where(predicate(node, query))


def select_list(col: Column, kind: DataType, query) -> Column:
    """Elements of an array (of any type) or of a VARIANT list that match."""
    if isinstance(kind, ArrayType):
        return F.filter(col, lambda x: _sure(predicate(Node(x, kind.elementType), query)))
    return F.filter(kinds.as_list(col), lambda x: _sure(predicate(Node.variant(x), query)))


def select_children(col: Column, kind: DataType, query) -> Column:
    """array<struct<key, value>> of the children of a map (by key) or of a list that match, as their parent has them."""
    if isinstance(kind, MapType):
        return F.filter(nodes.entries(col), lambda x: _sure(predicate(Node(x["value"], kind.valueType), query, Node(x["key"], StringType()))))
    if isinstance(kind, ArrayType):
        places = F.transform(col, lambda x, i: F.struct(i.cast("long").alias("key"), x.alias("value")))
        return F.filter(places, lambda x: _sure(predicate(Node(x["value"], kind.elementType), query, Node(x["key"], LongType()))))
    # a list's keys are numbers, a map's are texts
    own = lambda x: nodes.as_variant(x["key"].cast("long"))
    key = lambda x: F.when(kinds.islist(col), own(x)).otherwise(nodes.as_variant(x["key"]))
    return F.filter(nodes.items(col), lambda x: _sure(predicate(Node.variant(x["value"]), query, Node.variant(key(x)))))
