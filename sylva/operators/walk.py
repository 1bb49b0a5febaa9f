"""walk as a relation (one row for each node of a document) and as a rewrite of documents, in built-in expressions.

Both are functions of a row: levels of a document are unfolded inside its row, so nothing is shuffled and columns are pruned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nodes
from ..functions.nodes import bind

MAXDEPTH = 32

#: What a callback of rewrite() gets: key (NULL at the root), value, parent (NULL at the root), path (array of keys).
Visit = Callable[[Column, Column, Column, Column], Column]

_ROW = "struct<key:string,path:array<string>,ord:array<int>,depth:int,kind:string,value:variant>"


def opened(v: Column) -> Column:
    """Fields v, m and a: a value with its entries if it is a map, or its elements if it is a list."""
    return F.struct(v.alias("v"), F.try_variant_get(v, "$", "map<string,variant>").alias("m"), F.try_variant_get(v, "$", "array<variant>").alias("a"))


def children(x: Column) -> Column:
    """array<struct<key, value>> of an opened value, in order of the keys; empty for scalars."""
    listed = F.transform(x["a"], lambda e, i: F.struct(i.cast("string").alias("key"), e.alias("value")))
    return F.coalesce(nodes.entries(x["m"]), listed, F.array().cast("array<struct<key:string,value:variant>>"))


def kind_of(x: Column) -> Column:
    """'map', 'list' or 'scalar' of an opened value."""
    return F.when(x["m"].isNotNull(), "map").when(x["a"].isNotNull(), "list").otherwise("scalar")


def _limit(maxdepth: int | None) -> int:
    return MAXDEPTH if maxdepth is None or maxdepth < 0 else maxdepth


def nodes_of(v: Column, maxdepth: int | None = MAXDEPTH) -> Column:
    """array<struct<key, path, ord, depth, kind, value>> of all nodes down to maxdepth, level by level.

    At the limit a node is a scalar: its whole value stays in one piece.
    """
    limit = _limit(maxdepth)

    def row(key: Column, path: Column, order: Column, depth: Column, value: Column) -> Column:
        kind = bind(opened(value), kind_of) if limit else F.lit("scalar")
        return F.struct(key.alias("key"), path.alias("path"), order.alias("ord"), depth.alias("depth"), F.when(depth < limit, kind).otherwise("scalar").alias("kind"), value.alias("value"))

    def below(n: Column) -> Column:
        kids = lambda x: F.transform(children(x), lambda e, i: row(e["key"], F.array_append(n["path"], e["key"]), F.array_append(n["ord"], i), n["depth"] + 1, e["value"]))
        return F.when(n["kind"] != "scalar", bind(opened(n["value"]), kids)).otherwise(F.array().cast(f"array<{_ROW}>"))

    root = row(F.lit(None).cast("string"), F.array().cast("array<string>"), F.array().cast("array<int>"), F.lit(0), v)
    start = F.array(F.array(root)).cast(f"array<array<{_ROW}>>")
    if not limit:
        return F.flatten(start)
    step = lambda levels, _: F.when(F.size(F.element_at(levels, -1)) == 0, levels).otherwise(F.array_append(levels, F.flatten(F.transform(F.element_at(levels, -1), below)))).cast(f"array<array<{_ROW}>>")
    return F.flatten(F.aggregate(F.sequence(F.lit(1), F.lit(limit)), start, step))


def walk(df: DataFrame, doc: str, keep: list[str], maxdepth: int | None = MAXDEPTH) -> DataFrame:
    """keep columns, key, path (array), ord (array<int>), depth, kind and value (VARIANT) of all nodes of the VARIANT column doc.

    ord gives depth-first order. A document that is absent (SQL NULL) has one row, its root.
    """
    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.explode(nodes_of(F.col(f"`{doc}`"), maxdepth)).alias("__n"))
    return rows.select(*(F.col(f"`{c}`") for c in keep), "__n.key", "__n.path", "__n.ord", "__n.depth", "__n.kind", "__n.value")


def leaves(df: DataFrame, doc: str, keep: list[str]) -> DataFrame:
    """Rows of walk() that have no children: scalars, {} and []."""
    out = walk(df, doc, keep)
    return out.where((F.col("kind") == "scalar") | F.to_json("value").isin("{}", "[]"))


def build(kind: Column, kids: Column, value: Column) -> Column:
    """A map or a list of array<struct<key, value>> (lists in the order given), else the value."""
    as_map = F.to_variant_object(F.map_from_entries(kids))
    return F.when(kind == "scalar", value).when(kind == "map", as_map).otherwise(F.to_variant_object(F.transform(kids, lambda e: e["value"])))


def by_levels(load: Column, kind: str, expand: Callable, after: Visit | None, limit: int) -> Column:
    """A document made from the top down and put together from the bottom up, level by level, in one expression of a fixed size.

    expand(key, load, parent, path) gives struct(kind, value, kids: array<struct<key, load>>) of a node: a scalar's value is its result, a map
    or a list is built of what its kids become. kind is the type of load. Nodes at the limit are scalars that after does not see.
    """
    node = f"struct<i:int,pos:int,key:string,path:array<string>,parent:variant,last:boolean,kind:string,value:variant,kids:array<struct<key:string,load:{kind}>>>"
    level = f"struct<nodes:array<{node}>,starts:array<int>>"
    made = "struct<built:array<struct<key:string,value:variant>>,starts:array<int>>"
    null = F.lit(None)

    def one(i: Column, pos: Column, key: Column, x: Column, parent: Column, path: Column, last: Column) -> Column:
        own = lambda e: F.struct(i.alias("i"), pos.alias("pos"), key.alias("key"), path.alias("path"), parent.alias("parent"), last.alias("last"), F.when(last, "scalar").otherwise(e["kind"]).alias("kind"), e["value"].alias("value"), F.when(~last, e["kids"]).otherwise(F.array().cast(f"array<struct<key:string,load:{kind}>>")).alias("kids"))
        return bind(expand(key, x, parent, path), own)

    def down(levels: Column, d: Column) -> Column:
        inner = F.filter(F.element_at(levels, -1)["nodes"], lambda n: F.size(n["kids"]) > 0)
        kids = F.flatten(F.transform(inner, lambda n: F.transform(n["kids"], lambda k, pos: F.struct(pos.alias("pos"), k["key"].alias("key"), k["load"].alias("load"), n["value"].alias("parent"), F.array_append(n["path"], k["key"]).alias("path")))))

        def placed(raw: Column) -> Column:
            nodes_ = F.transform(raw, lambda r, i: one(i, r["pos"], r["key"], r["load"], r["parent"], r["path"], d >= limit))
            # where the kids of each node of the level above that has some begin
            first = F.filter(F.transform(raw, lambda r, i: F.struct(r["pos"].alias("pos"), i.alias("i"))), lambda x: x["pos"] == 0)
            return F.struct(nodes_.alias("nodes"), F.transform(first, lambda x: x["i"]).alias("starts"))

        return F.when(F.size(inner) == 0, levels).otherwise(F.array_append(levels, bind(kids, placed))).cast(f"array<{level}>")

    def up(acc: Column, at: Column) -> Column:
        def done(n: Column, kids: Column) -> Column:
            return F.struct(n["i"].alias("i"), n["key"].alias("key"), n["path"].alias("path"), n["parent"].alias("parent"), n["last"].alias("last"), build(n["kind"], kids, n["value"]).alias("value"))

        own = lambda n, a: F.filter(F.slice(acc["built"], F.get(acc["starts"], a) + 1, F.size(n["kids"])), lambda k: k["value"].isNotNull())
        inner = F.transform(F.filter(at["nodes"], lambda n: F.size(n["kids"]) > 0), lambda n, a: done(n, own(n, a)))
        outer = F.transform(F.filter(at["nodes"], lambda n: F.size(n["kids"]) == 0), lambda n: done(n, F.array().cast("array<struct<key:string,value:variant>>")))
        whole = F.array_sort(F.concat(inner, outer), lambda a, b: a["i"] - b["i"])
        seen = lambda n: bind(n["value"], lambda w: after(n["key"], w, n["parent"], n["path"])) if after else n["value"]
        built = F.transform(whole, lambda n: F.struct(n["key"].alias("key"), F.when(n["last"], n["value"]).otherwise(seen(n)).alias("value")))
        return F.struct(built.alias("built"), at["starts"].alias("starts")).cast(made)

    root = one(F.lit(0), F.lit(0), null.cast("string"), load, null.cast("variant"), F.array().cast("array<string>"), F.lit(limit == 0))
    levels = F.array(F.struct(F.array(root).alias("nodes"), F.array().cast("array<int>").alias("starts"))).cast(f"array<{level}>")
    if limit:
        levels = F.aggregate(F.sequence(F.lit(1), F.lit(limit)), levels, down)
    zero = F.struct(F.array().alias("built"), F.array().alias("starts")).cast(made)
    return F.aggregate(F.reverse(levels), zero, up, lambda acc: F.get(acc["built"], F.lit(0))["value"])


def rewrite(v: Column, before: Visit | None = None, after: Visit | None = None, maxdepth: int | None = MAXDEPTH) -> Column:
    """The document with every node replaced by what the callbacks make of it.

    before sees a value ahead of its children, which are those of what it gives; after sees it when they are done. Children for which
    NULL comes out are left out. A value at the depth limit is only seen by before. parent is what before made of it.
    """

    def expand(key: Column, value: Column, parent: Column, path: Column) -> Column:
        kids = lambda x: F.transform(children(x), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("load")))
        return bind(bind(before(key, value, parent, path) if before else value, opened), lambda x: F.struct(kind_of(x).alias("kind"), x["v"].alias("value"), kids(x).alias("kids")))

    return by_levels(v, "variant", expand, after, _limit(maxdepth))
