"""Deep merge: later values win; maps merge by key, lists by index, other pairs are replaced.

merge() and merge_variants() merge values that stand in one row, at any depth. merge_layers() and merge_agg() merge rows: few rows
of a key in their row, more as a relation: documents are walked, the last layer wins at every path, conflicts of kind are settled by prefix, and
winners are nested again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from ..functions import nodes
from ..functions.nodes import bind
from ..session import settled
from .nest import match, nest
from .walk import MAXDEPTH, by_levels, kind_of, opened, walk


def merge_maps(*maps: Column) -> Column:
    """Overlay of map<string, T> columns (one level); later entries win, null entries too."""

    def two(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    return reduce(two, maps)


def merge_variants(values: list[Column], maxdepth: int | None = None) -> Column:
    """Merge of VARIANT columns in one expression; absent values (SQL NULL) are left out, a stored null replaces.

    At maxdepth the later value replaces instead of merging; 0 and less give the last value, maps and lists emptied.
    """
    limit = MAXDEPTH if maxdepth is None else max(0, maxdepth)
    if limit == 0:
        last = F.coalesce(*reversed(values))
        return bind(opened(last), lambda x: F.when(x["m"].isNotNull(), F.parse_json(F.lit("{}"))).when(x["a"].isNotNull(), F.parse_json(F.lit("[]"))).otherwise(x["v"]))

    there = F.filter(F.array(*values), lambda v: v.isNotNull())
    return bind(there, lambda layers: F.when(F.size(layers) > 0, merge_array(layers, limit)))


#: Levels of a document that merge_array() has an expression of their own for; deeper ones share one.
UNROLLED = 4


def merge_array(layers: Column, limit: int = MAXDEPTH, depth: int = 0) -> Column:
    """merge_variants() of the elements of an array<variant> without nulls that has at least one, for a limit above 0.

    What only one layer has is taken as it is, unopened.
    """
    if depth == limit:
        return F.element_at(layers, -1)
    if depth == UNROLLED:
        return by_levels(layers, "array<variant>", _last_decides, None, limit - depth)
    each = lambda have, v: F.when(v.isNull(), have).when(have.isNull(), F.array(v)).otherwise(F.array_append(have, v))

    def overlaid(last: Column) -> Column:
        """array<struct<key, load>> of a map or (keys null) a list; a layer of another kind starts it anew. NULL for scalars."""
        maps = F.aggregate(layers, F.create_map().cast("map<string,array<variant>>"), lambda acc, x: bind(F.try_variant_get(x, "$", "map<string,variant>"), lambda m: F.when(m.isNull(), F.create_map().cast("map<string,array<variant>>")).otherwise(F.map_zip_with(acc, m, lambda _, have, v: each(have, v)))).cast("map<string,array<variant>>"))
        lists = F.aggregate(layers, F.array().cast("array<array<variant>>"), lambda acc, x: bind(F.try_variant_get(x, "$", "array<variant>"), lambda a: F.when(a.isNull(), F.array().cast("array<array<variant>>")).otherwise(F.zip_with(acc, a, each))).cast("array<array<variant>>"))
        pairs = F.when(F.try_variant_get(last, "$", "map<string,variant>").isNotNull(), F.transform(F.map_entries(maps), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("load"))).cast(_LOADS))
        return pairs.when(F.try_variant_get(last, "$", "array<variant>").isNotNull(), F.transform(lists, lambda e: F.struct(F.lit(None).cast("string").alias("key"), e.alias("load"))).cast(_LOADS))

    def built(kids: Column) -> Column:
        return F.when(kids[0]["key"].isNull(), F.to_variant_object(F.transform(kids, lambda e: e["value"]))).otherwise(F.to_variant_object(F.map_from_entries(kids)))

    def merged(last: Column) -> Column:
        kids = lambda loads: F.transform(loads, lambda e: F.struct(e["key"].alias("key"), bind(e["load"], lambda x: merge_array(x, limit, depth + 1)).alias("value"))).cast("array<struct<key:string,value:variant>>")
        return bind(overlaid(last), lambda loads: F.when(F.coalesce(F.size(loads), F.lit(0)) < 1, last).otherwise(bind(kids(loads), built)))

    return F.when(F.size(layers) == 1, F.element_at(layers, 1)).otherwise(bind(F.element_at(layers, -1), merged)).cast("variant")


def _last_decides(key: Column, layers: Column, parent: Column, path: Column) -> Column:
    """expand of by_levels(): the last layer decides; it merges with those before it that have its kind, back to one that has not."""

    def inside(x: Column) -> Column:
        kind = kind_of(F.element_at(x, -1))
        other = F.filter(F.transform(x, lambda e, i: F.when(kind_of(e) != kind, i)), lambda i: i.isNotNull())
        run = F.slice(x, F.coalesce(F.try_element_at(other, F.lit(-1)), F.lit(-1)) + 2, F.size(x))
        return F.struct(kind.alias("kind"), F.element_at(x, -1)["v"].alias("value"), F.when(kind == "scalar", F.array().cast(_LOADS)).otherwise(bind(run, gathered)).alias("kids"))

    def gathered(run: Column) -> Column:
        """The layers' values of each key; keys of a list stay in order, as what only a longer one has comes last."""
        keyed = lambda x: F.coalesce(x["m"], F.map_from_entries(F.transform(x["a"], lambda e, i: F.struct(i.cast("string").alias("key"), e.alias("value")))))
        add = lambda acc, x: F.map_zip_with(acc, keyed(x), lambda _, have, v: F.when(v.isNull(), have).when(have.isNull(), F.array(v)).otherwise(F.array_append(have, v))).cast("map<string,array<variant>>")
        found = F.aggregate(run, F.create_map().cast("map<string,array<variant>>"), add)
        return F.transform(F.map_entries(found), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("load")))

    one = F.struct(F.lit("scalar").alias("kind"), F.element_at(layers, 1).alias("value"), F.array().cast(_LOADS).alias("kids"))
    return F.when(F.size(layers) == 1, one).otherwise(bind(F.transform(layers, opened), inside))


_LOADS = "array<struct<key:string,load:array<variant>>>"


def merge_depth(values: list[Column], depth: int) -> Column:
    """Merge of VARIANT columns to a depth: below it the later value replaces."""
    return merge_variants(values, depth) if depth > 0 else F.coalesce(*reversed(values))


def merge(values: list[Column], maxdepth: int | None = None) -> Column:
    """Merge of JSON text columns to any depth; JSON text, keys sorted."""
    return F.to_json(merge_variants([F.parse_json(v) for v in values], maxdepth))


def merge_layers(df: DataFrame, by: list[str], layer: list[str], doc: str, maxdepth: int | None = None) -> DataFrame:
    """by and doc (VARIANT): for each by the merge of its rows' documents in order of the layer columns.

    Rows are counted by key first. The documents of a key with at most FEW are collected and merged in their row, so whole documents are
    shuffled once and nothing is written. For the others every path's last layer of each kind is aggregated before the shuffle, however many
    rows a key has; a path that changes its kind cuts off what was below it before: those layers' nodes go by a join on their ancestors, and
    nest() puts the rest together.
    Absent documents are left out, and keys with nothing else with them; rows of one layer should differ in the layer columns.
    """
    limit = MAXDEPTH if maxdepth is None else max(0, maxdepth)
    keys = [f"__k{i}" for i in range(len(by))]
    docs = df.where(F.col(f"`{doc}`").isNotNull()).select(*(F.col(f"`{c}`").alias(k) for k, c in zip(keys, by, strict=True)), F.struct(*(F.col(f"`{c}`") for c in layer)).alias("layer"), F.col(f"`{doc}`").alias("doc"))
    if limit == 0:
        last = docs.groupBy(*keys).agg(F.max_by("doc", "layer").alias("doc"))
        return last.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), merge_variants([F.col("doc")], 0).alias(doc))
    heavy = settled(docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > FEW).select(*keys))
    if heavy.isEmpty():
        made = _in_rows(docs, keys, limit)
    else:
        made = _in_rows(match(docs, heavy, keys, "left_anti"), keys, limit).unionByName(_by_paths(match(docs, heavy, keys, "left_semi"), keys, limit))
    return made.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), F.col("doc").alias(doc))


#: Rows of a key that are merged in one row; more go by their paths.
FEW = 64


def _in_rows(docs: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """keys and doc, from keys, layer and doc of keys with few rows."""
    order = lambda a, b: F.when(a["layer"] < b["layer"], -1).when(a["layer"] > b["layer"], 1).otherwise(0)
    layers = docs.groupBy(*keys).agg(F.collect_list(F.struct("layer", "doc")).alias("layers"))
    return layers.select(*keys, bind(F.transform(F.array_sort("layers", order), lambda x: x["doc"]), lambda x: merge_array(x, limit)).alias("doc"))


def _by_paths(docs: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """keys and doc, from keys, layer and doc of keys with any number of rows."""
    seen = walk(docs, "doc", [*keys, "layer"], limit)
    of = lambda kind: F.when(F.col("kind") == kind, F.col("layer"))
    rows = seen.groupBy(*keys, "path").agg(F.max("depth").alias("depth"), F.max(of("map")).alias("map"), F.max(of("list")).alias("list"), F.max(of("scalar")).alias("scalar"), F.max_by("value", of("scalar")).alias("value"))
    last = F.greatest("map", "list", "scalar")
    rows = rows.select(*keys, "path", "depth", last.alias("last"), "map", "list", "scalar", "value")
    kind = F.when(F.col("scalar") == F.col("last"), "scalar").when(F.col("map") == F.col("last"), "map").otherwise("list")
    rows = settled(rows.withColumn("kind", kind))  # as small as the merged documents; the walk is done once
    # nodes below it of this layer and of those before are gone
    none = F.lit(None).cast(docs.schema["layer"].dataType)
    cut = F.greatest(F.when(F.col("kind") != "map", F.col("map")), F.when(F.col("kind") != "list", F.col("list")), F.col("scalar"), none)
    cuts = rows.where((F.col("map").isNotNull().cast("int") + F.col("list").isNotNull().cast("int") + F.col("scalar").isNotNull().cast("int")) > 1).select(*keys, F.col("path").alias("above"), cut.alias("cut"))
    touched = match(rows.where("depth > 0").select(*keys, "path", "last"), cuts.select(*keys).distinct(), keys, "left_semi")
    below = touched.select(*keys, "path", "last", F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda k: F.slice("path", F.lit(1), k))).alias("above"))
    gone = match(below, cuts, [*keys, "above"]).where("last <= cut").select(*keys, "path").distinct()
    kept = match(rows, gone, [*keys, "path"], "left_anti")
    return nest(kept, keys, kind="kind", out="doc", depth=None)


def merge_agg(df: DataFrame, by: list[str], order: str, fields: list[str]) -> DataFrame:
    """Merge of the rows of each key in order (equal orders by the value's text, documents by its hash): one row for each key.

    Of a scalar field the last value that is there stays. Maps, lists and VARIANT fields are merged as deep as they go by merge_layers()
    (VARIANT). No task collects more than FEW documents of a key: scalars and the paths of keys with more are aggregated before the shuffle.
    """
    deep = [c for c in fields if isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType, VariantType))]
    flat = [c for c in fields if c not in deep]
    last = {c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c).cast("string")))).alias(c) for c in flat}
    out = df.groupBy(*by).agg(*last.values()) if flat else df.select(*by).distinct()
    if deep:
        values = {c: F.col(c) if isinstance(df.schema[c].dataType, VariantType) else F.when(F.col(c).isNotNull(), nodes.as_variant(F.col(c))) for c in deep}
        pairs = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), v.alias("value")) for c, v in values.items())), lambda e: e["value"].isNotNull())
        docs = df.select(*by, F.col(order).alias("__order"), F.when(F.size(pairs) > 0, F.to_variant_object(F.map_from_entries(pairs))).alias("__doc"))
        docs = docs.withColumn("__tie", F.xxhash64(F.to_json("__doc")))
        merged = merge_layers(docs, by, ["__order", "__tie"], "__doc")
        out = match(out, merged, by, "left").select(*by, *flat, *(nodes.lookup(F.col("__doc"), c).alias(c) for c in deep))
    return out.select(*by, *fields)
