"""Condensed documents: shared symbols and hash-consed nodes, of one value (read in columns) and of a whole table (relations).

A condensed value is `{"$condense":1, "sym":[...], "node":[...], "root":n}`. A node is [0, symbol, node, ...] (map, by symbol),
[1, node, ...] (list), [2, symbol] (text), [3, number], [4] (true), [5] (false) or [6] (null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinds, nodes, paths
from ..functions.nodes import bind
from ..session import settled
from .walk import MAXDEPTH, build, by_levels, walk

# Node codes.
MAP, LIST, TEXT, NUMBER, TRUE, FALSE, NULL = range(7)

# ---------------------------------------------------------------- one value, in columns


def iscondensed(v: Column) -> Column:
    """Whether a VARIANT has the marks of a condensed value."""
    at = lambda key: F.variant_get(v, f"$['{key}']", "variant")
    whole = kinds.is_number(at("root")) & (kinds.number(at("root")) % 1 == 0)
    return F.coalesce(kinds.ismap(v) & (kinds.number(at("$condense")) == 1) & kinds.islist(at("sym")) & kinds.islist(at("node")) & whole, F.lit(False))


def _opened(v: Column) -> Column:
    """sym, node and root of a condensed value; node's entries stay closed."""
    return F.struct(F.variant_get(v, "$.sym", "array<string>").alias("sym"), F.variant_get(v, "$.node", "array<variant>").alias("node"), F.variant_get(v, "$.root", "int").alias("root"))


def _bisect(size: Column, at, want: Column) -> Column:
    """Index of want among sorted values at(i), or NULL: 31 halvings at most, each one read."""
    zero = F.struct(F.lit(0).alias("low"), size.cast("int").alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        moved = bind(middle, lambda m: F.when(at(m) < want, F.struct((m + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), m.alias("high"))))
        return F.when(s["low"] < s["high"], moved).otherwise(s).cast("struct<low:int,high:int>")

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)) + 1)).cast("int"))
    found = F.aggregate(rounds, zero.cast("struct<low:int,high:int>"), halve, lambda s: s["low"])
    return bind(found, lambda i: F.when((i < size) & (at(i) == want), i))


def _whole(x: Column) -> Column:
    return F.try_variant_get(x, "$", "int")


def _child(c: Column, node: Column, key: Column) -> Column:
    """Number of the node at a key of a node, or NULL."""

    def inside(n: Column) -> Column:
        symbol = _bisect(F.size(c["sym"]), lambda i: F.get(c["sym"], i), key)
        place = lambda s: _bisect((F.size(n) - 1) / 2, lambda j: _whole(F.get(n, 2 * j + 1)), s)
        named = bind(symbol, lambda s: F.when(s.isNotNull(), bind(place(s), lambda j: _whole(F.get(n, 2 * j + 2)))))
        listed = F.when(key.rlike(r"^(0|[1-9][0-9]*)$"), _whole(F.get(n, key.try_cast("int") + 1)))
        return F.when(_whole(F.get(n, F.lit(0))) == MAP, named).when(_whole(F.get(n, F.lit(0))) == LIST, listed)

    return F.when(node.isNotNull(), bind(F.try_variant_get(F.get(c["node"], node), "$", "array<variant>"), inside))


def _value(c: Column, at: Column, limit: int = MAXDEPTH) -> Column:
    """The document under a node."""

    def expand(key: Column, node: Column, parent: Column, path: Column) -> Column:
        def inside(n: Column) -> Column:
            code = _whole(F.get(n, F.lit(0)))
            pairs = F.transform(F.sequence(F.lit(1), F.size(n) - 2, F.lit(2)), lambda k: F.struct(F.get(c["sym"], _whole(F.get(n, k))).alias("key"), _whole(F.get(n, k + 1)).alias("load")))
            listed = F.transform(F.slice(n, F.lit(2), F.size(n)), lambda x, i: F.struct(i.cast("string").alias("key"), _whole(x).alias("load")))
            none = F.array().cast("array<struct<key:string,load:int>>")
            scalar = F.when(code == TEXT, nodes.as_variant(F.get(c["sym"], _whole(F.get(n, F.lit(1)))))).when(code == NUMBER, F.get(n, F.lit(1))).when(code == TRUE, F.parse_json(F.lit("true"))).when(code == FALSE, F.parse_json(F.lit("false"))).otherwise(F.parse_json(F.lit("null")))
            kids = F.when((code == MAP) & (F.size(n) > 2), pairs).when((code == LIST) & (F.size(n) > 1), listed).otherwise(none)
            return F.struct(F.when(code == MAP, "map").when(code == LIST, "list").otherwise("scalar").alias("kind"), F.when(code > LIST, scalar).alias("value"), kids.alias("kids"))

        return bind(F.try_variant_get(F.get(c["node"], node), "$", "array<variant>"), inside)

    return F.when(at.isNotNull(), by_levels(at, "int", expand, None, limit))


def expand(v: Column) -> Column:
    """The document of a condensed value (VARIANT); other values stay."""
    return F.when(iscondensed(v), bind(_opened(v), lambda c: _value(c, c["root"]))).otherwise(v)


def getpath_condensed(v: Column, path: paths.Path | None) -> Column:
    """getpath of a condensed value: symbols are found by bisection and nodes followed; only what is found is expanded."""
    steps = paths.resolve(path)
    if steps is None:
        return F.lit(None).cast("variant")
    found = lambda c: F.aggregate(F.array(*map(F.lit, steps)), c["root"], lambda at, s: _child(c, at, s)) if steps else c["root"]
    return bind(_opened(v), lambda c: bind(found(c), lambda at: kinds.present(_value(c, at))))


# ---------------------------------------------------------------- a whole table, as relations


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its rows' places (from 0) in the order of some columns.

    Rows are dealt by ranges, counted for each range and numbered inside it; the driver sees one count for each range.
    """
    ranged = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()), must=True)
    spans = sorted(ranged.groupBy("__part").agg(F.count("*").alias("n"), F.min("__seq").alias("first")).collect(), key=lambda r: r[0])
    before, starts = 0, []
    for part, n, first in spans:
        starts.append((part, before - first))
        before += n
    shift = F.create_map(*(F.lit(x) for pair in starts for x in pair)) if starts else None
    out = ranged.withColumn(name, F.col("__seq") + F.try_element_at(shift, F.col("__part")) if starts else F.lit(0).cast("long"))
    return out.drop("__part", "__seq")


def _scalar_text(v: Column) -> Column:
    return F.when(kinds.is_string(v), F.concat(F.lit(f"{TEXT}:"), kinds.string(v))).when(kinds.is_number(v), F.concat(F.lit(f"{NUMBER}:"), kinds.number_text(kinds.number(v)))).when(kinds.is_boolean(v), F.when(kinds.boolean(v), F.lit(f"{TRUE}:")).otherwise(F.lit(f"{FALSE}:"))).otherwise(F.lit(f"{NULL}:"))


def condense_table(df: DataFrame, by: list[str], doc: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, nodes, roots) of all documents of a VARIANT column.

    symbols: sym, text (keys and texts, numbered in code point order). nodes: node, code, height, sym (of texts), number (text), children (array of
    sym and node; sym is NULL in lists), numbered by height and hash, so children come before their parents. roots: by and node; absent
    documents have none.

    Subtrees are hashed (SHA-256 of their code, keys and children's hashes) from the deepest level up, one aggregation for each
    level; equal hashes are one node, whichever documents they are in.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    rows = walk(df.where(F.col(f"`{doc}`").isNotNull()).select(*(F.col(f"`{c}`").alias(k) for k, c in zip(keys, by, strict=True)), F.col(f"`{doc}`").alias("doc")), "doc", keys)
    rows = settled(rows.select(*keys, "path", "depth", "kind", F.when(F.col("kind") == "scalar", _scalar_text(F.col("value"))).alias("text")))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    kid = "struct<key:string,place:int,hash:string,height:int>"
    told: DataFrame | None = None
    level = rows.where(F.col("depth") == deepest).select(*keys, "path", "kind", "text", F.array().cast(f"array<{kid}>").alias("kids"))
    for d in range(deepest, -1, -1):
        code = F.when(F.col("kind") == "map", MAP).when(F.col("kind") == "list", LIST).otherwise(F.substring("text", 1, 1).cast("int"))
        kids = F.array_sort("kids", lambda a, b: F.when(F.when(F.col("kind") == "list", a["place"] < b["place"]).otherwise(a["key"] < b["key"]), -1).otherwise(1))
        content = F.when(F.col("kind") == "map", F.concat(F.lit(f"{MAP}:"), F.array_join(F.transform("kids", lambda c: F.concat(F.length(c["key"]).cast("string"), F.lit(":"), c["key"], F.lit("="), c["hash"])), ","))).when(F.col("kind") == "list", F.concat(F.lit(f"{LIST}:"), F.array_join(F.transform("kids", lambda c: c["hash"]), ","))).otherwise(F.col("text"))
        height = F.when(F.size("kids") > 0, F.array_max(F.transform("kids", lambda c: c["height"])) + 1).otherwise(0)
        made = level.withColumn("kids", kids).withColumn("hash", F.sha2(content, 256)).withColumn("height", height).withColumn("code", code)
        made = settled(made)
        here = made.select("hash", "code", "height", F.substring("text", F.lit(3), F.length("text")).alias("text"), F.transform("kids", lambda c: F.struct(c["key"].alias("key"), c["hash"].alias("hash"))).alias("kids"))
        told = here if told is None else told.unionByName(here)
        if d:
            up = made.select(*keys, F.slice("path", 1, d - 1).alias("path"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("text"), F.struct(F.element_at("path", -1).alias("key"), F.element_at("path", -1).try_cast("int").alias("place"), F.col("hash"), F.col("height")).cast(kid).alias("kid"))
            own = rows.where(F.col("depth") == d - 1).select(*keys, "path", "kind", "text", F.lit(None).cast(kid).alias("kid"))
            level = own.unionByName(up).groupBy(*keys, "path").agg(F.max("kind").alias("kind"), F.max("text").alias("text"), F.collect_list("kid").alias("kids"))
    once = settled(told.groupBy("hash").agg(F.max("code").alias("code"), F.max("height").alias("height"), F.max("text").alias("text"), F.max("kids").alias("kids")))
    texts = once.where(F.col("code") == TEXT).select("text").unionByName(once.where(F.col("code") == MAP).select(F.explode("kids.key").alias("text"))).distinct()
    symbols = numbered(texts, ["text"], "sym").select("sym", "text")
    ids = numbered(once.select("hash", "height"), ["height", "hash"], "node")
    kids = once.select("hash", "code", F.posexplode("kids").alias("i", "k")).select(F.col("hash").alias("parent"), "code", "i", F.when(F.col("code") == MAP, F.col("k.key")).alias("text"), "k.hash")
    kids = kids.join(ids.select("hash", "node"), "hash").join(symbols, "text", "left").groupBy(F.col("parent").alias("hash")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sym", "node"))), lambda c: F.struct(c["sym"].alias("sym"), c["node"].alias("node"))).alias("children"))
    own = once.select("hash", "code", F.when(F.col("code") == TEXT, F.col("text")).alias("text"), F.when(F.col("code") == NUMBER, F.col("text")).alias("number")).join(symbols, "text", "left").drop("text")
    nodes_ = ids.join(own, "hash").join(kids, "hash", "left").select("node", "code", "height", "sym", "number", F.coalesce("children", F.array().cast("array<struct<sym:bigint,node:bigint>>")).alias("children"))
    roots = made.join(ids.select("hash", "node"), "hash").select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), "node")
    return symbols, nodes_, roots


def expand_table(symbols: DataFrame, nodes_: DataFrame, roots: DataFrame, doc: str = "doc") -> DataFrame:
    """The documents again: each node is built once, height by height, and joined to the roots that have it."""
    nodes_ = settled(nodes_)
    highest = nodes_.agg(F.max("height")).first()[0] or 0
    texts = symbols.select(F.col("sym"), F.col("text"))
    number = F.when(F.col("number").rlike(r"^-?[0-9]+$"), F.parse_json("number")).otherwise(nodes.as_variant(F.col("number").cast("double")))
    scalar = F.when(F.col("code") == TEXT, nodes.as_variant(F.col("text"))).when(F.col("code") == NUMBER, number).when(F.col("code") == TRUE, F.parse_json(F.lit("true"))).when(F.col("code") == FALSE, F.parse_json(F.lit("false"))).when(F.col("code") == MAP, F.parse_json(F.lit("{}"))).when(F.col("code") == LIST, F.parse_json(F.lit("[]"))).otherwise(F.parse_json(F.lit("null")))
    values = settled(nodes_.where("height = 0").join(texts, "sym", "left").select("node", scalar.alias("value")))
    for h in range(1, highest + 1):
        kids = nodes_.where(F.col("height") == h).select(F.col("node").alias("parent"), "code", F.posexplode("children").alias("i", "c")).select("parent", "code", "i", "c.sym", "c.node")
        kids = kids.join(values, "node").join(texts, "sym", "left")
        pair = F.struct("i", F.coalesce("text", F.col("i").cast("string")).alias("key"), F.col("value"))
        ordered = F.array_sort(F.collect_list(pair), lambda a, b: a["i"] - b["i"])
        shape = F.when(F.max("code") == MAP, "map").otherwise("list")
        made = kids.groupBy("parent").agg(build(shape, F.transform(ordered, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"))), F.lit(None).cast("variant")).alias("value"))
        values = settled(values.unionByName(made.select(F.col("parent").alias("node"), "value")))
    return roots.join(values.withColumnRenamed("value", doc), "node").drop("node")


