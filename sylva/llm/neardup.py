"""MinHash near-dedup with bottom-k sketches.

One hash function; a sketch is the K smallest shingle hashes of a document. Documents with equal sets are
one class. Inverted lists of the retained values generate candidates:

* a pair with similarity t shares SHARED values of its sketches but for about 1 in 10^9 (K draws
  that hit with probability t); so a sketch with fewer values that other sketches have too is out, and
  only each sketch's K - SHARED + 1 rarest values need lists (any two of its partner's are among them);
* first each list links its members to its most typical one (whose values are the commonest), which
  joins whole groups of near copies with as many pairs as members;
* then lists that still hold several components pair the rest: short lists directly, long ones
  in blocks, all lists with one head together, after members that have over 1 - t of their
  shingles to themselves (they link with nothing there) are out. No pairs are made in blocks.

The estimate from the union's sketch drops candidates far below t; exact Jaccard on full sets decides.

Edge cases: null and wordless texts have an empty set and link with nothing; with under n words the whole
sequence is one shingle; rows that repeat a doc_id are one node; null ids are never linked (kept, component
null); an empty table gives no rows; extra columns pass through or are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, leave, materialize, pick, shingles, text_chunks, tidy, words
from .components import components

K, SHARED = 32, 10
#: Candidates whose estimate is below the threshold by so much are dropped (over five standard deviations).
MARGIN = 0.35
SHORT_LIST, BLOCK = 48, 512
#: Shingles that one task holds when a long list's members are searched for shingles of their own.
OWN_BUCKET = 1 << 20


def _chunk_sets(batch: pa.RecordBatch, n: int):
    """(row, its sorted distinct shingle hashes) of every row."""
    for a, _, data, offs in text_chunks(batch.column("text")):
        h, at = shingles(*words(data, offs), n)
        for k in range(len(at) - 1):
            s = np.sort(h[at[k] : at[k + 1]])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            yield a + k, s


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (digests of the set), sketch (as signed longs, in order of the unsigned)."""

    def run(batches):
        for batch in batches:
            size, d1, d2, values, at = [], [], [], [], [0]
            with np.errstate(over="ignore"):
                for _, s in _chunk_sets(batch, n):
                    size.append(len(s))
                    d1.append(int(s.sum(dtype=np.uint64)))
                    d2.append(int((s * (s >> np.uint64(17) | np.uint64(1))).sum(dtype=np.uint64)))
                    values.append(s[:K])
                    at.append(at[-1] + len(values[-1]))
            flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
            digests = [pa.array(np.array(d, np.uint64).view(np.int64)) for d in (d1, d2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), *digests, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], names=["doc_id", "n_shingles", "d1", "d2", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, items (the whole set)."""

    def run(batches):
        for batch in batches:
            values, at = [], [0]
            for _, s in _chunk_sets(batch, n):
                values.append(s)
                at.append(at[-1] + len(s))
            flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], names=["doc_id", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, items array<long>")


def _estimate(a: str, b: str):
    """Column: share of the union's K smallest values that both sketches (sorted unsigned) have."""
    flip = lambda c: F.transform(c, lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))  # noqa: E731  unsigned order as signed
    union = F.slice(F.array_sort(flip(F.array_union(a, b))), 1, K)
    both = F.size(F.array_intersect(union, flip(F.array_intersect(a, b))))
    return both / F.size(union)


def _ends(pairs: DataFrame) -> DataFrame:
    """doc_id of all documents in pairs (u, v)."""
    return materialize(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct())


def _verified(pairs: DataFrame, docs: DataFrame, sketch: DataFrame, n: int, threshold: int) -> DataFrame:
    """Links (u, v) among the distinct pairs (materialised ids): estimate, then exact Jaccard on full sets.

    Sketches and texts of documents in no pair stay where they are.
    """
    wanted = _ends(pairs)
    some = materialize(pick(sketch, wanted))
    a = some.select(F.col("doc_id").alias("u"), F.col("sketch").alias("su"), F.col("n_shingles").alias("nu"))
    b = some.select(F.col("doc_id").alias("v"), F.col("sketch").alias("sv"), F.col("n_shingles").alias("nv"))
    likely = pairs.join(a, "u").join(b, "v").where(f"100 * least(nu, nv) >= {threshold} * greatest(nu, nv)")
    likely = materialize(likely.where(_estimate("su", "sv") >= threshold / 100 - MARGIN).select("u", "v").distinct())
    discard(wanted, some)
    wanted = _ends(likely)
    sets = materialize(full_sets(pick(docs, wanted), n).dropDuplicates(["doc_id", "items"]))
    both = likely.join(sets.select(F.col("doc_id").alias("u"), F.col("items").alias("iu")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("items").alias("iv")), "v")
    shared = F.size(F.array_intersect("iu", "iv"))
    links = materialize(both.select("u", "v", shared.alias("i"), (F.size("iu") + F.size("iv") - shared).alias("o")).where(f"100 * i >= {threshold} * o").select("u", "v").distinct())
    discard(wanted, likely, sets)
    return links


def _own_counts(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """doc_id, own: how many of a member's shingles no other member has. Sets travel as binary slices by hash range."""
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    cuts = max(8, -(-total // OWN_BUCKET))
    edges = np.array([(k << 64) // cuts for k in range(1, cuts)], np.uint64)

    def cut(batches):
        for batch in batches:
            out = []
            ids = batch.column("doc_id").to_pylist()
            for r, s in _chunk_sets(batch, n):
                out += [{"part": k, "doc_id": ids[r], "raw": x.tobytes()} for k, x in enumerate(np.split(s, np.searchsorted(s, edges))) if len(x)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("raw", pa.binary())]))

    def count(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        raw = [np.frombuffer(x, np.uint64) for x in table.column("raw").to_pylist()]
        owner = np.repeat(ids, [len(x) for x in raw])
        values = np.concatenate(raw)
        order = np.lexsort((owner, values))
        v, o = values[order], owner[order]
        first = np.ones(len(v), bool)
        first[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        v, o = v[first], o[first]
        lone = np.ones(len(v), bool)
        lone[1:] &= v[1:] != v[:-1]
        lone[:-1] &= v[1:] != v[:-1]
        who, own = np.unique(o[lone], return_counts=True)
        return pa.table({"doc_id": pa.array(who, pa.int64()), "own": pa.array(own, pa.int64())})

    cuts_of = pick(docs, members.select("doc_id")).mapInArrow(tidy(cut), "part int, doc_id long, raw binary")
    return cuts_of.groupBy("part").applyInArrow(count, "doc_id long, own long").groupBy("doc_id").agg(F.sum("own").alias("own"))


def _block_links(groups: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v) of large groups (head, doc_id, n_shingles, component, size of the group), in blocks of about BLOCK members.

    A task has two blocks and counts all their intersections exactly, as products of 0/1 matrices; it returns
    links that join components, no more than members.
    """
    sized = groups.withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int"))
    sized = sized.withColumn("blk", F.pmod(F.xxhash64("doc_id"), "nb").cast("int"))
    # each member goes to every pair of blocks that has its own
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least("blk", o).alias("x"), F.greatest("blk", o).alias("y"))))
    sized = sized.select("head", "blk", "doc_id", "n_shingles", "component", pair.alias("p")).select("*", "p.x", "p.y").drop("p").join(sets, "doc_id")

    def run(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        blk, ids, comp, size = (table.column(c).to_numpy() for c in ("blk", "doc_id", "component", "n_shingles"))
        items = table.column("items").combine_chunks()
        at, flat = items.offsets.to_numpy(), items.flatten().to_numpy()
        at = at - at[0]
        sides = [np.flatnonzero(blk == k) for k in (x, y)]
        parts = [[flat[at[r] : at[r + 1]] for r in side] for side in sides]
        both = np.intersect1d(*(np.concatenate([np.zeros(0, np.int64), *p]) for p in parts))
        left, right = sides
        shared = np.zeros((len(left), len(right)), np.float32)
        cells = []
        for p in parts:
            row = np.repeat(np.arange(len(p)), [len(v) for v in p])
            v = np.concatenate([np.zeros(0, np.int64), *p])
            col = np.minimum(np.searchsorted(both, v), max(0, len(both) - 1))
            hit = both[col] == v if len(both) else np.zeros(len(v), bool)
            order = np.argsort(col[hit], kind="stable")
            cells.append((row[hit][order], col[hit][order]))
        for c in range(0, len(both), 4096):
            m = []
            for (row, col), side in zip(cells, sides, strict=True):
                i, j = np.searchsorted(col, [c, c + 4096])
                d = np.zeros((len(side), 4096), np.float32)
                d[row[i:j], col[i:j] - c] = 1
                m.append(d)
            shared += m[0] @ m[1].T
        linked = 100 * shared >= threshold * (size[left][:, None] + size[right][None, :] - shared)
        linked &= comp[left][:, None] != comp[right][None, :]
        parent: dict[int, int] = {}

        def root(c):
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        us, vs = [], []
        for i, j in zip(*(k.tolist() for k in np.nonzero(linked)), strict=True):
            a, b = root(comp[left[i]]), root(comp[right[j]])
            if a != b:
                parent[max(a, b)] = min(a, b)
                us.append(ids[left[i]])
                vs.append(ids[right[j]])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return sized.groupBy("head", "x", "y").applyInArrow(run, "u long, v long")


def cluster(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) of every row of docs."""
    rows = materialize(sketches(docs, n))
    some = rows.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(some.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    # a node is a doc_id; rows of its set point to the class's smallest
    same = some.join(classes.where("n > 1"), ["n_shingles", "d1", "d2"]).where("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    reps = materialize(some.join(classes.select(F.col("rep").alias("doc_id"), "n_shingles", "d1", "d2"), ["doc_id", "n_shingles", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "d1", "d2"]).select("doc_id", "n_shingles", "sketch"))

    posts = reps.select("doc_id", F.explode("sketch").alias("value"))
    # written, so that the join is one of two plain shuffles, whose skewed partitions Spark splits
    shared = materialize(posts.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"))
    mine = posts.join(shared, "value").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vals"), F.sum("df").alias("common"))
    # a sketch of s values: a partner shares at least SHARED of K, or ceil(t * s) if the sketch is the whole set
    whole = F.ceil(F.col("n_shingles") * (threshold / 100) - 1e-9)
    need = F.when(F.col("n_shingles") <= K, F.least(whole, F.lit(SHARED))).otherwise(F.lit(SHARED)).cast("int")
    mine = mine.join(reps, "doc_id").withColumn("need", need).where("size(vals) >= need")
    lone = F.size("sketch") - F.size("vals")
    mine = mine.withColumn("keep", F.size("sketch") - F.col("need") + 1 - lone).where("keep > 0")
    mine = materialize(mine.select("doc_id", "n_shingles", "sketch", "common", F.slice("vals", F.lit(1), F.col("keep")).alias("vals")))
    discard(shared, reps)

    lists = mine.select("doc_id", "common", F.explode("vals.value").alias("value"))
    heads = lists.groupBy("value").agg(F.max_by("doc_id", F.struct(F.col("common"), -F.col("doc_id"))).alias("u"), F.count("*").alias("df")).where("df > 1")
    heads = materialize(heads)
    pairs = materialize(lists.join(heads, "value").where("doc_id != u").select("u", F.col("doc_id").alias("v")).distinct())
    sketch = mine.select("doc_id", "sketch", "n_shingles")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    edges = materialize(_verified(pairs, docs, sketch, n, threshold).unionByName(same))
    comp = materialize(components(edges))

    # the rest: lists with members of several components
    member = mine.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    member = member.select("doc_id", "n_shingles", "component", F.explode("vals.value").alias("value"))
    mixed = materialize(member.groupBy("value").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("value", "df"))
    ids = materialize(member.join(mixed, "value"))
    discard(mixed)
    short = ids.where(f"df <= {SHORT_LIST}")
    other = short.select("value", F.col("doc_id").alias("v"), F.col("component").alias("cv"), F.col("n_shingles").alias("nv"))
    rest = short.select("value", F.col("doc_id").alias("u"), F.col("component").alias("cu"), F.col("n_shingles").alias("nu")).join(other, "value")
    rest = rest.where(f"u < v and cu != cv and 100 * least(nu, nv) >= {threshold} * greatest(nu, nv)").select("u", "v").distinct()
    rest = materialize(rest.join(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti"))
    discard(pairs)
    more = _verified(rest, docs, sketch, n, threshold)
    discard(rest)
    long = ids.where(f"df > {SHORT_LIST}")
    if long.limit(1).count():
        members = materialize(sketch.select("doc_id", "n_shingles").join(long.select("doc_id"), "doc_id", "left_semi"))
        members = members.join(_own_counts(docs, members, n), "doc_id", "left").where(f"100 * (n_shingles - coalesce(own, 0)) >= {threshold} * n_shingles")
        members = materialize(members.select("doc_id"))
        groups = materialize(long.join(members, "doc_id").join(heads.select("value", F.col("u").alias("head")), "value").select("head", "doc_id", "n_shingles", "component").distinct())
        size = groups.groupBy("head").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("head", "size")
        sets = full_sets(pick(docs, members), n).dropDuplicates(["doc_id", "items"])
        more = more.unionByName(_block_links(groups.join(size, "head"), sets, threshold))
    more = materialize(more)
    if more.limit(1).count():
        comp = materialize(components(more.unionByName(comp.select(F.col("node").alias("u"), F.col("component").alias("v")))))
    out = rows.select("doc_id", "n_shingles").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def dedupe(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """One row of each component: the one with the smallest doc_id (null ids come last).

    The nodes are keys of 64 bits made of doc_id and text: different texts of one doc_id, and texts without one, are
    nodes of their own; of rows that repeat both, one stays.
    """
    null = F.col("row.doc_id").isNull()
    keyed = docs.select(F.struct("*").alias("row")).withColumn("id", F.col("row.doc_id").cast("long"))
    keyed = keyed.withColumn("key", F.xxhash64(null, F.coalesce("id", F.lit(0)), F.col("row.text").isNull(), "row.text"))
    found = materialize(cluster(keyed.select(F.col("key").alias("doc_id"), "row.text"), n, threshold).select(F.col("doc_id").alias("key"), "component_id"))
    several = found.groupBy("component_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo != hi").select("component_id")
    members = found.distinct().join(several, "component_id").join(keyed.select("key", "id").distinct(), "key")
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "key"))["key"].alias("best"))
    gone = materialize(members.join(best, "component_id").where("key != best").select("key"))
    kept = leave(keyed, gone)
    repeated = materialize(found.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"))
    once = pick(kept, repeated).dropDuplicates(["key"])
    return leave(kept, repeated).unionByName(once).select("row.*")
