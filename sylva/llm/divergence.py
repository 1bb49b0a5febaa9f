"""Source divergence audit: how the terms of each (lang, source) group differ from its language's and from the other sources'.

1. Terms are counted text by text in Arrow batches; a task sums up before the shuffle, at most ENTRIES sums at a time.
2. A language keeps the terms that at least min_docs of its documents have.
3. For each pair of sources of a language a joint count histogram says how many kept terms have the counts (c, d) in the two:
   cells that are not (0, 0) are tallied in blocks of terms by blocks of sources (so no term's sources are paired as rows),
   blocks are summed, and the number of (0, 0) is what is left of the language's kept terms. f is evaluated once for each combination
   and multiplied by how often it occurs.
4. A term's own row needs no pairs: it is compared with its language.

All arithmetic is on whole numbers: smoothed shares are floor(SCALE * (count + ALPHA) / (N + ALPHA * V)) + 1 by exact division of decimals.

Edge cases: null text, lang and source are ''; groups without a term, or without a kept one, have N = 0 and all counts 0; a language
without a kept term has V = 0, pairs of value 0 and no term rows; a single source has no pairs; repeated rows count as often as
they occur; an empty table gives no rows; terms of any length and texts of any length are cut in slices; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, tidy

MIN_DOCS, ALPHA, SCALE, TOP = 30, 5, 10**9, 50
#: Sums that a counting task holds, cells of a block of the joint histogram, and sources of a block.
ENTRIES, CELLS, SOURCES = 250_000, 64_000, 32
#: Bytes of a text that are cut into terms together.
SLICE = 4 << 20

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_OTHER = re.compile(rb"[^A-Za-z\x80-\xff]")


def terms(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a text (UTF-8), A-Z lower-cased, slice by slice; no term is cut."""
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            m = _OTHER.search(data, end)
            end = m.start() if m else len(data)
        yield _TERM.findall(data[at:end].lower())  # bytes: only A-Z change
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: sums over the rows of this task. Every group also has a row without a term."""
    n: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), seen in n.items():
            own = docs[lang, source]
            names = [None, *seen]
            arrays = [pa.array([lang] * len(names)), pa.array([source] * len(names)), pa.array(names, pa.binary()).cast(pa.string()), pa.array([0, *seen.values()], pa.int64()), pa.array([0, *(own[t] for t in seen)], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])
        n.clear()
        docs.clear()

    for batch in batches:
        langs, sources, texts = (batch.column(k) for k in range(3))
        for lang, source, i in zip(langs.to_pylist(), sources.to_pylist(), range(len(texts)), strict=True):
            own = Counter()
            for found in terms(texts[i].as_buffer().to_pybytes()):
                own.update(found)
            sums = n[lang, source]
            before = len(sums)
            sums.update(own)
            docs[lang, source].update(own.keys())
            held += len(sums) - before
            if held > ENTRIES:
                yield from out()
                held = 0
    yield from out()


def _tally(sources: int) -> Callable:
    """Joint histograms of the pairs of one block of sources (or of two) over one block of terms."""

    def run(table: pa.Table) -> pa.Table:
        lang, a, b = (table.column(c)[0].as_py() for c in ("lang", "a", "b"))
        term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        place, n = table.column("place").to_numpy(), table.column("n").to_numpy()
        # sources of block a first, then those of b
        slot = place % sources + np.where((place // sources == b) & (a != b), sources, 0)
        counts = np.zeros((2 * sources if a != b else sources, int(term.max()) + 1), np.int64)
        counts[slot, term] = n
        coded = [np.unique(row, return_inverse=True) for row in counts]
        some = [k for k in range(len(counts)) if counts[k].any()]
        first = range(sources)
        second = range(sources, 2 * sources) if a != b else first
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for i in first:
            for j in second:
                if i >= j and a == b or i not in some and j not in some:
                    continue
                (vi, ci), (vj, cj) = coded[i], coded[j]
                key, m = np.unique(ci * len(vj) + cj, return_counts=True)
                x, y = vi[key // len(vj)], vj[key % len(vj)]
                keep = (x > 0) | (y > 0)
                size = int(keep.sum())
                cols[0].append(np.full(size, a * sources + i))
                cols[1].append(np.full(size, b * sources + (j - sources if a != b else j)))
                for c, v in zip(cols[2:], (x[keep], y[keep], m[keep]), strict=True):
                    c.append(v)
        made = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in cols]
        return pa.table([pa.array([lang] * len(made[0]), pa.string()), *map(pa.array, made)], names=["lang", "i", "j", "x", "y", "m"])

    return run


def _share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + ALPHA) / (total + ALPHA * v)), exactly; V is not 0."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (count + ALPHA).cast("decimal(20,0)")
    return F.call_function("div", up, (total + ALPHA * v).cast("decimal(20,0)")) + 1


def _cells(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term, n, all (the language's count), lead (once for each term) of kept terms; a row without a term for each group."""
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = rows.mapInArrow(tidy(_count), "lang string, source string, term string, n long, docs long")
    sums = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    sums = sums.select("lang", "source", "term", "n", F.sum("docs").over(w).alias("docs"), F.sum("n").over(w).alias("all"), (F.row_number().over(w.orderBy("source")) == 1).alias("lead"))
    return sums.where(F.col("term").isNull() | (F.col("docs") >= min_docs)).drop("docs")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank of every group."""
    cells = materialize(_cells(docs, min_docs))
    groups = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("cells"), F.sum((F.col("lead") & F.col("term").isNotNull()).cast("long")).alias("v"))
    of_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "total", F.sum("v").over(of_lang).alias("v"), F.sum("total").over(of_lang).alias("lang_total"), F.sum("cells").over(of_lang).alias("lang_cells"), F.count("*").over(of_lang).alias("sources"), (F.row_number().over(of_lang.orderBy("source")) - 1).alias("place"))
    groups = materialize(groups)
    own = cells.where("term is not null").join(groups, ["lang", "source"])
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    p, q = _share(F.col("n"), F.col("total"), F.col("v")), _share(F.col("all"), F.col("lang_total"), F.col("v"))
    term = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    term = term.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    pair = _pairs(own, groups).withColumn("rank", F.row_number().over(ranked))
    return term.unionByName(pair)


def _pairs(own: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, part, item, value of all ordered pairs of a language's sources."""
    last = F.floor((F.col("sources") - 1) / SOURCES).cast("long")
    block = F.floor(F.col("place") / SOURCES).cast("long")
    # a block holds about CELLS cells: a language's, by the share of its sources that meet there
    blocks = F.greatest(F.lit(1), F.ceil(F.col("lang_cells") * F.least(F.lit(1.0), 2 * SOURCES / F.col("sources")) / CELLS))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda o: F.struct(F.least(o, F.col("block")).alias("a"), F.greatest(o, F.col("block")).alias("b")))
    cells = own.select("lang", "term", "n", F.col("place").cast("long").alias("place"), block.alias("block"), last.alias("last"), F.pmod(F.xxhash64("term"), blocks).alias("terms"))
    cells = cells.select("lang", "term", "n", "place", "terms", F.explode(meets).alias("m")).select("lang", "m.a", "m.b", "terms", "term", "n", "place")
    found = cells.groupBy("lang", "a", "b", "terms").applyInArrow(_tally(SOURCES), "lang string, i long, j long, x long, y long, m long")
    joint = found.groupBy("lang", "i", "j", "x", "y").agg(F.sum("m").alias("m"))

    side = lambda name: groups.select("lang", F.col("place").cast("long").alias(name), F.col("total").alias(f"{name}_total"))
    v = groups.where("place = 0").select("lang", "v")
    f = lambda x, y: F.abs(_share(x, F.col("i_total"), F.col("v")) - _share(y, F.col("j_total"), F.col("v")))
    joint = joint.join(side("i"), ["lang", "i"]).join(side("j"), ["lang", "j"]).join(v, "lang")
    told = joint.groupBy("lang", "i", "j").agg(F.sum(F.col("m") * f(F.col("x"), F.col("y"))).alias("told"), F.sum("m").alias("seen"))
    both = told.select("*", F.explode(F.array(F.struct(F.col("i").alias("own"), F.col("j").alias("other")), F.struct(F.col("j").alias("own"), F.col("i").alias("other")))).alias("s"))
    both = both.select("lang", F.col("s.own").alias("i"), F.col("s.other").alias("j"), "told", "seen")

    # every ordered pair, block by block of sources; all of them are rows of the result
    sides = groups.select("lang", "source", F.col("place").cast("long").alias("place"), "total", "v", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("o"))
    left = sides.select("lang", F.col("block").alias("a"), F.col("o").alias("b"), "source", F.col("place").alias("i"), F.col("total").alias("i_total"), "v")
    right = sides.select("lang", F.col("o").alias("a"), F.col("block").alias("b"), F.col("source").alias("item"), F.col("place").alias("j"), F.col("total").alias("j_total"))
    pairs = left.join(right, ["lang", "a", "b"]).where("i <> j").join(both, ["lang", "i", "j"], "left")
    zero = F.lit(0).cast("long")
    value = F.when(F.col("v") > 0, F.coalesce("told", zero) + (F.col("v") - F.coalesce("seen", zero)) * f(zero, zero)).otherwise(zero)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
