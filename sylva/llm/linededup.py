"""Line dedup by winnowing over line hashes.

A document is its sequence of lines that have a word; lines are equal if their words are (A-Z
lower-cased). A gram is the shortest run of lines from a line on with GRAM_WORDS words, a window the shortest
from some line on, or up to some line, with MIN_WORDS. Each window selects its smallest gram (the last of equal
ones); the selected grams with their places, each place once however many windows select it, are the document's
fingerprints. A run of MIN_WORDS words or more that occurs twice holds a window that does, which selects
the same gram at the same place in it: so every repeat is found by a fingerprint that occurs more than once, and only
those go on. Their places are joined and extended both ways: each such place is extended to all windows that
selected it, by lines on its left and right; extensions that agree in all lines with one at an earlier place (by doc_id,
hash of the text, line) are repeats, and overlapping ones are one long match. Its lines go. As the windows from and up to its
lines cover any run of MIN_WORDS words, a line goes exactly if it is in a run of whole lines of MIN_WORDS words that
occurs before, whichever documents have its parts first.

Edge cases: null, empty and wordless texts stay as they are; rows that repeat doc_id and text are one
document and stay alike; null ids come first; lines without words inside a deleted run stay;
a run that repeats inside one document keeps its first window; an empty table gives no rows; extra
columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import discard, leave, materialize, mix, pick, text_chunks, tidy

MIN_WORDS, GRAM_WORDS = 50, 25

_SEQ = "id long, th long, line array<int>, place array<int>, gram array<long>, pos array<int>, end array<int>, by array<int>, win array<long>"


def _runs(values: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of the sequences values[s:e]."""
    p, inv = common._powers(len(values) + 1)
    with np.errstate(over="ignore"):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * p[: len(values)])])
        return mix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64))


def line_units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with words: line number in its document, hash, words; and each document's first one."""
    low = common._LOWER[data]
    s, e, at = common.spans(~common._WS[low], offs)
    w = common.span_hashes(low, s, e)
    nl = np.concatenate([[0], np.cumsum(low == 10)])
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    line = nl[s] - nl[offs[:-1]][doc]
    new = np.ones(len(s), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    us = np.flatnonzero(new)
    ue = np.append(us[1:], len(s))
    return line[us], _runs(w, us, ue), ue - us, np.searchsorted(us, at)


def winnow(h: np.ndarray, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grams from all lines, and the windows of all documents: first line, end, and the line whose gram each selects."""
    n = len(h)
    begin, end = np.repeat(at[:-1], np.diff(at)), np.repeat(at[1:], np.diff(at))
    cum = np.concatenate([[0], np.cumsum(w)])
    i = np.arange(n)
    g = np.searchsorted(cum, cum[:-1] + GRAM_WORDS)  # the run [i, g)
    e = np.searchsorted(cum, cum[:-1] + MIN_WORDS)
    gram = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    ok = g <= end
    gram[ok] = _runs(h, i[ok], g[ok])
    start, stop = i[e <= end], e[e <= end]
    # up to line i, where no window from a line on is the same
    s = np.searchsorted(cum, cum[1:] - MIN_WORDS, "right") - 1
    back = (cum[1:] - MIN_WORDS >= 0) & (s >= begin)
    back[back] = e[s[back]] != i[back] + 1
    start, stop = np.concatenate([start, s[back]]), np.concatenate([stop, i[back] + 1])
    order = np.lexsort((stop, start))
    start, stop = start[order], stop[order]
    last = np.searchsorted(g, stop, "right") - 1
    best = start.copy()
    for d in range(1, int((last - start).max(initial=0)) + 1):
        m = start + d <= last
        m[m] = gram[start[m] + d] <= gram[best[m]]
        best[m] = start[m] + d
    return gram, start, stop, best


def sequences(docs: DataFrame) -> DataFrame:
    """One row for each row with a window (key columns id, th): the numbers of its lines, its fingerprints (place, gram), and
    its windows as extensions of these: pos, end, by (the place that the window selects) and win (hash of its lines)."""

    def run(batches):
        for batch in batches:
            for a, b, data, offs in text_chunks(batch.column("text")):
                line, h, w, at = line_units(data, offs)
                gram, pos, end, by = winnow(h, w, at)
                place = np.unique(by)  # where the selected minimum changes
                first, marks = np.searchsorted(pos, at), np.searchsorted(place, at)
                base, from_ = at[np.searchsorted(at, pos, "right") - 1], at[np.searchsorted(at, place, "right") - 1]
                part = batch.slice(a, b - a)

                def lists(at, values, kind):
                    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64) if kind == pa.int64() else values, kind))

                out = [part.column("id"), part.column("th"), lists(at, line, pa.int32()), lists(marks, place - from_, pa.int32()), lists(marks, gram[place], pa.int64()), lists(first, pos - base, pa.int32()), lists(first, end - base, pa.int32()), lists(first, by - base, pa.int32()), lists(first, _runs(h, pos, end), pa.int64())]
                out = pa.RecordBatch.from_arrays(out, names=["id", "th", "line", "place", "gram", "pos", "end", "by", "win"])
                yield out.filter(pa.array(np.diff(first) > 0))

    return docs.select("id", "th", "text").mapInArrow(tidy(run), _SEQ)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """id, th, gone: the line numbers that dedup deletes, for documents that lose any."""
    seq = materialize(sequences(docs))
    marks = seq.select("id", "th", F.explode(F.arrays_zip("place", "gram")).alias("f")).select("id", "th", "f.*")
    # tables that are written make a join one of two plain shuffles, whose skewed partitions Spark splits
    several = materialize(marks.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    places = marks.join(several, "gram", "left_semi").groupBy("id", "th").agg(F.collect_set("place").alias("places"))
    # extend the places that occur elsewhere too
    near = seq.join(places, ["id", "th"]).select("id", "th", "places", F.explode(F.arrays_zip("pos", "end", "by", "win")).alias("f"))
    near = materialize(near.where("array_contains(places, f.by)").select("id", "th", "f.pos", "f.end", (F.col("f.by") - F.col("f.pos")).alias("left"), "f.win"))
    first = near.groupBy("left", "win").agg(F.min(F.struct("id", "th", "pos", "end")).alias("b"), F.count("*").alias("n")).where("n > 1").select("left", "win", "b")
    first = materialize(first)
    hits = near.join(first, ["left", "win"]).where("struct(id, th, pos, end) > b")
    # in its own document the first window stays
    same = (F.col("id") == F.col("b.id")) & (F.col("th") == F.col("b.th"))
    hits = hits.select("id", "th", F.when(same, F.greatest("pos", "b.end")).otherwise(F.col("pos")).alias("s"), F.col("end").alias("e")).where("s < e")
    hits = hits.groupBy("id", "th").agg(F.collect_set(F.struct("s", "e")).alias("hits"))
    # the union of what matched, as line numbers
    units = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["s"], x["e"] - 1))))
    lines = seq.select("id", "th", "line").dropDuplicates(["id", "th"])
    gone = materialize(hits.join(lines, ["id", "th"]).select("id", "th", F.transform(F.array_sort(units), lambda k: F.get("line", k)).alias("gone")))
    discard(several, near, first, seq)
    return gone


def dedupe_lines(docs: DataFrame) -> DataFrame:
    """row (all columns of docs, text and n_chars without the deleted lines) and gone (their numbers, or null)."""
    least = -(1 << 63)
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("id"), F.xxhash64("text").alias("th"))
    gone = repeated_lines(keyed.select("id", "th", F.col("row.text").alias("text")))
    # documents that lose nothing stay where they are while the others are few
    hurt = materialize(gone.select("id", "th"))
    both = leave(keyed, hurt).withColumn("gone", F.lit(None).cast("array<int>")).unionByName(pick(keyed, hurt).join(gone, ["id", "th"]))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n"))
    both = both.withColumn("text", text)
    made = {"text": F.col("text"), "n_chars": F.when(F.col("gone").isNull(), F.col("row").getField("n_chars")).otherwise(F.length("text")) if "n_chars" in docs.columns else None}
    fields = [(made[c] if made.get(c) is not None else F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]
    return both.select(F.struct(*fields).alias("row"), "gone")


def dedupe(docs: DataFrame) -> DataFrame:
    """docs without the later repeated runs; rows that lose all their words go."""
    out = dedupe_lines(docs)
    return out.where(F.col("gone").isNull() | F.col("row.text").rlike(r"[^ \t-\r]")).select("row.*")
