"""Benchmark decontamination by size-partitioned MinHash containment search.

Sets are 5-word shingles of runs of letters and digits (case and ASCII punctuation do not count).
Items are partitioned by set size into powers of two; an item of a partition with sizes up to u is
sketched by its floor((1 - t) * u) + 1 smallest shingle hashes (all, if it has fewer). A text with a
share t of the item's shingles has one of these at least, so the search misses nothing; every hit is
verified by exact containment. The benchmark is searched in blocks of bounded size.

Edge cases: null and wordless texts have no shingles; with under five words the whole sequence is one shingle, so such
an item is found in texts that are no more than it; repeated items or rows are each reported; empty tables give no rows; extra columns
are ignored or pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, plain_words, shingles, text_chunks, tidy, total_bytes

N, THRESHOLD = 5, 0.8
#: Bytes of item texts that are collected and sent to the workers at a time.
BLOCK_BYTES = 4 << 20
_MASK = np.uint64((1 << 22) - 1)


class Index:
    """Sketches and sets of one block of items."""

    def __init__(self, items: list[tuple[int, str]], threshold: float):
        self.threshold = threshold
        self.ids = [i for i, _ in items]
        raw = [t.encode() for _, t in items]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        h, at = shingles(*plain_words(np.frombuffer(b"".join(raw), np.uint8), offs), N)
        self.sets = [np.unique(h[at[k] : at[k + 1]]) for k in range(len(items))]
        values, owner = [], []
        for k, s in enumerate(self.sets):
            upper = 1 << max(0, len(s) - 1).bit_length()
            sketch = s[: int((1 - threshold) * upper + 1e-9) + 1]
            values.append(sketch)
            owner.append(np.full(len(sketch), k))
        self.values = np.concatenate([np.zeros(0, np.uint64), *values])
        order = np.argsort(self.values, kind="stable")
        self.values, self.owner = self.values[order], np.concatenate([np.zeros(0, np.int64), *owner])[order].astype(np.int64)
        self.seen = np.zeros(int(_MASK) + 1, bool)
        self.seen[self.values & _MASK] = True

    def search(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, shared, size) with shared >= threshold * size."""
        h, at = shingles(*plain_words(data, offs), N)
        hit = np.flatnonzero(self.seen[h & _MASK])
        left, right = np.searchsorted(self.values, h[hit], "left"), np.searchsorted(self.values, h[hit], "right")
        hit, left, right = hit[right > left], left[right > left], right[right > left]
        doc = np.searchsorted(at, hit, "right") - 1
        found = {(d, int(self.owner[v])) for d, a, b in zip(doc.tolist(), left.tolist(), right.tolist(), strict=True) for v in range(a, b)}
        out, own, last = [], None, -1
        for d, k in sorted(found):
            if d != last:
                own, last = np.unique(h[at[d] : at[d + 1]]), d
            s = self.sets[k]
            p = np.minimum(np.searchsorted(own, s), len(own) - 1)
            shared = int((own[p] == s).sum())
            if shared >= self.threshold * len(s) - 1e-9:
                out.append((d, k, shared, len(s)))
        return out


def blocks(benchmark: DataFrame, threshold: float = THRESHOLD) -> list[Index]:
    """Indexes of the items, one for each BLOCK_BYTES of text; each is built and shipped on its own."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = buckets_for(total_bytes(items, "text"), BLOCK_BYTES)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Index([(r.item_id, r.text) for r in rows], threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, shared, size, containment of every text and item that it holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in blocks(benchmark, threshold):

        def run(batches, index=index):
            for batch in batches:
                for a, _, data, offs in text_chunks(batch.column("text")):
                    got = index.search(data, offs)
                    ids = batch.column("doc_id").take(pa.array([a + d for d, *_ in got], pa.int64()))
                    item = pa.array([index.ids[k] for _, k, *_ in got], pa.int64())
                    shared, size = (pa.array([g[x] for g in got], pa.int64()) for x in (2, 3))
                    yield pa.RecordBatch.from_arrays([ids, item, shared, size, pa.array([g[2] / g[3] for g in got], pa.float64())], names=["doc_id", "item_id", "shared", "size", "containment"])

        part = rows.mapInArrow(tidy(run), "doc_id long, item_id long, shared long, size long, containment double")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that hold an item."""
    at = docs.columns.index("text")
    for index in blocks(benchmark, threshold):

        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, data, offs in text_chunks(batch.column(at)):
                    keep[[a + d for d, *_ in index.search(data, offs)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
