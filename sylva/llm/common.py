"""Shared plumbing: durable intermediate tables and vectorised word hashing over Arrow text."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that Python workers hold as numpy arrays at a time.
CHUNK_BYTES = 1 << 20

#: Spark removes a query's shuffle files when it ends, if this is set while it is planned.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Ids that may be broadcast (a few tens of MB); larger sets are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``; one of our own only where it is unset in local mode (tests)."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="sylva-checkpoint-")
    return _own_dir


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    Its shuffle files go once it is written; discard() removes the table when its last reader is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sylva-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _small(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are at most BROADCAST_IDS rows."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def pick(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose key (the one column of the materialised ids) is among them; df stays where it is while they are few."""
    return df.join(_small(ids), ids.columns, "left_semi")


def leave(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose key is not among the materialised ids."""
    return df.join(_small(ids), ids.columns, "left_anti")


def small_batches(spark: SparkSession, rows: int = 1500, size: int = 32 << 20) -> None:
    """Less text to a Python worker at a time, unless the session asks for other numbers than Spark's own."""
    for name, usual, less in (("maxRecordsPerBatch", 10000, rows), ("maxBytesPerBatch", 64 << 20, size)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, str(usual)) in (str(usual), f"{usual}b"):
            spark.conf.set(name, str(less))


def trim() -> None:
    """Give memory that this process has freed back to the machine: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function of Arrow batches that gives its memory back when its task ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids give -1 (never held out)."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % m, F.lit(-1))


# ---------------------------------------------------------------- text as numpy arrays

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        for key, base in (("p", _BASE), ("i", _INV)):
            with np.errstate(over="ignore"):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                np.multiply.accumulate(a, out=a)
            _POW[key] = a
    return _POW["p"], _POW["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(col: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into (first row, end row, bytes, offsets) of about ``limit`` bytes; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if len(col) == 0:
        return
    col = col.cast(pa.large_string()).fill_null("")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside`` that do not cross documents; and each document's first run."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, offs)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span (polynomial over random byte codes, then mixed)."""
    with np.errstate(over="ignore"):
        p, inv = _powers(len(data) + 1)
        c = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * p[: len(data)], out=c[1:])
        h = (c[e] - c[s]) * inv[s]
        return mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and each document's first word."""
    data = _LOWER[data]
    s, e, at = spans(~_WS[data], offs)
    return span_hashes(data, s, e), at


# Letters and digits of normalised words: ASCII alphanumerics and all non-ASCII bytes.
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True


def plain_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like words(), for runs of letters and digits: case (Latin-1 too) and ASCII punctuation do not count."""
    data = _LOWER[data]
    if len(data) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][up] += 0x20
    s, e, at = spans(_ALNUM[data], offs)
    return span_hashes(data, s, e), at


_STEP = [np.uint64(x) for x in _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def shingles(w: np.ndarray, at: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word shingles and each document's first one.

    A document with fewer words has its whole sequence as one shingle (short) or none.
    """
    with np.errstate(over="ignore"):
        count = np.diff(at)
        m = np.where(count >= n, count - n + 1, (count > 0) if short else 0)
        out_at = np.concatenate([[0], np.cumsum(m)])
        h = np.zeros(out_at[-1], np.uint64)
        if len(w) >= n:
            full = np.zeros(len(w) - n + 1, np.uint64)
            for j in range(n):
                full += w[j : len(w) - n + 1 + j] * _STEP[j]
            full = mix(full)
            long = count >= n
            take = np.repeat(long, m)
            src = np.repeat(at[:-1] - out_at[:-1], m) + np.arange(len(h))
            h[take] = full[src[take]]
        if short:
            for k in range(1, n):
                rows = np.flatnonzero(count == k)
                if len(rows):
                    acc = np.full(len(rows), k, np.uint64) * np.uint64(0xA24BAED4963EE407)
                    for j in range(k):
                        acc += w[at[rows] + j] * _STEP[j]
                    h[out_at[rows]] = mix(acc)
        return h, out_at


def total_bytes(df: DataFrame, col: str) -> int:
    return int(df.agg(F.sum(F.octet_length(col).cast("long"))).first()[0] or 0)


def buckets_for(nbytes: int, per_bucket: int) -> int:
    return max(1, math.ceil(nbytes / per_bucket))
