"""Fill-in-middle: texts cut at two unit ends into prefix, middle and suffix, and put in another order.

A text is kept as its maximal runs of one character class with the number of units that have ended with each run; a cut after
so many units is found by binary search among these counts, and its place in the run by arithmetic. Units are

* line: a line with its line feed (classes: line feeds, others; every line feed ends a unit),
* word: a word with the white space after it (classes: white space, others; every run of white space ends one unit),
* char: a code point (classes: characters of one, two, three and four bytes; every character is a unit).

Text at the end that no class ends is a last unit. The two cuts come from a hash of the seed and doc_id, so they don't depend on
how the table is partitioned, nor on what runs again after an executor is lost.

Edge cases: null is the empty text, which stays plain, as do texts that hold a sentinel; null doc_ids hash as the empty text; rows that
repeat are each cut alike; a text of one unit has cuts at its ends only; an empty table gives no rows; columns other than doc_id and text
are kept, but those named like the output's are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import tidy

#: Prefix, suffix and middle marks.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50
#: Bytes of a text that are looked at together.
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FEED = np.arange(256) == 10
#: Bytes of a character by its first byte; 0 inside a character.
_WIDTH = np.zeros(256, np.int8)
_WIDTH[:0x80], _WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:] = 1, 2, 3, 4


def _changes(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the maximal runs of one class start, found slice by slice."""
    found = [np.zeros(min(1, len(data)), np.int64)]
    for a in range(0, len(data), SLICE):
        c = classes[data[max(0, a - 1) : a + SLICE]]
        found.append(np.flatnonzero(c[1:] != c[:-1]) + max(1, a))
    return np.concatenate(found)


class Runs:
    """Run-length encoding of a UTF-8 text: start of each run, units that have ended by its end, and bytes between unit ends in it."""

    def __init__(self, data: np.ndarray, unit: str = "line"):
        self.size = len(data)
        if unit == "char":
            self._of_chars(data)
            return
        ends = _FEED if unit == "line" else _SPACE
        self.start = _changes(data, ends)
        stop = np.append(self.start[1:], self.size)
        ending = ends[data[self.start]] if self.size else np.zeros(0, bool)
        self.step = np.where(ending, 1 if unit == "line" else stop - self.start, stop - self.start)
        units = np.where(ending, (stop - self.start) // np.maximum(self.step, 1), 0)
        if self.size and not ending[-1]:
            units[-1] = 1
        self.ended = np.cumsum(units)

    def _of_chars(self, data: np.ndarray) -> None:
        starts, widths, last = [], [], 0
        for a in range(0, self.size, SLICE):
            w = _WIDTH[data[a : a + SLICE]]
            at = np.flatnonzero(w)
            w = w[at]
            new = np.flatnonzero(np.diff(w, prepend=np.int8(last)))
            starts.append(at[new] + a)
            widths.append(w[new])
            last = w[-1] if len(w) else last
        self.start = np.concatenate([np.zeros(0, np.int64), *starts])
        self.step = np.concatenate([np.zeros(0, np.int64), *widths]).astype(np.int64)
        self.ended = np.cumsum(np.diff(np.append(self.start, self.size)) // np.maximum(self.step, 1))

    @property
    def units(self) -> int:
        return int(self.ended[-1]) if len(self.ended) else 0

    def offset(self, unit: int) -> int:
        """Bytes before the end of the first so many units."""
        if unit <= 0:
            return 0
        run = int(np.searchsorted(self.ended, unit))
        before = int(self.ended[run - 1]) if run else 0
        return int(self.start[run]) + (unit - before) * int(self.step[run])


def _chars(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return sum(int(np.count_nonzero((data[a : a + SLICE] & 0xC0) != 0x80)) for a in range(0, len(data), SLICE))


def arrange(data: np.ndarray, h: tuple[int, int, int, int], unit: str, rate: int, spm: int, marks: tuple[bytes, bytes, bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and output of one text (bytes)."""
    runs = Runs(data, unit)
    n, text = runs.units, data.tobytes()
    if not text or h[2] % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = runs.offset(a), runs.offset(b)
    p, s, m = marks
    form = "spm" if h[3] % 100 < spm else "psm"
    out = b"".join((s, text[b:], p, text[:a], m, text[a:b]) if form == "spm" else (p, text[:a], s, text[b:], m, text[a:b]))
    return n, form, _chars(data[:a]), _chars(data[a:b]), out


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks whose first place in a text is always the one that was put there."""
    if len(set(sentinels)) < 3 or any(not m or m[0] in m[1:] for m in sentinels) or len({m[0] for m in sentinels}) > 1 or any(a != b and b.startswith(a) for a in sentinels for b in sentinels):
        raise ValueError("sentinels must differ, begin with the same character and have it nowhere else")
    return sentinels


_MADE = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]


def _maker(names: list[str], unit: str, rate: int, spm: int, marks: tuple[bytes, bytes, bytes], piece: int = 8 << 20) -> Callable:
    def run(batches):
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("__text"))
            hs = list(zip(*(batch.column(batch.schema.get_field_index(f"__h{k}")).to_pylist() for k in range(1, 5)), strict=True))
            rows, first, size = [], 0, 0
            for i in range(len(col)):
                data = np.frombuffer(col[i].as_buffer(), np.uint8)
                rows.append(arrange(data, hs[i], unit, rate, spm, marks))
                size += len(data)
                if size >= piece or i == len(col) - 1:
                    made = [list(c) for c in zip(*rows, strict=True)]
                    kept = [batch.column(batch.schema.get_field_index(c)).slice(first, len(rows)) for c in names]
                    arrays = [pa.array(made[0], pa.int64()), pa.array(made[1], pa.string()), pa.array(made[2], pa.int64()), pa.array(made[3], pa.int64()), pa.array(made[4], pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*kept, *arrays], [*names, *(f.name for f in _MADE)])
                    rows, first, size = [], i + 1, 0

    return tidy(run)


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs without text, with n, form (plain, psm or spm), prefix_chars, middle_chars and output.

    rate: texts of 100 that are cut; spm: of these, texts of 100 whose suffix comes first.
    """
    if unit not in ("line", "word", "char"):
        raise ValueError(f"unknown unit: {unit}")
    marks = tuple(m.encode() for m in _checked(sentinels))
    names = [c for c in docs.columns if c != "text" and c not in {f.name for f in _MADE}]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hs = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"__h{k + 1}") for k in range(4)]
    rows = docs.select(*(F.col(f"`{c}`") for c in names), F.coalesce("text", F.lit("")).alias("__text"), *hs)
    schema = StructType([*(docs.schema[c] for c in names), *_MADE])
    return rows.mapInArrow(_maker(names, unit, rate, spm, marks), schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text behind an output: its three parts are found by the first place of each mark."""
    p, s, m = sentinels

    def after(text: Column, head: Column, mark: str) -> Column:
        return F.substr(text, F.length(head) + len(mark) + 1)

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = after(body, one, second)
        two = F.substring_index(rest, m, 1)
        return one, two, after(rest, two, m)

    prefix, suffix, middle = between(p, s)
    suffix2, prefix2, middle2 = between(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
