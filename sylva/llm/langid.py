"""Language ID by cross-parsing entropy.

Per language, a suffix automaton of a bounded labelled sample. A text is cut greedily into the
longest phrases that occur in the sample; the language that needs the fewest bits per
character (phrases times log2 of the sample's length) wins.

Edge cases: null, empty and letterless texts give ``und`` with score 0; null ids are never held
out; repeated rows are scored alike; without labelled rows every text is ``und``; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, text_chunks, tidy

#: Bound of the training sample: documents per language and characters of each (from its middle).
TRAIN_DOCS, TRAIN_CHARS = 24, 1200
#: Limits of keep_identified: a text of n symbols goes if its best language needs more than MAX_BITS * n + SLACK bits. Text of
#: the languages learned needs 2 to 3 a symbol, letters drawn at random over 10; SLACK keeps texts too short to tell.
MAX_BITS, SLACK = 6.0, 200.0
#: Symbols of a lane: texts are parsed in lanes side by side; phrases cross them, so its size changes no result.
BLOCK = 256

# Symbols: 0 any run of non-letters, 1-26 a-z, then lead and continuation bytes of non-ASCII letters and their marks;
# a lead byte without a symbol of its own is 95 and the symbol of its lower six bits.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[0x80:0xC0] = 27 + np.arange(64)
_CLASS[0xC0:] = 95
_CLASS[[0xC2, 0xC3, 0xC4, 0xC5]] = 91, 92, 93, 94
SYMBOLS = 96


_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Of all code points: 2 letters, 1 marks that go with them, 0 others."""
    if not _KINDS:
        first = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        _KINDS.append(np.array([2 if k == "L" else k == "M" for k in first], np.uint8))
    return _KINDS[0]


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes start a letter, and which belong to a letter or mark."""
    letter = (_CLASS[data] > 0) & (data < 0x80)
    inside = letter.copy()
    if (data >= 0x80).any():
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[code]
        letter[lead] = kind == 2
        inside = np.repeat(kind > 0, np.diff(np.append(lead, len(data))))
    return letter, inside


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as symbols (runs of non-letters collapsed into one) and their offsets."""
    return _symbols(data, offs)[:2]


def _symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbols(), and whether each text has a letter."""
    up = np.zeros(len(data), bool)
    if len(data) > 1:
        up[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    letter, inside = _letters(data)
    c = np.where(inside, _CLASS[np.where(up, data + 0x20, data)], 0).astype(np.uint8)
    keep = c != 0
    keep[1:] |= c[:-1] != 0
    first = offs[:-1][offs[:-1] < len(c)]
    keep[first] = c[first] != 0  # a text begins with a letter, whatever the one before ends with
    rare = c == 95
    size = keep.astype(np.int64) + rare
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.repeat(c, size)
    out[at[1:][rare] - 1] = 27 + (data[rare] & 63)
    return out, at[offs], np.diff(np.concatenate([[0], np.cumsum(letter)])[offs]) > 0


def automaton(text: np.ndarray) -> tuple[np.ndarray, int]:
    """Suffix automaton of ``text`` as a dense table: entry = next row * 2 + (1 if a new phrase starts there).

    Rows are premultiplied by SYMBOLS. Where no arc exists, the entry restarts at the root with this symbol.
    """
    arcs: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in arcs[p]:
            arcs[p][c] = cur
            p = link[p]
        if p != -1:
            q = arcs[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(arcs)
                arcs.append(arcs[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and arcs[p].get(c) == q:
                    arcs[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.empty((len(arcs), SYMBOLS), np.int32)
    restart = np.ones(SYMBOLS, np.int32)  # an unknown symbol is a phrase of its own
    for c, t in arcs[0].items():
        restart[c] = t * SYMBOLS * 2 + 1
    table[:] = restart
    rows = np.repeat(np.arange(len(arcs)), [len(a) for a in arcs])
    cols = np.fromiter((c for a in arcs for c in a), np.int64, len(rows))
    to = np.fromiter((t for a in arcs for t in a.values()), np.int64, len(rows))
    table[rows, cols] = to * SYMBOLS * 2
    table[0] = restart  # the root is only left to begin a phrase
    return table.ravel(), len(text)


def _walk(table: np.ndarray, lanes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases start in each lane if one does at its first symbol, and the state at its end; lanes is (step, lane), longest first."""
    starts = np.zeros(lanes.shape, bool)
    starts[:1] = True
    state = np.zeros(lanes.shape[1], np.int32)
    live = np.searchsorted(-lengths, -np.arange(lanes.shape[0]), "left")
    for step in range(lanes.shape[0]):
        n = live[step]
        v = table[state[:n] + lanes[step, :n]]
        starts[step, :n] |= (v & 1).astype(bool)
        state[:n] = v >> 1
    return starts, state


def phrases(table: np.ndarray, lanes: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Phrases that start in each lane; lanes is (step, lane), longest lanes first, ``before`` the lane that each goes on from, or -1.

    All lanes are walked as if a phrase started with them. A lane that goes on from another is then walked again from that
    one's last state, until a phrase starts where one did before: from there on both walks are the same.
    """
    starts, end = _walk(table, lanes, lengths)
    count = starts.sum(0)
    if before is None:
        return count
    last = end.copy()
    again = np.flatnonzero(before >= 0)
    while len(again):
        own, state, got, changed = again, last[before[again]], np.zeros(len(again), np.int64), []

        def settle(lane: np.ndarray, total: np.ndarray, state: np.ndarray) -> None:
            count[lane] = total
            changed.append(lane[last[lane] != state])
            last[lane] = state

        for step in range(lanes.shape[0]):
            over = lengths[own] <= step  # the walks never met
            if over.any():
                settle(own[over], got[over], state[over])
                own, state, got = own[~over], state[~over], got[~over]
            if not len(own):
                break
            v = table[state + lanes[step, own]]
            new, state = (v & 1).astype(bool), v >> 1
            met = new & starts[step, own]
            if met.any():
                settle(own[met], got[met] + starts[step:, own[met]].sum(0), end[own[met]])
            got = got + new
            own, state, got = own[~met], state[~met], got[~met]
        if len(own):
            settle(own, got, state)
        again = np.flatnonzero((before >= 0) & np.isin(before, np.concatenate(changed)))
    return count


class Model:
    """Automata of all languages; built once per Python worker from the sample."""

    _built: dict[str, Model] = {}

    def __init__(self, sample: list[tuple[str, str]]):
        by: dict[str, list[str]] = {}
        for lang, text in sample:
            by.setdefault(lang, []).append(text)
        self.langs, self.tables = [], []
        for lang in sorted(by):
            raw = np.frombuffer("\n".join(by[lang]).encode(), np.uint8)
            s, _, has = _symbols(raw, np.array([0, len(raw)]))
            if has[0]:
                self.langs.append(lang)
                self.tables.append(automaton(s))

    @classmethod
    def of(cls, key: str, sample: list[tuple[str, str]]) -> Model:
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(sample)
        return cls._built[key]

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (share of the winner in a softmax over bits) and bits per symbol of each text."""
        return self.parse(data, offs)[:3]

    def parse(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """predict(), and each text's number of symbols."""
        s, at, has = _symbols(data, offs)
        n = np.diff(at)
        per = -(-n // BLOCK)
        first = np.concatenate([[0], np.cumsum(per)])
        lane_of = np.repeat(np.arange(len(n)), per)
        start = at[lane_of] + (np.arange(first[-1]) - first[lane_of]) * BLOCK
        length = np.minimum(BLOCK, at[lane_of + 1] - start)
        order = np.argsort(-length, kind="stable")
        padded = np.concatenate([s, np.zeros(BLOCK, np.uint8)])
        lanes = np.ascontiguousarray(padded[start[order][:, None] + np.arange(BLOCK)].T)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.where(start > at[lane_of], place[np.maximum(np.arange(len(order)) - 1, 0)], -1)[order]
        bits = np.full((max(1, len(self.langs)), len(n)), np.inf)
        for k, (table, size) in enumerate(self.tables):
            got = phrases(table, lanes, length[order], before)
            total = np.bincount(lane_of[order], got, len(n))
            bits[k] = total * np.log2(size + 1) / np.maximum(n, 1)
        best = bits.argmin(0)
        low = bits[best, np.arange(len(n))]
        with np.errstate(invalid="ignore", over="ignore"):
            score = 1 / np.exp2(-(bits - low) * 8).sum(0)
        known = has & bool(self.langs)
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0), np.where(known, low, np.inf), n


def training_sample(docs: DataFrame, holdout: int = 5) -> list[tuple[str, str]]:
    """At most TRAIN_DOCS pieces of TRAIN_CHARS characters for each language, from rows that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), holdout) != 0))
    middle = F.greatest(F.lit(1), (F.length("text") / 3).cast("int"))
    rows = rows.select("lang", F.xxhash64("doc_id", "text").alias("h"), F.col("text").substr(middle, F.lit(TRAIN_CHARS)).alias("piece"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))
    return [(r.lang, r.piece) for r in rows.withColumn("r", rank).where(f"r <= {TRAIN_DOCS}").orderBy("lang", "h", "piece").collect()]


def identify(docs: DataFrame, sample: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits (per symbol) of every row of ``docs`` (doc_id, text, lang)."""
    if sample is None:
        sample = training_sample(docs)
    key = str(hash(tuple(sample)))

    def run(batches):
        for batch in batches:
            model = Model.of(key, sample)
            for a, b, data, offs in text_chunks(batch.column("text")):
                lang, score, bits = model.predict(data, offs)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], names=["doc_id", "held_out", "lang_pred", "score", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double, bits double")


def keep_identified(docs: DataFrame, max_bits: float = MAX_BITS, slack: float = SLACK) -> DataFrame:
    """Rows whose text has a letter and is in a language of the labelled rows, by the bits that its parse needs; all their columns."""
    sample = training_sample(docs)
    key, names = str(hash(tuple(sample))), docs.columns

    def run(batches):
        for batch in batches:
            model = Model.of(key, sample)
            for a, b, data, offs in text_chunks(batch.column(names.index("text"))):
                lang, _, bits, n = model.parse(data, offs)
                with np.errstate(invalid="ignore"):
                    fits = bits * n <= max_bits * n + slack
                yield batch.slice(a, b - a).filter(pa.array(fits & np.array([x != "und" for x in lang], bool), pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
