"""LM scoring with a weighted backoff automaton over words, of order 3.

States are the empty history, words, and pairs of words that training has at least MIN_STATE times. An arc of the state h
on word w has the probability (c(h w) + m * p(w | h')) / (c(h) + m), where h' is h without its first word and m = MU + SHARE * c(h)
by length of h; where there is none, the failure arc to h' costs m / (c(h) + m). At the empty history p discounts all
counts by D = n1 / (n1 + 2 * n2) and gives that mass to unknown words as one. A text is one left-to-right traversal
that carries the state (it starts at END's) and adds logarithms.

Counts cover all training documents and are gathered in one round, with no table that a single machine must hold:
documents are packed into blocks of bounded size; a block asks for the counts of its own words, pairs and
triples, as sorted hashes, cut by hash range into a binary piece for each range that it has any of; each range
sums its pieces and answers every block in the order it asked. A block then builds the part of the automaton that its
texts can reach. Hashes have SPARE_BITS more bits than the corpus's size in bytes, so that an n-gram meets another one's
hash with a chance of less than 1 in 2^SPARE_BITS, at any size.

Edge cases: null and empty texts are the token END alone; null ids are training rows; rows that repeat are
counted and scored each; without training rows every token is unknown (probability 1); an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _STEP, buckets_for, crc_mod, materialize, mix, text_chunks, total_bytes, words

#: Weight of the shorter history against c(h) counts, for histories of one and of two words: MU + SHARE * c(h).
MU, SHARE = (200.0, 2.0), (3.0, 0.5)
#: Histories that training has less often are no states.
MIN_STATE = 2
#: Text bytes of a block of documents, and of the corpus for each range of hashes.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 16 << 20
#: Tokens of a lane of the traversal.
LANE = 512
#: Bits of a hash beyond those of the corpus's size in bytes (64 at most in all).
SPARE_BITS = 20
_END = np.uint64(0x1F83D9ABFB41BD6B)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with END after each, and each text's first one."""
    parts, sizes = [], []
    for _, _, data, offs in text_chunks(col):
        w, at = words(data, offs)
        n = np.diff(at)
        out = np.full(len(w) + len(n), _END, np.uint64)
        out[np.arange(len(w)) + np.repeat(np.arange(len(n)), n)] = w
        parts.append(out)
        sizes.append(n + 1)
    w = np.concatenate([np.zeros(0, np.uint64), *parts])
    return w, np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int64)


def ngrams(w: np.ndarray, at: np.ndarray, bits: int = 64):
    """Hashes of each token, of it with the one before, and with the two before; END stands before a text's first."""
    drop = np.uint64(64 - bits)
    yield w >> drop
    one = np.concatenate([[_END], w[:-1]])[: len(w)]
    one[at[:-1]] = _END
    with np.errstate(over="ignore"):
        yield mix(one * _STEP[0] + w * _STEP[1]) >> drop
    two = np.concatenate([[_END], one[:-1]])[: len(w)]
    two[at[:-1]] = np.uint64(0)  # nothing: END alone is a text's first history
    with np.errstate(over="ignore"):
        yield mix(two * _STEP[2] + one * _STEP[3] + w * _STEP[4]) >> drop


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, where each has its first place, and where each of h is among them."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    where = np.empty(len(h), np.int32)
    where[order] = np.cumsum(new, dtype=np.int32) - 1
    return s[new], order[new], where


# ---------------------------------------------------------------- counts of the whole corpus


def _pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers, or ascending numbers as differences, compressed by the planes of their bytes."""
    x = (np.diff(x, prepend=np.uint64(0)) if ascending else x).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T), 1)


def _unpack(raw, ascending: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(x, dtype=np.uint64) if ascending else x


def _range_of(values: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Range of hashes, by their upper 32 bits."""
    return ((values >> np.uint64(bits - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
_BLOCK_SQL = "block long, ids array<long>, held array<boolean>, train array<boolean>, sizes array<long>, data binary"
_ASK = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))])


def blocks(docs: DataFrame) -> DataFrame:
    """Documents packed into blocks of about BLOCK_BYTES of text, compressed; one row each."""
    rest = crc_mod(F.col("doc_id"), 7)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (rest == 2).alias("held"), (rest != 2).alias("train"), "text")

    def run(batches):
        codec, have, size = pa.Codec("zstd"), [], 0

        def made():
            table = pa.Table.from_batches(have)
            text = pa.concat_arrays([c.cast(pa.large_binary()).fill_null(b"") for c in table.column("text").chunks])
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            raw = text.buffers()[2]
            raw = b"" if raw is None else raw.slice(int(ends[0]), int(ends[-1] - ends[0]))
            row = {"block": uuid.uuid4().int >> 65, "ids": table.column("doc_id").to_pylist(), "held": table.column("held").to_pylist(), "train": table.column("train").to_pylist(), "sizes": np.diff(ends), "data": codec.compress(raw, asbytes=True)}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in batches:
            lengths = batch.column("text").cast(pa.large_string()).fill_null("")
            ends = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1]
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK_BYTES - size, "right")) - 1) if size < BLOCK_BYTES else a
                have.append(batch.slice(a, b - a))
                size += int(ends[b] - ends[a])
                a = b
                if size >= BLOCK_BYTES or a < len(batch):
                    yield made()
                    have, size = [], 0
        if have:
            yield made()

    return rows.mapInArrow(run, _BLOCK_SQL)


def _texts(row: dict) -> pa.Array:
    """The texts of a block."""
    ends = np.concatenate([[0], np.cumsum(row["sizes"], dtype=np.int64)])
    raw = pa.Codec("zstd").decompress(row["data"], int(ends[-1])) if ends[-1] else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), raw)


def _asks(row: dict, ranges: int, bits: int):
    """Questions of one block: for words (kind 0), pairs (1) and triples (2), a piece for each range that it has any of."""
    w, at = tokens(_texts(row))
    train = np.repeat(np.array(row["train"], bool), np.diff(at))
    for kind, h in enumerate(ngrams(w, at, bits)):
        out: dict[str, list] = {c: [] for c in _ASK.names}
        values, _, where = _distinct(h)
        counts = np.bincount(where[train], minlength=len(values))
        of = _range_of(values, ranges, bits)
        cut = np.flatnonzero(np.diff(of, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(values)], strict=True):
            for c, x in zip(_ASK.names, (kind, int(of[a]), row["block"], _pack(values[a:b], True), _pack(counts[a:b])), strict=True):
                out[c].append(x)
        del h, values, counts, where
        yield pa.RecordBatch.from_pydict(out, schema=_ASK)


def _answers(table: pa.Table) -> pa.Table:
    """Total counts of one range, for every block in the order of its question; the first row has statistics of words."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    hashes = [_unpack(x.as_buffer(), True) for x in table.column("hashes")]
    counts = [_unpack(x.as_buffer()) for x in table.column("counts")]
    values, _, where = _distinct(np.concatenate(hashes))
    total = np.bincount(where, np.concatenate(counts), len(values)).astype(np.uint32)
    back = total[where]
    stats = [int(total.sum(dtype=np.int64)), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
    ends = np.cumsum([len(x) for x in hashes])
    made = [_pack(x) for x in np.split(back, ends[:-1])]
    n = len(made)
    return pa.table([table.column("block"), [kind] * n, [part] * n, pa.array(made, pa.binary()), [stats if kind == 0 and k == 0 else None for k in range(n)]], schema=_ANSWER)


# ---------------------------------------------------------------- the model


class Smoothing:
    """Probabilities of words, and of words after a history."""

    def __init__(self, n: int, v: int, n1: int, n2: int):
        self.n, self.v = n, v
        d = n1 / (n1 + 2 * n2) if n1 else 0.5
        # an unknown word has D * V / N, which must not vanish
        self.d = min(0.95, max(0.05, d))

    def word(self, c: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(c))
        return np.where(c > 0, c - self.d, self.d * self.v) / self.n

    def lower(self, length: int, c: np.ndarray) -> np.ndarray:
        """Weight of the shorter history's probability at a history of one or two words with count c."""
        m = MU[length - 1] + SHARE[length - 1] * c
        return m / (c + m)

    def after(self, length: int, c: np.ndarray, both: np.ndarray, p: np.ndarray) -> np.ndarray:
        m = MU[length - 1] + SHARE[length - 1] * c
        return (both + m * p) / (c + m)


class Automaton:
    """The states and arcs that some texts can reach.

    States: 0 is the empty history, then come the words, then the pairs. An arc's number is that of its n-gram: arcs of the
    empty history are words, arcs of words are pairs, arcs of pairs are triples; ``arc`` says whether there is one.
    """

    def __init__(self, model: Smoothing, w: np.ndarray, at: np.ndarray, counts: list[np.ndarray], bits: int = 64):
        """counts: of the distinct words, pairs and triples of the texts (w, at), in order of their hashes."""
        grams = [_distinct(h)[1:] for h in ngrams(w, at, bits)]
        self.at, self.ids = at, [where for _, where in grams]
        (w1, word), (p1, pair), (t1, _) = grams
        c1, c2, c3 = (c.astype(np.float64) for c in counts)
        self.words, self.pairs, first = len(c1), len(c2), np.zeros(len(w), bool)
        first[at[:-1]] = True
        end = word[np.flatnonzero(w == _END)[0]] if len(w) else 0
        before = np.concatenate([[end], word[:-1]])[: len(w)]  # word before each token
        before[first] = end
        # states and their failure arcs
        n = 1 + self.words + self.pairs
        live = np.concatenate([[True], c1 >= MIN_STATE, c2 >= MIN_STATE])
        state_of = np.arange(n)
        state_of[1 : 1 + self.words][~live[1 : 1 + self.words]] = 0
        dead = ~live[1 + self.words :]
        state_of[1 + self.words :][dead] = state_of[1 + word[p1[dead]]]
        self.fail = np.zeros(n, np.int64)
        self.fail[1 + self.words :] = state_of[1 + word[p1]]
        self.fail_log = np.zeros(n)
        self.fail_log[1 : 1 + self.words] = np.log10(model.lower(1, c1))
        self.fail_log[1 + self.words :] = np.log10(model.lower(2, c2))
        # arcs: whether there is one, its weight and where it leads
        p = model.word(c1)
        h = before[p1]  # history of each pair
        p2 = np.where(live[1 + h], model.after(1, c1[h], c2, p[word[p1]]), p[word[p1]])
        last = pair[t1]  # the last two words of each triple
        lead = np.where(first[t1], 0, pair[np.maximum(t1, 1) - 1])  # its first two
        open_ = ~first[t1] & live[1 + self.words + lead]
        p3 = model.after(2, c2[lead], c3, p2[last]) if len(c3) else np.zeros(0)
        self.arc = np.concatenate([np.ones(self.words, bool), live[1 + h] & (c2 > 0), open_ & (c3 > 0)])
        with np.errstate(divide="ignore"):
            self.arc_log = np.log10(np.concatenate([p, p2, p3]))
        to = state_of[1 + self.words :]
        self.arc_to = np.concatenate([state_of[1 : 1 + self.words], to, to[last]])
        self.start = int(state_of[1 + end]) if len(w) else 0

    def traverse(self) -> np.ndarray:
        """log10 probability of each text: one walk from left to right, in lanes that are walked side by side.

        A lane inside a text begins two tokens early at the empty history, after which its state is what the whole walk's is.
        """
        n = np.diff(self.at)
        per = -(-n // LANE)
        text = np.repeat(np.arange(len(n)), per)
        begin = self.at[text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * LANE
        end = np.minimum(begin + LANE, self.at[text + 1])
        inner = begin > self.at[text]
        pos = begin - 2 * inner
        order = np.argsort(pos - end, kind="stable")  # longest first
        pos, begin, end, text, inner = pos[order], begin[order], end[order], text[order], inner[order]
        state = np.where(inner, 0, self.start)
        total = np.zeros(len(pos))
        words, pairs = self.words, self.words + self.pairs
        while len(pos):
            s, here, cost = state, pos, np.zeros(len(pos))
            arc = self._arc(s, here, words, pairs)
            for _ in range(2):
                stuck = np.flatnonzero(~self.arc[arc])
                if not len(stuck):
                    break
                cost[stuck] += self.fail_log[s[stuck]]
                s = s.copy()
                s[stuck] = self.fail[s[stuck]]
                arc[stuck] = self._arc(s[stuck], here[stuck], words, pairs)
            cost += self.arc_log[arc]
            total[: len(pos)] += np.where(pos >= begin, cost, 0)
            state = self.arc_to[arc]
            pos = pos + 1
            left = int(np.searchsorted(-(end - pos), 0, "left")) if len(pos) else 0  # lanes with tokens left come first
            pos, begin, end, state = pos[:left], begin[:left], end[:left], state[:left]
        return np.bincount(text, total, len(n))

    def _arc(self, state: np.ndarray, pos: np.ndarray, words: int, pairs: int) -> np.ndarray:
        """Number of the arc from each state on the token at pos."""
        w, p, t = self.ids
        return np.where(state == 0, w[pos], np.where(state <= words, words + p[pos], pairs + t[pos]))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    size = total_bytes(docs, "text")
    ranges, bits = buckets_for(size, RANGE_BYTES), min(64, max(32, size.bit_length() + SPARE_BITS))
    packed = materialize(blocks(docs))

    def ask(batches):
        for batch in batches:
            for k in range(len(batch)):
                yield from _asks(batch.slice(k, 1).to_pylist()[0], ranges, bits)

    asked = packed.mapInArrow(ask, "kind int, part int, block long, hashes binary, counts binary")
    answered = materialize(asked.groupBy("kind", "part").applyInArrow(_answers, "block long, kind int, part int, counts binary, stats array<long>"))
    s = answered.where("stats is not null").agg(*(F.sum(F.col("stats")[k]) for k in range(4))).first()
    model = Smoothing(*(int(x or 0) for x in s))

    def run(table: pa.Table) -> pa.Table:
        kinds, parts, raw = table.column("kind").to_pylist(), table.column("part").to_pylist(), table.column("raw")
        row = table.select(["ids", "held", "sizes"]).slice(kinds.index(-1), 1).to_pylist()[0] | {"data": raw[kinds.index(-1)].as_buffer()}
        w, at = tokens(_texts(row))
        counts = [np.concatenate([_unpack(raw[k].as_buffer()) for _, k in sorted((parts[k], k) for k in range(len(kinds)) if kinds[k] == kind)]) for kind in range(3)]
        machine = Automaton(model, w, at, counts, bits)
        c = counts[0][machine.ids[0]].astype(np.float64)
        base = np.log10((c + 1) / (model.n + model.v + 1))
        known = np.add.reduceat(c > 0, at[:-1], dtype=np.int64)
        made = {"doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": np.diff(at), "n_known": known, "train_tokens": np.full(len(known), model.n), "base_score": np.add.reduceat(base, at[:-1]), "score": machine.traverse()}
        return pa.table(made)

    # a block and its answers meet in one group
    none = lambda c: F.lit(None).cast(packed.schema[c].dataType).alias(c)
    texts = packed.select("block", F.lit(-1).alias("kind"), F.lit(0).alias("part"), F.col("data").alias("raw"), "ids", "held", "sizes")
    both = texts.unionByName(answered.select("block", "kind", "part", F.col("counts").alias("raw"), none("ids"), none("held"), none("sizes")))
    return both.groupBy("block").applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
