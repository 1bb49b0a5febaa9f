"""Best-fit packing of tokenised documents by bin completion with branch and bound.

A document is its token ids and END; longer ones are cut into full pieces, with what is over as the first.
Only the count of pieces of each length (at most CAPACITY numbers) reaches the driver. There, best-fit decreasing over all
counts is the first incumbent (bins with equal contents are one entry, so its size is bounded by CAPACITY, not by the
data). If it needs more sequences than the lower bound, branch and bound looks for less: bins are completed around the
largest remaining piece by undominated fillings, least waste first, each used as often as pieces and waste allow; a branch
ends where its waste rules out a better packing than the incumbent. It visits at most NODES nodes; the incumbent stays if
it finds nothing, so a plan never needs more sequences than best-fit. Pieces get ranks within their length where they
are cut, and look their place up.

Edge cases: null and empty texts are one END; rows that repeat doc_id are packed each on their own (their
pieces number alike); null ids are packed too; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import array
import base64
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy

CAPACITY, END = 2048, 0
#: Nodes that branch and bound may visit, and fillings it tries at each.
NODES, BRANCH = 4_000, 8
#: Distinct words whose ids a worker remembers.
CACHE = 150_000

_ODD = re.compile(r"\s\s|^ | $|[^\S \n]|\n$|^\n")


class Encoder:
    """Ids of texts as little-endian bytes; words between single spaces and line ends are looked up.

    The tokenizer's pieces never cross a single space or line end between non-spaces, so texts with no other
    white space are the ids of their words; the rest is encoded as a whole.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.made = path, None
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.fast = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):  # the same vocabulary, faster for single words
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.first, self.later = _Words(self, ""), _Words(self, " ")
        self.newline = self.raw("\n")

    @property
    def whole(self):
        """The tokenizer itself; most texts do without."""
        if self.made is None:
            from tokenizers import Tokenizer

            self.made = Tokenizer.from_file(self.path)
        return self.made

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def raw(self, text: str) -> bytes:
        ids = self.fast(text) if self.fast else self.whole.encode(text, add_special_tokens=False).ids
        return array.array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if not text or _ODD.search(text):
            return self.raw(text)
        out = []
        later = self.later
        for line in text.split("\n"):
            head, space, rest = line.partition(" ")
            out.append(self.first[head] + b"".join([later[w] for w in rest.split(" ")]) if space else self.first[head])
        return self.newline.join(out)


class _Words(dict):
    def __init__(self, encoder: Encoder, prefix: str):
        self.encoder, self.prefix = encoder, prefix

    def __missing__(self, word: str) -> bytes:
        if len(word) > 1 and word[-1] in ",." and word[:-1].isalpha():
            return self[word[:-1]] + self.encoder.first[word[-1]]
        ids = self.encoder.raw(self.prefix + word)
        if len(self) < CACHE and len(word) < 64:
            self[word] = ids
        return ids


def pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row; part (the task) and rank (among those of its length there)."""

    def run(batches):
        encoder = Encoder.of(tokenizer)
        end = array.array("I", [END]).tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(CAPACITY + 1, np.int64)
        for batch in batches:
            ids, col = batch.column("doc_id").to_pylist(), batch.column("text")
            out: list[list] = [[], [], [], [], []]
            for r, doc_id in enumerate(ids):
                raw = encoder.encode(col[r].as_py() or "") + end
                n = len(raw) // 4
                cuts = [0, *range(n % CAPACITY or CAPACITY, n + 1, CAPACITY)]
                for k in range(len(cuts) - 1):
                    row = (doc_id, k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(raw[4 * cuts[k] : 4 * cuts[k + 1]]))
                    for o, x in zip(out, row, strict=True):
                        o.append(x)
            rank = np.zeros(len(out[0]), np.int64)
            length = np.array(out[3], np.int64)
            order = np.argsort(length, kind="stable")
            kinds, first, count = np.unique(length[order], return_index=True, return_counts=True)
            rank[order] = np.arange(len(order)) - np.repeat(first - seen[kinds], count)
            seen[kinds] += count
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(o, pa.int64()) for o in out[2:]), pa.array(np.full(len(rank), part, np.int32)), pa.array(rank)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


# ---------------------------------------------------------------- the plan


Fillings = list[tuple[list[int], int]]


def best_fit(counts: dict[int, int]) -> Fillings:
    """Best-fit decreasing over so many pieces of each length: contents of bins, with how many bins have them."""
    groups: dict[int, list[tuple[tuple, int]]] = {}  # by room: (contents as nested pairs, how many)
    rooms = 0  # bit r: there are bins with room r

    def put(room: int, contents: tuple, times: int) -> None:
        nonlocal rooms
        if times:
            groups.setdefault(room, []).append((contents, times))
            rooms |= 1 << room

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            fits = rooms >> x
            room = x + (fits & -fits).bit_length() - 1 if fits else CAPACITY
            if fits:
                contents, times = groups[room].pop()
                if not groups[room]:
                    rooms &= ~(1 << room)
            else:
                contents, times = (), left
            each = room // x  # a bin that gets one piece is the best fit for the next
            full = min(times, left // each)
            put(room - each * x, (contents, x, each), full)
            left -= full * each
            if full < times and left:  # less than a full bin's worth
                put(room - left * x, (contents, x, left), 1)
                times, left = times - 1, 0
            if fits:
                put(room, contents, times - full)
    out = []
    for bins in groups.values():
        for contents, times in bins:
            flat: list[int] = []
            while contents:
                contents, x, each = contents
                flat = [x] * each + flat
            out.append((flat, times))
    return out


def lower_bound(counts: dict[int, int]) -> int:
    """Sequences that any packing needs: by the sum of lengths, and by pieces that cannot share one."""
    n = np.zeros(CAPACITY + 1, np.int64)
    for x, c in counts.items():
        n[x] = c
    size = n * np.arange(CAPACITY + 1)
    best = -(-int(size.sum()) // CAPACITY)
    half = CAPACITY // 2
    for least in range(1, half + 1):  # pieces shorter than this are left out
        alone = int(n[CAPACITY - least + 1 :].sum())
        large = slice(half + 1, CAPACITY - least + 1)
        free = int(n[large].sum()) * CAPACITY - int(size[large].sum())
        best = max(best, alone + int(n[large].sum()) + max(0, -(-(int(size[least : half + 1].sum()) - free) // CAPACITY)))
    return best


class _Stock:
    """Pieces left by length, with bit sets of the lengths there are (from below and from above)."""

    def __init__(self, counts: dict[int, int]):
        self.n = [0] * (CAPACITY + 1)
        self.up = self.down = 0
        for x, c in counts.items():
            self.add(x, c)

    def add(self, x: int, c: int) -> None:
        self.n[x] += c
        bit = bool(self.n[x])
        self.up = self.up & ~(1 << x) | bit << x
        self.down = self.down & ~(1 << CAPACITY - x) | bit << CAPACITY - x

    def pairs(self, total: int, most: int) -> int:
        """Bit set of lengths a <= most for which a and total - a <= a are there."""
        both = self.up & (self.down >> CAPACITY - total) if total > 1 else 0
        return both & (1 << most + 1) - 1 & -(1 << (total + 1) // 2)

    def has(self, chosen: list[int]) -> bool:
        return all(self.n[x] >= chosen.count(x) for x in chosen)


def fillings(stock: _Stock, top: int, spare: int) -> list[list[int]]:
    """Undominated fillings around top with up to ``spare`` waste, least waste and fewest pieces first, BRANCH at most."""
    room, out = CAPACITY - top, []
    for waste in range(min(spare, room) + 1):
        r = room - waste
        if r == 0:
            out.append([top])
            break
        if stock.n[r] and stock.has([top, r]):
            out.append([top, r])
            break  # dominates what fits into its place
        pairs = stock.pairs(r, r)
        while pairs and len(out) < BRANCH:
            a = pairs.bit_length() - 1
            pairs &= ~(1 << a)
            if stock.has(chosen := [top, a, r - a]):
                out.append(chosen)
                break
        more = _several(stock, top, r)
        if more:
            out.append(more)
        if len(out) >= BRANCH:
            break
    return out


def _several(stock: _Stock, top: int, r: int) -> list[int]:
    """top and three or more pieces that fill r exactly, large ones first; [] if none is found."""
    below = stock.up & (1 << r) - 1
    while below > 1:
        a = below.bit_length() - 1
        below &= ~(1 << a)
        if 3 * a < r:
            break
        pairs = stock.pairs(r - a, a)
        while pairs:
            b = pairs.bit_length() - 1
            pairs &= ~(1 << b)
            if stock.has(chosen := [top, a, b, r - a - b]):
                return chosen
    # more: the largest pieces, and two for the rest
    chosen, left = [top], r
    below = stock.up
    while left > 1:
        below &= (1 << left) - 1
        if below < 2:
            return []
        a = below.bit_length() - 1
        if stock.n[a] > chosen.count(a):
            chosen.append(a)
            left -= a
            pairs = stock.pairs(left, a)
            while pairs:
                b = pairs.bit_length() - 1
                pairs &= ~(1 << b)
                if stock.has(chosen + [b, left - b]):
                    return chosen + [b, left - b]
            if stock.n[left] > chosen.count(left):
                return [*chosen, left]
        else:
            below &= ~(1 << a)
    return [*chosen, 1] if left == 1 and stock.n[1] > chosen.count(1) else chosen if left == 0 else []


def complete(counts: dict[int, int], incumbent: Fillings, bound: int) -> Fillings:
    """Bin completion by branch and bound: the best packing found within NODES nodes, the incumbent if none is better."""
    best, need = incumbent, sum(t for _, t in incumbent)
    total = sum(x * c for x, c in counts.items())
    stock, made, waste, nodes = _Stock(counts), [], 0, 0
    branches: list = []  # of the open nodes: fillings not tried yet
    while need > bound and nodes < NODES:
        spare = (need - 1) * CAPACITY - total - waste
        if stock.up == 0:
            best, need = list(made), sum(t for _, t in made)
        elif spare >= 0 and len(branches) == len(made):
            nodes += 1
            branches.append(iter(fillings(stock, stock.up.bit_length() - 1, spare)))
        # the next filling of the last node, or back
        while branches:
            if len(made) == len(branches):
                chosen, times = made.pop()
                waste -= times * (CAPACITY - sum(chosen))
                for x in chosen:
                    stock.add(x, times)
            spare = (need - 1) * CAPACITY - total - waste
            chosen = next(branches[-1], None)
            lost = CAPACITY - sum(chosen) if chosen else 0
            if chosen and lost <= spare:
                times = min(stock.n[x] // chosen.count(x) for x in chosen)
                times = min(times, spare // lost) if lost else times
                for x in chosen:
                    stock.add(x, -times)
                waste += times * lost
                made.append((chosen, times))
                break
            branches.pop()
        else:
            break
    return best


def plan(counts: dict[int, int]) -> Fillings:
    """Fillings with how often each is used, for so many pieces of each length."""
    counts = {x: c for x, c in counts.items() if c}
    return complete(counts, best_fit(counts), lower_bound(counts))


class Places:
    """Where the piece with some rank among those of its length goes."""

    def __init__(self, fillings: list[tuple[list[int], int]]):
        entry: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        sequence = 0
        for chosen, times in fillings:
            offset = 0
            for n in sorted(set(chosen), reverse=True):
                k = chosen.count(n)
                entry.setdefault(n, []).append((taken.get(n, 0), k, sequence, offset))
                taken[n] = taken.get(n, 0) + k * times
                offset += n * k
            sequence += times
        self.sequences = sequence
        self.tables = {n: np.array(rows, np.int64) for n, rows in entry.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            t = self.tables[int(n)]
            row = t[np.searchsorted(t[:, 0], rank[at], "right") - 1]
            k = rank[at] - row[:, 0]
            seq[at] = row[:, 2] + k // row[:, 1]
            off[at] = row[:, 3] + k % row[:, 1] * n
        return seq, off


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; all sequences hold CAPACITY ids at most."""
    cut = materialize(pieces(docs, tokenizer))
    sizes = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan(counts))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = cut.join(sizes.withColumn("before", before).drop("n"), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches):
        for batch in batches:
            seq, off = places.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
