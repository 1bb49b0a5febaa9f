"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage's vector has the shares of its words, and of their first
and last three bytes, in hashed buckets, and surface statistics; a learned layer encodes it. Gated attention, a = softmax(w . (tanh(V h) * sigmoid(U h))), weighs them; the weighted sum is scored by a
logistic layer. It is fitted on the driver by Adam on a bounded sample of labelled documents: TRAIN_DOCS at most,
all passages of each.

Edge cases: null, empty and wordless texts are one passage of zeros and get a score like any other; null ids are never held
out; conflicting labels of one document all count; null labels are left out; without labelled rows every score is
0.5; rows that repeat are scored alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import crc_mod, text_chunks

PASSAGE, TRAIN_DOCS = 64, 4000
HIDDEN, EPOCHS, BATCH, RATE = 12, 14, 64, 0.02

# Kinds of bytes that are counted: upper, lower, digit, other ASCII marks by group, non-ASCII.
_KIND = np.full(256, 4, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
for _k, _marks in enumerate((b".,;:'\"", b"!?", b"|<>/\\=_{}[]()", b"#$%&*@^~+`"), 5):
    _KIND[list(_marks)] = _k
KINDS = 9
SURFACE = KINDS + 9
#: Hashed buckets of words, and of their beginnings and endings.
WORDS, AFFIXES = 32, 32
FEATURES = SURFACE + WORDS + AFFIXES


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages, and each document's first one."""
    low = common._LOWER[data]
    s, e, at = common.spans(~common._WS[low], offs)
    h = common.span_hashes(low, s, e)
    n = np.diff(at)
    per = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros((first[-1], FEATURES))
    if not len(s):
        return out, first
    doc = np.repeat(np.arange(len(n)), n)
    own = first[doc] + (np.arange(len(s)) - at[doc]) // PASSAGE
    size = np.bincount(own, minlength=len(out)).astype(float)
    some = np.maximum(size, 1)
    length = (e - s).astype(float)
    # bytes of words by kind, as differences of running counts
    chars = np.bincount(own, length, len(out))
    kind = _KIND[data]
    for k in range(KINDS):
        run = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        out[:, k] = np.bincount(own, run[e] - run[s], len(out)) / np.maximum(chars, 1)
    mean = chars / some
    out[:, KINDS] = np.log1p(mean)
    out[:, KINDS + 1] = np.sqrt(np.maximum(0, np.bincount(own, length * length, len(out)) / some - mean**2)) / 8
    same = own[1:] == own[:-1]
    out[:, KINDS + 2] = np.bincount(own[1:], same & (h[1:] == h[:-1]), len(out)) / some
    with np.errstate(over="ignore"):
        out[:, KINDS + 3] = _distinct(own, h, len(out)) / some
        two = h[1:] * common._STEP[0] + h[:-1]
    out[:, KINDS + 4] = _distinct(own[1:][same], two[same], len(out)) / np.maximum(1, size - 1)
    edge = kind[e - 1]
    out[:, KINDS + 5] = np.bincount(own, edge >= 6, len(out)) / some
    out[:, KINDS + 6] = np.bincount(own, kind[s] == 0, len(out)) / some
    out[:, KINDS + 7] = np.bincount(own, length == 1, len(out)) / some
    out[:, KINDS + 8] = size / PASSAGE
    # hashed words, beginnings and endings, as square roots of shares
    base = own * (WORDS + AFFIXES)
    count = np.bincount(base + (h >> np.uint64(59)).astype(np.int64), minlength=len(out) * (WORDS + AFFIXES))
    for at_ in (s, np.maximum(s, e - 3)):
        code = np.zeros(len(s), np.uint64)
        for k in range(3):
            code = code * np.uint64(256) + np.where(at_ + k < e, low[np.minimum(at_ + k, len(low) - 1)], 0).astype(np.uint64)
        with np.errstate(over="ignore"):
            code = common.mix(code * np.uint64(2) + np.uint64(at_ is not s))
        count += np.bincount(base + WORDS + (code >> np.uint64(59)).astype(np.int64), minlength=len(count))
    out[:, SURFACE:] = np.sqrt(count.reshape(len(out), -1) / some[:, None])
    return out, first


def _distinct(own: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each owner (owners ascend)."""
    with np.errstate(over="ignore"):
        key = (own.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)[:n]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, p: dict[str, np.ndarray]):
        self.mean, self.scale, self.p = mean, scale, p

    def _forward(self, x: np.ndarray, first: np.ndarray):
        p, bag = self.p, np.repeat(np.arange(len(first) - 1), np.diff(first))
        z = np.tanh(x @ p["e"] + p["eb"])
        t, g = np.tanh(z @ p["v"]), _sigmoid(z @ p["u"])
        a = (t * g) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, first[:-1])[bag])
        a /= np.add.reduceat(a, first[:-1])[bag]
        rep = np.add.reduceat(a[:, None] * z, first[:-1])
        return bag, z, t, g, a, rep, _sigmoid(rep @ p["c"] + p["cb"][0])

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale, first)[-1]

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        bag, z, t, g, a, rep, s = self._forward(x, first)
        d = (s - y) / len(y)
        drep = d[:, None] * p["c"]
        dz = a[:, None] * drep[bag]
        da = (z * drep[bag]).sum(1)
        da = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
        dt, dg = da[:, None] * p["w"] * g * (1 - t * t), da[:, None] * p["w"] * t * g * (1 - g)
        dz += dt @ p["v"].T + dg @ p["u"].T
        dz *= 1 - z * z
        return {"c": rep.T @ d, "cb": np.array([d.sum()]), "w": (t * g).T @ da, "v": z.T @ dt, "u": z.T @ dg, "e": x.T @ dz, "eb": dz.sum(0)}


def fit(bags: list[np.ndarray], labels: list[int]) -> Model | None:
    """Adam on the cross entropy; deterministic."""
    if not bags:
        return None
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    bags = [(b - mean) / scale for b in bags]
    y = np.array(labels, float)
    rng = np.random.default_rng(7)
    shape = {"e": (FEATURES, HIDDEN), "eb": (HIDDEN,), "v": (HIDDEN, HIDDEN), "u": (HIDDEN, HIDDEN), "w": (HIDDEN,), "c": (HIDDEN,), "cb": (1,)}
    model = Model(mean, scale, {k: rng.normal(0, 0.3, s) for k, s in shape.items()})
    m = {k: np.zeros(s) for k, s in shape.items()}
    v = {k: np.zeros(s) for k, s in shape.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            x = [bags[i] for i in part]
            first = np.concatenate([[0], np.cumsum([len(b) for b in x])])
            grad = model.gradients(np.concatenate(x), first, y[part])
            step += 1
            rate = RATE * (0.3 if epoch >= EPOCHS - 4 else 1)
            for name, g in grad.items():
                g = g + 1e-4 * model.p[name]
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                model.p[name] = model.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """Fit on at most TRAIN_DOCS labelled rows that are not held out, the first by a hash of doc_id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(crc_mod(F.col("doc_id"), 5) != 0)
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(TRAIN_DOCS)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def encode(batches):
        for batch in batches:
            for a, b, data, offs in text_chunks(batch.column("text")):
                x, first = passages(data, offs)
                part = batch.slice(a, b - a)
                kept = [x[first[k] : first[k + 1]].astype(np.float32).tobytes() for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(kept, pa.binary())], names=["doc_id", "y", "x"])

    both = text.join(F.broadcast(rows), "doc_id").select("doc_id", "y", "text")  # at most TRAIN_DOCS rows of two numbers
    got = both.mapInArrow(encode, "doc_id long, y int, x binary").orderBy("doc_id", "y", "x").collect()
    return fit([np.frombuffer(r.x, np.float32).reshape(-1, FEATURES).astype(float) for r in got], [int(r.y > 0) for r in got])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "text")

    def run(batches):
        for batch in batches:
            for a, b, data, offs in text_chunks(batch.column("text")):
                s = np.full(b - a, 0.5) if model is None else model.score(*passages(data, offs))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.3).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
