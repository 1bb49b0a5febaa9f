"""LM scoring against a plain recursion of the backed-off probabilities."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from sylva.llm import lm

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def plain(rows):
    """Result rows by the definition: counts in dictionaries, one recursion for each token."""
    toks = [[*words(t), None] for _, t in rows]
    grams = [Counter(), Counter(), Counter()]
    for (i, _), t in zip(rows, toks, strict=True):
        if not held_out(i):
            known = [None, *t]
            for k in range(len(t)):
                grams[0][t[k],] += 1
                grams[1][known[k], t[k]] += 1
                if k:
                    grams[2][known[k - 1], known[k], t[k]] += 1
    n, v = sum(grams[0].values()), len(grams[0])
    n1, n2 = (sum(c == k for c in grams[0].values()) for k in (1, 2))
    d = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 else 0.5))

    def p(history, w):
        c = grams[0][w,]
        if not history:
            return ((c - d if c else d * v) / n) if n else 1.0
        c = grams[len(history) - 1][history]
        if c < lm.MIN_STATE:
            return p(history[1:], w)
        m = lm.MU[len(history) - 1] + lm.SHARE[len(history) - 1] * c
        return (grams[len(history)][*history, w] + m * p(history[1:], w)) / (c + m)

    out = []
    for (i, _), t in zip(rows, toks, strict=True):
        known = [None, *t]
        total = sum(math.log10(p(tuple(known[max(0, k - 1) : k + 1]), t[k])) for k in range(len(t)))
        base = sum(math.log10((grams[0][w,] + 1) / (n + v + 1)) for w in t)
        out.append((-1 if i is None else i, held_out(i), len(t), sum(grams[0][w,] > 0 for w in t), n, round(base, 5), round(total, 5)))
    return sorted(out)


def scored(spark, rows):
    got = lm.score(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got)


ODD = [(10**6, None), (10**6 + 1, ""), (None, "a b"), (None, "a b"), (10**6 + 2, "A b  a\tB\n"), (10**6 + 3, " "), (10**6 + 4, "é ß é ß é ß")]


def test_score_is_the_recursion(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(120).collect()] + ODD
    assert scored(spark, rows) == plain(rows)


@pytest.mark.parametrize("lane", [1, 3, 512])
def test_lanes_and_blocks_change_nothing(spark, monkeypatch, lane):
    rng = random.Random(lane)
    rows = [(i, " ".join(rng.choice("abcdeF") for _ in range(rng.choice((0, 1, 2, 5, 40, 300))))) for i in range(60)] + ODD
    rows += [(i + 1000, t) for i, t in rows[:20]]
    monkeypatch.setattr(lm, "LANE", lane)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 700)
    monkeypatch.setattr(lm, "RANGE_BYTES", 300)
    assert scored(spark, rows) == plain(rows)


def test_texts_with_known_and_unknown_histories(spark):
    rng = random.Random(2)
    train = [(i, " ".join(rng.choice("abcd") for _ in range(30))) for i in range(30) if not held_out(i)]
    for lead in ("a", "b c", "d d", "zz"):
        probe = [(k, f"{lead} {w}".strip()) for k, w in zip((j for j in range(100, 400) if held_out(j)), ["a", "b", "c", "d", "unseen"], strict=False)]
        short = (next(j for j in range(400, 500) if held_out(j)), lead)
        by = {r[0]: 10 ** r[6] for r in scored(spark, train + probe + [short])}
        want = {r[0]: 10 ** r[6] for r in plain(train + probe + [short])}
        assert by == pytest.approx(want)


def test_no_training_rows_and_no_rows(spark):
    rows = [(i, "a b") for i in range(60) if held_out(i)]
    assert {r[6] for r in scored(spark, rows)} == {0.0}
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents_that_occur_twice_stand_apart(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(120)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:10]) if not held_out(i)]
    per = {r[0]: r[6] / r[2] for r in scored(spark, rows)}
    ids = {i for i, _ in rows}
    twice = [per[i] for i in range(10) if {i, i + 60} <= ids]
    assert min(twice) > max(per[i] for i in range(10, 60) if i in per)


def test_long_text_and_clashing_columns(spark):
    text = " ".join(f"w{i % 997}" for i in range(30_000))
    df = spark.createDataFrame([(1, text, "x", 2), (2, text, None, 3)], "doc_id long, text string, block string, train int")
    assert [r.n_tokens for r in lm.score(df).collect()] == [30_001] * 2
