"""Cross-parsing against a plain parse with string search; the limit of the pipeline's stage."""

import random

import numpy as np
import pytest

from sylva.llm import langid


def plain_phrases(sample: bytes, text: bytes) -> int:
    n, phrase = 0, b""
    for c in text:
        if phrase and sample.find(phrase + bytes([c])) >= 0:
            phrase += bytes([c])
        else:
            n, phrase = n + 1, bytes([c])
    return n


def coded(text: str) -> bytes:
    raw = np.frombuffer(text.encode(), np.uint8)
    return langid.symbols(raw, np.array([0, len(raw)]))[0].tobytes()


@pytest.mark.parametrize("block", [1, 2, 7, 64, 256])
def test_phrases_cross_lanes(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(block)
    stock = ["".join(rng.choice("abc ") for _ in range(60)) for _ in range(4)]
    samples = {"x": " ".join(stock), "y": "".join(rng.choice("bcd é") for _ in range(300))}
    texts = ["", "a", "ab ba", *("".join(rng.choice([*stock, "b", "dé", " "]) for _ in range(rng.randrange(1, 30))) for _ in range(25))]
    model = langid.Model(list(samples.items()))
    raw = [t.encode() for t in texts]
    langs, score, bits = model.predict(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, t in enumerate(texts):
        s = coded(t)
        cost = [plain_phrases(coded(samples[x]), s) * np.log2(len(coded(samples[x])) + 1) / max(1, len(s)) for x in "xy"]
        if not any(c.isalpha() for c in t):
            assert langs[k] == "und"
        else:
            assert langs[k] == "xy"[int(np.argmin(cost))]
            assert bits[k] == pytest.approx(min(cost))
        assert 0 <= score[k] <= 1


def test_equal_bits_go_to_the_first_language():
    model = langid.Model([("b", "same text"), ("a", "same text")])
    raw = np.frombuffer(b"same text", np.uint8)
    assert model.predict(raw, np.array([0, len(raw)]))[0] == ["a"]


def test_stage_drops_texts_in_no_language(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 6))) for _ in range(40)]
    clean = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 3, 40, 300, 300, 300, 300)]
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (600, 5000)]
    rows = [(k, t, "x" if k > 2 else None, 0, None) for k, t in enumerate(clean)] + [(100 + k, t, None, 0, None) for k, t in enumerate(noise)] + [(200, None, "x", 0, None), (201, "", None, 0, None), (None, clean[3], None, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, bits int, score string")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=str) == sorted([*range(len(clean)), None], key=str)
    assert langid.keep_identified(docs.where("false")).count() == 0
    assert langid.identify(docs.where("false")).count() == 0
