"""The fingerprint is a sum over paragraphs: insertion, deletion, order and the sums themselves."""

import random

from pyspark.sql import functions as F

from sylva.llm import fingerprint as fp

SCHEMA = "doc_id long, text string, slot int, after string, place int"


def prints(spark, texts):
    got = fp.fingerprints(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(texts)], SCHEMA)).collect()
    return {r.doc_id: r for r in got}


def paragraphs(rng, n):
    return [" ".join(f"{rng.choice('abcd')}{rng.randrange(9)}" + rng.choice(("", ".", "")) for _ in range(rng.randrange(1, 12))) for _ in range(n)]


def test_paragraphs_come_and_go(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(12):
        base, more = paragraphs(rng, rng.randrange(0, 7)), paragraphs(rng, rng.randrange(1, 4))
        both = [*base, *more]
        rng.shuffle(both)
        texts += ["\n".join(base), "\n".join(more), "\n".join(both)]
    got = prints(spark, texts)
    rows = [(got[k].fingerprint, got[k + 1].fingerprint, got[k + 2].fingerprint) for k in range(0, len(texts), 3)]
    df = spark.createDataFrame(rows, "a string, b string, ab string")
    made = df.select(fp.inserted(F.col("a"), F.col("b")).alias("i"), fp.deleted(F.col("ab"), F.col("b")).alias("d"), "a", "ab").collect()
    assert all(r.i == r.ab and r.d == r.a for r in made)


def test_sums_are_those_of_the_paragraphs_alone(spark):
    rng = random.Random(2)
    parts = paragraphs(rng, 9)
    got = prints(spark, [*parts, "\n".join(parts)])
    wide = lambda r: [int(r.fingerprint[8 + 10 * k : 18 + 10 * k], 16) for k in range(fp.WIDE)]
    near = lambda r: [int(r.fingerprint[8 + 10 * fp.WIDE + 16 * k : 24 + 10 * fp.WIDE + 16 * k], 16) for k in range(fp.NEAR)]
    assert wide(got[9]) == [sum(x) % (1 << 40) for x in zip(*(wide(got[k]) for k in range(9)), strict=True)]
    assert near(got[9]) == [sum(x) for x in zip(*(near(got[k]) for k in range(9)), strict=True)]


def test_likeness_follows_shared_sentences(spark):
    rng = random.Random(3)
    base = [f"{' '.join(f'w{rng.randrange(10**6)}' for _ in range(6))}." for _ in range(400)]
    texts = []
    for share in (0.0, 0.5, 0.9):
        texts += [" ".join(base), " ".join([*base[: int(400 * share)], *(f"x{share}{k}." for k in range(400 - int(400 * share)))])]
    got = prints(spark, texts)
    for k, share in enumerate((0.0, 0.5, 0.9)):
        assert abs(got[2 * k].near_next - share) < 0.3


def test_long_text(spark):
    text = " ".join(f"w{i}." for i in range(40_000))
    assert prints(spark, [text])[0].n_chars == len(text)


def _lanes(fingerprint):
    near = [int(fingerprint[8 + 10 * fp.WIDE + 16 * k : 24 + 10 * fp.WIDE + 16 * k], 16) for k in range(fp.NEAR)]
    return [x >> 21 * j & (1 << 21) - 1 for x in near for j in range(3)]


def test_millions_of_lines_and_of_sentences(spark):
    """Lanes wrap modulo their powers: one line's numbers times so many."""
    n = 5_000_000
    docs = spark.range(4).selectExpr("id AS doc_id", f"CASE id WHEN 0 THEN 'a' WHEN 1 THEN repeat('a\n', {n}) WHEN 2 THEN 'Yes. ' ELSE repeat('Yes. ', {n}) END AS text")
    got = {r.doc_id: r for r in fp.fingerprints(docs).collect()}
    one, many = got[0].fingerprint, got[1].fingerprint
    assert int(many[:8], 16) == n
    assert _lanes(many) == [x * n % (1 << 21) for x in _lanes(one)]
    assert [int(many[8 + 10 * k : 18 + 10 * k], 16) for k in range(fp.WIDE)] == [int(one[8 + 10 * k : 18 + 10 * k], 16) * n % (1 << 40) for k in range(fp.WIDE)]
    assert int(got[3].fingerprint[:8], 16) == n + 1
    few = _lanes(got[2].fingerprint)  # "Yes." and the empty rest
    assert all((x - y) % (1 << 21) in (0, (n - 1) % (1 << 21)) for x, y in zip(_lanes(got[3].fingerprint), few, strict=True))
    assert 0 <= got[1].near_edited <= 1 and 0 <= got[3].near_next <= 1


def test_insertion_wraps_lane_by_lane(spark):
    digits = lambda n, w, s: f"{n:08x}" + f"{w:010x}" * fp.WIDE + f"{s:016x}" * fp.NEAR
    top = (1 << 21) - 1
    full = top | top << 21 | top << 42
    df = spark.createDataFrame([(digits(7, (1 << 40) - 1, full), digits(2, 3, 1 | 2 << 21 | 3 << 42))], "a string, b string")
    made = df.select(fp.inserted(F.col("a"), F.col("b")).alias("ab"), fp.deleted(fp.inserted(F.col("a"), F.col("b")), F.col("b")).alias("back"), "a").first()
    assert made.ab == digits(9, 2, 0 | 1 << 21 | 2 << 42)
    assert made.back == made.a
