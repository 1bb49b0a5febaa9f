"""Homomorphic multiset hash of a document's paragraphs, in DataFrame functions only.

Every paragraph (line that is not empty) is hashed to a wide vector, and vectors are summed lane by
lane modulo powers of two: WIDE lanes modulo 2^40 of the whole paragraph (equal multisets of
paragraphs have equal sums; paragraphs can be added and taken away without the rest), and NEAR
lanes modulo 2^21, three to a long, in which the sentences of the paragraph count by one bit of their hash. A lane's
count less half of all is a hashed sign sum, so squared differences of two texts' lanes estimate how many
sentences they do not share (a tug-of-war sketch): likeness = 1 - different / all.

Edge cases: null is the empty text, with the fingerprint of no paragraphs; two of those are alike (1),
one of them and another are not (0); long texts: every lane is summed modulo its power, however many lines and sentences there are; rows that repeat a doc_id follow one another by a hash of the text;
null ids come first; a single row is its own next; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: Lanes of the whole paragraph, and longs with three lanes of sentences each.
WIDE, NEAR = 6, 20
_FIELD = 21
_ONES = 1 | 1 << _FIELD | 1 << 2 * _FIELD
_LANE = (1 << _FIELD) - 1
_WHOLE = (1 << 40) - 1


def _fields(lanes: Column) -> list[Column]:
    """The three lanes of a long."""
    return [F.shiftright(lanes, _FIELD * j).bitwiseAND(_LANE) for j in range(3)]


def _packed(fields: list[Column]) -> Column:
    """Three numbers as the lanes of a long, each modulo 2^21."""
    a, b, c = (F.shiftleft(f.bitwiseAND(_LANE), _FIELD * j) for j, f in enumerate(fields))
    return a.bitwiseOR(b).bitwiseOR(c)


def _text(p: str) -> Column:
    """Fingerprint as text: sentences, wide lanes, near lanes, in hex."""
    part = lambda c, width: F.lower(F.lpad(F.hex(F.col(c)), width, "0"))
    return F.concat(part(f"{p}n", 8), *(part(f"{p}w{i}", 10) for i in range(WIDE)), *(part(f"{p}s{i}", 16) for i in range(NEAR)))


def _likeness(a: str, b: str) -> Column:
    """1 - different / all sentences of the fingerprints with column prefixes a and b, between 0 and 1."""
    total = F.col(f"{a}n") + F.col(f"{b}n")
    lanes = F.array(*(x - y for i in range(NEAR) for x, y in zip(_fields(F.col(f"{a}s{i}")), _fields(F.col(f"{b}s{i}")), strict=True)))
    off = F.col(f"{a}n") - F.col(f"{b}n")
    # lanes are known modulo 2^21, so a difference of signed sums is the one nearest to 0
    signed = lambda d: (F.pmod(2 * d - off + (1 << _FIELD), F.lit(2 << _FIELD)) - (1 << _FIELD)).cast("double")
    square = F.aggregate(F.transform(lanes, lambda d: signed(d) * signed(d)), F.lit(0.0), lambda x, y: x + y)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - square / (3.0 * NEAR * total))))


#: Hex digits of each number in a fingerprint as text.
_DIGITS = [8, *[10] * WIDE, *[16] * NEAR]


def _numbers(fingerprint: Column) -> list[Column]:
    at = [1 + sum(_DIGITS[:k]) for k in range(len(_DIGITS))]
    return [F.conv(F.substring(fingerprint, a, n), 16, 10).cast("decimal(20,0)").cast("long") for a, n in zip(at, _DIGITS, strict=True)]


def _combined(a: Column, b: Column, sign: int) -> Column:
    x, y = _numbers(a), _numbers(b)
    near = [_packed([p + sign * q for p, q in zip(_fields(u), _fields(v), strict=True)]) for u, v in zip(x[1 + WIDE :], y[1 + WIDE :], strict=True)]
    sums = [(x[0] + sign * y[0]).bitwiseAND((1 << 32) - 1), *((u + sign * v).bitwiseAND(_WHOLE) for u, v in zip(x[1 : 1 + WIDE], y[1 : 1 + WIDE], strict=True)), *near]
    return F.concat(*(F.lower(F.lpad(F.hex(x), n, "0")) for x, n in zip(sums, _DIGITS, strict=True)))


def inserted(fingerprint: Column, paragraphs: Column) -> Column:
    """Fingerprint of a text with paragraphs added anywhere, from its own and that of these paragraphs alone."""
    return _combined(fingerprint, paragraphs, 1)


def deleted(fingerprint: Column, paragraphs: Column) -> Column:
    """Fingerprint of a text without paragraphs that it has."""
    return _combined(fingerprint, paragraphs, -1)


def _at_most(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are at most value, by binary search (null: 0)."""
    if not cuts:
        return F.lit(0)
    table = F.array(*(F.lit(c) for c in cuts))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= value, at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """slot, after, place, doc_id, text, next_text: rows in order of doc_id, dealt by ranges of it into slots.

    A slot also gets the rows with the next range's first id (after = 1; for the last range the first one's),
    so each row's successor is beside it. What the driver sees is a few ids for each range.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    cuts = sorted({int(c) for c in ids.where("doc_id is not null").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n)})
    at = _at_most(cuts, F.col("doc_id"))
    heads = {r.part: r.h for r in ids.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(at)).groupBy("part").agg(F.min(F.struct("doc_id")).alias("h")).collect()}
    parts = sorted(heads)
    first = [heads[p].doc_id if p in heads else None for p in range(len(cuts) + 1)]
    before = [parts[parts.index(p) - 1] if p in heads else None for p in range(len(cuts) + 1)]
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(at)
    is_head = F.col("doc_id").eqNullSafe(F.get(F.array(*(F.lit(x).cast("long") for x in first)), F.col("part")))
    copy = F.struct(F.get(F.array(*(F.lit(x).cast("int") for x in before)), F.col("part")).alias("slot"), F.lit(1).alias("after"))
    own = F.struct(F.col("part").alias("slot"), F.lit(0).alias("after"))
    dealt = rows.withColumn("part", part).withColumn("s", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))))
    w = Window.partitionBy("slot").orderBy("after", "doc_id", F.xxhash64("text"))
    return dealt.select("s.slot", "s.after", "doc_id", "text").select("*", F.row_number().over(w).alias("place"), F.lead("text").over(w).alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("slot", "after", "place", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))

    key = ["slot", "place", "after", "doc_id", "n_chars", "edited_sha256"]
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))
    para = rows.select(*key, F.explode(both).alias("x")).select(*key, "x.which", F.posexplode(F.split("x.t", "\n")).alias("line", "p"))
    # the paragraph's own hash stands with its first sentence; empty lines are no paragraphs
    unit = para.select("*", F.posexplode(F.split("p", r"(?<=\.) ")).alias("k", "u"))
    some = F.col("p") != ""
    wide = [F.when(some & (F.col("k") == 0), F.shiftrightunsigned(F.xxhash64(F.lit(i), "p"), 24)).alias(f"w{i}") for i in range(WIDE)]
    # three bits of the sentence's hash to a long; another hash once its bits are used up
    near = [F.when(some, F.shiftrightunsigned(F.xxhash64(F.lit(100 + i // 20), "u"), i % 20).bitwiseAND(_ONES)).alias(f"s{i}") for i in range(NEAR)]
    # at most 2^20 sentences are summed in packed lanes; these sums are taken apart before they are summed again
    chunk = [F.shiftright("line", 10).alias("c1"), F.shiftright("k", 10).alias("c2")]
    unit = unit.select(*key, "which", *chunk, F.when(some, 1).alias("n"), *wide, *near)
    zero = F.lit(0).cast("long")
    parts, sums = [], []
    for which, p in ((0, "a_"), (1, "b_")):
        of = lambda c, which=which: F.coalesce(F.sum(F.when(F.col("which") == which, F.col(c))), zero)
        parts += [of(c).alias(f"{p}{c}") for c in ("n", *(f"w{i}" for i in range(WIDE)), *(f"s{i}" for i in range(NEAR)))]
        sums.append(F.sum(f"{p}n").alias(f"{p}n"))
        sums += [(F.sum(F.col(f"{p}w{i}").bitwiseAND(_WHOLE)).bitwiseAND(_WHOLE)).alias(f"{p}w{i}") for i in range(WIDE)]
        sums += [_packed([F.sum(f) for f in _fields(F.col(f"{p}s{i}"))]).alias(f"{p}s{i}") for i in range(NEAR)]
    made = unit.groupBy(*key, "c1", "c2").agg(*parts).groupBy(*key).agg(*sums)
    w = Window.partitionBy("slot").orderBy("place")
    lanes = ["n", *(f"w{i}" for i in range(WIDE)), *(f"s{i}" for i in range(NEAR))]
    made = made.select("*", *(F.lead(f"a_{c}").over(w).alias(f"c_{c}") for c in lanes)).where("after = 0")
    return made.select("doc_id", "n_chars", "edited_sha256", _text("a_").alias("fingerprint"), _text("b_").alias("edited_fingerprint"), _likeness("a_", "b_").alias("near_edited"), _likeness("a_", "c_").alias("near_next"))
