"""Operators 11 to 13 against brute force, round trips and held-out accuracy."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sylva.llm import divergence, infill, queries, sql, urls

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, form string"


def same_as_sql(spark, name, docs):
    pdf = docs.toPandas()
    con = duckdb.connect()
    con.register("shown", pdf)
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(lang AS VARCHAR) AS lang, CAST(source AS VARCHAR) AS source FROM shown")
    want = con.execute(sql.ORACLE[name]).fetchall()
    names = [c[0] for c in con.description]
    made = divergence.audit(docs) if name.startswith("op11") else infill.digests(infill.fill_in_middle(docs))
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted((tuple(r) for r in made.select(*names).collect()), key=key), sorted((tuple(r) for r in want), key=key)


# ---------------------------------------------------------------- 11


@pytest.mark.parametrize("sources", [2, 5])
def test_divergence_is_that_of_sql(spark, monkeypatch, sources):
    # small blocks: several meet for each pair
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "CELLS", 40)
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + k)}é" for k in range(20)] + ["Once", "x1y"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 30)))), ["en", "de", None][i % 3], f"s{i % 7}", "x") for i in range(300)]
    rows += [(900, None, "en", "s1", "x"), (901, "", "fr", "s1", "x"), (902, "1234", "en", "empty", "x"), (903, "alone", "qq", None, "x"), (5, rows[5][1], *rows[5][2:])]
    got, want = same_as_sql(spark, "op11_source_divergence", spark.createDataFrame(rows, DOCS))
    assert got == want
    assert ("en", "empty", "pair") in {r[:3] for r in got}


def test_divergence_without_rows_or_kept_terms(spark):
    none = spark.createDataFrame([], DOCS)
    assert divergence.audit(none).count() == 0
    few = spark.createDataFrame([(1, "a b", "en", "x", ""), (2, "c", "en", "y", "")], DOCS)
    assert sorted(tuple(r) for r in divergence.audit(few).collect()) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_terms_are_cut_in_slices(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    text = "Straße 12 ÉCOLE-x abcdefghijklmnopqrst Zz\n".encode() * 5
    assert [t for part in divergence.terms(text) for t in part] == re.findall(rb"[a-z\x80-\xff]+", text.lower())


def test_counting_tasks_hold_few_sums(spark, monkeypatch):
    rows = [(i, " ".join(f"t{chr(97 + j % 26)}{chr(97 + i % 26)}" for j in range(30)), "en", f"s{i % 3}", "") for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted(map(tuple, divergence.audit(docs, min_docs=3).collect()))
    monkeypatch.setattr(divergence, "ENTRIES", 10)
    assert sorted(map(tuple, divergence.audit(docs, min_docs=3).collect())) == want


# ---------------------------------------------------------------- 12


def plain_host_path(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_rule(host, path):
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


ODD = [None, "", "no scheme", "HTTP://Example.ORG/es/x", "x://a.example.org/en/12?q#f", "x://example.org/en/2", "x://example.com/fr/1://u.org/", "x://org/", "x://org", "x://borg/", "x://b.com/de/", "x://B.COM/DE/", "http://:80/fr/", "x://é.com/fr/?", "x://a.com?/fr/", "x://example.org/es", "https://u@h.com/fr/\n/x", "x://" + "a." * 3000 + "com/fr/" + "y" * 20000]


def test_rules_are_those_of_a_plain_loop(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "page_id long, url string").withColumn("host", F.lit("clash"))
    for r in urls.judge(rows).collect():
        host, path = plain_host_path(ODD[r.page_id])
        rule = plain_rule(host, path)
        assert (r.host, r.path) == (host, path)
        assert r.rule == (rule and rule[0] + rule[1])
        assert r.verdict == (rule[2] if rule else "block" if r.p_block > 0.5 else "allow")


def test_longest_rule_wins_in_any_order(spark):
    rules = [("com", "/", "allow"), ("a.com", "/", "block"), ("com", "/xyz", "allow"), ("a.com", "/x", "block")]
    df = spark.createDataFrame([("b.a.com", "/xyz"), ("b.com", "/q"), ("a.com", "/q"), ("com", "/xy")], "host string, path string")
    for given in (rules, rules[::-1]):
        got = [r[0] for r in df.select(urls.ruled(F.col("host"), F.col("path"), given)["rule"]).collect()]
        assert got == ["a.com/x", "com/", "a.com/", "com/"]


def test_probability_is_that_of_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    weights, bias = [float(x) for x in rng.normal(size=urls.BUCKETS)], -0.25
    cases = [("a.example.com", "/de/12"), ("é", ""), ("", ""), ("", "/"), ("aaaa", "/aaaa")]
    df = spark.createDataFrame(cases, "host string, path string")
    got = [r[0] for r in df.select(urls.probability(urls.features(F.col("host"), F.col("path")), (weights, bias))).collect()]

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    for (host, path), p in zip(cases, got, strict=True):
        found = {signed(xxhash.xxh64((part + g[k : k + n]).encode(), seed=42).intdigest()) % urls.BUCKETS for part, g in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in urls.GRAMS for k in range(len(g) - n + 1)} if host or path else set()
        total = sum(weights[k] for k in found) / math.sqrt(len(found)) if found else 0.0
        assert p == pytest.approx(1 / (1 + math.exp(-total - bias)))


def test_learned_verdicts_hold_on_urls_left_out(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    host, path = urls.parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("verdict", urls.ruled(F.col("host"), F.col("path"))["verdict"]).where("verdict is not null")
    out = F.crc32(F.col("page_id").cast("string").cast("binary")) % 5 == 0
    model = urls.train(urls.labelled_sample(rows.where(~out)))
    guess = F.when(urls.probability(urls.features(F.col("host"), F.col("path")), model) > 0.5, "block").otherwise("allow")
    right = [r[0] for r in rows.where(out).select(guess == F.col("verdict")).collect()]
    assert len(right) > 150 and sum(right) / len(right) > 0.93


def test_training_does_not_depend_on_order_or_repeats(spark):
    rows = [(f"{'spam' if k % 2 else 'news'}{k}.example", f"/{k}", "block" if k % 2 else "allow") for k in range(40)]
    one = spark.createDataFrame(rows, "host string, path string, verdict string")
    two = spark.createDataFrame(rows[::-1] + rows[:7], "host string, path string, verdict string").repartition(5)
    assert urls.train(urls.labelled_sample(one)) == urls.train(urls.labelled_sample(two))
    assert urls.labelled_sample(one, size=4).count() <= 8


def test_labels_of_ones_own_teach(spark):
    labelled = spark.createDataFrame([(f"x://{w}{k}.net/p", v) for k in range(30) for w, v in (("casino", "block"), ("school", "allow"))], "url string, verdict string")
    pages = spark.createDataFrame([(1, "x://bestcasino.net/p"), (2, "x://ourschool.net/p"), (3, "x://casino.org/p")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, labelled=labelled).collect()} == {1: (None, "block"), 2: (None, "allow"), 3: ("org/", "allow")}
    assert urls.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(pages.where("page_id < 3")).collect()} == {"allow"}  # nothing to learn from


def test_no_python_in_the_plan(spark):
    plan = queries.op12_url_filter(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- 13

TEXTS = [None, "", "\n", "\n\n\na", "a\n", "one\ntwo\nthree", "é\nß\n\nx", "has <P> in it", "<\n<S\nP>\n>", "\r\n\r\n", "a" * 100, "x\ny\n" * 5000, "  lead and  two ", "né 日本 𝄞x\n"]


def test_fill_in_middle_is_that_of_sql(spark):
    docs = spark.createDataFrame([(k * 7 + j, t, "en", "s", "clash") for k, t in enumerate(TEXTS) for j in range(6)], DOCS)
    got, want = same_as_sql(spark, "op13_fill_in_middle", docs.unionByName(docs.limit(2)))
    assert got == want


PATTERN = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "char": r"(?s)."}


@pytest.mark.parametrize("unit", ["line", "word", "char"])
@pytest.mark.parametrize("size", [1, 3, 1 << 20])
def test_every_cut_is_where_a_plain_split_has_it(monkeypatch, unit, size):
    monkeypatch.setattr(infill, "SLICE", size)
    for text in TEXTS[1:]:
        text = text[:300]
        units = re.findall(PATTERN[unit], text)
        runs = infill.Runs(np.frombuffer(text.encode(), np.uint8), unit)
        assert runs.units == len(units)
        assert [runs.offset(k) for k in range(len(units) + 1)] == [len("".join(units[:k]).encode()) for k in range(len(units) + 1)]


def test_rates_units_and_marks(spark):
    docs = spark.createDataFrame([(k, f"a{k} b c\nd e f\n", k) for k in range(200)], "doc_id long, text string, n int")
    made = infill.fill_in_middle(docs, unit="word", rate=30, spm=100, seed=3, sentinels=("[pre]", "[suf]", "[mid]")).collect()
    assert {r.form for r in made} == {"plain", "spm"} and 30 <= sum(r.form == "spm" for r in made) <= 90
    back = infill.restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]"))
    again = infill.fill_in_middle(docs, unit="word", rate=30, spm=100, seed=3, sentinels=("[pre]", "[suf]", "[mid]")).withColumn("back", back).join(docs.select("doc_id", "text"), "doc_id")
    assert again.where("back = text").count() == 200
    for r in made:
        h = hashlib.sha256(f"3:{r.doc_id}".encode()).hexdigest()
        assert (int(h[16:24], 16) % 100 < 30) == (r.form == "spm")
    with pytest.raises(ValueError, match="sentinels"):
        infill.fill_in_middle(docs, sentinels=("<P>", "<P>>", "<M>"))
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_null_ids_and_long_texts(spark):
    docs = spark.createDataFrame([(None, "a\nb\nc"), (4, "line \n" * 400_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in infill.fill_in_middle(docs).withColumn("back", F.length(infill.restored(F.col("output"), F.col("form")))).collect()}
    assert got[None].n == 3 and got[4].n == 400_000 and got[4].back == 2_400_000
