"""URL filter: rules for hosts and paths, and logistic regression on hashed character n-grams where no rule fits.

DataFrame functions only. Features of a url are the distinct buckets of the 3- and 4-grams of its host and, apart from
these, of its path, each with marks at its ends, scaled to length 1. The model is trained by accelerated gradient descent
on a small labelled url table: at most SAMPLE urls of each verdict, the least hash of each of SAMPLE buckets of hashes, so
the choice depends neither on order nor on repeated rows. Each step is one aggregation of that table;
the driver holds BUCKETS weights. Gradients are summed as whole numbers, so a task that runs again changes nothing.

Edge cases: a null url, or one without `://`, has an empty host and path, fits no rule and has no features (the bias alone decides); rows that
repeat are judged each; labels of one verdict only teach that verdict; without any labels all is allowed; very long
urls are cut into characters once, so their cost grows as their length; other columns of the table are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: (host, path, verdict): fits the host and its subdomains where the path starts so; the longest wins.
Rule = tuple[str, str, str]
RULES: list[Rule] = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
GRAMS, BUCKETS = (3, 4), 1 << 13
#: Bound of the labelled sample (urls of each verdict), steps of descent, their length, and the weight of the squared norm.
SAMPLE, STEPS, RATE, DECAY = 1024, 30, 4.0, 1e-4
_UNIT = 1 << 32


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    pattern = r"://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    lower = F.translate(F.regexp_extract(u, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return lower, F.regexp_extract(u, pattern, 2)


def ruled(host: Column, path: Column, rules: list[Rule] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits (of two as long, the one with the longer host); NULL if none does."""

    def one(rule: Rule) -> Column:
        h, p, verdict = rule
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        return F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))

    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    return F.coalesce(*map(one, ordered)) if ordered else F.lit(None).cast("struct<rule:string,verdict:string>")


def _grams(text: Column, part: str) -> list[Column]:
    """Buckets of the n-grams of ^text$."""
    chars = F.concat(F.array(F.lit("^")), F.filter(F.split(text, ""), lambda c: c != ""), F.array(F.lit("$")))

    def of(n: int) -> Column:
        last = F.size(chars) - n
        gram = lambda a, i: F.concat(F.lit(part), *(F.get(a, i + k) for k in range(n)))
        made = F.get(F.transform(F.array(chars), lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.pmod(F.xxhash64(gram(a, i)), F.lit(BUCKETS)).cast("int"))), F.lit(0))
        return F.when(last >= 0, made).otherwise(F.array().cast("array<int>"))

    return [of(n) for n in GRAMS]


def features(host: Column, path: Column) -> Column:
    """Distinct buckets of a url's n-grams; none if both parts are empty."""
    found = F.array_distinct(F.concat(*_grams(host, "h"), *_grams(path, "p")))
    return F.when((host != "") | (path != ""), found).otherwise(F.array().cast("array<int>"))


def _literal(weights: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(weights)), "array<double>")


def _margin(feats: Column, weights: list[float], bias: float) -> Column:
    w = _literal(weights)
    total = F.aggregate(feats, F.lit(0.0), lambda acc, f: acc + F.get(w, f))
    return F.when(F.size(feats) > 0, total / F.sqrt(F.size(feats))).otherwise(F.lit(0.0)) + bias


def probability(feats: Column, model: tuple[list[float], float]) -> Column:
    """How likely the verdict is block."""
    return 1 / (1 + F.exp(-_margin(feats, *model)))


def labelled_sample(urls: DataFrame, size: int = SAMPLE) -> DataFrame:
    """host, path, verdict of at most `size` (or, where hashes are equal, a few more) urls of each verdict."""
    rows = urls.select("host", "path", "verdict", F.xxhash64("host", "path").alias("h"))
    least = rows.groupBy("verdict", F.pmod("h", F.lit(size)).alias("bucket")).agg(F.min("h").alias("h"))
    return rows.join(F.broadcast(least.select("verdict", "h")), ["verdict", "h"], "left_semi").select("host", "path", "verdict").distinct()


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights and bias from a small table of host, path, verdict."""
    made = labelled.select(features(F.col("host"), F.col("path")).alias("f"), (F.col("verdict") == "block").cast("double").alias("y"))
    table = materialize(made.coalesce(1))
    n = table.count()
    w, b = [0.0] * BUCKETS, 0.0
    ahead, ahead_b, t = list(w), b, 1.0
    rows = table.coalesce(1)  # a bounded table: one task, without a shuffle for each step
    for _ in range(STEPS if n else 0):
        err = 1 / (1 + F.exp(-_margin(F.col("f"), ahead, ahead_b))) - F.col("y")
        scaled = F.round(err * _UNIT / F.sqrt(F.greatest(F.size("f"), F.lit(1)))).cast("long")
        step = rows.select("f", scaled.alias("e"), F.round(err * _UNIT).cast("long").alias("eb"))
        step = step.select("e", "eb", F.explode(F.array_append("f", F.lit(-1))).alias("f"))  # bucket -1 is the bias
        grad = {r.f: r.e / _UNIT / n for r in step.groupBy("f").agg(F.sum(F.when(F.col("f") < 0, F.col("eb")).otherwise(F.col("e"))).alias("e")).collect()}
        new = [a - RATE * (grad.get(k, 0.0) + DECAY * a) for k, a in enumerate(ahead)]
        new_b = ahead_b - RATE * grad.get(-1, 0.0)
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        push = (t - 1) / t_next
        ahead, ahead_b = [x + push * (x - y) for x, y in zip(new, w, strict=True)], new_b + push * (new_b - b)
        w, b, t = new, new_b, t_next
    discard(table)
    return [round(x, 9) for x in w], round(b, 9)


def judge(pages: DataFrame, rules: list[Rule] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block of every row.

    labelled: a small table of url and verdict to learn from; else the rows that a rule decides teach the rest.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", ruled(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", "r.verdict")
    if labelled is None:
        known = rows.where("verdict is not null")
    else:
        known = labelled.select(host.alias("host"), path.alias("path"), "verdict")
    model = train(labelled_sample(known))
    out = rows.withColumn("p_block", probability(features(F.col("host"), F.col("path")), model))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("p_block") > 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")
