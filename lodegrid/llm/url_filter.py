"""URL filters: a rule list, and logistic regression on hashed character n-grams for what no rule covers.

DataFrame and SQL functions only. The labelled table is small and bounded; what a training step sends to the driver
is one number for each hash bucket. Gradients are added up as whole numbers, so that weights don't depend on the order of
tasks. Scoring is a projection: n-grams, buckets, and a look-up in a literal array.

Where no labelled table is given, URLs that rules cover are one: they carry the rules' verdicts. To tell how well the
regression does on hosts of which it has no label, `held_out` keeps whole hosts from training.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, read

#: host, path, verdict. A rule fits its host and all subdomains, and paths that start with its path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Parts of a unit in which gradients are added up; of this many shares of hosts, one is held out.
UNIT, SHARES = float(1 << 32), 4
#: Hash buckets, lengths of the n-grams, labelled rows used at most, training steps, step size, weight decay.
BUCKETS, LENGTHS, LABELLED, STEPS, RATE, DECAY = 1 << 11, (2, 3, 4), 2000, 40, 0.5, 1e-4


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; null or without ://, both are empty."""
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url, found, n), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def features(host: Column, path: Column, buckets: int = BUCKETS, lengths: tuple[int, ...] = LENGTHS) -> Column:
    """Distinct buckets of the n-grams of host and path, each framed by its limits and hashed with its part's name."""

    def grams(part: str, text: Column, n: int) -> Column:
        framed = F.concat(F.lit("\x02"), text, F.lit("\x03"))
        starts = F.when(F.length(framed) >= n, F.sequence(F.lit(1), F.length(framed) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(part), F.substring(framed, i, F.lit(n))), F.lit(buckets)).cast("int"))

    return F.array_distinct(F.concat(*[grams(k, c, n) for k, c in (("host", host), ("path", path)) for n in lengths]))


def logit(grams: Column, weights: list[float], bias: float) -> Column:
    """Weights of the buckets, divided by the root of their number so that long URLs don't score higher for their length."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one literal
    total = F.aggregate(grams, F.lit(0.0), lambda a, i: a + F.get(table, i))
    return F.lit(float(bias)) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))


def train(labelled: DataFrame, buckets: int = BUCKETS, most: int = LABELLED, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[list[float], float]:
    """Weights and bias from labelled (url, label 0 or 1), by gradient descent with per-bucket step sizes.

    Of a larger table, the `most` rows with the least hashes are used. An empty table gives zero weights.
    """
    host, path = split_url(F.col("url"))
    kept = labelled.where(F.col("label").isNotNull()).orderBy(F.xxhash64("url"), "url", "label").limit(most)
    rows = kept.select(F.col("label").cast("double").alias("label"), features(host, path, buckets).alias("grams")).persist()
    n = rows.count()
    weights, bias, seen, seen_bias = [0.0] * buckets, 0.0, [1e-8] * buckets, 1e-8
    for _ in range(steps if n else 0):
        p = 1 / (1 + F.exp(-logit(F.col("grams"), weights, bias)))
        part = rows.select((p - F.col("label")).alias("e"), "grams")
        size = F.sqrt(F.greatest(F.size("grams"), F.lit(1)).cast("double"))
        by = part.select(F.explode(F.concat("grams", F.array(F.lit(-1)))).alias("i"), (F.col("e") / F.when(F.col("i") < 0, 1.0).otherwise(size)).alias("g"))
        for i, g in by.groupBy("i").agg(F.sum(F.round(F.col("g") * UNIT).cast("long"))).collect():  # one row per bucket at most
            g /= UNIT * n
            if i < 0:
                seen_bias += g * g
                bias -= rate * g / math.sqrt(seen_bias)
            else:
                g += decay * weights[i]
                seen[i] += g * g
                weights[i] -= rate * g / math.sqrt(seen[i])
    rows.unpersist()
    return weights, bias


def judge(pages: DataFrame, weights: list[float], bias: float, rules=RULES) -> DataFrame:
    """pages with host, path, rule, score (chance of allow) and verdict: the rule's, else allow from a score of 0.5 on.

    Columns of pages called like these are replaced; a null or empty url is judged by the bias and its empty frames.
    """
    host, path = split_url(F.col("url"))
    out = pages.drop("host", "path", "rule", "score", "verdict").withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    score = 1 / (1 + F.exp(-logit(features(F.col("host"), F.col("path"), len(weights)), weights, bias)))
    out = out.withColumns({"rule": rule, "score": score})
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= 0.5, "allow").otherwise("block")))


def rule_labels(pages: DataFrame, rules=RULES) -> DataFrame:
    """Labelled URLs without hand work: those that a rule covers carry its verdict."""
    rule, verdict = rule_of(*split_url(F.col("url")), rules)
    return pages.select("url", (verdict == "allow").cast("int").alias("label")).where(F.col("label").isNotNull())


def held_out(labelled: DataFrame, shares: int = SHARES) -> tuple[DataFrame, DataFrame]:
    """labelled in two: rows to learn from, and those of the hosts, one in `shares`, that are kept from it."""
    host, _ = split_url(F.col("url"))
    kept = F.pmod(F.xxhash64(F.lit("host"), host), F.lit(shares)) == 0
    return labelled.where(~kept), labelled.where(kept)


def accuracy(labelled: DataFrame, weights: list[float], bias: float) -> DataFrame:
    """One row: n, n_right, by the regression alone; an empty table has 0 and 0."""
    right = (F.col("score") >= 0.5) == (F.col("label") == 1)
    return judge(labelled, weights, bias, ()).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("n_right"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Judges every URL of pages; the regression learns from a bounded sample of the URLs that rules cover."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, *train(rule_labels(pages))).select("page_id", "host", "path", "rule", "verdict", "score")
