"""Quality rules with risk-controlled thresholds, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import durable, packed

#: Fixed grids of cutoffs. A document is rejected where a feature exceeds its stratum's cutoff.
GRIDS = {
    "symbols": (0.05, 0.1, 0.2, 0.3, 0.5, 1.0),
    "dup_lines": (0.05, 0.1, 0.2, 0.3, 0.5),
    "repeats": (0.05, 0.1, 0.2, 0.3, 0.4),
    "shouting": (0.1, 0.2, 0.3, 0.5, 0.8),
    "word_length": (8.0, 9.0, 10.0, 12.0, 16.0),
}
#: Most false rejections among good documents of a stratum, how sure that must be, and terms summed one by one.
RISK, CONFIDENCE, TERMS = 0.05, 0.95, 400
MIN_WORDS, MAX_REPEATED = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def repeated(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more; each word counts once.

    Windows are hashed. Where hashes repeat, (hash, place) pairs are sorted, places with an equal neighbour are
    taken in order, and each adds its words that lie beyond the one before.
    """
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def places(s: Column) -> Column:
        twice = F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]))
        return F.sort_array(F.filter(twice, lambda x: x.isNotNull()))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end"))
        return F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i + 3 - a["end"])).alias("n"), (i + 3).alias("end")), lambda a: a["n"])

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(pairs, lambda s: covered(places(s))))

    return bound(windows, count).cast("long")


def measured(text: Column) -> Column:
    """A struct of counts of a whole text; null has no words and no lines."""
    whole = F.coalesce(text, F.lit(""))

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(whole, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.regexp_count(whole, F.lit(r"[!?]")).cast("long").alias("n_marks"),
            bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            repeated(words).alias("n_repeat_words"),
        )

    return bound(F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), ""), counts)


def with_features(rows: DataFrame) -> DataFrame:
    """Spread ``_m`` into counts and add base_failed, _stratum and the features of GRIDS."""
    m = lambda c: F.col(f"_m.{c}")
    share = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    n, rep = m("n_words"), m("n_repeat_words")
    return rows.select(
        *(c for c in rows.columns if c not in ("_m", "_lang")),
        *(m(c).alias(c) for c in ("n_words", "word_chars", "n_symbols")),
        m("lines.dup").alias("n_dup_lines"),
        rep.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * rep > MAX_REPEATED * n)).alias("base_failed"),
        F.when(F.rlike("_lang", F.lit("^[a-z]{2}$")), F.col("_lang")).otherwise("other").alias("_stratum"),
        share(m("n_symbols"), n).alias("symbols"),
        share(m("lines.dup"), m("lines.all")).alias("dup_lines"),
        share(rep, n).alias("repeats"),
        share(m("n_marks"), n).alias("shouting"),
        share(m("word_chars"), n).alias("word_length"),
    )


def log_factorial(n: Column) -> Column:
    x = n.cast("double") + 1
    stirling = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(stirling)


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for a binomial X of n draws with chance p, for k below n * p; 1 beyond.

    The largest terms are summed one by one from k down; what is left is bounded by a geometric series, so the
    value is never too small.
    """
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    step = lambda i: i / (n - i + 1) * ((1 - p) / p)
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))
    fall = lambda a, i: bound(a["term"] * step((k - i).cast("double")), lambda t: F.struct((a["sum"] + t).alias("sum"), t.alias("term")))
    upto = F.sequence(F.lit(0), F.least(k, F.lit(TERMS)).cast("int"))
    rest = step(F.greatest(k - TERMS, F.lit(0)).cast("double"))
    total = bound(F.aggregate(upto, start, fall), lambda a: a["sum"] + F.when(rest < 1, a["term"] * rest / (1 - rest)).otherwise(F.lit(float("inf"))))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def cutoffs(labelled: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """For each stratum the strictest cutoff of each feature that may be used; null where none may.

    ``labelled``: features, _stratum and quality of the labelled holdout; the grids are fixed beforehand, so
    every labelled row is a holdout. Of a stratum's n good documents, a cutoff rejects k. It may be used if the
    exact binomial (Clopper-Pearson) upper bound of its false rejections is ``risk`` over the number of features
    at most, at a level divided by the number of all tests made (Bonferroni). Then, with the given confidence,
    all strata at once reject no more than ``risk`` of their good documents. Strata are two-letter codes or
    "other": 677 at most.
    """
    good = labelled.where("quality = 1")
    tests = [(f, c) for f, grid in GRIDS.items() for c in grid]
    counts = good.groupBy("_stratum").agg(F.count("*").alias("n"), *(F.count_if(F.col(f) > c).alias(f"_{i}") for i, (f, c) in enumerate(tests)))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(c).alias("cut"), F.col(f"_{i}").alias("k")) for i, (f, c) in enumerate(tests))))
    rows = counts.withColumn("_strata", F.count("*").over(W.partitionBy())).select("_stratum", "n", "_strata", each.alias("t")).select("_stratum", "n", "_strata", "t.*")
    sure = at_most(F.col("k"), F.col("n"), risk / len(GRIDS)) <= (1 - confidence) / (len(tests) * F.col("_strata"))
    return rows.where(sure).groupBy("_stratum").agg(*(F.min(F.when(F.col("feature") == f, F.col("cut"))).alias(f"cut_{f}") for f in GRIDS))


def judged(rows: DataFrame, labels: DataFrame, risk: float, confidence: float) -> DataFrame:
    """``rows``: durable, with _id and what with_features() gives; adds kept."""
    marks = labels.select(F.col("doc_id").alias("_labelled"), "quality")
    found = rows.select("_id", "_stratum", *GRIDS).join(marks, F.col("_id") == F.col("_labelled"))
    cuts = durable(cutoffs(found, risk, confidence)).withColumnRenamed("_stratum", "_cut_for")
    out = rows.join(F.broadcast(cuts), F.col("_stratum") == F.col("_cut_for"), "left")  # 677 rows at most
    above = [F.coalesce(F.col(f) > F.col(f"cut_{f}"), F.lit(False)) for f in GRIDS]
    rejected = above[0]
    for x in above[1:]:
        rejected = rejected | x
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected)


def assess(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, the counts, base_failed, kept, features and cutoffs of every document (doc_id, lang, text).

    ``labels``: doc_id, quality (1 good). A null text has no words and fails; a null or odd lang is the stratum
    "other"; a null doc_id has no label; repeated rows are judged alike. A stratum with too few labels rejects by
    the base rules alone. Without documents there are no rows; without labels only the base rules hold. Other
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), measured(F.col("text")).alias("_m"))
    out = judged(durable(with_features(rows)), labels, risk, confidence)
    return out.select(F.col("_id").alias("doc_id"), *COUNTS, "base_failed", "kept", *GRIDS, *(f"cut_{f}" for f in GRIDS))


def keep(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """The documents kept, with all their columns.

    Null texts go, as they have no words; a null doc_id or an odd lang is no reason to go; repeated rows stay or go
    together; no documents give no rows; columns may have any names. Without labels only the base rules hold.
    """
    rows = packed(docs, _id=F.col("doc_id"), _lang=F.col("lang"), _m=measured(F.col("text")))
    return judged(durable(with_features(rows)), labels, risk, confidence).where("kept").select("_row.*")
