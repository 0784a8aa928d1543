"""Corpus reports that can be kept and merged: exact counts, and sketches of distinct texts, documents and confidences.

A report is a few small rows for each run. Reports of any runs, in any order, add up to that of all of them together, and reports of two
versions of a detector tell what only one of them found, without the matches being kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of the entries of a sketch of distinct values: a share of 2^-7 (0.8 %) of them is the standard error, 2.4 % holds for all but one
#: in 400. And the size of a sketch of quantiles: ranks are right to 1.65 % for all but one in 100.
ENTRIES, RANKS = 14, 200
DISTINCT_ERROR, RANK_ERROR = 0.024, 0.0165


def report(matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, texts, documents, confidences) of matches (doc_id, text, confidence and by, which is category if not given): n is exact, the others are
    sketches. Texts count once whatever their case; nulls count in n alone. No matches give no rows."""
    by = by or ["category"]
    return matches.groupBy(*by).agg(F.count("*").alias("n"), F.theta_sketch_agg(F.lower("text"), ENTRIES).alias("texts"), F.theta_sketch_agg(F.col("doc_id").cast("string"), ENTRIES).alias("documents"),
                                    F.kll_sketch_agg_double(F.col("confidence").cast("double"), RANKS).alias("confidences"))


def merge(reports: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Reports of several runs as one."""
    by = by or ["category"]
    return reports.groupBy(*by).agg(F.sum("n").alias("n"), F.theta_union_agg("texts", ENTRIES).alias("texts"), F.theta_union_agg("documents", ENTRIES).alias("documents"), F.kll_merge_agg_double("confidences", RANKS).alias("confidences"))


def read(reports: DataFrame, by: list[str] | None = None, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """What reports say: (by, n, n_texts, n_documents, q10, q50, q90) with the errors named above."""
    by = by or ["category"]
    some = F.kll_sketch_get_n_double("confidences") > 0
    at: list[Column] = [F.when(some, F.kll_sketch_get_quantile_double("confidences", F.lit(q))).alias(f"q{round(q * 100)}") for q in quantiles]
    return reports.select(*by, "n", F.theta_sketch_estimate("texts").alias("n_texts"), F.theta_sketch_estimate("documents").alias("n_documents"), *at)


def compare(before: DataFrame, after: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Two reports side by side: (by, n_before, n_after, lost, won), the last two being how many distinct texts only one of them holds. Groups that one
    report lacks count as empty."""
    by = by or ["category"]
    a = before.select(*by, F.col("n").alias("n_before"), F.col("texts").alias("_a"))
    b = after.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("n").alias("n_after"), F.col("texts").alias("_b"))
    both = a.join(b, [a[c].eqNullSafe(b[f"_{c}"]) for c in by], "full")
    only = lambda x, y: F.when(F.col(x).isNull(), 0).when(F.col(y).isNull(), F.theta_sketch_estimate(x)).otherwise(F.theta_sketch_estimate(F.theta_difference(x, y)))
    keys = [F.when(F.col("n_before").isNotNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in by]
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select(*keys, zero("n_before"), zero("n_after"), only("_a", "_b").cast("long").alias("lost"), only("_b", "_a").cast("long").alias("won"))
