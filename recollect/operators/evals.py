"""Retrieval and extraction metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import f1, fuzzy_contains


def first_hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """``(question_id, first_rank)``, null without a hit, from ``results(question_id, rank, name)`` and ``expected(question_id, wanted)``; a hit holds a wanted text in any case."""
    met = results.join(expected, "question_id").where(F.lower("name").contains(F.lower("wanted")))
    best = met.groupBy("question_id").agg(F.min("rank").alias("first_rank"))
    return expected.select("question_id").distinct().join(best, "question_id", "left")


def hit_rate_and_mrr(first: DataFrame, *by: str) -> DataFrame:
    """Share of questions with a hit and mean reciprocal rank, per group."""
    hit = F.col("first_rank").isNotNull()
    return first.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"), F.avg(hit.cast("double")).alias("hit_rate"), F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr")
    )


def precision_at(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``(question_id, precision)``: share of the first ``k`` results that are relevant."""
    met = results.where(F.col("rank") <= k).join(relevant.select("question_id", "item", F.lit(1).alias("hit")), ["question_id", "item"], "left")
    return met.groupBy("question_id").agg((F.count("hit") / k).alias("precision"))


def match_scores(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Micro precision, recall and F1 of exact matches on ``keys``, in one row."""
    both = found.select(*keys).distinct().withColumn("f", F.lit(1)).join(truth.select(*keys).distinct().withColumn("t", F.lit(1)), keys, "full")
    sums = both.agg(F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"), F.count("f").alias("found"), F.count("t").alias("truth"))
    p = F.coalesce(F.try_divide("tp", "found"), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", "truth"), F.lit(0.0))
    return sums.select("tp", "found", "truth", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def fuzzy_found(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``(doc, wanted, hit)``: whether a document's truth is in one of its finds or the other way round; documents are joined, not all rows."""
    met = truth.join(found, "doc", "left").withColumn("hit", F.coalesce(fuzzy_contains(F.col("name"), F.col("wanted")), F.lit(False)))
    return met.groupBy("doc", "wanted").agg(F.max("hit").alias("hit"))


def haystack(sessions: DataFrame, gold: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` sessions: gold ones first, then others in the order of a seeded hash."""
    marked = sessions.join(gold.select("session_id", F.lit(1).alias("g")), "session_id", "left")
    return marked.orderBy(F.desc(F.coalesce("g", F.lit(0))), F.xxhash64("session_id", F.lit(seed)), "session_id").limit(n).drop("g")
