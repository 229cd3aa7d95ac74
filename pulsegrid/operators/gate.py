"""Thresholds fitted on gold items, acceptance, and cost-aware verification.

scores: (item, score, correct BOOLEAN[, is_gold]). Thresholds come as one-row frames and are used as
scalar subqueries, so that fit and use stay one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.ranking import quantile, running_sums


def conformal_threshold(scores: DataFrame, alpha: float = 0.05, least_errors: int = 10) -> DataFrame:
    """(tau): the (1 - alpha) quantile of the scores of errors; 1 with fewer than least_errors errors."""
    wrong = scores.where(~F.col("correct"))
    if wrong.count() < least_errors:
        return scores.sparkSession.range(1).select(F.lit(1.0).alias("tau"))
    return quantile(wrong, "score", 1 - alpha).select(F.coalesce("quantile", F.lit(1.0)).alias("tau"))


def bernstein_scan(scores: DataFrame, delta: float = 0.05) -> DataFrame:
    """(score, k, err, bound) per distinct score, descending: the items at or above it, their error share and its empirical
    Bernstein bound. Running sums go over distinct scores, by ranges of them."""
    levels = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("correct"), 1).otherwise(0)).alias("e"))
    run = running_sums(levels, [F.desc("score")], {"n": "k", "e": "bad"}).select("score", "k", "bad").withColumn("err", F.col("bad") / F.col("k"))
    k, p = F.col("k"), F.col("err")
    variance = F.when(k > 1, k / (k - 1) * p * (1 - p)).otherwise(0.0)
    log_term = F.lit(-1.0) * F.log(F.lit(delta))
    return run.withColumn("bound", p + F.sqrt(2 * variance * log_term / k) + 7 * log_term / (3 * F.greatest(k - 1, F.lit(1))))


def bernstein_threshold(scores: DataFrame, alpha: float = 0.05, delta: float = 0.05, least: int = 10, scan: str = "prefix") -> DataFrame:
    """(tau): the lowest score of the passing run from the top (scan='prefix') or the lowest passing score ('global')."""
    rows = bernstein_scan(scores, delta).where(F.col("k") >= least).withColumn("ok", F.col("bound") <= alpha)
    if scan == "prefix":
        failing = rows.agg(F.max(F.when(~F.col("ok"), F.col("score")))).first()[0]
        rows = rows if failing is None else rows.withColumn("ok", F.col("ok") & (F.col("score") > failing))
    return rows.agg(F.coalesce(F.min(F.when(F.col("ok"), F.col("score"))), F.lit(1.0)).alias("tau"))


def conformal_quantile(gold: DataFrame, confidence: str = "confidence", alpha: float = 0.05) -> DataFrame:
    """(q): the (1 - alpha) quantile of 1 - confidence over gold items."""
    return quantile(gold.select((1 - F.col(confidence)).alias("__r")), "__r", 1 - alpha, "q")


#: The confidence grid, from high to low.
GRID = tuple(round(0.95 - 0.01 * i, 2) for i in range(46))


def confidence_threshold(gold: DataFrame, confidence: str = "confidence", alpha: float = 0.05, fallback: float = 0.95) -> DataFrame:
    """(tau): the highest grid value with accepted gold items and an error share of at most alpha among them.

    All grid values are aggregates of one pass over gold."""
    c, wrong = F.col(confidence), F.when(F.col("correct"), 0.0).otherwise(1.0)
    one = gold.agg(*[F.avg(F.when(c >= g, wrong)).alias(f"g{i}") for i, g in enumerate(GRID)])
    return one.select(F.coalesce(*[F.when(F.col(f"g{i}") <= alpha, F.lit(g)) for i, g in enumerate(GRID)], F.lit(fallback)).alias("tau"))


def accept(scores: DataFrame, tau: DataFrame, score: str = "score") -> DataFrame:
    """scores with accept = (score >= tau); tau is one row."""
    return scores.withColumn("accept", F.coalesce(F.col(score) >= tau.select("tau").scalar(), F.lit(False)))


def verification_set(scores: DataFrame, item: str = "item", score: str = "score", cost: str = "token_cost", budget: float = 0.18) -> DataFrame:
    """(item, value): the budgeted share of items with the greatest (1 - score) / max(cost, 1), ties by item."""
    from pulsegrid.operators.votes import top_by_value

    return top_by_value(scores.withColumn("value", (1 - F.col(score)) / F.greatest(F.col(cost), F.lit(1.0))), item, "value", budget)
