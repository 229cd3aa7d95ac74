"""Votes of several views per item: counts, plurality, entropy, agreement, and the six disagreement features.

Input is long: (item, view_idx, label, confidence). An item has as many rows as views, so groups are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.ranking import first_rows


def vote_counts(votes: DataFrame, item: str = "item") -> DataFrame:
    """(item, label, n, share) per label that got a vote.

    Rows meet by item once; counting by (item, label) and adding up by item both keep that partitioning."""
    counts = votes.select(item, "label").repartition(item).groupBy(item, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(item)))


def majority(votes: DataFrame, item: str = "item") -> DataFrame:
    """(item, pred, share): the commonest label, the smallest of several, and its share."""
    counts = vote_counts(votes, item)
    return counts.groupBy(item).agg(F.max_by(F.struct("label", "share"), F.struct("n", -F.col("label"))).alias("t")).select(item, F.col("t.label").alias("pred"), F.col("t.share").alias("share"))


def _entropy(share: Column) -> Column:
    return -F.sum(share * F.log(share + F.lit(1e-9)))


def disagreement(votes: DataFrame, item: str = "item") -> DataFrame:
    """(item, pred, plurality, entropy, conf_mean, conf_std, unanimous, aligned).

    unanimous: all labels equal; aligned: the median label is that of the first view. One aggregation by item: the labels of
    an item (as many as views) are counted inside their array."""
    per_item = votes.groupBy(item).agg(
        F.collect_list("label").alias("__l"),
        F.avg("confidence").alias("conf_mean"),
        F.stddev_pop("confidence").alias("conf_std"),
        (F.min("label") == F.max("label")).cast("int").alias("unanimous"),
        (F.percentile("label", F.lit(0.5)) == F.min_by("label", "view_idx")).cast("int").alias("aligned"),
    )
    counts = F.transform(F.array_distinct("__l"), lambda k: F.struct(F.size(F.filter("__l", lambda x: x == k)).alias("n"), (-k).alias("l")))
    counted = per_item.withColumn("__c", counts).withColumn("__m", F.size("__l"))
    top = F.array_max("__c")
    entropy = F.aggregate("__c", F.lit(0.0), lambda a, c: a - c["n"] / F.col("__m") * F.log(c["n"] / F.col("__m") + F.lit(1e-9)))
    return counted.select(item, (-top["l"]).alias("pred"), (top["n"] / F.col("__m")).alias("plurality"), entropy.alias("entropy"), "conf_mean", "conf_std", "unanimous", "aligned")


def vote_entropy(votes: DataFrame, item: str = "item") -> DataFrame:
    """(item, plurality, entropy)."""
    return vote_counts(votes, item).groupBy(item).agg(F.max("share").alias("plurality"), _entropy(F.col("share")).alias("entropy"))


def confidence_stats(votes: DataFrame, item: str = "item") -> DataFrame:
    return votes.groupBy(item).agg(F.avg("confidence").alias("conf_mean"), F.stddev_pop("confidence").alias("conf_std"))


def top_by_value(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """The share of rows (at least one, none of an empty table) with the greatest value, ties by key: (key, value)."""
    n = rows.count()
    return first_rows(rows.select(key, value), [F.desc(value), F.col(key)], max(1, int(share * n)) if n else 0)


def refresh_set(votes_entropy: DataFrame, item: str = "item", share: float = 0.20) -> DataFrame:
    return top_by_value(votes_entropy, item, "entropy", share)


def override(base: DataFrame, fresh: DataFrame, item: str = "item") -> DataFrame:
    """base (item, pred, confidence) with the rows of fresh instead where it has any."""
    f = fresh.select(item, F.col("pred").alias("__p"), F.col("confidence").alias("__c"))
    return base.join(f, item, "left").select(item, F.coalesce("__p", "pred").alias("pred"), F.when(F.col("__p").isNotNull(), F.col("__c")).otherwise(F.col("confidence")).alias("confidence"))
