"""Window statistics as SQL aggregates: one shuffle on the window's key serves all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_neighbours(df: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """Add d1, d2 (first and second difference), prev and next within each window."""
    w = Window.partitionBy(*keys).orderBy(pos)
    v = F.col(value)
    prev, next_, prev2 = F.lag(v).over(w), F.lead(v).over(w), F.lag(v, 2).over(w)
    return df.withColumns({"prev": prev, "next": next_, "d1": v - prev, "d2": v - 2 * prev + prev2})


def moments(value: Column) -> list[Column]:
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]


def quartiles(value: Column) -> list[Column]:
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [p[0].alias("p25"), p[1].alias("p50"), p[2].alias("p75")]


def trend(value: Column, pos: Column) -> list[Column]:
    """Least-squares slope on the position, and R^2 with a guard for constant series."""
    slope = F.regr_slope(value, pos)
    sse = F.regr_syy(value, pos) - slope * F.regr_sxy(value, pos)
    return [slope.alias("slope"), (1 - sse / (F.regr_syy(value, pos) + F.lit(1e-9))).alias("r2")]


def mean_abs_diff(d1: Column) -> Column:
    return F.avg(F.abs(d1)).alias("mean_abs_diff")


def peak_count(value: Column, prev: Column, next_: Column) -> Column:
    """Strict rise, then strict fall."""
    return F.sum(F.when((value > prev) & (value > next_), 1).otherwise(0)).cast("bigint").alias("peaks")


def window_stats(df: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """All statistics of a window in one aggregation."""
    v = F.col(value)
    return with_neighbours(df, keys, pos, value).groupBy(*keys).agg(*moments(v), *quartiles(v), *trend(v, F.col(pos)), mean_abs_diff(F.col("d1")), peak_count(v, F.col("prev"), F.col("next")))


def quality(df: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """artifact (mean absolute second difference), flatline share (near the median), saturation share (at the 1st or 99th
    percentile or beyond); all 0 for windows that do not vary."""
    w = Window.partitionBy(*keys)
    p = F.percentile(F.col(value), F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).over(w)
    rich = with_neighbours(df, keys, pos, value).withColumn("__p", p).withColumn("__std", F.stddev_pop(value).over(w))
    v = F.col(value)
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    alive = F.max("__std") >= 1e-6
    return rich.groupBy(*keys).agg(
        F.when(alive, F.avg(F.abs("d2"))).otherwise(0.0).alias("artifact"),
        F.when(alive, share(F.abs(v - F.col("__p")[1]) < 0.05 * F.col("__std"))).otherwise(0.0).alias("flatline"),
        F.when(alive, share((v <= F.col("__p")[0]) | (v >= F.col("__p")[2]))).otherwise(0.0).alias("saturation"),
    )


def block_shift(df: DataFrame, keys: Sequence[str], pos: str, value: str, block: int) -> DataFrame:
    """score at each position with a full block on both sides: |difference of means| + |difference of deviations|."""
    w = Window.partitionBy(*keys).orderBy(pos)
    left, right = w.rowsBetween(-block, -1), w.rowsBetween(0, block - 1)
    score = F.abs(F.avg(value).over(right) - F.avg(value).over(left)) + F.abs(F.stddev_pop(value).over(right) - F.stddev_pop(value).over(left))
    full = (F.count(value).over(left) == block) & (F.count(value).over(right) == block)
    return df.withColumn("score", F.when(full, score)).where("score is not null")


def peak_intervals(df: DataFrame, keys: Sequence[str], pos: str, value: str, fs: float) -> DataFrame:
    """From strict local maxima: rate per minute, mean and deviation of the intervals in ms, and the root mean square of
    their successive differences."""
    peaks = with_neighbours(df, keys, pos, value).where((F.col(value) > F.col("prev")) & (F.col(value) > F.col("next")))
    w = Window.partitionBy(*keys).orderBy(pos)
    rr = (F.col(pos) - F.lag(pos).over(w)) * (1000.0 / fs)
    steps = peaks.withColumn("rr", rr).withColumn("drr", F.col("rr") - F.lag("rr").over(w))
    spans = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    out = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("__k"), F.avg("rr").alias("rr_mean"), F.stddev_pop("rr").alias("rr_std"), F.sqrt(F.avg(F.col("drr") * F.col("drr"))).alias("rmssd"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return spans.join(out, list(keys), "left").select(*keys, (60.0 * F.coalesce("__k", F.lit(0)) / (F.col("__n") / fs)).alias("rate"), zero("rr_mean"), zero("rr_std"), zero("rmssd"))
