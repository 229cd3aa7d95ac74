"""Exact ranks and top-k over a whole table without one global sort task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import discard, materialize

#: Rows up to which a top-k runs as per-partition heaps that meet in one task.
HEAP_ROWS = 10_000


def with_global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 0-based rank of each row in the order, which must tell all rows apart.

    Rows are range-partitioned by the order and written down once, so that the ranges stay what they were; row numbers run
    inside a range, and a table with one row per range carries the counts before it."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.select(F.col("__range").alias("__range_o"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    numbered = ranged.withColumn(name, inside)
    return numbered.join(offsets, F.col("__range") == F.col("__range_o")).withColumn(name, F.col(name) - 1 + F.col("__before")).drop("__range", "__range_o", "__before")


def first_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows in the order: small k by heaps per partition, large k by rank."""
    if k <= HEAP_ROWS:
        return df.orderBy(*order).limit(k)
    return with_global_rank(df, order, "__rank").where(F.col("__rank") < k).drop("__rank")


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """df with running sums in the order, {column: name}, the row itself included; the order must tell all rows apart.

    As in with_global_rank, rows are written down by ranges; the table that adds up what lies before has a row per range."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__sum_{i}") for i, c in enumerate(sums)])
    offsets = whole.select(F.col("__range").alias("__range_o"), *[F.coalesce(F.sum(f"__sum_{i}").over(before), F.lit(0)).alias(f"__before_{i}") for i in range(len(sums))])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = ranged.select("*", *[F.sum(c).over(inside).alias(f"__in_{i}") for i, c in enumerate(sums)]).join(offsets, F.col("__range") == F.col("__range_o"))
    out = met.select(*df.columns, *[(F.col(f"__in_{i}") + F.col(f"__before_{i}")).alias(name) for i, name in enumerate(sums.values())])
    out._pulsegrid_path = ranged._pulsegrid_path  # for discard()
    return out


def quantile(df: DataFrame, value: str, q: float, name: str = "quantile") -> DataFrame:
    """(name): the exact q quantile, interpolated between its two order statistics; NULL for no values.

    No task sees all values: distinct ones are counted, added up by ranges, and only the two statistics come to the driver."""
    levels = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    run = running_sums(levels, [F.col("v")], {"n": "k"})
    n = run.agg(F.max("k")).first()[0]
    found = None
    if n:
        at = q * (n - 1)
        low, high = run.agg(F.min(F.when(F.col("k") > math.floor(at), F.col("v"))), F.min(F.when(F.col("k") > math.ceil(at), F.col("v")))).first()
        found = low + (high - low) * (at - math.floor(at)) if high > low else low
    discard(run)
    return df.sparkSession.range(1).select(F.lit(found).cast("double").alias(name))
