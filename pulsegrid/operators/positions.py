"""Exact per-key positions and neighbours without one task per key.

A plain window over (key) sorts a whole key in one task. Here a key is cut into buckets of bounded size; windows
run inside (key, bucket), and a table with one row per bucket carries what crosses the borders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_position(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "pos", null_safe: bool = False) -> DataFrame:
    """Add the 0-based position of each row within its key, ordered by (bucket, order).

    bucket must be monotone in the order. With null_safe, NULL keys form a key of their own."""
    b, n, off = f"__{name}_b", f"__{name}_n", f"__{name}_off"
    parts = [*keys, b]
    rows = df.withColumn(b, bucket)
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*parts)
        .agg(F.count(F.lit(1)).alias(n))
        .withColumn(off, F.coalesce(F.sum(n).over(before), F.lit(0)))
        .select(*[F.col(k).alias(f"__o_{k}") for k in parts], off)
    )
    same = [F.col(k).eqNullSafe(F.col(f"__o_{k}")) if null_safe else F.col(k) == F.col(f"__o_{k}") for k in parts]
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))
    return (
        ranked.join(offsets, same)
        .withColumn(name, (F.col(name) - 1 + F.col(off)).cast("bigint"))
        .drop(b, off, *[f"__o_{k}" for k in parts])
    )


def with_previous(df: DataFrame, keys: Sequence[str], bucket: Column, order: str, payload: str, name: str = "prev", null_safe: bool = False) -> DataFrame:
    """Add payload of the preceding row of the same key in the order of column `order` (unique within a key).

    bucket must be monotone in order. The first row of a key gets NULL."""
    b, carry = "__b", "__carry"
    parts = [*keys, b]
    rows = df.withColumn(b, bucket)
    lasts = (
        rows.groupBy(*parts)
        .agg(F.max_by(payload, order).alias(carry))
        .withColumn(carry, F.lag(carry).over(Window.partitionBy(*keys).orderBy(b)))
        .select(*[F.col(k).alias(f"__o_{k}") for k in parts], carry)
    )
    same = [F.col(k).eqNullSafe(F.col(f"__o_{k}")) if null_safe else F.col(k) == F.col(f"__o_{k}") for k in parts]
    w = Window.partitionBy(*parts).orderBy(order)
    out = rows.withColumn(name, F.lag(payload).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    return (
        out.join(lasts, same)
        .withColumn(name, F.when(F.col("__first"), F.col(carry)).otherwise(F.col(name)))
        .drop(b, carry, "__first", *[f"__o_{k}" for k in parts])
    )
