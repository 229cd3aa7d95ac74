"""Response cache and call trace as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.schemas import schema

DEFAULT_MODEL, DEFAULT_TEMPERATURE = "gpt-4o-mini", 0.0


def cache_key(model: Column, temperature: Column, prompt: Column, nonce: Column | None = None) -> Column:
    """The first 16 hex digits of SHA-256 over model, temperature (4 digits) and prompt, and an optional nonce."""
    parts = [model, F.format_string("%.4f", temperature), prompt, *([nonce.cast("string")] if nonce is not None else [])]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(k, r) of JSON lines, plain or gzipped; lines that do not parse or lack a key are skipped, of a key the last counts."""
    rows = spark.read.schema("k string, r string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    kept = rows.where("_corrupt is null and k is not null and r is not null").select("k", "r", F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("o"))
    return kept.groupBy("k").agg(F.max_by("r", "o").alias("r"))


def first_entries(entries: DataFrame, order: Column) -> DataFrame:
    """(k, r): the first response of each key in order, NULL responses never."""
    return entries.where(F.col("r").isNotNull() & F.col("k").isNotNull()).groupBy("k").agg(F.min_by("r", order).alias("r"))


def append_new(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with the entries of fresh (one row per key) that it lacks; what it has wins."""
    return cache.unionByName(fresh.join(cache, "k", "left_anti"))


def probe(calls: DataFrame, cache: DataFrame, key: str = "k") -> DataFrame:
    """calls with r (NULL on a miss) and hit."""
    return calls.join(cache.withColumnRenamed("k", key), key, "left").withColumn("hit", F.col("r").isNotNull())


def misses(calls: DataFrame, cache: DataFrame, key: str = "k") -> DataFrame:
    return calls.join(cache.withColumnRenamed("k", key), key, "left_anti")


def cache_stats(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """(hits, misses, n_keys)."""
    looked = probe(calls, cache).agg(F.sum(F.col("hit").cast("bigint")).alias("hits"), F.sum((~F.col("hit")).cast("bigint")).alias("misses"))
    return looked.withColumn("n_keys", cache.agg(F.count(F.lit(1)).alias("n_keys")).scalar())


def trace_entries(trace: DataFrame, order: Column) -> DataFrame:
    """(status, k, r, order) of trace rows: usable with a prompt and a response, skipped otherwise; absent model and
    temperature take the defaults."""
    k = cache_key(F.coalesce("model", F.lit(DEFAULT_MODEL)), F.coalesce("temperature", F.lit(DEFAULT_TEMPERATURE)), F.col("prompt"))
    usable = F.col("prompt").isNotNull() & F.col("response").isNotNull()
    return trace.select(F.when(usable, "usable").otherwise("skipped").alias("status"), F.when(usable, k).alias("k"), F.col("response").alias("r"), order.alias("o"))


def prefill(trace: DataFrame, cache: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """(the cache with the trace's new entries, one row with added, present and skipped)."""
    rows = trace_entries(trace, order)
    fresh = first_entries(rows.where("status = 'usable'"), F.col("o"))
    known = cache.select("k", F.lit(True).alias("known"))
    counts = rows.join(known, "k", "left").groupBy("k", "status", "known").agg(F.count(F.lit(1)).alias("n"))
    added = F.sum(F.when((F.col("status") == "usable") & F.col("known").isNull(), 1).otherwise(0)).cast("bigint")
    usable = F.sum(F.when(F.col("status") == "usable", F.col("n")).otherwise(0)).cast("bigint")
    skipped = F.sum(F.when(F.col("status") == "skipped", F.col("n")).otherwise(0)).cast("bigint")
    return append_new(cache, fresh), counts.agg(added.alias("added"), (usable - added).alias("present"), skipped.alias("skipped"))


def usage(trace: DataFrame) -> DataFrame:
    """Token sums, successful and failed calls, and the last model of a trace."""
    ok = F.col("error").isNull() & F.col("response").isNotNull()
    return trace.agg(
        F.coalesce(F.sum(F.when(ok, F.col("prompt_tokens"))), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("completion_tokens"))), F.lit(0)).alias("completion_tokens"),
        F.count_if(ok).alias("calls_ok"),
        F.count_if(~ok).alias("calls_failed"),
        F.max_by("model", F.struct("ts", "trace_id") if "trace_id" in trace.columns else F.col("ts")).alias("last_model"),
    )


def write_trace(trace: DataFrame, path: str, truncate: bool = False) -> None:
    """Append (or replace) trace rows as JSON lines."""
    cols = [f.name for f in schema("llm_trace") if f.name in trace.columns]
    trace.select(*cols).write.mode("overwrite" if truncate else "append").json(path)
