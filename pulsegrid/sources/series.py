"""Reading of charts, univariate series and windows; writing of windows, labels and splits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.registry import DATASETS


class DatasetUnavailableError(RuntimeError):
    """The dataset's tables are not there and no stand-in was asked for."""


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A Parquet table, or CSV with header and inferred types."""
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.parquet(path)


def to_value(cell: Column) -> Column:
    """A cell as a double the way a tolerant reader takes it (nan and inf included); NULL if it is no number."""
    text = F.lower(F.regexp_replace(cell, r"^\s+|\s+$", ""))
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    word = F.regexp_replace(text, r"^[+-]", "")
    return F.when(word == "nan", F.lit(float("nan"))).when(word.isin("inf", "infinity"), sign * F.lit(float("inf"))).otherwise(F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), text.try_cast("double")))


def to_flag(cell: Column) -> Column:
    """1 for a number whose integer part is not zero, else 0 (also for empty and unreadable cells)."""
    x = to_value(cell)
    whole = F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.when(x >= 0, F.floor(x).cast("double")).otherwise(F.ceil(x).cast("double")))
    return F.when(F.coalesce(whole, F.lit(0.0)) != 0, 1).otherwise(0)


#: Accepted column names, in lower case.
VALUE_COLUMNS = ("value", "val")
FLAG_COLUMNS = ("is_anomaly", "anomaly", "isanomaly")


def tolerant_series(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(kept columns, value, flag): rows with a readable value. Column names match without regard to case; without a value
    column there are no rows."""
    by_name = {c.lower(): c for c in reversed(rows.columns)}
    value = next((by_name[c] for c in VALUE_COLUMNS if c in by_name), None)
    flag = next((by_name[c] for c in FLAG_COLUMNS if c in by_name), None)
    if value is None:
        return rows.sparkSession.createDataFrame([], rows.select(*keep).schema).withColumn("value", F.lit(None).cast("double")).withColumn("flag", F.lit(None).cast("int"))
    x = rows.select(*keep, to_value(F.col(value).cast("string")).alias("value"), (to_flag(F.col(flag).cast("string")) if flag else F.lit(0)).alias("flag"))
    return x.where("value is not null")


def read_series_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(series_id, row_no, value, flag) of all CSV files below a folder, each with a header of its own, whatever its names."""
    from pulsegrid.operators.schema_drift import read_file

    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).format("binaryFile").load(path)

    def load(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                names, lines = read_file(bytes(content).decode("utf-8", "replace"))
                low = [n.lower() for n in names]
                v = next((low.index(c) for c in VALUE_COLUMNS if c in low), None)
                f = next((low.index(c) for c in FLAG_COLUMNS if c in low), None)
                if v is not None:
                    rows += [(p, i, r[v] if v < len(r) else None, r[f] if f is not None and f < len(r) else None) for i, r in enumerate(lines)]
            yield pd.DataFrame(rows, columns=["series_id", "row_no", "value", "is_anomaly"])

    return tolerant_series(files.select("path", "content").mapInPandas(load, "series_id string, row_no bigint, value string, is_anomaly string"), ("series_id", "row_no"))


def load_dataset(spark: SparkSession, name: str, root: str, split: str = "all", override: str | None = None, allow_synthetic: bool = False) -> DataFrame:
    """Windows with labels of a registered dataset, optionally of one split, under its logical name.

    Tables lie in root/<name>/{windows,labels,splits}. Raises DatasetUnavailableError if they are missing, unless a
    synthetic stand-in is allowed; then `synthetic` is true."""
    if name not in DATASETS:
        raise KeyError(name)
    actual = override or name
    base = f"{root.rstrip('/')}/{actual}"
    if not exists(spark, f"{base}/windows"):
        if not allow_synthetic:
            raise DatasetUnavailableError(f"{base}/windows is missing; preprocess the raw data first or allow a synthetic stand-in")
        d = DATASETS[actual]
        return synthetic_windows(spark, actual, 500, len(d.classes), len(d.channels)).withColumns({"logical_name": F.lit(name), "synthetic": F.lit(True)})
    out = spark.read.parquet(f"{base}/windows").join(spark.read.parquet(f"{base}/labels"), "window_id")
    if split != "all":
        out = out.join(spark.read.parquet(f"{base}/splits").where(F.col("split") == split).select("window_id"), "window_id", "left_semi")
    return out.withColumns({"logical_name": F.lit(name), "synthetic": F.lit(False)})


def synthetic_windows(spark: SparkSession, dataset: str, n: int, classes: int, channels: int, length: int = 60) -> DataFrame:
    """Class-separable windows from integer arithmetic, the same in every engine: label (7919 id) mod classes, and values
    spread in [0, 1) plus 0.15 times the class."""
    y = (F.col("id") * 7919) % classes
    value = lambda t: ((F.col("window_id") * 7607 + F.col("channel_idx") * 101 + t * 3571 + t * t * 13) % 997) / 997.0 + 0.15 * F.col("y")
    base = spark.range(n).select(F.lit(dataset).alias("dataset"), F.col("id").alias("window_id"), y.cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel_idx"))
    names = F.array(*[F.lit(c) for c in DATASETS[dataset].channels]) if dataset in DATASETS else None
    channel = F.get(names, F.col("channel_idx")) if names is not None else F.concat(F.lit("c"), F.col("channel_idx").cast("string"))
    return base.select("dataset", "window_id", "channel_idx", channel.alias("channel"), F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: value(t.cast("bigint"))).alias("values"), "y")


def write_dataset(tables: Mapping[str, DataFrame], root: str, name: str) -> None:
    """windows, labels and splits below root/name."""
    for part, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}/{part}")
