"""From irregular samples to fixed windows: channel choice, scrubbing, resampling, binning, windows, gates and labels.

Everything is a column expression or a window inside a bounded partition. A series may hold a third of all rows, so
positions within a series come from positions.py, never from one window over the series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.positions import with_position
from pulsegrid.operators.ranking import with_global_rank


def scrub(col) -> Column:
    """0 for NaN and infinities; NULL stays NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def pick_channels(leads: DataFrame, record: str, lead: str, aliases: Mapping[str, Sequence[str]], payload: str) -> DataFrame:
    """(record, channel, payload): for each record and target channel the lead first in its aliases, case ignored.

    Channels without any lead come with NULL payload (fill with zeros at the array level)."""
    spark = leads.sparkSession
    table = F.broadcast(spark.createDataFrame([(c, a.upper(), i) for c, names in aliases.items() for i, a in enumerate(names)], "channel string, __alias string, __prio int"))
    wanted = F.array(*[F.lit(c) for c in aliases])
    found = (
        leads.join(table, F.upper(lead) == F.col("__alias"))
        .groupBy(record, "channel")
        .agg(F.min_by(F.struct(F.col(payload).alias("p")), F.struct("__prio", F.col(lead))).alias("__p"))
    )
    grid = leads.select(record).distinct().select(record, F.explode(wanted).alias("channel"))
    return grid.join(found, [record, "channel"], "left").select(record, "channel", F.col("__p.p").alias(payload))


def resample_linear(values: Column, fs: Column, target: float) -> Column:
    """The array at `target` samples a second, linearly interpolated, clamped at the right end; itself where fs is equal."""
    n = F.size(values)
    m = F.greatest(F.bround(n * F.lit(target) / fs).cast("int"), F.lit(1))

    def at(i: Column) -> Column:
        x = F.least(i * fs / F.lit(target), (n - 1).cast("double"))
        a = F.floor(x).cast("int")
        b = F.least(a + 1, n - 1)
        va, vb = F.get(values, a), F.get(values, b)
        return va + (x - a) * (vb - va)

    return F.when(fs == target, values).when(n > 0, F.transform(F.sequence(F.lit(0), m - 1), at)).otherwise(values)


def strided(values: Column, n: int) -> Column:
    """n evenly strided elements, first and last included; arrays of at most n elements stay as they are."""
    last = F.size(values) - 1
    step = max(n - 1, 1)
    return F.when(F.size(values) <= n, values).otherwise(_strides(values, n, last, step))


def _strides(values: Column, n: int, last: Column, step: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(values, F.floor(i * last / step).cast("int")))


def decimate(values: Column, most: int = 512) -> Column:
    """Every k-th element so that at most `most` remain."""
    stride = F.greatest(F.ceil(F.size(values) / most), F.lit(1))
    return F.filter(values, lambda x, i: i % stride == 0)


def count_windows(df: DataFrame, series: str, order: str, size: int, bucket: Column) -> DataFrame:
    """df with window_no and pos: full windows of `size` successive rows per series, the tail dropped.

    order is unique within a series; bucket is monotone in it."""
    placed = with_position(df, [series], bucket, [F.col(order)], "__pos")
    cut = placed.withColumn("window_no", F.floor(F.col("__pos") / size)).withColumn("pos", (F.col("__pos") % size).cast("int"))
    full = F.count(F.lit(1)).over(Window.partitionBy(series, "window_no"))
    return cut.withColumn("__n", full).where(F.col("__n") == size).drop("__n", "__pos")


def tail_rows(df: DataFrame, series: str, size: int) -> DataFrame:
    """(series, rows, windows, dropped): what count_windows keeps and drops per series."""
    n = F.count(F.lit(1))
    return df.groupBy(series).agg(n.alias("rows"), F.floor(n / size).alias("windows"), (n % size).alias("dropped"))


def window_flag(windows: DataFrame, keys: Sequence[str], flag: Column, name: str = "label") -> DataFrame:
    """1 for windows with any flagged row, else 0."""
    return windows.groupBy(*keys).agg(F.max(F.when(flag, 1).otherwise(0)).alias(name))


def bin_channels(df: DataFrame, source: str, time: str, channels: Sequence[str], seconds: float = 60.0, bins: int = 60) -> DataFrame:
    """(source, window_no, pos, channels…): means per time bin since the source's first bin, on a dense grid of full windows.

    Empty bins are NULL rows; the last, partial window is dropped. Rows without source or time do not count."""
    clean = df.where(F.col(source).isNotNull() & F.col(time).isNotNull() & ~F.isnan(time)).select(
        source, F.floor(F.col(time) / seconds).alias("__bin"), *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in channels]
    )
    means = clean.groupBy(source, "__bin").agg(*[F.avg(c).alias(c) for c in channels])
    spans = means.groupBy(source).agg(F.min("__bin").alias("__first"), F.max("__bin").alias("__last"))
    windows = F.floor((F.col("__last") - F.col("__first") + 1) / bins)
    # one row per full window, exploded to its bins in a second step: no array grows with the source
    grid = (
        spans.select(source, "__first", F.explode(F.sequence(F.lit(0), windows)).alias("window_no"), windows.alias("__w"))
        .where("window_no < __w")
        .select(source, "window_no", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("pos"), (F.col("__first") + F.col("window_no") * bins).alias("__start"))
        .select(source, F.col("window_no").cast("bigint").alias("window_no"), "pos", (F.col("__start") + F.col("pos")).alias("__bin"))
    )
    return grid.join(means, [source, "__bin"], "left").select(source, "window_no", "pos", *channels)


def long_channels(df: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("channel_idx"), F.lit(c).alias("channel"), F.col(c).alias("value")) for i, c in enumerate(channels)])
    return df.select(*keys, F.inline(pairs))


def missing_gate(binned: DataFrame, keys: Sequence[str], channels: Sequence[str], most: float = 0.10) -> DataFrame:
    """(keys, missing): the windows in which no channel lacks more than `most` of its bins, with the worst share."""
    shares = [F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)) for c in channels]
    return binned.groupBy(*keys).agg((F.greatest(*shares) if len(shares) > 1 else shares[0]).alias("missing")).where(F.col("missing") <= most)


def fill_forward(binned: DataFrame, keys: Sequence[str], channels: Sequence[str], pos: str = "pos") -> DataFrame:
    """Last observation carried forward inside each window; a leading gap takes the mean of the window before filling."""
    w = Window.partitionBy(*keys)
    upto = w.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return binned.select(*keys, pos, *[F.coalesce(F.last(c, True).over(upto), F.avg(c).over(w)).alias(c) for c in channels])


def stay_labels(diagnoses: DataFrame, source: str, order: str, category: str, classes: Sequence[str]) -> DataFrame:
    """(source, y): the first known category other than `other` in order; else `other` if any; else class 0.

    Categories match exactly; unknown and NULL ones do not count."""
    index = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    idx = F.try_element_at(index, F.col(category))
    other = classes.index("other")
    first = F.min_by(F.when(idx != other, idx), F.when(idx != other, F.col(order)))
    return diagnoses.groupBy(source).agg(F.coalesce(first, F.when(F.max(F.when(idx == other, 1)) == 1, F.lit(other)), F.lit(0)).alias("y"))


def label_stays(stays: DataFrame, source: str, labels: DataFrame) -> DataFrame:
    """Stays with y; stays without diagnoses are class 0. AQE broadcasts the labels where they are small."""
    return stays.join(labels, source, "left").withColumn("y", F.coalesce("y", F.lit(0)))


def record_class(record: Column, prefixes: Mapping[str, int]) -> Column:
    """Class by the first letter of a record's name, case ignored; NULL if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv]), F.lower(F.substring(record, 1, 1)))


def alarm_truth(header: Column) -> Column:
    """1 for '#true alarm', 0 for '#false alarm' anywhere in the text, case ignored; else NULL."""
    low = F.lower(header)
    return F.when(low.contains("#true alarm"), 1).when(low.contains("#false alarm"), 0)


def is_present(value: Column, least: float = 1e-6) -> Column:
    """Aggregate: whether a channel varies at all."""
    return F.coalesce(F.stddev_pop(value) > least, F.lit(False))


def ranked_split(ids: DataFrame, key: str, rank_key: Column, gold: int, seed_col: str = "split", test_divisor: int = 5, caps: Mapping[str, int] | None = None) -> DataFrame:
    """(key, split): gold first, then a fifth of the rest (at least 1) as test, the remainder unlabeled, by rank_key.

    caps bounds a split's size after the assignment."""
    total = ids.count()
    n_gold = min(gold, total)
    n_test = max(1, (total - n_gold) // test_divisor) if total > n_gold else 0
    placed = with_global_rank(ids.select(key, rank_key.alias("__k")), [F.col("__k"), F.col(key)], "__r")
    split = F.when(F.col("__r") < n_gold, "gold").when(F.col("__r") < n_gold + n_test, "test").otherwise("unlabeled")
    out = placed.select(key, split.alias(seed_col), "__r")
    start = {"gold": 0, "test": n_gold, "unlabeled": n_gold + n_test}
    for name, cap in (caps or {}).items():
        out = out.where((F.col(seed_col) != name) | (F.col("__r") < start[name] + cap))
    return out.drop("__r")
