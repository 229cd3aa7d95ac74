"""Streaming counterparts: time-binned windows with late data, count windows with state, and scoring by a fitted gate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def binned(stream: DataFrame, series: str, time: str, value: str, width: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """(series, start, n, mean, min, max) per time bin; rows later than `late` are dropped by the watermark."""
    return (
        stream.withWatermark(time, late)
        .groupBy(series, F.window(time, width).alias("w"))
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
        .select(series, F.col("w.start").alias("start"), "n", "mean", "min", "max")
    )


def counted(stream: DataFrame, series: str, time: str, value: str, size: int) -> DataFrame:
    """(series, window_no, values): a row for every `size` successive readings of a series in the order of arrival, ties of a
    micro-batch by time. State per series is its unfinished window only."""
    kind = dict(stream.dtypes)[series]

    def update(key, batches, state: GroupState):
        rest, done = state.get if state.exists else ([], 0)
        rest, out = list(rest), []
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        for v in rows[value]:
            rest.append(float(v))
            if len(rest) == size:
                out.append((key[0], done, rest))
                rest, done = [], done + 1
        state.update((rest, done))
        yield pd.DataFrame(out, columns=[series, "window_no", "values"])

    return stream.groupBy(series).applyInPandasWithState(update, f"`{series}` {kind}, window_no bigint, values array<double>", "rest array<double>, done bigint", "append", GroupStateTimeout.NoTimeout)


def gated(stream: DataFrame, model, tau: float) -> DataFrame:
    """Disagreement rows with the score of a fitted calibrator and the decision of a fitted threshold."""
    return model.score(stream).withColumn("accept", F.coalesce(F.col("score") >= F.lit(tau), F.lit(False)))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; results go to Parquet at path, exactly once."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
