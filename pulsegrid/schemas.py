"""Schemas of the engine's tables, and a check for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TABLES = {
    "samples": "series_id string, t double, channel string, value double, flag int",
    "windows": "dataset string, window_id bigint, channel_idx int, channel string, values array<double>",
    "labels": "window_id bigint, y int",
    "splits": "window_id bigint, split string",
    "views": "view_idx int, prompt_variant string, temperature double, view string",
    "summaries": "window_id bigint, summary string",
    "view_outputs": "window_id bigint, view_idx int, view string, raw string, label int, confidence double",
    "scores": "window_id bigint, score double, correct boolean",
    "decisions": "window_id bigint, method string, pred int, confidence double, accept boolean",
    "metrics": "method string, seed int, n_accepted bigint, risk double, coverage double, cost double, f1 double",
    "llm_cache": "k string, r string",
    "llm_trace": "ts double, model string, temperature double, prompt_tokens bigint, completion_tokens bigint, elapsed_s double, attempt int, prompt string, response string, error string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def require(df: DataFrame, name: str) -> DataFrame:
    """df, if it has the columns of the named table with their types; a ValueError otherwise."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in schema(name) if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"{name} lacks: {', '.join(wrong)}")
    return df
