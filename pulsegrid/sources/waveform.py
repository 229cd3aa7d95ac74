"""Waveform records (text header plus 16-bit or 212-packed signal file) without any third-party reader."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.windowing import alarm_truth


def parse_header(text: str) -> dict | None:
    """Record name, rate, and per signal its file, format, gain, baseline and name; None if it is no header."""
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    try:
        head = lines[0].split()
        n, fs = int(head[1]), float(head[2].split("/")[0]) if len(head) > 2 else 250.0
        signals = []
        for line in lines[1 : 1 + n]:
            p = line.split()
            gain_text = p[2] if len(p) > 2 else "200"
            gain = float(gain_text.split("/")[0].split("(")[0] or 200) or 200.0
            baseline = int(gain_text.split("(")[1].split(")")[0]) if "(" in gain_text else int(p[4]) if len(p) > 4 else 0
            signals.append({"file": p[0], "fmt": int(p[1].split("x")[0].split("+")[0]), "gain": gain, "baseline": baseline, "name": " ".join(p[8:]) if len(p) > 8 else f"s{len(signals)}"})
        return {"record_id": head[0], "fs": fs, "signals": signals}
    except (IndexError, ValueError):
        return None


def decode(raw: bytes, fmt: int, channels: int) -> np.ndarray | None:
    """(samples, channels) of interleaved integers in format 16 or 212."""
    if fmt == 16:
        flat = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(float)
        flat[flat == -32768] = np.nan
    elif fmt == 212:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).astype(np.int32).reshape(-1, 3)
        pair = np.column_stack([b[:, 0] | (b[:, 1] & 0x0F) << 8, b[:, 2] | (b[:, 1] & 0xF0) << 4]).ravel()
        flat = np.where(pair > 2047, pair - 4096, pair).astype(float)
        flat[flat == -2048] = np.nan
    else:
        return None
    return flat[: len(flat) // channels * channels].reshape(-1, channels)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, fs, truth, lead, values) of all readable records below a folder: one row per lead, in physical units.

    Headers are small text; each signal file is one row of the binary source and is decoded where it is read."""
    base = spark.read.option("recursiveFileLookup", True).format("binaryFile")
    stem = F.regexp_extract("path", r"([^/]+)\.\w+$", 1)
    heads = base.option("pathGlobFilter", "*.hea").load(path).select(stem.alias("stem"), F.decode("content", "utf-8").alias("header"))
    data = base.option("pathGlobFilter", "*.dat").load(path).select(stem.alias("stem"), "content")

    def load(batches):
        for pdf in batches:
            rows = []
            for header, content in zip(pdf["header"], pdf["content"]):
                h = parse_header(header)
                if not h or not h["signals"]:
                    continue
                x = decode(bytes(content), h["signals"][0]["fmt"], len(h["signals"]))
                if x is None or not len(x):
                    continue
                for i, s in enumerate(h["signals"]):
                    rows.append((h["record_id"], h["fs"], header, s["name"], i, np.nan_to_num((x[:, i] - s["baseline"]) / s["gain"]).tolist()))
            yield pd.DataFrame(rows, columns=["record_id", "fs", "header", "lead", "lead_no", "values"])

    out = heads.join(data, "stem").mapInPandas(load, "record_id string, fs double, header string, lead string, lead_no int, values array<double>")
    return out.withColumn("truth", alarm_truth(F.col("header"))).drop("header")


def record_windows(records: DataFrame, target_fs: float = 250.0, seconds: int = 30) -> DataFrame:
    """(record_id, channel, window_no, values): leads picked by alias, resampled, cut into full windows; records shorter than
    a window give none, absent channels come as zeros."""
    from pulsegrid.operators.windowing import pick_channels, resample_linear, scrub
    from pulsegrid.registry import ALARM_CHANNELS, CHANNEL_ALIASES

    size = int(target_fs * seconds)
    ready = records.withColumn("values", F.transform(resample_linear(F.col("values"), F.col("fs"), target_fs), lambda x: scrub(x)))
    lengths = ready.groupBy("record_id").agg(F.max(F.size("values")).alias("n")).where(F.col("n") >= size)
    picked = pick_channels(ready, "record_id", "lead", CHANNEL_ALIASES, "values").join(lengths, "record_id")
    order = F.array(*[F.lit(c) for c in ALARM_CHANNELS])
    windows = picked.select("record_id", "channel", (F.array_position(order, F.col("channel")) - 1).cast("int").alias("channel_idx"), "values", F.explode(F.sequence(F.lit(0), (F.col("n") / size).cast("int") - 1)).alias("window_no"))
    cut = F.when(F.col("values").isNull(), F.array_repeat(F.lit(0.0), size)).otherwise(F.slice("values", F.col("window_no") * size + 1, size))
    return windows.select("record_id", "channel_idx", "channel", "window_no", cut.alias("values"))
