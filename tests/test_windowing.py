import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import stats
from pulsegrid.operators import windowing as W
from pulsegrid.registry import CHANNEL_ALIASES, CLINICAL_CLASSES, RECORD_PREFIXES


def events(spark, n, series=1):
    return spark.range(n).select(F.lit(series).alias("s"), "id", F.col("id").alias("o"), (F.col("id") * 1.5).alias("v"))


@pytest.mark.parametrize(("n", "windows"), [(0, 0), (3, 0), (4, 1), (9, 2)])
def test_count_windows(spark, n, windows):
    got = W.count_windows(events(spark, n), "s", "o", 4, F.floor(F.col("o") / 3)).collect()
    assert sorted((r["window_no"], r["pos"]) for r in got) == [(w, p) for w in range(windows) for p in range(4)]


def test_resample_matches_interp(spark):
    x = [1.0, 4.0, 2.0, 8.0, 5.0]
    df = spark.createDataFrame([(x,)], "x array<double>")
    for fs, target in ((2.0, 5.0), (5.0, 2.0), (3.0, 3.0)):
        got = df.select(W.resample_linear(F.col("x"), F.lit(fs), target)).first()[0]
        n = round(len(x) * target / fs)
        assert np.allclose(got, np.interp(np.minimum(np.arange(n) / target, 4 / fs), np.arange(5) / fs, x))


def test_strided_decimate_scrub(spark):
    df = spark.createDataFrame([([float(i) for i in range(10)], float("nan")), ([1.0], float("-inf"))], "x array<double>, v double")
    rows = df.select(W.strided(F.col("x"), 4).alias("s"), W.decimate(F.col("x"), 4).alias("d"), W.scrub("v").alias("v")).collect()
    assert rows[0]["s"] == [0.0, 3.0, 6.0, 9.0] and rows[0]["d"] == [0.0, 3.0, 6.0, 9.0] and rows[0]["v"] == 0.0
    assert rows[1]["s"] == [1.0] and rows[1]["v"] == 0.0


def test_pick_channels(spark):
    df = spark.createDataFrame([("a", "ii", 1.0), ("a", "V", 2.0), ("b", "v", 3.0), ("b", "pleth", 4.0), ("c", "xx", 5.0)], "r string, lead string, x double")
    got = {(r["r"], r["channel"]): r["x"] for r in W.pick_channels(df, "r", "lead", CHANNEL_ALIASES, "x").collect()}
    assert len(got) == 15 and got["a", "ECG_II"] == 1.0 and got["b", "ECG_II"] == 3.0 and got["b", "PPG"] == 4.0 and got["c", "ABP"] is None


def test_bins_gate_and_fill(spark):
    rows = [(1, 60.0 * m + 5, float(m)) for m in range(60) if m not in (0, 1, 20, 21, 22, 30)] + [(1, 0.0, None), (1, 60.0 * 130, 1.0), (1, 65.0, float("nan")), (None, 5.0, 1.0), (1, None, 1.0)]
    binned = W.bin_channels(spark.createDataFrame(rows, "s long, t double, x double"), "s", "t", ["x"])
    assert binned.count() == 120
    kept = W.missing_gate(binned, ["s", "window_no"], ["x"]).collect()
    assert [(r["window_no"], round(r["missing"], 3)) for r in kept] == [(0, 0.1)]
    filled = {r["pos"]: r["x"] for r in W.fill_forward(binned, ["s", "window_no"], ["x"]).where("window_no = 0").collect()}
    mean = np.mean([m for m in range(60) if m not in (0, 1, 20, 21, 22, 30)])
    assert filled[0] == pytest.approx(mean) and filled[1] == pytest.approx(mean) and filled[21] == 19.0 and filled[30] == 29.0


def test_stay_labels(spark):
    rows = [(1, 0, "other"), (1, 1, "infection"), (1, 2, "sepsis_onset"), (2, 0, "other"), (3, 0, "weird"), (3, 1, None), (4, 0, "normal"), (4, 1, "infection")]
    got = dict(map(tuple, W.stay_labels(spark.createDataFrame(rows, "s long, o int, c string"), "s", "o", "c", CLINICAL_CLASSES).collect()))
    assert got == {1: 6, 2: 7, 3: 0, 4: 0}


def test_record_class_and_truth(spark):
    df = spark.createDataFrame([("a103", "#True alarm"), ("F2", "x\n#FALSE ALARM"), ("x1", "none"), ("", None)], "r string, h string")
    got = [tuple(r) for r in df.select(W.record_class(F.col("r"), RECORD_PREFIXES), W.alarm_truth(F.col("h"))).collect()]
    assert got == [(0, 1), (4, 0), (None, None), (None, None)]


def test_split_sizes(spark):
    got = W.ranked_split(spark.range(103), "id", F.col("id") * 7 % 101, 50).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"gold": 50, "test": 10, "unlabeled": 43}


def test_window_stats_match_numpy(spark):
    x = np.random.default_rng(0).normal(size=40).round(3)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k long, p int, v double")
    r = stats.window_stats(df, ["k"], "p", "v").first()
    slope, icpt = np.polyfit(np.arange(40), x, 1)
    r2 = 1 - ((x - slope * np.arange(40) - icpt) ** 2).sum() / (((x - x.mean()) ** 2).sum() + 1e-9)
    want = [x.mean(), x.std(), x.min(), x.max(), *np.percentile(x, [25, 50, 75]), slope, r2, np.abs(np.diff(x)).mean(), ((np.diff(x)[:-1] > 0) & (np.diff(x)[1:] < 0)).sum()]
    assert np.allclose(list(r)[1:], want)
    q = stats.quality(df, ["k"], "p", "v").first()
    assert q["artifact"] == pytest.approx(np.abs(np.diff(x, n=2)).mean()) and q["flatline"] == pytest.approx((np.abs(x - np.median(x)) < 0.05 * x.std()).mean())


def test_constant_window(spark):
    df = spark.createDataFrame([(1, i, 3.0) for i in range(8)], "k long, p int, v double")
    r = stats.window_stats(df, ["k"], "p", "v").first()
    assert (r["slope"], r["r2"], r["peaks"]) == (0.0, 1.0, 0)
    assert stats.quality(df, ["k"], "p", "v").first()["flatline"] == 0.0
