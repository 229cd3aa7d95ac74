import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid import registry, schemas
from pulsegrid.sources import manifest, series, waveform
from pulsegrid.streaming import windows as streaming


def test_registry(spark):
    views = registry.default_views(spark).orderBy("view_idx").collect()
    assert len(views) == 12 and views[0]["view"] == "narrow_T0.0" and views[11]["view"] == "wide_T1.0"
    assert registry.classes_table(spark).where("dataset = 'mimic'").count() == 8


def test_schema_check(spark):
    good = spark.createDataFrame([], schemas.schema("labels"))
    assert schemas.require(good, "labels") is good
    with pytest.raises(ValueError):
        schemas.require(good.drop("y"), "labels")


def test_tolerant_series(spark):
    rows = [("1", "0"), ("x", "1"), (" nan ", "1"), ("2", ""), ("3", "0.5"), ("4", "2"), ("5", "y"), ("1e3", "-1"), (None, "1")]
    df = spark.createDataFrame(rows, "VAL string, isAnomaly string")
    got = [(r["value"], r["flag"]) for r in series.tolerant_series(df).collect()]
    assert [f for _, f in got] == [0, 1, 0, 0, 1, 0, 1] and np.isnan(got[1][0]) and got[6][0] == 1000.0
    assert series.tolerant_series(df.drop("VAL")).count() == 0
    assert series.tolerant_series(df.select("VAL")).first()["flag"] == 0


def test_series_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("timestamps,Value,anomaly\n1,2.5,1\n2,bad,0\n3,4,\n")
    (tmp_path / "y.csv").write_text("ts,val\n1,7\n")
    (tmp_path / "z.csv").write_text("a,b\n1,7\n")
    (tmp_path / "empty.csv").write_text("")
    got = sorted((r["series_id"].rsplit("/", 1)[1], r["row_no"], r["value"], r["flag"]) for r in series.read_series_files(spark, str(tmp_path)).collect())
    assert got == [("x.csv", 0, 2.5, 1), ("x.csv", 2, 4.0, 0), ("y.csv", 0, 7.0, 0)]


def test_dataset_round_trip(spark, tmp_path):
    w = series.synthetic_windows(spark, "mimic", 10, 8, 8)
    labels = w.select("window_id", "y").distinct()
    splits = labels.select("window_id", F.when(F.col("window_id") < 3, "gold").otherwise("test").alias("split"))
    series.write_dataset({"windows": w.drop("y"), "labels": labels, "splits": splits}, str(tmp_path), "mimic")
    assert series.load_dataset(spark, "mimic", str(tmp_path)).count() == 80
    assert series.load_dataset(spark, "mimic", str(tmp_path), "gold").select("window_id").distinct().count() == 3
    with pytest.raises(series.DatasetUnavailableError):
        series.load_dataset(spark, "yahoo", str(tmp_path))
    assert series.load_dataset(spark, "yahoo", str(tmp_path), allow_synthetic=True).first()["synthetic"]
    with pytest.raises(KeyError):
        series.load_dataset(spark, "nope", str(tmp_path))


def test_formats():
    x = np.array([[1, -2], [300, -2047]])
    assert waveform.decode(x.astype("<i2").tobytes(), 16, 2).tolist() == x.tolist()
    packed = b"".join(bytes([a & 255, (a >> 8 & 15) | (b >> 8 & 15) << 4, b & 255]) for a, b in (x & 0xFFF))
    assert waveform.decode(packed, 212, 2).tolist() == x.tolist()
    assert waveform.decode(b"", 99, 1) is None and waveform.parse_header("junk") is None


def test_records(spark, tmp_path):
    for name, fs, seconds, truth in (("a1", 125, 61, "#True alarm"), ("v2", 250, 29, "#False alarm")):
        n = fs * seconds
        sig = np.column_stack([np.arange(n) % 100, np.full(n, 7)]).astype("<i2")
        (tmp_path / f"{name}.dat").write_bytes(sig.tobytes())
        (tmp_path / f"{name}.hea").write_text(f"{name} 2 {fs} {n}\n{name}.dat 16 10 16 0 0 0 0 II\n{name}.dat 16 1(7) 16 0 0 0 0 pleth\n{truth}\n")
    records = waveform.read_records(spark, str(tmp_path))
    assert {(r["record_id"], r["truth"]) for r in records.collect()} == {("a1", 1), ("v2", 0)}
    got = waveform.record_windows(records).collect()
    assert {(r["record_id"], r["window_no"]) for r in got} == {("a1", 0), ("a1", 1)} and len(got) == 10
    by = {(r["channel"], r["window_no"]): r["values"] for r in got}
    assert by["ECG_II", 0][:3] == [0.0, 0.05, 0.1] and set(by["PPG", 1]) == {0.0} and set(by["ABP", 0]) == {0.0} and len(by["ECG_II", 1]) == 7500


def test_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("OPENAI_API_KEY", "secret")
    (tmp_path / "in.txt").write_text("x")
    out = manifest.Manifest(tmp_path / "run", {"alpha": 0.05}, spark).start().add_inputs([tmp_path / "in.txt", tmp_path / "no"]).add_usage({"calls": 1}).done()
    data = json.loads(out.read_text())
    assert "secret" not in out.read_text() and data["spark"]["version"] == spark.version and data["inputs"][str(tmp_path / "no")] is None
    assert (tmp_path / "run" / "STARTED").exists() and (tmp_path / "run" / "DONE").exists()


def stream_of(spark, tmp_path, rows):
    spark.createDataFrame(rows, "s long, t timestamp, v double").repartition(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("s long, t timestamp, v double").parquet(str(tmp_path / "in"))


def test_streaming_bins(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2030, 1, 1)
    rows = [(i % 2, base + dt.timedelta(seconds=20 * i), float(i)) for i in range(12)] + [(0, base + dt.timedelta(days=2), 1.0)]
    made = streaming.binned(stream_of(spark, tmp_path, rows), "s", "t", "v")
    streaming.run_to_end(made, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 8 and got.agg(F.sum("n")).first()[0] == 12


def test_streaming_count_windows(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2030, 1, 1)
    rows = [(i % 2, base + dt.timedelta(seconds=100 - i), float(i)) for i in range(11)]
    made = streaming.counted(stream_of(spark, tmp_path, rows), "s", "t", "v", 3)
    streaming.run_to_end(made, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r["s"], r["window_no"]): r["values"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, 0): [10.0, 8.0, 6.0], (0, 1): [4.0, 2.0, 0.0], (1, 0): [9.0, 7.0, 5.0]}
