import json

import numpy as np
import pytest

from pulsegrid.operators import labeling
from pulsegrid.plans import runner


def test_clinical_to_demo(spark, tmp_path):
    rng = np.random.default_rng(0)
    charts = [(s, 60.0 * m, *[float(x) for x in rng.normal(80 + 5 * (s % 3), 2, 8)]) for s in range(1, 13) for m in range(125)]
    from pulsegrid.registry import CLINICAL_CHANNELS

    df = spark.createDataFrame(charts, "stay_id long, charttime double, " + ", ".join(f"{c} double" for c in CLINICAL_CHANNELS))
    diagnoses = spark.createDataFrame([(s, 0, ["normal", "infection", "other"][s % 3]) for s in range(1, 13)], "stay_id long, ord int, icd_category string")
    done = runner.preprocess_clinical(df, diagnoses, str(tmp_path), gold=12)
    assert done["windows"] == 24
    rows = runner.demo(spark, "mimic", str(tmp_path), str(tmp_path / "out"), labeling.RuleModel(8), alpha=0.2, names=["pipeline", "full_llm", "self_consistency", "snorkel_style"], fs=30.0)
    assert [r["method"] for r in rows] == ["full_llm", "label_model", "pipeline", "self_consistency"]
    assert all(0 <= r["risk"] <= 1 and 0 <= r["coverage"] <= 1 for r in rows)
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["usage"]["calls_failed"] == 0


def test_anomaly(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.csv").write_text("timestamp,value,is_anomaly\n" + "".join(f"{i},{i * 0.5},{int(i == 7)}\n" for i in range(25)))
    (tmp_path / "in" / "short.csv").write_text("timestamp,value\n1,2\n")
    assert runner.preprocess_anomaly(spark, str(tmp_path / "in"), str(tmp_path / "out"), size=10) == {"windows": 2, "positive": 1}
    with pytest.raises(SystemExit):
        runner.preprocess_anomaly(spark, str(tmp_path / "in"), str(tmp_path / "none"), size=100)


def test_alarm(spark, tmp_path):
    for name, truth in (("a1", "#True alarm"), ("t2", "#False alarm"), ("x3", "")):
        sig = np.column_stack([np.arange(250 * 31) % 90, np.arange(250 * 31) % 70]).astype("<i2")
        (tmp_path / f"{name}.dat").write_bytes(sig.tobytes())
        (tmp_path / f"{name}.hea").write_text(f"{name} 2 250 {len(sig)}\n{name}.dat 16 10 16 0 0 0 0 II\n{name}.dat 16 10 16 0 0 0 0 ABP\n{truth}\n")
    assert runner.preprocess_alarm(spark, str(tmp_path), str(tmp_path / "o1")) == {"windows": 2, "positive": 1}
    assert runner.preprocess_alarm(spark, str(tmp_path), str(tmp_path / "o2"), "multiclass") == {"windows": 2, "positive": 1}


def test_command_line_needs_a_job(capsys):
    from pulsegrid.__main__ import main

    with pytest.raises(SystemExit):
        main([])


def test_halves_and_verifier(spark):
    from pulsegrid.operators.methods import verified

    second, first = runner.halved(spark.createDataFrame([(i * 3, i % 2) for i in range(7)], "item long, y int"))
    assert sorted(r["item"] for r in first.collect()) == [0, 3, 6] and sorted(r["item"] for r in second.collect()) == [9, 12, 15, 18]
    decisions = spark.createDataFrame([(i, "pipeline", 0, i / 10, i >= 5) for i in range(10)], "item long, method string, pred int, confidence double, accept boolean")
    truth = spark.createDataFrame([(i, 1) for i in range(10)], "item long, y int")
    got = {r["item"]: r for r in verified(decisions, truth, budget=0.2).collect()}
    assert [i for i, r in got.items() if r["verified"]] == [0, 1] and (got[0]["pred"], got[0]["accept"]) == (1, True) and got[2]["accept"] is False and got[9]["pred"] == 0


def test_windows_of_many_series_never_share_an_id(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for f in range(3):
        (tmp_path / "in" / f"s{f}.csv").write_text("timestamp,value,is_anomaly\n" + "".join(f"{i},{f * 10_000 + i},0\n" for i in range(1205)))
    assert runner.preprocess_anomaly(spark, str(tmp_path / "in"), str(tmp_path / "out"), size=1)["windows"] == 3 * 1205
    rows = spark.read.parquet(str(tmp_path / "out" / "yahoo" / "windows")).collect()
    assert len({r["window_id"] for r in rows}) == len(rows) == 3615 and all(len(r["values"]) == 1 for r in rows)


def test_progress(spark):
    from pulsegrid.plans.progress import Progress

    lines = []
    with Progress(spark, lines.append, every_s=0.05):
        spark.range(1 << 22).selectExpr("sum(hash(id))").collect()
    assert lines and lines[-1].endswith("done")
