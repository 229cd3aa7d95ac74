import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.operators import gate, metrics, votes


def table(spark, labels, item=1):
    return [(item, v, int(x), 0.5 + v / 100) for v, x in enumerate(labels)]


SCHEMA = "item long, view_idx int, label int, confidence double"


def test_disagreement(spark):
    rows = table(spark, [2] * 12, 1) + table(spark, [3] * 6 + [1] * 6, 2) + table(spark, [5] + [4] * 11, 3) + table(spark, [7], 4)
    got = {r["item"]: r for r in votes.disagreement(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1]["pred"], got[1]["unanimous"], got[1]["aligned"]) == (2, 1, 1)
    assert (got[2]["pred"], got[2]["plurality"], got[2]["aligned"]) == (1, 0.5, 0)
    assert got[2]["entropy"] == pytest.approx(-math.log(0.5 + 1e-9))
    assert (got[3]["pred"], got[3]["unanimous"], got[3]["aligned"]) == (4, 0, 0)
    assert (got[4]["pred"], got[4]["plurality"], got[4]["conf_std"]) == (7, 1.0, 0.0)
    assert votes.disagreement(spark.createDataFrame([], SCHEMA)).count() == 0


def test_top_by_value(spark):
    df = spark.createDataFrame([(i, float(i // 2)) for i in range(10)], "k long, v double")
    assert [r["k"] for r in votes.top_by_value(df, "k", "v", 0.3).collect()] == [8, 9, 6]
    assert votes.top_by_value(df, "k", "v", 0.01).count() == 1 and votes.top_by_value(df.limit(0), "k", "v", 0.5).count() == 0


def scores(spark, rows):
    return spark.createDataFrame([(i, float(s), bool(c)) for i, (s, c) in enumerate(rows)], "item long, score double, correct boolean")


def test_conformal(spark):
    nine = [(0.5, False)] * 9 + [(0.9, True)] * 5
    assert gate.conformal_threshold(scores(spark, nine)).first()[0] == 1.0
    ten = [(i / 10, False) for i in range(10)]
    assert gate.conformal_threshold(scores(spark, ten), 0.1).first()[0] == pytest.approx(np.quantile([i / 10 for i in range(10)], 0.9))
    taus = [gate.conformal_threshold(scores(spark, ten), a).first()[0] for a in (0.05, 0.2, 0.5)]
    assert taus == sorted(taus, reverse=True)


def brute_bernstein(rows, alpha, delta=0.05):
    tau = 1.0
    for s in sorted({r[0] for r in rows}, reverse=True):
        errs = [0.0 if c else 1.0 for v, c in rows if v >= s]
        k = len(errs)
        if k < 10:
            continue
        var = np.var(errs, ddof=1)
        if np.mean(errs) + math.sqrt(2 * var * math.log(1 / delta) / k) + 7 * math.log(1 / delta) / (3 * max(k - 1, 1)) > alpha:
            break
        tau = s
    return tau


def test_bernstein(spark):
    rows = [(1.0, True)] * 150 + [(0.9, True)] * 20 + [(0.8, False)] * 30
    for alpha in (0.05, 0.3, 0.8):
        assert gate.bernstein_threshold(scores(spark, rows), alpha).first()[0] == brute_bernstein(rows, alpha)


def test_confidence_threshold(spark):
    gold = spark.createDataFrame([(1, 0.96, True), (2, 0.9, False), (3, 0.6, True)], "item long, confidence double, correct boolean")
    assert gate.confidence_threshold(gold).first()[0] == 0.95
    assert gate.confidence_threshold(gold.where("confidence < 0.95")).first()[0] == 0.95
    assert gate.confidence_threshold(gold.where("correct and confidence < 0.95")).first()[0] == 0.6


def test_verifier(spark):
    df = spark.createDataFrame([(1, 0.9, 10.0), (2, 0.5, 0.0), (3, 0.1, 100.0)], "item long, score double, token_cost double")
    assert [r["item"] for r in gate.verification_set(df).collect()] == [2]
    assert gate.verification_set(df.limit(0)).count() == 0


def test_metrics(spark):
    rows = [("a", 1, 1, True), ("a", 2, 1, True), ("a", 1, 2, False), ("b", 1, 1, False)]
    m = {r["method"]: r for r in metrics.all_metrics(spark.createDataFrame(rows, "method string, pred int, y int, accept boolean")).collect()}
    assert (m["a"]["risk"], m["a"]["coverage"]) == (0.5, pytest.approx(2 / 3))
    assert m["a"]["cost"] == pytest.approx(1.2 + 1 / 3) and m["a"]["f1"] == pytest.approx((2 / 3 + 0) / 2)
    assert (m["b"]["risk"], m["b"]["coverage"], m["b"]["f1"]) == (0.0, 0.0, 0.0) and m["b"]["cost"] == pytest.approx(2.2)


def test_wilcoxon_exact():
    assert metrics.wilcoxon_p(0, 5) == pytest.approx(2 / 32) and metrics.wilcoxon_p(0, 0) == 1.0
    assert metrics.wilcoxon_p(3, 6) == pytest.approx(2 * 5 / 64)


def per_seed(spark, **kw):
    return spark.createDataFrame([(m, s, float(v)) for m, vs in kw.items() for s, v in enumerate(vs)], "method string, seed int, value double")


def test_tests_between_methods(spark):
    df = per_seed(spark, t=[1, 2, 3, 4, 5], a=[0, 0, 0, 0, 0], b=[1, 2, 3, 4, 5], c=[2, 1, 5, 9, 0])
    got = {r["method"]: r for r in metrics.against(df, "t").collect()}
    assert got["a"]["p_value"] == pytest.approx(2 / 32) and got["b"]["p_value"] == 1.0 and got["b"]["n_pairs"] == 0
    assert all(r["p_holm"] >= r["p_value"] for r in got.values())
    with pytest.raises(KeyError):
        metrics.against(df, "missing")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=6))
def test_holm_is_monotone(spark, ps):
    df = spark.createDataFrame([(f"m{i}", p) for i, p in enumerate(ps)], "method string, p_value double")
    rows = sorted(metrics.holm(df).collect(), key=lambda r: (r["p_value"], r["method"]))
    adj = [r["p_holm"] for r in rows]
    assert adj == sorted(adj) and all(0 <= r["p_value"] <= r["p_holm"] <= 1 for r in rows)


def test_sign_test(spark):
    df = spark.createDataFrame([("a", s, d) for s, d in enumerate([1.0, 1.0, 1.0, 1.0, -1.0, 0.0])] + [("z", 0, 0.0)], "method string, seed int, diff double")
    got = {r["method"]: r for r in metrics.sign_test(df).collect()}
    assert got["a"]["p_value"] == pytest.approx(2 * 6 / 32) and got["z"]["p_value"] == 1.0 and got["a"]["n_pairs"] == 5
