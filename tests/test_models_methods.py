import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from pulsegrid.operators import methods, models
from pulsegrid.plans import bindings, engine


def direct_em(votes, k, rounds):
    """Row by row, without collapsing patterns."""
    n, m = votes.shape
    prior, acc = np.log(np.full(k, 1 / k)), np.full(m, 0.7)
    for _ in range(rounds):
        post = np.zeros((n, k))
        for i in range(n):
            z = prior.copy()
            for j in range(m):
                for c in range(k):
                    p = 1 / k if votes[i, j] < 0 else acc[j] if votes[i, j] == c else (1 - acc[j]) / (k - 1)
                    z[c] += np.log(p + 1e-6)
            e = np.exp(z - z.max())
            post[i] = e / (e.sum() + 1e-6)
        for j in range(m):
            seen = votes[:, j] >= 0
            if seen.any():
                acc[j] = np.clip(post[seen, votes[seen, j]].mean(), 1 / k + 1e-6, 1 - 1e-6)
        prior = np.log(post.mean(axis=0) + 1e-6)
    return post, acc


@pytest.mark.parametrize("k", [2, 5])
def test_label_model(spark, k):
    rng = np.random.default_rng(k)
    y = rng.integers(0, k, 80)
    votes = np.where(rng.random((80, 3)) < 0.7, y[:, None], rng.integers(0, k, (80, 3)))
    votes[rng.random((80, 3)) < 0.2] = -1
    votes[:3] = -1
    rows = [(i, j, None if votes[i, j] < 0 else int(votes[i, j])) for i in range(80) for j in range(3)]
    out, acc = models.label_model(spark.createDataFrame(rows, "item long, lf_idx int, vote int"), [0, 1, 2], k, rounds=10)
    post, want = direct_em(votes, k, 10)
    got = np.array([r["posterior"] for r in out.orderBy("item").collect()])
    assert np.allclose(got, post, atol=1e-9)
    assert np.allclose([r["accuracy"] for r in acc.orderBy("lf_idx").collect()], want, atol=1e-9)


def test_source_that_always_abstains(spark):
    rows = [(i, j, 1 if j == 0 else None) for i in range(5) for j in range(2)]
    out, acc = models.label_model(spark.createDataFrame(rows, "item long, lf_idx int, vote int"), [0, 1], 2)
    assert {r["pred"] for r in out.collect()} == {1} and acc.where("lf_idx = 1").first()["accuracy"] == 0.7


def test_calibrator(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(p), float(1 - p), float(p), 0.1, int(p > 0.9), 1, bool(rng.random() < p)) for i, p in enumerate(rng.random(300))]
    df = spark.createDataFrame(rows, "item long, plurality double, entropy double, conf_mean double, conf_std double, unanimous int, aligned int, correct boolean")
    got = np.array([(r["plurality"], r["score"]) for r in models.Calibrator().fit(df).score(df).collect()])
    assert np.corrcoef(got.T)[0, 1] > 0.8 and got[:, 1].min() >= 0 and got[:, 1].max() <= 1
    one = models.Calibrator().fit(df.where("correct"))
    assert {r["score"] for r in one.score(df).collect()} == {1.0}


def test_nearest_blocks(spark):
    rng = np.random.default_rng(1)
    base, q = rng.normal(size=(40, 4)), rng.normal(size=(9, 4))
    base[7] = base[3]
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "g long, x array<double>")
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "i long, x array<double>")
    want = {(i, r + 1): int(g) for i in range(9) for r, g in enumerate(np.lexsort((np.arange(40), ((base - q[i]) ** 2).sum(1)))[:3])}
    for block in (1000, 11):
        assert {(r["i"], r["rank"]): r["g"] for r in models.nearest(a, "i", b, "g", "x", 3, block).collect()} == want


def test_kmeanspp():
    x = np.r_[np.zeros((20, 2)), np.ones((1, 2)) * 9]
    assert 20 in models.kmeanspp_pick(x, 2) and models.kmeanspp_pick(x, 99).tolist() == list(range(21))
    assert len(models.kmeanspp_pick(np.zeros((10, 2)), 5)) == 1


def test_draws_of_a_round_follow_kmeanspp():
    x, start = np.array([[0.0], [1.0], [1.5], [4.0]]), np.array([0.0, 1.0, 2.25, 16.0])
    want, got, rng = np.zeros((4, 4)), np.zeros((4, 4)), np.random.default_rng(3)
    for a in range(1, 4):
        left = np.minimum(start, ((x - x[a]) ** 2).ravel())
        want[a] = start[a] / start.sum() * left / left.sum()
    runs = 20_000
    for _ in range(runs):
        t = np.r_[np.inf, rng.exponential(size=3) / start[1:]]
        at = np.flatnonzero(t <= 1e3)
        pair = models.d2_draws(x[at], start[at], t[at], 1e3, 2, rng)
        got[at[pair[0]], at[pair[1]]] += 1 / runs
    assert np.abs(got - want).max() < 0.015


def test_large_tables_are_seeded_as_a_whole(spark):
    few = spark.range(6000).selectExpr("id AS item", "array(double(id % 3), 0D) AS x")
    assert sorted(r["item"] % 3 for r in models.diverse_subset(few, "item", "x", 0.5).collect()) == [0, 1, 2]
    x = np.random.default_rng(5).normal(size=(5000, 3)) * np.where(np.arange(5000) % 50, 0.01, 1.0)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, x array<double>")
    got = [r["item"] for r in models.diverse_subset(df, "item", "x", 0.02).collect()]
    assert len(got) == len(set(got)) == 100
    left = lambda at: ((x[:, None] - x[None, at]) ** 2).sum(axis=2).min(axis=1).sum()
    whole = np.mean([left(models.kmeanspp_pick(x, 100, seed)) for seed in range(10)])
    assert 0.75 * whole < left(got) < 1.25 * whole


def test_whiten(spark):
    x = np.random.default_rng(2).normal(3, 2, (20, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, f array<double>")
    got = np.array([r["f"] for r in models.whiten(df, df.where("i < 10"), "f", "i").orderBy("i").collect()])
    assert np.allclose(got, (x - x[:10].mean(0)) / (x[:10].std(0) + 1e-6))


def test_predictor_with_one_class(spark):
    df = spark.createDataFrame([([1.0, 2.0], 3)], "features array<double>, y int")
    assert models.FeaturePredictor(5).fit(df).predict(df).first()["pred"] == 3


@pytest.mark.parametrize("name", [m for m in methods.METHODS if m != "llmaa"])
def test_methods_share_a_schema(spark, sf, name):
    ctx = bindings.context(spark, sf)
    out = methods.METHODS[name](ctx)
    assert out.columns == ["item", "method", "pred", "confidence", "accept"]
    rows = out.collect()
    assert len(rows) == 500 and all(0 <= r["pred"] < 10 and 0 <= r["confidence"] <= 1 + 1e-9 for r in rows)


def test_coverage_falls_with_alpha(spark, sf):
    shares = [methods.pipeline(bindings.context(spark, sf, a), False).agg(F.avg(F.col("accept").cast("int"))).first()[0] for a in (0.02, 0.1, 0.5)]
    assert shares == sorted(shares)


def test_demonstrations(spark, sf):
    rows = methods.demo_prefix(methods.llmaa_neighbours(bindings.context(spark, sf)), [f"c{i}" for i in range(10)]).take(1)
    assert rows[0]["prefix"].count("\n") == 2 and rows[0]["prefix"].startswith("Example 1: label ")


@pytest.mark.parametrize("name", ["q_m2_predictor", "q_m4_downstream"])
def test_registered_forests_are_whole(spark, sf, monkeypatch, name):
    trees = []
    monkeypatch.setattr(models, "RandomForestClassifier", lambda **kw: trees.append(kw["numTrees"]) or RandomForestClassifier(**kw | {"numTrees": 2}))
    engine.QUERIES[name](spark, sf).collect()
    assert trees == [200]


def test_label_model_queries_are_fitted(spark, sf):
    rows = bindings.votes(spark, sf).where(F.col("view_idx").isin(*methods.LF_VIEWS)).orderBy("item", "view_idx").collect()
    post, acc = direct_em(np.array([r["label"] for r in rows]).reshape(-1, 3), bindings.CLASSES, 50)
    got = engine.QUERIES["q_m5_posterior_fitted"](spark, sf).orderBy("item", "k").collect()
    assert np.allclose(np.array([r["q"] for r in got]).reshape(-1, bindings.CLASSES), post, atol=1e-6)
    assert np.allclose([r["accuracy"] for r in engine.QUERIES["q_a30_source_accuracy_fitted"](spark, sf).orderBy("lf_idx").collect()], acc, atol=1e-6)
