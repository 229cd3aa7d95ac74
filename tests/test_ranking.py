from pyspark.sql import functions as F

from pulsegrid.operators import ranking


def test_rank_equals_sort(spark):
    df = spark.range(1000).select("id", (F.col("id") * 37 % 11).alias("v"))
    order = [F.desc("v"), F.col("id")]
    got = {r["rank"]: r["id"] for r in ranking.with_global_rank(df, order).collect()}
    want = [i for _, i in sorted((-(i * 37 % 11), i) for i in range(1000))]
    assert [got[k] for k in range(1000)] == want


def test_first_rows(spark, monkeypatch):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("v"))
    order = [F.desc("v"), F.col("id")]
    small = {r["id"] for r in ranking.first_rows(df, order, 120).collect()}
    monkeypatch.setattr(ranking, "HEAP_ROWS", 10)
    assert {r["id"] for r in ranking.first_rows(df, order, 120).collect()} == small and len(small) == 120
    assert ranking.first_rows(df.limit(0), order, 20).count() == 0


def test_quantiles_and_running_sums(spark):
    import numpy as np
    import pytest

    from pulsegrid.operators.ranking import quantile, running_sums

    x = np.round(np.random.default_rng(0).normal(0, 1, 300), 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    for q in (0.0, 0.05, 0.5, 0.9, 1.0):
        assert quantile(df, "v", q).first()[0] == pytest.approx(np.quantile(x, q), abs=1e-12)
    assert quantile(df.limit(0), "v", 0.5).first()[0] is None and quantile(df.where("v is null"), "v", 0.5).first()[0] is None
    rows = running_sums(spark.createDataFrame([(i, i % 5) for i in range(100)], "i int, n long"), [F.desc("i")], {"n": "k"}).collect()
    assert {r["i"]: r["k"] for r in rows} == {i: sum(j % 5 for j in range(i, 100)) for i in range(100)}
