import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm.consensus import consensus, label_of, triplet_accuracies, votes_of

SCHEMA = "item long, annotator int, label int"


def simulate(n=1500, k=5, acc=(0.9, 0.8, 0.7, 0.6, 0.85), seed=0):
    rng = np.random.default_rng(seed)
    y = rng.choice(k, n, p=np.r_[0.4, np.full(k - 1, 0.6 / (k - 1))])
    wrong = (y[:, None] + rng.integers(1, k, (n, len(acc)))) % k
    return y, np.where(rng.random((n, len(acc))) < np.array(acc), y[:, None], wrong), rng


def rows(votes, keep=None):
    return [(i, j, int(v)) for i, r in enumerate(votes) for j, v in enumerate(r) if keep is None or keep[i, j]]


def test_triplets_recover_accuracy():
    y, v, _ = simulate(20000)
    x = (v[:, :, None] == np.arange(5)).reshape(len(v), -1).astype(float)
    acc = triplet_accuracies((x.T @ x).reshape(5, 5, 5, 5))[1]
    assert np.abs(acc - [0.9, 0.8, 0.7, 0.6, 0.85]).max() < 0.03


def test_consensus_beats_majority_with_odd_annotators(spark):
    y, v, rng = simulate()
    v = np.column_stack([v, np.zeros(len(y), int), (v[:, 0] + 2) % 5])  # a constant one and a swapper
    shared = np.where(rng.random(len(y)) < 0.45, y, (y + 1) % 5)
    v = np.column_stack([v, *[np.where(rng.random(len(y)) < 0.9, shared, rng.integers(0, 5, len(y))) for _ in range(3)]])  # a clique
    keep = rng.random(v.shape) < 0.9
    labels, notes, pairs = consensus(spark.createDataFrame(rows(v, keep), SCHEMA), 5)
    got = {r["item"]: r["label"] for r in labels.collect()}
    counts = np.stack([((v == c) & keep).sum(axis=1) for c in range(5)], axis=1)
    mine = np.mean([got[i] == y[i] for i in got])
    assert mine > np.mean(counts.argmax(axis=1) == y) + 0.02 and mine > 0.95
    note = {r["annotator"]: r for r in notes.collect()}
    assert note[0]["accuracy"] > note[3]["accuracy"] and abs(note[5]["skill"]) < 0.1 and len(note) == 10
    assert pairs.count() == 45


@pytest.mark.parametrize(("data", "want"), [([], {}), ([(1, 0, 3)], {1: 3}), ([(1, 0, 3), (1, 1, 2)], {1: 2}), ([(1, 0, 1), (1, 1, 1), (2, 0, 4), (2, 1, 4)], {1: 1, 2: 4})])
def test_few_annotators(spark, data, want):
    labels, notes, _ = consensus(spark.createDataFrame(data, SCHEMA), 5)
    assert {r["item"]: r["label"] for r in labels.collect()} == want and notes.count() == len({a for _, a, _ in data})


def test_votes(spark):
    data = [(1, 0, '{"label": 2}', 1), (1, 0, '{"label": "infection"}', 2), (1, 1, "Label: 9", 1), (1, 2, None, 1), (None, 0, "label: 1", 1), (2, None, "label: 1", 1), (2, 0, "no answer", 1), (3, 0, "Label: 0, sure", 1), (3, 0, "Label: 0, sure", 1), (4, 0, '{"label": null}', 1)]
    df = spark.createDataFrame(data, "item long, view int, response string, attempt int").withColumn("label", F.lit("clash"))
    got = sorted(map(tuple, votes_of(df, "item", "view", label_of(F.col("response")), [F.col("attempt")]).collect()))
    assert got == [(1, 0, 6), (3, 0, 0)]


def test_too_many_annotators(spark):
    with pytest.raises(ValueError):
        consensus(spark.createDataFrame([(1, a, 0) for a in range(5)], SCHEMA), 2, max_annotators=4)
