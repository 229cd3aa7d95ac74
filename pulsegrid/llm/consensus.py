"""Problem 2: consensus from several annotators' labels.

Triplet moment method. For annotators i, j, k who err independently, the chance-corrected agreement rates factor into
c_ij = b_i b_j, so b_i^2 = c_ij c_ik / c_jk; the median over all pairs (j, k) gives each b_i without any true label, and a
share of correct answers a_i = (1 + (K - 1) b_i) / K. The first consensus adds log-odds weights ln(a_i (K - 1) / (1 - a_i)).
Annotators who err in a direction of their own (a constant answer, swapped classes) or together with others get their
weights per answer: in `rounds` further passes the log-odds of each answer under each class come from its joint moments
with the consensus, and annotators whose agreement exceeds what their answers explain share one weight.

Only moments reach the driver: per round (annotators x classes)^2 sums at most, for at most max_annotators annotators.

Defined results
* Rows without item, annotator or label, and labels outside 0 … K - 1, are no votes. Items without any vote have no label.
* Several votes of one annotator on one item count once: the latest by `order`, equal ones by the smaller label.
* Ties go to the smaller class index. A single annotator is believed; with fewer than three, all weigh alike.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.pairs import CLASSES, LABEL
from pulsegrid.session import materialize


def label_of(response: Column, classes: Sequence[str] = CLASSES) -> Column:
    """The class index an answer gives as number, text or class name; NULL without one or beyond the classes."""
    raw = F.lower(F.regexp_extract(response, LABEL, 1))
    named = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    index = F.coalesce(raw.try_cast("int"), F.try_element_at(named, raw))
    return F.when((index >= 0) & (index < len(classes)), index)


def votes_of(df: DataFrame, item: str, annotator: str, label: Column, order: Sequence[Column]) -> DataFrame:
    """(item, annotator, label), one row per item and annotator."""
    named = df.select(F.col(item).alias("item"), F.col(annotator).alias("annotator"), label.cast("int").alias("label"), F.struct(*order).alias("__o"))
    kept = named.where("item is not null and annotator is not null and label is not null")
    return kept.groupBy("item", "annotator").agg(F.max_by("label", F.struct("__o", -F.col("label"))).alias("label"))


def _dense(pdf: pd.DataFrame, v: int, k: int) -> np.ndarray:
    """Votes of a batch of items as an (items, annotators, classes) indicator."""
    x = np.zeros((len(pdf), v, k), np.float64)
    if len(pdf):
        row = np.repeat(np.arange(len(pdf)), [len(p) for p in pdf["places"]])
        x[row, np.concatenate(pdf["places"].to_list()), np.concatenate(pdf["labels"].to_list())] = 1.0
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sum_moments(items: DataFrame, moment, names: list[str]) -> dict[str, np.ndarray]:
    """Sum arrays over all partitions: each partition adds up its own, then one small aggregation per cell."""

    def part(batches):
        total = None
        for pdf in batches:
            m = moment(pdf)
            total = m if total is None else {n: total[n] + m[n] for n in names}
        if total is not None:
            for n in names:
                flat = total[n].ravel()
                at = np.flatnonzero(flat)
                yield pd.DataFrame({"name": n, "at": at, "x": flat[at]})

    return items.mapInPandas(part, "name string, at bigint, x double").groupBy("name", "at").agg(F.sum("x").alias("x"))


def _collect(sums: DataFrame, shapes: dict[str, tuple]) -> dict[str, np.ndarray]:
    out = {n: np.zeros(s) for n, s in shapes.items()}
    for r in sums.toLocalIterator():
        out[r["name"]].flat[r["at"]] = r["x"]
    return out


def triplet_accuracies(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(b, a) per annotator, (agreement, corrected agreement) per pair, from joint counts J[i, l, j, m] on common items."""
    v, k = joint.shape[0], joint.shape[1]
    common = np.maximum(joint.sum(axis=(1, 3)), 1e-9)
    agree = np.einsum("iljl->ij", joint) / common
    margin = joint.sum(axis=3).transpose(0, 2, 1) / common[:, :, None]  # share of answer l of i on items common with j
    chance = np.einsum("ijl,jil->ij", margin, margin)
    c = (agree - chance) / np.maximum(1 - chance, 1e-9)
    b = np.zeros(v)
    if v < 3:
        b[:] = 0.5
        return b, (1 + (k - 1) * b) / k, agree, c
    for i in range(v):
        others = [j for j in range(v) if j != i]
        ratios = [c[i, j] * c[i, m] / c[j, m] for n, j in enumerate(others) for m in others[n + 1 :] if abs(c[j, m]) > 0.02]
        size = np.sqrt(max(np.median(ratios), 0.0)) if ratios else 0.0
        b[i] = size * np.sign(np.median(c[i, others]))
    return b, np.clip((1 + (k - 1) * b) / k, 1e-3, 1 - 1e-3), agree, c


def consensus(votes: DataFrame, classes: int = len(CLASSES), rounds: int = 2, max_annotators: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, annotators, agreement per pair of annotators) from votes_of().

    labels: item, label, confidence, n_votes, agreement (the share of votes for the label). annotators: annotator, accuracy
    (triplet estimate), reliability (share of its votes equal to the consensus), skill (b_i), n_votes."""
    spark, k = votes.sparkSession, classes
    items = materialize(votes.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("annotator", "label"))).alias("votes")), "votes")
    names = sorted(r[0] for r in items.select(F.explode("votes.annotator")).distinct().limit(max_annotators + 1).collect())
    if len(names) > max_annotators:
        raise ValueError(f"more than {max_annotators} annotators")
    place = {a: i for i, a in enumerate(names)}
    v = len(names)
    listed = F.array(*[F.lit(a) for a in names]).cast(f"array<{dict(votes.dtypes)['annotator']}>")
    items = items.select("item", F.transform("votes.annotator", lambda a: (F.array_position(listed, a) - 1).cast("int")).alias("places"), F.col("votes.label").alias("labels"))
    label_schema = f"item {dict(votes.dtypes)['item']}, label bigint, confidence double, n_votes int, agreement double"
    note_schema = f"annotator {dict(votes.dtypes)['annotator']}, accuracy double, reliability double, skill double, n_votes bigint"
    kind = dict(votes.dtypes)["annotator"]
    pair_schema = f"annotator_a {kind}, annotator_b {kind}, agreement double, corrected double"
    if not v:
        return spark.createDataFrame([], label_schema), spark.createDataFrame([], note_schema), spark.createDataFrame([], pair_schema)

    def pairs(pdf):
        x = _dense(pdf, v, k).reshape(len(pdf), v * k)
        return {"joint": x.T @ x}

    joint = _collect(_sum_moments(items, pairs, ["joint"]), {"joint": (v * k, v * k)})["joint"].reshape(v, k, v, k)
    skill, accuracy, agree, corrected = triplet_accuracies(joint)
    counts = np.einsum("ilil->i", joint)
    odds = np.where(skill > 0.02, np.log(accuracy * (k - 1) / (1 - accuracy)), 0.0)
    if not odds.any():
        odds = np.ones(v)
    weights = np.stack([max(w, 0.0) * np.eye(k) for w in odds])  # [annotator, answer, class]
    prior = np.zeros(k)

    for _ in range(rounds):

        def refine(pdf, weights=weights, prior=prior):
            x = _dense(pdf, v, k)
            q = _softmax(np.einsum("nvl,vlk->nk", x, weights) + prior)
            return {"conf": np.einsum("nk,nvl->vkl", q, x), "mass": q.sum(axis=0), "both": np.einsum("nk,ni,nj->ijk", q, x.sum(2), x.sum(2))}

        m = _collect(_sum_moments(items, refine, ["conf", "mass", "both"]), {"conf": (v, k, k), "mass": (k,), "both": (v, v, k)})
        p = (m["conf"] + 0.5) / (m["conf"] + 0.5).sum(axis=2, keepdims=True)  # P(answer | class)
        prior = np.log((m["mass"] + 0.5) / (m["mass"] + 0.5).sum())
        expected = np.einsum("ikl,jkl,ijk->ij", p, p, m["both"]) / np.maximum(m["both"].sum(axis=2), 1e-9)
        shared = np.clip((agree - expected) / np.maximum(1 - expected, 1e-9) - 0.05, 0, None)
        np.fill_diagonal(shared, 0)
        logp = np.log(p).transpose(0, 2, 1)
        weights = (logp - logp.mean(axis=2, keepdims=True)) / (1 + shared.sum(axis=1))[:, None, None]

    def decide(batches, weights=weights, prior=prior):
        for pdf in batches:
            x = _dense(pdf, v, k)
            q = _softmax(np.einsum("nvl,vlk->nk", x, weights) + prior)
            best = np.round(q, 9).argmax(axis=1)
            n = x.sum(axis=(1, 2))
            mine = x[np.arange(len(x)), :, best].sum(axis=1)
            yield pd.DataFrame({"item": pdf["item"], "label": best, "confidence": q[np.arange(len(q)), best], "n_votes": n.astype(np.int32), "agreement": mine / n})

    labels = items.mapInPandas(decide, label_schema)

    def hits(batches, weights=weights, prior=prior):
        for pdf in batches:
            x = _dense(pdf, v, k)
            best = np.round(_softmax(np.einsum("nvl,vlk->nk", x, weights) + prior), 9).argmax(axis=1)
            yield pd.DataFrame({"at": np.arange(v), "hit": x[np.arange(len(x)), :, best].sum(axis=0)})

    hit = {r["at"]: r["hit"] for r in items.mapInPandas(hits, "at int, hit double").groupBy("at").agg(F.sum("hit").alias("hit")).collect()}
    rows = [(a, float(accuracy[i]), float(hit.get(i, 0.0) / max(counts[i], 1)), float(skill[i]), int(counts[i])) for a, i in place.items()]
    annotators = spark.createDataFrame(rows, note_schema)
    measure = [(names[i], names[j], float(agree[i, j]), float(corrected[i, j])) for i in range(v) for j in range(i + 1, v)]
    return labels, annotators, spark.createDataFrame(measure, pair_schema)
