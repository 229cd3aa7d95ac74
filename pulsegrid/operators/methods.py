"""Labelers: each gives decisions (item, method, pred, confidence, accept) from the same tables.

ctx holds: votes (item, view_idx, label, confidence), gold (item, y), classes, and what some methods need on top: single
(view outputs of one call at temperature 0), features (item, features), costs (item, token_cost), and call, which makes further
calls: call(items with an optional prefix, (view_idx, variant, temperature), nonce) gives (item, label, confidence). Without
call, relabel (outputs of a second, warmer call) or the warm view of the votes stands in for a second call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import gate, models, votes
from pulsegrid.session import materialize


@dataclass
class Context:
    votes: DataFrame
    gold: DataFrame
    classes: int
    single: DataFrame | None = None
    features: DataFrame | None = None
    relabel: DataFrame | None = None
    alpha: float = 0.05
    item: str = "item"
    costs: DataFrame | None = None
    call: Callable[[DataFrame, tuple[int, str, float], str | None], DataFrame] | None = None
    names: tuple[str, ...] = ()


def _decide(df: DataFrame, method: str, accept=None, item: str = "item") -> DataFrame:
    accept = F.lit(True) if accept is None else accept
    return df.select(item, F.lit(method).alias("method"), F.col("pred").cast("int").alias("pred"), F.col("confidence").cast("double").alias("confidence"), accept.alias("accept"))


def _single(ctx: Context) -> DataFrame:
    one = ctx.single if ctx.single is not None else ctx.votes.where("view_idx = 4")
    return one.select(ctx.item, F.col("label").alias("pred"), "confidence")


def _with_truth(df: DataFrame, ctx: Context) -> DataFrame:
    return df.join(ctx.gold.select(ctx.item, "y"), ctx.item).withColumn("correct", F.col("pred") == F.col("y"))


def pipeline(ctx: Context, calibrated: bool = True) -> DataFrame:
    """All views, disagreement features, calibrated score (or plain vote share), conformal threshold on gold."""
    signals = materialize(votes.disagreement(ctx.votes, ctx.item), "signals")
    known = _with_truth(signals, ctx)
    if calibrated:
        model = models.Calibrator().fit(known)
        scored, gold = model.score(signals), model.score(known)
    else:
        scored, gold = signals.withColumn("score", F.col("plurality")), known.withColumn("score", F.col("plurality"))
    taken = gate.accept(scored, gate.conformal_threshold(gold, ctx.alpha))
    return _decide(taken.withColumn("confidence", F.col("score")), "pipeline", F.col("accept"), ctx.item)


def full_llm(ctx: Context) -> DataFrame:
    return _decide(_single(ctx), "full_llm", item=ctx.item)


def self_consistency(ctx: Context) -> DataFrame:
    return _decide(votes.majority(ctx.votes, ctx.item).withColumnRenamed("share", "confidence"), "self_consistency", item=ctx.item)


def confidence_threshold(ctx: Context) -> DataFrame:
    one = _single(ctx)
    tau = gate.confidence_threshold(_with_truth(one, ctx), "confidence", ctx.alpha)
    return _decide(gate.accept(one, tau, "confidence"), "confidence_threshold", F.col("accept"), ctx.item)


def conformal_llm(ctx: Context) -> DataFrame:
    one = _single(ctx)
    q = gate.conformal_quantile(one.join(ctx.gold.select(ctx.item), ctx.item, "left_semi"), "confidence", ctx.alpha)
    return _decide(one.withColumn("q", q.scalar()), "conformal_llm", F.coalesce((1 - F.col("confidence")) <= F.col("q"), F.lit(False)), ctx.item)


#: The views at temperature 0, one per prompt variant.
LF_VIEWS = (0, 4, 8)


def _lf_votes(ctx: Context, least_confidence: float | None = None) -> DataFrame:
    rows = ctx.votes.where(F.col("view_idx").isin(*LF_VIEWS))
    vote = F.col("label") if least_confidence is None else F.when(F.col("confidence") >= least_confidence, F.col("label"))
    return rows.select(ctx.item, F.col("view_idx").alias("lf_idx"), vote.alias("vote"))


def snorkel_style(ctx: Context) -> DataFrame:
    return _decide(models.label_model(_lf_votes(ctx), LF_VIEWS, ctx.classes, ctx.item)[0], "label_model", item=ctx.item)


def badge(ctx: Context, share: float = 0.70) -> DataFrame:
    signals = materialize(votes.disagreement(ctx.votes, ctx.item), "signals")
    embedded = materialize(models.badge_embedding(votes.vote_counts(ctx.votes, ctx.item), signals, ctx.classes, ctx.item), "badge")
    chosen = models.diverse_subset(embedded, ctx.item, "embedding", share).withColumn("__in", F.lit(True))
    return _decide(embedded.join(chosen, ctx.item, "left"), "badge", F.coalesce("__in", F.lit(False)), ctx.item)


def prompted_ws(ctx: Context, least_confidence: float = 0.6) -> DataFrame:
    return _decide(models.label_model(_lf_votes(ctx, least_confidence), LF_VIEWS, ctx.classes, ctx.item)[0], "prompted_ws", item=ctx.item)


def free_al(ctx: Context, share: float = 0.20) -> DataFrame:
    """Labels from one call train a task model on features; where its entropy is highest, a second call overrides."""
    base = _single(ctx)
    rows = ctx.features.join(base.select(ctx.item, F.col("pred").alias("y")), ctx.item)
    model = models.FeaturePredictor(ctx.classes, "logistic").fit(rows)
    p = model.predict(ctx.features)
    entropy = F.aggregate("proba", F.lit(0.0), lambda a, x: a - x * F.log(x + F.lit(1e-9)))
    again = votes.refresh_set(p.select(ctx.item, entropy.alias("entropy")), ctx.item, share)
    if ctx.call is not None:
        fresh = ctx.call(again.select(ctx.item), (6, "standard", 0.7), "relabel")
    else:
        fresh = ctx.relabel if ctx.relabel is not None else ctx.votes.where("view_idx = 6")
    fresh = fresh.select(ctx.item, F.col("label").alias("pred"), "confidence").join(again.select(ctx.item), ctx.item, "left_semi")
    return _decide(votes.override(base, fresh, ctx.item), "free_al", item=ctx.item)


def llmaa_neighbours(ctx: Context, k: int = 3) -> DataFrame:
    """(item, demos): the labels of the k nearest gold items in whitened features, nearest first, for the prompt."""
    gold = ctx.features.join(ctx.gold.select(ctx.item, "y"), ctx.item)
    white = models.whiten(ctx.features, gold, "features", ctx.item)
    base = models.whiten(gold, gold, "features", ctx.item)
    near = models.nearest(white, ctx.item, base.withColumnRenamed(ctx.item, "gold_item"), "gold_item", "features", k)
    named = near.join(ctx.gold.select(F.col(ctx.item).alias("gold_item"), "y"), "gold_item")
    return named.groupBy(ctx.item).agg(F.sort_array(F.collect_list(F.struct("rank", "y"))).alias("d")).select(ctx.item, F.transform("d", lambda s: s["y"]).alias("demos"))


def demo_prefix(demos: DataFrame, classes: list[str], item: str = "item") -> DataFrame:
    """(item, prefix): a line per demonstration, to be put before a summary."""
    names = F.array(*[F.lit(c) for c in classes])
    return demos.select(item, F.array_join(F.transform("demos", lambda y, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(": label "), y.cast("string"), F.lit(" ("), F.get(names, y), F.lit(")"))), "\n").alias("prefix"))


def llmaa(ctx: Context) -> DataFrame:
    """One call at temperature 0 with the nearest gold items' labels as demonstrations before the summary."""
    names = list(ctx.names) or [f"class_{i}" for i in range(ctx.classes)]
    if ctx.call is None:
        return _decide(_single(ctx), "llmaa", item=ctx.item)
    asked = demo_prefix(llmaa_neighbours(ctx), names, ctx.item)
    return _decide(ctx.call(asked, (4, "standard", 0.0), None).select(ctx.item, F.col("label").alias("pred"), "confidence"), "llmaa", item=ctx.item)


def verified(decisions: DataFrame, truth: DataFrame, costs: DataFrame | None = None, budget: float = 0.18, item: str = "item") -> DataFrame:
    """Decisions after a person has looked at the budgeted share of the rejected items that is worth most per cost: their
    predictions become the truth, they are accepted, and `verified` tells them apart."""
    cost = decisions.join(costs, item, "left") if costs is not None else decisions.withColumn("token_cost", F.lit(1.0))
    open_ = cost.select(item, F.col("confidence").alias("score"), F.coalesce("token_cost", F.lit(1.0)).alias("token_cost"), "accept")
    picked = gate.verification_set(open_, item, budget=budget).select(item).withColumn("__picked", F.lit(True))
    met = decisions.join(picked, item, "left").join(truth.select(item, F.col("y").alias("__y")), item, "left")
    seen = F.coalesce("__picked", F.lit(False)) & F.col("__y").isNotNull() & ~F.col("accept")
    return met.select(item, "method", F.when(seen, F.col("__y")).otherwise(F.col("pred")).alias("pred"), "confidence", (F.col("accept") | seen).alias("accept"), seen.alias("verified"))


METHODS = {f.__name__: f for f in (pipeline, full_llm, self_consistency, confidence_threshold, conformal_llm, snorkel_style, badge, prompted_ws, free_al, llmaa)}
