"""End-to-end jobs: preprocessing to windows, and a comparison of labelers with metrics and tests."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import registry
from pulsegrid.functions import dsp
from pulsegrid.operators import labeling, methods, metrics, models, windowing
from pulsegrid.operators.ranking import with_global_rank
from pulsegrid.plans.progress import Progress
from pulsegrid.session import materialize
from pulsegrid.sources import series, waveform
from pulsegrid.sources.llm_cache import usage
from pulsegrid.sources.manifest import Manifest


def _write(windows: DataFrame, labels: DataFrame, root: str, name: str, gold: int, seed: int) -> dict[str, int]:
    windows, labels = materialize(windows, "windows"), materialize(labels, "labels")
    n = labels.count()
    if not n:
        raise SystemExit("no windows: nothing to write")
    splits = windowing.ranked_split(labels, "window_id", F.pmod(F.xxhash64("window_id", F.lit(seed)), F.lit(1 << 40)), gold)
    series.write_dataset({"windows": windows, "labels": labels, "splits": splits}, root, name)
    return {"windows": n, "positive": labels.where("y <> 0").count()}


def _numbered(keys: DataFrame, *names: str) -> DataFrame:
    """(names, window_id): the distinct keys by number, in their order. Numbers never collide, whatever the keys."""
    return with_global_rank(keys.select(*names).distinct(), [F.col(n) for n in names], "window_id")


def preprocess_clinical(charts: DataFrame, diagnoses: DataFrame, root: str, gold: int = 500, seed: int = 0, bins: int = 60, missing: float = 0.10) -> dict[str, int]:
    """Charts and diagnoses to windows of minute means, gated by missingness, gaps filled forward, labelled by stay."""
    channels = list(registry.CLINICAL_CHANNELS)
    binned = materialize(windowing.bin_channels(charts, "stay_id", "charttime", channels, 60.0, bins), "bins")
    kept = windowing.missing_gate(binned, ["stay_id", "window_no"], channels, missing).select("stay_id", "window_no")
    filled = windowing.fill_forward(binned.join(kept, ["stay_id", "window_no"], "left_semi"), ["stay_id", "window_no"], channels)
    numbered = materialize(_numbered(kept, "stay_id", "window_no"), "numbers")
    packed = windowing.long_channels(filled.join(numbered, ["stay_id", "window_no"]), ["window_id", "pos"], channels).groupBy("window_id", "channel_idx", "channel").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("p"))
    windows = packed.select(F.lit("mimic").alias("dataset"), "window_id", "channel_idx", "channel", F.transform("p", lambda s: s["value"]).alias("values"))
    labels = windowing.label_stays(kept, "stay_id", windowing.stay_labels(diagnoses, "stay_id", "ord", "icd_category", registry.CLINICAL_CLASSES)).join(numbered, ["stay_id", "window_no"]).select("window_id", "y")
    return _write(windows, labels, root, "mimic", gold, seed)


def preprocess_alarm(spark: SparkSession, path: str, root: str, task: str = "binary", gold: int = 500, seed: int = 0) -> dict[str, int]:
    """Waveform records to windows; labels are the alarm's truth (binary) or its kind (multiclass)."""
    records = materialize(waveform.read_records(spark, path), "records")
    label = F.first("truth") if task == "binary" else F.first(windowing.record_class(F.col("record_id"), registry.RECORD_PREFIXES))
    known = records.groupBy("record_id").agg(label.alias("y")).where("y is not null")
    cut = materialize(waveform.record_windows(records).join(known, "record_id"), "cut")
    cut = cut.join(_numbered(cut, "record_id", "window_no"), ["record_id", "window_no"])
    name = "physionet_binary" if task == "binary" else "physionet"
    windows = cut.select(F.lit(name).alias("dataset"), "window_id", "channel_idx", "channel", "values")
    return _write(windows, cut.select("window_id", F.col("y").cast("int").alias("y")).distinct(), root, name, gold, seed)


def preprocess_anomaly(spark: SparkSession, path: str, root: str, size: int = 3600, gold: int = 500, seed: int = 0) -> dict[str, int]:
    """Univariate CSV series to windows of `size` rows per file, labelled by any flag inside."""
    rows = series.read_series_files(spark, path)
    cut = windowing.count_windows(rows, "series_id", "row_no", size, F.floor(F.col("row_no") / 65536))
    packed = materialize(cut.groupBy("series_id", "window_no").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("p"), F.max("flag").alias("y")), "series")
    packed = packed.join(_numbered(packed, "series_id", "window_no"), ["series_id", "window_no"])
    windows = packed.select(F.lit("yahoo").alias("dataset"), "window_id", F.lit(0).alias("channel_idx"), F.lit("value").alias("channel"), F.transform("p", lambda s: s["value"]).alias("values"))
    return _write(windows, packed.select("window_id", "y"), root, "yahoo", gold, seed)


def build_context(spark: SparkSession, name: str, root: str, llm: Callable[[str, float], str], alpha: float = 0.05, fs: float = 250.0, with_hint: bool = False, threads: int = 8):
    """(context over gold and test windows, truth, trace) of a preprocessed dataset: summaries, twelve views, features.

    With a hint, gold is halved by position: the first half trains the predictor behind the hint, the second one calibrates
    scores and thresholds, so that nothing is fitted on what the hint has seen. Token costs of an item are those of its calls."""
    data = registry.DATASETS[name]
    classes = data.classes
    windows = series.load_dataset(spark, name, root)
    splits = spark.read.parquet(f"{root.rstrip('/')}/{name}/splits").where("split in ('gold', 'test')")
    used = materialize(windows.join(splits, "window_id"), "used")
    truth = materialize(used.select(F.col("window_id").alias("item"), "y", "split").distinct(), "truth")
    feats = materialize(dsp.features(used, fs).select(F.col("window_id").alias("item"), "features"), "features")
    texts = dsp.summaries(used, fs).select(F.col("window_id").alias("item"), "summary")
    gold = truth.where("split = 'gold'").select("item", "y")
    if with_hint:
        gold, training = halved(gold)
        predictor = models.FeaturePredictor(len(classes)).fit(feats.join(training, "item"))
        hints = predictor.predict(feats).select("item", labeling.hint_column(F.col("proba"), classes).alias("h"))
        texts = texts.join(hints, "item").select("item", F.concat_ws("\n", "summary", "h").alias("summary"))
    texts = materialize(texts, "texts")
    views = [(i, v, t) for i, (v, t) in enumerate((v, t) for v in registry.PROMPT_VARIANTS for t in registry.TEMPERATURES)]
    outputs, _, trace = labeling.label_windows(texts, views, classes, llm, threads=threads)
    votes = materialize(outputs.select("item", "view_idx", "label", "confidence"), "votes")

    def call(items: DataFrame, view: tuple[int, str, float], nonce: str | None) -> DataFrame:
        prefix = [F.col("prefix")] if "prefix" in items.columns else []
        asked = texts.join(items, "item").select("item", F.concat_ws("\n", *prefix, "summary").alias("summary"))
        asked = asked.withColumn("nonce", F.lit(nonce)) if nonce else asked
        answers, _, _ = labeling.label_windows(asked, [view], classes, llm, nonce="nonce" if nonce else None, threads=threads)
        return answers.select("item", "label", "confidence")

    costs = texts.select("item", (F.length("summary") / 4.0 * len(views)).alias("token_cost"))
    ctx = methods.Context(votes, gold, len(classes), features=feats, alpha=alpha, costs=costs, call=call, names=tuple(classes))
    return ctx, truth, trace


def halved(gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(second half, first half) of the gold items in their order; the first half has one item at least."""
    placed = materialize(with_global_rank(gold, [F.col("item")], "__at"), "gold")
    middle = max(1, placed.count() // 2)
    return placed.where(F.col("__at") >= middle).drop("__at"), placed.where(F.col("__at") < middle).drop("__at")


def compare(ctx: methods.Context, truth: DataFrame, names: Sequence[str] | None = None, seed: int = 0) -> DataFrame:
    """(method, seed, n_accepted, risk, coverage, cost, f1) of each method over the test items."""
    test = truth.where("split = 'test'").select("item", "y")
    out = None
    for name in names or list(methods.METHODS):
        d = methods.METHODS[name](ctx).join(test, "item")
        out = d if out is None else out.unionByName(d)
    return metrics.all_metrics(out).withColumn("seed", F.lit(seed))


def demo(spark: SparkSession, name: str, root: str, out: str, llm: Callable[[str, float], str] | None = None, alpha: float = 0.05, names: Sequence[str] | None = None, fs: float = 250.0, with_hint: bool = True, budget: float = 0.18, report: Callable[[str], None] | None = None) -> list[dict]:
    """Run the comparison, write metrics as JSON lines and a manifest, and return the metrics.

    Half of gold feeds the hints, the other half the thresholds; what the pipeline rejects goes through the verifier within its
    budget, with the outcome in verified.json. report gets a line of progress now and then."""
    log = Manifest(Path(out), {"dataset": name, "alpha": alpha, "hint": with_hint, "budget": budget}, spark).start().add_dataset(root, name)
    with Progress(spark, report):
        ctx, truth, trace = build_context(spark, name, root, llm or labeling.RuleModel(len(registry.DATASETS[name].classes)), alpha, fs, with_hint)
        rows = [r.asDict() for r in compare(ctx, truth, names).orderBy("method").collect()]
        test = truth.where("split = 'test'").select("item", "y")
        looked = methods.verified(methods.pipeline(ctx).join(test.select("item"), "item", "left_semi"), test, ctx.costs, budget)
        after = looked.join(test, "item").agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("verified").cast("int")).alias("verified"), F.avg(F.col("accept").cast("int")).alias("coverage"), F.coalesce(F.avg(F.when(F.col("accept"), (F.col("pred") != F.col("y")).cast("int"))), F.lit(0.0)).alias("risk")).first()
    result, verified = Path(out) / "metrics.json", Path(out) / "verified.json"
    result.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    verified.write_text(json.dumps(after.asDict()) + "\n")
    log.add_usage(usage(trace).first().asDict()).add_results([result, verified]).done()
    return rows
