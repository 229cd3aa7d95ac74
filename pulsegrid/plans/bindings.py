"""How the driver's tables stand for the engine's inputs, in Spark and as SQL fragments with the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import labeling, windowing
from pulsegrid.operators.methods import Context
from pulsegrid.registry import CLINICAL_CHANNELS, PROMPT_VARIANTS, TEMPERATURES
from pulsegrid.session import table

SIZE, CLASSES = 16, 10
VIEWS = [(i, v, t) for i, (v, t) in enumerate((v, t) for v in PROMPT_VARIANTS for t in TEMPERATURES)]


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")


def day_of(ts: str):
    return F.unix_date(F.col(ts).cast("date"))


def windows(spark: SparkSession, sf: str, size: int = SIZE) -> DataFrame:
    """Events as full windows of 16 per user: (user_id, window_no, pos, ts, value, event_type)."""
    return windowing.count_windows(events(spark, sf), "user_id", "ts", size, day_of("ts"))


KEYS = ["user_id", "window_no"]

WINDOWS = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS rn FROM events
), cut AS (
  SELECT *, rn // 16 AS window_no, CAST(rn % 16 AS INTEGER) AS pos, count(*) OVER (PARTITION BY user_id, rn // 16) AS n FROM ranked
), w AS (
  SELECT event_id, user_id, ts, event_type, value, window_no, pos FROM cut WHERE n = 16
)"""


def arrays(spark: SparkSession, sf: str, size: int = SIZE) -> DataFrame:
    """(user_id, window_no, values) of the event windows."""
    packed = windows(spark, sf, size).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("p"))
    return packed.select(*KEYS, F.transform("p", lambda s: s["value"]).alias("values"))


def window_table(spark: SparkSession, sf: str, size: int = SIZE) -> DataFrame:
    """The event windows as a windows table with the value and its running total as two channels."""
    a = arrays(spark, sf, size)
    total = F.transform("values", lambda x, i: F.aggregate(F.slice("values", 1, i + 1), F.lit(0.0), lambda s, v: s + v))
    channels = F.array(F.struct(F.lit(0).alias("channel_idx"), F.lit("ABP").alias("channel"), F.col("values")), F.struct(F.lit(1).alias("channel_idx"), F.lit("level").alias("channel"), total.alias("values")))
    return a.select(F.lit("events").alias("dataset"), (F.col("user_id") * 100_000 + F.col("window_no")).alias("window_id"), F.inline(channels))


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve votes on each embedding's label by integer arithmetic: (item, y, view_idx, label, confidence, gold)."""
    i, v, y = F.col("item"), F.col("v"), F.col("y")
    base = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("v"))
    err = F.when((i * 37) % 100 < 25, 55).otherwise(8) + v
    wrong = (i * 31 + v * 47 + i * v * 7 + (i * i) % 89) % 100 < err
    return base.select("item", "y", F.col("v").alias("view_idx"), F.when(wrong, (y + 1) % CLASSES).otherwise(y).cast("int").alias("label"), (0.5 + ((i * 7 + v * 11) % 50) / 100.0).alias("confidence"), (i % 3 == 0).alias("gold"))


VOTES = """votes AS (
  SELECT item, y, view_idx, CAST(CASE WHEN (item * 31 + v * 47 + item * v * 7 + (item * item) % 89) % 100 < (CASE WHEN (item * 37) % 100 < 25 THEN 55 ELSE 8 END) + v
      THEN (y + 1) % 10 ELSE y END AS INTEGER) AS label, CAST(0.5 AS DOUBLE) + CAST((item * 7 + v * 11) % 50 AS DOUBLE) / 100 AS confidence, item % 3 = 0 AS gold
  FROM (SELECT CAST(vec_id AS BIGINT) AS item, CAST(label AS INTEGER) AS y, CAST(r.range AS BIGINT) AS v, CAST(r.range AS INTEGER) AS view_idx FROM embeddings, range(12) r)
)"""

COUNTS = VOTES + """, counts AS (
  SELECT item, label, count(*) AS n, count(*) / 12.0::DOUBLE AS share FROM votes GROUP BY 1, 2
), top AS (
  SELECT item, label AS pred, share FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, label) AS r FROM counts) WHERE r = 1
), truth AS (SELECT DISTINCT item, y, gold FROM votes), scores AS (
  SELECT item, pred, share AS score, y, gold, pred = y AS correct FROM top JOIN truth USING (item)
)"""


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where(F.col("vec_id") % 3 == 0).select(F.col("vec_id").alias("item"), F.col("label").cast("int").alias("y"))


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").cast("int").alias("y"))


def share_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(item, pred, score, y, gold, correct) with the plurality share as score."""
    from pulsegrid.operators.votes import majority

    top = majority(votes(spark, sf)).withColumnRenamed("share", "score")
    return top.join(truth(spark, sf), "item").withColumns({"gold": F.col("item") % 3 == 0, "correct": F.col("pred") == F.col("y")})


def context(spark: SparkSession, sf: str, alpha: float = 0.1) -> Context:
    feats = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("features"))

    def call(items: DataFrame, view: tuple[int, str, float], nonce: str | None) -> DataFrame:
        """Further calls, answered by the deterministic model that follows demonstrations."""
        prefix = [F.col("prefix")] if "prefix" in items.columns else []
        asked = items.select("item", F.concat_ws("\n", *prefix, F.concat(F.lit("recording "), F.col("item").cast("string"))).alias("summary"))
        outputs, _, _ = labeling.label_windows(asked, [view], [f"class_{i}" for i in range(CLASSES)], labeling.DemoModel(CLASSES))
        return outputs.select("item", "label", "confidence")

    return Context(votes(spark, sf).select("item", "view_idx", "label", "confidence"), gold(spark, sf), CLASSES, features=feats, alpha=alpha, call=call)


VITALS = list(CLINICAL_CHANNELS)


def bins(spark: SparkSession, sf: str) -> DataFrame:
    """charts as 60-minute windows of minute means per stay."""
    return windowing.bin_channels(table(spark, sf, "charts"), "stay_id", "charttime", VITALS)


BINS = (
    """clean AS (
  SELECT stay_id, CAST(floor(charttime / 60) AS BIGINT) AS bin, """
    + ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in VITALS)
    + """ FROM charts WHERE stay_id IS NOT NULL AND charttime IS NOT NULL AND NOT isnan(charttime)
), means AS (
  SELECT stay_id, bin, """
    + ", ".join(f"avg({c}) AS {c}" for c in VITALS)
    + """ FROM clean GROUP BY 1, 2
), spans AS (
  SELECT stay_id, min(bin) AS b0, (max(bin) - min(bin) + 1) // 60 AS nw FROM means GROUP BY 1
), grid AS (
  SELECT stay_id, b0, unnest(range(0, nw * 60)) AS k FROM spans WHERE nw > 0
), bins AS (
  SELECT g.stay_id, k // 60 AS window_no, CAST(k % 60 AS INTEGER) AS pos, """
    + ", ".join(f"m.{c}" for c in VITALS)
    + """ FROM grid g LEFT JOIN means m ON m.stay_id = g.stay_id AND m.bin = g.b0 + g.k
)"""
)


def r6(name: str):
    return (F.round(F.col(name), 6) + F.lit(0.0)).alias(name)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(c) if c in names else F.col(c) for c in df.columns])
