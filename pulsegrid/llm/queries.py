"""Queries of the language-model problems (1, 2, 4, 8, 9, 10), each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.consensus import consensus, label_of, votes_of
from pulsegrid.llm.language import identify, mislabelled
from pulsegrid.llm.leakage import find_leaks, leaked_items
from pulsegrid.llm.mixing import in_sequence, mix_sources
from pulsegrid.llm.pairs import flag_pairs, main_defects
from pulsegrid.llm.splits import components, deal, torn_groups, tree_links
from pulsegrid.session import materialize, spread, table


def _documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *more), "doc_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "raw_trace").select("trace_id", "prompt", "response")
    return main_defects(flag_pairs(rows), "trace_id")


def p1_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "raw_trace").select("trace_id", "prompt", "response")
    return flag_pairs(rows).select("trace_id", F.explode_outer("defects").alias("defect")).where("defect is not null")


def _consensus(spark: SparkSession, sf_dir: str):
    trace = table(spark, sf_dir, "raw_trace").select("trace_id", "ts", "sample_id", "view_id", "attempt", "response")
    return consensus(votes_of(trace, "sample_id", "view_id", label_of(F.col("response")), [F.col("attempt"), F.col("ts"), F.col("trace_id")]))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir)[0].select(F.col("item").alias("sample_id"), "label")


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir)[0].withColumnRenamed("item", "sample_id")


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir)[1].withColumnRenamed("annotator", "view_id")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "window_index"), "stay_id", table(spark, sf_dir, "stay_moves"), "from_stay_id", "to_stay_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = (
        table(spark, sf_dir, "splits")
        .select("window_id", F.lower(F.trim("split")).alias("split"))
        .where(F.col("split").isin("gold", "unlabeled", "test"))
        .join(table(spark, sf_dir, "window_index").select("window_id", "stay_id"), "window_id")
        .select("stay_id", "split")
        .distinct()
    )
    return torn_groups(listed.join(_groups(spark, sf_dir), "stay_id"), "root", "split").select(F.col("root").alias("stay_id"))


def p4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_links(table(spark, sf_dir, "stay_moves"), "from_stay_id", "to_stay_id").groupBy("root").agg(F.count(F.lit(1)).alias("links"))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "window_index").select("window_id", "stay_id").join(_groups(spark, sf_dir), "stay_id", "left")
    windows = materialize(windows, "windows")
    sizes = materialize(windows.groupBy("root").agg(F.count(F.lit(1)).alias("windows")), "sizes")
    dealt = deal(sizes, "root", "windows", table(spark, sf_dir, "split_targets"), "split_name", "share")
    return windows.join(dealt.select("root", "split"), "root").select("window_id", "stay_id", F.col("root").alias("group_id"), "split")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = p4_splits(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("group_id").alias("groups"))
    whole = got.agg(F.sum("windows").alias("__all"))
    goals = table(spark, sf_dir, "split_targets").select(F.col("split_name").alias("split"), "share")
    return goals.join(got, "split", "left").withColumn("__all", whole.scalar()).select("split", "share", "groups", "windows", (F.col("windows") / F.col("__all")).alias("actual_share"))


def _languages(spark: SparkSession, sf_dir: str, segments: bool) -> DataFrame:
    return identify(_documents(spark, sf_dir, "lang"), "doc_id", "lang", "text", with_segments=segments)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mislabelled(_languages(spark, sf_dir, False), "doc_id")


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _languages(spark, sf_dir, True)
    return found.select("doc_id", F.inline("segments")).select("doc_id", "start", "length", "lang", "confidence")


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir, False)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_documents(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_leaks(spark, sf_dir), "item_id", "doc_id")


def _mix(spark: SparkSession, sf_dir: str, total: str | None = None, target_entropy: str | None = None):
    return mix_sources(_documents(spark, sf_dir, "source"), "doc_id", "source", "text", table(spark, sf_dir, "mix_targets"), total=total, target_entropy=target_entropy)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the target sources hold: the repetition limits bind and the weights are tempered."""
    return _mix(spark, sf_dir, "all")[0]


def p9_tempered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir, "all")[1]


def p9_tempered_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tempered mixture laid out: a row per copy with its place."""
    return in_sequence(_mix(spark, sf_dir, "all")[0], "doc_id")


def p9_entropy_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural token shares tempered to the entropy of the target shares."""
    return _mix(spark, sf_dir, None, "targets")[1]


QUERIES = {f.__name__: f for f in (p1_found, p1_defects, p2_found, p2_agreement, p2_reliability, p4_found, p4_forest, p4_splits, p4_shares, p8_found, p8_items, p9_mixture, p9_shares, p9_tempered, p9_tempered_shares, p9_tempered_sequence, p9_entropy_shares, p10_found, p10_segments, p10_documents)}

SQL = {
    "p4_forest": """
WITH RECURSIVE e AS (
  SELECT from_stay_id AS a, to_stay_id AS b FROM stay_moves WHERE from_stay_id <> to_stay_id
  UNION SELECT to_stay_id, from_stay_id FROM stay_moves WHERE from_stay_id <> to_stay_id
), reach(a, b) AS (
  SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a
)
SELECT root, count(*) - 1 AS links FROM (SELECT a, min(b) AS root FROM reach GROUP BY 1) GROUP BY 1
""",
    "p4_found": """
WITH RECURSIVE e AS (
  SELECT from_stay_id AS a, to_stay_id AS b FROM stay_moves WHERE from_stay_id IS NOT NULL AND to_stay_id IS NOT NULL
  UNION SELECT to_stay_id, from_stay_id FROM stay_moves WHERE from_stay_id IS NOT NULL AND to_stay_id IS NOT NULL
), reach(a, b) AS (
  SELECT DISTINCT stay_id, stay_id FROM window_index WHERE stay_id IS NOT NULL
  UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a
), roots AS (
  SELECT r.a AS stay_id, min(r.b) AS root FROM reach r WHERE r.b IN (SELECT stay_id FROM window_index) GROUP BY 1
)
SELECT root AS stay_id FROM splits s JOIN window_index w USING (window_id) JOIN roots g ON g.stay_id = w.stay_id
WHERE lower(trim(s.split)) IN ('gold', 'unlabeled', 'test') GROUP BY root HAVING count(DISTINCT lower(trim(s.split))) > 1
""",
}
