"""Risk, coverage, cost and F1 of decisions, and tests between methods."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def risk_coverage(decisions: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """(by, n_accepted, risk, coverage); decisions have pred, y, accept. Without accepted items risk is 0."""
    a = F.col("accept")
    return decisions.groupBy(*by).agg(
        F.sum(F.when(a, 1).otherwise(0)).cast("bigint").alias("n_accepted"),
        F.coalesce(F.avg(F.when(a, F.when(F.col("pred") != F.col("y"), 1.0).otherwise(0.0))), F.lit(0.0)).alias("risk"),
        F.avg(F.when(a, 1.0).otherwise(0.0)).alias("coverage"),
    )


def normalised_cost(n: Column, rejected: Column, views: int = 12, c_llm: float = 0.1, unit: float = 1.0) -> Column:
    return F.when(n == 0, 0.0).otherwise((n * views * c_llm * unit + rejected * unit) / F.greatest(n * unit, F.lit(1e-9)))


def cost(decisions: DataFrame, by: Sequence[str] = ("method",), **kw) -> DataFrame:
    n, rejected = F.count(F.lit(1)), F.sum(F.when(F.col("accept"), 0).otherwise(1))
    return decisions.groupBy(*by).agg(normalised_cost(n, rejected, **kw).alias("cost"))


def class_counts(decisions: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """(by, k, tp, fp, fn) over the union of labels seen as truth or prediction."""
    sides = F.array(F.struct(F.col("y").alias("k"), F.lit(0).alias("side")), F.struct(F.col("pred").alias("k"), F.lit(1).alias("side")))
    hit = (F.col("pred") == F.col("y")).cast("int")
    long = decisions.select(*by, hit.alias("hit"), F.inline(sides))
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    return long.groupBy(*by, "k").agg(count((F.col("side") == 0) & (F.col("hit") == 1)).alias("tp"), count((F.col("side") == 1) & (F.col("hit") == 0)).alias("fp"), count((F.col("side") == 0) & (F.col("hit") == 0)).alias("fn"))


def macro_f1(decisions: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    f = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return class_counts(decisions, by).groupBy(*by).agg(F.avg(f).alias("f1"))


def all_metrics(decisions: DataFrame, by: Sequence[str] = ("method",), accepted_f1: bool = True, **kw) -> DataFrame:
    """(by, n_accepted, risk, coverage, cost, f1); F1 over accepted items (0 if there are none)."""
    keys = list(by)
    f1 = macro_f1(decisions.where("accept") if accepted_f1 else decisions, by)
    return risk_coverage(decisions, by).join(cost(decisions, by, **kw), keys).join(f1, keys, "left").withColumn("f1", F.coalesce("f1", F.lit(0.0)))


def compliance(metrics: DataFrame, alpha: float, by: Sequence[str] = ("method",)) -> DataFrame:
    """(by, compliance): 'k/n' of seeds whose risk is at most alpha."""
    return metrics.groupBy(*by).agg(F.concat(F.sum((F.col("risk") <= alpha).cast("int")).cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")).alias("compliance"))


def accuracy(decisions: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    return decisions.groupBy(*by).agg(F.avg((F.col("pred") == F.col("y")).cast("int")).alias("accuracy"))


def paired(per_seed: DataFrame, target: str) -> DataFrame:
    """(method, seed, diff): the target's value less another method's on the same seed."""
    t = per_seed.where(F.col("method") == target).select("seed", F.col("value").alias("__t"))
    return per_seed.where(F.col("method") != target).join(t, "seed").select("method", "seed", (F.col("__t") - F.col("value")).alias("diff"))


def sign_test(pairs: DataFrame) -> DataFrame:
    """(method, statistic, p_value, n_pairs): two-sided sign test on non-zero differences, exact binomial."""
    counts = pairs.groupBy("method").agg(F.sum((F.col("diff") != 0).cast("bigint")).alias("n"), F.sum((F.col("diff") > 0).cast("bigint")).alias("k"))
    i = F.sequence(F.lit(0), F.least("k", F.col("n") - F.col("k")).cast("int"))
    log_choose = lambda n, j: F.aggregate(F.when(j > 0, F.sequence(F.lit(1), j)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, m: a + F.log((n - j + m) / m))
    tail = F.aggregate(i, F.lit(0.0), lambda a, j: a + F.exp(log_choose(F.col("n"), j) - F.col("n") * math.log(2)))
    return counts.select("method", F.col("k").cast("double").alias("statistic"), F.when(F.col("n") == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)).alias("p_value"), F.col("n").alias("n_pairs"))


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """(method, w_plus, w_minus, n_pairs): rank sums of positive and negative differences, ties sharing their mean rank."""
    live = pairs.where("diff <> 0").withColumn("a", F.abs("diff"))
    order = Window.partitionBy("method").orderBy("a")
    ranked = live.withColumn("r", F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy("method", "a")) - 1) / 2)
    part = lambda cond: F.sum(F.when(cond, F.col("r")).otherwise(0.0))
    return ranked.groupBy("method").agg(part(F.col("diff") > 0).alias("w_plus"), part(F.col("diff") < 0).alias("w_minus"), F.count(F.lit(1)).alias("n_pairs"))


def wilcoxon_p(w: float, n: int, exact_to: int = 50, tied: bool = False) -> float:
    """Two-sided p-value of the smaller rank sum: exact for untied samples up to exact_to, normal otherwise."""
    if n == 0:
        return 1.0
    if n <= exact_to and not tied:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    mean, sd = n * (n + 1) / 4, math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return min(1.0, math.erfc(abs(w - mean) / sd / math.sqrt(2)))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """(method, statistic, p_value, n_pairs) of the paired signed-rank test; one row per method, p-values on the driver's
    formula over one small row per method."""
    rows = pairs.select("method").distinct().join(signed_ranks(pairs), "method", "left")

    @F.udf("double")
    def p(w, n, tied):
        return 1.0 if not n else wilcoxon_p(w, n, tied=bool(tied))

    ties = pairs.where("diff <> 0").groupBy("method").agg((F.countDistinct(F.abs("diff")) < F.count(F.lit(1))).alias("tied"))
    out = rows.join(ties, "method", "left").withColumn("statistic", F.coalesce(F.least("w_plus", "w_minus"), F.lit(0.0)))
    return out.select("method", "statistic", p("statistic", "n_pairs", "tied").alias("p_value"), F.coalesce("n_pairs", F.lit(0)).cast("bigint").alias("n_pairs"))


def holm(tests: DataFrame, p: str = "p_value", key: str = "method") -> DataFrame:
    """tests with p_holm: the step-down adjusted p-value, capped at 1. One row per compared method."""
    order = Window.orderBy(p, key)
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    scaled = tests.withColumn("__s", (m - F.row_number().over(order) + 1) * F.col(p))
    return scaled.withColumn("p_holm", F.least(F.lit(1.0), F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__s")


def against(per_seed: DataFrame, target: str) -> DataFrame:
    """Pairwise significance of the target against every other method; KeyError if the target has no rows."""
    if per_seed.where(F.col("method") == target).isEmpty():
        raise KeyError(target)
    return holm(wilcoxon(paired(per_seed, target)))
