"""Queries of the engine's own operators over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import registry
from pulsegrid.functions import dsp, parse, stats
from pulsegrid.operators import gate, labeling, methods, metrics, models, votes, windowing
from pulsegrid.operators.ranking import with_global_rank
from pulsegrid.plans import bindings as B
from pulsegrid.session import table
from pulsegrid.sources import llm_cache, series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def W(select: str, more: str = "") -> str:
    return f"WITH {B.WINDOWS}{more} {select}"


def R(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n.split('.')[-1]}" for n in names)


# ---- windows and their statistics -------------------------------------------------------------------------------------


@query(W("SELECT event_id, user_id, window_no, pos, value FROM w"))
def q_p4_windows(s, d):
    return B.windows(s, d).select("event_id", "user_id", "window_no", "pos", "value")


@query("SELECT user_id, count(*) AS rows, count(*) // 16 AS windows, count(*) % 16 AS dropped FROM events GROUP BY 1")
def q_p5_tail(s, d):
    return windowing.tail_rows(B.events(s, d), "user_id", B.SIZE)


@query(W("SELECT user_id, window_no, CAST(max(CASE WHEN value > 150 THEN 1 ELSE 0 END) AS INTEGER) AS label FROM w GROUP BY 1, 2"))
def q_p8_window_label(s, d):
    return windowing.window_flag(B.windows(s, d), B.KEYS, F.col("value") > 150)


@query(W(f"SELECT user_id, window_no, {R('mean', 'std', 'min', 'max')} FROM (SELECT user_id, window_no, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max FROM w GROUP BY 1, 2)"))
def q_a3_moments(s, d):
    return B.rounded(B.windows(s, d).groupBy(*B.KEYS).agg(*stats.moments(F.col("value"))), "mean", "std", "min", "max")


@query(W(f"SELECT user_id, window_no, {R('p25', 'p50', 'p75')} FROM (SELECT user_id, window_no, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75 FROM w GROUP BY 1, 2)"))
def q_a4_quartiles(s, d):
    return B.rounded(B.windows(s, d).groupBy(*B.KEYS).agg(*stats.quartiles(F.col("value"))), "p25", "p50", "p75")


@query(W(f"SELECT user_id, window_no, {R('slope', 'r2')} FROM (SELECT user_id, window_no, regr_slope(value, pos) AS slope, 1 - (regr_syy(value, pos) - regr_slope(value, pos) * regr_sxy(value, pos)) / (regr_syy(value, pos) + 1e-9) AS r2 FROM w GROUP BY 1, 2)"))
def q_a5_trend(s, d):
    return B.rounded(B.windows(s, d).groupBy(*B.KEYS).agg(*stats.trend(F.col("value"), F.col("pos"))), "slope", "r2")


_NEIGHBOURS = ", nb AS (SELECT *, lag(value) OVER x AS prev, lead(value) OVER x AS next, lag(value, 2) OVER x AS prev2 FROM w WINDOW x AS (PARTITION BY user_id, window_no ORDER BY pos))"


@query(W(f"SELECT user_id, window_no, {R('mean_abs_diff')} FROM (SELECT user_id, window_no, avg(abs(value - prev)) AS mean_abs_diff FROM nb GROUP BY 1, 2)", _NEIGHBOURS))
def q_a6_abs_diff(s, d):
    rich = stats.with_neighbours(B.windows(s, d), B.KEYS, "pos", "value")
    return B.rounded(rich.groupBy(*B.KEYS).agg(stats.mean_abs_diff(F.col("d1"))), "mean_abs_diff")


@query(W("SELECT user_id, window_no, CAST(sum(CASE WHEN value > prev AND value > next THEN 1 ELSE 0 END) AS BIGINT) AS peaks FROM nb GROUP BY 1, 2", _NEIGHBOURS))
def q_a7_peaks(s, d):
    rich = stats.with_neighbours(B.windows(s, d), B.KEYS, "pos", "value")
    return rich.groupBy(*B.KEYS).agg(stats.peak_count(F.col("value"), F.col("prev"), F.col("next")))


_SPECTRUM = """, bins AS (
  SELECT user_id, window_no, k, sum((value - m) * cos(2 * pi() * k * pos / 16)) AS re, sum((value - m) * sin(2 * pi() * k * pos / 16)) AS im
  FROM (SELECT *, avg(value) OVER (PARTITION BY user_id, window_no) AS m FROM w), (SELECT range AS k FROM range(9)) GROUP BY 1, 2, 3
), mag AS (SELECT *, sqrt(re * re + im * im) AS a, re * re + im * im AS p FROM bins)"""


@query(W(f"SELECT user_id, window_no, {R('centroid')} FROM (SELECT user_id, window_no, sum(k * a) / (sum(a) + 1e-9) AS centroid FROM mag GROUP BY 1, 2)", _SPECTRUM))
def q_a8_centroid(s, d):
    return B.rounded(B.arrays(s, d).select(*B.KEYS, dsp.centroid_udf()("values").alias("centroid")), "centroid")


@query(W("SELECT user_id, window_no, round(sum(CASE WHEN k < 1 THEN p ELSE 0 END) / sum(p), 6) + 0.0 AS b0, round(sum(CASE WHEN k >= 1 AND k < 3 THEN p ELSE 0 END) / sum(p), 6) + 0.0 AS b1, round(sum(CASE WHEN k >= 3 AND k < 5 THEN p ELSE 0 END) / sum(p), 6) + 0.0 AS b2, round(sum(CASE WHEN k >= 5 AND k < 7 THEN p ELSE 0 END) / sum(p), 6) + 0.0 AS b3, round(sum(CASE WHEN k >= 7 THEN p ELSE 0 END) / sum(p), 6) + 0.0 AS b4 FROM mag GROUP BY 1, 2", _SPECTRUM))
def q_a9_band_power(s, d):
    found = B.arrays(s, d).select(*B.KEYS, dsp.band_power_udf()("values").alias("b"))
    return found.select(*B.KEYS, *[(F.round(F.col("b")[i], 6) + F.lit(0.0)).alias(f"b{i}") for i in range(5)])


@query(W(f"""SELECT user_id, window_no, {R('artifact', 'flatline', 'saturation')} FROM (
  SELECT user_id, window_no, CASE WHEN max(sd) >= 1e-6 THEN avg(abs(value - 2 * prev + prev2)) ELSE 0.0 END AS artifact,
    CASE WHEN max(sd) >= 1e-6 THEN avg(CASE WHEN abs(value - p50) < 0.05 * sd THEN 1.0::DOUBLE ELSE 0 END) ELSE 0.0 END AS flatline,
    CASE WHEN max(sd) >= 1e-6 THEN avg(CASE WHEN value <= p1 OR value >= p99 THEN 1.0::DOUBLE ELSE 0 END) ELSE 0.0 END AS saturation
  FROM (SELECT *, stddev_pop(value) OVER y AS sd, quantile_cont(value, 0.01) OVER y AS p1, quantile_cont(value, 0.5) OVER y AS p50, quantile_cont(value, 0.99) OVER y AS p99 FROM nb WINDOW y AS (PARTITION BY user_id, window_no)) GROUP BY 1, 2)""", _NEIGHBOURS))
def q_a10_quality(s, d):
    return B.rounded(stats.quality(B.windows(s, d), B.KEYS, "pos", "value"), "artifact", "flatline", "saturation")


@query(W(f"""SELECT user_id, window_no, {R('rate', 'rr_mean', 'rr_std', 'rmssd')} FROM (
  SELECT n.user_id, n.window_no, 60.0 * coalesce(k, 0) / (n / 1.0) AS rate, coalesce(rr_mean, 0) AS rr_mean, coalesce(rr_std, 0) AS rr_std, coalesce(rmssd, 0) AS rmssd
  FROM (SELECT user_id, window_no, count(*) AS n FROM w GROUP BY 1, 2) n LEFT JOIN (
    SELECT user_id, window_no, count(*) AS k, avg(rr) AS rr_mean, stddev_pop(rr) AS rr_std, sqrt(avg(drr * drr)) AS rmssd FROM (
      SELECT *, rr - lag(rr) OVER z AS drr FROM (SELECT *, (pos - lag(pos) OVER z) * 1000.0::DOUBLE AS rr FROM nb WHERE value > prev AND value > next WINDOW z AS (PARTITION BY user_id, window_no ORDER BY pos))
      WINDOW z AS (PARTITION BY user_id, window_no ORDER BY pos)) GROUP BY 1, 2) p ON n.user_id = p.user_id AND n.window_no = p.window_no)""", _NEIGHBOURS))
def q_a12_intervals(s, d):
    return B.rounded(stats.peak_intervals(B.windows(s, d), B.KEYS, "pos", "value", 1.0), "rate", "rr_mean", "rr_std", "rmssd")


@query(W("SELECT event_id, round(value - prev, 6) + 0.0 AS d1, round(value - 2 * prev + prev2, 6) + 0.0 AS d2 FROM nb", _NEIGHBOURS))
def q_w2_differences(s, d):
    rich = stats.with_neighbours(B.windows(s, d), B.KEYS, "pos", "value")
    return B.rounded(rich.select("event_id", "d1", "d2"), "d1", "d2")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1) % 16 AS pos, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1) // 16 AS window_no FROM events")
def q_w3_position(s, d):
    from pulsegrid.operators.positions import with_position

    placed = with_position(B.events(s, d), ["user_id"], B.day_of("ts"), [F.col("ts")], "p")
    return placed.select("event_id", (F.col("p") % B.SIZE).alias("pos"), F.floor(F.col("p") / B.SIZE).alias("window_no"))


@query(W("""SELECT event_id, round(abs(rm - lm) + abs(rs - ls), 6) + 0.0 AS score FROM (
  SELECT event_id, avg(value) OVER r AS rm, avg(value) OVER l AS lm, stddev_pop(value) OVER r AS rs, stddev_pop(value) OVER l AS ls, count(*) OVER r AS rn, count(*) OVER l AS ln FROM w
  WINDOW l AS (PARTITION BY user_id, window_no ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY user_id, window_no ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE rn = 4 AND ln = 4"""))
def q_w4_block_shift(s, d):
    return B.rounded(stats.block_shift(B.windows(s, d), B.KEYS, "pos", "value", 4).select("event_id", "score"), "score")


@query(W("SELECT user_id, window_no, coalesce(stddev_pop(value) > 1e-6, false) AS present FROM w GROUP BY 1, 2"))
def q_p11_presence(s, d):
    return B.windows(s, d).groupBy(*B.KEYS).agg(windowing.is_present(F.col("value")).alias("present"))


@query()
def q_d1_change_points(s, d):
    return B.arrays(s, d, 32).select(*B.KEYS, dsp.change_points_udf(3, "cusum")("values").alias("cusum"), dsp.change_points_udf(3, "pelt")("values").alias("pelt"))


@query()
def q_d2_pulse_peaks(s, d):
    return B.arrays(s, d).select(*B.KEYS, dsp.peaks_udf(4.0)("values").alias("peaks"))


@query()
def q_d3_summaries(s, d):
    return dsp.summaries(B.window_table(s, d, 32), fs=4.0)


@query()
def q_d4_features(s, d):
    return dsp.features(B.window_table(s, d), fs=4.0)


# ---- reshaping ----------------------------------------------------------------------------------------------------------


@query("SELECT reading_id, CASE WHEN isnan(HR) OR isinf(HR) THEN 0.0 ELSE HR END AS HR, CASE WHEN isnan(SpO2) OR isinf(SpO2) THEN 0.0 ELSE SpO2 END AS SpO2 FROM charts")
def q_p2_scrub(s, d):
    return table(s, d, "charts").select("reading_id", windowing.scrub("HR").alias("HR"), windowing.scrub("SpO2").alias("SpO2"))


@query(W("""SELECT user_id, window_no, CAST(i AS INTEGER) AS i, round(a.value + (x - floor(x)) * (b.value - a.value), 6) + 0.0 AS v FROM (
  SELECT DISTINCT user_id, window_no, i, least(i * 4.0 / 10.0, 15.0)::DOUBLE AS x FROM w, (SELECT range AS i FROM range(40))) g
  JOIN w a USING (user_id, window_no) JOIN w b USING (user_id, window_no) WHERE a.pos = floor(x) AND b.pos = least(floor(x) + 1, 15)"""))
def q_p3_resample(s, d):
    up = B.arrays(s, d).select(*B.KEYS, F.posexplode(windowing.resample_linear(F.col("values"), F.lit(4.0), 10.0)).alias("i", "v"))
    return B.rounded(up, "v")


@query(W("SELECT user_id, window_no, CAST(i AS INTEGER) AS i, value AS v FROM w JOIN (SELECT range AS i, range * 15 // 4 AS p FROM range(5)) ON pos = p"))
def q_p12_strided(s, d):
    return B.arrays(s, d).select(*B.KEYS, F.posexplode(windowing.strided(F.col("values"), 5)).alias("i", "v"))


@query(W("SELECT user_id, window_no, CAST(pos // 3 AS INTEGER) AS i, value AS v FROM w WHERE pos % 3 = 0"))
def q_p13_decimate(s, d):
    return B.arrays(s, d).select(*B.KEYS, F.posexplode(windowing.decimate(F.col("values"), 6)).alias("i", "v"))


_LEADS = {"primary": ("PURCHASE", "signup"), "pulse": ("View", "CLICK"), "breath": ("missing",)}


@query("""WITH leads AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2),
alias(channel, alias, prio) AS (VALUES ('primary', 'PURCHASE', 0), ('primary', 'SIGNUP', 1), ('pulse', 'VIEW', 0), ('pulse', 'CLICK', 1), ('breath', 'MISSING', 0)),
found AS (SELECT user_id, channel, v FROM (SELECT user_id, channel, v, row_number() OVER (PARTITION BY user_id, channel ORDER BY prio) AS r FROM leads JOIN alias ON upper(event_type) = alias) WHERE r = 1)
SELECT u.user_id, c.channel, round(coalesce(f.v, 0), 6) + 0.0 AS v FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT channel FROM alias) c LEFT JOIN found f ON f.user_id = u.user_id AND f.channel = c.channel""")
def q_p1_channel_pick(s, d):
    leads = B.events(s, d).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return B.rounded(windowing.pick_channels(leads, "user_id", "event_type", _LEADS, "v").withColumn("v", F.coalesce("v", F.lit(0.0))), "v")


@query(W("SELECT DISTINCT user_id, window_no, concat_ws(', ', CASE WHEN max(value) > 0 THEN 'max=' || CAST(CAST(floor(max(value)) AS BIGINT) AS VARCHAR) END, CASE WHEN avg(value) > 40 THEN 'high' END, CASE WHEN min(value) > 5 THEN 'lifted' END) AS fields FROM w GROUP BY 1, 2"))
def q_p22_conditional_fields(s, d):
    top = F.concat(F.lit("max="), F.floor(F.max("value")).cast("string"))
    return B.windows(s, d).groupBy(*B.KEYS).agg(F.concat_ws(", ", F.when(F.max("value") > 0, top), F.when(F.avg("value") > 40, "high"), F.when(F.min("value") > 5, "lifted")).alias("fields"))


@query("SELECT channel, regexp_matches(upper(channel), 'ECG|ABP|PPG') AS clinical FROM (VALUES ('ECG_I'), ('ECG_II'), ('ABP'), ('PPG'), ('RESP')) t(channel)")
def q_p23_clinical_channels(s, d):
    return registry.channels_table(s).where("dataset = 'physionet'").select("channel", F.upper("channel").rlike("ECG|ABP|PPG").alias("clinical"))


@query("SELECT c_custkey, y FROM (SELECT c_custkey, CASE lower(substr(c_mktsegment, 1, 1)) WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 't' THEN 2 WHEN 'v' THEN 3 WHEN 'f' THEN 4 END AS y FROM customer) WHERE y IS NOT NULL")
def q_p10_record_class(s, d):
    return table(s, d, "customer").select("c_custkey", windowing.record_class(F.col("c_mktsegment"), registry.RECORD_PREFIXES).alias("y")).where("y is not null")


@query("SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS INTEGER) AS truth FROM events")
def q_s10_alarm_truth(s, d):
    k = F.col("event_id") % 3
    header = F.concat(F.lit("rec "), F.when(k == 0, "#True alarm").when(k == 1, "x #FALSE ALARM").otherwise("# none"))
    return B.events(s, d).select("event_id", windowing.alarm_truth(header).alias("truth"))


# ---- charts -------------------------------------------------------------------------------------------------------------


@query(f"WITH {B.BINS} SELECT stay_id, window_no, pos, {R(*B.VITALS)} FROM bins")
def q_p6_bins(s, d):
    return B.rounded(B.bins(s, d), *B.VITALS)


_GATE = ", missing AS (SELECT stay_id, window_no, greatest(" + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END)" for c in ("HR", "SpO2", "SBP", "RR")) + ") AS missing FROM bins GROUP BY 1, 2)"


@query(f"WITH {B.BINS}{_GATE} SELECT stay_id, window_no, {R('missing')} FROM missing WHERE missing <= 0.25")
def q_p7_missing_gate(s, d):
    return B.rounded(windowing.missing_gate(B.bins(s, d), ["stay_id", "window_no"], ["HR", "SpO2", "SBP", "RR"], 0.25), "missing")


@query(f"WITH {B.BINS} SELECT stay_id, window_no, pos, {', '.join(f'round(coalesce(last_value({c} IGNORE NULLS) OVER u, avg({c}) OVER p), 6) + 0.0 AS {c}' for c in ('HR', 'SBP', 'Temp'))} FROM bins WINDOW u AS (PARTITION BY stay_id, window_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY stay_id, window_no)")
def q_w1_fill_forward(s, d):
    return B.rounded(windowing.fill_forward(B.bins(s, d), ["stay_id", "window_no"], ["HR", "SBP", "Temp"]), "HR", "SBP", "Temp")


@query(f"WITH {B.BINS} SELECT stay_id, window_no, pos, channel, round(value, 6) + 0.0 AS value FROM (SELECT stay_id, window_no, pos, unnest(['HR', 'SpO2']) AS channel, unnest([HR, SpO2]) AS value FROM bins)")
def q_a2_channel_means(s, d):
    long = windowing.long_channels(B.bins(s, d), ["stay_id", "window_no", "pos"], ["HR", "SpO2"]).drop("channel_idx")
    return B.rounded(long, "value")


_CLASSES_SQL = "[" + ", ".join(f"'{c}'" for c in registry.CLINICAL_CLASSES) + "]"
_STAY_LABELS = f"""known AS (SELECT stay_id, ord, list_position({_CLASSES_SQL}, icd_category) - 1 AS i FROM diagnoses),
labels AS (SELECT stay_id, CAST(coalesce(arg_min(i, ord) FILTER (WHERE i IS NOT NULL AND i <> 7), CASE WHEN bool_or(i = 7) THEN 7 END, 0) AS INTEGER) AS y FROM known GROUP BY 1)"""


def _first_diagnoses(s, d) -> DataFrame:
    """Repeated rows of a stay and place count once, by the smaller category."""
    return table(s, d, "diagnoses").groupBy("stay_id", "ord").agg(F.min("icd_category").alias("icd_category"))


_STAY_LABELS_ONCE = _STAY_LABELS.replace("FROM diagnoses)", "FROM (SELECT stay_id, ord, min(icd_category) AS icd_category FROM diagnoses GROUP BY 1, 2))")


@query(f"WITH {_STAY_LABELS_ONCE} SELECT stay_id, y FROM labels")
def q_p9_stay_label(s, d):
    return windowing.stay_labels(_first_diagnoses(s, d), "stay_id", "ord", "icd_category", registry.CLINICAL_CLASSES)


@query(f"WITH {_STAY_LABELS_ONCE} SELECT window_id, w.stay_id, CAST(coalesce(y, 0) AS INTEGER) AS y FROM window_index w LEFT JOIN labels l ON l.stay_id = w.stay_id")
def q_j1_window_labels(s, d):
    labels = windowing.stay_labels(_first_diagnoses(s, d), "stay_id", "ord", "icd_category", registry.CLINICAL_CLASSES)
    return windowing.label_stays(table(s, d, "window_index").select("window_id", "stay_id"), "stay_id", labels)


@query("SELECT stay_id, count(*) AS readings, count(DISTINCT charttime) AS times FROM charts GROUP BY 1")
def q_a1_per_stay(s, d):
    return table(s, d, "charts").groupBy("stay_id").agg(F.count(F.lit(1)).alias("readings"), F.countDistinct("charttime").alias("times"))


# ---- sources ------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT w.window_id, w.stay_id, 8 AS n_classes, 8 AS n_channels FROM window_index w JOIN splits p ON p.window_id = w.window_id WHERE lower(trim(p.split)) = 'test'")
def q_s1_split_windows(s, d):
    data = registry.DATASETS["mimic"]
    listed = table(s, d, "splits").where(F.lower(F.trim("split")) == "test").select("window_id")
    return table(s, d, "window_index").join(listed, "window_id", "left_semi").select("window_id", "stay_id", F.lit(len(data.classes)).alias("n_classes"), F.lit(len(data.channels)).alias("n_channels"))


@query("SELECT window_id, CAST(channel_idx AS INTEGER) AS channel_idx, CAST(y AS INTEGER) AS y, CAST(t AS INTEGER) AS t, round(((window_id * 7607 + channel_idx * 101 + t * 3571 + t * t * 13) % 997) / 997.0::DOUBLE + 0.15 * y, 6) + 0.0 AS v FROM (SELECT range AS window_id, (range * 7919) % 8 AS y FROM range(100)), (SELECT range AS channel_idx FROM range(8)), (SELECT range AS t FROM range(60))")
def q_s4_synthetic(s, d):
    made = series.synthetic_windows(s, "mimic", 100, 8, 8)
    return B.rounded(made.select("window_id", "channel_idx", "y", F.posexplode("values").alias("t", "v")), "v")


@query(r"""SELECT line_id, v AS value, CAST(CASE WHEN trunc(coalesce(f, 0)) <> 0 THEN 1 ELSE 0 END AS INTEGER) AS flag FROM (
  SELECT line_id, CASE WHEN regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?') THEN try_cast(ltrim(v, '+') AS DOUBLE) WHEN v IN ('nan', '+nan', '-nan') THEN 'nan'::DOUBLE WHEN v IN ('inf', '+inf', 'infinity', '+infinity') THEN 'inf'::DOUBLE WHEN v IN ('-inf', '-infinity') THEN '-inf'::DOUBLE END AS v,
    CASE WHEN regexp_full_match(f, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?') THEN try_cast(ltrim(f, '+') AS DOUBLE) END AS f
  FROM (SELECT line_id, lower(trim(string_split(line, ',')[2], ' ' || chr(9) || chr(10) || chr(13))) AS v, lower(trim(string_split(line, ',')[3], ' ' || chr(9) || chr(10) || chr(13))) AS f FROM csv_lines)) WHERE v IS NOT NULL""")
def q_s7_tolerant_csv(s, d):
    cells = F.split("line", ",")
    rows = table(s, d, "csv_lines").select("line_id", F.get(cells, F.lit(1)).alias("VAL"), F.get(cells, F.lit(2)).alias("isAnomaly"))
    return series.tolerant_series(rows, ("line_id",))


_TRACE_ENTRIES = """entries AS (
  SELECT CASE WHEN prompt IS NOT NULL AND response IS NOT NULL THEN 'usable' ELSE 'skipped' END AS status,
    CASE WHEN prompt IS NOT NULL AND response IS NOT NULL THEN substr(sha256(coalesce(model, 'gpt-4o-mini') || '|' || printf('%.4f', coalesce(temperature, 0.0)) || '|' || prompt), 1, 16) END AS k, response AS r, trace_id AS o, view_id FROM raw_trace
), cache AS (SELECT k, arg_min(r, o) AS r FROM entries WHERE k IS NOT NULL AND r IS NOT NULL AND view_id < 6 GROUP BY 1)"""


def _entries(s, d) -> DataFrame:
    return llm_cache.trace_entries(table(s, d, "raw_trace"), F.struct("trace_id", "view_id"))


def _cache(s, d) -> DataFrame:
    """The cache as views 0 to 5 left it."""
    return llm_cache.first_entries(_entries(s, d).where("o.view_id < 6"), F.col("o"))


@query(f"WITH {_TRACE_ENTRIES} SELECT k, r FROM cache")
def q_s13_cache_first(s, d):
    return _cache(s, d)


@query(f"WITH {_TRACE_ENTRIES} SELECT k, arg_min(r, o) AS r FROM entries WHERE k IS NOT NULL AND r IS NOT NULL GROUP BY 1")
def q_s13_cache_whole(s, d):
    """The cache as all views left it."""
    return llm_cache.first_entries(_entries(s, d), F.col("o"))


@query(f"WITH {_TRACE_ENTRIES} SELECT k, r FROM cache UNION ALL SELECT k, arg_min(r, o) FROM entries WHERE k IS NOT NULL AND r IS NOT NULL AND k NOT IN (SELECT k FROM cache) GROUP BY 1")
def q_s14_cache_append(s, d):
    return llm_cache.append_new(_cache(s, d), llm_cache.first_entries(_entries(s, d), F.col("o")))


@query(f"""WITH {_TRACE_ENTRIES} SELECT CAST(count(DISTINCT CASE WHEN status = 'usable' AND c.k IS NULL THEN e.k END) AS BIGINT) AS added,
  CAST(count(*) FILTER (WHERE status = 'usable') - count(DISTINCT CASE WHEN status = 'usable' AND c.k IS NULL THEN e.k END) AS BIGINT) AS present, CAST(count(*) FILTER (WHERE status = 'skipped') AS BIGINT) AS skipped FROM entries e LEFT JOIN cache c ON c.k = e.k""")
def q_s15_prefill(s, d):
    return llm_cache.prefill(table(s, d, "raw_trace"), _cache(s, d), F.struct("trace_id", "view_id"))[1]


def _calls(s, d) -> DataFrame:
    return table(s, d, "raw_trace").select("trace_id", llm_cache.cache_key(F.col("model"), F.col("temperature"), F.col("prompt")).alias("k"))


_CALLS = ", calls AS (SELECT trace_id, substr(sha256(model || '|' || printf('%.4f', temperature) || '|' || prompt), 1, 16) AS k FROM raw_trace)"


@query(f"WITH {_TRACE_ENTRIES}{_CALLS} SELECT CAST(count(c.k) AS BIGINT) AS hits, CAST(count(*) - count(c.k) AS BIGINT) AS misses, (SELECT count(*) FROM cache) AS n_keys FROM calls a LEFT JOIN cache c ON c.k = a.k")
def q_s16_cache_stats(s, d):
    return llm_cache.cache_stats(_calls(s, d), _cache(s, d))


@query(f"WITH {_TRACE_ENTRIES}{_CALLS} SELECT trace_id, a.k, r, r IS NOT NULL AS hit FROM calls a LEFT JOIN cache c ON c.k = a.k")
def q_j4_cache_probe(s, d):
    return llm_cache.probe(_calls(s, d), _cache(s, d)).select("trace_id", "k", "r", "hit")


@query("SELECT CAST(coalesce(sum(prompt_tokens) FILTER (WHERE ok), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens) FILTER (WHERE ok), 0) AS BIGINT) AS completion_tokens, count(*) FILTER (WHERE ok) AS calls_ok, count(*) FILTER (WHERE NOT ok) AS calls_failed, arg_max(model, (ts, trace_id)) FILTER (WHERE ts IS NOT NULL) AS last_model FROM (SELECT *, error IS NULL AND response IS NOT NULL AS ok FROM raw_trace)")
def q_a28_usage(s, d):
    return llm_cache.usage(table(s, d, "raw_trace"))


@query(
    r"""WITH a AS (SELECT trace_id, response IS NULL AS gone, trim(response, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM raw_trace),
b AS (SELECT *, string_split(s, '```') AS p FROM a),
c AS (SELECT *, CASE WHEN NOT starts_with(s, '```') THEN s WHEN len(p) >= 3 THEN array_to_string(p[3:], '```') ELSE p[2] END AS u FROM b),
d AS (SELECT *, CASE WHEN starts_with(u, 'json') AND starts_with(s, '```') THEN substr(u, 5) ELSE u END AS t FROM c),
e AS (SELECT *, nullif(regexp_extract(t, '(?s)\{.*\}', 0), '') AS o FROM d),
f AS (SELECT *, CASE WHEN o IS NOT NULL AND json_valid(o) THEN o END AS j FROM e),
g AS (SELECT *, json_type(j, '$.label') AS lt, json_extract_string(j, '$.label') AS lv, json_type(j, '$.confidence') AS ct, json_extract_string(j, '$.confidence') AS cv FROM f),
h AS (SELECT *, CASE WHEN lt IS NULL THEN 0 WHEN lt IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN trunc(try_cast(lv AS DOUBLE)) WHEN lt = 'VARCHAR' AND regexp_full_match(trim(lv), '[+-]?[0-9]+') THEN try_cast(lv AS DOUBLE) WHEN lt = 'BOOLEAN' THEN CASE WHEN lv = 'true' THEN 1 ELSE 0 END END AS jl,
  CASE WHEN ct IS NULL THEN 0.5 WHEN ct IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'VARCHAR') THEN try_cast(cv AS DOUBLE) WHEN ct = 'BOOLEAN' THEN CASE WHEN cv = 'true' THEN 1 ELSE 0 END END AS jc,
  try_cast(nullif(regexp_extract(t, '"label"\s*:\s*(-?\d+)', 1), '') AS DOUBLE) AS rl, coalesce(try_cast(nullif(regexp_extract(t, '"confidence"\s*:\s*([\d.]+)', 1), '') AS DOUBLE), 0.5) AS rc FROM g),
i AS (SELECT *, j IS NOT NULL AND jl IS NOT NULL AND jc IS NOT NULL AS ok FROM h)
SELECT trace_id, CAST(CASE WHEN gone THEN 0 WHEN ok THEN greatest(0, least(7, jl)) WHEN rl IS NOT NULL THEN greatest(0, least(7, rl)) ELSE 0 END AS INTEGER) AS label,
  CAST(CASE WHEN gone THEN 0.5 WHEN ok THEN greatest(0.0, least(1.0, jc)) WHEN rl IS NOT NULL THEN greatest(0.0, least(1.0, rc)) ELSE 0.5 END AS DOUBLE) AS confidence FROM i"""
)
def q_d6_parse(s, d):
    return parse.parse_answers(table(s, d, "raw_trace").select("trace_id", "response"), "response", 8).select("trace_id", "label", "confidence")


@query(r"""SELECT trace_id, CAST(CASE WHEN l IS NULL THEN NULL ELSE greatest(0, least(7, l)) END AS INTEGER) AS label, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(c, 0.5))) AS confidence FROM (
  SELECT trace_id, try_cast(nullif(regexp_extract(response, '"label"\s*:\s*(-?\d+)', 1), '') AS BIGINT) AS l, try_cast(nullif(regexp_extract(response, '"confidence"\s*:\s*([\d.]+)', 1), '') AS DOUBLE) AS c FROM raw_trace)""")
def q_d6_pattern_stage(s, d):
    label, confidence = parse.pattern_stage(F.col("response"), 8)
    return table(s, d, "raw_trace").select("trace_id", label.alias("label"), confidence.alias("confidence"))


# ---- views, prompts, calls ----------------------------------------------------------------------------------------------


@query("SELECT view_idx, view, prompt_variant || '_T' || printf('%.1f', temperature) AS built FROM views")
def q_p16_view_names(s, d):
    return table(s, d, "views").select("view_idx", "view", labeling.view_name_col(F.col("prompt_variant"), F.col("temperature")).alias("built"))


@query("SELECT string_agg(i || '=' || c, ', ' ORDER BY i) AS classes FROM (SELECT unnest(range(0, 8)) AS i, unnest(" + _CLASSES_SQL + ") AS c)")
def q_p17_class_list(s, d):
    return registry.classes_table(s).where("dataset = 'mimic'").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("class_idx", "class_name"))), lambda x: F.concat(x["class_idx"].cast("string"), F.lit("="), x["class_name"])), ", ").alias("classes"))


def _prompt_sql() -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    text = lambda v: quote(labeling.TEMPLATES["multi", v].replace("{classes}", labeling.class_list(registry.CLINICAL_CLASSES)))
    return f"SELECT window_id, CAST(view_idx AS INTEGER) AS view_idx, replace(CASE prompt_variant WHEN 'narrow' THEN {text('narrow')} WHEN 'wide' THEN {text('wide')} ELSE {text('standard')} END, '{{summary}}', 'Window ' || window_id || ' of stay ' || stay_id) AS prompt FROM window_index, views"


@query(_prompt_sql())
def q_p18_prompts(s, d):
    summary = F.concat(F.lit("Window "), F.col("window_id").cast("string"), F.lit(" of stay "), F.col("stay_id").cast("string"))
    items = table(s, d, "window_index").select("window_id", summary.alias("summary"))
    return labeling.prompts(labeling.with_views(items, B.VIEWS), registry.CLINICAL_CLASSES).select("window_id", "view_idx", "prompt")


@query("SELECT CAST(i AS INTEGER) AS view_idx, v AS prompt_variant, t AS temperature, v || '_T' || printf('%.1f', t) AS view FROM (SELECT (a.i * 4 + b.i) AS i, v, t FROM (VALUES (0, 'narrow'), (1, 'standard'), (2, 'wide')) a(i, v), (VALUES (0, 0.0::DOUBLE), (1, 0.3::DOUBLE), (2, 0.7::DOUBLE), (3, 1.0::DOUBLE)) b(i, t))")
def q_j2_views(s, d):
    return registry.default_views(s)


@query("SELECT window_id, CAST(view_idx AS INTEGER) AS view_idx, view FROM window_index, views")
def q_j3_calls(s, d):
    return labeling.with_views(table(s, d, "window_index").select("window_id"), B.VIEWS).select("window_id", "view_idx", "view")


@query()
def q_d8_label_windows(s, d):
    texts = table(s, d, "window_index").select("window_id", F.concat(F.lit("stay "), F.col("stay_id").cast("string"), F.lit(" minute "), F.col("first_minute").cast("string")).alias("summary"))
    outputs, _, _ = labeling.label_windows(texts, B.VIEWS, registry.CLINICAL_CLASSES, labeling.RuleModel(8))
    return outputs.select("window_id", "view_idx", "view", "label", "confidence")


# ---- votes --------------------------------------------------------------------------------------------------------------


@query(f"WITH {B.COUNTS} SELECT item, label, n, {R('share')} FROM counts")
def q_a13_votes(s, d):
    return B.rounded(votes.vote_counts(B.votes(s, d)), "share")


@query(f"WITH {B.COUNTS} SELECT item, {R('plurality', 'entropy')} FROM (SELECT item, max(share) AS plurality, -sum(share * ln(share + 1e-9)) AS entropy FROM counts GROUP BY 1)")
def q_a14_entropy(s, d):
    return B.rounded(votes.vote_entropy(B.votes(s, d)), "plurality", "entropy")


@query(f"WITH {B.VOTES} SELECT item, {R('conf_mean', 'conf_std')} FROM (SELECT item, avg(confidence) AS conf_mean, stddev_pop(confidence) AS conf_std FROM votes GROUP BY 1)")
def q_a15_confidence(s, d):
    return B.rounded(votes.confidence_stats(B.votes(s, d)), "conf_mean", "conf_std")


@query(f"WITH {B.VOTES} SELECT item, CAST(min(label) = max(label) AS INTEGER) AS unanimous, CAST(quantile_cont(label, 0.5) = arg_min(label, view_idx) AS INTEGER) AS aligned FROM votes GROUP BY 1")
def q_a16_alignment(s, d):
    return votes.disagreement(B.votes(s, d)).select("item", "unanimous", "aligned")


@query(f"WITH {B.COUNTS} SELECT item, pred, {R('share')} FROM top")
def q_a17_majority(s, d):
    return B.rounded(votes.majority(B.votes(s, d)), "share")


@query(f"""WITH {B.COUNTS}, e AS (SELECT item, -sum(share * ln(share + 1e-9)) AS entropy FROM counts GROUP BY 1), c AS (
  SELECT item, avg(confidence) AS conf_mean, stddev_pop(confidence) AS conf_std, CAST(min(label) = max(label) AS INTEGER) AS unanimous, CAST(quantile_cont(label, 0.5) = arg_min(label, view_idx) AS INTEGER) AS aligned FROM votes GROUP BY 1)
SELECT item, pred, round(share, 6) + 0.0 AS plurality, {R('entropy', 'conf_mean', 'conf_std')}, unanimous, aligned FROM top JOIN e USING (item) JOIN c USING (item)""")
def q_disagreement(s, d):
    return B.rounded(votes.disagreement(B.votes(s, d)), "plurality", "entropy", "conf_mean", "conf_std")


@query(f"WITH {B.VOTES} SELECT item, view_idx, label, first_value(label) OVER (PARTITION BY item ORDER BY view_idx) AS first_label FROM votes")
def q_w9_first_view(s, d):
    from pyspark.sql import Window

    return B.votes(s, d).select("item", "view_idx", "label", F.first("label").over(Window.partitionBy("item").orderBy("view_idx")).alias("first_label"))


@query(f"WITH {B.COUNTS} SELECT item, pred, y, correct FROM scores")
def q_j5_truth(s, d):
    return B.share_scores(s, d).select("item", "pred", "y", "correct")


@query(f"WITH {B.COUNTS} SELECT item, pred, y FROM scores WHERE NOT correct")
def q_p14_errors(s, d):
    return B.share_scores(s, d).where(~F.col("correct")).select("item", "pred", "y")


# ---- thresholds and decisions -------------------------------------------------------------------------------------------


def _taus(s, d, fit, alphas):
    gold = B.share_scores(s, d).where("gold")
    out = None
    for a in alphas:
        row = fit(gold, a).withColumn("alpha", F.lit(a))
        out = row if out is None else out.unionByName(row)
    return B.rounded(out.select("alpha", "tau"), "tau")


@query(f"WITH {B.COUNTS} " + " UNION ALL ".join(f"SELECT {a}::DOUBLE AS alpha, round(CASE WHEN count(*) >= 10 THEN quantile_cont(score, {1 - a!r}) ELSE 1.0 END, 6) + 0.0 AS tau FROM scores WHERE gold AND NOT correct" for a in (0.05, 0.1, 0.2, 0.3)))
def q_a19_tau(s, d):
    return _taus(s, d, gate.conformal_threshold, (0.05, 0.1, 0.2, 0.3))


_SCAN = """, levels AS (SELECT score, count(*) AS n, sum(CASE WHEN correct THEN 0 ELSE 1 END) AS e FROM scores GROUP BY 1),
run AS (SELECT score, sum(n) OVER o AS k, sum(e) OVER o AS bad FROM levels WINDOW o AS (ORDER BY score DESC)),
scan AS (SELECT score, CAST(k AS BIGINT) AS k, bad / k AS err, bad / k + sqrt(2 * (CASE WHEN k > 1 THEN k / (k - 1) * (bad / k) * (1 - bad / k) ELSE 0 END) * -ln(0.05) / k) + 7 * -ln(0.05) / (3 * greatest(k - 1, 1)) AS bound FROM run)"""


@query(f"WITH {B.COUNTS}{_SCAN} SELECT round(score, 6) + 0.0 AS score, k, {R('err', 'bound')} FROM scan")
def q_w7_bernstein_scan(s, d):
    return B.rounded(gate.bernstein_scan(B.share_scores(s, d)).select("score", "k", "err", "bound"), "score", "err", "bound")


@query(f"WITH {B.COUNTS}{_SCAN}, ok AS (SELECT score, min(CASE WHEN bound <= 0.35 THEN 1 ELSE 0 END) OVER (ORDER BY score DESC) AS p FROM scan WHERE k >= 10) SELECT round(coalesce(min(score) FILTER (WHERE p = 1), 1.0), 6) + 0.0 AS tau FROM ok")
def q_a20_bernstein(s, d):
    return B.rounded(gate.bernstein_threshold(B.share_scores(s, d), 0.35), "tau")


@query(f"WITH {B.VOTES} SELECT round(quantile_cont(1 - confidence, 0.95), 6) + 0.0 AS q FROM votes WHERE view_idx = 4 AND gold")
def q_a21_conformal_quantile(s, d):
    return B.rounded(gate.conformal_quantile(B.votes(s, d).where("view_idx = 4 and gold")), "q")


_GRID = ", ".join(f"({g!r}::DOUBLE)" for g in gate.GRID)
_TUNED = f"""tuned AS (SELECT coalesce(max(thr) FILTER (WHERE err <= 0.2), 0.95) AS tau FROM (SELECT thr, avg(CASE WHEN label = y THEN 0.0::DOUBLE ELSE 1 END) AS err FROM (VALUES {_GRID}) t(thr) JOIN votes ON confidence >= thr WHERE view_idx = 4 AND gold GROUP BY 1))"""


@query(f"WITH {B.VOTES}, {_TUNED} SELECT round(tau, 6) + 0.0 AS tau FROM tuned")
def q_a22_confidence_threshold(s, d):
    gold = B.votes(s, d).where("view_idx = 4 and gold").withColumn("correct", F.col("label") == F.col("y"))
    return B.rounded(gate.confidence_threshold(gold, alpha=0.2), "tau")


@query(f"""WITH {B.COUNTS}, v AS (SELECT item, (1 - score) / greatest(1.0 + item % 7, 1.0) AS value FROM scores)
SELECT item, round(value, 6) + 0.0 AS value FROM (SELECT *, row_number() OVER (ORDER BY value DESC, item) AS r FROM v) WHERE r <= (SELECT greatest(1, CAST(floor(0.18 * count(*)) AS BIGINT)) FROM v)""")
def q_t1_verify(s, d):
    scores = B.share_scores(s, d).withColumn("token_cost", 1.0 + F.col("item") % 7)
    return B.rounded(gate.verification_set(scores), "value")


_SINGLE = "one AS (SELECT item, label AS pred, confidence FROM votes WHERE view_idx = 4)"
_DECIDE = "SELECT item, '{m}' AS method, pred, round({c}, 6) + 0.0 AS confidence, {a} AS accept FROM {f}"


def _method(name: str, alpha: float = 0.1):
    def run(s, d):
        return B.rounded(methods.METHODS[name](B.context(s, d, alpha)), "confidence")

    return run


@query(f"WITH {B.COUNTS}, tau AS (SELECT CASE WHEN count(*) >= 10 THEN quantile_cont(score, 0.9) ELSE 1.0 END AS tau FROM scores WHERE gold AND NOT correct) " + _DECIDE.format(m="pipeline", c="score", a="score >= tau", f="scores, tau"))
def q_l0_share(s, d):
    return B.rounded(methods.pipeline(B.context(s, d), calibrated=False), "confidence")


@query(f"WITH {B.VOTES}, {_SINGLE} " + _DECIDE.format(m="full_llm", c="confidence", a="true", f="one"))
def q_l1_full_llm(s, d):
    return _method("full_llm")(s, d)


@query(f"WITH {B.COUNTS} " + _DECIDE.format(m="self_consistency", c="share", a="true", f="top"))
def q_l2_self_consistency(s, d):
    return _method("self_consistency")(s, d)


@query(f"WITH {B.VOTES}, {_TUNED}, {_SINGLE} " + _DECIDE.format(m="confidence_threshold", c="confidence", a="confidence >= tau", f="one, tuned"))
def q_l3_confidence_threshold(s, d):
    return _method("confidence_threshold", 0.2)(s, d)


@query(f"WITH {B.VOTES}, {_SINGLE}, q AS (SELECT quantile_cont(1 - confidence, 0.7) AS q FROM votes WHERE view_idx = 4 AND gold) " + _DECIDE.format(m="conformal_llm", c="confidence", a="(1 - confidence) <= q", f="one, q"))
def q_l4_conformal_llm(s, d):
    return _method("conformal_llm", 0.3)(s, d)


def _em_tables(rounds: int, least: float = 0.0) -> str:
    """The label model over the three sources, unrolled; votes below the least confidence abstain. Round r leaves its
    posteriors in q<r> and its accuracies in a<r + 1>."""
    out = [
        B.VOTES,
        f"v AS MATERIALIZED (SELECT item, view_idx AS m, label FROM votes WHERE view_idx IN (0, 4, 8) AND confidence >= {least})",
        "i AS MATERIALIZED (SELECT DISTINCT item FROM votes)",
        "k AS MATERIALIZED (SELECT CAST(range AS INTEGER) AS k FROM range(10))",
        "a0 AS MATERIALIZED (SELECT DISTINCT m, 0.7::DOUBLE AS acc FROM v)",
        "p0 AS MATERIALIZED (SELECT k, -ln(10.0::DOUBLE) AS lp FROM k)",
    ]
    for r in range(rounds):
        out += [
            f"s{r} AS MATERIALIZED (SELECT item, k.k, sum(ln((CASE WHEN v.label = k.k THEN a.acc ELSE (1 - a.acc) / 9 END) + 1e-6)) AS s FROM v JOIN a{r} a ON a.m = v.m CROSS JOIN k GROUP BY 1, 2)",
            f"z{r} AS MATERIALIZED (SELECT i.item, p.k, p.lp + coalesce(s.s, 0) AS z FROM i CROSS JOIN p{r} p LEFT JOIN s{r} s ON s.item = i.item AND s.k = p.k)",
            f"e{r} AS MATERIALIZED (SELECT item, k, exp(z - max(z) OVER (PARTITION BY item)) AS e FROM z{r})",
            f"q{r} AS MATERIALIZED (SELECT item, k, e / (sum(e) OVER (PARTITION BY item) + 1e-6) AS q FROM e{r})",
            f"a{r + 1} AS MATERIALIZED (SELECT v.m, least(greatest(avg(q.q), 0.1 + 1e-6), 1 - 1e-6) AS acc FROM v JOIN q{r} q ON q.item = v.item AND q.k = v.label GROUP BY 1)",
            f"p{r + 1} AS MATERIALIZED (SELECT k, ln(avg(q) + 1e-6) AS lp FROM q{r} GROUP BY 1)",
        ]
    return "WITH " + ",\n".join(out)


def _em_labels(method: str, least: float = 0.0) -> str:
    return _em_tables(50, least) + f" SELECT item, '{method}' AS method, CAST(arg_min(k, -round(q, 12) + k * 1e-13) AS INTEGER) AS pred, round(max(q), 6) + 0.0 AS confidence, true AS accept FROM q49 GROUP BY item"


@query()
def q_l0_calibrated(s, d):
    return _method("pipeline")(s, d)


@query(_em_labels("label_model"))
def q_l5_label_model(s, d):
    return _method("snorkel_style")(s, d)


@query()
def q_l6_badge(s, d):
    return _method("badge")(s, d)


@query(_em_labels("prompted_ws", 0.6))
def q_l7_prompted_ws(s, d):
    return _method("prompted_ws")(s, d)


@query()
def q_l8_free_al(s, d):
    return _method("free_al")(s, d)


_WHITE = """g AS (SELECT CAST(vec_id AS BIGINT) AS i, generate_subscripts(embedding, 1) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
st AS (SELECT j, avg(x) AS m, stddev_pop(x) AS sd FROM g WHERE i % 3 = 0 GROUP BY 1),
white AS (SELECT i, list((x - m) / (sd + 1e-6) ORDER BY g.j) AS v FROM g JOIN st ON st.j = g.j GROUP BY 1),
dist AS (SELECT a.i AS item, b.i AS gold_item, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM white a JOIN white b ON b.i % 3 = 0),
near AS (SELECT item, gold_item, row_number() OVER (PARTITION BY item ORDER BY distance, gold_item) AS rank FROM dist)"""


@query(f"""WITH {_WHITE} SELECT n.item, 'llmaa' AS method, CAST(e.label AS INTEGER) AS pred, round(0.5::DOUBLE + (n.item * 7 % 50) / 100.0::DOUBLE, 6) + 0.0 AS confidence, true AS accept
FROM near n JOIN embeddings e ON e.vec_id = n.gold_item WHERE rank = 1""")
def q_l9_llmaa(s, d):
    return _method("llmaa")(s, d)


@query(f"""WITH {_WHITE} SELECT n.item, string_agg('Example ' || n.rank || ': label ' || e.label || ' (class_' || e.label || ')', chr(10) ORDER BY n.rank) AS prefix
FROM near n JOIN embeddings e ON e.vec_id = n.gold_item WHERE rank <= 3 GROUP BY 1""")
def q_j8_prompt_prefix(s, d):
    return methods.demo_prefix(methods.llmaa_neighbours(B.context(s, d)), [f"class_{i}" for i in range(B.CLASSES)])


# ---- models -------------------------------------------------------------------------------------------------------------


@query()
def q_m2_predictor(s, d):
    ctx = B.context(s, d)
    model = models.FeaturePredictor(B.CLASSES).fit(ctx.features.join(ctx.gold, "item"))
    return model.predict(ctx.features).select("item", "pred", "confidence")


def _em_sql(rounds: int) -> str:
    """The label model's first rounds over the three sources, unrolled."""
    out = [B.VOTES, "v AS (SELECT item, view_idx AS m, label FROM votes WHERE view_idx IN (0, 4, 8))", "k AS (SELECT CAST(range AS INTEGER) AS k FROM range(10))", "a0 AS (SELECT DISTINCT m, 0.7::DOUBLE AS acc FROM v)", "p0 AS (SELECT k, -ln(10.0::DOUBLE) AS lp FROM k)"]
    for r in range(rounds):
        out += [
            f"z{r} AS (SELECT item, p.k, any_value(p.lp) + sum(ln((CASE WHEN v.label = p.k THEN a.acc ELSE (1 - a.acc) / 9 END) + 1e-6)) AS z FROM v JOIN a{r} a ON a.m = v.m CROSS JOIN p{r} p GROUP BY 1, 2)",
            f"e{r} AS (SELECT item, k, exp(z - max(z) OVER (PARTITION BY item)) AS e FROM z{r})",
            f"q{r} AS (SELECT item, k, e / (sum(e) OVER (PARTITION BY item) + 1e-6) AS q FROM e{r})",
            f"a{r + 1} AS (SELECT v.m, least(greatest(avg(q.q), 0.1 + 1e-6), 1 - 1e-6) AS acc FROM v JOIN q{r} q ON q.item = v.item AND q.k = v.label GROUP BY 1)",
            f"p{r + 1} AS (SELECT k, ln(avg(q) + 1e-6) AS lp FROM q{r} GROUP BY 1)",
        ]
    return "WITH " + ",\n".join(out) + f" SELECT item, k, round(q, 6) + 0.0 AS q FROM q{rounds - 1}"


@query(_em_sql(3))
def q_m5_posterior(s, d):
    rows = B.votes(s, d).where(F.col("view_idx").isin(*methods.LF_VIEWS)).select("item", F.col("view_idx").alias("lf_idx"), F.col("label").alias("vote"))
    post = models.label_model(rows, methods.LF_VIEWS, B.CLASSES, rounds=3)[0]
    return B.rounded(post.select("item", F.posexplode("posterior").alias("k", "q")), "q")


@query(_em_tables(50) + " SELECT item, k, round(q, 6) + 0.0 AS q FROM q49")
def q_m5_posterior_fitted(s, d):
    """The posteriors after all rounds; q_m5_posterior stops after the three that its SQL unrolls."""
    rows = B.votes(s, d).where(F.col("view_idx").isin(*methods.LF_VIEWS)).select("item", F.col("view_idx").alias("lf_idx"), F.col("label").alias("vote"))
    post = models.label_model(rows, methods.LF_VIEWS, B.CLASSES)[0]
    return B.rounded(post.select("item", F.posexplode("posterior").alias("k", "q")), "q")


@query("""WITH g AS (SELECT vec_id AS i, generate_subscripts(embedding, 1) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), st AS (SELECT j, avg(x) AS m, stddev_pop(x) AS sd FROM g WHERE i % 3 = 0 GROUP BY 1)
SELECT i AS item, CAST(g.j - 1 AS INTEGER) AS dim, round((x - m) / (sd + 1e-6), 6) + 0.0 AS x FROM g JOIN st ON st.j = g.j""")
def q_a29_whiten(s, d):
    ctx = B.context(s, d)
    gold = ctx.features.join(ctx.gold, "item")
    white = models.whiten(ctx.features, gold, "features", "item")
    return B.rounded(white.select("item", F.posexplode("features").alias("dim", "x")), "x")


@query("""WITH e AS (SELECT CAST(vec_id AS BIGINT) AS i, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
dist AS (SELECT a.i AS item, b.i AS gold_item, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM e a JOIN e b ON a.i % 3 <> 0 AND b.i % 3 = 0)
SELECT item, gold_item, round(distance, 6) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY distance, gold_item) AS rank FROM dist) WHERE rank <= 3""")
def q_j7_neighbours(s, d):
    ctx = B.context(s, d)
    base = ctx.features.join(ctx.gold, "item", "left_semi").withColumnRenamed("item", "gold_item")
    queries = ctx.features.join(ctx.gold, "item", "left_anti")
    return B.rounded(models.nearest(queries, "item", base, "gold_item", "features", 3), "distance")


@query(f"""WITH {B.COUNTS}, e AS (SELECT item, -sum(share * ln(share + 1e-9)) AS entropy FROM counts GROUP BY 1)
SELECT item, round(entropy, 6) + 0.0 AS entropy FROM (SELECT *, row_number() OVER (ORDER BY round(entropy, 9) DESC, item) AS r FROM e) WHERE r <= (SELECT greatest(1, CAST(floor(0.2 * count(*)) AS BIGINT)) FROM e)""")
def q_t5_refresh(s, d):
    e = votes.vote_entropy(B.votes(s, d)).select("item", F.round("entropy", 9).alias("entropy"))
    return B.rounded(votes.refresh_set(e), "entropy")


@query(f"WITH {B.COUNTS} SELECT DISTINCT round(score, 6) + 0.0 AS score FROM scores")
def q_t7_scores(s, d):
    return B.share_scores(s, d).select((F.round("score", 6) + F.lit(0.0)).alias("score")).distinct()


@query(f"""WITH {B.COUNTS}, r AS (SELECT item, label, row_number() OVER (PARTITION BY item ORDER BY n DESC, label) AS r FROM counts)
SELECT item, max(label) FILTER (WHERE r = 1) AS first, max(label) FILTER (WHERE r = 2) AS second FROM r GROUP BY 1""")
def q_t6_top_two(s, d):
    ranked = votes.vote_counts(B.votes(s, d)).groupBy("item").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "label"))).alias("l"))
    return ranked.select("item", F.get(F.col("l"), F.lit(0))["label"].alias("first"), F.get(F.col("l"), F.lit(1))["label"].alias("second"))


@query("""WITH r AS (SELECT window_id, row_number() OVER (ORDER BY (window_id * 7919) % 10007, window_id) - 1 AS r, count(*) OVER () AS n FROM window_index), b AS (SELECT *, least(50, n) AS g, CASE WHEN n > 50 THEN greatest(1, (n - 50) // 5) ELSE 0 END AS t FROM r)
SELECT window_id, CASE WHEN r < g THEN 'gold' WHEN r < g + t THEN 'test' ELSE 'unlabeled' END AS split FROM b""")
def q_t8_split(s, d):
    return windowing.ranked_split(table(s, d, "window_index"), "window_id", (F.col("window_id") * 7919) % 10007, 50)


@query("""WITH r AS (SELECT window_id, row_number() OVER (ORDER BY (window_id * 7919) % 10007, window_id) - 1 AS r, count(*) OVER () AS n FROM window_index), b AS (SELECT *, least(50, n) AS g, CASE WHEN n > 50 THEN greatest(1, (n - 50) // 5) ELSE 0 END AS t FROM r)
SELECT window_id, split FROM (SELECT window_id, r, g, t, CASE WHEN r < g THEN 'gold' WHEN r < g + t THEN 'test' ELSE 'unlabeled' END AS split FROM b) WHERE (split <> 'gold' OR r < 20) AND (split <> 'test' OR r < g + 10) AND (split <> 'unlabeled' OR r < g + t + 40)""")
def q_p19_capped_split(s, d):
    return windowing.ranked_split(table(s, d, "window_index"), "window_id", (F.col("window_id") * 7919) % 10007, 50, caps={"gold": 20, "test": 10, "unlabeled": 40})


@query("SELECT split, count(*) AS windows FROM (SELECT DISTINCT w.window_id, lower(trim(p.split)) AS split FROM window_index w JOIN splits p ON p.window_id = w.window_id) GROUP BY 1")
def q_j6_membership(s, d):
    listed = table(s, d, "splits").select("window_id", F.lower(F.trim("split")).alias("split")).distinct()
    return listed.join(table(s, d, "window_index"), "window_id", "left_semi").groupBy("split").agg(F.count(F.lit(1)).alias("windows"))


# ---- metrics and tests --------------------------------------------------------------------------------------------------


def _decisions(s, d) -> DataFrame:
    """Single views as methods, accepted at a confidence of 0.7, with the truth."""
    return B.votes(s, d).select("item", F.concat(F.lit("view"), F.col("view_idx").cast("string")).alias("method"), F.col("label").alias("pred"), "y", (F.col("confidence") >= 0.7).alias("accept"))


_DECISIONS = B.VOTES + ", dec AS (SELECT item, 'view' || view_idx AS method, label AS pred, y, confidence >= 0.7 AS accept FROM votes)"


@query(f"WITH {_DECISIONS} SELECT method, CAST(sum(CASE WHEN accept THEN 1 ELSE 0 END) AS BIGINT) AS n_accepted, round(coalesce(avg(CASE WHEN pred <> y THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE accept), 0), 6) + 0.0 AS risk, round(avg(CASE WHEN accept THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS coverage FROM dec GROUP BY 1")
def q_a23_risk_coverage(s, d):
    return B.rounded(metrics.risk_coverage(_decisions(s, d)), "risk", "coverage")


@query(f"WITH {_DECISIONS} SELECT method, round((count(*) * 12 * 0.1::DOUBLE + sum(CASE WHEN accept THEN 0 ELSE 1 END)) / greatest(count(*), 1e-9), 6) + 0.0 AS cost FROM dec GROUP BY 1")
def q_a24_cost(s, d):
    return B.rounded(metrics.cost(_decisions(s, d)), "cost")


_F1 = """, ks AS (SELECT method, y AS k FROM acc UNION SELECT method, pred FROM acc), f AS (
  SELECT k.method, k.k, count(*) FILTER (WHERE y = k.k AND pred = k.k) AS tp, count(*) FILTER (WHERE pred = k.k AND y <> k.k) AS fp, count(*) FILTER (WHERE y = k.k AND pred <> k.k) AS fn FROM ks k JOIN acc a ON a.method = k.method GROUP BY 1, 2)"""


@query(f"WITH {_DECISIONS}, acc AS (SELECT * FROM dec WHERE accept){_F1} SELECT method, round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END), 6) + 0.0 AS f1 FROM f GROUP BY 1")
def q_a25_macro_f1(s, d):
    return B.rounded(metrics.macro_f1(_decisions(s, d).where("accept")), "f1")


@query(f"WITH {_DECISIONS}, acc AS (SELECT * FROM dec){_F1} SELECT method, k, tp, fp, fn FROM f")
def q_u4_class_counts(s, d):
    return metrics.class_counts(_decisions(s, d))


@query(f"""WITH {_DECISIONS}, acc AS (SELECT * FROM dec WHERE accept){_F1}, f1 AS (SELECT method, avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END) AS f1 FROM f GROUP BY 1)
SELECT d.method, CAST(sum(CASE WHEN accept THEN 1 ELSE 0 END) AS BIGINT) AS n_accepted, round(coalesce(avg(CASE WHEN pred <> y THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE accept), 0), 6) + 0.0 AS risk, round(avg(CASE WHEN accept THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS coverage,
  round((count(*) * 12 * 0.1::DOUBLE + sum(CASE WHEN accept THEN 0 ELSE 1 END)) / greatest(count(*), 1e-9), 6) + 0.0 AS cost, round(coalesce(any_value(f1), 0), 6) + 0.0 AS f1 FROM dec d LEFT JOIN f1 ON f1.method = d.method GROUP BY 1""")
def q_metrics(s, d):
    return B.rounded(metrics.all_metrics(_decisions(s, d)), "risk", "coverage", "cost", "f1")


def _seeded(s, d) -> DataFrame:
    """Risk per method and seed, the seed being a fifth of the items."""
    return _decisions(s, d).withColumn("seed", (F.col("item") % 5).cast("int"))


_SEEDED = _DECISIONS + ", seeded AS (SELECT method, CAST(item % 5 AS INTEGER) AS seed, coalesce(avg(CASE WHEN pred <> y THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE accept), 0) AS value FROM dec GROUP BY 1, 2)"


def _per_seed(s, d) -> DataFrame:
    return metrics.risk_coverage(_seeded(s, d), ("method", "seed")).select("method", "seed", F.col("risk").alias("value"))


@query(f"WITH {_SEEDED} SELECT method, CAST(sum(CASE WHEN value <= 0.25 THEN 1 ELSE 0 END) AS BIGINT) || '/' || count(*) AS compliance FROM seeded GROUP BY 1")
def q_a26_compliance(s, d):
    return metrics.compliance(_per_seed(s, d).withColumnRenamed("value", "risk"), 0.25)


@query(f"WITH {_DECISIONS} SELECT method, round(avg(CASE WHEN pred = y THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS accuracy FROM dec GROUP BY 1")
def q_a27_accuracy(s, d):
    return B.rounded(metrics.accuracy(_decisions(s, d)), "accuracy")


_PAIRS = _SEEDED + ", pairs AS (SELECT o.method, o.seed, round(t.value - o.value, 9) AS diff FROM seeded o JOIN seeded t ON t.seed = o.seed AND t.method = 'view0' WHERE o.method <> 'view0')"


def _pairs(s, d) -> DataFrame:
    return metrics.paired(_per_seed(s, d), "view0").withColumn("diff", F.round("diff", 9))


@query(f"WITH {_PAIRS} SELECT method, seed, round(diff, 6) + 0.0 AS diff FROM pairs")
def q_j9_paired(s, d):
    return B.rounded(_pairs(s, d), "diff")


_BINOMIAL = """, nk AS (SELECT method, count(*) FILTER (WHERE diff <> 0) AS n, count(*) FILTER (WHERE diff > 0) AS k FROM pairs GROUP BY 1),
sign AS (SELECT method, CAST(k AS DOUBLE) AS statistic, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(k, n - k) + 1), lambda i: CAST(factorial(CAST(n AS INTEGER)) / (factorial(CAST(i AS INTEGER)) * factorial(CAST(n - i AS INTEGER))) AS DOUBLE))) / pow(2, n)) END AS p_value, n AS n_pairs FROM nk)"""


@query(f"WITH {_PAIRS}{_BINOMIAL} SELECT method, statistic, round(p_value, 6) + 0.0 AS p_value, n_pairs FROM sign")
def q_z1_sign_test(s, d):
    return B.rounded(metrics.sign_test(_pairs(s, d)), "p_value")


@query(f"""WITH {_PAIRS}, r AS (SELECT method, diff, avg(rn) OVER (PARTITION BY method, abs(diff)) AS r FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY abs(diff)) AS rn FROM pairs WHERE diff <> 0))
SELECT method, coalesce(sum(r) FILTER (WHERE diff > 0), 0.0) AS w_plus, coalesce(sum(r) FILTER (WHERE diff < 0), 0.0) AS w_minus, count(*) AS n_pairs FROM r GROUP BY 1""")
def q_z1_signed_ranks(s, d):
    return metrics.signed_ranks(_pairs(s, d))


@query(f"WITH {_PAIRS}{_BINOMIAL} SELECT method, round(p_value, 6) + 0.0 AS p_value, round(least(1.0, max(sc) OVER (ORDER BY r)), 6) + 0.0 AS p_holm FROM (SELECT method, p_value, row_number() OVER (ORDER BY round(p_value, 9), method) AS r, (count(*) OVER () - row_number() OVER (ORDER BY round(p_value, 9), method) + 1) * p_value AS sc FROM sign)")
def q_z2_holm(s, d):
    tests = metrics.sign_test(_pairs(s, d)).withColumn("p_value", F.round("p_value", 9))
    return B.rounded(metrics.holm(tests).select("method", "p_value", "p_holm"), "p_value", "p_holm")


@query()
def q_z3_against(s, d):
    return B.rounded(metrics.against(_per_seed(s, d), "view0"), "p_value", "p_holm")


@query("SELECT CAST(event_id AS BIGINT) AS id, 'events' AS origin FROM events UNION ALL SELECT CAST(reading_id AS BIGINT), 'charts' FROM charts")
def q_u1_union(s, d):
    return B.events(s, d).select(F.col("event_id").alias("id"), F.lit("events").alias("origin")).unionByName(table(s, d, "charts").select(F.col("reading_id").alias("id"), F.lit("charts").alias("origin")))


# ---- streaming ----------------------------------------------------------------------------------------------------------


@query("SELECT user_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def q_stream_bins(s, d):
    import uuid

    from pulsegrid.session import shared_dir
    from pulsegrid.streaming import windows as streaming

    rows = table(s, d, "events").select("user_id", "ts", "value")
    stream = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    root = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    # complete results need every bin closed: the sink of a finished stream keeps updates, the last of each bin counts
    made = streaming.binned(stream, "user_id", "ts", "value", "6 hours")
    collected = made.writeStream.foreachBatch(lambda batch, i: batch.withColumn("__batch", F.lit(i)).write.mode("append").parquet(f"{root}/out")).outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    collected.awaitTermination()
    out = s.read.parquet(f"{root}/out").groupBy("user_id", "start").agg(F.max_by(F.struct("n", "mean", "min", "max"), "__batch").alias("r"))
    kind = dict(rows.dtypes)["ts"]
    return B.rounded(out.select("user_id", F.col("start").cast(kind).alias("start"), "r.*"), "mean")


# ---- further operators of the inventory ---------------------------------------------------------------------------------


@query("SELECT w.window_id, first_minute, n_rows FROM window_index w WHERE w.window_id IN (SELECT window_id FROM splits WHERE lower(trim(split)) = 'gold')")
def q_p15_gather(s, d):
    listed = table(s, d, "splits").where(F.lower(F.trim("split")) == "gold").select("window_id")
    return table(s, d, "window_index").join(listed, "window_id", "left_semi").select("window_id", "first_minute", "n_rows")


@query("SELECT vec_id AS item, CASE WHEN r <= greatest(1, n // 2) THEN 'fit' ELSE 'calibrate' END AS half FROM (SELECT CAST(vec_id AS BIGINT) AS vec_id, row_number() OVER (ORDER BY vec_id) AS r, count(*) OVER () AS n FROM embeddings WHERE vec_id % 3 = 0)")
def q_p20_half_split(s, d):
    gold = B.gold(s, d)
    n = gold.count()
    placed = with_global_rank(gold, [F.col("item")], "r")
    return placed.select("item", F.when(F.col("r") < max(1, n // 2), "fit").otherwise("calibrate").alias("half"))


@query(W("SELECT user_id, window_no, CAST(count(*) FILTER (WHERE value > 100) AS BIGINT) AS n, CASE WHEN stddev_pop(value) > 1e-6 THEN '' ELSE 'ABSENT' END AS mark FROM w GROUP BY 1, 2"))
def q_p21_absent_mark(s, d):
    return B.windows(s, d).groupBy(*B.KEYS).agg(F.count_if(F.col("value") > 100).alias("n"), F.when(windowing.is_present(F.col("value")), "").otherwise("ABSENT").alias("mark"))


@query(W("SELECT user_id, window_no, round(60.0 * CAST(sum(CASE WHEN value > prev AND value > next THEN 1 ELSE 0 END) AS BIGINT) / count(*), 6) + 0.0 AS rate FROM nb GROUP BY 1, 2", _NEIGHBOURS))
def q_a11_rate(s, d):
    return B.rounded(stats.peak_intervals(B.windows(s, d), B.KEYS, "pos", "value", 1.0).select(*B.KEYS, "rate"), "rate")


@query(f"WITH {B.COUNTS} SELECT item, round(max(share), 6) + 0.0 AS confidence FROM counts GROUP BY 1")
def q_a18_share(s, d):
    return B.rounded(votes.majority(B.votes(s, d)).select("item", F.col("share").alias("confidence")), "confidence")


def _accuracy_sql(rounds: int) -> str:
    return _em_sql(rounds).rsplit(" SELECT item", 1)[0] + f" SELECT CAST(m AS INTEGER) AS lf_idx, round(acc, 6) + 0.0 AS accuracy FROM a{rounds}"


@query(_accuracy_sql(3))
def q_a30_source_accuracy(s, d):
    rows = B.votes(s, d).where(F.col("view_idx").isin(*methods.LF_VIEWS)).select("item", F.col("view_idx").alias("lf_idx"), F.col("label").alias("vote"))
    return B.rounded(models.label_model(rows, methods.LF_VIEWS, B.CLASSES, rounds=3)[1], "accuracy")


@query(_em_tables(50) + " SELECT CAST(m AS INTEGER) AS lf_idx, round(acc, 6) + 0.0 AS accuracy FROM a50")
def q_a30_source_accuracy_fitted(s, d):
    rows = B.votes(s, d).where(F.col("view_idx").isin(*methods.LF_VIEWS)).select("item", F.col("view_idx").alias("lf_idx"), F.col("label").alias("vote"))
    return B.rounded(models.label_model(rows, methods.LF_VIEWS, B.CLASSES)[1], "accuracy")


@query(W("SELECT CAST(sum(label) AS BIGINT) AS positive, count(*) AS windows, count(DISTINCT label) AS labels FROM (SELECT user_id, window_no, CAST(max(CASE WHEN value > 150 THEN 1 ELSE 0 END) AS INTEGER) AS label FROM w GROUP BY 1, 2)"))
def q_a31_label_counts(s, d):
    flagged = windowing.window_flag(B.windows(s, d), B.KEYS, F.col("value") > 150)
    return flagged.agg(F.sum("label").alias("positive"), F.count(F.lit(1)).alias("windows"), F.countDistinct("label").alias("labels"))


@query(SQL["q_j7_neighbours"].replace("SELECT item, gold_item, round(distance, 6) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank FROM", "SELECT n.item, CAST(n.rank AS INTEGER) AS rank, CAST(m.label AS INTEGER) AS y, 'class_' || m.label AS class_name FROM (SELECT * FROM").replace("WHERE rank <= 3", "WHERE rank <= 3) n JOIN embeddings m ON m.vec_id = n.gold_item"))
def q_j8_demo_labels(s, d):
    near = q_j7_neighbours(s, d).select("item", "gold_item", "rank")
    named = near.join(B.gold(s, d).withColumnRenamed("item", "gold_item"), "gold_item")
    return named.select("item", "rank", "y", F.concat(F.lit("class_"), F.col("y").cast("string")).alias("class_name"))


@query(f"WITH {_SEEDED} SELECT a.method AS target, b.method, a.seed, round(a.value - b.value, 6) + 0.0 AS diff FROM seeded a JOIN seeded b ON a.seed = b.seed AND a.method <> b.method WHERE a.method IN ('view0', 'view4')")
def q_j10_against_others(s, d):
    per = _per_seed(s, d)
    one = lambda t: metrics.paired(per, t).select(F.lit(t).alias("target"), "method", "seed", "diff")
    return B.rounded(one("view0").unionByName(one("view4")), "diff")


@query(f"WITH {B.COUNTS} SELECT v.item, v.view_idx, v.label, round(c.share, 6) + 0.0 AS share FROM votes v JOIN counts c ON c.item = v.item AND c.label = v.label")
def q_j11_vote_share(s, d):
    v = B.votes(s, d)
    return B.rounded(v.join(votes.vote_counts(v), ["item", "label"]).select("item", "view_idx", "label", "share"), "share")


_BLOCKS = """WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS rn FROM events
), cut AS (
  SELECT user_id, value, rn // 32 AS window_no, rn % 32 AS pos, count(*) OVER (PARTITION BY user_id, rn // 32) AS n FROM ranked
), sc AS (
  SELECT user_id, window_no, pos, abs(rm - lm) + abs(rs - ls) AS score FROM (
    SELECT user_id, window_no, pos, avg(value) OVER r AS rm, avg(value) OVER l AS lm, stddev_pop(value) OVER r AS rs, stddev_pop(value) OVER l AS ls FROM cut WHERE n = 32
    WINDOW l AS (PARTITION BY user_id, window_no ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY user_id, window_no ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
  WHERE pos BETWEEN 8 AND 23
), p1 AS (SELECT user_id, window_no, arg_max(pos, (score, -pos)) AS a FROM sc GROUP BY 1, 2),
p2 AS (SELECT s.user_id, s.window_no, any_value(a) AS a, arg_max(pos, (score, -pos)) FILTER (WHERE abs(pos - a) >= 8) AS b FROM sc s JOIN p1 USING (user_id, window_no) GROUP BY 1, 2),
p3 AS (SELECT s.user_id, s.window_no, any_value(a) AS a, any_value(b) AS b, arg_max(pos, (score, -pos)) FILTER (WHERE abs(pos - a) >= 8 AND abs(pos - b) >= 8) AS c FROM sc s JOIN p2 USING (user_id, window_no) GROUP BY 1, 2)
SELECT user_id, window_no, CAST(row_number() OVER (PARTITION BY user_id, window_no ORDER BY t) - 1 AS INTEGER) AS i, CAST(t AS INTEGER) AS t FROM (SELECT user_id, window_no, unnest([a, b, c]) AS t FROM p3) WHERE t IS NOT NULL"""


@query(_BLOCKS)
def q_j13_separated_points(s, d):
    found = B.arrays(s, d, 32).select(*B.KEYS, dsp.change_points_udf(3, "cusum")("values").alias("p"))
    return found.select(*B.KEYS, F.posexplode("p").alias("i", "t"))


@query(W("""SELECT user_id, window_no, CAST(row_number() OVER (PARTITION BY user_id, window_no ORDER BY pos) - 1 AS INTEGER) AS i, pos AS t FROM (
  SELECT *, lag(e) OVER z AS pe, lead(e) OVER z AS ne, avg(e) OVER y + stddev_pop(e) OVER y AS thr, stddev_pop(value) OVER y AS sd FROM (SELECT *, coalesce((value - prev) * (value - prev), 0) AS e FROM nb)
  WINDOW y AS (PARTITION BY user_id, window_no), z AS (PARTITION BY user_id, window_no ORDER BY pos)) WHERE pos BETWEEN 1 AND 14 AND sd >= 1e-6 AND e > thr AND e >= pe AND e > ne""", _NEIGHBOURS))
def q_w5_refractory_peaks(s, d):
    return B.arrays(s, d).select(*B.KEYS, F.posexplode(dsp.peaks_udf(8.0)("values")).alias("i", "t"))


@query("""SELECT window_id, CAST(view_idx AS INTEGER) AS view_idx, view, CAST((7 * window_id + CAST(round(10 * temperature) AS INTEGER)) % 8 AS INTEGER) AS label, round(0.5::DOUBLE + (window_id * 7 % 50) / 100.0::DOUBLE, 6) + 0.0 AS confidence FROM window_index, views""")
def q_m7_calls(s, d):
    """Every window under every view through prompts, calls, cache and parser, answered by arithmetic on the window's number."""
    texts = table(s, d, "window_index").select("window_id", F.concat(F.lit("recording "), F.col("window_id").cast("string")).alias("summary"))
    outputs, _, _ = labeling.label_windows(texts, B.VIEWS, registry.CLINICAL_CLASSES, labeling.DemoModel(8))
    return B.rounded(outputs.select("window_id", "view_idx", "view", "label", "confidence"), "confidence")


@query()
def q_t3_merged_points(s, d):
    """The first three change points of all channels of a window, by time and then channel."""
    marks = B.window_table(s, d, 32).select("window_id", "channel_idx", dsp.change_points_udf(3, "cusum")("values").alias("p"))
    each = F.transform("p", lambda t: F.struct(t.alias("t"), F.col("channel_idx")))
    merged = marks.groupBy("window_id").agg(F.flatten(F.collect_list(each)).alias("all"))
    return merged.select("window_id", F.posexplode(F.slice(F.array_sort("all"), 1, 3)).alias("i", "c")).select("window_id", "i", "c.t", "c.channel_idx")


@query(f"WITH {B.COUNTS}, e AS (SELECT item, round(-sum(share * ln(share + 1e-9)), 9) AS entropy FROM counts GROUP BY 1) SELECT item, CAST(row_number() OVER (ORDER BY entropy DESC, item) AS BIGINT) AS rank FROM e")
def q_w8_rank(s, d):
    e = votes.vote_entropy(B.votes(s, d)).select("item", F.round("entropy", 9).alias("entropy"))
    placed = with_global_rank(e, [F.desc("entropy"), F.col("item")], "r")
    return placed.select("item", (F.col("r") + 1).alias("rank"))


@query(f"WITH {_TRACE_ENTRIES}, fresh AS (SELECT k, arg_min(r, o) AS r FROM entries WHERE k IS NOT NULL AND r IS NOT NULL GROUP BY 1) SELECT k, r FROM cache UNION SELECT k, r FROM fresh WHERE k NOT IN (SELECT k FROM cache)")
def q_u2_cache_union(s, d):
    return llm_cache.prefill(table(s, d, "raw_trace"), _cache(s, d), F.struct("trace_id", "view_id"))[0]


@query("WITH r AS (SELECT window_id, row_number() OVER (ORDER BY (window_id * 7919) % 10007, window_id) - 1 AS r, count(*) OVER () AS n FROM window_index), b AS (SELECT CASE WHEN r < least(50, n) THEN 'gold' WHEN r < least(50, n) + CASE WHEN n > 50 THEN greatest(1, (n - 50) // 5) ELSE 0 END THEN 'test' ELSE 'unlabeled' END AS split FROM r) SELECT split, count(*) AS windows FROM b GROUP BY 1")
def q_u3_partition(s, d):
    return q_t8_split(s, d).groupBy("split").agg(F.count(F.lit(1)).alias("windows"))


@query()
def q_u5_diverse(s, d):
    ctx = B.context(s, d)
    return models.diverse_subset(ctx.features, "item", "features", 0.1).distinct()


@query(f"WITH {B.COUNTS}, p AS (SELECT item, label, share, row_number() OVER (PARTITION BY item ORDER BY share DESC, label) AS r FROM counts) SELECT a.item, '  ml_hint: top=class_' || a.label || ' (p=' || printf('%.2f', a.share) || ')' AS hint FROM p a WHERE r = 1")
def q_d5_hint(s, d):
    top = votes.majority(B.votes(s, d))
    return top.select("item", F.concat(F.lit("  ml_hint: top=class_"), F.col("pred").cast("string"), F.lit(" (p="), F.format_string("%.2f", "share"), F.lit(")")).alias("hint"))


@query(f"""WITH {B.COUNTS}, full_ AS (SELECT t.item, k.k, coalesce(c.share, 0.0) AS p FROM truth t CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(10)) k LEFT JOIN counts c ON c.item = t.item AND c.label = k.k),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p DESC, k DESC) AS r FROM full_)
SELECT a.item, '  ml_hint: top=class_' || a.k || ' (p=' || printf('%.2f', a.p) || '), runner_up=class_' || b.k || ' (p=' || printf('%.2f', b.p) || ')' AS hint FROM r a JOIN r b ON b.item = a.item AND b.r = 2 WHERE a.r = 1""")
def q_d5_hint_line(s, d):
    """The whole line, from the votes' shares as probabilities."""
    shares = votes.vote_counts(B.votes(s, d)).groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("label", "share"))).alias("m"))
    proba = F.transform(F.sequence(F.lit(0), F.lit(B.CLASSES - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    return shares.select("item", labeling.hint_column(proba, [f"class_{i}" for i in range(B.CLASSES)]).alias("hint"))


@query("SELECT trace_id, CAST(0 AS INTEGER) AS label, CAST(0.5 AS DOUBLE) AS confidence FROM raw_trace WHERE response IS NULL")
def q_d7_failed_calls(s, d):
    rows = table(s, d, "raw_trace").where("response is null").select("trace_id", "response")
    return parse.parse_answers(rows, "response", 8).select("trace_id", "label", "confidence")


@query()
def q_m4_downstream(s, d):
    ctx = B.context(s, d, 0.2)
    taken = methods.pipeline(ctx, calibrated=False).where("accept").join(ctx.features, "item")
    return models.downstream_f1(taken, ctx.features.join(B.truth(s, d), "item"), B.CLASSES)


@query()
def q_m6_seeding(s, d):
    ctx = B.context(s, d)
    signals = votes.disagreement(ctx.votes)
    embedded = models.badge_embedding(votes.vote_counts(ctx.votes), signals, B.CLASSES)
    return models.diverse_subset(embedded, "item", "embedding", 0.7)


@query()
def q_compare_methods(s, d):
    from pulsegrid.plans.runner import compare

    truth = B.truth(s, d).withColumn("split", F.when(F.col("item") % 3 == 0, "gold").otherwise("test"))
    return B.rounded(compare(B.context(s, d), truth), "risk", "coverage", "cost", "f1")
