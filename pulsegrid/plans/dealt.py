"""Queries of the general training-data problems (3, 5, 6, 7), each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.operators.line_rescue import rescue_lines, split_lines
from pulsegrid.operators.regular_grid import regular_grid, uncovered_cells
from pulsegrid.operators.schema_drift import fused_schema, schema_changes, unify_rows
from pulsegrid.operators.spikes import flag_measurements
from pulsegrid.plans.bindings import rounded
from pulsegrid.session import real, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "csv_lines")
    return rescue_lines(lines).where("reason is not null and reason <> 'no_header'").select("line_id", "reason")


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(table(spark, sf_dir, "csv_lines"))[0].select("line_id", "value", "is_anomaly")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_grid(table(spark, sf_dir, "charts"), "stay_id", "charttime", gauges=["HR", "SpO2"], cell="minute")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uncovered_cells(_grid(spark, sf_dir), "stay_id", ["HR", "SpO2"], "minute")


def p5_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_grid(spark, sf_dir), "HR", "SpO2")


def p5_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cumulative counter with resets on the grid: the number of rows a stay has had since the shift of 12 hours began."""
    charts = table(spark, sf_dir, "charts").select("reading_id", "stay_id", real(F.col("charttime")).alias("charttime")).where("stay_id is not null and charttime is not null")
    shift = Window.partitionBy("stay_id", F.floor(F.col("charttime") / 43200)).orderBy("charttime", "reading_id")
    counted = charts.select("stay_id", "charttime", F.row_number().over(shift).alias("readings"))
    return rounded(regular_grid(counted, "stay_id", "charttime", counters=["readings"], cell="minute"), "readings")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "series_files")).select("file_id", "change", "field")


def p6_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the types before and after, and whether an alternative appears for the first time on its path."""
    return schema_changes(table(spark, sf_dir, "series_files"))


def p6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify_rows(table(spark, sf_dir, "series_files"))


def p6_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_schema(table(spark, sf_dir, "series_files"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_measurements(table(spark, sf_dir, "charts"), "reading_id", "stay_id", "charttime").select("reading_id", "channel")


def p7_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_measurements(table(spark, sf_dir, "charts"), "reading_id", "stay_id", "charttime")


QUERIES = {f.__name__: f for f in (p3_found, p3_loaded, p5_found, p5_grid, p5_counter, p6_found, p6_changes, p6_rows, p6_schema, p7_found, p7_flags)}

_JUDGED = r"""
WITH heads AS (
  SELECT file_name, rtrim(min(line), chr(13)) AS h FROM csv_lines WHERE line_no = 1 AND file_name IS NOT NULL GROUP BY 1
), split_heads AS (
  SELECT *, CASE WHEN contains(h, chr(9)) THEN chr(9) WHEN contains(h, ';') THEN ';' ELSE ',' END AS d FROM heads
), formats AS (
  SELECT file_name, d, len(names) AS n, list_position(list_transform(names, lambda x: x IN ('value', 'val')), true) AS vi,
         list_position(list_transform(names, lambda x: x IN ('is_anomaly', 'anomaly', 'isanomaly')), true) AS fi
  FROM (SELECT file_name, d, list_transform(string_split(h, d), lambda x: lower(trim(x, ' "'))) AS names FROM split_heads)
), body AS (
  SELECT l.line_id, f.*, CASE WHEN right(coalesce(l.line, ''), 1) = chr(13) THEN left(l.line, length(l.line) - 1) ELSE coalesce(l.line, '') END AS line
  FROM csv_lines l JOIN formats f USING (file_name) WHERE l.line_no <> 1
), sound AS (
  SELECT *, CASE d
    WHEN ',' THEN regexp_full_match(line, '(?s)[ \t]*("([^"]|"")*"[ \t]*|[^",]*)(,[ \t]*("([^"]|"")*"[ \t]*|[^",]*))*')
    WHEN ';' THEN regexp_full_match(line, '(?s)[ \t]*("([^"]|"")*"[ \t]*|[^";]*)(;[ \t]*("([^"]|"")*"[ \t]*|[^";]*))*')
    ELSE regexp_full_match(line, '(?s)[ ]*("([^"]|"")*"[ ]*|[^"\t]*)(\t[ ]*("([^"]|"")*"[ ]*|[^"\t]*))*') END AS ok
  FROM body
), cut AS (
  SELECT *, CASE WHEN NOT ok THEN NULL ELSE list_transform(CASE d
    WHEN ',' THEN regexp_extract_all(line || ',', '([ \t]*("([^"]|"")*"[ \t]*|[^",]*)),', 1)
    WHEN ';' THEN regexp_extract_all(line || ';', '([ \t]*("([^"]|"")*"[ \t]*|[^";]*));', 1)
    ELSE regexp_extract_all(line || chr(9), '([ ]*("([^"]|"")*"[ ]*|[^"\t]*))\t', 1) END,
    lambda x: trim(replace(regexp_replace(trim(x, ' ' || chr(9)), '^"((?s).*)"$', '\1'), '""', '"'), ' ' || chr(9))) END AS cells
  FROM sound
), typed AS (
  SELECT *, cells[vi] AS v, CASE WHEN fi IS NULL THEN '' ELSE cells[fi] END AS f FROM cut
), judged AS (
  SELECT line_id, CASE WHEN NOT ok THEN 'quoting' WHEN len(cells) <> n THEN 'column_count'
    WHEN v IS NULL OR NOT regexp_full_match(v, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') OR NOT coalesce(isfinite(try_cast(replace(v, '+', '') AS DOUBLE)), false)
      OR f NOT IN ('', '0', '1', '0.0', '1.0') THEN 'invalid_value' END AS reason,
    try_cast(CASE WHEN left(v, 1) = '+' THEN substr(v, 2) ELSE v END AS DOUBLE) AS value, CASE WHEN f IN ('1', '1.0') THEN 1 ELSE 0 END AS is_anomaly
  FROM typed
)
"""

_CH = ("HR", "SpO2")
_GRID_SQL = f"""
WITH c AS (
  SELECT stay_id, charttime AS t, {", ".join(f"avg(CASE WHEN NOT isnan({x}) THEN {x} END) AS {x}" for x in _CH)} FROM charts
  WHERE stay_id IS NOT NULL AND charttime IS NOT NULL AND NOT isnan(charttime) GROUP BY 1, 2
), m AS (
  SELECT stay_id, CAST(floor(t / 60) AS BIGINT) AS m, {", ".join(f"avg({x}) AS {x}, min(t) FILTER (WHERE {x} IS NOT NULL) AS ft_{x}, arg_min({x}, t) FILTER (WHERE {x} IS NOT NULL) AS fv_{x}, max(t) FILTER (WHERE {x} IS NOT NULL) AS lt_{x}, arg_max({x}, t) FILTER (WHERE {x} IS NOT NULL) AS lv_{x}" for x in _CH)}
  FROM c GROUP BY 1, 2
), n AS (
  SELECT *, lead(m) OVER (PARTITION BY stay_id ORDER BY m) AS nx,
    {", ".join(f"last_value(lt_{x} IGNORE NULLS) OVER b AS pt_{x}, last_value(lv_{x} IGNORE NULLS) OVER b AS pv_{x}, first_value(ft_{x} IGNORE NULLS) OVER a AS nt_{x}, first_value(fv_{x} IGNORE NULLS) OVER a AS nv_{x}" for x in _CH)}
  FROM m WINDOW b AS (PARTITION BY stay_id ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY stay_id ORDER BY m ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), e AS (
  SELECT *, unnest(generate_series(m, CASE WHEN nx - m - 1 <= 720 THEN nx - 1 ELSE m END)) AS minute FROM n
)
SELECT stay_id, minute, {", ".join(f"round(CASE WHEN minute = m AND {x} IS NOT NULL THEN {x} WHEN nt_{x} - pt_{x} <= 43200 THEN (pv_{x} + nv_{x}) / 2 END, 6) + 0.0 AS {x}, CASE WHEN minute = m AND {x} IS NOT NULL THEN 'observed' WHEN nt_{x} - pt_{x} <= 43200 THEN 'filled' ELSE 'missing' END AS {x}_state" for x in _CH)} FROM e
"""

SQL = {
    "p3_found": _JUDGED + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_loaded": _JUDGED + "SELECT line_id, value, CAST(is_anomaly AS INTEGER) AS is_anomaly FROM judged WHERE reason IS NULL",
    "p5_grid": _GRID_SQL,
    "p5_counter": """
WITH k AS (
  SELECT stay_id, charttime AS t, row_number() OVER (PARTITION BY stay_id, floor(charttime / 43200) ORDER BY charttime, reading_id) AS n
  FROM charts WHERE stay_id IS NOT NULL AND charttime IS NOT NULL AND NOT isnan(charttime)
), c AS (
  SELECT stay_id, t, avg(n) AS v FROM k GROUP BY 1, 2
), i AS (
  SELECT stay_id, t, v, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM c WINDOW w AS (PARTITION BY stay_id ORDER BY t)
), p AS (
  SELECT stay_id, t, t2, CASE WHEN v2 < v THEN v2 ELSE v2 - v END / (t2 - t) AS rate, unnest(generate_series(CAST(floor(t / 60) AS BIGINT), CAST(floor(t2 / 60) AS BIGINT))) AS minute
  FROM i WHERE t2 - t <= 43200
), g AS (
  SELECT stay_id, minute, sum(rate * (least(t2, (minute + 1) * 60.0) - greatest(t, minute * 60.0))) AS readings FROM p GROUP BY 1, 2
), m AS (
  SELECT stay_id, CAST(floor(t / 60) AS BIGINT) AS m FROM c GROUP BY 1, 2
), n AS (
  SELECT *, lead(m) OVER (PARTITION BY stay_id ORDER BY m) AS nx FROM m
), e AS (
  SELECT stay_id, m, unnest(generate_series(m, CASE WHEN nx - m - 1 <= 720 THEN nx - 1 ELSE m END)) AS minute FROM n
)
SELECT stay_id, minute, round(CASE WHEN minute = m THEN coalesce(readings, 0.0) ELSE readings END, 6) + 0.0 AS readings,
  CASE WHEN minute = m THEN 'observed' WHEN readings IS NOT NULL THEN 'filled' ELSE 'missing' END AS readings_state
FROM e LEFT JOIN g USING (stay_id, minute)
""",
    "p5_found": """
WITH c AS (
  SELECT stay_id, CAST(floor(charttime / 60) AS BIGINT) AS m, HR, SpO2 FROM charts WHERE stay_id IS NOT NULL AND charttime IS NOT NULL AND NOT isnan(charttime)
), m AS (
  SELECT stay_id, m, bool_or(HR IS NOT NULL AND NOT isnan(HR)) AS hr, bool_or(SpO2 IS NOT NULL AND NOT isnan(SpO2)) AS spo2 FROM c GROUP BY 1, 2
), n AS (
  SELECT *, lead(m) OVER (PARTITION BY stay_id ORDER BY m) AS nx FROM m
), e AS (
  SELECT stay_id, unnest(generate_series(m, CASE WHEN nx - m - 1 <= 720 THEN nx - 1 ELSE m END)) AS minute, m, hr, spo2 FROM n
)
SELECT stay_id, minute, 'HR' AS channel FROM e WHERE minute > m OR NOT hr
UNION ALL SELECT stay_id, minute, 'SpO2' FROM e WHERE minute > m OR NOT spo2
""",
}
