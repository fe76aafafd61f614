"""Queries: run logs. The log lines are written from ``orders`` and ``lineitem``, one file per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowdrift.operators import ordering, runlog
from flowdrift.plans.registry import query
from flowdrift.plans.tables import rounded, table

_LINE_SQL = """CASE o_orderpriority
  WHEN '1-URGENT' THEN '12:00 INFO === CE Model Calibration Summary ==='
  WHEN '2-HIGH' THEN '12:00 INFO === Classifier Model Performance Summary ==='
  WHEN '3-MEDIUM' THEN concat('12:00 INFO [==OVERALL SIM STATS==] Avg Accuracy: ', '0.', cast(o_orderkey % 9000 + 1000 AS {text}))
  WHEN '4-NOT SPECIFIED' THEN concat('12:00 INFO [==OVERALL SIM STATS==] ',
     CASE o_orderkey % 4 WHEN 0 THEN 'Drift Detection Rate: ' WHEN 1 THEN 'Total simulate time: '
       WHEN 2 THEN 'Median Chunk Size: ' ELSE 'Drift Intervals (in chunks): ' END,
     CASE o_orderkey % 4 WHEN 0 THEN concat(cast(o_orderkey % 100 AS {text}), '.5%') WHEN 1 THEN concat(cast(o_orderkey % 60 AS {text}), '.25s')
       WHEN 2 THEN cast(o_orderkey % 500 AS {text}) ELSE '[1, 2, 3]' END)
  ELSE concat('12:00 INFO run modelVariant=', CASE o_custkey % 5 WHEN 0 THEN 'RandomForest' WHEN 1 THEN 'xgboost' WHEN 2 THEN 'DT'
     WHEN 3 THEN 'feedforward' ELSE 'other' END, ' ceType=', CASE o_orderkey % 4 WHEN 0 THEN 'APPROX_CCE' WHEN 1 THEN 'cce'
     WHEN 2 THEN 'ice' ELSE 'approx_tce' END) END"""

_LINES_SQL = f"""lines AS (SELECT concat('/logs/', CASE o_custkey % 3 WHEN 0 THEN 'svm' WHEN 1 THEN 'knn' ELSE 'misc' END, '/run_',
 cast(o_custkey AS varchar), '.log') AS path, o_orderkey AS line_no, {_LINE_SQL.format(text="varchar")} AS text FROM orders)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = "CASE o_custkey % 3 WHEN 0 THEN 'svm' WHEN 1 THEN 'knn' ELSE 'misc' END"
    return table(spark, sf_dir, "orders").selectExpr(
        f"concat('/logs/', {folder}, '/run_', cast(o_custkey AS string), '.log') AS path",
        "o_orderkey AS line_no",
        f"{_LINE_SQL.format(text='string')} AS text",
    )


_STATS_SQL = f"""{_LINES_SQL}, sections AS (SELECT *, CASE
   WHEN contains(text, '=== CE Model Calibration Summary ===') THEN 'CE Model'
   WHEN contains(text, '=== Classifier Model Performance Summary ===') THEN 'Classifier Model' END AS section FROM lines),
placed AS (SELECT *, last_value(section IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) AS current FROM sections),
pairs AS (SELECT path, line_no, current,
  trim(regexp_extract(text, '\\[==OVERALL SIM STATS==\\]\\s+(.*?):\\s+(.*)', 1)) AS k,
  trim(regexp_extract(text, '\\[==OVERALL SIM STATS==\\]\\s+(.*?):\\s+(.*)', 2)) AS raw
  FROM placed WHERE regexp_matches(text, '\\[==OVERALL SIM STATS==\\]\\s+(.*?):\\s+(.*)')),
stats AS (SELECT path, line_no, CASE WHEN k IN ('Average Chunk Size', 'Median Chunk Size', 'Standard Deviation of Chunk Sizes') OR current IS NULL
  THEN k ELSE concat('[', current, '] ', k) END AS stat, raw, try_cast(trim(raw, '%s') AS double) AS value FROM pairs)"""


@query("k1_extract_stats", f"WITH {_STATS_SQL} SELECT path, line_no, stat, raw FROM stats")
def extract_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.extract_stats(lines(spark, sf_dir)).select("path", "line_no", "stat", "raw")


@query("k2_parse_stat_value", f"WITH {_STATS_SQL} SELECT path, line_no, value FROM stats WHERE value IS NOT NULL")
def parse_stat_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.numeric_stats(runlog.extract_stats(lines(spark, sf_dir))).select("path", "line_no", "value")


@query(
    "f6_best_by_stat",
    f"""WITH {_STATS_SQL}, known AS (SELECT * FROM stats WHERE value IS NOT NULL),
modes AS (SELECT stat, CASE WHEN stat IN ('Total simulate time') THEN 'min' WHEN stat IN ('Drift Detection Rate') THEN 'both'
   WHEN stat IN ('Median Chunk Size') THEN 'all' ELSE 'max' END AS mode, min(value) AS low, max(value) AS high FROM known GROUP BY ALL)
SELECT path, stat, raw, best FROM (
 SELECT k.path, k.stat, k.raw, 'highest' AS best FROM known k JOIN modes m USING (stat) WHERE m.mode IN ('max', 'both') AND k.value = m.high
 UNION ALL SELECT k.path, k.stat, k.raw, 'lowest' FROM known k JOIN modes m USING (stat) WHERE m.mode IN ('min', 'both') AND k.value = m.low
 UNION ALL SELECT k.path, k.stat, k.raw, 'listed' FROM known k JOIN modes m USING (stat) WHERE m.mode = 'all')""",
)
def best_by_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = runlog.numeric_stats(runlog.extract_stats(lines(spark, sf_dir)))
    return ordering.best_by_stat(known, "stat", "value", runlog.STAT_MODES).select("path", "stat", "raw", "best")


@query(
    "f7_last_record_per_file",
    f"""WITH {_LINES_SQL} SELECT path, max(line_no) AS line_no, arg_max(text, line_no) AS text FROM lines
WHERE contains(text, 'SIM STATS') GROUP BY path""",
)
def last_record_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.last_record_per_file(lines(spark, sf_dir).filter(F.contains(F.col("text"), F.lit("SIM STATS"))))


@query(
    "k4_canonical_name",
    f"""WITH {_LINES_SQL}, found AS (SELECT path, line_no, lower(regexp_extract(text, 'modelVariant\\s*=\\s*([A-Za-z0-9_\\-]+)', 1)) AS m,
  lower(regexp_extract(text, 'ceType\\s*=\\s*([A-Za-z0-9_\\-]+)', 1)) AS c FROM lines),
named AS (SELECT path, line_no, CASE WHEN contains(m, 'dt') THEN 'dt' WHEN contains(m, 'randomforest') THEN 'rf'
  WHEN contains(m, 'xgb') THEN 'xgb' WHEN contains(m, 'feedforward') THEN 'ffn' END AS classifier,
  CASE WHEN contains(c, 'approx_cce') THEN 'approx-cce' WHEN contains(c, 'cce') THEN 'cce' WHEN contains(c, 'ice') THEN 'ice'
  WHEN contains(c, 'tce') THEN 'tce' END AS ce_type FROM found),
files AS (SELECT path, arg_min(classifier, line_no) FILTER (classifier IS NOT NULL) AS classifier,
  arg_min(ce_type, line_no) FILTER (ce_type IS NOT NULL) AS ce_type FROM named GROUP BY path)
SELECT path, coalesce(classifier, CASE WHEN contains(path, 'svm') THEN 'svm' WHEN contains(path, 'knn') THEN 'knn' ELSE 'unknown' END) AS classifier,
  coalesce(ce_type, 'unknown') AS ce_type FROM files""",
)
def canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.run_names(lines(spark, sf_dir))


# One report line per order: metric lists written out as text, one file per customer.
_REPORT_TEXT = """concat('INFO __main__: Full performance stats: perf_stats = PerformanceStats(iteration_times=[0.1], ce_stats=ModelStats(accuracies=[',
 cast(o_orderkey % 100 AS {text}), '%, nan, ', cast(o_custkey % 50 AS {text}), '], precisions=[0.', cast(o_orderkey AS {text}), '], recalls=[], f1s=[x, 0.5]), ',
 'classifier_stats=ModelStats(accuracies=[0.', cast(o_custkey + 1 AS {text}), ', 0.25], precisions=[0.0', cast(o_custkey % 9 AS {text}), '], recalls=[1.0], f1s=[]))')"""

_REPORTS_SQL = f"""reports AS (SELECT o_orderkey, concat('run_', cast(o_custkey AS varchar)) AS path,
 o_orderkey AS line_no, {_REPORT_TEXT.format(text="varchar")} AS text FROM orders),
blocks AS ({" UNION ALL ".join(f"SELECT * EXCLUDE (text), '{s}' AS series, regexp_extract(text, '{b}=ModelStats\\((.*?)\\)', 1) AS inner_text FROM reports" for s, b in (("ce", "ce_stats"), ("classifier", "classifier_stats")))}),
listed AS ({" UNION ALL ".join(f"SELECT * EXCLUDE (inner_text), '{m}' AS metric, string_split(regexp_extract(inner_text, '{m}=\\[([^\\]]*)\\]', 1), ',') AS tokens FROM blocks" for m in ("accuracies", "precisions", "recalls", "f1s"))}),
numbers AS (SELECT * EXCLUDE (tokens), list_filter(list_transform(tokens, lambda t: CASE WHEN lower(trim(t)) <> 'nan'
  THEN try_cast(rtrim(trim(t), '%') AS double) END), lambda v: v IS NOT NULL) AS vals FROM listed),
series AS (SELECT * EXCLUDE (vals), unnest(vals) AS value, generate_subscripts(vals, 1) AS step FROM numbers)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "concat('run_', cast(o_custkey AS string)) AS path",
        "o_orderkey AS line_no",
        f"{_REPORT_TEXT.format(text='string')} AS text",
    )


@query(
    "k3_extract_series",
    f"""WITH {_REPORTS_SQL} SELECT o_orderkey, series, metric, cast(step AS bigint) AS step, round(value, 9) AS value FROM series""",
)
def extract_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runlog.extract_series(reports(spark, sf_dir), ["o_orderkey"]), 9)


@query(
    "k5_rescale_percent",
    f"""WITH {_REPORTS_SQL.replace("series AS (", "series AS MATERIALIZED (")}
SELECT o_orderkey, path AS classifier, series, metric, cast(step AS bigint) AS step,
 round(CASE WHEN max(value) OVER (PARTITION BY path, metric) > 1.05 THEN value / 100 ELSE value END, 9) AS value
FROM series""",
)
def rescale_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports(spark, sf_dir).withColumnRenamed("path", "classifier")
    return rounded(runlog.rescale_percent(runlog.extract_series(found, ["o_orderkey", "classifier"])), 9)


@query(
    "k6_runs_by_group",
    f"""WITH {_REPORTS_SQL}, last_line AS (SELECT path, max(line_no) AS last FROM reports GROUP BY path)
SELECT 'unknown' AS classifier, series, s.path AS run, 'unknown' AS ce_type, metric, cast(step AS bigint) AS step, round(value, 9) AS value
FROM series s JOIN last_line l ON s.path = l.path AND s.line_no = l.last""",
)
def runs_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last report of each file, with the names found in its text."""
    return rounded(runlog.runs_by_group(reports(spark, sf_dir), [*runlog.CE_ORDER, "unknown"]), 9)
