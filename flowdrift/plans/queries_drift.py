"""Queries: row order, metrics, conformal scores and controllers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowdrift.config import ChunkConfig
from flowdrift.operators import conformal, control, metrics, ordering
from flowdrift.plans.queries_clean import _PREDICTED_SQL, predicted
from flowdrift.plans.registry import query
from flowdrift.plans.tables import RAW_FLOWS_SQL, raw_flows, rounded, table

# Row order -----------------------------------------------------------------


@query(
    "f1_assign_chunks",
    f"""WITH {RAW_FLOWS_SQL}, n AS (SELECT event_id, row_number() OVER (ORDER BY timestamp, event_id) AS row_no FROM raw_flows)
SELECT event_id, row_no, (row_no - 1) // 1000 AS chunk_id FROM n""",
)
def assign_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = raw_flows(spark, sf_dir).select("event_id", "timestamp")
    return ordering.assign_chunks(arrived, 1000, ["timestamp", "event_id"]).select("event_id", "row_no", "chunk_id")


@query(
    "f1_assign_chunks_per_stream",
    f"""WITH {RAW_FLOWS_SQL}, n AS (
SELECT event_id, dst_ip, row_number() OVER (PARTITION BY dst_ip ORDER BY timestamp, event_id) AS row_no FROM raw_flows)
SELECT event_id, dst_ip, row_no, (row_no - 1) // 250 AS chunk_id FROM n""",
)
def assign_chunks_per_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = raw_flows(spark, sf_dir).select("event_id", "dst_ip", "timestamp")
    chunks = ordering.assign_chunks(arrived, 250, ["timestamp", "event_id"], by=["dst_ip"])
    return chunks.select("event_id", "dst_ip", "row_no", "chunk_id")


_CHUNKED_SQL = f"""{RAW_FLOWS_SQL}, chunked AS (
SELECT event_id, epoch_us(timestamp) + flow_duration * 1000000 AS end_us,
       (row_number() OVER (ORDER BY timestamp, event_id) - 1) // 1000 AS chunk_id FROM raw_flows)"""


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = raw_flows(spark, sf_dir).select(
        "event_id", "timestamp", F.timestamp_micros(F.unix_micros("timestamp") + F.col("flow_duration") * 1_000_000).alias("end_time")
    )
    return ordering.assign_chunks(arrived, 1000, ["timestamp", "event_id"]).select("event_id", "end_time", "chunk_id")


@query(
    "f2_trailing_window_rows",
    f"""WITH {_CHUNKED_SQL},
newest AS (SELECT chunk_id AS after_chunk, max(max(end_us)) OVER (ORDER BY chunk_id) AS newest FROM chunked GROUP BY chunk_id)
SELECT c.event_id, c.chunk_id, n.after_chunk FROM chunked c JOIN newest n
ON c.chunk_id <= n.after_chunk AND c.end_us >= n.newest - 7200000000""",
)
def trailing_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = ordering.trailing_window_rows(chunked(spark, sf_dir), "end_time", duration_us=7_200_000_000)
    return seen.select("event_id", "chunk_id", "after_chunk")


@query(
    "f3_sliding_accuracy",
    f"""WITH {_PREDICTED_SQL}, w AS (
SELECT event_id, row_number() OVER (ORDER BY event_id) AS row_no,
 avg(cast(label = prediction AS double)) OVER (ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS a FROM predicted)
SELECT event_id, row_no, round(a, 6) AS sliding_accuracy FROM w WHERE row_no >= 100""",
)
def sliding_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = predicted(spark, sf_dir).select("event_id", (F.col("label") == F.col("prediction")).alias("correct"))
    moving = ordering.sliding_accuracy(scored, ["event_id"], "correct", block=1_000)
    return rounded(moving.select("event_id", "row_no", "sliding_accuracy"))


# A chunk of 20 flows drifts when its first flow is an attack.
_DRIFTS_SQL = f"""{RAW_FLOWS_SQL}, chunk_drift AS (
SELECT event_id // 20 AS chunk_id, count(*) AS rows, arg_min(label <> 'Benign', event_id) AS drift
FROM raw_flows GROUP BY 1)"""


def chunk_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_flows(spark, sf_dir).select(
        "event_id", F.floor(F.col("event_id") / 20).alias("chunk_id"), (F.col("label") != "Benign").alias("drift")
    )
    return conformal.detect_drift(rows, ["chunk_id"], "event_id")


@query(
    "f4_drift_intervals",
    f"""WITH {_DRIFTS_SQL} SELECT chunk_id, chunk_id - lag(chunk_id) OVER (ORDER BY chunk_id) AS drift_interval
FROM chunk_drift WHERE drift""",
)
def drift_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.drift_intervals(chunk_drift(spark, sf_dir))


@query(
    "f5_sort_flows",
    f"""WITH {RAW_FLOWS_SQL} SELECT event_id, epoch_us(timestamp) AS timestamp FROM raw_flows ORDER BY timestamp DESC""",
)
def sort_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = raw_flows(spark, sf_dir).select("event_id", "timestamp")
    return rounded(ordering.sort_flows(flows, "timestamp", descending=True))


@query(
    "a7_last_n",
    f"""WITH {RAW_FLOWS_SQL} SELECT event_id, label FROM raw_flows ORDER BY event_id DESC LIMIT 1000""",
)
def last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.last_n(raw_flows(spark, sf_dir).select("event_id", "label"), 1000, ["event_id"])


@query(
    "a7_last_n_per_stream",
    f"""WITH {RAW_FLOWS_SQL} SELECT event_id, src_ip FROM raw_flows
QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY event_id DESC) <= 20""",
)
def last_n_per_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.last_n(raw_flows(spark, sf_dir).select("event_id", "src_ip"), 20, ["event_id"], by=["src_ip"])


@query(
    "a7_last_n_per_stream_large",
    f"""WITH {RAW_FLOWS_SQL} SELECT event_id, dst_ip FROM raw_flows
QUALIFY row_number() OVER (PARTITION BY dst_ip ORDER BY event_id DESC) <= 1500""",
)
def last_n_per_stream_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More rows per stream than the window group limit covers."""
    return ordering.last_n(raw_flows(spark, sf_dir).select("event_id", "dst_ip"), 1500, ["event_id"], by=["dst_ip"])


@query(
    "j6_seed_log",
    f"""WITH {RAW_FLOWS_SQL}
SELECT cast(tot_fwd_pkts AS double) AS tot_fwd_pkts, cast(flow_duration AS double) AS flow_duration,
       NULL::double AS idle_mean, CASE WHEN label = 'Benign' THEN 0::bigint ELSE 1::bigint END AS "BinLabel", event_id AS seq
FROM raw_flows ORDER BY event_id DESC LIMIT 5000""",
)
def seed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowdrift.sources.rolling_log import seed_rows

    columns = ["tot_fwd_pkts", "flow_duration", "idle_mean", "BinLabel"]
    return rounded(seed_rows(raw_flows(spark, sf_dir), 5000, "event_id", columns, label="label"))


# Metrics -------------------------------------------------------------------

_PAIRS_SQL = f"""{_PREDICTED_SQL}, classes AS (SELECT DISTINCT label AS class FROM predicted),
report AS (SELECT class, count(*) FILTER (label = class AND prediction = class) AS hits,
 count(*) FILTER (prediction = class) AS said, count(*) FILTER (label = class) AS support
 FROM predicted, classes GROUP BY class),
scored AS (SELECT class, support, CASE WHEN said > 0 THEN hits / said ELSE 0 END AS precision,
 CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
 CASE WHEN said + support > 0 THEN 2 * hits / (said + support) ELSE 0 END AS f1, hits FROM report)"""


@query(
    "h1_confusion_matrix",
    f"""WITH {_PREDICTED_SQL}, known AS (SELECT unnest(['Benign', 'TCPAttack', 'UDPAttack', 'XMasAttack']) AS class)
SELECT a.class AS actual, p.class AS predicted, count(x.event_id) AS n
FROM known a CROSS JOIN known p LEFT JOIN predicted x ON x.label = a.class AND x.prediction = p.class GROUP BY ALL""",
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Benign", "TCPAttack", "UDPAttack", "XMasAttack"]
    return metrics.confusion_matrix(predicted(spark, sf_dir), labels=names)


_BINARY_SQL = f"""{_PREDICTED_SQL}, b AS (SELECT label <> 'Benign' AS pos, prediction <> 'Benign' AS said FROM predicted),
k AS (SELECT count(*) FILTER (pos AND said) AS tp, count(*) FILTER (NOT pos AND said) AS fp,
 count(*) FILTER (pos AND NOT said) AS fn, count(*) FILTER (NOT pos AND NOT said) AS tn FROM b)"""


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).select(
        (F.col("label") != "Benign").cast("int").alias("label"),
        (F.col("prediction") != "Benign").cast("int").alias("prediction"),
    )


@query(
    "h2_binary_metrics",
    f"""WITH {_BINARY_SQL} SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
 round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
 round(tn / (tn + fp), 6) AS specificity FROM k""",
)
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.binary_metrics(_binary(spark, sf_dir)))


@query(
    "h3_averaged_metrics",
    f"""WITH {_PAIRS_SQL}
SELECT 'macro' AS average, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision,
 round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM scored
UNION ALL SELECT 'weighted', round(sum(hits) / sum(support), 6), round(sum(precision * support) / sum(support), 6),
 round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) FROM scored""",
)
def averaged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = predicted(spark, sf_dir)
    both = [metrics.averaged_metrics(pairs, a).withColumn("average", F.lit(a)) for a in ("macro", "weighted")]
    return rounded(conformal.union_all(both))


@query(
    "h4_classification_report",
    f"""WITH {_PAIRS_SQL} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,
 round(f1, 6) AS f1, support FROM scored""",
)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.classification_report(predicted(spark, sf_dir)))


@query("h5_specificity", f"WITH {_BINARY_SQL} SELECT tn, fp, round(tn / (tn + fp), 6) AS specificity FROM k")
def specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.specificity(_binary(spark, sf_dir)))


# One run per supplier and line status, one calibration per order line.
@query(
    "h6_run_summary",
    """SELECT l_suppkey, count(*) AS calibrations, round(avg(1 - l_discount), 6) AS avg_accuracy,
 round(avg(1 - l_tax), 6) AS avg_precision, round(avg(l_quantity / 50), 6) AS avg_recall,
 round(avg(l_discount), 6) AS avg_f1, round(stddev_pop(1 - l_discount), 6) AS std_accuracy
FROM lineitem GROUP BY l_suppkey""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        (1 - F.col("l_discount")).alias("accuracy"),
        (1 - F.col("l_tax")).alias("precision"),
        (F.col("l_quantity") / 50).alias("recall"),
        F.col("l_discount").alias("f1"),
    )
    return rounded(metrics.run_summary(runs, ["l_suppkey"]))


@query(
    "h7_timing_summary",
    """SELECT l_returnflag, count(*) AS count, round(avg(l_extendedprice), 4) AS mean,
 round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(stddev_samp(l_extendedprice), 4) AS std,
 round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max FROM lineitem GROUP BY l_returnflag""",
)
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return rounded(metrics.timing_summary(lines, "l_extendedprice", ["l_returnflag"]), 4)


@query(
    "h8_overall_accuracy",
    f"WITH {_PREDICTED_SQL} SELECT round(avg(cast(label = prediction AS double)), 6) AS accuracy, count(*) AS rows FROM predicted",
)
def overall_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = predicted(spark, sf_dir).withColumn("correct", F.col("label") == F.col("prediction"))
    return rounded(metrics.overall_accuracy(scored))


@query(
    "h9_drift_summary",
    f"""WITH {_DRIFTS_SQL}, gaps AS (SELECT chunk_id - lag(chunk_id) OVER (ORDER BY chunk_id) AS gap FROM chunk_drift WHERE drift)
SELECT count(*) FILTER (drift) AS drifts, cast(sum(rows) AS bigint) AS scored_rows,
 round(count(*) FILTER (drift) / sum(rows), 6) AS drift_rate, round(count(*) FILTER (drift) / count(*), 6) AS drift_rate_per_chunk,
 (SELECT round(avg(gap), 6) FROM gaps) AS mean_interval FROM chunk_drift""",
)
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.drift_summary(chunk_drift(spark, sf_dir)))


@query(
    "h9_drift_interval_histogram",
    f"""WITH {_DRIFTS_SQL}, gaps AS (SELECT chunk_id - lag(chunk_id) OVER (ORDER BY chunk_id) AS gap FROM chunk_drift WHERE drift)
SELECT gap AS drift_interval, count(*) AS n FROM gaps WHERE gap IS NOT NULL GROUP BY gap""",
)
def drift_interval_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.drift_interval_histogram(chunk_drift(spark, sf_dir))


# Conformal scores -----------------------------------------------------------
# Lines shipped before 1998 calibrate, later lines are tested.

_SCORES_SQL = """scores AS (
SELECT l_orderkey, cast(l_linenumber AS bigint) AS l_linenumber, l_returnflag AS class, (cast(round(l_extendedprice * 100) AS bigint) * (100 - cast(round(l_discount * 100) AS bigint)) // 12000) / 100000 AS score,
       l_shipdate < TIMESTAMP '1998-01-01' AS calibrates FROM lineitem),
cal AS (SELECT class, score FROM scores WHERE calibrates),
test AS (SELECT l_orderkey, l_linenumber, class, score FROM scores WHERE NOT calibrates)"""


def scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint") * (100 - F.round(F.col("l_discount") * 100).cast("bigint"))
    score = F.floor(cents / 12000) / 100000
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    columns = ["l_orderkey", "l_linenumber", F.col("l_returnflag").alias("class"), score.alias("score")]
    return lines.filter(early).select(*columns[2:]), lines.filter(~early).select(*columns)


@query(
    "i1_nonconformity",
    f"""SELECT l_orderkey, cast(l_linenumber AS bigint) AS l_linenumber, l_partkey, l_suppkey, round(1 - CASE WHEN l_linestatus = 'F' THEN l_discount ELSE 1 - l_discount END, 9)
 AS score FROM lineitem""",
)
def nonconformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_linestatus") != "F").cast("int"))
    probability = F.array(F.col("l_discount"), 1 - F.col("l_discount"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rounded(lines.select(*keys, conformal.nonconformity(probability, "label").alias("score")), 9)


@query(
    "i2_nonconformity_pred",
    """SELECT l_orderkey, cast(l_linenumber AS bigint) AS l_linenumber, l_partkey, l_suppkey, round(1 - greatest(l_quantity / 50, 1 - l_quantity / 50), 9) AS score FROM lineitem""",
)
def nonconformity_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_quantity") / 50
    lines = table(spark, sf_dir, "lineitem").withColumn("prediction", F.when(p >= 0.5, 0).otherwise(1))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rounded(lines.select(*keys, conformal.nonconformity_pred(F.array(p, 1 - p)).alias("score")), 9)


@query(
    "i3_class_thresholds",
    f"WITH {_SCORES_SQL} SELECT class, round(quantile_cont(score, 0.95), 6) AS threshold FROM cal GROUP BY class",
)
def class_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(conformal.class_thresholds(scores(spark, sf_dir)[0], 0.05))


_P_SQL = f"""{_SCORES_SQL}, counts AS (SELECT class, score, sum(c) AS c FROM (
 SELECT class, score, 1 AS c FROM cal UNION ALL SELECT class, score, 0 FROM test) GROUP BY ALL),
above AS (SELECT class, score, sum(c) OVER (PARTITION BY class ORDER BY score DESC) AS above,
 sum(c) OVER (PARTITION BY class) AS size FROM counts),
p AS (SELECT l_orderkey, l_linenumber, class, score, (above + 1) / (size + 1) AS p_value FROM test JOIN above USING (class, score))"""


@query("i4_p_values", f"WITH {_P_SQL} SELECT l_orderkey, l_linenumber, class, score, round(p_value, 9) AS p_value FROM p")
def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal, test = scores(spark, sf_dir)
    return rounded(conformal.p_values(test, conformal.calibration_counts(cal)), 9)


@query(
    "i4_p_values_distributed",
    f"WITH {_P_SQL} SELECT l_orderkey, l_linenumber, class, score, round(p_value, 9) AS p_value FROM p",
)
def p_values_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same p-values with few rows in each score range."""
    cal, test = scores(spark, sf_dir)
    return rounded(conformal.p_values(test, conformal.calibration_counts(cal)), 9)


_ODD = "CASE class WHEN 'A' THEN 0 WHEN 'N' THEN 1 END"


@query(
    "i4_p_values_odd_rows",
    f"""WITH {_SCORES_SQL}, known AS (SELECT {_ODD} AS k, score FROM cal WHERE class <> 'R' AND score <= 0.6),
size AS (SELECT k, count(*) AS size FROM known GROUP BY k),
asked AS (SELECT l_orderkey, l_linenumber, {_ODD} AS k, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE score END AS score FROM test),
above AS (SELECT a.k, a.score, (SELECT count(*) FROM known n WHERE n.k = a.k AND n.score >= a.score) AS above
 FROM (SELECT DISTINCT k, score FROM asked) a)
SELECT l_orderkey, l_linenumber, cast(a.k AS bigint) AS k, round((above + 1) / (size + 1), 9) AS p_value
FROM asked a LEFT JOIN above b ON a.k = b.k AND a.score = b.score LEFT JOIN size s ON s.k = a.k""",
)
def p_values_odd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number classes with NULL among them, NaN scores on both sides."""
    odd = lambda df, nan: df.withColumns({"k": F.expr(_ODD), "score": F.when(nan, F.lit(float("nan"))).otherwise(F.col("score"))}).drop("class")
    cal, test = scores(spark, sf_dir)
    counts = conformal.calibration_counts(odd(cal, F.col("score") > 0.6), "k")
    asked = odd(test, F.col("l_linenumber") % 4 == 0)
    return rounded(conformal.p_values(asked, counts, "k").select("l_orderkey", "l_linenumber", "k", "p_value"), 9)


_FOLDS_SQL = """fold_scores AS (
SELECT o_orderkey, model, cast((o_custkey * (model + 1) + o_orderkey) % 3 AS bigint) AS prediction,
       ((o_custkey + model * 37) % 100) / 100 AS score FROM orders, range(5) AS t(model)),
votes AS (SELECT o_orderkey, prediction, count(*) AS n FROM fold_scores GROUP BY ALL),
best AS (SELECT o_orderkey, arg_max(prediction, (n, -prediction)) AS class FROM votes GROUP BY ALL)"""
_COMBINED_SQL = f"""WITH {_FOLDS_SQL} SELECT o_orderkey, class, round(avg(score), 6) AS score
FROM fold_scores JOIN best USING (o_orderkey) GROUP BY ALL"""


@query("i7_predict_cce", _COMBINED_SQL)
def predict_cce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five fold models as columns of one row."""
    models = range(5)
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        *[((F.col("o_custkey") * (m + 1) + F.col("o_orderkey")) % 3).alias(f"p{m}") for m in models],
        *[(((F.col("o_custkey") + m * 37) % 100) / 100).alias(f"s{m}") for m in models],
    )
    combined = conformal.combine_folds(rows, [f"p{m}" for m in models], [f"s{m}" for m in models])
    return rounded(combined.select("o_orderkey", "class", "score"))


@query("i7_predict_cce_long", _COMBINED_SQL)
def predict_cce_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five fold models as one row each."""
    rows = table(spark, sf_dir, "orders").withColumn("model", F.explode(F.array(*[F.lit(m) for m in range(5)])))
    long = rows.select(
        "o_orderkey",
        ((F.col("o_custkey") * (F.col("model") + 1) + F.col("o_orderkey")) % 3).alias("prediction"),
        (((F.col("o_custkey") + F.col("model") * 37) % 100) / 100).alias("score"),
    )
    return rounded(conformal.combine_folds_long(long, ["o_orderkey"]))


@query(
    "i10_detect_drift",
    f"""WITH {_P_SQL}, t AS (SELECT class, quantile_cont(score, 0.95) AS threshold FROM cal GROUP BY class),
flagged AS (SELECT l_orderkey // 100 AS chunk_id, p_value < threshold AS drift, p_value FROM p JOIN t USING (class))
SELECT chunk_id, count(*) AS rows, bool_or(drift) AS any_drift, avg(cast(drift AS double)) > 0.9 AS rate_drift,
 bool_or(p_value < 0.05) AS epsilon_drift FROM flagged GROUP BY chunk_id""",
)
def detect_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal, test = scores(spark, sf_dir)
    counts = conformal.calibration_counts(cal)
    scored = conformal.p_values(test, counts).withColumn("chunk_id", F.floor(F.col("l_orderkey") / 100))
    limits = conformal.class_thresholds(counts, 0.05, counted="n")
    flagged = conformal.drift_flags(scored, limits)
    any_drift = conformal.detect_drift(flagged, ["chunk_id"], "l_orderkey", "any").withColumnRenamed("drift", "any_drift")
    rate = conformal.detect_drift(flagged, ["chunk_id"], "l_orderkey", "rate", 0.9)
    epsilon = conformal.detect_drift(conformal.drift_flags(scored, limits, "epsilon"), ["chunk_id"], "l_orderkey", "any")
    return any_drift.join(rate.select("chunk_id", F.col("drift").alias("rate_drift")), "chunk_id").join(
        epsilon.select("chunk_id", F.col("drift").alias("epsilon_drift")), "chunk_id"
    )


@query(
    "i10_detect_drift_first",
    f"""WITH {RAW_FLOWS_SQL}, t AS (SELECT label AS class, quantile_cont(totlen_fwd_pkts / 20000, 0.95) AS threshold FROM raw_flows GROUP BY label)
SELECT event_id // 50 AS chunk_id, count(*) AS rows, arg_min(totlen_bwd_pkts / 2560 < threshold, event_id) AS drift
FROM raw_flows r JOIN t ON r.label = t.class GROUP BY 1""",
)
def detect_drift_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_flows(spark, sf_dir).select(
        "event_id",
        F.floor(F.col("event_id") / 50).alias("chunk_id"),
        F.col("label").alias("class"),
        (F.col("totlen_fwd_pkts") / 20000).alias("score"),
        (F.col("totlen_bwd_pkts") / 2560).alias("p_value"),
    )
    flagged = conformal.drift_flags(rows, conformal.class_thresholds(rows, 0.05))
    return conformal.detect_drift(flagged, ["chunk_id"], "event_id")


# Controllers ------------------------------------------------------------------

_EMA_SQL = f"""WITH RECURSIVE {_DRIFTS_SQL},
rates AS (SELECT chunk_id + 1 AS chunk_no, drift, sum(cast(drift AS int)) OVER (ORDER BY chunk_id) / (chunk_id + 1) AS rate FROM chunk_drift),
ema AS (SELECT chunk_no, drift, rate, 0.1::double * rate AS e FROM rates WHERE chunk_no = 1
 UNION ALL SELECT r.chunk_no, r.drift, r.rate, 0.9::double * ema.e + (1 - 0.9::double) * r.rate FROM rates r JOIN ema ON r.chunk_no = ema.chunk_no + 1)"""


def numbered_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_drift(spark, sf_dir).select((F.col("chunk_id") + 1).alias("chunk_no"), "drift")


@query(
    "j3_drift_ema",
    f"{_EMA_SQL} SELECT chunk_no, drift, round(rate, 6) AS drift_rate, round(e, 6) AS drift_ema FROM ema",
)
def drift_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(control.drift_ema(numbered_drift(spark, sf_dir), block=64))


@query(
    "j2_adaptive_chunks",
    f"""{_EMA_SQL}, moved AS (SELECT chunk_no, CASE WHEN e > 0.2 THEN -1 WHEN e < 0.05 THEN 1 ELSE 0 END AS move FROM ema),
sizes AS (SELECT 0::bigint AS chunk_no, 10::bigint AS size
 UNION ALL SELECT m.chunk_no, CASE m.move WHEN -1 THEN greatest(1, s.size // 2) WHEN 1 THEN least(1000, s.size + 5) ELSE s.size END
 FROM moved m JOIN sizes s ON m.chunk_no = s.chunk_no + 1)
SELECT chunk_no, size AS chunk_size FROM sizes WHERE chunk_no > 0""",
)
def adaptive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = control.adaptive_chunks(numbered_drift(spark, sf_dir), ChunkConfig(), block=64)
    return rounded(sizes.select("chunk_no", "chunk_size"))


# The controller row by row: the window of every class after each row of its stream, then one step of each class at a time.
LEVELS_SQL = f"""WITH RECURSIVE {RAW_FLOWS_SQL}, rows AS MATERIALIZED (
 SELECT event_id, dst_ip, label AS class, totlen_fwd_pkts / 30000 AS p, row_number() OVER (PARTITION BY dst_ip ORDER BY event_id) AS step_no FROM raw_flows),
seen AS MATERIALIZED (SELECT dst_ip, class, list(p ORDER BY step_no) AS ps FROM rows GROUP BY ALL),
windows AS MATERIALIZED (SELECT dst_ip, step_no, class, n, list_slice(ps, greatest(1, n - 99), n) AS win FROM (
 SELECT r.dst_ip, r.step_no, s.class, s.ps, sum((r.class = s.class)::int) OVER (PARTITION BY r.dst_ip, s.class ORDER BY r.step_no)::bigint AS n
 FROM rows r JOIN seen s ON s.dst_ip = r.dst_ip)),
levels AS (
 SELECT dst_ip, class, 0::bigint AS step_no, 0.05::double AS alpha FROM seen
 UNION ALL
 SELECT dst_ip, class, step_no, CASE WHEN rate > 0.3 THEN round(least(alpha + 0.02::double, 0.3::double), 10)
  WHEN rate < 0.05 THEN round(greatest(alpha - 0.02::double, 0.05::double), 10) ELSE alpha END
 FROM (SELECT l.dst_ip, l.class, w.step_no, l.alpha, CASE WHEN w.n > 0 THEN len(list_filter(w.win, lambda x: x < l.alpha))::double / len(w.win) ELSE 0.1 END AS rate
  FROM levels l JOIN windows w ON w.dst_ip = l.dst_ip AND w.class = l.class AND w.step_no = l.step_no + 1))"""


@query(
    "j1_adaptive_significance",
    f"{LEVELS_SQL} SELECT r.event_id, r.dst_ip, r.class, r.p AS p_value, r.step_no, l.alpha FROM rows r JOIN levels l USING (dst_ip, class, step_no)",
)
def adaptive_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream per destination, classes are the labels; the p-value is the record's share of a price range."""
    rows = raw_flows(spark, sf_dir).select(
        "event_id", "dst_ip", F.col("label").alias("class"), (F.col("totlen_fwd_pkts") / 30000).alias("p_value")
    )
    return control.adaptive_significance(rows, order=["event_id"], by=["dst_ip"], block=500)
