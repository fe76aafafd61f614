"""Queries: sources, sinks, evaluators and streams. Streams run to the end of their input and are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.config import ChunkConfig, ConformalConfig, DriftConfig
from flowdrift.operators import ml, sampling
from flowdrift.operators.evaluators import make_evaluator
from flowdrift.operators.features import WINDOW_FEATURES
from flowdrift.plans.queries_drift import LEVELS_SQL
from flowdrift.plans.queries_models import MODEL_COLUMNS, labelled
from flowdrift.plans.queries_features import RATES, _hops_sql
from flowdrift.plans.registry import query
from flowdrift.plans.tables import FLOWS_SQL, RAW_FLOWS_SQL, flows, raw_flows, rounded, table
from flowdrift.session import ensure_checkpoint_dir, materialize
from flowdrift.sources import readers, sinks
from flowdrift.sources.rolling_log import RollingLog
from flowdrift.streaming.drift import DriftStream, ProgressLog
from flowdrift.streaming.hopping import stream_hopping_features
from flowdrift.streaming.chunks import chunk_stream, chunk_table, rechunk_stream
from flowdrift.streaming.state import last_n_stream, significance_stream


def scratch(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/work-{uuid.uuid4().hex}"


# Rows of one arriving file; a longer stretch arrives as several files, which one micro-batch takes together.
ARRIVING_ROWS = 250_000


def arriving(df: DataFrame, order: str, steps: int) -> tuple[str, T.StructType, int]:
    """Write rows step by step in arrival order, for a file stream that takes the oldest files first.

    Returns folder, schema and the number of files of every step, which is that of a micro-batch. It follows from
    the shortest step: dealing rows round robin fills all files, so each step has as many.
    """
    path, at = scratch(df.sparkSession), F.col(order).cast("double")
    low, high = df.agg(F.min(at), F.max(at)).first()
    part = F.least(F.floor((at - low) / ((high - low) / steps)), F.lit(steps - 1))
    sizes = {r["part"]: r["count"] for r in df.groupBy(part.alias("part")).count().collect()}  # one row for each step
    files = max(1, min(sizes.get(i, 0) for i in range(steps)) // ARRIVING_ROWS)
    for i in range(steps):
        rows = df.filter(part == i)
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(path)
    return path, df.schema, files


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all its input into files and read them back."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").option(
        "path", f"{path}/out"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


# Sources and sinks ------------------------------------------------------------

_PLAIN = ["event_id", "src_ip", "dst_port", "tot_fwd_pkts", "totlen_fwd_pkts", "label"]
_PLAIN_SQL = "event_id, src_ip, cast(dst_port AS bigint) AS dst_port, cast(tot_fwd_pkts AS bigint) AS tot_fwd_pkts, totlen_fwd_pkts, label"
_PLAIN_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("tot_fwd_pkts", T.IntegerType()),
        T.StructField("totlen_fwd_pkts", T.DoubleType()),
        T.StructField("label", T.StringType()),
    ]
)


def _csv_text(df: DataFrame, special: bool = False) -> DataFrame:
    """Flow rows as CSV fields; some byte counts are written as inf or nan."""
    size = F.col("totlen_fwd_pkts").cast("string")
    if special:
        size = F.when(F.col("event_id") % 41 == 0, "inf").when(F.col("event_id") % 43 == 0, "NaN").otherwise(size)
    return df.select(*[size.alias(c) if c == "totlen_fwd_pkts" else F.col(c).cast("string").alias(c) for c in _PLAIN])


@query(
    "a1_read_flows",
    f"""WITH {RAW_FLOWS_SQL} SELECT event_id, src_ip, cast(dst_port AS bigint) AS dst_port, cast(tot_fwd_pkts AS bigint) AS tot_fwd_pkts,
 CASE WHEN event_id % 41 = 0 OR event_id % 43 = 0 THEN NULL ELSE totlen_fwd_pkts::double END AS totlen_fwd_pkts, label FROM raw_flows""",
)
def read_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    shuffled = _csv_text(raw_flows(spark, sf_dir), special=True).select(F.lit("7").alias("Unnamed: 0"), *_PLAIN[::-1])
    shuffled.write.option("header", "true").csv(path)
    return rounded(readers.read_flows(spark, path, schema=_PLAIN_SCHEMA))


@query("a2_stream_flows", f"WITH {RAW_FLOWS_SQL} SELECT {_PLAIN_SQL.replace('totlen_fwd_pkts', 'totlen_fwd_pkts::double AS totlen_fwd_pkts')} FROM raw_flows")
def stream_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    _csv_text(raw_flows(spark, sf_dir)).select(*_PLAIN[::-1], F.lit("7").alias("device_id")).repartition(4).write.option("header", "true").csv(path)
    return rounded(drained(readers.stream_flows(spark, path, _PLAIN_SCHEMA, files_per_trigger=2)))


@query("a3_csv_payloads", f"WITH {RAW_FLOWS_SQL} SELECT {_PLAIN_SQL.replace('totlen_fwd_pkts', 'totlen_fwd_pkts::double AS totlen_fwd_pkts')} FROM raw_flows")
def csv_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50 flows form one pushed CSV text."""
    lines = raw_flows(spark, sf_dir).select(F.floor(F.col("event_id") / 50).alias("push"), F.concat_ws(",", *_PLAIN).alias("line"))
    pushed = lines.groupBy("push").agg(F.concat_ws("\n", F.lit(",".join(_PLAIN)), F.collect_list("line")).alias("value"))
    path, schema, files = arriving(pushed.select("push", "value"), "push", 3)
    stream = readers.stream_flows(spark, path, schema, "parquet", files)
    return rounded(drained(readers.decode_csv_payloads(stream, _PLAIN_SCHEMA)).drop("push"))


@query(
    "a4_merge_flow_dir",
    f"""WITH {RAW_FLOWS_SQL} SELECT event_id, src_ip, CASE WHEN event_id % 2 = 0 THEN label END AS label,
 epoch_us(date_trunc('second', timestamp)) AS timestamp FROM raw_flows""",
)
def merge_flow_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two file layouts; files without a timestamp are left out."""
    path = scratch(spark)
    rows = raw_flows(spark, sf_dir).select("event_id", "src_ip", "label", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    writer = {"header": "true"}
    rows.filter("event_id % 2 = 0").write.options(**writer).csv(path)
    rows.filter("event_id % 2 = 1").drop("label").write.mode("append").options(**writer).csv(path)
    rows.drop("timestamp").write.mode("append").options(**writer).csv(path)
    return rounded(readers.merge_flow_dir(spark, path, schema=T.StructType([T.StructField("event_id", T.LongType())])))


@query("a5_write_features", f"WITH {RAW_FLOWS_SQL} SELECT {_PLAIN_SQL} FROM raw_flows")
def write_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_features(raw_flows(spark, sf_dir).select(*_PLAIN), path, partition_by=["label"])
    return rounded(spark.read.parquet(path))


@query(
    "a6_append_rolling_log",
    f"""WITH {RAW_FLOWS_SQL}, quarters AS (SELECT event_id AS seq, label, event_id // (SELECT (max(event_id) + 4) // 4 FROM raw_flows) AS quarter FROM raw_flows),
arrived AS (SELECT 3 - quarter AS batch, seq, label FROM quarters UNION ALL SELECT 4, seq, label FROM quarters WHERE quarter = 1 AND seq % 2 = 0)
SELECT seq, label FROM arrived ORDER BY batch DESC, seq DESC LIMIT (SELECT cast(0.4 * count(*) AS bigint) FROM raw_flows)""",
)
def append_rolling_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose sequence falls, one of them written twice; compacted, appended to with repeated numbers, pruned."""
    rows = raw_flows(spark, sf_dir).select(F.col("event_id").alias("seq"), "label")
    most, n = rows.agg(F.max("seq"), F.count(F.lit(1))).first()
    log = RollingLog(scratch(spark), max_rows=int(0.4 * n), columns=["seq", "label"])
    quarter = F.floor(F.col("seq") / ((most + 4) // 4))
    for batch in (0, 1, 1, 2, 3):
        log.append(rows.filter(quarter == 3 - batch), batch)
    small = log.compact(spark, scratch(spark))
    small.append(rows.filter((quarter == 1) & (F.col("seq") % 2 == 0)), 4)
    small.prune(spark)
    return small.read(spark)


@query("a8_save_load_pipeline")
def save_load_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, base = labelled(spark, sf_dir), scratch(spark)
    fitted = ml.train(rows, MODEL_COLUMNS, variant="dt", use_pca=True, maxDepth=4)
    sinks.save_pipeline(fitted, base, "flows", "binary", "dt")
    loaded = sinks.load_pipeline(base, "flows", "binary", "dt")
    before = ml.score(rows, fitted).select("event_id", F.col("prediction").alias("before"))
    return ml.score(rows, loaded).select("event_id", "prediction").join(before, "event_id").filter("prediction = before")


@query(
    "a9_read_run_logs",
    f"""WITH {RAW_FLOWS_SQL} SELECT concat('kind=', label) AS folder, row_number() OVER (PARTITION BY label ORDER BY event_id) AS line_no,
 'event ' || event_id AS text FROM raw_flows WHERE label <> 'UDPAttack'""",
)
def read_run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder per label; the folder of one label is marked as old and skipped."""
    path = scratch(spark)
    rows = raw_flows(spark, sf_dir).select("event_id", F.col("label").alias("kind"), F.concat(F.lit("event "), "event_id").alias("text"))
    rows.repartition(1).sortWithinPartitions("kind", "event_id").drop("event_id").write.partitionBy("kind").text(path)
    return readers.read_run_logs(spark, path, exclude_prefix="kind=UDP", pattern="*.txt").select("folder", "line_no", "text")


@query(
    "a10_write_metrics_long",
    """SELECT 'rf' AS classifier, 'ce' AS series, concat('run_', o_custkey) AS run, 'ice' AS ce_type, 'accuracies' AS metric,
 cast(o_orderkey AS varchar) AS step, cast(o_totalprice AS varchar) AS value FROM orders""",
)
def write_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    rows = table(spark, sf_dir, "orders").select(
        F.lit("rf").alias("classifier"), F.lit("ce").alias("series"), F.concat(F.lit("run_"), "o_custkey").alias("run"),
        F.lit("ice").alias("ce_type"), F.lit("accuracies").alias("metric"), F.col("o_orderkey").alias("step"),
        F.col("o_totalprice").alias("value"),
    )
    sinks.write_metrics_long(rows, path)
    return spark.read.option("header", "true").csv(path)


# Evaluators --------------------------------------------------------------------


def _evaluated(spark: SparkSession, sf_dir: str, kind: str, folds: int = 3) -> DataFrame:
    rows = labelled(spark, sf_dir)
    stages, vector = ml.fit_features(rows, MODEL_COLUMNS)
    prepared = ml.PipelineModel(stages=stages).transform(rows).select("event_id", vector, "label")
    marked = materialize(sampling.split(prepared, "event_id", label="label"))
    config = ConformalConfig(evaluator=kind, folds=folds)
    calibrated = make_evaluator(kind)(
        marked.filter("is_train").drop("is_train"), ml.make_estimator("dt", maxDepth=5), config, "event_id"
    )
    scored = calibrated.flags(calibrated.predict(marked.filter("NOT is_train").drop("is_train")))
    return scored.select("event_id", "class", "score", "p_value", "drift")


@query("i5_calibrate_ice")
def calibrate_ice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "ice")


@query("i6_calibrate_cce")
def calibrate_cce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "cce")


@query("i8_calibrate_approx_cce")
def calibrate_approx_cce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "approx_cce")


@query("i9_calibrate_approx_tce")
def calibrate_approx_tce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "approx_tce")


# Streams -----------------------------------------------------------------------


@query("j1_significance_stream", f"{LEVELS_SQL} SELECT r.dst_ip AS stream, r.event_id AS seq, r.class, r.p AS p_value, l.alpha FROM rows r JOIN levels l USING (dst_ip, class, step_no)")
def j1_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_flows(spark, sf_dir).select(
        F.col("event_id").alias("seq"), "dst_ip", F.col("label").alias("class"), (F.col("totlen_fwd_pkts") / 30000).alias("p_value")
    )
    path, schema, files = arriving(rows, "seq", 4)
    return drained(significance_stream(readers.stream_flows(spark, path, schema, "parquet", files), "dst_ip"))


def _loop_sql(rows: str, hit: str, tail: bool) -> str:
    """Chunks of each stream by the fold, chunk after chunk: ``rows`` has stream, n (from 0), seq, flag; ``hit`` is the verdict."""
    size = "CASE WHEN ema > 0.2 THEN greatest(1, size // 2) WHEN ema < 0.05 THEN least(1000, size + 5) ELSE size END"
    inside = "least(l.place + l.size, c.total)" if tail else "l.place + l.size"
    more = "l.place < c.total" if tail else "l.place + l.size <= c.total"
    return f"""{rows},
counted AS MATERIALIZED (SELECT *, sum(flag::int) OVER (PARTITION BY stream ORDER BY n) AS upto FROM numbered),
totals AS (SELECT stream, count(*) AS total FROM numbered GROUP BY stream),
loop AS (
 SELECT stream, 0::bigint AS chunk_no, 0::bigint AS begin_at, 0::bigint AS place, 10::bigint AS size, 0::bigint AS taken, 0::double AS ema, 0::bigint AS drifts, false AS drift
 FROM totals
 UNION ALL
 SELECT stream, chunk_no, begin_at, place, {size}, size, ema, drifts, drift FROM (
  SELECT l.stream, l.chunk_no + 1 AS chunk_no, l.place AS begin_at, {inside} AS place, l.size,
   0.9::double * l.ema + (1::double - 0.9::double) * ((l.drifts + ({hit})::int)::double / (l.chunk_no + 1)) AS ema,
   l.drifts + ({hit})::int AS drifts, {hit} AS drift
  FROM loop l JOIN totals c ON c.stream = l.stream AND {more}
  JOIN counted f ON f.stream = l.stream AND f.n = l.place JOIN counted z ON z.stream = l.stream AND z.n = {inside} - 1))
SELECT l.stream, n.seq, l.chunk_no, l.place - l.begin_at AS chunk_rows, l.drift, l.size AS next_size, l.place - l.begin_at = l.taken AS whole
FROM loop l JOIN numbered n ON n.stream = l.stream AND n.n >= l.begin_at AND n.n < l.place WHERE l.chunk_no > 0"""


_J4_ROWS = f"""WITH RECURSIVE {RAW_FLOWS_SQL}, numbered AS MATERIALIZED (
 SELECT dst_ip AS stream, event_id AS seq, label = 'TCPAttack' AS flag, row_number() OVER (PARTITION BY dst_ip ORDER BY event_id) - 1 AS n FROM raw_flows)"""


@query("j4_rechunk_stream", _loop_sql(_J4_ROWS, "f.flag", False))
def j4_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_flows(spark, sf_dir).select(F.col("event_id").alias("seq"), "dst_ip", (F.col("label") == "TCPAttack").alias("drift"))
    path, schema, files = arriving(rows, "seq", 4)
    return drained(rechunk_stream(readers.stream_flows(spark, path, schema, "parquet", files), "dst_ip", config=ChunkConfig())).drop("alpha")


@query("j4_rechunk_tail", _loop_sql(_J4_ROWS, "f.flag", True))
def j4_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unfinished chunks too: a row of another stream, far ahead in time, lets the watermark pass all others."""
    rows = raw_flows(spark, sf_dir).select(
        F.col("event_id").alias("seq"), "dst_ip", (F.col("label") == "TCPAttack").alias("drift"), F.timestamp_seconds(F.col("event_id") + 86400).alias("at")
    )
    path, schema, files = arriving(rows, "seq", 4)
    clock = rows.agg((F.max("seq") + 10_000).alias("seq")).select(
        "seq", F.lit("clock").alias("dst_ip"), F.lit(False).alias("drift"), F.timestamp_seconds(F.col("seq") + 86400).alias("at")
    )
    clock.coalesce(1).write.mode("append").parquet(path)
    stream = readers.stream_flows(spark, path, schema, "parquet", files).withWatermark("at", "10 minutes")
    found = drained(rechunk_stream(stream, "dst_ip", config=ChunkConfig(), tail_after="20 minutes", ts="at"))
    return found.filter("stream <> 'clock'").drop("alpha")


_J5_ROWS = f"""WITH RECURSIVE {RAW_FLOWS_SQL}, numbered AS MATERIALIZED (
 SELECT dst_ip AS stream, event_id AS seq, totlen_fwd_pkts < 1500 AS flag, row_number() OVER (PARTITION BY dst_ip ORDER BY event_id) - 1 AS n FROM raw_flows)"""


@query("j5_adaptive_chunks", _loop_sql(_J5_ROWS, "z.upto - f.upto + f.flag::int > 0.1 * (z.n - f.n + 1)", False))
def j5_adaptive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop of the drift stream for a fixed test: a chunk drifts where over a tenth of its rows do, and that sets the next size."""
    rows = raw_flows(spark, sf_dir).select(F.col("event_id").alias("seq"), "dst_ip", (F.col("totlen_fwd_pkts") < 1500).alias("row_drift"))
    path, schema, files = arriving(rows, "seq", 4)
    return drained(chunk_stream(readers.stream_flows(spark, path, schema, "parquet", files), "dst_ip", mode="rate", rate=0.1)).drop("alpha")


@query(
    "a7_last_n_stream",
    f"""WITH {RAW_FLOWS_SQL}, newest AS (SELECT src_ip AS stream, event_id, totlen_fwd_pkts FROM raw_flows
 QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY event_id DESC) <= 20)
SELECT stream, max(event_id) AS last_seq, list(totlen_fwd_pkts ORDER BY event_id) AS values FROM newest GROUP BY stream""",
)
def a7_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buffer of every stream after the last of four micro-batches."""
    rows = raw_flows(spark, sf_dir).select(F.col("event_id").alias("seq"), "src_ip", F.col("totlen_fwd_pkts").alias("value"))
    path, schema, files = arriving(rows, "seq", 4)
    stream = last_n_stream(readers.stream_flows(spark, path, schema, "parquet", files), "src_ip", 20)
    out = scratch(spark)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", scratch(spark)).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).groupBy("stream").agg(
        F.max("last_seq").alias("last_seq"), F.max_by("values", "last_seq").alias("values")
    )


_STREAM_HOPS_SQL = _hops_sql(3_600_000_000, 900_000_000).replace(
    "epoch_us(timestamp) - (SELECT min(epoch_us(timestamp)) FROM flows) AS off", "epoch_us(timestamp) AS off"
).replace("greatest(0, cast(floor((off - 3600000000) / 900000000) AS bigint) + 1)", "cast(floor((off - 3600000000) / 900000000) AS bigint) + 1").replace(
    "(SELECT min(epoch_us(timestamp)) FROM flows) + hop", "hop"
)


@query(
    "j10_stream_hopping_features",
    f"""WITH {FLOWS_SQL}, {_STREAM_HOPS_SQL}
SELECT * EXCLUDE (hop) FROM hops WHERE end_time <= (SELECT max(epoch_us(timestamp)) - 600000000 FROM flows)""",
)
def j10_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window the watermark (ten minutes behind the newest flow) has passed."""
    path, schema, files = arriving(flows(spark, sf_dir), "timestamp", 3)
    stream = stream_hopping_features(readers.stream_flows(spark, path, schema, "parquet", files), "1h", "15min", watermark="10 minutes")
    return rounded(drained(stream).select("start_time", "end_time", *WINDOW_FEATURES), skip=RATES)


# Without the port the label cannot be learnt, so drift is found and models are refitted.
DRIFT_COLUMNS = [c for c in MODEL_COLUMNS if c != "dst_port"]


def _drift_stream(spark: SparkSession, sf_dir: str, seeded: bool) -> DriftStream:
    rows = labelled(spark, sf_dir).select("event_id", *DRIFT_COLUMNS, F.col("label").cast("int").alias("BinLabel"))
    config = DriftConfig(variant="dt", conformal=ConformalConfig(evaluator="approx_tce", mode="any"), max_rows=2000)
    run = DriftStream(spark, scratch(spark), DRIFT_COLUMNS, config, order="event_id", truth="BinLabel", classifier_params={"maxDepth": 4})
    if seeded:
        run.seed(rows)
    path, schema, files = arriving(rows, "event_id", 3)
    run.start(readers.stream_flows(spark, path, schema, "parquet", files), scratch(spark), available_now=True).awaitTermination()
    return run


def _arrivals_sql(files: int) -> str:
    """Rows with the micro-batch that ``arriving`` puts them into."""
    return f"""{RAW_FLOWS_SQL}, arrived AS (SELECT event_id, least(floor((event_id - low) / ((high - low)::double / {files})), {files - 1})::bigint AS batch_id
 FROM raw_flows, (SELECT min(event_id) AS low, max(event_id) AS high FROM raw_flows))"""


@query(
    "j5_drift_stream",
    f"""WITH {_arrivals_sql(3)} SELECT batch_id AS chunk_id, count(*) AS rows, true AS refitted_on_drift, true AS earlier_model, true AS judged
 FROM arrived GROUP BY batch_id""",
)
def j5_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded from all flows, then replayed over them in three micro-batches; retrains where drift is found, for the next batch on."""
    chunks = _drift_stream(spark, sf_dir, True).chunks()
    return chunks.select(
        "chunk_id", "rows", (F.col("retrained") == F.col("drift")).alias("refitted_on_drift"),
        (F.col("version") < F.col("chunk_id")).alias("earlier_model"), F.col("p_first").between(0, 1).alias("judged"),
    )


@query(
    "j9_bootstrap_calibration",
    f"WITH {_arrivals_sql(3)} SELECT batch_id, event_id, true AS known, true AS judged FROM arrived WHERE batch_id > 0",
)
def j9_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No model at the start: the first micro-batch calibrates and emits nothing, all rows of the others come out judged."""
    scored = _drift_stream(spark, sf_dir, False).scored()
    judged = F.col("p_value").between(0, 1) & F.col("row_drift").isNotNull() & (F.col("class") == F.col("prediction"))
    return scored.select(F.col("batch_id").cast("bigint"), "event_id", F.col("prediction").isin(0, 1).alias("known"), judged.alias("judged"))


@query(
    "j7_pseudo_label_log",
    f"""WITH {_arrivals_sql(3)}, logged AS (SELECT batch_id, event_id, 'prediction' AS label_source FROM arrived
 UNION ALL SELECT -1, event_id, 'truth' FROM arrived)
SELECT event_id AS seq, label_source, true AS known FROM logged ORDER BY batch_id DESC, event_id DESC LIMIT 2000""",
)
def j7_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after a run: its newest rows, labelled with predictions, before them the rows of the seed."""
    run = _drift_stream(spark, sf_dir, True)
    return run.log.read(spark).select("seq", "label_source", F.col("BinLabel").isin(0, 1).alias("known"))


@query("j8_retrain_from_log", "SELECT true AS one_for_each_refit, true AS accuracies, true AS seeded")
def j8_retrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every refit leaves the quality of its version, the seed first."""
    run = _drift_stream(spark, sf_dir, True)
    refits = run.chunks().agg(F.count_if("retrained").alias("refits"), F.min("version").alias("first"))
    quality = run.calibrations().agg(F.count(F.lit(1)).alias("versions"), F.bool_and(F.col("accuracy").between(0, 1)).alias("accuracies"))
    one = quality.withColumn("refits", refits.select("refits").scalar()).withColumn("first", refits.select("first").scalar())
    return one.select((F.col("versions") == F.col("refits") + 1).alias("one_for_each_refit"), "accuracies", (F.col("first") == -1).alias("seeded"))


@query("h10_latency_summary", "SELECT 3::bigint AS chunks, true AS measured")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _drift_stream(spark, sf_dir, True)
    shortest = run.chunks().agg(F.min("latency_s")).scalar()
    return run.latency().select(F.col("chunks").cast("bigint"), (shortest > 0).alias("measured"))


@query("h10_progress_log", f"WITH {_arrivals_sql(12)} SELECT batch_id, count(*) AS rows, true AS timed FROM arrived GROUP BY batch_id")
def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and seconds of every micro-batch of a stream, kept by a listener."""
    path, schema, files = arriving(raw_flows(spark, sf_dir).select("event_id"), "event_id", 12)
    log = ProgressLog(spark, scratch(spark), every=5)
    spark.streams.addListener(log)
    try:
        stream = readers.stream_flows(spark, path, schema, "parquet", files).writeStream.format("noop").option("checkpointLocation", scratch(spark))
        running = stream.trigger(availableNow=True).start()
        running.awaitTermination()
        log.wait_for(running)
    finally:
        spark.streams.removeListener(log)
    return log.table().filter((F.col("rows") > 0) & (F.col("query") == str(running.id))).select("batch_id", "rows", (F.col("latency_s") > 0).alias("timed"))


@query("drift_replay")
def drift_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flows replayed in chunks of 100 against a model trained on them, with an adaptive significance level."""
    from flowdrift.config import SignificanceConfig
    from flowdrift.plans.drift import replay

    rows = labelled(spark, sf_dir).select("event_id", *DRIFT_COLUMNS, F.col("label").cast("int").alias("BinLabel"))
    config = DriftConfig(
        variant="dt", conformal=ConformalConfig(evaluator="ice"), chunk_size=100, significance=SignificanceConfig(window=20)
    )
    return replay(rows, rows, DRIFT_COLUMNS, config, "event_id", maxDepth=4)[1]
