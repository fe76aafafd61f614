"""The drift stream: score, test, log, retrain, one micro-batch at a time."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.utils import AnalysisException

from flowdrift.config import DriftConfig, SignificanceConfig
from flowdrift.operators.clean import clean_flows, fill_mean
from flowdrift.operators.control import Levels
from flowdrift.operators.evaluators import Calibrated, make_evaluator, observe_calibration
from flowdrift.operators.label import quarantine_bad_labels
from flowdrift.operators.metrics import latency_summary, model_metrics
from flowdrift.operators.ml import align_to_model, fit_features, make_estimator
from flowdrift.session import materialize
from flowdrift.sources.rolling_log import RollingLog
from flowdrift.streaming.chunks import CHUNKED, ChunkLoop, chunk_table

_STATE = "version bigint, controller string, learned bigint, loop string"
STATES_KEPT = 10  # only the last batch is ever repeated


@dataclass
class ModelVersion:
    """Feature stages, classifier and calibrated evaluator that take effect together."""

    version: int
    features: PipelineModel
    classifier: PipelineModel
    evaluator: Calibrated | None


def _evaluator_estimator(config: DriftConfig, width: int, classes: int, classifier_params: dict) -> Estimator:
    """The unfitted model that the evaluator is calibrated with."""
    if config.evaluator_model == "classifier":
        return make_estimator(config.variant, config.task, width, classes, **classifier_params)
    own = {"kernel": "linear"} if config.evaluator_model == "svm" else {"hidden": [256, 128, 64]}
    return make_estimator(config.evaluator_model, config.task, width, classes, **{**own, **config.evaluator_params})


def fit_version(
    rows: DataFrame, columns: list[str], config: DriftConfig, version: int, label: str = "BinLabel", seq: str = "seq",
    **overrides,
) -> ModelVersion | None:
    """Fit scaler, projection and classifier and calibrate the evaluator; None if only one class is present.

    The class check comes first, so a useless refit is never started.
    """
    good, _ = quarantine_bad_labels(rows, label, name="label")
    good = materialize(good.select(seq, "label", *columns))
    classes = good.select("label").distinct().count()
    if classes < 2:
        return None
    stages, vector = fit_features(good, columns, config.use_pca)
    features = PipelineModel(stages=stages)
    prepared = materialize(features.transform(good).select(seq, F.col("label").cast("double").alias("label"), F.col(vector).alias("features")))
    width = len(columns) if not config.use_pca else len(stages[-1].getIndices())
    estimator = make_estimator(config.variant, config.task, width, classes, **overrides)
    calibrate = make_evaluator(config.conformal.evaluator)
    judge = _evaluator_estimator(config, width, classes, overrides)
    evaluator = calibrate(prepared, judge, config.conformal, seq) if calibrate else None
    # the approximate evaluators fit the same estimator on the same rows
    shared = evaluator is not None and evaluator.evaluator in ("approx_cce", "approx_tce") and config.evaluator_model == "classifier"
    classifier = evaluator.models[0] if shared else estimator.fit(prepared)
    if not isinstance(classifier, PipelineModel):
        classifier = PipelineModel(stages=[classifier])
    return ModelVersion(version, features, classifier, evaluator)


@dataclass
class DriftStream:
    """State of one drift stream, kept under ``base``: log, model versions, scored rows, chunk results.

    Everything a micro-batch writes is stored under its batch id, and it reads
    only what earlier batches left: one row of state (model version, controller,
    chunk loop), found by the name of its folder. A batch that is repeated after a
    failure therefore overwrites its own output and leaves the rest alone.

    With ``config.adaptive_chunks`` the rows of a batch are cut into chunks by the
    verdicts on the chunks before (``ChunkLoop``); rows that fill no chunk wait for
    the next batch, or for ``finish``. A model is refitted after a batch with a drift
    chunk and serves the next batch on; ``retrain=False`` keeps the first model.
    """

    spark: SparkSession
    base: str
    columns: list[str]
    config: DriftConfig = field(default_factory=DriftConfig)
    netflow: bool = False
    seq: str = "seq"
    order: str | None = None
    truth: str | None = None
    learn_from_truth: bool = False
    classifier_params: dict = field(default_factory=dict)
    on_batch: Callable[[DataFrame, int], None] | None = None
    retrain: bool = True

    def __post_init__(self) -> None:
        self.base = self.base.rstrip("/")
        self.log = RollingLog(f"{self.base}/log", self.config.max_rows)
        self._held: ModelVersion | None = None

    # versions ---------------------------------------------------------------

    def _batches(self, name: str) -> list[int]:
        """Ids of the folders of one kind, by their names."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = (f.getPath().getName() for f in files.listStatus(folder))
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch_id="))

    def _state_before(self, batch_id: int) -> tuple[int | None, dict]:
        """The newest earlier batch that left a state (the seed counts as batch -1), and that state."""
        earlier = [b for b in self._batches("state") if b < batch_id]
        if not earlier:
            return None, {"version": None, "controller": None, "learned": None, "loop": None}
        return earlier[-1], self.spark.read.schema(_STATE).parquet(f"{self.base}/state/batch_id={earlier[-1]}").first().asDict()

    def _keep_state(self, batch_id: int, **state) -> None:
        row = tuple(state.get(c.split()[0]) for c in _STATE.split(", "))
        self.spark.createDataFrame([row], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/state/batch_id={batch_id}")
        for old in self._batches("state")[:-STATES_KEPT]:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/state/batch_id={old}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _path(self, version: int) -> str:
        return f"{self.base}/models/version={version + 1}"

    def _save(self, model: ModelVersion) -> None:
        path = self._path(model.version)
        model.features.write().overwrite().save(f"{path}/features")
        model.classifier.write().overwrite().save(f"{path}/classifier")
        if model.evaluator is not None:
            model.evaluator.save(f"{path}/evaluator")
        row = self.spark.createDataFrame([(model.version, model.version)], "version bigint, batch bigint")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/versions/v={model.version + 1}")
        self._held = model

    def model_for(self, version: int | None) -> ModelVersion | None:
        if version is None:
            return None
        if self._held is None or self._held.version != version:
            path = self._path(version)
            evaluator = Calibrated.load(self.spark, f"{path}/evaluator") if self.config.conformal.evaluator != "none" else None
            self._held = ModelVersion(
                version, PipelineModel.load(f"{path}/features"), PipelineModel.load(f"{path}/classifier"), evaluator
            )
        return self._held

    def seed(self, training: DataFrame, label: str = "BinLabel") -> None:
        """Fill the log with the newest labelled training rows and fit the first version on all of them."""
        from flowdrift.sources.rolling_log import seed_rows

        rows = seed_rows(training, self.config.max_rows, self.order or self.seq, [*self.columns, label], label, label)
        logged = rows.select("seq", *self.columns, F.col(label).alias("BinLabel"), F.lit("truth").alias("label_source"),
                             F.lit(False).alias("drift"))
        self.log.append(materialize(logged), -1)
        model = fit_version(training.withColumn("seq", F.col(self.order or self.seq)), self.columns, self.config, -1, label,
                            **self.classifier_params)
        if model is None:
            raise ValueError("training data holds one class only")
        self._save(model)
        self._keep_state(-1, version=-1)

    # one micro-batch -----------------------------------------------------------

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Clean, score and test one batch with the newest earlier version, log it, retrain on drift."""
        started = time.time()
        cleaned = clean_flows(batch, self.netflow)
        if self.order and self.order != "seq":
            cleaned = cleaned.withColumn("seq", F.col(self.order))
        # read several times below; a lost part is recomputed from the batch
        cleaned = cleaned.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._process(cleaned, batch_id, started)
        finally:
            cleaned.unpersist()

    def _process(self, cleaned: DataFrame, batch_id: int, started: float) -> None:
        rows = cleaned.count()
        if not rows:
            return
        before, state = self._state_before(batch_id)
        model = self.model_for(state["version"])
        if model is None:
            self._bootstrap(cleaned, batch_id)
            return
        present = [c for c in self.columns if c in cleaned.columns]
        # the batch is the chunk: nulls take its own column means
        filled = fill_mean(cleaned, present) if present else cleaned
        prepared = model.features.transform(align_to_model(filled, model.features))
        scored = self._score(prepared, model)
        outputs = ("prediction", "class", "score", "p_value", "row_drift")
        kept = [c for c in scored.columns if c in cleaned.columns or c in outputs]
        # scored once, written once; everything after reads the written rows
        path = f"{self.base}/scored/batch_id={batch_id}"
        scored.select(*kept).write.mode("overwrite").parquet(path)
        result = self.spark.read.parquet(path)
        decision = self._test(result, model, batch_id, before, state)
        self.log.append(self._pseudo_labelled(result, decision["drift"]), batch_id)
        self.log.prune(self.spark)
        decision["retrained"] = self.retrain and decision["drift"] and self._retrain(batch_id)
        version = batch_id if decision["retrained"] else model.version
        self._keep_state(batch_id, version=version, learned=model.version, controller=decision["controller"], loop=decision["loop"])
        self._record(result, batch_id, rows, model.version, decision, time.time() - started)
        if self.on_batch is not None:
            self.on_batch(result.withColumn("drift", F.lit(decision["drift"])), batch_id)

    def _bootstrap(self, rows: DataFrame, batch_id: int) -> None:
        """First batch without a model: it calibrates and emits nothing."""
        label = self.truth or "BinLabel"
        logged = rows.select("seq", *[F.col(c).cast("double").alias(c) for c in self.columns], F.col(label).cast("int").alias("BinLabel"),
                             F.lit("truth").alias("label_source"), F.lit(False).alias("drift"))
        self.log.append(logged, batch_id)
        model = fit_version(rows, self.columns, self.config, batch_id, label, **self.classifier_params)
        if model is not None:
            self._save(model)
            self._keep_state(batch_id, version=batch_id)

    def _score(self, prepared: DataFrame, model: ModelVersion) -> DataFrame:
        vector = "features_pca" if self.config.use_pca else "features"
        helpers = [c for c in prepared.columns if c.endswith("__z") or c in ("_components", "features", "features_pca")]
        slim = prepared.withColumn("_vector", F.col(vector)).drop(*helpers).withColumnRenamed("_vector", "features")
        out = model.classifier.transform(slim).withColumn("prediction", F.col("prediction").cast("int"))
        own = [c for c in out.columns if c in slim.columns or c == "prediction"]
        out = out.select(*own)
        if model.evaluator is None:
            return out.drop("features")
        predicted = out.withColumnRenamed("prediction", "_prediction")
        judged = model.evaluator.predict(predicted).drop("prediction", "probability")
        flagged = model.evaluator.flags(judged, self.config.conformal.rule, self.config.conformal.significance)
        return flagged.withColumnsRenamed({"_prediction": "prediction", "drift": "row_drift"}).drop("features")

    def _test(self, scored: DataFrame, model: ModelVersion, batch_id: int, before: int | None, state: dict) -> dict:
        """Decision for the batch; only its few numbers reach the driver."""
        out = {"drift": False, "p_first": None, "class_first": None, "alpha": None, "controller": None, "loop": None}
        if model.evaluator is None:
            return out
        c = self.config.conformal
        first = scored.agg(
            F.min_by("class", "seq").alias("class"), F.min_by("p_value", "seq").alias("p"),
            F.min_by("row_drift", "seq").alias("first"), F.bool_or("row_drift").alias("any"),
            F.avg(F.col("row_drift").cast("double")).alias("rate"),
        ).first()
        decided = {"first": first["first"], "any": first["any"], "rate": (first["rate"] or 0.0) > c.rate}
        out.update(p_first=first["p"], class_first=first["class"])
        control = None if self.config.significance is None else self._levels(model, state, self.config.significance)
        if self.config.adaptive_chunks is not None:
            loop = self._loop(state, control)
            cut = self._cut(self._narrow(scored, batch_id), batch_id, before, loop)
            out["loop"] = cut.agg(F.max("loop")).first()[0]
            out["drift"] = bool(cut.agg(F.bool_or("drift")).first()[0])
            control = self._loop({"loop": out["loop"]}, None).levels
        elif control is not None and first["p"] is not None:
            control.observe([first["class"]], [first["p"]])
            out["alpha"] = control.alpha(first["class"])
            out["drift"] = first["p"] < out["alpha"]
        else:
            out["drift"] = bool(decided[c.mode])
        if control is not None:
            out["controller"] = json.dumps([[k, level, seen] for k, (level, seen) in control.held.items()])
        return out

    def _levels(self, model: ModelVersion, state: dict, config: SignificanceConfig) -> Levels:
        """The controller after the previous batch; after a retrain it lives on and learns the new calibration scores too."""
        control = Levels(config)
        if state["controller"] is not None:
            control = Levels(config, {k: (level, seen) for k, level, seen in json.loads(state["controller"])})
            if state["learned"] == model.version:
                return control
        return observe_calibration(control, model.evaluator)

    # adaptive chunks -----------------------------------------------------------

    def _loop(self, state: dict, control: Levels | None) -> ChunkLoop:
        c = self.config
        loop = ChunkLoop(c.adaptive_chunks, c.conformal.mode, c.conformal.rate, c.significance)
        if state["loop"] is not None:
            loop.load(state["loop"])
        if control is not None:
            loop.levels = control
        return loop

    @staticmethod
    def _narrow(scored: DataFrame, batch_id: int) -> DataFrame:
        return scored.select(F.lit(batch_id).cast("bigint").alias("arrived"), F.col("seq").cast("bigint").alias("seq"), F.col("class").alias("kind"), F.col("p_value").cast("double").alias("p_value"), "row_drift")

    def _cut(self, rows: DataFrame | None, batch_id: int, before: int | None, loop: ChunkLoop, flush: bool = False) -> DataFrame:
        """Rows that waited and new ones with their chunks, stored under the batch id; rows without a chunk wait on."""
        waiting = None
        if before is not None and before in self._batches("cuts"):
            waiting = self.spark.read.parquet(f"{self.base}/cuts/batch_id={before}").filter("chunk_no IS NULL").select("arrived", "seq", "kind", "p_value", "row_drift")
        parts = [p for p in (waiting, rows) if p is not None]
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        kinds, names = ", ".join(f"`{c}` {t}" for c, t in both.dtypes), [*both.columns, *(c.split()[0] for c in CHUNKED.split(", "))]

        def one(pdf):
            done, rest = loop.cut(pdf.sort_values(["arrived", "seq"], ignore_index=True).astype({"kind": object}), flush)
            whole = done if rest.empty else rest if done.empty else pd.concat([done, rest], ignore_index=True)
            return whole.reindex(columns=names).assign(loop=[loop.dump()] + [None] * (len(whole) - 1))

        cut = both.groupBy().applyInPandas(one, f"{kinds}, {CHUNKED}, loop string")
        path = f"{self.base}/cuts/batch_id={batch_id}"
        cut.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def finish(self) -> None:
        """Close the unfinished chunk of a stream that has ended; a later batch takes its rows up again instead."""
        last = self._batches("state")[-1]
        _, state = self._state_before(last + 1)
        if last in self._batches("cuts"):
            self._cut(None, last + 1, last, self._loop(state, None), flush=True)

    def adaptive_chunks(self) -> DataFrame | None:
        """One row for each chunk of the loop."""
        cuts = self._table("cuts")
        return None if cuts is None else chunk_table(cuts.filter("chunk_no IS NOT NULL"), [])

    def _pseudo_labelled(self, result: DataFrame, drift: bool) -> DataFrame:
        """Log rows labelled with the prediction; a known truth replaces it where that is allowed."""
        label, source = F.col("prediction").cast("int"), F.lit("prediction")
        if self.learn_from_truth and self.truth in result.columns:
            known = F.col(self.truth).isNotNull()
            label = F.when(known, F.col(self.truth).cast("int")).otherwise(label)
            source = F.when(known, F.lit("truth")).otherwise(source)
        features = [
            (F.col(c) if c in result.columns else F.lit(None)).cast("double").alias(c) for c in self.columns
        ]
        return result.select(
            "seq", *features, label.alias("BinLabel"), source.alias("label_source"), F.lit(drift).alias("drift")
        )

    def _retrain(self, batch_id: int) -> bool:
        """Refit on the newest log rows; the new version serves the next batch on."""
        rows = self.log.read(self.spark)
        fitted = fit_version(materialize(rows), self.columns, self.config, batch_id, **self.classifier_params)
        if fitted is None:
            return False
        if self.config.scope == "evaluator_only" and self._held is not None:
            fitted = ModelVersion(batch_id, self._held.features, self._held.classifier, self._recalibrated(rows, batch_id))
        self._save(fitted)
        return True

    def _recalibrated(self, rows: DataFrame, batch_id: int) -> Calibrated:
        """A new evaluator in the feature space of the model that stays."""
        good, _ = quarantine_bad_labels(rows, "BinLabel", name="label")
        vector = "features_pca" if self.config.use_pca else "features"
        prepared = materialize(
            self._held.features.transform(good).select("seq", F.col("label").cast("double").alias("label"), F.col(vector).alias("features"))
        )
        classes = prepared.select("label").distinct().count()
        width = len(prepared.first()["features"])
        estimator = _evaluator_estimator(self.config, width, classes, self.classifier_params)
        return make_evaluator(self.config.conformal.evaluator)(prepared, estimator, self.config.conformal, "seq")

    # results -------------------------------------------------------------------

    def _record(self, result: DataFrame, batch_id: int, rows: int, version: int, decision: dict, seconds: float) -> None:
        correct = None
        if self.truth and self.truth in result.columns:
            correct = result.filter(F.col(self.truth).cast("int") == F.col("prediction")).count()
        schema = ("chunk_id bigint, rows bigint, correct bigint, drift boolean, class_first int, p_first double, alpha double, "
                  "version bigint, retrained boolean, latency_s double, controller string")
        d = decision
        row = (batch_id, rows, correct, d["drift"], d["class_first"], d["p_first"], d["alpha"], version, d["retrained"], seconds, d["controller"])
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/chunks/batch_id={batch_id}")

    def _table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.base}/{name}")
        except AnalysisException:
            return None

    def chunks(self) -> DataFrame | None:
        """One row per processed batch."""
        return self._table("chunks")

    def scored(self) -> DataFrame | None:
        return self._table("scored")

    def calibrations(self) -> DataFrame:
        """Model quality of every version (one row each)."""
        versions = self.spark.read.schema("version bigint, batch bigint").parquet(f"{self.base}/versions")
        return self.spark.read.parquet(*[f"{self._path(r['version'])}/evaluator/metrics" for r in versions.collect()])

    def latency(self) -> DataFrame:
        return latency_summary(self.chunks())

    def quality(self) -> DataFrame:
        """Metrics of all scored rows against the truth column."""
        known = self.scored().withColumn("_truth", F.col(self.truth).cast("int"))
        return model_metrics(known, 2, "_truth", "prediction")

    # streaming -------------------------------------------------------------------

    def start(self, flows: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Run over a streaming flow table; each micro-batch is one chunk."""
        writer = flows.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


class ProgressLog(StreamingQueryListener):
    """Keeps the progress of every micro-batch of a query in a table, however many there are.

    Spark itself remembers the last hundred only. Rows are gathered and written ``every`` so many batches, and when
    the query ends. A batch that is run again is reported again; ``table`` takes the last report.
    """

    def __init__(self, spark: SparkSession, base: str, every: int = 50) -> None:
        self.spark, self.base, self.every = spark, base.rstrip("/"), every
        self.rows, self.newest, self.lock = [], {}, threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows.append((str(p.id), int(p.batchId), int(p.numInputRows), float(p.batchDuration) / 1000, p.timestamp))
        self.newest[str(p.id)] = int(p.batchId)
        if len(self.rows) >= self.every:
            self.flush()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.flush()

    def flush(self) -> None:
        with self.lock:  # who asks for the table waits for a write that is under way
            rows, self.rows = self.rows, []
            if rows:
                self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(f"{self.base}/part={uuid.uuid4().hex}")

    def wait_for(self, query: StreamingQuery, seconds: float = 30.0) -> None:
        """Reports come a little after their batch: wait until that of the query's last batch is here."""
        last = query.lastProgress
        ends = time.time() + seconds
        while last is not None and time.time() < ends and self.newest.get(str(last["id"]), -1) < int(last["batchId"]):
            time.sleep(0.05)

    def table(self) -> DataFrame:
        """One row for each batch: query, batch_id, rows, latency_s, at."""
        self.flush()
        found = self.spark.read.schema(PROGRESS).parquet(f"{self.base}/part=*")
        last = F.max_by(F.struct("rows", "latency_s", "at"), "at").alias("last")
        return found.groupBy("query", "batch_id").agg(last).select("query", "batch_id", "last.*")


PROGRESS = "query string, batch_id bigint, rows bigint, latency_s double, at string"


def progress_table(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Recent micro-batches of a query: id, rows and seconds."""
    schema = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("latency_s", T.DoubleType())])
    rows = [(int(p["batchId"]), int(p["numInputRows"]), float(p["batchDuration"]) / 1000) for p in query.recentProgress]
    return spark.createDataFrame(rows, schema)


def run_payloads(
    payloads: DataFrame, schema: T.StructType, callback: Callable[[DataFrame, int], None], checkpoint: str, payload: str = "value"
) -> StreamingQuery:
    """Decode pushed CSV batches and hand each micro-batch to a callback."""
    from flowdrift.sources.readers import decode_csv_payloads

    decoded = decode_csv_payloads(payloads, schema, payload)
    return decoded.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).start()
