"""Queries on trained models whose result does not depend on the fit: which rows come out, and what must hold for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowdrift.config import ConformalConfig, DriftConfig
from flowdrift.operators import metrics, ml, sampling
from flowdrift.operators.evaluators import make_evaluator
from flowdrift.plans.queries_models import MODEL_COLUMNS, labelled, multi_labelled
from flowdrift.plans.queries_streams import scratch
from flowdrift.plans.registry import query
from flowdrift.plans.tables import RAW_FLOWS_SQL
from flowdrift.session import materialize
from flowdrift.sources import sinks
from flowdrift.streaming.drift import fit_version

# The 80/20 split by the order of a hash of the row id, over all rows and inside the binary label.
_SPLIT_SQL = f"""{RAW_FLOWS_SQL}, named AS (SELECT event_id, label, label <> 'Benign' AS attack FROM raw_flows),
placed AS (SELECT *, row_number() OVER (ORDER BY md5(cast(event_id AS varchar)), event_id) AS pos_all, count(*) OVER () AS n_all,
 row_number() OVER (PARTITION BY attack ORDER BY md5(cast(event_id AS varchar)), event_id) AS pos, count(*) OVER (PARTITION BY attack) AS n
 FROM named)"""
_HELD_OUT = "pos_all > floor(n_all * 0.8::double + 0.5)"
_HELD_OUT_BY_CLASS = "pos > floor(n * 0.8::double + 0.5)"


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = sampling.split(rows, "event_id")
    return marked.filter("is_train"), marked.filter("NOT is_train")


@query("a8_loaded_pipeline_agrees", f"WITH {RAW_FLOWS_SQL} SELECT event_id, true AS same FROM raw_flows")
def loaded_pipeline_agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, base = labelled(spark, sf_dir), scratch(spark)
    fitted = ml.train(rows, MODEL_COLUMNS, variant="dt", use_pca=True)
    sinks.save_pipeline(fitted, base, "flows", "binary", "dt")
    loaded = sinks.load_pipeline(base, "flows", "binary", "dt")
    before = ml.score(rows, fitted).select("event_id", F.col("prediction").alias("before"))
    after = ml.score(rows, loaded).select("event_id", F.col("prediction").alias("after"))
    return before.join(after, "event_id").select("event_id", (F.col("before") == F.col("after")).alias("same"))


@query("a8_knn_loaded_agrees", f"WITH {RAW_FLOWS_SQL} SELECT event_id, true AS same, true AS own FROM raw_flows")
def loaded_neighbours_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved neighbour model answers as before; with one neighbour, each flow is given the label of a flow with its features."""
    rows, base = labelled(spark, sf_dir), scratch(spark)
    fitted = ml.train(rows, MODEL_COLUMNS, variant="knn", k=1)
    sinks.save_pipeline(fitted, base, "flows", "binary", "knn")
    loaded = sinks.load_pipeline(base, "flows", "binary", "knn")
    before = ml.score(rows, fitted).select("event_id", F.col("prediction").alias("before"))
    # stored: both sides of the join below read it
    after = materialize(ml.score(rows, loaded).select("event_id", F.col("prediction").alias("after"), "label", *MODEL_COLUMNS))
    twins = after.groupBy(*MODEL_COLUMNS).agg(F.collect_set("label").alias("seen"))
    match = [F.col(f"a.{c}").eqNullSafe(F.col(f"t.{c}")) for c in MODEL_COLUMNS]
    own = after.alias("a").join(twins.alias("t"), match).select("event_id", "after", "seen")
    return before.join(own, "event_id").select(
        "event_id", (F.col("before") == F.col("after")).alias("same"), F.array_contains("seen", F.col("after")).alias("own")
    )


@query("g2_pca_reaches_its_share", f"WITH {RAW_FLOWS_SQL} SELECT event_id, true AS enough, true AS none_to_spare FROM raw_flows")
def pca_reaches_its_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many components as 95 % of the variance need, and no more; each row has that many."""
    rows = labelled(spark, sf_dir)
    stages, vector = ml.fit_features(rows, MODEL_COLUMNS, use_pca=True)
    shares = [float(s) for s in stages[-2].explainedVariance.toArray()]
    projected = ml.PipelineModel(stages=stages).transform(rows)
    k = F.size(ml.vector_to_array(vector))
    total = F.aggregate(F.slice(F.array(*map(F.lit, shares)), 1, k), F.lit(0.0), lambda a, b: a + b)
    fewer = F.aggregate(F.slice(F.array(*map(F.lit, shares)), 1, k - 1), F.lit(0.0), lambda a, b: a + b)
    return projected.select("event_id", (total >= 0.95 - 1e-9).alias("enough"), (fewer < 0.95).alias("none_to_spare"))


@query(
    "g3_shares_add_up",
    f"WITH {RAW_FLOWS_SQL} SELECT true AS falling, true AS cumulative, count(*) AS rows FROM raw_flows",
)
def shares_add_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    stages, _ = ml.fit_features(rows, MODEL_COLUMNS, use_pca=True)
    table = ml.explained_variance_table(stages[-2], spark)
    pairs = table.alias("a").join(table.alias("b"), F.col("b.component") == F.col("a.component") - 1, "left")
    return pairs.agg(
        F.bool_and(F.coalesce(F.col("b.explained_pct") >= F.col("a.explained_pct"), F.lit(True))).alias("falling"),
        F.bool_and(F.abs(F.coalesce(F.col("b.cumulative_pct"), F.lit(0.0)) + F.col("a.explained_pct") - F.col("a.cumulative_pct")) < 0.16).alias("cumulative"),
        F.lit(rows.count()).cast("bigint").alias("rows"),
    )


def _report(df: DataFrame, variant: str, task: str, **more) -> DataFrame:
    """Support by class of the held-out rows, and whether the shares of the report are shares."""
    train, held_out = _split(df)
    fitted = ml.train(train, MODEL_COLUMNS, variant=variant, task=task, n_classes=2 if task == "binary" else 3, **more)
    report = metrics.classification_report(ml.score(held_out, fitted, task=task, names=["Benign", "TCPAttack", "UDPAttack"]))
    shares = F.array("precision", "recall", "f1")
    return report.filter("support > 0").select(
        F.col("class").cast("bigint").alias("class"), "support", F.forall(shares, lambda s: (s >= 0) & (s <= 1)).alias("valid")
    )


_BINARY_SQL = f"WITH {_SPLIT_SQL} SELECT attack::bigint AS class, count(*) AS support, true AS valid FROM placed WHERE {_HELD_OUT} GROUP BY attack"
_MULTI_SQL = f"""WITH {_SPLIT_SQL} SELECT CASE label WHEN 'Benign' THEN 0 WHEN 'TCPAttack' THEN 1 ELSE 2 END::bigint AS class,
 count(*) AS support, true AS valid FROM placed WHERE {_HELD_OUT} GROUP BY ALL"""


@query("g7_rf_support", _BINARY_SQL)
def rf_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(labelled(spark, sf_dir), "rf", "binary")


@query("g7_dt_multi_support", _MULTI_SQL)
def dt_multi_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(multi_labelled(spark, sf_dir), "dt", "multi", use_pca=True)


@query("g8_gbt_support", _BINARY_SQL)
def gbt_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(labelled(spark, sf_dir), "gbt", "binary")


@query("g9_svm_support", _BINARY_SQL)
def svm_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(labelled(spark, sf_dir), "svm", "binary", kernel="linear")


@query("g10_mlp_support", _BINARY_SQL)
def mlp_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(labelled(spark, sf_dir), "mlp", "binary")


@query("g6_cv_folds", f"WITH {RAW_FLOWS_SQL} SELECT unnest(range(5)) AS fold, true AS valid, count(*) AS rows FROM raw_flows")
def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    stages, vector = ml.fit_features(rows, MODEL_COLUMNS)
    prepared = ml.PipelineModel(stages=stages).transform(rows).select("event_id", vector, "label")
    folds = ml.cv_accuracy(prepared, ml.make_estimator("dt"), "event_id")
    whole = F.lit(rows.count()).cast("bigint").alias("rows")
    return folds.select(F.col("fold").cast("bigint"), F.col("accuracy").between(0, 1).alias("valid"), whole)


@query("g6_cv_summary", f"WITH {RAW_FLOWS_SQL} SELECT avg(1.0::double) AS mean_accuracy, 0.0::double AS std_accuracy FROM raw_flows")
def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label that one feature decides is learned without a fault in every fold."""
    rows = labelled(spark, sf_dir).withColumn("label", (F.col("event_id") % 2).cast("double"))
    rows = rows.withColumn("side", F.col("label") * 2 - 1)
    stages, vector = ml.fit_features(rows, [*MODEL_COLUMNS, "side"])
    prepared = ml.PipelineModel(stages=stages).transform(rows).select("event_id", vector, "label")
    return ml.cv_summary(ml.cv_accuracy(prepared, ml.make_estimator("dt"), "event_id"))


@query("g12_score_rows", f"WITH {RAW_FLOWS_SQL} SELECT event_id, true AS valid FROM raw_flows")
def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is scored once, with a missing feature column, and carries the name of its class."""
    rows = labelled(spark, sf_dir)
    scored = ml.score(rows.drop("fwd_iat_mean"), ml.train(rows, MODEL_COLUMNS, variant="dt"), threshold=0.5)
    name = F.when(F.col("prediction") == 1, "Attack").when(F.col("prediction") == 0, "Benign")
    return scored.select("event_id", F.col("predicted_name").eqNullSafe(name).alias("valid"))


@query("g14_fresh_estimator", f"WITH {RAW_FLOWS_SQL} SELECT event_id, true AS same FROM raw_flows")
def fresh_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unfitted copy has the same parameters, so it learns the same from the same rows."""
    rows = labelled(spark, sf_dir)
    stages, vector = ml.fit_features(rows, MODEL_COLUMNS)
    prepared = materialize(ml.PipelineModel(stages=stages).transform(rows).select("event_id", vector, "label"))
    first = ml.make_estimator("dt")
    second = ml.fresh_estimator(first)
    a, b = (e.fit(prepared).transform(prepared).select("event_id", "prediction") for e in (first, second))
    b = b.withColumnRenamed("prediction", "again")
    return a.join(b, "event_id").select("event_id", (F.col("prediction") == F.col("again")).alias("same"))


def _evaluated(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Held-out rows with whether class, p-value and flag are what they may be."""
    rows = labelled(spark, sf_dir)
    stages, vector = ml.fit_features(rows, MODEL_COLUMNS)
    prepared = ml.PipelineModel(stages=stages).transform(rows).select("event_id", vector, "label")
    marked = materialize(sampling.split(prepared, "event_id", label="label"))
    train, test = (marked.filter(c).drop("is_train") for c in ("is_train", "NOT is_train"))
    calibrated = make_evaluator(kind)(train, ml.make_estimator("dt"), ConformalConfig(evaluator=kind), "event_id")
    judged = calibrated.flags(calibrated.predict(test))
    valid = F.col("class").isin(0, 1) & (F.col("p_value") > 0) & (F.col("p_value") <= 1) & F.col("drift").isNotNull()
    return judged.select("event_id", F.coalesce(valid, F.lit(False)).alias("valid"))


_EVALUATED_SQL = f"WITH {_SPLIT_SQL} SELECT event_id, true AS valid FROM placed WHERE {_HELD_OUT_BY_CLASS}"


@query("i5_ice_rows", _EVALUATED_SQL)
def ice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "ice")


@query("i6_cce_rows", _EVALUATED_SQL)
def cce_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "cce")


@query("i8_approx_cce_rows", _EVALUATED_SQL)
def approx_cce_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "approx_cce")


@query("i9_approx_tce_rows", _EVALUATED_SQL)
def approx_tce_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "approx_tce")


def _calibrated_apart(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Calibration rows of each class for an evaluator whose model is not the classifier."""
    config = DriftConfig(variant="dt", conformal=ConformalConfig(evaluator="ice"), evaluator_model=kind)
    model = fit_version(labelled(spark, sf_dir), MODEL_COLUMNS, config, 0, "label", "event_id")
    return model.evaluator.counts.groupBy(F.col("class").cast("bigint").alias("class")).agg(F.sum("n").alias("rows"))


_CALIBRATED_SQL = f"WITH {_SPLIT_SQL} SELECT attack::bigint AS class, count(*) AS rows FROM placed WHERE {_HELD_OUT_BY_CLASS} GROUP BY 1"


@query("i5_svm_evaluator_counts", _CALIBRATED_SQL)
def svm_evaluator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated_apart(spark, sf_dir, "svm")


@query("i5_mlp_evaluator_counts", _CALIBRATED_SQL)
def mlp_evaluator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated_apart(spark, sf_dir, "mlp")


@query(
    "i11_make_evaluator",
    f"WITH {_SPLIT_SQL} SELECT kind, count(*) AS rows FROM placed, (VALUES ('ice'), ('approx_tce')) k(kind) WHERE {_HELD_OUT_BY_CLASS} GROUP BY kind",
)
def evaluators_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluators made by name judge every held-out row once."""
    frames = [_evaluated(spark, sf_dir, kind).select(F.lit(kind).alias("kind")) for kind in ("ice", "approx_tce")]
    return frames[0].union(frames[1]).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))
