"""Conformal evaluators: calibrate on labelled rows, then score new rows with p-values."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowdrift.config import EVALUATORS, ConformalConfig
from flowdrift.operators import conformal
from flowdrift.operators.control import Levels
from flowdrift.operators.metrics import model_metrics
from flowdrift.operators.ml import fresh_estimator
from flowdrift.operators.ordering import last_n
from flowdrift.operators.sampling import split, stratified_folds
from flowdrift.session import materialize


@dataclass
class Calibrated:
    """A calibrated evaluator: its models, calibration counts and class thresholds.

    ``seeds`` holds the (class, score, seq) rows with which an adaptive
    significance controller starts; ``metrics`` one row of model quality.
    """

    evaluator: str
    models: list
    counts: DataFrame
    thresholds: DataFrame
    seeds: DataFrame
    metrics: DataFrame

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``class``, ``score`` (1 - P(class)) and ``p_value``. Rows are scored once and stored: the p-values read them twice."""
        if len(self.models) == 1:
            scored = _predict_one(self.models[0], df)
        else:
            scored = df
            for i, model in enumerate(self.models):
                scored = _predict_fold(model, scored, i)
            classes = [f"_class_{i}" for i in range(len(self.models))]
            scores = [f"_score_{i}" for i in range(len(self.models))]
            scored = conformal.combine_folds(scored, classes, scores).drop(*classes, *scores)
        return conformal.p_values(materialize(scored), self.counts)

    def flags(self, scored: DataFrame, rule: str = "score_quantile", significance: float = 0.05) -> DataFrame:
        return conformal.drift_flags(scored, self.thresholds, rule, significance)

    def save(self, path: str) -> None:
        for i, model in enumerate(self.models):
            model = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
            model.write().overwrite().save(f"{path}/model_{i}")
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        self.thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")
        self.seeds.write.mode("overwrite").parquet(f"{path}/seeds")
        self.metrics.withColumn("evaluator", F.lit(self.evaluator)).withColumn(
            "models", F.lit(len(self.models))
        ).write.mode("overwrite").parquet(f"{path}/metrics")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Calibrated:
        metrics = spark.read.parquet(f"{path}/metrics")
        about = metrics.select("evaluator", "models").first()
        return Calibrated(
            about["evaluator"],
            [PipelineModel.load(f"{path}/model_{i}") for i in range(about["models"])],
            spark.read.parquet(f"{path}/counts"),
            spark.read.parquet(f"{path}/thresholds"),
            spark.read.parquet(f"{path}/seeds"),
            metrics.drop("evaluator", "models"),
        )


_OUTPUTS = ("rawPrediction", "probability", "prediction")


def _new_columns(before: DataFrame, after: DataFrame, keep: tuple[str, ...] = ()) -> list[str]:
    old = set(before.columns)
    return [c for c in after.columns if c not in old and c not in keep]


def _predict_one(model, df: DataFrame) -> DataFrame:
    base = df.drop(*_OUTPUTS)
    out = model.transform(base)
    out = out.withColumn("class", F.col("prediction").cast("int")).withColumn(
        "score", conformal.nonconformity_pred("probability")
    )
    return out.drop(*_new_columns(base, out, ("class", "score", "prediction", "probability")))


def _predict_fold(model, df: DataFrame, i: int) -> DataFrame:
    base = df.drop(*_OUTPUTS)
    out = model.transform(base)
    out = out.withColumn(f"_class_{i}", F.col("prediction").cast("int")).withColumn(
        f"_score_{i}", conformal.nonconformity_pred("probability")
    )
    return out.drop(*_new_columns(base, out, (f"_class_{i}", f"_score_{i}")))


def _calibration_rows(model, df: DataFrame, row_id: str, label: str, *kept: str) -> DataFrame:
    """(kept columns, seq, true class, score by true class, predicted class, score by predicted class)."""
    out = model.transform(df.drop(*_OUTPUTS))
    return out.select(
        *kept,
        F.col(row_id).alias("seq"),
        F.col(label).cast("int").alias("class"),
        conformal.nonconformity("probability", label).alias("score"),
        F.col("prediction").cast("int").alias("predicted"),
        conformal.nonconformity_pred("probability").alias("predicted_score"),
    )


def _finish(
    config: ConformalConfig, models: list, calibration: DataFrame, judged: DataFrame, seeds: DataFrame, window: int
) -> Calibrated:
    counts = conformal.calibration_counts(calibration)
    thresholds = materialize(conformal.class_thresholds(counts, config.significance, counted="n"))
    classes = judged.select("class").distinct().count()
    quality = model_metrics(judged, classes, "class", "predicted")
    newest = materialize(last_n(seeds.select("class", "score", "seq"), window, ["seq"], ["class"]))
    return Calibrated(config.evaluator, models, counts, thresholds, newest, materialize(quality))


def calibrate_ice(
    df: DataFrame, estimator: Estimator, config: ConformalConfig, row_id: str, label: str = "label", window: int = 100
) -> Calibrated:
    """Fit on a stratified part, calibrate on the held-out rest, judge on all rows. Every row is scored once."""
    marked = materialize(split(df, row_id, 1.0 - config.calibration_split, label, "_proper"))
    model = fresh_estimator(estimator).fit(marked.filter("_proper"))
    judged = materialize(_calibration_rows(model, marked, row_id, label, "_proper"))
    rows = judged.filter("NOT _proper")
    return _finish(config, [model], rows, judged, rows, window)


def calibrate_cce(
    df: DataFrame, estimator: Estimator, config: ConformalConfig, row_id: str, label: str = "label", window: int = 100
) -> Calibrated:
    """One model per fold, fitted on the other folds; the held-out scores of all folds are pooled.

    Folds are stored apart, so a held-out one is read alone. Driver threads only submit the fits.
    """
    folded = materialize(stratified_folds(df, row_id, label, config.folds, "_fold"), "_fold")

    def one(k: int):
        model = fresh_estimator(estimator).fit(folded.filter(F.col("_fold") != k))
        return model, _calibration_rows(model, folded.filter(F.col("_fold") == k), row_id, label)

    with ThreadPoolExecutor(min(config.folds, 4)) as pool:
        fitted = list(pool.map(one, range(config.folds)))
    rows = materialize(conformal.union_all([r for _, r in fitted]))
    return _finish(config, [m for m, _ in fitted], rows, rows, rows, window)


def _calibrate_approx(
    df: DataFrame, estimator: Estimator, config: ConformalConfig, row_id: str, label: str, window: int, seed_score: str
) -> Calibrated:
    model = fresh_estimator(estimator).fit(df)
    rows = materialize(_calibration_rows(model, df, row_id, label))
    seeds = rows.select("seq", F.col("predicted").alias("class"), F.col(seed_score).alias("score"))
    return _finish(config, [model], rows, rows, seeds, window)


def calibrate_approx_cce(
    df: DataFrame, estimator: Estimator, config: ConformalConfig, row_id: str, label: str = "label", window: int = 100
) -> Calibrated:
    """One model on all rows. Folds only partition the scoring, so the pooled scores are those of one pass."""
    return _calibrate_approx(df, estimator, config, row_id, label, window, "predicted_score")


def calibrate_approx_tce(
    df: DataFrame, estimator: Estimator, config: ConformalConfig, row_id: str, label: str = "label", window: int = 100
) -> Calibrated:
    """One model on all rows, scored on the same rows."""
    return _calibrate_approx(df, estimator, config, row_id, label, window, "score")


def make_evaluator(kind: str):
    """The calibration function of an evaluator type; None for ``none``."""
    if kind not in EVALUATORS:
        raise ValueError(f"unknown evaluator type: {kind}")
    return {
        "ice": calibrate_ice,
        "cce": calibrate_cce,
        "approx_cce": calibrate_approx_cce,
        "approx_tce": calibrate_approx_tce,
        "none": None,
    }[kind]


def observe_calibration(control: Levels, evaluator: Calibrated) -> Levels:
    """Let a significance controller see the calibration scores: class by class for the cross evaluator, else all at once."""
    seeds = evaluator.seeds.orderBy("seq").collect()  # at most `window` rows per class
    groups = [[r for r in seeds if r["class"] == cls] for cls in sorted({r["class"] for r in seeds})] if evaluator.evaluator == "cce" else [seeds]
    for rows in groups:
        control.observe([r["class"] for r in rows], [r["score"] for r in rows])
    return control
