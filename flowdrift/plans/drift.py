"""Replay of recorded flows against a model trained on labelled ones, as one batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdrift.config import DriftConfig
from flowdrift.operators.clean import fill_mean
from flowdrift.operators.conformal import detect_drift
from flowdrift.operators.control import Levels, adaptive_significance, drift_ema
from flowdrift.operators.evaluators import observe_calibration
from flowdrift.operators.ml import align_to_model
from flowdrift.operators.ordering import assign_chunks
from flowdrift.session import materialize
from flowdrift.streaming.drift import ModelVersion, fit_version


def score_flows(flows: DataFrame, model: ModelVersion, config: DriftConfig, chunk: list[str], keep: list[str]) -> DataFrame:
    """Class, score, p-value and drift flag of every row; nulls take the mean of their chunk."""
    columns = [c for c in flows.columns if c not in {*chunk, *keep}]
    filled = fill_mean(flows, columns, chunk)
    prepared = model.features.transform(align_to_model(filled, model.features))
    vector = "features_pca" if config.use_pca else "features"
    slim = prepared.select(*chunk, *keep, F.col(vector).alias("features"))
    judged = model.evaluator.predict(slim).drop("prediction", "probability", "features")
    return model.evaluator.flags(judged, config.conformal.rule, config.conformal.significance).withColumnRenamed(
        "drift", "row_drift"
    )


def replay(
    training: DataFrame,
    flows: DataFrame,
    columns: list[str],
    config: DriftConfig,
    order: str,
    label: str = "BinLabel",
    **classifier_params,
) -> tuple[DataFrame, DataFrame]:
    """Scored rows and one row per chunk of ``config.chunk_size`` flows in arrival order.

    The model stays the same throughout; the drift stream is the form that
    retrains. Chunks carry ``rows``, ``drift``, the moving average of the drift
    rate and, with an adaptive significance, the level each was tested at.
    """
    model = fit_version(training.withColumn("seq", F.col(order)), columns, config, 0, label, **classifier_params)
    if model is None or model.evaluator is None:
        raise ValueError("a replay needs two classes and an evaluator")
    kept = [order, *([label] if label in flows.columns else [])]
    chunked = assign_chunks(flows.select(*kept, *[c for c in columns if c in flows.columns]), config.chunk_size, [order])
    scored = materialize(score_flows(chunked.drop("row_no"), model, config, ["chunk_id"], kept))
    flagged = scored.withColumn("drift", F.col("row_drift"))
    chunks = detect_drift(flagged, ["chunk_id"], order, config.conformal.mode, config.conformal.rate)
    if config.significance is not None:
        first = scored.groupBy("chunk_id").agg(
            F.count(F.lit(1)).alias("rows"), F.min_by("class", order).alias("class"), F.min_by("p_value", order).alias("p_value")
        )
        start = observe_calibration(Levels(config.significance), model.evaluator)
        tested = adaptive_significance(first, config.significance, ["chunk_id"], start=start)
        chunks = tested.select("chunk_id", "rows", "alpha", F.coalesce(F.col("p_value") < F.col("alpha"), F.lit(False)).alias("drift"))
    followed = drift_ema(chunks.withColumn("chunk_no", F.col("chunk_id") + 1))
    return scored, followed.drop("chunk_no")
