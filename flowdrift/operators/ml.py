"""Feature scaling, projection, training and scoring on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, PCAModel, PolynomialExpansion, SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.functions.columns import decode_prediction
from flowdrift.operators.clean import fill_mean
from flowdrift.operators.margins import LinearSvm
from flowdrift.operators.metrics import overall_accuracy
from flowdrift.operators.sampling import stratified_folds
from flowdrift.session import materialize

SEED = 42
SCALED = "__z"


# Scaling --------------------------------------------------------------------


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with mean and population deviation, from a single aggregation."""
    parts = [
        F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")) for c in columns
    ]
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores with the population deviation; a constant column becomes 0."""
    stats = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).alias("t")).scalar()
    out = {}
    for c in columns:
        mean, std = stats.getField(c).getField("m"), stats.getField(c).getField("s")
        out[c] = F.when(F.col(c).isNotNull(), F.when(std > 0, (F.col(c) - mean) / std).otherwise(F.lit(0.0)))
    return df.withColumns(out)


def scaling_stage(df: DataFrame, columns: list[str]) -> SQLTransformer:
    """A stage that fills nulls with the training mean and scales, as plain SQL with the fitted numbers."""
    stats = {r["column"]: r for r in column_stats(df, columns).collect()}
    scaled = []
    for c in columns:
        mean = float(stats[c]["mean"] or 0.0)
        std = float(stats[c]["std"] or 0.0) or 1.0
        scaled.append(f"(coalesce(cast(`{c}` AS double), {mean!r}D) - {mean!r}D) / {std!r}D AS `{c}{SCALED}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


def fit_pca(df: DataFrame, features: str, share: float = 0.95, output: str = "features_pca") -> list[Transformer]:
    """Stages projecting to the fewest components that reach ``share`` of the variance."""
    size = len(df.select(vector_to_array(features).alias("v")).first()["v"])
    full = PCA(k=size, inputCol=features, outputCol="_components").fit(df)
    k = components_needed(full, share)
    return [full, VectorSlicer(inputCol="_components", outputCol=output, indices=list(range(k)))]


def components_needed(model: PCAModel, share: float = 0.95) -> int:
    reached = np.cumsum(model.explainedVariance.toArray())
    return int(np.searchsorted(reached, share - 1e-12) + 1) if reached[-1] >= share else len(reached)


def explained_variance_table(model: PCAModel, spark) -> DataFrame:
    """Component, share and cumulative share of the variance in percent (one row per component)."""
    shares = model.explainedVariance.toArray()
    rows = [(i + 1, round(float(s) * 100, 1), round(float(t) * 100, 1)) for i, (s, t) in enumerate(zip(shares, np.cumsum(shares)))]
    return spark.createDataFrame(rows, "component int, explained_pct double, cumulative_pct double")


def fit_features(
    df: DataFrame, columns: list[str], use_pca: bool = False, share: float = 0.95
) -> tuple[list[Transformer], str]:
    """Fitted stages from raw columns to a feature vector, and the name of that vector."""
    stages: list[Transformer] = [scaling_stage(df, columns)]
    stages.append(VectorAssembler(inputCols=[c + SCALED for c in columns], outputCol="features", handleInvalid="keep"))
    if not use_pca:
        return stages, "features"
    scaled = PipelineModel(stages=stages).transform(df)
    return [*stages, *fit_pca(scaled.select("features"), "features", share)], "features_pca"


def model_columns(model: PipelineModel) -> list[str]:
    """Training columns of a fitted pipeline, in trained order."""
    for stage in model.stages:
        if isinstance(stage, VectorAssembler):
            return [c.removesuffix(SCALED) for c in stage.getInputCols()]
    raise ValueError("the pipeline has no feature assembler")


def align_to_model(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add the model's missing columns as NULL; its scaling stage reads NULL as the training mean."""
    present = set(df.columns)
    missing = {c: F.lit(None).cast("double") for c in model_columns(model) if c not in present}
    return df.withColumns(missing) if missing else df


# Classifiers ------------------------------------------------------------------


class RandomFourierFeatures(
    Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable
):
    """Random cosine features whose inner products approximate the RBF kernel ``exp(-gamma |x - y|^2)``."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", typeConverter=TypeConverters.toFloat)
    dims = Param(Params._dummy(), "dims", "number of random features", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="features_rbf", gamma=0.1, dims=128, seed=SEED):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="features_rbf", gamma=0.1, dims=128, seed=SEED)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, dims, seed = self.getOrDefault("gamma"), self.getOrDefault("dims"), self.getSeed()

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            weights = phase = None
            for arrays in batches:
                x = np.vstack(arrays.to_numpy()) if len(arrays) else np.empty((0, 1))
                if weights is None:
                    rng = np.random.default_rng(seed)
                    weights = rng.normal(scale=np.sqrt(2 * gamma), size=(x.shape[1], dims))
                    phase = rng.uniform(0, 2 * np.pi, dims)
                yield pd.Series(list(np.sqrt(2 / dims) * np.cos(x @ weights + phase)))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(project(vector_to_array(self.getInputCol()))))


def _svm(task: str, kernel: str, features: str, label: str, overrides: dict) -> Estimator:
    """Linear SVM on an explicit kernel map, with class probabilities from a logistic fit on its margins."""
    stages: list = []
    if kernel == "poly":
        stages.append(PolynomialExpansion(degree=overrides.pop("degree", 3), inputCol=features, outputCol="features_poly"))
        features = "features_poly"
    elif kernel == "rbf":
        gamma, dims = overrides.pop("gamma", 0.1), overrides.pop("dims", 128)
        stages.append(RandomFourierFeatures(inputCol=features, outputCol="features_rbf", gamma=gamma, dims=dims))
        features = "features_rbf"
    elif kernel != "linear":
        raise ValueError(f"unknown kernel: {kernel}")
    svc = LinearSvm(
        featuresCol=features, labelCol=label, predictionCol="svm_side", rawPredictionCol="svm_margin",
        **{"regParam": 0.01, "maxIter": 50, **overrides},
    )
    if task == "multi":
        svc = OneVsRest(
            classifier=svc.copy(), featuresCol=features, labelCol=label, predictionCol="svm_side", rawPredictionCol="svm_margin"
        )
    platt = LogisticRegression(featuresCol="svm_margin", labelCol=label, regParam=0.0, maxIter=50)
    return Pipeline(stages=[*stages, svc, platt])


# Values that a task holds of its training rows while a forest is fitted: Spark keeps a count for each row and tree.
FOREST_VALUES = 20_000_000


class SlicedForest(RandomForestClassifier):
    """A random forest whose training rows lie in slices of a bounded size, the smaller the more trees there are."""

    def _fit(self, dataset: DataFrame):
        rows = materialize(dataset)  # Spark reads them several times
        slices = -(-rows.count() * self.getNumTrees() // FOREST_VALUES)
        # rows that fill no more slices than there are cores stay where they are
        return super()._fit(rows if slices <= rows.sparkSession.sparkContext.defaultParallelism else rows.repartition(slices))


def make_estimator(
    variant: str,
    task: str = "binary",
    n_features: int | None = None,
    n_classes: int = 2,
    features: str = "features",
    label: str = "label",
    **overrides,
) -> Estimator:
    """Unfitted classifier by variant: dt, rf, gbt, svm, mlp or knn. Each yields ``prediction`` and ``probability``.

    ``overrides`` replace the listed defaults. Tree depth is capped at 30 by Spark.
    """
    common = {"featuresCol": features, "labelCol": label}
    if variant == "dt":
        depth = 30 if task == "multi" else 20
        return DecisionTreeClassifier(**common, **{"maxDepth": depth, "seed": SEED, **overrides})
    if variant == "rf":
        return SlicedForest(**common, **{"numTrees": 100, "maxDepth": 15, "seed": SEED, **overrides})
    if variant == "gbt":
        overrides = {"maxDepth": 8, "stepSize": 0.1, "maxIter": 10, "seed": SEED, **overrides}
        if task == "binary":
            return GBTClassifier(**common, **overrides)
        gbt = GBTClassifier(**common, **overrides).setRawPredictionCol("gbt_margin")
        # raw one-vs-rest margins to probabilities through a multinomial fit
        rest = OneVsRest(classifier=gbt, **common, predictionCol="gbt_side", rawPredictionCol="gbt_margin")
        return Pipeline(stages=[rest, LogisticRegression(featuresCol="gbt_margin", labelCol=label, maxIter=50)])
    if variant == "svm":
        overrides = dict(overrides)
        kernel = overrides.pop("kernel", "poly" if task == "binary" else "rbf")
        return _svm(task, kernel, features, label, overrides)
    if variant == "mlp":
        if n_features is None:
            raise ValueError("mlp needs n_features")
        hidden = overrides.pop("hidden", [64, 32] if task == "binary" else [128, 64])
        layers = [n_features, *hidden, n_classes]
        from flowdrift.operators.nets import NetClassifier

        return NetClassifier(MultilayerPerceptronClassifier(**common, layers=layers, **{"maxIter": 50, "seed": SEED, **overrides}))
    if variant == "knn":
        from flowdrift.operators.neighbours import KnnClassifier

        return KnnClassifier(features=features, label=label, **{"k": 5 if task == "binary" else 4, **overrides})
    raise ValueError(f"unknown model variant: {variant}")


def fresh_estimator(estimator: Estimator) -> Estimator:
    """Unfitted copy with the same parameters."""
    return estimator.copy()


def train(
    df: DataFrame,
    columns: list[str],
    label: str = "label",
    variant: str = "rf",
    task: str = "binary",
    use_pca: bool = False,
    n_classes: int = 2,
    **overrides,
) -> PipelineModel:
    """Scaler, optional projection and classifier, fitted as one pipeline."""
    stages, vector = fit_features(df, columns, use_pca)
    prepared = PipelineModel(stages=stages).transform(df)
    width = len(columns) if vector == "features" else len(stages[-1].getIndices())
    classifier = make_estimator(variant, task, width, n_classes, vector, label, **overrides)
    return PipelineModel(stages=[*stages, classifier.fit(prepared.select(vector, label))])


def feature_part(model: PipelineModel) -> PipelineModel:
    """The fitted stages before the classifier."""
    return PipelineModel(stages=model.stages[:-1])


def score(
    df: DataFrame,
    model: PipelineModel,
    threshold: float | None = None,
    chunk: list[str] | None = None,
    names: list[str] | None = None,
    task: str = "binary",
) -> DataFrame:
    """Fill, align, scale, project and predict. Works on batch frames; on streams without ``chunk``.

    Nulls take the mean of their chunk where ``chunk`` is given, else the training
    mean. ``threshold`` replaces the argmax for binary models. Adds ``prediction``,
    ``probability`` and ``predicted_name``.
    """
    if chunk:
        present = [c for c in model_columns(model) if c in df.columns]
        df = fill_mean(df, present, chunk)
    scored = model.transform(align_to_model(df, model))
    if threshold is not None:
        above = F.get(vector_to_array("probability"), F.lit(1)) > threshold
        scored = scored.withColumn("prediction", above.cast("double"))
    named = decode_prediction(F.col("prediction"), names if task == "multi" else None)
    helpers = [c for c in scored.columns if c.endswith(SCALED)]
    return scored.withColumn("predicted_name", named).drop(*helpers)


def score_trailing(
    df: DataFrame, model: PipelineModel, end: str, order: list[str], chunk_size: int = 1000,
    window_us: int = 300_000_000, **kwargs,
) -> DataFrame:
    """Score, after each chunk, every row still in the trailing time window."""
    from flowdrift.operators.ordering import assign_chunks, trailing_window_rows

    seen = trailing_window_rows(assign_chunks(df, chunk_size, order), end, duration_us=window_us)
    return score(seen, model, chunk=["after_chunk"], **kwargs)


def cv_accuracy(
    df: DataFrame, estimator: Estimator, row_id: str, label: str = "label", folds: int = 5, parallel: int = 2
) -> DataFrame:
    """Accuracy of each fold, their mean and population deviation.

    Driver threads only submit the fits; each fit is a Spark job over all executors.
    """
    folded = materialize(stratified_folds(df, row_id, label, folds))

    def one(k: int) -> DataFrame:
        model = fresh_estimator(estimator).fit(folded.filter(F.col("fold") != k))
        scored = model.transform(folded.filter(F.col("fold") == k))
        hit = scored.select((F.col("prediction") == F.col(label)).alias("correct"))
        return overall_accuracy(hit).select(F.lit(k).alias("fold"), "accuracy")

    with ThreadPoolExecutor(parallel) as pool:
        frames = list(pool.map(one, range(folds)))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def cv_summary(fold_accuracy: DataFrame) -> DataFrame:
    return fold_accuracy.agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"))
