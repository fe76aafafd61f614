"""Conformal scores, p-values, thresholds and the drift test."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.operators.ordering import group_quantile, running_sums
from flowdrift.session import materialize


def _probabilities(probability: str | Column) -> Column:
    return vector_to_array(F.col(probability)) if isinstance(probability, str) else probability


def nonconformity(probability: str | Column, label: str) -> Column:
    """1 - P(true class). ``probability`` is a vector column name or an array column."""
    return F.lit(1.0) - F.get(_probabilities(probability), F.col(label).cast("int"))


def nonconformity_pred(probability: str | Column, prediction: str = "prediction") -> Column:
    """1 - P(predicted class), for rows whose class is not known."""
    return F.lit(1.0) - F.get(_probabilities(probability), F.col(prediction).cast("int"))


def class_thresholds(
    calibration: DataFrame, significance: float, cls: str = "class", score: str = "score", counted: str | None = None
) -> DataFrame:
    """Per class the interpolated score quantile at ``1 - significance``.

    Pass ``counted="n"`` with the table of :func:`calibration_counts`.
    """
    return group_quantile(calibration, [cls], score, 1.0 - significance, name="threshold", counted=counted)


def _usable(cls: str | Column, score: str | Column) -> Column:
    cls, score = (F.col(c) if isinstance(c, str) else c for c in (cls, score))
    return cls.isNotNull() & score.isNotNull() & ~F.isnan(score.cast("double"))


def calibration_counts(calibration: DataFrame, cls: str = "class", score: str = "score") -> DataFrame:
    """Calibration scores as (class, score, n): equal scores share a row. Written once, read often.

    Rows with a NULL class, a NULL score or NaN calibrate nothing and are left out.
    """
    return materialize(
        calibration.filter(_usable(cls, score))
        .groupBy(F.col(cls).alias("class"), F.col(score).alias("score"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def p_values(test: DataFrame, counts: DataFrame, cls: str = "class", score: str = "score", name: str = "p_value") -> DataFrame:
    """``(calibration scores of the class >= score, plus 1) / (calibration rows of the class, plus 1)``.

    ``counts`` comes from :func:`calibration_counts`. Different scores of both sides
    are run up over score ranges and joined to the test rows, whatever the sizes are;
    Spark chooses how. A test row gets NULL if its class has no calibration rows or
    is NULL, or if its score is NULL or NaN.
    """
    known = counts.filter(_usable("class", "score")).select("class", "score", "n")
    wanted = test.filter(_usable(cls, score)).select(
        F.col(cls).alias("class"), F.col(score).alias("score"), F.lit(0).cast("bigint").alias("n")
    )
    both = materialize(known.unionByName(wanted).groupBy("class", "score").agg(F.sum("n").alias("n")))
    ranked = running_sums(both, ["class"], "score", {"above": F.col("n")}, descending=True)
    sizes = known.groupBy(F.col("class").alias("_class")).agg(F.sum("n").alias("size"))
    table = ranked.join(sizes, F.col("class") == F.col("_class")).select(
        F.col("class").alias("_c"), F.col("score").alias("_s"), ((F.col("above") + 1) / (F.col("size") + 1)).alias(name)
    )
    return test.join(table, (F.col(cls) == F.col("_c")) & (F.col(score) == F.col("_s")), "left").drop("_c", "_s")


def vote(predictions: Column) -> Column:
    """Most frequent class of an array, the smallest one on a tie. Stays inside the row: no shuffle."""
    tallies = F.transform(
        F.array_distinct(predictions),
        lambda c: F.struct(F.size(F.filter(predictions, lambda p: p == c)).alias("votes"), (-c).alias("neg")),
    )
    return -F.array_max(tallies).getField("neg")


def combine_folds(df: DataFrame, predictions: list[str], scores: list[str]) -> DataFrame:
    """Cross-conformal combination of one prediction and one score column per fold model.

    Adds the majority ``class`` (the smallest on a tie) and the mean ``score``, as plain row expressions.
    """
    mean = sum(F.col(s) for s in scores) / len(scores)
    # as an array: comparing all columns pairwise makes code that costs more than the models
    return df.withColumn("class", vote(F.array(*predictions))).withColumn("score", mean)


def combine_folds_long(df: DataFrame, row: list[str], prediction: str = "prediction", score: str = "score") -> DataFrame:
    """As :func:`combine_folds` for one row per (row, model)."""
    votes = df.groupBy(*row, F.col(prediction).alias("class")).agg(
        F.count(F.lit(1)).alias("_votes"), F.sum(score).alias("_sum"), F.count(score).alias("_n")
    )
    best = F.max(F.struct(F.col("_votes"), (-F.col("class")).alias("_neg")))
    return votes.groupBy(*row).agg(
        (-best.getField("_neg")).alias("class"), (F.sum("_sum") / F.sum("_n")).alias("score")
    )


def drift_flags(
    scored: DataFrame,
    thresholds: DataFrame,
    rule: str = "score_quantile",
    significance: float = 0.05,
    cls: str = "class",
    p_value: str = "p_value",
) -> DataFrame:
    """Per-row drift flag: p-value below the class threshold, or below ``significance`` with rule ``epsilon``.

    A class without a threshold is never flagged.
    """
    if rule == "epsilon":
        return scored.withColumn("drift", F.coalesce(F.col(p_value) < significance, F.lit(False)))
    if rule != "score_quantile":
        raise ValueError(f"unknown rule: {rule}")
    limits = thresholds.select(F.col("class").alias("_class"), F.col("threshold").alias("_limit"))
    return (
        scored.join(limits, F.col(cls) == F.col("_class"), "left")
        .withColumn("drift", F.coalesce(F.col(p_value) < F.col("_limit"), F.lit(False)))
        .drop("_class", "_limit")
    )


def detect_drift(
    flagged: DataFrame, chunk: list[str], order: str, mode: str = "first", rate: float = 0.0
) -> DataFrame:
    """One row per chunk with its drift decision: from the first row, any row, or the share of flagged rows."""
    decisions = {
        "first": F.min_by("drift", order),
        "any": F.bool_or("drift"),
        "rate": F.avg(F.col("drift").cast("double")) > rate,
    }
    if mode not in decisions:
        raise ValueError(f"unknown mode: {mode}")
    return flagged.groupBy(*chunk).agg(F.count(F.lit(1)).alias("rows"), decisions[mode].alias("drift"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
