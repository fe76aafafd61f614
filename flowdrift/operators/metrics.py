"""Evaluation metrics. Everything is derived from one count per (actual, predicted) pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowdrift.operators.ordering import drift_intervals, group_quantile


def _safe(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(0.0))


def pair_counts(df: DataFrame, actual: str = "label", predicted: str = "prediction", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(
    df: DataFrame, actual: str = "label", predicted: str = "prediction", labels: list | None = None
) -> DataFrame:
    """Counts for every pair of labels, zero where a pair does not occur.

    Without ``labels`` the label set is the one seen on either side.
    """
    counts = pair_counts(df, actual, predicted)
    if labels is not None:
        known = F.array(*[F.lit(x) for x in labels])
        counts = counts.filter(F.col("actual").isin(*labels) & F.col("predicted").isin(*labels))
        grid = df.sparkSession.range(1).select(known.alias("l"))
    else:
        seen = counts.select(F.explode(F.array("actual", "predicted")).alias("x")).filter("x IS NOT NULL")
        grid = seen.agg(F.collect_set("x").alias("l"))
    grid = grid.select(F.explode("l").alias("_a"), "l").select("_a", F.explode("l").alias("_p"))
    return grid.join(counts, (F.col("_a") == F.col("actual")) & (F.col("_p") == F.col("predicted")), "left").select(
        F.col("_a").alias("actual"), F.col("_p").alias("predicted"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def _binary_counts(positive: Column, actual: str, predicted: str) -> dict[str, Column]:
    is_pos, said_pos = F.col(actual) == positive, F.col(predicted) == positive
    both = lambda c: F.count(F.when(c, 1))
    return {
        "tp": both(is_pos & said_pos),
        "fp": both(~is_pos & said_pos),
        "fn": both(is_pos & ~said_pos),
        "tn": both(~is_pos & ~said_pos),
    }


def binary_metrics(
    df: DataFrame,
    actual: str = "label",
    predicted: str = "prediction",
    positive: object = 1,
    by: list[str] | None = None,
) -> DataFrame:
    """Accuracy, precision, recall, F1 and specificity in one pass; a zero division gives 0."""
    counts = _binary_counts(F.lit(positive), actual, predicted)
    table = df.groupBy(*(by or [])).agg(*[c.alias(k) for k, c in counts.items()])
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return table.withColumns(
        {
            "accuracy": _safe(tp + tn, tp + fp + fn + tn),
            "precision": _safe(tp, tp + fp),
            "recall": _safe(tp, tp + fn),
            "f1": _safe(2 * tp, 2 * tp + fp + fn),
            "specificity": _safe(tn, tn + fp),
        }
    )


def specificity(df: DataFrame, actual: str = "label", predicted: str = "prediction", positive: object = 1) -> DataFrame:
    return binary_metrics(df, actual, predicted, positive).select("tn", "fp", "specificity")


def classification_report(
    df: DataFrame, actual: str = "label", predicted: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as label or prediction."""
    by = by or []
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said"), hit.alias("hits")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hits")),
    )
    per_class = (
        pair_counts(df, actual, predicted, by)
        .select(*by, F.inline(sides))
        .filter("class IS NOT NULL")
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "said", "hits")])
    )
    hits, said, support = F.col("hits"), F.col("said"), F.col("support")
    return per_class.select(
        *by,
        "class",
        _safe(hits, said).alias("precision"),
        _safe(hits, support).alias("recall"),
        _safe(2 * hits, said + support).alias("f1"),
        "support",
    )


def averaged_metrics(
    df: DataFrame, average: str, actual: str = "label", predicted: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """Macro or support-weighted precision, recall and F1, with the accuracy."""
    by = by or []
    report = classification_report(df, actual, predicted, by)
    rows = F.sum("support")
    if average == "macro":
        agg = {m: F.avg(m) for m in ("precision", "recall", "f1")}
    elif average == "weighted":
        agg = {m: F.sum(F.col(m) * F.col("support")) / rows for m in ("precision", "recall", "f1")}
    else:
        raise ValueError(f"unknown average: {average}")
    accuracy = F.sum(F.col("recall") * F.col("support")) / rows
    return report.groupBy(*by).agg(accuracy.alias("accuracy"), *[c.alias(m) for m, c in agg.items()])


def model_metrics(
    df: DataFrame, n_classes: int, actual: str = "label", predicted: str = "prediction", positive: object = 1
) -> DataFrame:
    """Binary metrics for two classes, weighted averages otherwise."""
    if n_classes == 2:
        return binary_metrics(df, actual, predicted, positive).select("accuracy", "precision", "recall", "f1")
    return averaged_metrics(df, "weighted", actual, predicted)


def run_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Calibration count, mean of the four metrics and population deviation of the accuracy."""
    return runs.groupBy(*by).agg(
        F.count("accuracy").alias("calibrations"),
        F.avg("accuracy").alias("avg_accuracy"),
        F.avg("precision").alias("avg_precision"),
        F.avg("recall").alias("avg_recall"),
        F.avg("f1").alias("avg_f1"),
        F.stddev_pop("accuracy").alias("std_accuracy"),
    )


def timing_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, exact median, sample deviation, minimum and maximum."""
    by = by or []
    stats = df.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    median = group_quantile(df, by, value, 0.5, name="median")
    if not by:
        return stats.withColumn("median", median.scalar())
    median = median.withColumnsRenamed({b: f"_m_{b}" for b in by})
    match = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_m_{b}")) for b in by])
    return stats.join(median, match, "left").drop(*[f"_m_{b}" for b in by])


def overall_accuracy(df: DataFrame, correct: str = "correct") -> DataFrame:
    return df.agg(F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count(correct).alias("rows"))


def drift_summary(chunks: DataFrame, rows: str = "rows", chunk: str = "chunk_id", drift: str = "drift") -> DataFrame:
    """Drift count, rate per scored row and per chunk, and mean interval between drifts.

    ``chunks`` has one row per chunk with its row count and drift flag.
    """
    intervals = drift_intervals(chunks, chunk, drift).agg(F.avg("drift_interval").alias("mean_interval"))
    flagged = F.count(F.when(F.col(drift), 1))
    return chunks.agg(
        flagged.alias("drifts"),
        F.sum(rows).alias("scored_rows"),
        (flagged / F.sum(rows)).alias("drift_rate"),
        (flagged / F.count(F.lit(1))).alias("drift_rate_per_chunk"),
    ).withColumn("mean_interval", intervals.scalar())


def drift_interval_histogram(chunks: DataFrame, chunk: str = "chunk_id", drift: str = "drift") -> DataFrame:
    return (
        drift_intervals(chunks, chunk, drift)
        .filter("drift_interval IS NOT NULL")
        .groupBy("drift_interval")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def latency_summary(progress: DataFrame, by: list[str] | None = None, latency: str = "latency_s") -> DataFrame:
    """Mean and total latency over recorded micro-batches or chunks."""
    return progress.groupBy(*(by or [])).agg(
        F.count(latency).alias("chunks"), F.avg(latency).alias("mean_latency_s"), F.sum(latency).alias("total_latency_s")
    )
