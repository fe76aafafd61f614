"""Statistics and metric series out of run logs (one row per line: path, line_no, text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowdrift.functions.columns import parse_stat_value
from flowdrift.operators.ordering import forward_fill

# Markers and key names of the run logs.
STAT_MARKER = "[==OVERALL SIM STATS==]"
STAT_PATTERN = r"\[==OVERALL SIM STATS==\]\s+(.*?):\s+(.*)"
SECTION_HEADERS = {
    "=== CE Model Calibration Summary ===": "CE Model",
    "=== Classifier Model Performance Summary ===": "Classifier Model",
}
CHUNK_STATS = ["Average Chunk Size", "Median Chunk Size", "Standard Deviation of Chunk Sizes"]
# Statistics of a report and which of their extremes is listed.
STAT_MODES = {
    "Total simulate time": "min",
    "Total Drift Detections": "both",
    "Drift Detection Rate": "both",
    "Average Chunks Between Drift Detections": "both",
    "[CE Model] Calibrations": "both",
    "[CE Model] Avg Accuracy": "max",
    "[CE Model] Avg Precision": "max",
    "[CE Model] Avg Recall": "max",
    "[CE Model] Avg F1 Score": "max",
    "[CE Model] Std Accuracy": "min",
    "[Classifier Model] Calibrations": "both",
    "[Classifier Model] Avg Accuracy": "max",
    "[Classifier Model] Avg Precision": "max",
    "[Classifier Model] Avg Recall": "max",
    "[Classifier Model] Avg F1 Score": "max",
    "[Classifier Model] Std Accuracy": "min",
    "Average Chunk Size": "all",
    "Median Chunk Size": "all",
    "Standard Deviation of Chunk Sizes": "all",
}
# Marker, blocks and metrics of the series lines.
SERIES_MARKER = r"(?i)INFO\s+__main__:\s+Full performance stats:\s+perf_stats\s*=\s*PerformanceStats\("
SERIES_BLOCKS = {"ce": "ce_stats", "classifier": "classifier_stats"}
SERIES_METRICS = ["accuracies", "precisions", "recalls", "f1s"]
VARIANT_PATTERN = r"(?i)\bmodelVariant\s*=\s*([A-Za-z0-9_\-]+)"
CE_TYPE_PATTERN = r"(?i)\bceType\s*=\s*([A-Za-z0-9_\-]+)"
# Classifier names and their spellings, in the order in which they are tried.
CLASSIFIER_NAMES = {
    "svm": ["svm", "svc"],
    "dt": ["dt", "decisiontree", "decision_tree", "decision-tree"],
    "rf": ["rf", "randomforest", "random_forest", "random-forest"],
    "xgb": ["xgb", "xgboost", "xgbclassifier"],
    "knn": ["knn", "k-nearest", "kneighbors", "k-nearest-neighbors", "k-nearest-neighbours"],
    "logreg": ["logreg", "logistic", "logisticregression", "lr"],
    "mlp": ["mlp", "mlpclassifier", "neural", "nn"],
    "sgd": ["sgd"],
    "nb": ["naive_bayes", "nb", "gaussian_nb", "gaussiannb"],
    "lgbm": ["lgbm", "lightgbm"],
    "ffn": ["ffn", "feedforward"],
}
# Evaluator names and their spellings, in the order in which they are tried.
CE_NAMES = {
    "approx-cce": ["approx-cce", "approxcce", "approx_cce"],
    "cce": ["cce"],
    "ice": ["ice"],
    "tce": ["tce"],
    "none": ["none", "noce", "no-ce", "no_ce", "baseline", "null"],
    "approx-tce": ["approx-tce", "approxtce", "approx_tce"],
}
# The order of evaluators in reports.
CE_ORDER = ["approx-cce", "cce", "ice", "tce", "none"]
PERCENT_ABOVE = 1.05


def extract_stats(lines: DataFrame) -> DataFrame:
    """Key/value lines, each key prefixed with the section it stands in (chunk statistics are not)."""
    section = F.lit(None).cast("string")
    for header, name in SECTION_HEADERS.items():
        section = F.when(F.contains(F.col("text"), F.lit(header)), F.lit(name)).otherwise(section)
    marked = lines.select("path", "line_no", "text", section.alias("_section")).filter(
        F.col("_section").isNotNull() | F.contains(F.col("text"), F.lit(STAT_MARKER))
    )
    placed = forward_fill(marked, "line_no", "_section", ["path"], "_in")
    key = F.trim(F.regexp_extract("text", STAT_PATTERN, 1))
    named = F.when(key.isin(*CHUNK_STATS) | F.col("_in").isNull(), key).otherwise(
        F.concat(F.lit("["), F.col("_in"), F.lit("] "), key)
    )
    value = F.trim(F.regexp_extract("text", STAT_PATTERN, 2))
    return placed.filter(F.col("_section").isNull() & F.col("text").rlike(STAT_PATTERN)).select(
        "path", "line_no", named.alias("stat"), value.alias("raw"), parse_stat_value(value).alias("value")
    )


def numeric_stats(stats: DataFrame) -> DataFrame:
    """Statistics whose value reads as a number."""
    return stats.filter(F.col("value").isNotNull())


def canonical_name(token: Column, names: dict[str, list[str]]) -> Column:
    """First name, in listing order, one of whose spellings occurs in the token."""
    lowered = F.lower(token)
    out = F.lit(None).cast("string")
    for name, spellings in reversed(names.items()):
        hit = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(s)) for s in spellings])
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def run_names(lines: DataFrame) -> DataFrame:
    """Classifier and evaluator of every file: from its settings line, else its path, else ``unknown``."""
    found = {}
    for column, pattern, names in (
        ("_classifier", VARIANT_PATTERN, CLASSIFIER_NAMES),
        ("_ce_type", CE_TYPE_PATTERN, CE_NAMES),
    ):
        found[column] = canonical_name(F.regexp_extract("text", pattern, 1), names)
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("line_no"))
    per_file = lines.withColumns(found).groupBy("path").agg(
        F.min_by("_classifier", at("_classifier")).alias("_classifier"),
        F.min_by("_ce_type", at("_ce_type")).alias("_ce_type"),
    )
    return per_file.select(
        "path",
        F.coalesce("_classifier", canonical_name(F.col("path"), CLASSIFIER_NAMES), F.lit("unknown")).alias("classifier"),
        F.coalesce("_ce_type", canonical_name(F.col("path"), CE_NAMES), F.lit("unknown")).alias("ce_type"),
    )


def extract_series(records: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Metric lists of report lines as rows (series, metric, step from 1, value).

    Blank, ``nan`` and unreadable entries are skipped before steps are counted.
    """
    keep = keep if keep is not None else [c for c in records.columns if c != text]
    # each step is exploded before the next one reads it, so no pattern runs twice on the same text
    inner = [
        F.struct(F.lit(series).alias("series"), F.regexp_extract(text, rf"(?s){block}\s*=\s*ModelStats\((.*?)\)", 1).alias("_inner"))
        for series, block in SERIES_BLOCKS.items()
    ]
    listed = [
        F.struct(F.lit(metric).alias("metric"), F.regexp_extract("_inner", rf"{metric}\s*=\s*\[([^\]]*)\]", 1).alias("_list"))
        for metric in SERIES_METRICS
    ]
    numbers = F.filter(
        F.transform(F.split("_list", ","), lambda t: F.when(~F.trim(t).rlike("(?i)^nan%*$"), F.regexp_replace(F.trim(t), "%+$", "").try_cast("double"))),
        lambda v: v.isNotNull(),
    )
    return (
        records.filter(F.contains(F.col(text), F.lit("PerformanceStats(")) & F.col(text).rlike(SERIES_MARKER))
        .select(*keep, F.inline(F.array(*inner)))
        .select(*keep, "series", F.inline(F.array(*listed)))
        .filter(F.length("_list") > 0)
        .select(*keep, "series", "metric", F.posexplode(numbers).alias("_at", "value"))
        .select(*keep, "series", "metric", (F.col("_at") + 1).cast("bigint").alias("step"), "value")
    )


def rescale_percent(series: DataFrame, by: tuple[str, ...] = ("classifier", "metric")) -> DataFrame:
    """Values of a metric whose maximum exceeds 1.05 are percentages: divided by 100, per classifier.

    There may be as many maxima as classifiers, and their size is underestimated before the
    lists are unfolded, so they are shuffled to the rows and never broadcast.
    """
    tops = series.groupBy(*[F.col(c).alias(f"_t_{c}") for c in by]).agg(F.max("value").alias("_top"))
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in by])
    value = F.when(F.col("_top") > PERCENT_ABOVE, F.col("value") / 100).otherwise(F.col("value"))
    return series.join(tops.hint("merge"), match).select(*[c for c in series.columns if c != "value"], value.alias("value"))


def last_series(lines: DataFrame) -> DataFrame:
    """Metric series of each file's last report line."""
    from flowdrift.operators.ordering import last_record_per_file

    reports = lines.filter(F.col("text").rlike(SERIES_MARKER)).select("path", "line_no", "text")
    return extract_series(last_record_per_file(reports), ["path"])


def runs_by_group(lines: DataFrame, ce_types: list[str] | None = None) -> DataFrame:
    """Long metric table (classifier, series, run, ce_type, metric, step, value) of the listed evaluators."""
    series = last_series(lines).join(run_names(lines), "path")
    listed = series.filter(F.col("ce_type").isin(*(ce_types or CE_ORDER)))
    return listed.select("classifier", "series", F.col("path").alias("run"), "ce_type", "metric", "step", "value")
