"""Labels of flow tables."""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.functions.columns import binary_label, nonfinite_to_null, normalize_label


def with_binary_label(df: DataFrame, label: str = "Label", name: str = "BinLabel") -> DataFrame:
    return df.withColumn(name, binary_label(F.col(label)))


def passthrough_label(df: DataFrame, name: str = "BinLabel") -> DataFrame:
    """NetFlow tables: keep ``BinLabel``, else take ``Label``, else rename ``Bin_Label``."""
    if name in df.columns:
        return df
    if "Label" in df.columns:
        return df.withColumn(name, F.col("Label"))
    if "Bin_Label" in df.columns:
        return df.withColumnRenamed("Bin_Label", name)
    return df


def quarantine_bad_labels(
    df: DataFrame, label: str, strict: bool = False, name: str = "BinLabel"
) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable 0/1-style label and, apart, the rows without one.

    ``strict`` makes the first frame fail at run time on the first bad label.
    """
    value = normalize_label(F.col(label)) if isinstance(df.schema[label].dataType, T.StringType) else nonfinite_to_null(
        F.col(label).cast("double")
    )
    read = df.withColumn("_label", value)
    if strict:
        shown = F.concat(F.lit("label is not finite: "), F.coalesce(F.col(label).cast("string"), F.lit("NULL")))
        checked = F.when(F.col("_label").isNull(), F.raise_error(shown).cast("int")).otherwise(F.col("_label").cast("int"))
        return read.withColumn(name, checked).drop("_label"), df.limit(0)
    good = read.filter(F.col("_label").isNotNull()).withColumn(name, F.col("_label").cast("int")).drop("_label")
    return good, read.filter(F.col("_label").isNull()).drop("_label")


def bad_label_report(bad: DataFrame, label: str, examples: int = 5) -> DataFrame:
    """Count of quarantined rows and a few of their label texts (the smallest, so runs agree)."""
    text = F.coalesce(F.col(label).cast("string"), F.lit("NULL"))
    seen = bad.groupBy(text.alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    shown = seen.orderBy("label").limit(examples)
    listed = shown.agg(F.array_sort(F.collect_list("label")).alias("l")).scalar()
    return seen.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("bad_rows")).withColumn("examples", listed)


def label_by_endpoints(df: DataFrame, pairs: DataFrame, name: str = "BinLabel") -> DataFrame:
    """1 where (src_ip, dst_ip) is one of many listed pairs.

    Spark picks a broadcast only if the pair table is measured small.
    """
    listed = pairs.select(F.col("src_ip").alias("_s"), F.col("dst_ip").alias("_d")).distinct().withColumn("_hit", F.lit(1))
    return (
        df.join(listed, (F.col("src_ip") == F.col("_s")) & (F.col("dst_ip") == F.col("_d")), "left")
        .withColumn(name, F.coalesce("_hit", F.lit(0)))
        .drop("_s", "_d", "_hit")
    )


def fit_label_encoder(df: DataFrame, label: str, name: str = "label_id") -> StringIndexerModel:
    """Label ids in alphabetical order; labels not seen in the fit get the id after the last."""
    return StringIndexer(
        inputCol=label, outputCol=name, stringOrderType="alphabetAsc", handleInvalid="keep"
    ).fit(df)


def encode_label(df: DataFrame, encoder: StringIndexerModel) -> DataFrame:
    return encoder.transform(df)


def decode_label(df: DataFrame, encoder: StringIndexerModel, id_column: str, name: str = "label_name") -> DataFrame:
    return IndexToString(inputCol=id_column, outputCol=name, labels=list(encoder.labels)).transform(df)


def one_hot_label(df: DataFrame, id_column: str, name: str = "label_vector") -> DataFrame:
    encoder = OneHotEncoder(inputCols=[id_column], outputCols=[name], dropLast=False)
    return encoder.fit(df).transform(df)


def filter_known_labels(df: DataFrame, known: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Pairs whose label and prediction are both known (filtered together, so they stay aligned)."""
    return df.filter(F.col(label).isin(*known) & F.col(prediction).isin(*known))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
