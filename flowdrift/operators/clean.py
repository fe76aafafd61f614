"""Cleaning and projection of flow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.functions.columns import epoch_ms_to_ts, nonfinite_to_null, parse_flow_ts, ratio_or_zero
from flowdrift.operators.ordering import group_quantile
from flowdrift.schema import ID_AND_LABEL_COLUMNS, NETFLOW_RENAMES, REQUIRED_KEYS


def drop_index_column(df: DataFrame) -> DataFrame:
    """Drop the unnamed index columns a CSV export leaves behind."""
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed")])


def normalize_netflow(df: DataFrame) -> DataFrame:
    """NetFlow names, times and duration to flow names and units.

    A frame that lacks one of the required columns is returned unchanged.
    """
    if not set(NETFLOW_RENAMES) <= set(df.columns):
        return df
    out = []
    for name in df.columns:
        new = NETFLOW_RENAMES.get(name, name)
        c = F.col(f"`{name}`")
        if new in ("start_time", "end_time"):
            c = epoch_ms_to_ts(c)
        elif new == "flow_duration":
            c = c * 1000
        out.append(c.alias(new))
    return df.select(*out)


def derive_flow_features(df: DataFrame) -> DataFrame:
    """Guarded packet-length, inter-arrival and direction ratios of a flow."""
    fwd, bwd = F.col("tot_fwd_pkts"), F.col("tot_bwd_pkts")
    fwd_bytes, bwd_bytes = F.col("totlen_fwd_pkts"), F.col("totlen_bwd_pkts")
    total = fwd + bwd
    derived = {
        "fwd_pkt_len_mean": ratio_or_zero(fwd != 0, fwd_bytes, fwd),
        "bwd_pkt_len_mean": ratio_or_zero(bwd != 0, bwd_bytes, bwd),
        "pkt_len_mean": ratio_or_zero(total != 0, fwd_bytes + bwd_bytes, total),
        "flow_iat_mean": ratio_or_zero(total > 1, F.col("flow_duration"), total - 1),
        "down_up_ratio": ratio_or_zero(fwd > 0, bwd, fwd),
    }
    if "fwd_iat_mean" in df.columns:
        derived["fwd_iat_tot"] = F.col("fwd_iat_mean") * (fwd - 1)
    if "bwd_iat_mean" in df.columns:
        derived["bwd_iat_tot"] = F.col("bwd_iat_mean") * (bwd - 1)
    return df.withColumns(derived)


def drop_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in every floating column."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nonfinite_to_null(F.col(f"`{c}`")) for c in floating}) if floating else df


def require_keys(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows whose 5-tuple and duration are all present."""
    return df.dropna(subset=[k for k in (keys or REQUIRED_KEYS)])


def clean_flows(df: DataFrame, netflow: bool = False) -> DataFrame:
    """Cleaning of one batch, chunk or stream of flows; a flow-meter timestamp in text form becomes a timestamp."""
    if not netflow:
        if dict(df.dtypes).get("timestamp") == "string":
            text = F.col("timestamp")
            df = df.withColumn("timestamp", F.coalesce(parse_flow_ts(text), F.try_to_timestamp(text)))
        return drop_nonfinite(drop_index_column(df))
    if not set(NETFLOW_RENAMES) <= set(df.columns):
        return df
    return require_keys(drop_nonfinite(derive_flow_features(normalize_netflow(df))))


def drop_if_present(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    present = set(df.columns)
    return df.drop(*[c for c in (columns or ID_AND_LABEL_COLUMNS) if c in present])


def numeric_features(df: DataFrame, drop: list[str] | None = None) -> list[str]:
    """Names of the numeric columns left once ids and labels are dropped."""
    gone = set(drop or ID_AND_LABEL_COLUMNS)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in gone]


def reindex_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema`` in its order: missing as NULL, extras dropped."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def fill_mean(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """NULLs to the column mean of the whole table or of the row's group.

    Means come from one partial aggregation joined back, so a group that holds
    most rows is never sorted or gathered in one task. Whole-table means are a
    one-row scalar subquery per column.
    """
    if not by:
        means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m")).scalar()
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), means.getField(c)) for c in columns})
    means = df.groupBy(*[F.col(b).alias(f"_by_{b}") for b in by]).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    match = F.lit(True)
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return df.join(means, match, "left").select(
        *[
            (F.coalesce(F.col(c).cast("double"), F.col(f"_mean_{c}")).alias(c) if c in columns else F.col(c))
            for c in df.columns
        ]
    )


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs and non-finite values to the exact column median.

    The columns are unpivoted once, so every median comes out of one distributed
    rank computation (:func:`group_quantile`).
    """
    clean = df.withColumns({c: nonfinite_to_null(F.col(c).cast("double")) for c in columns})
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in columns]))
    long = clean.select(pairs.alias("p")).select("p.column", "p.x")
    medians = group_quantile(long, ["column"], "x", 0.5, name="median")
    as_map = medians.agg(F.map_from_entries(F.collect_list(F.struct("column", "median"))).alias("m")).scalar()
    return clean.withColumns({c: F.coalesce(F.col(c), F.element_at(as_map, F.lit(c))) for c in columns})


def null_inf_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: how many values are null (NaN included) and how many infinite."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = columns or df.columns
    counts = []
    for c in columns:
        col = F.col(f"`{c}`")
        floating = isinstance(kinds[c], (T.DoubleType, T.FloatType))
        null = (col.isNull() | F.isnan(col)) if floating else col.isNull()
        inf = (F.abs(col) == F.lit(float("inf"))) if floating else F.lit(False)
        counts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.when(null, 1)).alias("nulls"),
                F.count(F.when(inf, 1)).alias("infinities"),
            )
        )
    return df.agg(F.array(*counts).alias("p")).select(F.inline("p"))


def flag_empty_rows(df: DataFrame, columns: list[str] | None = None, name: str = "is_empty") -> DataFrame:
    """Mark rows whose columns are all null."""
    texts = [F.col(f"`{c}`").cast("string") for c in (columns or df.columns)]
    return df.withColumn(name, F.coalesce(*texts).isNull())


def row_to_json(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Misclassified rows as JSON text."""
    return df.filter(~F.col(label).eqNullSafe(F.col(prediction))).select(
        F.col(label), F.col(prediction), F.to_json(F.struct("*")).alias("row_json")
    )


