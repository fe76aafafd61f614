"""Reproducible splits and folds: rows are ordered by a hash of their id, never by chance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowdrift.session import materialize


def _hashed(df: DataFrame, row_id: str, hex_digits: int) -> DataFrame:
    """Hash of the row id and its leading digits; rows without an id come first."""
    lead = F.coalesce(F.substring("_hash", 1, hex_digits), F.lit(""))
    return df.withColumn("_hash", F.md5(F.col(row_id).cast("string"))).withColumn("_lead", lead)


def _lead_counts(keyed: DataFrame, by: list[str]) -> DataFrame:
    """Per group and leading hash digits: rows, rows before them and rows of the group."""
    before = Window.partitionBy(*by).orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    return (
        keyed.groupBy(*by, "_lead")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(c).alias(f"_k_{c}") for c in [*by, "_lead"]],
            "_n",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(group).alias("_of"),
        )
    )


def hash_positions(
    df: DataFrame, row_id: str, by: list[str] | None = None, name: str = "position", hex_digits: int = 4
) -> DataFrame:
    """1-based position of each row in the hash order of its ``by`` group, and the group size.

    The leading hash digits cut every group into evenly filled parts (a hash is
    uniform), so a class of any size is ranked in parallel without sampling.
    """
    by = by or []
    keyed = _hashed(df, row_id, hex_digits)
    leads = _lead_counts(keyed, by).drop("_n").withColumnRenamed("_of", f"{name}_of")
    inside = Window.partitionBy(*by, "_lead").orderBy("_hash", row_id)
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_lead"]])
    return (
        keyed.withColumn("_at", F.row_number().over(inside))
        .join(leads, match)
        .select(*df.columns, (F.col("_at") + F.col("_before")).alias(name), f"{name}_of")
    )


def split(
    df: DataFrame, row_id: str, train: float = 0.8, label: str | None = None, name: str = "is_train", hex_digits: int = 4
) -> DataFrame:
    """Mark the first ``train`` share of the rows in hash order, within each class if ``label`` is given.

    Counts per leading hash digits tell which digits hold the cut of a group. Rows with other digits are
    marked where they lie; only those with the digits of a cut are ranked, so the rows are not shuffled.
    """
    by = [label] if label else []
    kept = [c for c in df.columns if c != name]
    keyed = _hashed(df, row_id, hex_digits)
    wanted = F.floor(F.col("_of") * train + 0.5) - F.col("_before")
    counts = _lead_counts(keyed, by).withColumn("_wanted", wanted).filter((F.col("_wanted") > 0) & (F.col("_wanted") <= F.col("_n")))
    # stored: its size is known to be one row per class when the join is planned
    cuts = materialize(counts.select(*[f"_k_{c}" for c in by], F.col("_k__lead").alias("_cut"), "_wanted"))
    if by:
        found = keyed.join(cuts, F.col(label).eqNullSafe(F.col(f"_k_{label}")), "left")
    else:
        cut = cuts.select(F.struct("_cut", "_wanted")).scalar()
        found = keyed.withColumns({"_cut": cut.getField("_cut"), "_wanted": cut.getField("_wanted")})
    at_cut = F.coalesce(F.col("_lead") == F.col("_cut"), F.lit(False))
    clear = found.filter(~at_cut).select(*kept, F.coalesce(F.col("_lead") < F.col("_cut"), F.lit(False)).alias(name))
    inside = Window.partitionBy(*by, "_lead").orderBy("_hash", row_id)
    ranked = found.filter(at_cut).withColumn("_at", F.row_number().over(inside))
    return clear.unionByName(ranked.select(*kept, (F.col("_at") <= F.col("_wanted")).alias(name)))


def stratified_folds(df: DataFrame, row_id: str, label: str, folds: int, name: str = "fold") -> DataFrame:
    """Fold id 0..folds-1; per class the fold sizes differ by at most one."""
    placed = hash_positions(df, row_id, [label], "_pos")
    return placed.withColumn(name, ((F.col("_pos") - 1) % folds).cast("int")).drop("_pos", "_pos_of")
