"""Joins of windows, sessions and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowdrift.operators.ordering import with_range_bucket
from flowdrift.schema import FIVE_TUPLE
from flowdrift.session import materialize


def asof_match(
    left: DataFrame, left_time: str, right: DataFrame, right_time: str, buckets: int | None = None
) -> DataFrame:
    """For each distinct left time the latest right time at or before it.

    Works on distinct times only: whatever share of the rows one instant holds,
    it is a single row here. Ranges of times are scanned independently and the
    newest right time of the earlier ranges (one row per range) is carried in.
    Both time columns are integers (microseconds).
    """
    both = left.select(F.col(left_time).alias("_t"), F.lit(False).alias("_r")).unionByName(
        right.select(F.col(right_time).alias("_t"), F.lit(True).alias("_r"))
    )
    times = materialize(
        both.filter(F.col("_t").isNotNull())
        .groupBy("_t")
        .agg(F.max(F.when(F.col("_r"), F.col("_t"))).alias("_right"), F.bool_or(~F.col("_r")).alias("_is_left"))
        .withColumn("_order", F.col("_t").cast("double"))
    )
    parts = with_range_bucket(times, "_order", buckets=buckets)
    # one row per range of times
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        parts.groupBy("_bucket")
        .agg(F.max("_right").alias("_m"))
        .select(F.col("_bucket").alias("_k"), F.max("_m").over(earlier).alias("_carry"))
    )
    inside = Window.partitionBy("_bucket").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.withColumn("_local", F.max("_right").over(inside))
        .filter("_is_left")
        .join(carried, F.col("_bucket") == F.col("_k"), "left")
        .select(F.col("_t").alias("_left_time"), F.coalesce("_local", "_carry").alias("_right_time"))
    )


def asof_join_backward(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    tie_break: list[str],
    suffixes: tuple[str, str] = ("_x", "_y"),
    buckets: int | None = None,
) -> DataFrame:
    """Left outer as-of join without a key: the latest right row with ``right_on <= left_on``.

    Of several right rows at that time the last by ``tie_break`` wins. Columns on
    both sides get the suffixes, except a shared ``on`` column, which stays the left one.
    """
    lt, rt = F.unix_micros(F.col(left_on)), F.unix_micros(F.col(right_on))
    lhs = left.withColumn("_lt", lt)
    newest = (
        right.withColumn("_rt", rt)
        .filter(F.col("_rt").isNotNull())
        .groupBy("_rt")
        .agg(F.max_by(F.struct(*right.columns), F.struct(*tie_break)).alias("_row"))
    )
    match = asof_match(lhs.select("_lt"), "_lt", right.select(rt.alias("_rt")), "_rt", buckets)
    shared = (set(left.columns) & set(right.columns)) - ({left_on} & {right_on})
    dropped = {left_on} & {right_on}
    out = [F.col(c).alias(c + suffixes[0]) if c in shared else F.col(c) for c in left.columns]
    out += [
        F.col("_row").getField(c).alias(c + suffixes[1] if c in shared else c)
        for c in right.columns
        if c not in dropped
    ]
    picked = match.join(newest, F.col("_right_time") == F.col("_rt")).select("_left_time", "_row")
    joined = lhs.join(picked, F.col("_lt") == F.col("_left_time"), "left")
    return joined.select(*out)


def window_session_join(
    windows: DataFrame, sessions: DataFrame, keys: list[str] | None = None, suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Left join of windows to sessions on the 5-tuple; other shared columns get the suffixes."""
    keys = keys or FIVE_TUPLE
    shared = (set(windows.columns) & set(sessions.columns)) - set(keys)
    lhs = windows.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    rhs = sessions.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return lhs.join(rhs, keys, "left")


def distinct_label_map(flows: DataFrame, labels: list[str], keys: list[str] | None = None) -> DataFrame:
    """Distinct (5-tuple, label columns)."""
    return flows.select(*(keys or FIVE_TUPLE), *labels).distinct()


def label_join(df: DataFrame, label_map: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Left join to the label map; NULL keys match NULL keys, several labels fan rows out."""
    keys = keys or FIVE_TUPLE
    rhs = label_map.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(rhs, match, "left").drop(*[f"_r_{k}" for k in keys])
