"""Hopping-window features on a stream."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdrift.functions.columns import parse_duration_us
from flowdrift.operators.features import (
    SRC,
    WINDOW_FEATURES,
    WINDOW_MAXS,
    WINDOW_MEANS,
    WINDOW_MINS,
    WINDOW_SUMS,
    address_entropies,
    sides,
    window_rates,
)


def stream_hopping_features(
    flows: DataFrame,
    size: str = "5s",
    step: str = "1s",
    ts: str = "timestamp",
    watermark: str = "10 seconds",
    anchor_us: int = 0,
) -> DataFrame:
    """Window features in append mode: a window is emitted once the watermark has passed its end.

    Windows start at ``anchor_us`` plus multiples of the step (a stream has no
    earliest row). Three aggregations follow each other: flows per pane (a stretch
    that no window cuts) and address, panes per window and address, and the window
    itself. Only closed panes are copied into their windows, so the state of the flows
    holds one row per open pane and address, whatever size / step is.
    """
    size_us, step_us = parse_duration_us(size), parse_duration_us(step)
    pane_us, start = gcd(size_us, step_us), f"{anchor_us % step_us} microseconds"
    pane = F.window(F.col(ts), f"{pane_us} microseconds", f"{pane_us} microseconds", f"{anchor_us % pane_us} microseconds")
    features = [*WINDOW_SUMS.values(), *WINDOW_MEANS.values(), *WINDOW_MINS.values(), *WINDOW_MAXS.values()]
    sided = flows.withWatermark(ts, watermark).select(ts, *features, sides().alias("_side"))
    is_src = F.col("_side.kind") == SRC
    sided = sided.select(
        ts, F.col("_side.kind").alias("_kind"), F.col("_side.ip").alias("_ip"),
        *[F.when(is_src, F.col(c)).alias(c) for c in features],
    )
    parts = {
        "_n": (F.count(F.lit(1)), F.sum),
        "_first": (F.min(F.unix_micros(F.col(ts))), F.min),
        "_last": (F.max(F.unix_micros(F.col(ts))), F.max),
        **{f"_s_{c}": (F.sum(c), F.sum) for c in dict.fromkeys([*WINDOW_SUMS.values(), *WINDOW_MEANS.values()])},
        **{f"_c_{c}": (F.count(c), F.sum) for c in WINDOW_MEANS.values()},
        **{f"_l_{c}": (F.min(c), F.min) for c in WINDOW_MINS.values()},
        **{f"_h_{c}": (F.max(c), F.max) for c in WINDOW_MAXS.values()},
    }
    in_pane = sided.groupBy(pane.alias("_pane"), "_kind", "_ip").agg(*[first.alias(c) for c, (first, _) in parts.items()])
    window = F.window(F.window_time("_pane"), f"{size_us} microseconds", f"{step_us} microseconds", start)
    per_ip = in_pane.groupBy(window.alias("_w"), "_kind", "_ip").agg(*[again(c).alias(c) for c, (_, again) in parts.items()])
    src = F.col("_kind") == SRC
    merged = per_ip.groupBy("_w").agg(
        F.sum(F.when(src, F.col("_n"))).alias("packet_count_window"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        *[F.coalesce(F.sum(f"_s_{c}"), F.lit(0)).alias(name) for name, c in WINDOW_SUMS.items()],
        *[(F.sum(f"_s_{c}") / F.sum(F.when(src, F.col(f"_c_{c}")))).alias(name) for name, c in WINDOW_MEANS.items()],
        *[F.min(f"_l_{c}").alias(name) for name, c in WINDOW_MINS.items()],
        *[F.max(f"_h_{c}").alias(name) for name, c in WINDOW_MAXS.items()],
        *address_entropies(F.when(F.col("_ip").isNotNull(), F.col("_n"))),
    )
    return merged.withColumns(window_rates()).select(
        F.col("_w.start").alias("start_time"), F.col("_w.end").alias("end_time"), *WINDOW_FEATURES
    )
