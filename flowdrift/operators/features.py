"""Session and hopping-window features."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowdrift.functions.columns import parse_duration_us
from flowdrift.schema import FIVE_TUPLE

# Session output column -> flow column, by aggregate.
SESSION_CORE_SUMS = {
    "flow_duration": "flow_duration",
    "total_forward_packets": "tot_fwd_pkts",
    "total_backward_packets": "tot_bwd_pkts",
    "total_bytes_forward": "totlen_fwd_pkts",
    "total_bytes_backward": "totlen_bwd_pkts",
}
SESSION_CORE_MEANS = {
    "mean_packet_length_forward": "fwd_pkt_len_mean",
    "mean_packet_length_backward": "bwd_pkt_len_mean",
    "packet_size_mean": "pkt_len_mean",
    "flow_iat_mean": "flow_iat_mean",
    "down_up_ratio": "down_up_ratio",
}
SUBFLOW_SUMS = ["subflow_fwd_pkts", "subflow_bwd_pkts", "subflow_fwd_byts", "subflow_bwd_byts"]
DIRECTIONS = ["fwd", "bwd"]


def _sum0(c: str) -> Column:
    """Sum that is 0 for a group without values."""
    return F.coalesce(F.sum(c), F.lit(0))


def session_features(
    flows: DataFrame, source: str = "flowmeter", start: str = "timestamp", end: str = "timestamp", wide: bool = False
) -> DataFrame:
    """One row per 5-tuple. Every aggregate merges map-side, so a hot 5-tuple shuffles one row per task.

    ``source`` is ``flowmeter`` or ``netflow``; ``wide`` adds the directional means to the first.
    """
    aggs = [_sum0(c).alias(name) for name, c in SESSION_CORE_SUMS.items()]
    aggs += [F.avg(c).alias(name) for name, c in SESSION_CORE_MEANS.items()]
    if source == "flowmeter":
        aggs += [_sum0(c).alias(c) for c in SUBFLOW_SUMS]
    for d in DIRECTIONS:
        if source == "flowmeter":
            aggs += [
                F.max(f"{d}_pkt_len_max").alias(f"{d}_pkt_len_max"),
                F.min(f"{d}_pkt_len_min").alias(f"{d}_pkt_len_min"),
                F.stddev_samp(f"{d}_pkt_len_std").alias(f"{d}_pkt_len_std"),
                F.avg(f"{d}_blk_rate_avg").alias(f"{d}_blk_rate_avg"),
            ]
            if wide:
                aggs.append(F.avg(f"{d}_pkt_len_mean").alias(f"{d}_pkt_len_mean"))
        if source == "netflow" or wide:
            aggs.append(F.avg(f"{d}_iat_mean").alias(f"{d}_iat_mean"))
        aggs += [
            F.max(f"{d}_iat_max").alias(f"{d}_iat_max"),
            F.min(f"{d}_iat_min").alias(f"{d}_iat_min"),
            _sum0(f"{d}_iat_tot").alias(f"{d}_iat_tot"),
        ]
    aggs += [F.min(start).alias("start_time"), F.max(end).alias("end_time")]
    return (
        flows.dropna(subset=FIVE_TUPLE)
        .groupBy(*FIVE_TUPLE)
        .agg(*aggs)
        .withColumn("total_packets", F.col("total_forward_packets") + F.col("total_backward_packets"))
        .withColumn("total_bytes", F.col("total_bytes_forward") + F.col("total_bytes_backward"))
    )


# Window output column -> flow column, by aggregate.
WINDOW_SUMS = {
    "total_forward_packets_window": "tot_fwd_pkts",
    "total_backward_packets_window": "tot_bwd_pkts",
    "total_forward_bytes_window": "totlen_fwd_pkts",
    "total_backward_bytes_window": "totlen_bwd_pkts",
    "flow_duration_window": "flow_duration",
}
WINDOW_MEANS = {
    "average_packet_size_fwd_window": "fwd_pkt_len_mean",
    "average_packet_size_bwd_window": "bwd_pkt_len_mean",
    "mean_iat_fwd_window": "fwd_iat_mean",
    "stddev_iat_fwd_window": "fwd_iat_std",
    "mean_iat_bwd_window": "bwd_iat_mean",
    "stddev_iat_bwd_window": "bwd_iat_std",
}
WINDOW_MINS = {"min_iat_fwd_window": "fwd_iat_min", "min_iat_bwd_window": "bwd_iat_min"}
WINDOW_MAXS = {"max_iat_fwd_window": "fwd_iat_max", "max_iat_bwd_window": "bwd_iat_max"}
SRC, DST = 0, 1
# Window lengths of time that the counts of one address stay together in one task.
STRETCH = 256
# Address counts (two for a flow at most) that are placed in one task.
PLACED_ROWS = 100_000


def window_rates() -> dict[str, Column]:
    """Rates and direction ratios over the summed columns and ``_first``/``_last`` (microseconds)."""
    span = (F.col("_last") - F.col("_first")) / 1_000_000 + F.lit(1e-9)
    fwd, bwd = F.col("total_forward_packets_window"), F.col("total_backward_packets_window")
    fwd_bytes, bwd_bytes = F.col("total_forward_bytes_window"), F.col("total_backward_bytes_window")
    return {
        "flow_rate_packets_window": F.col("packet_count_window") / span,
        "flow_rate_bytes_window": fwd_bytes / span,
        "flow_direction_ratio_window": fwd / (bwd + 1),
        "byte_direction_ratio_window": fwd_bytes / (bwd_bytes + 1),
    }


def _entropy_of_counts(count: Column, keep: Column) -> Column:
    """Natural-log Shannon entropy of the counts kept in a group."""
    kept = F.when(keep, count)
    total = F.sum(kept)
    return F.ln(total) - F.sum(kept * F.ln(kept)) / total


def entropy(df: DataFrame, column: str, by: list[str] | None = None, name: str = "entropy") -> DataFrame:
    """Shannon entropy (natural log, nulls left out) of a column, per group.

    Counts per value come first, so the second aggregation sees one row per value.
    """
    by = by or []
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(_entropy_of_counts(F.col("_n"), F.lit(True)).alias(name))


def _pane_aggs() -> list[Column]:
    """Mergeable parts of the window features, from flows."""
    out = [F.count(F.lit(1)).alias("_n"), F.min("_off").alias("_first"), F.max("_off").alias("_last")]
    out += [F.sum(c).alias(c) for c in [*WINDOW_SUMS.values(), *WINDOW_MEANS.values()]]
    out += [F.count(c).alias(f"_n_{c}") for c in WINDOW_MEANS.values()]
    out += [F.min(c).alias(c) for c in WINDOW_MINS.values()]
    return out + [F.max(c).alias(c) for c in WINDOW_MAXS.values()]


def _merged_aggs() -> list[Column]:
    """Window features from the parts of :func:`_pane_aggs`."""
    out = [F.sum("_n").alias("packet_count_window"), F.min("_first").alias("_first"), F.max("_last").alias("_last")]
    out += [F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in WINDOW_SUMS.items()]
    out += [(F.sum(c) / F.sum(f"_n_{c}")).alias(name) for name, c in WINDOW_MEANS.items()]
    out += [F.min(c).alias(name) for name, c in WINDOW_MINS.items()]
    return out + [F.max(c).alias(name) for name, c in WINDOW_MAXS.items()]


def sides() -> Column:
    """One entry per flow for its source and one for its destination address."""
    return F.explode(
        F.array(
            F.struct(F.lit(SRC).alias("kind"), F.col("src_ip").alias("ip")),
            F.struct(F.lit(DST).alias("kind"), F.col("dst_ip").alias("ip")),
        )
    )


def address_entropies(count: Column) -> list[Column]:
    """Entropy of the source and of the destination addresses, from one row per (kind, address)."""
    return [
        _entropy_of_counts(count, F.col("_kind") == kind).alias(f"{name}_ip_entropy_window")
        for kind, name in ((SRC, "src"), (DST, "dst"))
    ]


def hopping_features(
    flows: DataFrame,
    size: str = "5s",
    step: str = "1s",
    ts: str = "timestamp",
    with_first: bool = False,
    order: list[str] | None = None,
) -> DataFrame:
    """Features of hopping windows ``[start, start + size)`` anchored at the earliest flow.

    Flows are first reduced to panes (the common divisor of size and step); only
    panes are copied into the windows they belong to. Address counts take a
    second, narrow pass: counts per (pane, address) are placed by address and
    stretch of time, so that the copies for overlapping windows are made and
    summed inside one task and never shuffled. A hot address is spread over its
    stretches, a hot second is combined before any shuffle. The number of these
    tasks follows from the number of flows, so that one holds bounded counts.
    ``with_first`` adds the 5-tuple of the first flow in time (ties by ``order``).
    """
    size_us, step_us = parse_duration_us(size), parse_duration_us(step)
    if size_us <= 0 or step_us <= 0:
        raise ValueError("size and step must be positive")
    pane_us = gcd(size_us, step_us)
    per_size, per_step = size_us // pane_us, step_us // pane_us
    anchor = flows.select(F.min(F.unix_micros(F.col(ts)))).scalar()
    paned = (
        flows.filter(F.col(ts).isNotNull())
        .withColumn("_off", F.unix_micros(F.col(ts)) - anchor)
        .withColumn("_pane", F.expr(f"_off div {pane_us}"))
    )

    def in_hops(panes: DataFrame) -> DataFrame:
        """Copy each pane row into the windows that cover it."""
        lowest = F.ceil((F.col("_pane") + 1 - per_size) / per_step)
        ranged = panes.withColumn("_lo", F.greatest(F.lit(0).cast("bigint"), lowest)).withColumn(
            "_hi", F.expr(f"_pane div {per_step}")
        )
        if per_size < per_step:  # windows leave gaps
            ranged = ranged.filter("_lo <= _hi")
        return ranged.withColumn("_hop", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")

    totals = in_hops(paned.groupBy("_pane").agg(*_pane_aggs())).groupBy("_hop").agg(*_merged_aggs())

    counts = (
        paned.select("_pane", sides().alias("_side"))
        .select("_pane", F.col("_side.kind").alias("_kind"), F.col("_side.ip").alias("_ip"))
        .filter(F.col("_ip").isNotNull())
        .groupBy("_pane", "_kind", "_ip")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # a window lies in the stretch of its first pane; a pane serves the stretches its windows start in
    stretch = per_size * STRETCH
    tasks = -(-2 * flows.count() // PLACED_ROWS)
    placed = counts.withColumn(
        "_stretch",
        F.explode(F.sequence(F.expr(f"greatest(_pane + 1 - {per_size}, 0L) div {stretch}"), F.expr(f"_pane div {stretch}"))),
    ).repartition(*([tasks] if tasks > 1 else []), "_stretch", "_kind", "_ip")
    entropies = (
        in_hops(placed)
        .filter(F.expr(f"_hop * {per_step} div {stretch} = _stretch"))
        .groupBy("_stretch", "_hop", "_kind", "_ip")
        .agg(F.sum("_n").alias("_n"))
        .groupBy("_hop")
        .agg(*address_entropies(F.col("_n")))
    )
    named = totals.join(entropies.withColumnRenamed("_hop", "_e_hop"), F.col("_hop") == F.col("_e_hop"), "left")
    if with_first:
        heads = paned.groupBy("_pane").agg(F.min(F.struct("_off", *(order or []), *FIVE_TUPLE)).alias("_head"))
        first = in_hops(heads).groupBy(F.col("_hop").alias("_f_hop")).agg(F.min("_head").alias("_head"))
        named = named.join(first, F.col("_hop") == F.col("_f_hop"), "left")
    start_us = anchor + F.col("_hop") * step_us
    return named.withColumns(window_rates()).select(
        F.timestamp_micros(start_us).alias("start_time"),
        F.timestamp_micros(start_us + size_us).alias("end_time"),
        *[F.col(c) for c in WINDOW_FEATURES],
        *([F.col(f"_head.{c}").alias(c) for c in FIVE_TUPLE] if with_first else []),
    )


# Order of the window features in the output.
WINDOW_FEATURES = [
    "total_forward_packets_window",
    "total_backward_packets_window",
    "total_forward_bytes_window",
    "total_backward_bytes_window",
    "average_packet_size_fwd_window",
    "average_packet_size_bwd_window",
    "flow_duration_window",
    "packet_count_window",
    "mean_iat_fwd_window",
    "stddev_iat_fwd_window",
    "min_iat_fwd_window",
    "max_iat_fwd_window",
    "mean_iat_bwd_window",
    "stddev_iat_bwd_window",
    "min_iat_bwd_window",
    "max_iat_bwd_window",
    "flow_rate_packets_window",
    "flow_rate_bytes_window",
    "flow_direction_ratio_window",
    "byte_direction_ratio_window",
    "src_ip_entropy_window",
    "dst_ip_entropy_window",
]


def window_span(windows: DataFrame, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """``time_diff`` (an interval) and its length in seconds."""
    micros = F.unix_micros(F.col(end)) - F.unix_micros(F.col(start))
    return windows.withColumn("time_diff", F.col(end) - F.col(start)).withColumn(
        "time_diff_seconds", micros / 1_000_000
    )


def offset_seconds(df: DataFrame, start: str = "start_time_x", name: str = "timestamp_offset_seconds") -> DataFrame:
    """Seconds since the earliest ``start`` of the table (a one-row scalar subquery)."""
    first = df.select(F.min(F.unix_micros(F.col(start)))).scalar()
    return df.withColumn(name, (F.unix_micros(F.col(start)) - first) / 1_000_000)
