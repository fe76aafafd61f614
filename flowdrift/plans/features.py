"""From cleaned flows to the aggregated, labelled feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdrift.functions.columns import binary_label
from flowdrift.operators.features import hopping_features, offset_seconds, session_features
from flowdrift.operators.joins import asof_join_backward, distinct_label_map, label_join, window_session_join
from flowdrift.schema import FIVE_TUPLE
from flowdrift.session import materialize


def aggregated_features(
    flows: DataFrame,
    size: str = "5s",
    step: str = "1s",
    netflow: bool = False,
    label: str = "Label",
    ts: str = "timestamp",
    order: list[str] | None = None,
) -> DataFrame:
    """Windows joined to sessions and labels, one row per window (more where a 5-tuple has several labels).

    Flow-meter input joins each window to the latest session started by then;
    NetFlow input joins on the 5-tuple of the window's first flow and adds the
    offset from the earliest window. Sessions and windows are each written once,
    as both are read again by the join.
    """
    if netflow:
        sessions = session_features(flows, "netflow", start="start_time", end="end_time")
        windows = hopping_features(flows, size, step, ts="start_time", with_first=True, order=order)
        joined = window_session_join(windows, sessions)
        labels = [c for c in (label, "Attack") if c in flows.columns]
        return offset_seconds(materialize(label_join(joined, distinct_label_map(flows, labels))))
    sessions = materialize(session_features(flows, "flowmeter", start=ts, end=ts))
    windows = materialize(hopping_features(flows, size, step, ts=ts))
    joined = asof_join_backward(windows, sessions, "start_time", "start_time", FIVE_TUPLE)
    labelled = label_join(joined, distinct_label_map(flows, [label]))
    return labelled.withColumn("BinLabel", binary_label(F.col(label)))
