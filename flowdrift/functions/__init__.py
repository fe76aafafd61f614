"""Column functions: each takes and returns Spark columns, nothing else."""

from flowdrift.functions.columns import (
    binary_label,
    decode_prediction,
    epoch_ms_to_ts,
    label_by_endpoint,
    nonfinite_to_null,
    normalize_label,
    parse_duration_us,
    parse_flow_ts,
    parse_stat_value,
    ratio_or_zero,
    valid_ipv4,
)

__all__ = [
    "binary_label",
    "decode_prediction",
    "epoch_ms_to_ts",
    "label_by_endpoint",
    "nonfinite_to_null",
    "normalize_label",
    "parse_duration_us",
    "parse_flow_ts",
    "parse_stat_value",
    "ratio_or_zero",
    "valid_ipv4",
]
