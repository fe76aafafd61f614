"""Scalar column functions shared by the operators. All stay inside codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label spellings accepted by normalize_label.
BENIGN_SPELLINGS = ("BENIGN", "Benign", "benign", "NORMAL", "Normal", "normal", "0")
ATTACK_SPELLINGS = ("ATTACK", "Attack", "attack", "MALICIOUS", "Malicious", "malicious", "1")

# Fixed value: dotted IPv4 text, leading zeros allowed up to three digits.
IPV4_PATTERN = r"^(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(\.(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)){3}$"

FLOW_TIMESTAMP_FORMAT = "dd-MM-yyyy HH:mm"

_UNITS_US = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "sec": 1_000_000,
    "second": 1_000_000,
    "m": 60_000_000,
    "min": 60_000_000,
    "minute": 60_000_000,
    "h": 3_600_000_000,
    "hour": 3_600_000_000,
    "d": 86_400_000_000,
    "day": 86_400_000_000,
}


def parse_duration_us(text: str | int | float) -> int:
    """Microseconds in a duration such as ``5s``, ``15 min``, ``1 hour`` (a bare number is seconds)."""
    if isinstance(text, (int, float)):
        return round(text * 1_000_000)
    match = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*([a-zA-Z]*)\s*", text)
    unit = (match.group(2).lower() or "s") if match else ""
    if unit not in _UNITS_US and unit.endswith("s"):
        unit = unit[:-1]
    if not match or unit not in _UNITS_US:
        raise ValueError(f"not a duration: {text!r}")
    return round(float(match.group(1)) * _UNITS_US[unit])


def nonfinite_to_null(c: Column) -> Column:
    """NaN and both infinities to NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def ratio_or_zero(guard: Column, numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` where ``guard`` holds, else 0."""
    return F.when(guard, numerator / denominator).otherwise(F.lit(0.0))


def epoch_ms_to_ts(c: Column) -> Column:
    """Epoch milliseconds to a timestamp; what does not read as a number is NULL."""
    return F.timestamp_millis(c.try_cast("bigint"))


def parse_flow_ts(c: Column, fmt: str = FLOW_TIMESTAMP_FORMAT) -> Column:
    """Flow timestamp text to a timestamp; unparsable text is NULL."""
    return F.try_to_timestamp(c, F.lit(fmt))


def valid_ipv4(c: Column) -> Column:
    return c.rlike(IPV4_PATTERN)


def binary_label(c: Column) -> Column:
    """0 for ``Benign``, 1 for everything else, NULL included."""
    return F.when(c.eqNullSafe(F.lit("Benign")), F.lit(0)).otherwise(F.lit(1)).cast("int")


def normalize_label(c: Column) -> Column:
    """Known spellings to 0/1, other text read as a number, else NULL."""
    text = c.cast("string")
    return (
        F.when(text.isin(*BENIGN_SPELLINGS), F.lit(0.0))
        .when(text.isin(*ATTACK_SPELLINGS), F.lit(1.0))
        .otherwise(nonfinite_to_null(text.try_cast("double")))
    )


def label_by_endpoint(src: Column, dst: Column, src_ip: str, dst_ip: str) -> Column:
    """1 where both endpoints match (a NULL endpoint does not)."""
    return F.coalesce((src == src_ip) & (dst == dst_ip), F.lit(False)).cast("int")


def decode_prediction(c: Column, names: list[str] | None = None) -> Column:
    """Class id to name: ``Attack``/``Benign`` for a binary id, ``names[id]`` otherwise."""
    if names is None:
        return F.when(c.cast("int") == 1, F.lit("Attack")).otherwise(F.lit("Benign"))
    return F.get(F.array(*[F.lit(n) for n in names]), c.cast("int"))


def parse_stat_value(c: Column) -> Column:
    """Number in a report value: leading and trailing ``%`` and ``s`` removed, else NULL."""
    return F.regexp_replace(c, "^[%s]+|[%s]+$", "").try_cast("double")
