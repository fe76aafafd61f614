"""Cleaning, labels and scalar functions on hand-made rows."""

from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.functions import columns
from flowdrift.operators import clean, label
from flowdrift.schema import FLOW_COLUMNS, NETFLOW_RENAMES, flow_schema, netflow_schema


def one(df):
    return df.first()[0]


def test_nonfinite_and_clean(spark):
    df = spark.createDataFrame(
        [(1.0, float("inf"), 0), (float("nan"), 2.0, 1), (None, float("-inf"), 2)], "a double, b double, `Unnamed: 0` int"
    )
    cleaned = clean.clean_flows(df)
    assert cleaned.columns == ["a", "b"]
    assert [tuple(r) for r in cleaned.collect()] == [(1.0, None), (None, 2.0), (None, None)]
    profile = {r["column"]: (r["nulls"], r["infinities"]) for r in clean.null_inf_profile(df).collect()}
    assert profile == {"a": (2, 0), "b": (0, 2), "Unnamed: 0": (0, 0)}


def test_netflow_cleaning(spark):
    row = dict.fromkeys(NETFLOW_RENAMES, 0)
    row.update(
        IPV4_SRC_ADDR="10.0.0.1", IPV4_DST_ADDR="10.0.0.2", FLOW_START_MILLISECONDS=1_700_000_000_000,
        FLOW_END_MILLISECONDS=1_700_000_001_000, FLOW_DURATION_MILLISECONDS=1000, IN_PKTS=0, OUT_PKTS=4, IN_BYTES=0,
        OUT_BYTES=400, SRC_TO_DST_IAT_AVG=2.0, SRC_TO_DST_IAT_STDDEV=float("inf"), DST_TO_SRC_IAT_AVG=0.0,
        DST_TO_SRC_IAT_STDDEV=0.0, Label=0, Attack="Benign",
    )
    good = spark.createDataFrame([row, {**row, "IPV4_SRC_ADDR": None}], netflow_schema())
    cleaned = clean.clean_flows(good, netflow=True)
    assert cleaned.count() == 1
    r = cleaned.first()
    assert r["flow_duration"] == 1_000_000 and r["fwd_pkt_len_mean"] == 100.0 and r["bwd_pkt_len_mean"] == 0.0
    assert r["fwd_iat_std"] is None and r["fwd_iat_tot"] == 6.0 and r["down_up_ratio"] == 0.0
    assert str(r["start_time"]) == "2023-11-14 22:13:20"
    partial = good.drop("IN_PKTS")
    assert clean.clean_flows(partial, netflow=True).columns == partial.columns


def test_flow_schema_has_83_columns():
    assert len(FLOW_COLUMNS) == len(set(FLOW_COLUMNS)) == 83
    assert flow_schema().fieldNames()[-1] == "BinLabel"


def test_fill_mean_and_drop(spark):
    df = spark.createDataFrame([(1.0, None, 9), (None, 2.0, 9)], "a double, b double, drop int")
    filled = clean.fill_mean(clean.drop_if_present(df, ["drop", "absent"]), ["a", "b"])
    assert filled.columns == ["a", "b"]
    assert [tuple(r) for r in filled.collect()] == [(1.0, 2.0), (1.0, 2.0)]


def test_fill_mean_of_empty_column_stays_null(spark):
    df = spark.createDataFrame([(None, 1), (None, 1)], "a double, g int")
    assert clean.fill_mean(df, ["a"]).filter("a IS NULL").count() == 2
    assert clean.fill_mean(df, ["a"], ["g"]).filter("a IS NULL").count() == 2


def test_fill_median_even_count(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (2.0,), (9.0,), (None,), (float("inf"),)], "a double")
    assert sorted(r[0] for r in clean.fill_median(df, ["a"]).collect()) == [1.0, 2.0, 3.0, 3.0, 4.0, 9.0]


def test_reindex(spark):
    df = spark.createDataFrame([(1, 2)], "b int, c int")
    wanted = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.LongType())])
    out = clean.reindex_columns(df, wanted)
    assert out.columns == ["a", "b"] and tuple(out.first()) == (None, 1)


@pytest.mark.parametrize(
    ("ip", "ok"),
    [("10.0.0.1", True), ("256.1.1.1", False), ("1.2.3", False), ("01.02.003.4", True), ("a.b.c.d", False), ("1.2.3.4.5", False)],
)
def test_valid_ipv4(spark, ip, ok):
    assert one(spark.range(1).select(columns.valid_ipv4(F.lit(ip)))) is ok


@pytest.mark.parametrize(
    ("text", "value"), [("12.5%", 12.5), ("3.25s", 3.25), ("7", 7.0), ("[1, 2]", None), ("0.1s | Median: 2s", None), ("", None)]
)
def test_stat_value(spark, text, value):
    assert one(spark.range(1).select(columns.parse_stat_value(F.lit(text)))) == value


@pytest.mark.parametrize(
    ("text", "us"), [("5s", 5_000_000), ("15 min", 900_000_000), ("1h", 3_600_000_000), ("250ms", 250_000), (2, 2_000_000), ("2 hours", 7_200_000_000)]
)
def test_durations(text, us):
    assert columns.parse_duration_us(text) == us


def test_bad_duration():
    with pytest.raises(ValueError):
        columns.parse_duration_us("soon")


def test_labels(spark):
    df = spark.createDataFrame([("Benign",), ("Attack",), (None,), ("benign",)], "Label string")
    assert [r["BinLabel"] for r in label.with_binary_label(df).collect()] == [0, 1, 1, 1]
    read = df.select(columns.normalize_label(F.col("Label")).alias("v"))
    assert [r["v"] for r in read.collect()] == [0.0, 1.0, None, 0.0]


def test_quarantine(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (None,)], "y double")
    good, bad = label.quarantine_bad_labels(df, "y")
    assert sorted(r["BinLabel"] for r in good.collect()) == [0, 1]
    assert bad.count() == 2
    report = label.bad_label_report(bad, "y").first()
    assert report["bad_rows"] == 2
    strict, _ = label.quarantine_bad_labels(df, "y", strict=True)
    with pytest.raises(PySparkException, match="not finite"):
        strict.collect()


def test_endpoint_label(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "c"), (None, "b")], "src_ip string, dst_ip string")
    out = df.select(columns.label_by_endpoint(F.col("src_ip"), F.col("dst_ip"), "a", "b"))
    assert [r[0] for r in out.collect()] == [1, 0, 0]


def test_passthrough(spark):
    assert label.passthrough_label(spark.createDataFrame([(1,)], "Bin_Label int")).columns == ["BinLabel"]
    assert label.passthrough_label(spark.createDataFrame([(1,)], "other int")).columns == ["other"]


def test_empty_rows_and_json(spark):
    df = spark.createDataFrame([(None, None), (1, None)], "a int, b string")
    assert [r["is_empty"] for r in clean.flag_empty_rows(df).collect()] == [True, False]
    pairs = spark.createDataFrame([(0, 0), (0, 1)], "label int, prediction int")
    assert [r["row_json"] for r in clean.row_to_json(pairs).collect()] == ['{"label":0,"prediction":1}']


def test_known_labels_stay_paired(spark):
    pairs = spark.createDataFrame([("a", "x"), ("x", "a"), ("a", "b")], "label string, prediction string")
    assert [tuple(r) for r in label.filter_known_labels(pairs, ["a", "b"]).collect()] == [("a", "b")]


def test_entropy_value(spark):
    from flowdrift.operators.features import entropy

    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int")
    assert math.isclose(one(entropy(df, "x")), math.log(4))
