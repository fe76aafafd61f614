"""Sessions, windows and joins against plain Python on small fixtures."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowdrift.operators import features, joins
from flowdrift.plans.features import aggregated_features

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
SCHEMA = """id bigint, timestamp timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol int,
 flow_duration double, tot_fwd_pkts bigint, tot_bwd_pkts bigint, totlen_fwd_pkts double, totlen_bwd_pkts double,
 fwd_pkt_len_mean double, bwd_pkt_len_mean double, pkt_len_mean double, flow_iat_mean double, down_up_ratio double,
 fwd_iat_min double, fwd_iat_max double, fwd_iat_mean double, fwd_iat_std double, fwd_iat_tot double,
 bwd_iat_min double, bwd_iat_max double, bwd_iat_mean double, bwd_iat_std double, bwd_iat_tot double,
 subflow_fwd_pkts bigint, subflow_bwd_pkts bigint, subflow_fwd_byts bigint, subflow_bwd_byts bigint,
 fwd_pkt_len_max double, fwd_pkt_len_min double, fwd_pkt_len_std double, fwd_blk_rate_avg double,
 bwd_pkt_len_max double, bwd_pkt_len_min double, bwd_pkt_len_std double, bwd_blk_rate_avg double, Label string"""


def flow(i, seconds, src="a", dst="b", label="Benign", protocol=6, **values):
    names = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(",")]
    row = dict.fromkeys(names, 1.0 * (i % 7))
    for c in names:
        if c.startswith(("tot_", "subflow")):
            row[c] = i % 7
    row.update(
        id=i, timestamp=T0 + dt.timedelta(seconds=seconds), src_ip=src, dst_ip=dst, src_port=1, dst_port=2,
        protocol=protocol, Label=label,
    )
    row.update(values)
    return row


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_single_row_session_has_no_deviation(spark):
    s = features.session_features(make(spark, [flow(3, 0)])).first()
    assert s["fwd_pkt_len_std"] is None and s["total_packets"] == 6 and s["start_time"] == s["end_time"]


def test_session_sum_of_nulls_is_zero_and_null_keys_are_left_out(spark):
    rows = [flow(1, 0, tot_fwd_pkts=None), flow(2, 1, src=None)]
    sessions = features.session_features(make(spark, rows)).collect()
    assert len(sessions) == 1 and sessions[0]["total_forward_packets"] == 0


def _plain_windows(rows, size, step):
    start = min(r["timestamp"] for r in rows)
    last = max(r["timestamp"] for r in rows)
    out, st = {}, start
    while st <= last:
        inside = [r for r in rows if st <= r["timestamp"] < st + dt.timedelta(seconds=size)]
        if inside:
            counts = Counter(r["src_ip"] for r in inside if r["src_ip"] is not None)
            n = sum(counts.values())
            entropy = -sum(c / n * math.log(c / n) for c in counts.values())
            first = min(inside, key=lambda r: (r["timestamp"], r["id"]))
            out[st] = (len(inside), sum(r["tot_fwd_pkts"] for r in inside), entropy, first["dst_ip"],
                       max(r["fwd_iat_max"] for r in inside))
        st += dt.timedelta(seconds=step)
    return out


@pytest.mark.parametrize(("size", "step"), [(5, 1), (3, 5), (4, 3), (10, 10), (1, 0.5)])
def test_windows_against_plain_python(spark, size, step):
    rng = random.Random(size * 10 + step)
    rows = [flow(i, rng.choice([rng.randint(0, 60), rng.randint(0, 600) / 10]), rng.choice("acdd"), rng.choice("bxy")) for i in range(120)]
    rows += [flow(200 + i, 7, "hot") for i in range(60)]
    got = features.hopping_features(make(spark, rows), size, step, with_first=True, order=["id"]).collect()
    want = _plain_windows(rows, size, step)
    assert {r["start_time"] for r in got} == set(want)
    for r in got:
        n, packets, entropy, dst, top = want[r["start_time"]]
        assert (r["packet_count_window"], r["total_forward_packets_window"], r["dst_ip"], r["max_iat_fwd_window"]) == (n, packets, dst, top)
        assert math.isclose(r["src_ip_entropy_window"], entropy, abs_tol=1e-12)
        assert r["end_time"] - r["start_time"] == dt.timedelta(seconds=size)


def test_tasks_of_address_counts_follow_the_flows(spark, monkeypatch):
    """Twice the flows are placed in twice the tasks, which Spark may not merge; the windows stay the same."""
    rows = [flow(i, i % 60, "acd"[i % 3], "bxy"[i % 2]) for i in range(400)]
    want = sorted(map(tuple, features.hopping_features(make(spark, rows)).collect()))
    monkeypatch.setattr(features, "PLACED_ROWS", 20)
    for n in (200, 400):
        few = features.hopping_features(make(spark, rows[:n]))
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and re.search(rf"hashpartitioning\(_stretch#\d+L, _kind#\d+, _ip#\d+, {n // 10}\)", plan)
    for a, b in zip(sorted(map(tuple, few.collect())), want, strict=True):
        assert all(x == y or math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a, b))


def test_empty_hops_are_omitted(spark):
    got = features.hopping_features(make(spark, [flow(1, 0), flow(2, 100)]), "5s", "1s").collect()
    starts = sorted((r["start_time"] - T0).total_seconds() for r in got)
    assert starts == [0.0, 96.0, 97.0, 98.0, 99.0, 100.0]


def test_window_rates_of_one_flow(spark):
    r = features.hopping_features(make(spark, [flow(2, 0)]), "5s", "5s").first()
    assert r["flow_rate_packets_window"] == 1 / 1e-9 and r["flow_direction_ratio_window"] == 2 / 3


def _stamped(spark, pairs, name):
    return spark.createDataFrame([(T0 + dt.timedelta(seconds=s), v) for s, v in pairs], f"t timestamp, {name} string")


def test_asof_ties_and_early_rows(spark):
    left = _stamped(spark, [(0, "early"), (5, "at"), (7, "after"), (7, "after too")], "l")
    right = _stamped(spark, [(5, "a"), (5, "b"), (6, "c"), (9, "z")], "r")
    got = {r["l"]: r["r"] for r in joins.asof_join_backward(left, right, "t", "t", ["r"]).collect()}
    assert got == {"early": None, "at": "b", "after": "c", "after too": "c"}


def test_asof_random_with_hot_instants(spark):
    rng = random.Random(5)
    left = [(rng.randint(0, 400) if i % 3 else 77, f"l{i}") for i in range(600)]
    right = [(rng.randint(20, 380) if i % 3 else 76, f"r{i:03d}") for i in range(300)]
    got = {r["l"]: r["r"] for r in joins.asof_join_backward(
        _stamped(spark, left, "l"), _stamped(spark, right, "r"), "t", "t", ["r"], buckets=7).collect()}
    for at, name in left:
        before = [(s, v) for s, v in right if s <= at]
        assert got[name] == (max(before)[1] if before else None)


def test_asof_empty_right(spark):
    out = joins.asof_join_backward(_stamped(spark, [(1, "x")], "l"), _stamped(spark, [], "r"), "t", "t", ["r"])
    assert [r["r"] for r in out.collect()] == [None]


def test_label_join_fans_out_and_matches_null_keys(spark):
    rows = spark.createDataFrame([(None, "b", 1, 2, 6), ("a", "b", 1, 2, 6)], "src_ip string, dst_ip string, src_port int, dst_port int, protocol int")
    labels = spark.createDataFrame(
        [(None, "b", 1, 2, 6, "X"), ("a", "b", 1, 2, 6, "X"), ("a", "b", 1, 2, 6, "Y")],
        "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, Label string",
    )
    out = sorted((r["src_ip"] or "", r["Label"]) for r in joins.label_join(rows, labels).collect())
    assert out == [("", "X"), ("a", "X"), ("a", "Y")]


def test_window_session_join_suffixes(spark):
    f = make(spark, [flow(i, i, "abc"[i % 3]) for i in range(9)])
    hops = features.hopping_features(f, "2s", "2s", with_first=True, order=["id"])
    joined = joins.window_session_join(hops, features.session_features(f))
    assert {"start_time_x", "start_time_y", "end_time_x", "end_time_y"} <= set(joined.columns)
    assert joined.count() == hops.count()


def test_aggregated_netflow_offsets(spark):
    f = make(spark, [flow(i, i, "abc"[i % 3], label="Attack" if i % 3 == 0 else "Benign") for i in range(12)])
    f = f.withColumnRenamed("timestamp", "start_time").withColumn("end_time", F.col("start_time")).withColumn("Attack", F.col("Label"))
    out = aggregated_features(f, "3s", "1s", netflow=True, order=["id"])
    assert out.agg(F.min("timestamp_offset_seconds")).first()[0] == 0.0
    assert out.filter("Label <> Attack").count() == 0


def test_plan_of_windows(spark, tmp_path):
    make(spark, [flow(i, i) for i in range(5)]).write.parquet(str(tmp_path / "f"))
    df = features.hopping_features(spark.read.parquet(str(tmp_path / "f")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Cartesian", "NestedLoop", "SortAggregate"))
    # panes, windows; counts, stretches, windows: the copies for overlapping windows are not shuffled
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) == 5
    narrow = [line for line in plan.splitlines() if "ReadSchema" in line and "src_ip" in line]
    assert narrow and all("tot_fwd_pkts" not in line for line in narrow)
