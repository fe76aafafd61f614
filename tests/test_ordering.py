"""Numbering, running sums, quantiles and filling with one group holding most rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowdrift.operators import metrics, ordering, sampling

RNG = random.Random(11)
ROWS = [(i, "hot" if i % 3 else RNG.choice("abc"), RNG.choice([0.5, RNG.random(), RNG.random() * 100])) for i in range(900)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(RNG.sample(ROWS, len(ROWS)), "id bigint, g string, x double").repartition(7)


def test_number_rows(rows):
    got = {r["id"]: r["row_no"] for r in ordering.number_rows(rows, ["x", "id"]).collect()}
    want = {i: n for n, (i, _, _) in enumerate(sorted(ROWS, key=lambda r: (r[2], r[0])), 1)}
    assert got == want


def test_number_rows_per_group_with_null_key(spark, rows):
    keyed = rows.withColumn("g", F.when(F.col("g") != "a", F.col("g")))
    got = {r["id"]: r["n"] for r in ordering.number_rows(keyed, ["id"], ["g"], "n").collect()}
    for name in ("hot", "a", "b", "c"):
        ids = [i for i, g, _ in ROWS if g == name]
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_last_n_by_group_both_ways(spark, rows):
    for n in (5, 300):
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "100")
        got = {r["id"] for r in ordering.last_n(rows, n, ["id"], ["g"]).collect()}
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
        want = set()
        for name in ("hot", "a", "b", "c"):
            want |= set([i for i, g, _ in ROWS if g == name][-n:])
        assert got == want


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_group_quantile(rows, q):
    got = {r["g"]: r["quantile"] for r in ordering.group_quantile(rows, ["g"], "x", q, buckets=5).collect()}
    for name in got:
        want = np.quantile([x for _, g, x in ROWS if g == name], q)
        assert abs(got[name] - want) < 1e-12
    whole = ordering.group_quantile(rows, [], "x", q).first()[0]
    assert abs(whole - np.quantile([x for _, _, x in ROWS], q)) < 1e-12


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-5, 5), min_size=1, max_size=40), q=st.floats(0, 1))
def test_quantile_property(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert abs(ordering.group_quantile(df, [], "x", q).first()[0] - np.quantile(values, q)) < 1e-9


def test_running_sums_descending(rows):
    sums = ordering.running_sums(rows, ["g"], "id", {"s": F.lit(1)}, descending=True, buckets=4)
    got = {r["id"]: r["s"] for r in sums.collect()}
    ids = [i for i, g, _ in ROWS if g == "hot"]
    assert [got[i] for i in reversed(ids)] == list(range(1, len(ids) + 1))


def test_forward_fill_across_blocks(spark):
    data = [(k, i, f"{k}{i}" if i % 17 == 3 else None) for k in "ab" for i in range(100)]
    df = spark.createDataFrame(data, "k string, i bigint, v string")
    got = {(r["k"], r["i"]): r["f"] for r in ordering.forward_fill(df, "i", "v", ["k"], "f", block=8).collect()}
    for k in "ab":
        last = None
        for i in range(100):
            last = f"{k}{i}" if i % 17 == 3 else last
            assert got[(k, i)] == last


def test_chunks_that_do_not_divide_the_rows(rows):
    sizes = ordering.assign_chunks(rows, 400, ["id"]).groupBy("chunk_id").count().orderBy("chunk_id").collect()
    assert [r["count"] for r in sizes] == [400, 400, 100]


def test_sliding_accuracy_small_blocks(spark):
    flags = [RNG.random() < 0.7 for _ in range(350)]
    df = spark.createDataFrame(list(enumerate(flags)), "id bigint, correct boolean")
    got = {r["id"]: r["sliding_accuracy"] for r in ordering.sliding_accuracy(df, ["id"], "correct", 30, block=40).collect()}
    want = np.convolve(flags, np.ones(30) / 30, mode="valid")
    assert sorted(got) == list(range(29, 350))
    assert np.allclose([got[i] for i in range(29, 350)], want)


def test_drift_intervals(spark):
    df = spark.createDataFrame([(i, i in (3, 4, 9)) for i in range(12)], "chunk_id bigint, drift boolean")
    got = {r["chunk_id"]: r["drift_interval"] for r in ordering.drift_intervals(df).collect()}
    assert got == {3: None, 4: 1, 9: 5}
    s = metrics.drift_summary(df.withColumn("rows", F.lit(10))).first()
    assert (s["drifts"], s["drift_rate"], s["drift_rate_per_chunk"], s["mean_interval"]) == (3, 3 / 120, 0.25, 3.0)


def test_no_drift_at_all(spark):
    df = spark.createDataFrame([(i, False) for i in range(4)], "chunk_id bigint, drift boolean")
    s = metrics.drift_summary(df.withColumn("rows", F.lit(10))).first()
    assert s["drifts"] == 0 and s["mean_interval"] is None


def test_trailing_window_against_plain_loop(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    ends = [RNG.randint(0, 50) if i % 4 else 20 for i in range(90)]
    df = spark.createDataFrame(
        [(i, t0 + dt.timedelta(seconds=e) if e != 7 else None, i // 8) for i, e in enumerate(ends)], "id bigint, e timestamp, chunk_id bigint"
    )
    got = {(r["id"], r["after_chunk"]) for r in ordering.trailing_window_rows(df, "e", duration_us=10_000_000).collect()}
    want, kept = set(), []
    for c in range(-(-90 // 8)):
        kept += [(i, ends[i]) for i in range(90) if i // 8 == c and ends[i] != 7]
        top = max(e for _, e in kept)
        kept = [(i, e) for i, e in kept if e >= top - 10]
        want |= {(i, c) for i, _ in kept}
    assert got == want


def test_folds_and_splits_are_balanced(rows):
    folded = sampling.stratified_folds(rows, "id", "g", 7).groupBy("g", "fold").count().collect()
    for name in {r["g"] for r in folded}:
        sizes = [r["count"] for r in folded if r["g"] == name]
        assert max(sizes) - min(sizes) <= 1
    kept = sampling.split(rows, "id", 0.8, "g").filter("is_train").groupBy("g").count().collect()
    for r in kept:
        assert r["count"] == int(sum(g == r["g"] for _, g, _ in ROWS) * 0.8 + 0.5)


@pytest.mark.parametrize("digits", [1, 4])
@pytest.mark.parametrize("share", [0.0, 0.35, 0.8, 1.0])
def test_split_goes_by_hash_order(spark, share, digits):
    data = [(i if i % 50 else None, None if i % 9 == 0 else "ab"[i % 2]) for i in range(300)] + [(7, "b")] * 40
    df = spark.createDataFrame(data, "id bigint, g string")
    hashed = lambda i: "" if i is None else hashlib.md5(str(i).encode()).hexdigest()
    for label in ("g", None):
        got = sampling.split(df, "id", share, label, hex_digits=digits).collect()
        want = []
        for name in {g for _, g in data} if label else {0}:
            order = sorted((hashed(i), str(i), str(g)) for i, g in data if not label or g == name)
            want += [(i, k < int(len(order) * share + 0.5)) for k, (_, i, _) in enumerate(order)]
        assert sorted((str(r["id"]), r["is_train"]) for r in got) == sorted(want)


def test_split_ranks_only_rows_at_the_cut(rows):
    plan = sampling.split(rows, "id", 0.8, "g")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "NestedLoopJoin" not in plan


def test_best_by_stat_keeps_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("a", 3.0, 3), ("b", 2.0, 4)], "stat string, v double, id int")
    got = {(r["id"], r["best"]) for r in ordering.best_by_stat(df, "stat", "v", {"a": "both", "b": "all"}).collect()}
    assert got == {(1, "lowest"), (2, "highest"), (3, "highest"), (4, "listed")}
    with pytest.raises(ValueError):
        ordering.best_by_stat(df, "stat", "v", {"a": "worst"})


@pytest.mark.parametrize("small", [3, 40, 10_000])
@pytest.mark.parametrize("n", [0, 1, 7, 250, 700, 2000])
def test_newest_rows_by_selection(spark, small, n):
    """Ties, nulls, a value that holds half of all rows, identical rows: always n rows, the largest ones, the same each time."""
    import random

    rng = random.Random(n)
    rows = [(rng.choice([5, 5, 5, None, *range(30)]), rng.choice("ab"), rng.randrange(4)) for _ in range(600)] + [(5, "a", 1)] * 200
    df = spark.createDataFrame(rows, "k int, s string, v int").repartition(7)
    got = ordering.last_n(df, n, ["k", "s"], small=small)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    found = sorted(map(tuple, got.collect()), key=lambda r: (key(r), r[2]))
    assert [key(r) for r in found] == sorted(map(key, rows))[max(0, len(rows) - n) :]
    assert found == sorted(map(tuple, ordering.last_n(df.repartition(3), n, ["k", "s"], small=100_000).collect()), key=lambda r: (key(r), r[2]))


def test_newest_rows_need_one_round_on_the_order_alone(spark, monkeypatch):
    """The pivots lie close around the cut, so one pass counts them; it reads the column of the order and no other."""
    seen, plain = [], ordering._pivots
    monkeypatch.setattr(ordering, "_pivots", lambda inside, *a: (seen.append(inside.schema["_key"].dataType.names), plain(inside, *a))[1])
    df = spark.range(300_000).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    got = ordering.last_n(df, 500, ["id"], small=5_000)
    assert sorted(r["id"] for r in got.collect()) == list(range(299_500, 300_000))
    assert seen == [["id"]]


def test_newest_rows_per_group_alike(spark):
    rows = [(g, k % 9, v) for g in "xy" for k in range(40) for v in range(3)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    few = sorted(map(tuple, ordering.last_n(df, 31, ["k"], ["g"]).collect()))
    threshold = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5")
    try:
        many = sorted(map(tuple, ordering.last_n(df.repartition(2), 31, ["k"], ["g"]).collect()))
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    assert few == many and len(few) == 62
