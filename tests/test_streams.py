"""Sources, log and streams: same results as batch, also across a restart and a repeated batch."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.config import ChunkConfig, ConformalConfig, DriftConfig, SignificanceConfig
from flowdrift.operators import control, features
from flowdrift.schema import flow_schema
from flowdrift.sources import readers
from flowdrift.operators.clean import clean_flows
from flowdrift.plans.features import aggregated_features
from flowdrift.sources.rolling_log import RollingLog, seed_rows
from flowdrift.streaming.drift import DriftStream, ProgressLog, run_payloads
from flowdrift.streaming.hopping import stream_hopping_features
from flowdrift.streaming.chunks import ChunkLoop, chunk_stream, chunk_table, rechunk_stream
from flowdrift.streaming.state import significance_stream
from tests.test_features import SCHEMA, flow


def feed(df, path, order, cuts):
    """Write one file per range of ``order``, oldest first."""
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        part = df
        if low is not None:
            part = part.filter(F.col(order) >= low)
        if high is not None:
            part = part.filter(F.col(order) < high)
        part.coalesce(1).write.mode("append").parquet(path)


def drain(stream, base, mode="append"):
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/cp").option("path", f"{base}/out")
    q.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def test_csv_special_numbers(spark, tmp_path):
    (tmp_path / "f.csv").write_text("src_ip,flow_duration,protocol\n1.1.1.1,inf,6\n,NaN,x\n2.2.2.2,3.5,17\n")
    schema = T.StructType([f for f in flow_schema() if f.name in ("src_ip", "flow_duration")] + [T.StructField("protocol", T.IntegerType())])
    schema = T.StructType([schema["src_ip"], schema["flow_duration"], schema["protocol"]])
    got = [tuple(r) for r in readers.read_flows(spark, str(tmp_path / "f.csv"), schema=schema).collect()]
    assert got == [("1.1.1.1", None, 6), (None, None, None), ("2.2.2.2", 3.5, 17)]


def test_merge_skips_files_without_timestamp(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,x\n2024-01-01 00:00:00,1\n2024-01-03 00:00:00,3\n")
    (tmp_path / "b.csv").write_text("x,timestamp,y\n2,2024-01-02 00:00:00,q\n")
    (tmp_path / "c.csv").write_text("x\n9\n")
    out = readers.merge_flow_dir(spark, str(tmp_path))
    assert [(r["x"], r["y"]) for r in out.collect()] == [("3", None), ("2", "q"), ("1", None)]
    with pytest.raises(ValueError):
        readers.merge_flow_dir(spark, str(tmp_path), timestamp="when")


def test_payloads_by_header_name(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([("b,a\r\nx,1\r\n\r\ny,oops\n",), ("a\n5",), ("a,b",), ("",)], "value string")
    got = sorted((r["a"] or 0, r["b"] or "") for r in readers.decode_csv_payloads(df, schema).collect())
    assert got == [(0, "y"), (1, "x"), (5, "")]
    odd = spark.createDataFrame([('b,a,a\n"x,""y""",3,4\nz\n',)], "value string")
    got = sorted((r["a"] or 0, r["b"]) for r in readers.decode_csv_payloads(odd, schema).collect())
    assert got == [(0, "z"), (3, 'x,"y"')]


def test_file_to_features(spark, tmp_path):
    """The example of the README: shuffled columns, an index column, text times and a label."""
    lines = ["Unnamed: 0,Label,dst_ip,src_ip,timestamp,protocol,dst_port,src_port,flow_duration,tot_fwd_pkts"]
    for k in range(30):
        lines.append(f"{k},{'Benign' if k % 3 else 'Scan'},9.9.9.{k % 2},1.1.1.{k % 4},01-02-2024 10:{k % 7:02d},6,80,{1000 + k % 4},{'inf' if k == 5 else k},{k}")
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    flows = clean_flows(readers.read_flows(spark, str(tmp_path)))
    assert "Unnamed: 0" not in flows.columns and dict(flows.dtypes)["timestamp"] == "timestamp"
    assert flows.filter("src_ip like '1.1.1.%' and dst_ip like '9.9.9.%' and protocol = 6 and dst_port = 80").count() == 30
    assert flows.filter("flow_duration is null").count() == 1
    table = aggregated_features(flows, size="2 minutes", step="1 minute", label="Label")
    assert table.count() > 0 and {r[0] for r in table.select("BinLabel").distinct().collect()} == {0, 1}
    (tmp_path / "g.csv").write_text("src_ip,Label\n1.1.1.1,Benign\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_flows(spark, str(tmp_path)).collect()


def test_payload_callback(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    spark.createDataFrame([("a\n1\n2",)], "value string").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = readers.stream_flows(spark, str(tmp_path / "in"), T.StructType([T.StructField("value", T.StringType())]), "parquet")
    q = run_payloads(stream, schema, lambda df, i: seen.extend(r["a"] for r in df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [1, 2]


def test_rolling_log(spark, tmp_path):
    log = RollingLog(str(tmp_path / "log"), max_rows=5, columns=["seq", "v"])
    assert log.read(spark) is None and log.count(spark) == 0
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(12)], "seq bigint, v string")
    log.append(rows.filter("seq < 4"), 0)
    assert log.count(spark) == 4
    log.append(rows.filter("seq >= 4 AND seq < 9"), 1)
    log.append(rows.filter("seq >= 4 AND seq < 9"), 1)
    assert sorted(r["seq"] for r in log.read(spark).collect()) == [4, 5, 6, 7, 8]
    log.append(rows.filter("seq >= 9"), 2)
    small = log.compact(spark, str(tmp_path / "compact"))
    assert sorted(r["seq"] for r in spark.read.parquet(small.path).collect()) == [7, 8, 9, 10, 11]
    small.append(rows.filter("seq < 3"), 3)  # arrived last, although its numbers are small
    assert sorted(r["seq"] for r in small.read(spark).collect()) == [0, 1, 2, 10, 11]
    assert small.prune(spark) == [1] and sorted(r["seq"] for r in small.read(spark).collect()) == [0, 1, 2, 10, 11]
    assert log.prune(spark) == [0]
    with pytest.raises(ValueError):
        log.append(rows.withColumn("w", F.lit(1)), 3)
    with pytest.raises(ValueError):
        RollingLog("x", max_rows=0)


def test_seed_rows(spark):
    df = spark.createDataFrame([(i, 1.0 * i, "Benign" if i % 2 else "Scan") for i in range(10)], "id bigint, a double, Label string")
    got = seed_rows(df, 3, "id", ["a", "missing", "BinLabel"]).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(7.0, None, 0, 7), (8.0, None, 1, 8), (9.0, None, 0, 9)]


def test_stream_windows_equal_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = spark.createDataFrame([flow(i, i * 0.7, rng.choice("acd"), rng.choice("bx")) for i in range(150)], SCHEMA)
    t0 = rows.agg(F.min("timestamp")).first()[0]
    feed(rows, str(tmp_path / "in"), "timestamp", [t0 + dt.timedelta(seconds=s) for s in (30, 70)])
    stream = stream_hopping_features(readers.stream_flows(spark, str(tmp_path / "in"), rows.schema, "parquet"), "5s", "1s", watermark="2 seconds")
    got = {r["start_time"]: r for r in drain(stream, str(tmp_path)).collect()}
    want = {r["start_time"]: r for r in features.hopping_features(rows, "5s", "1s").collect()}
    whole = [s for s in want if want[s]["end_time"] <= t0 + dt.timedelta(seconds=149 * 0.7 - 2)]
    assert len(whole) > 90
    for s in whole:
        for c in features.WINDOW_FEATURES:
            assert got[s][c] == pytest.approx(want[s][c], rel=1e-12, abs=1e-12), (s, c)


def test_significance_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    data = [(i, rng.choice("xy"), rng.choice(["0", "1"]), rng.random() * (0.1 if (i // 50) % 2 else 1)) for i in range(300)]
    df = spark.createDataFrame(data, "seq bigint, stream string, class string, p_value double")
    feed(df, str(tmp_path / "in"), "seq", [90, 200])
    config = SignificanceConfig(window=20)
    stream = significance_stream(readers.stream_flows(spark, str(tmp_path / "in"), df.schema, "parquet"), "stream", config=config)
    got = {r["seq"]: r["alpha"] for r in drain(stream, str(tmp_path)).collect()}
    batch = control.adaptive_significance(df, config, ["seq"], ["stream"], block=40)
    assert got == pytest.approx({r["seq"]: r["alpha"] for r in batch.collect()})


def plain_loop(flags, config, mode="first", rate=0.0, tail=False):
    """(chunk_no, first, rows, drift, size after) of one sequence, chunk after chunk."""
    size, ema, drifts, at, wait, out = config.init_size, 0.0, 0, 0, 0, []
    while at < len(flags) and (at + size <= len(flags) or tail):
        own = flags[at : at + size]
        drift = {"first": own[0], "any": any(own), "rate": sum(own) > rate * len(own)}[mode]
        first, at = at, at + len(own)
        drifts += drift
        ema = config.ema_decay * ema + (1 - config.ema_decay) * (drifts / (len(out) + 1))
        if wait:
            wait -= 1
        else:
            if ema > config.shrink_above:
                size = max(config.min_size, size // 2)
            elif ema < config.grow_below:
                size = min(config.max_size, size + config.step)
            wait = config.cooldown
        out.append((len(out) + 1, first, len(own), bool(drift), size))
    return out


@pytest.mark.parametrize("mode,rate", [("first", 0.0), ("any", 0.0), ("rate", 0.2)])
def test_chunk_loop_equals_the_plain_fold(mode, rate):
    import pandas as pd

    rng = random.Random(4)
    for cooldown in (0, 2):
        config = ChunkConfig(init_size=7, max_size=60, cooldown=cooldown)
        flags = [rng.random() < (0.02 if (k // 400) % 2 else 0.3) for k in range(2000)]
        rows = pd.DataFrame({"seq": range(2000), "kind": None, "p_value": float("nan"), "row_drift": flags})
        loop, found, waiting = ChunkLoop(config, mode, rate), [], rows.iloc[:0]
        for low, high in ((0, 5), (5, 311), (311, 312), (312, 2000)):
            done, waiting = ChunkLoop.cut(loop, pd.concat([waiting, rows.iloc[low:high]]))
            loop = ChunkLoop(config, mode, rate).load(loop.dump())  # as after a restart
            found.append(done)
        done, _ = loop.cut(waiting, flush=True)
        rows = pd.concat([*found, done])
        got = [(n, int(g["seq"].min()), len(g), bool(g["drift"].iloc[0]), int(g["next_size"].iloc[0])) for n, g in rows.groupby("chunk_no")]
        assert got == plain_loop(flags, config, mode, rate, tail=True)


def test_chunks_with_adaptive_levels():
    import pandas as pd

    rng = random.Random(5)
    rows = pd.DataFrame({"seq": range(500), "kind": [rng.choice("ab") for _ in range(500)], "p_value": [rng.random() * 0.4 for _ in range(500)], "row_drift": False})
    settings = SignificanceConfig(window=6)
    done, _ = ChunkLoop(ChunkConfig(init_size=5, max_size=5, min_size=5), significance=settings).cut(rows)
    levels = control.Levels(settings)
    for k in range(0, 500, 5):
        levels.observe([rows["kind"][k]], [rows["p_value"][k]])
        assert done["alpha"][k] == levels.alpha(rows["kind"][k]) and done["drift"][k] == (rows["p_value"][k] < done["alpha"][k])


def test_chunk_stream_restart_gives_the_same_chunks(spark, tmp_path):
    rng = random.Random(6)
    data = [(i, "xy"[i % 2], rng.random() < 0.1) for i in range(500)]
    df = spark.createDataFrame(data, "seq bigint, stream string, drift boolean")
    config = ChunkConfig(init_size=10, max_size=40)

    def run(base, stops):
        # the stream is stopped after each part, in mid-chunk, and resumed from its checkpoint
        source, low = str(tmp_path / base / "in"), 0
        for high in [*stops, 500]:
            df.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(source)
            low = high
            out = drain(rechunk_stream(readers.stream_flows(spark, source, df.schema, "parquet"), "stream", config=config), str(tmp_path / base))
        return sorted(out.collect())

    once, thrice = run("once", []), run("thrice", [77, 301])
    assert once == thrice
    want = []
    for s in "xy":
        mine = [(i, d) for i, k, d in data if k == s]
        for no, first, rows, drift, after in plain_loop([d for _, d in mine], config):
            want += [(s, i, no, rows, drift, None, after, True) for i, _ in mine[first : first + rows]]
    assert [tuple(r) for r in once] == sorted(want)


def test_tails_come_out_when_their_time_has_passed(spark, tmp_path):
    """Event time: a stream's unfinished chunk is closed once the watermark is far enough ahead; no row is lost or repeated."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "xyz"[i % 3], i % 7 == 0, t0 + dt.timedelta(seconds=i)) for i in range(100)]
    rows += [(1000, "clock", False, t0 + dt.timedelta(hours=1)), (1001, "clock", False, t0 + dt.timedelta(hours=2)), (1002, "x", False, t0 + dt.timedelta(hours=2))]
    df = spark.createDataFrame(rows, "seq bigint, stream string, drift boolean, at timestamp")
    feed(df, str(tmp_path / "in"), "seq", [60, 1000, 1001, 1002])
    stream = readers.stream_flows(spark, str(tmp_path / "in"), df.schema, "parquet").withWatermark("at", "1 second")
    config = ChunkConfig(init_size=10, max_size=20)
    out = drain(rechunk_stream(stream, "stream", config=config, tail_after="5 minutes", ts="at"), str(tmp_path)).filter("stream <> 'clock'")
    got = {}
    for r in out.filter("seq < 1000").collect():
        got.setdefault((r["stream"], r["chunk_no"]), []).append((r["seq"], r["whole"]))
    assert sorted(i for c in got.values() for i, _ in c) == list(range(100))
    for s in "xyz":
        mine = [(i, d) for i, k, d, _ in rows[:100] if k == s]
        want = plain_loop([d for _, d in mine], config, tail=True)
        assert [sorted(got[s, no]) for no, *_ in want] == [[(i, n < len(want)) for i, _ in mine[f : f + c]] for n, f, c, *_ in want]
    table = chunk_table(out).filter("NOT whole")
    assert {r["stream"] for r in table.collect()} >= set("xyz")


def test_progress_of_more_than_a_hundred_batches(spark, tmp_path):
    for k in range(105):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k:03d}.csv").write_text("".join(f"{i}\n" for i in range(k % 3 + 1)))
    log = ProgressLog(spark, str(tmp_path / "progress"), every=20)
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema("a int").option("maxFilesPerTrigger", 1).csv(str(tmp_path / "in"))
        q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        log.wait_for(q)
    finally:
        spark.streams.removeListener(log)
    rows = log.table().filter("rows > 0").collect()
    assert len(rows) == 105 and sum(r["rows"] for r in rows) == sum(k % 3 + 1 for k in range(105)) and len(q.recentProgress) <= 100


COLUMNS = ["a", "b"]


def _flows(spark, n, shift=0.0, start=0, seed=1, apart=2.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.random() < 0.5
        rows.append((start + i, rng.gauss(apart * y + shift, 1.0), rng.gauss(0, 1), int(y)))
    return spark.createDataFrame(rows, "id bigint, a double, b double, BinLabel int")


def _run(spark, base, **settings):
    config = DriftConfig(variant="dt", conformal=ConformalConfig(evaluator=settings.pop("evaluator", "ice"), folds=2, mode=settings.pop("mode", "any")), max_rows=150, **settings)
    return DriftStream(spark, str(base), COLUMNS, config, order="id", truth="BinLabel", classifier_params={"maxDepth": 3})


def test_drift_stream_retrains_and_repeats_cleanly(spark, tmp_path):
    run = _run(spark, tmp_path)
    run.seed(_flows(spark, 300))
    first, second = (_flows(spark, 120, shift=1.0, start=1000 * k, seed=1 + k, apart=0.0) for k in (1, 2))
    run.process(first, 0)
    run.process(second, 1)
    before = {r["chunk_id"]: (r["drift"], r["version"], r["retrained"], r["rows"]) for r in run.chunks().collect()}
    assert before[0][:2] == (True, -1) and before[0][2]
    assert before[1][1] == 0  # the version fitted after batch 0 serves batch 1
    labels = {(r["label_source"], r["drift"]) for r in run.log.read(spark).select("label_source", "drift").distinct().collect()}
    assert ("prediction", True) in labels
    assert run.log.count(spark) == 150
    scored = run.scored().count()
    # batch 1 again, as after a failure, by a new process
    again = _run(spark, tmp_path)
    again.process(second, 1)
    after = {r["chunk_id"]: (r["drift"], r["version"], r["retrained"], r["rows"]) for r in again.chunks().collect()}
    assert after == before and again.scored().count() == scored
    assert again.calibrations().count() == 1 + sum(r[2] for r in before.values())
    assert again.quality().first()["accuracy"] > 0.3
    assert again.latency().first()["chunks"] == 2


@pytest.mark.parametrize("significance", [None, SignificanceConfig(window=20)])
def test_drift_stream_cuts_adaptive_chunks(spark, tmp_path, significance):
    """Chunks of a fixed model equal the plain fold over all its rows, whatever the micro-batches, also when one is repeated."""
    config = ChunkConfig(init_size=8, max_size=30)
    first, second, third = (_flows(spark, n, shift=s, start=1000 * k, seed=k) for k, (n, s) in enumerate([(45, 0.0), (30, 2.0), (47, 0.5)], 1))

    def run(base, batches):
        stream = _run(spark, tmp_path / base, mode="first" if significance else "any", adaptive_chunks=config, significance=significance)
        stream.retrain = False
        stream.seed(_flows(spark, 200))
        for k, b in enumerate(batches):
            stream.process(b, k)
        return stream

    parts = run("parts", [first, second, second.limit(0), third])
    parts.process(third, 3)  # as after a failure
    whole = run("whole", [first.unionByName(second).unionByName(third)])
    scored = parts.scored().orderBy("seq").collect()
    for stream in (parts, whole):
        stream.finish()
        got = [tuple(r) for r in stream.adaptive_chunks().orderBy("chunk_no").select("chunk_no", "first_seq", "rows", "drift", "next_size").collect()]
        assert sum(r[2] for r in got) == 122
        if significance is None:
            want = plain_loop([r["row_drift"] for r in scored], config, "any", tail=True)
            assert got == [(no, scored[f]["seq"], n, d, size) for no, f, n, d, size in want]
    tables = [sorted(map(tuple, s.adaptive_chunks().collect()), key=repr) for s in (parts, whole)]
    assert tables[0] == tables[1]
    assert len(parts._batches("state")) == 4  # the seed and three batches with rows


def test_state_rows_are_found_by_name_and_stay_few(spark, tmp_path):
    run = _run(spark, tmp_path)
    for b in range(-1, 40):
        run._keep_state(b, version=b)
    assert run._batches("state") == list(range(30, 40))
    assert run._state_before(36) == (35, {"version": 35, "controller": None, "learned": None, "loop": None}) and run._state_before(30)[0] is None


def test_bootstrap_then_score(spark, tmp_path):
    run = _run(spark, tmp_path, evaluator="approx_cce")
    run.process(_flows(spark, 200), 0)
    assert run.scored() is None and run.chunks() is None
    seen = []
    run.on_batch = lambda df, i: seen.append((i, df.count()))
    run.process(_flows(spark, 50, start=500, seed=5).limit(0), 1)
    run.process(_flows(spark, 50, start=500, seed=5), 2)
    assert seen == [(2, 50)] and run.scored().count() == 50


def test_one_class_log_is_not_refitted(spark, tmp_path):
    run = _run(spark, tmp_path, mode="rate")
    with pytest.raises(ValueError):
        run.seed(_flows(spark, 50).withColumn("BinLabel", F.lit(0)))


@pytest.mark.parametrize("settings", [{"significance": SignificanceConfig(window=20), "evaluator": "cce", "mode": "first"},
                                      {"scope": "evaluator_only"}, {"evaluator": "none"}, {"use_pca": True, "evaluator": "approx_tce"}])
def test_drift_stream_settings(spark, tmp_path, settings):
    run = _run(spark, tmp_path, **settings)
    run.seed(_flows(spark, 200))
    run.process(_flows(spark, 60, shift=3.0, start=400, seed=4).withColumn("b", F.when(F.col("id") % 3 > 0, F.col("b"))), 0)
    run.process(_flows(spark, 60, shift=3.0, start=500, seed=5), 1)
    rows = run.chunks().orderBy("chunk_id").collect()
    assert [r["rows"] for r in rows] == [60, 60]
    if "significance" in settings:
        assert all(0.05 <= r["alpha"] <= 0.3 for r in rows)
    if settings.get("evaluator") == "none":
        assert not any(r["drift"] for r in rows)


def test_replay_with_a_fixed_model(spark):
    from flowdrift.plans.drift import replay

    train = _flows(spark, 300)
    flows = _flows(spark, 90, start=1000, seed=2).unionByName(_flows(spark, 60, shift=1.0, start=2000, seed=3, apart=0.0))
    flows = flows.withColumn("b", F.when(F.col("id") % 5 > 0, F.col("b")))
    config = DriftConfig(variant="dt", conformal=ConformalConfig(evaluator="ice", mode="rate", rate=0.5), chunk_size=40)
    scored, chunks = replay(train, flows, COLUMNS, config, "id", maxDepth=3)
    assert scored.count() == 150 and scored.filter("p_value IS NULL").count() == 0
    rows = chunks.orderBy("chunk_id").collect()
    assert [r["rows"] for r in rows] == [40, 40, 40, 30]
    assert rows[3]["drift"] and not rows[0]["drift"]
    steered = DriftConfig(variant="dt", chunk_size=10, significance=SignificanceConfig(window=5))
    _, chunks = replay(train, flows, COLUMNS, steered, "id", maxDepth=3)
    assert {"alpha", "drift", "drift_ema"} <= set(chunks.columns) and chunks.count() == 15


def test_drift_stream_with_neighbours_goes_on_after_a_restart(spark, tmp_path):
    config = DriftConfig(variant="knn", conformal=ConformalConfig(evaluator="ice", folds=2, mode="any"), max_rows=150)
    stream = lambda: DriftStream(spark, str(tmp_path), COLUMNS, config, order="id", truth="BinLabel")
    run = stream()
    run.seed(_flows(spark, 200))
    batch = _flows(spark, 60, start=1000, seed=5)
    run.process(batch, 0)
    kept = ["id", "prediction", "p_value"]
    before = sorted(run.scored().select(*kept).collect())
    again = stream()  # reads the saved model
    again.process(batch, 0)
    assert sorted(again.scored().select(*kept).collect()) == before and len(before) == 60


@pytest.mark.parametrize(("kind", "params"), [("svm", {"maxIter": 10}), ("mlp", {"maxIter": 10})])
def test_evaluator_with_a_model_of_its_own(spark, tmp_path, kind, params):
    config = DriftConfig(
        variant="dt", conformal=ConformalConfig(evaluator="approx_tce", mode="any"), max_rows=150, evaluator_model=kind, evaluator_params=params
    )
    stream = lambda: DriftStream(spark, str(tmp_path), COLUMNS, config, order="id", truth="BinLabel", classifier_params={"maxDepth": 3})
    run = stream()
    run.seed(_flows(spark, 200))
    batch = _flows(spark, 60, start=1000, seed=5)
    run.process(batch, 0)
    kept = ["id", "prediction", "class", "p_value"]
    before = sorted(run.scored().select(*kept).collect())
    assert len(before) == 60 and all(0 < r["p_value"] <= 1 for r in before)
    model = run._held
    judge, own = model.evaluator.models[0], model.classifier
    stages = [type(s).__name__ for s in (judge.stages if hasattr(judge, "stages") else [judge])]
    assert ("LinearSVCModel" in stages) if kind == "svm" else stages == ["MultilayerPerceptronClassificationModel"]
    assert [type(s).__name__ for s in own.stages] == ["DecisionTreeClassificationModel"]
    again = stream()  # reads the saved models
    again.process(batch, 0)
    assert sorted(again.scored().select(*kept).collect()) == before


def test_evaluator_model_settings():
    with pytest.raises(ValueError):
        DriftConfig(evaluator_model="tree")
    with pytest.raises(ValueError):
        DriftConfig(evaluator_params={"maxIter": 3})


def test_a_long_step_arrives_as_several_files(spark, monkeypatch):
    """No single task writes a step; a micro-batch still holds a whole step, and controllers go through it in slices."""
    from flowdrift.config import ChunkConfig, SignificanceConfig
    from flowdrift.operators.control import Levels
    from flowdrift.plans import queries_streams as q
    from flowdrift.sources import readers
    from flowdrift.streaming import chunks, state

    monkeypatch.setattr(q, "ARRIVING_ROWS", 20_000)
    n = 2 * max(state.SLICE_ROWS, chunks.SLICE_ROWS) + 20_000
    rows = spark.range(n).select(
        F.col("id").alias("seq"), F.lit("one").alias("key"), F.concat(F.lit("c"), F.pmod(F.xxhash64("id"), F.lit(3))).alias("class"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000).alias("p_value"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(9)) == 0).alias("row_drift"),
    ).withColumn("row_drift", F.when(F.col("seq") % 7 != 0, F.col("row_drift")))
    path, schema, files = q.arriving(rows, "seq", 2)
    assert files == n // 2 // 20_000
    stream = lambda: readers.stream_flows(spark, path, schema, "parquet", files)
    sizes = []
    stream().writeStream.foreachBatch(lambda df, i: sizes.append(df.count())).option("checkpointLocation", q.scratch(spark)).trigger(
        availableNow=True
    ).start().awaitTermination()
    assert sizes == [n // 2, n // 2]
    plain = rows.orderBy("seq").toPandas()
    got = q.drained(state.significance_stream(stream(), "key")).orderBy("seq").toPandas()
    expected = Levels(SignificanceConfig()).scan(plain["class"].to_numpy(dtype=object), plain["p_value"].to_numpy(dtype=float))
    assert (got["seq"] == plain["seq"]).all() and (got["class"] == plain["class"]).all() and (got["alpha"] == expected).all()
    cut = q.drained(chunks.chunk_stream(stream(), "key", mode="rate", rate=0.1)).orderBy("seq").toPandas()
    whole, rest = chunks.ChunkLoop(ChunkConfig(), "rate", 0.1).cut(plain.rename(columns={"class": "kind"}).astype({"row_drift": "boolean"}))
    assert len(cut) == n - len(rest) and (cut["seq"] == whole["seq"]).all()
    assert all((cut[c] == whole[c]).all() for c in ("chunk_no", "chunk_rows", "drift", "next_size"))
