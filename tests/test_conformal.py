"""Conformal scores, metrics and controllers against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowdrift.config import ChunkConfig, ConformalConfig, DriftConfig, SignificanceConfig
from flowdrift.operators import conformal, control, metrics
from flowdrift.operators.evaluators import make_evaluator

RNG = random.Random(3)


def plain_levels(alphas, seen, config, cls, p):
    """One row of the significance controller, written out."""
    alphas.setdefault(cls, config.min_alpha)
    seen.setdefault(cls, []).append(p)
    for c, values in seen.items():
        last = values[-config.window :]
        rate = sum(v < alphas[c] for v in last) / len(last)
        up, down = min(alphas[c] + config.step, config.max_alpha), max(alphas[c] - config.step, config.min_alpha)
        alphas[c] = round(up if rate > config.increase_above else down if rate < config.decrease_below else alphas[c], 10)


CAL = [("hot" if i % 3 else RNG.choice("ab"), round(RNG.random(), 2)) for i in range(500)]
TEST = [(i, RNG.choice(["hot", "a", "b", "new"]), round(RNG.random(), 2)) for i in range(400)]


def _plain_p(cls, score):
    known = [s for c, s in CAL if c == cls]
    return (sum(s >= score for s in known) + 1) / (len(known) + 1) if known else None


def test_p_values(spark):
    counts = conformal.calibration_counts(spark.createDataFrame(CAL, "class string, score double"))
    test = spark.createDataFrame(TEST, "id int, class string, score double")
    out = conformal.p_values(test, counts)
    got = {r["id"]: r["p_value"] for r in out.collect()}
    for i, cls, score in TEST:
        want = _plain_p(cls, score)
        assert got[i] == want if want is None else abs(got[i] - want) < 1e-15 and 0 < got[i] <= 1


def test_p_values_with_number_classes_and_null_scores(spark):
    counts = conformal.calibration_counts(spark.createDataFrame([(0, 0.1), (0, 0.9), (1, 0.5), (None, 0.3), (0, float("nan"))], "class int, score double"))
    assert sum(r["n"] for r in counts.collect()) == 3
    test = spark.createDataFrame([(0, 0.5), (1, 0.6), (2, 0.1), (0, None), (1, float("nan")), (None, 0.2)], "class int, score double")
    got = [r["p_value"] for r in conformal.p_values(test, counts).orderBy("class", F.desc("score")).collect()]
    assert got == [None, 2 / 3, None, None, 0.5, None]


def test_thresholds_and_drift_rules(spark):
    cal = spark.createDataFrame(CAL, "class string, score double")
    limits = conformal.class_thresholds(cal, 0.05)
    got = {r["class"]: r["threshold"] for r in limits.collect()}
    for cls, value in got.items():
        assert abs(value - np.quantile([s for c, s in CAL if c == cls], 0.95)) < 1e-12
    rows = spark.createDataFrame(
        [(0, 0, "hot", 0.99), (0, 1, "hot", 0.01), (1, 2, "new", 0.0), (1, 3, "a", None)], "chunk int, seq int, class string, p_value double"
    )
    flagged = conformal.drift_flags(rows, limits)
    by = lambda mode, **k: {r["chunk"]: r["drift"] for r in conformal.detect_drift(flagged, ["chunk"], "seq", mode, **k).collect()}
    assert by("first") == {0: False, 1: False}
    assert by("any") == {0: True, 1: False}
    assert by("rate", rate=0.4) == {0: True, 1: False}
    assert conformal.drift_flags(rows, limits, "epsilon").filter("drift").count() == 2
    with pytest.raises(ValueError):
        conformal.detect_drift(flagged, ["chunk"], "seq", "last")


def test_fold_votes(spark):
    df = spark.createDataFrame([(1, [2, 1, 1, 2], [0.1, 0.2, 0.3, 0.4]), (2, [0, 5, 5, 5], [0.0, 0.0, 0.3, 0.1])], "id int, p array<int>, s array<double>")
    flat = df.select("id", *[F.col("p")[i].alias(f"p{i}") for i in range(4)], *[F.col("s")[i].alias(f"s{i}") for i in range(4)])
    combined = conformal.combine_folds(flat, [f"p{i}" for i in range(4)], [f"s{i}" for i in range(4)])
    wide = {r["id"]: (r["class"], round(r["score"], 9)) for r in combined.collect()}
    assert wide == {1: (1, 0.25), 2: (5, 0.1)}
    long = df.select("id", F.explode(F.arrays_zip("p", "s")).alias("z")).select("id", F.col("z.p").alias("prediction"), F.col("z.s").alias("score"))
    again = {r["id"]: (r["class"], round(r["score"], 9)) for r in conformal.combine_folds_long(long, ["id"]).collect()}
    assert again == wide
    assert {r["id"]: r["v"] for r in df.select("id", conformal.vote(F.col("p")).alias("v")).collect()} == {1: 1, 2: 5}


def test_many_folds_are_combined_by_a_short_plan(spark):
    """Ten models: comparing their columns pairwise made a hundred comparisons of generated code."""
    names = [(f"p{i}", f"s{i}") for i in range(10)]
    df = spark.range(9).select("id", *[((F.col("id") * 7 + i * i) % 4).cast("int").alias(p) for i, (p, _) in enumerate(names)], *[(F.col("id") / 10 + i).alias(s) for i, (_, s) in enumerate(names)])
    combined = conformal.combine_folds(df, *map(list, zip(*names)))
    assert combined._jdf.queryExecution().analyzed().toString().count(" = ") < 20
    for r in combined.collect():
        votes = [r[p] for p, _ in names]
        assert r["class"] == min(votes, key=lambda c: (-votes.count(c), c)) and abs(r["score"] - np.mean([r[s] for _, s in names])) < 1e-12


@pytest.mark.parametrize("kind", ["ice", "cce"])
def test_rows_are_scored_once(spark, kind):
    """The p-values read stored scores, so no model runs a second time behind them."""
    from flowdrift.operators import ml

    df = spark.range(200).select(
        F.col("id").alias("event_id"), ml.array_to_vector(F.array(F.col("id") % 7 + 0.0, F.col("id") % 3 + 0.0)).alias("features"), (F.col("id") % 7 > 3).cast("double").alias("label")
    )
    calibrated = make_evaluator(kind)(df, ml.make_estimator("dt", maxDepth=3), ConformalConfig(evaluator=kind, folds=3), "event_id")
    judged = calibrated.predict(df)
    assert "UDF" not in judged._jdf.queryExecution().optimizedPlan().toString()
    assert judged.filter("class = label AND p_value BETWEEN 0 AND 1").count() == 200


def test_metrics_zero_division(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    m = metrics.binary_metrics(pairs).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"], m["specificity"]) == (2 / 3, 0.0, 0.0, 0.0, 1.0)
    report = {r["class"]: (r["precision"], r["support"]) for r in metrics.classification_report(pairs).collect()}
    assert report == {0: (2 / 3, 2), 1: (0.0, 1)}
    matrix = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(pairs, labels=[0, 1, 2]).collect()}
    assert len(matrix) == 9 and matrix[(1, 0)] == 1 and matrix[(2, 2)] == 0
    assert metrics.model_metrics(pairs, 3).columns == ["accuracy", "precision", "recall", "f1"]


def test_class_only_predicted(spark):
    pairs = spark.createDataFrame([(0, 2), (1, 1)], "label int, prediction int")
    report = {r["class"]: (r["precision"], r["recall"], r["support"]) for r in metrics.classification_report(pairs).collect()}
    assert report == {0: (0.0, 0.0, 1), 1: (1.0, 1.0, 1), 2: (0.0, 0.0, 0)}


def test_timing_summary_single_value(spark):
    r = metrics.timing_summary(spark.createDataFrame([(2.0,)], "t double"), "t").first()
    assert (r["count"], r["mean"], r["median"], r["std"], r["min"], r["max"]) == (1, 2.0, 2.0, None, 2.0, 2.0)


# Controllers --------------------------------------------------------------------


@pytest.mark.parametrize("config", [SignificanceConfig(window=10), SignificanceConfig(window=25, step=0.07), SignificanceConfig()])
def test_adaptive_significance_equals_fold(spark, config):
    rng = random.Random(config.window)
    data = []
    for s in ("x", "y"):
        for i in range(400):
            cls = "hot" if rng.random() < 0.8 else rng.choice(["rare", "odd"])
            low = (i // 60) % 2 == 0
            data.append((s, i, cls, rng.random() * (0.2 if low else 1.0)))
    df = spark.createDataFrame(data, "stream string, step int, class string, p_value double").repartition(5)
    out = control.adaptive_significance(df, config, ["step"], ["stream"], block=37)
    got = {(r["stream"], r["step"]): r["alpha"] for r in out.collect()}
    assert len(got) == len(data)
    levels = set()
    for s in ("x", "y"):
        alphas, seen = {}, {}
        for stream, i, cls, p in data:
            if stream == s:
                plain_levels(alphas, seen, config, cls, p)
                levels.add(alphas[cls])
                assert got[(s, i)] == pytest.approx(alphas[cls], abs=1e-9), (s, i, cls)
    assert len(levels) > 3


@pytest.mark.parametrize("config", [ChunkConfig(), ChunkConfig(cooldown=3, step=7, max_size=60), ChunkConfig(ema_decay=0.5, init_size=40)])
def test_adaptive_chunks_equal_fold(spark, config):
    rng = random.Random(9)
    data = [(s, n, rng.random() < (0.6 if (n // 80) % 2 else 0.01) * (s == "x")) for s in ("x", "y") for n in range(1, 301)]
    df = spark.createDataFrame(data, "stream string, chunk_no bigint, drift boolean").repartition(5)
    got = {(r["stream"], r["chunk_no"]): (r["drift_ema"], r["chunk_size"]) for r in control.adaptive_chunks(df, config, by=["stream"], block=29).collect()}
    sizes = set()
    for s in ("x", "y"):
        size, ema, drifts = config.init_size, 0.0, 0
        for stream, n, drift in data:
            if stream == s:
                drifts += drift
                ema = config.ema_decay * ema + (1 - config.ema_decay) * drifts / n
                if (n - 1) % (config.cooldown + 1) == 0 and ema > config.shrink_above:
                    size = max(config.min_size, size // 2)
                elif (n - 1) % (config.cooldown + 1) == 0 and ema < config.grow_below:
                    size = min(config.max_size, size + config.step)
                sizes.add(size)
                assert got[(s, n)][1] == size and abs(got[(s, n)][0] - ema) < 1e-9
    assert len(sizes) > 3


def test_adaptive_significance_goes_on_from_a_controller(spark):
    """Calibration scores first, then rows: as one fold; classes without calibration rows start at the lowest level."""
    config, rng = SignificanceConfig(window=9), random.Random(12)
    before = [(rng.choice("ab"), rng.random() * 0.2) for _ in range(40)]
    rows = [(i, rng.choice("abc"), rng.random() * (0.2 if i % 70 < 30 else 1.0)) for i in range(300)]
    start, alphas, seen = control.Levels(config), {}, {}
    for cls, p in before:
        start.observe([cls], [p])
        plain_levels(alphas, seen, config, cls, p)
    df = spark.createDataFrame(rows, "step int, class string, p_value double").repartition(3)
    got = {r["step"]: r["alpha"] for r in control.adaptive_significance(df, config, ["step"], block=23, start=start).collect()}
    assert len(got) == len(rows)
    for i, cls, p in rows:
        plain_levels(alphas, seen, config, cls, p)
        assert got[i] == pytest.approx(alphas[cls], abs=1e-9), i


def test_drift_ema_without_stream_key(spark):
    flags = [i % 4 == 0 for i in range(50)]
    df = spark.createDataFrame([(i + 1, f) for i, f in enumerate(flags)], "chunk_no bigint, drift boolean")
    got = {r["chunk_no"]: r["drift_ema"] for r in control.drift_ema(df, block=7).collect()}
    ema = 0.0
    for i in range(50):
        ema = 0.9 * ema + 0.1 * sum(flags[: i + 1]) / (i + 1)
        assert abs(got[i + 1] - ema) < 1e-12


def test_alpha_levels_are_closed():
    levels, up, down = control.alpha_levels(SignificanceConfig())
    assert levels[0] == 0.05 and levels[-1] == 0.3 and len(levels) < 40
    assert all(0 <= i < len(levels) for i in [*up, *down])


# Settings -----------------------------------------------------------------------


@pytest.mark.parametrize(
    "make",
    [
        lambda: ChunkConfig(init_size=0),
        lambda: ChunkConfig(min_size=5, max_size=4),
        lambda: ChunkConfig(ema_decay=1.5),
        lambda: ChunkConfig(cooldown=-1),
        lambda: ConformalConfig(evaluator="tce"),
        lambda: ConformalConfig(folds=1),
        lambda: ConformalConfig(significance=1.0),
        lambda: DriftConfig(conformal=ConformalConfig(mode="any"), significance=SignificanceConfig()),
        lambda: DriftConfig(threshold=2.0),
        lambda: DriftConfig(chunk_size=0),
        lambda: DriftConfig(variant="forest"),
        lambda: make_evaluator("other"),
    ],
)
def test_bad_settings_are_refused(make):
    with pytest.raises(ValueError):
        make()


def test_defaults():
    assert (ConformalConfig().folds, ConformalConfig().significance, ConformalConfig().calibration_split) == (10, 0.05, 0.2)
    assert (ChunkConfig().init_size, ChunkConfig().max_size, ChunkConfig().step) == (10, 1000, 5)
    assert make_evaluator("none") is None


def test_trailing_rates():
    p = np.array([0.01, 0.5, 0.02, 0.9])
    rates = control.trailing_rates(p, 2, np.array([0.05, 0.6]))
    assert pd.DataFrame(rates).round(3).values.tolist() == [[1.0, 1.0], [0.5, 1.0], [0.5, 1.0], [0.5, 0.5]]
