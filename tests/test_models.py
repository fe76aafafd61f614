"""Scaling, projection, classifiers, neighbours and explanations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flowdrift.config import ConformalConfig
from flowdrift.operators import explain, ml, neighbours
from flowdrift.operators.evaluators import Calibrated, make_evaluator
from flowdrift.sources import sinks

RNG = np.random.default_rng(4)
N = 400
X = RNG.normal(size=(N, 4)) * [1, 5, 0.1, 1] + [0, 10, 3, 0]
X[:, 3] = 7.0
Y = (X[:, 0] + 0.2 * (X[:, 1] - 10) + RNG.normal(scale=0.3, size=N) > 0).astype(int)
Z = np.digitize(X[:, 0], [-0.5, 0.5])
COLUMNS = ["a", "b", "c", "constant"]


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, *map(float, x), float(y), float(z)) for i, (x, y, z) in enumerate(zip(X, Y, Z))]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, constant double, label double, kind double").repartition(3).cache()


def test_standardize_is_population_scaled(data):
    got = np.array(ml.standardize(data, COLUMNS).orderBy("id").select(*COLUMNS).collect())
    std = X.std(axis=0)
    std[3] = 1.0
    assert np.allclose(got, (X - X.mean(axis=0)) / std)
    stages, vector = ml.fit_features(data, COLUMNS)
    again = PipelineModel(stages=stages).transform(data).orderBy("id").select(vector_to_array(vector).alias("v")).collect()
    assert np.allclose(np.array([r["v"] for r in again]), got)


def test_pca_keeps_95_percent(spark, data):
    stages, vector = ml.fit_features(data, COLUMNS[:3], use_pca=True)
    z = (X[:, :3] - X[:, :3].mean(axis=0)) / X[:, :3].std(axis=0)
    shares = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    shares = shares / shares.sum()
    k = int(np.searchsorted(shares.cumsum(), 0.95) + 1)
    assert len(PipelineModel(stages=stages).transform(data).first()[vector]) == k
    table = ml.explained_variance_table(stages[-2], spark).collect()
    assert [r["explained_pct"] for r in table] == [round(s * 100, 1) for s in shares]
    assert table[-1]["cumulative_pct"] == 100.0
    few = PCA(k=1, inputCol="features", outputCol="p").fit(PipelineModel(stages=stages[:2]).transform(data))
    assert ml.components_needed(few) == 1


def test_forest_is_fitted_on_bounded_slices(data, monkeypatch):
    """Spark's fit holds a count for each row and tree, so the rows are cut into slices by their number and that of the trees."""
    seen = []
    plain = ml.RandomForestClassifier._fit
    monkeypatch.setattr(ml.RandomForestClassifier, "_fit", lambda self, rows: (seen.append((rows.rdd.getNumPartitions(), rows.count())), plain(self, rows))[1])
    monkeypatch.setattr(ml, "FOREST_VALUES", 100)
    stages, vector = ml.fit_features(data, COLUMNS)
    prepared = PipelineModel(stages=stages).transform(data).select(vector, "label")
    model = ml.make_estimator("rf", numTrees=5, maxDepth=4).copy().fit(prepared)
    assert seen == [(N * 5 // 100, N)] and model.getNumTrees == 5
    assert model.transform(prepared).filter("prediction = label").count() > 0.9 * N


@pytest.mark.parametrize(
    ("variant", "extra"),
    [("dt", {"maxDepth": 4}), ("rf", {"numTrees": 5, "maxDepth": 4}), ("gbt", {"maxIter": 3, "maxDepth": 3}),
     ("svm", {"kernel": "linear"}), ("svm", {"kernel": "poly", "degree": 2, "maxIter": 10}),
     ("svm", {"kernel": "rbf", "dims": 64, "maxIter": 20}), ("mlp", {"maxIter": 30}), ("knn", {})],
)
def test_binary_variants_learn_and_give_probabilities(data, variant, extra):
    model = ml.train(data, COLUMNS, variant=variant, **extra)
    out = ml.score(data, model).select("label", "prediction", vector_to_array("probability").alias("p"), "predicted_name").collect()
    assert len(out) == N
    assert np.mean([r["label"] == r["prediction"] for r in out]) > 0.8
    assert all(abs(sum(r["p"]) - 1) < 1e-9 and len(r["p"]) == 2 for r in out)
    assert {r["predicted_name"] for r in out} == {"Attack", "Benign"}


@pytest.mark.parametrize(("variant", "extra"), [("dt", {"maxDepth": 5}), ("gbt", {"maxIter": 2, "maxDepth": 3}), ("svm", {"kernel": "rbf", "dims": 64, "maxIter": 20}), ("mlp", {"maxIter": 40}), ("knn", {})])
def test_multi_variants(data, variant, extra):
    rows = data.drop("label").withColumnRenamed("kind", "label")
    model = ml.train(rows, COLUMNS, variant=variant, task="multi", n_classes=3, **extra)
    out = ml.score(rows, model, task="multi", names=["low", "mid", "high"]).collect()
    assert np.mean([r["label"] == r["prediction"] for r in out]) > 0.75
    assert {r["predicted_name"] for r in out} <= {"low", "mid", "high"}


def test_unknown_variant_and_kernel():
    with pytest.raises(ValueError):
        ml.make_estimator("tree")
    with pytest.raises(ValueError):
        ml.make_estimator("svm", kernel="sigmoid")


def test_missing_feature_takes_training_mean(data):
    model = ml.train(data, COLUMNS, variant="dt", maxDepth=3)
    mean = float(X[:, 1].mean())
    absent = {r["id"]: r["prediction"] for r in ml.score(data.drop("b"), model).collect()}
    filled = {r["id"]: r["prediction"] for r in ml.score(data.withColumn("b", F.lit(mean)), model).collect()}
    assert absent == filled


def test_threshold_moves_predictions(data):
    model = ml.train(data, COLUMNS, variant="rf", numTrees=5, maxDepth=4)
    ones = [ml.score(data, model, threshold=t).filter("prediction = 1").count() for t in (0.1, 0.5, 0.9)]
    assert ones[0] > ones[1] > ones[2]


def test_pipeline_round_trip(data, tmp_path):
    for variant, extra in (("dt", {"maxDepth": 3}), ("svm", {"kernel": "rbf", "dims": 16, "maxIter": 5})):
        model = ml.train(data, COLUMNS, variant=variant, use_pca=True, **extra)
        sinks.save_pipeline(model, str(tmp_path), "set", "binary", variant)
        loaded = sinks.load_pipeline(str(tmp_path), "set", "binary", variant)
        assert ml.model_columns(loaded) == COLUMNS
        a = {r["id"]: r["prediction"] for r in ml.score(data, model).collect()}
        assert a == {r["id"]: r["prediction"] for r in ml.score(data, loaded).collect()}
    with pytest.raises(ValueError):
        sinks.pipeline_path("b", "d", "other", "dt")
    assert sinks.dataset_name("/data/BAR/agg.csv") == "BAR"


def test_cv_accuracy(data):
    stages, _ = ml.fit_features(data, COLUMNS)
    prepared = PipelineModel(stages=stages).transform(data).select("id", "features", "label")
    folds = ml.cv_accuracy(prepared, ml.make_estimator("dt", maxDepth=3), "id")
    values = [r["accuracy"] for r in folds.collect()]
    s = ml.cv_summary(folds).first()
    assert len(values) == 5 and abs(s["mean_accuracy"] - np.mean(values)) < 1e-12 and abs(s["std_accuracy"] - np.std(values)) < 1e-12


@pytest.mark.parametrize("bounds", [{}, {"block_rows": 40, "test_rows": 50}])
def test_knn_against_brute_force(spark, bounds):
    points = RNG.integers(0, 6, size=(130, 3)).astype(float)  # many equal distances
    labels = RNG.integers(0, 3, size=130)
    df = spark.createDataFrame([(i, p.tolist(), int(c)) for i, (p, c) in enumerate(zip(points, labels))], "id bigint, x array<double>, label int").repartition(4)
    near = neighbours.knn(df, df, 4, "id", "x", "id", "label", **bounds)
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in near.collect()}
    votes = {r["id"]: r["v"] for r in near.select("id", neighbours.knn_vote(F.col("neighbours")).alias("v")).collect()}
    for i, p in enumerate(points):
        order = sorted(range(130), key=lambda j: (((points[j] - p) ** 2).sum(), j))[:4]
        assert got[i] == order
        tally = np.bincount(labels[order], minlength=3)
        assert votes[i] == tally.argmax()


def test_knn_leaves_out_far_blocks(spark):
    """Groups of points, one of them a third of all rows and in one place: a row meets few blocks, its neighbours are right."""
    centres = RNG.normal(size=(20, 4)) * 40
    points = centres[RNG.integers(0, 20, 1200)] + RNG.normal(size=(1200, 4))
    points[:400] = centres[0]
    frame = [(i, p.tolist(), i % 3) for i, p in enumerate(points)]
    df = spark.createDataFrame(frame, "id bigint, x array<double>, label int").repartition(4)
    rows = df.select(F.col("id").alias("_id"), F.col("label").cast("bigint").alias("_label"), F.col("x").alias("_x"))
    blocks = neighbours.cut_blocks(rows, 50)
    assert blocks.size.max() <= 50 and blocks.size.sum() == 1200 and len(blocks.size) >= 24
    placed = neighbours.homes(df, blocks, "id", "x")
    first = neighbours._visit(placed, blocks, 3, "id", 100, 1)
    # the crowded place has 8 blocks of equal rows, which all have to be met for the smallest ids
    assert neighbours.visits(first, placed, blocks, 3, "id").count() < 0.25 * 1200 * len(blocks.size)
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in neighbours.knn(df, df, 3, "id", "x", "id", "label", block_rows=50, test_rows=100).collect()}
    squared = np.round(((points[:, None] - points[None]) ** 2).sum(axis=2), 9)
    assert got == {i: np.lexsort((np.arange(1200), squared[i]))[:3].tolist() for i in range(1200)}


def test_knn_copies_no_row_for_each_small_block(spark):
    """Evenly filled space: every block is met, but a row is copied once for each shelf of blocks, and copies of a vector are left out."""
    points = np.vstack([RNG.uniform(size=(1500, 12))] + [RNG.uniform(size=(1, 12))] * 300)
    frame = [(i, p.tolist(), i % 3) for i, p in enumerate(points)]
    df = spark.createDataFrame(frame, "id bigint, x array<double>, label int").repartition(4)
    rows = df.select(F.col("id").alias("_id"), F.col("label").cast("bigint").alias("_label"), F.col("x").alias("_x"))
    few = neighbours.distinct_enough(rows, 3)
    assert few.count() == 1503
    blocks = neighbours.cut_blocks(few, 20)
    placed = neighbours.homes(df, blocks, "id", "x")
    first = neighbours._visit(placed, blocks, 3, "id", 40, 1)
    shelf = neighbours._groups(blocks.size, 200)
    assert (np.diff(shelf) >= 0).all() and np.bincount(shelf, blocks.size).max() < 220 and len(blocks.size) > 70
    met = neighbours.visits(first, placed, blocks, 3, "id", shelf)
    assert met.count() <= 1800 * (shelf.max() + 1) < 0.2 * neighbours.visits(first, placed, blocks, 3, "id").count()
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in neighbours.knn(df, df, 3, "id", "x", "id", "label", block_rows=20, test_rows=40).collect()}
    squared = np.round(((points[:, None] - points[None]) ** 2).sum(axis=2), 9)
    assert got == {i: np.lexsort((np.arange(1800), squared[i]))[:3].tolist() for i in range(1800)}


def test_knn_finds_the_ring_of_a_row_without_looking_at_all_blocks():
    """The block of a row and the blocks that it has to meet are those of the plain comparison with every block."""
    rng = np.random.default_rng(4)
    pivots = rng.normal(size=(12, 3))
    edges = [np.round(np.sort(rng.uniform(0, 1.5, 2 * n)), 1).reshape(n, 2) for n in rng.integers(0, 9, 12)]  # cells without rows, equal edges
    low, high = np.concatenate(edges).T
    cell = np.repeat(np.arange(12), [len(e) for e in edges])
    known = neighbours._rings({"pivots": pivots, "cell": cell, "low": low, "high": high, "size": np.ones(len(cell), int)})
    x = np.vstack([rng.normal(size=(400, 3)), pivots])
    own, d = neighbours._nearest_pivot(x, pivots)
    off = np.maximum(np.maximum(low - d[:, None], d[:, None] - high), 0.0)
    home = np.where(cell == own[:, None], off, np.inf).argmin(axis=1)
    assert np.array_equal(neighbours._home(x, known), home)
    apart = np.sqrt(neighbours._squares(pivots, pivots))
    worst = rng.uniform(0, 0.3, len(x))
    shelves = np.arange(0, len(cell), 3)
    found, many, _ = neighbours._others(x, home, worst, 1, {**known, "apart": apart, "first": shelves})
    gap = np.sqrt(neighbours._squares(x, pivots))
    to_pivot, between = gap[:, cell], apart[cell[home]][:, cell]
    mine = gap[np.arange(len(x)), cell[home]][:, None]
    plane = np.where(between > 1e-3, (to_pivot**2 - mine**2) / np.where(between > 1e-3, 2 * between, 1), 0)
    at_least = np.maximum(np.maximum(to_pivot - high, low - to_pivot), plane)
    for reach, holds in ((-1e-4, np.subtract), (1e-4, lambda a, b: np.subtract(b, a))):  # all that are surely near, none that surely are not
        maybe = at_least <= np.sqrt(worst)[:, None] + reach
        maybe[np.arange(len(x)), home] = False
        wanted = np.logical_or.reduceat(maybe, shelves, axis=1).astype(int)
        got = np.zeros_like(wanted)
        got[np.repeat(np.arange(len(x)), many), found] = 1
        assert (holds(wanted, got) <= 0).all()


def test_knn_leaves_out_most_of_a_block(monkeypatch):
    """Rows that have a twin in their block are compared with the rows at about their distance to the pivot only."""
    rng = np.random.default_rng(6)
    t = rng.normal(size=(2000, 5))
    x, ids = np.vstack([t[::2], t[:50] + 1e-7]), rng.permutation(2000)
    met = []
    meet = neighbours._Nearest.meet
    monkeypatch.setattr(neighbours._Nearest, "meet", lambda self, rows, a, b: (met.append(len(rows) * (b - a)), meet(self, rows, a, b)))
    found, mine, theirs = neighbours._in_block(x, np.full(len(x), np.inf), t, ids, 1, np.zeros(5))
    exact = np.round(((x[:, None] - t) ** 2).sum(axis=2), 9)
    best = [np.lexsort((ids, row))[0] for row in exact]
    assert np.array_equal(theirs[found.place[:, 0]], np.array(best)[mine])
    assert sum(met) < 0.4 * len(x) * len(t)


def test_knn_with_fewer_rows_than_neighbours_and_empty_sides(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0], i) for i in range(3)], "id bigint, x array<double>, label int")
    near = neighbours.knn(df, df, 5, "id", "x", "id", "label", block_rows=1)
    assert {r["id"]: [n["id"] for n in r["neighbours"]] for r in near.collect()} == {0: [0, 1, 2], 1: [1, 0, 2], 2: [2, 1, 0]}
    for rows in (None, 1):
        assert neighbours.knn(df.limit(0), df, 2, "id", "x", "id", "label", block_rows=rows).count() == 0
    with pytest.raises(ValueError, match="no training rows"):
        neighbours.knn(df, df.limit(0), 2, "id", "x", "id", "label")


def test_saved_neighbours_score_in_another_session(spark, data, tmp_path):
    fitted = ml.train(data, COLUMNS, variant="knn")
    expected = {r["id"]: (r["prediction"], r["probability"].toArray().tolist()) for r in ml.score(data, fitted).collect()}
    for _ in range(2):  # the second time over the first, by a model read from there
        sinks.save_pipeline(fitted, str(tmp_path), "flows", "binary", "knn")
        fitted = sinks.load_pipeline(str(tmp_path), "flows", "binary", "knn")
    other = spark.newSession().createDataFrame(data.collect(), data.schema)
    assert fitted.stages[-1].k == 5 and fitted.stages[-1].classes == 2
    assert expected == {r["id"]: (r["prediction"], r["probability"].toArray().tolist()) for r in ml.score(other, fitted).collect()}


def test_shapley_adds_up(data):
    model = ml.train(data, COLUMNS, variant="rf", numTrees=3, maxDepth=3)
    rows = ml.feature_part(model).transform(data.filter("id < 20")).select("id", "features")
    parts = explain.shapley_attribution(rows, model.stages[-1], COLUMNS, "id", permutations=3)
    total = {(r["id"], r["class"]): r["t"] for r in parts.groupBy("id", "class").agg(F.sum("attribution").alias("t")).collect()}
    zero = model.stages[-1].predictProbability(rows.first()["features"] * 0)
    for r in model.stages[-1].transform(rows).collect():
        for c in (0, 1):
            assert abs(total[(r["id"], c)] - (r["probability"][c] - zero[c])) < 1e-9
    useless = parts.filter("feature = 'constant'").agg(F.max(F.abs("attribution"))).first()[0]
    assert useless == 0.0
    assert explain.attribution_summary(parts).count() == 8


def test_local_surrogate_finds_the_driving_feature(data):
    model = ml.train(data, COLUMNS, variant="svm", kernel="linear")
    rows = ml.feature_part(model).transform(data.filter("id < 6")).select("id", "features")
    scorer = PipelineModel(stages=model.stages[2:])
    weights = explain.local_surrogate(rows, scorer, COLUMNS, "id", samples=200)
    mean = {r["feature"]: r["w"] for r in weights.groupBy("feature").agg(F.avg(F.abs("weight")).alias("w")).collect()}
    assert set(mean) == {"(intercept)", *COLUMNS}
    assert mean["a"] > 5 * mean["c"] and mean["b"] > 5 * mean["c"]


def test_local_surrogate_is_the_weighted_fit_of_its_samples(data):
    """A model that is linear in its features is found again, and only sums are shuffled."""
    model = ml.train(data, COLUMNS, variant="dt", maxDepth=3)
    rows = ml.feature_part(model).transform(data.filter("id < 40")).select("id", "features")

    class Linear:
        def transform(self, df):
            x = vector_to_array("features")
            p = 0.3 + 0.2 * x[0] - 0.1 * x[1]
            return df.withColumn("probability", F.array(1 - p, p)).withColumn("probability", array_to_vector("probability"))

    weights = explain.local_surrogate(rows, Linear(), COLUMNS, "id", samples=500, ridge=1e-9)
    got = {(r["id"], r["feature"]): r["weight"] for r in weights.collect()}
    assert len(got) == 40 * 5
    for r in rows.collect():
        x = r["features"].toArray()
        expected = [0.3 + 0.2 * x[0] - 0.1 * x[1], 0.2, -0.1, 0.0, 0.0]
        assert np.allclose([got[r["id"], f] for f in ["(intercept)", *COLUMNS]], expected, atol=1e-6)


@pytest.mark.parametrize("kind", ["ice", "cce", "approx_cce", "approx_tce"])
def test_evaluators(spark, data, kind, tmp_path):
    stages, _ = ml.fit_features(data, COLUMNS)
    rows = PipelineModel(stages=stages).transform(data).select("id", "features", "label")
    config = ConformalConfig(evaluator=kind, folds=3)
    c = make_evaluator(kind)(rows, ml.make_estimator("dt", maxDepth=3), config, "id", window=30)
    counted = sum(r["n"] for r in c.counts.collect())
    assert counted == (80 if kind == "ice" else N) or kind == "ice" and abs(counted - 80) <= 1
    assert len(c.models) == (3 if kind == "cce" else 1)
    scored = c.predict(rows)
    assert scored.count() == N
    low, high = scored.agg(F.min("p_value"), F.max("p_value")).first()
    assert 0 < low and high <= 1
    assert c.metrics.first()["accuracy"] > 0.8
    assert max(r["count"] for r in c.seeds.groupBy("class").count().collect()) <= 30
    c.save(str(tmp_path / kind))
    again = Calibrated.load(spark, str(tmp_path / kind))
    a = {r["id"]: r["p_value"] for r in scored.collect()}
    assert a == {r["id"]: r["p_value"] for r in again.predict(rows).collect()}
    assert c.flags(scored).columns[-1] == "drift"


def test_explanations_deal_out_their_rows(data):
    """Input in one part is scored by many tasks; walks are summed without a window; systems are solved once."""
    model = ml.train(data, COLUMNS, variant="dt", maxDepth=3)
    rows = ml.feature_part(model).transform(data).select("id", "features").coalesce(1)

    class Where:
        numClasses = 2

        def transform(self, df):
            where = F.array(F.spark_partition_id().cast("double"), F.lit(0.0))
            return model.stages[-1].transform(df).withColumn("probability", array_to_vector(where))

    walks = explain.shapley_attribution(rows, model.stages[-1], COLUMNS, "id", permutations=2)
    weights = explain.local_surrogate(rows, model.stages[-1], COLUMNS, "id", samples=20)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (walks, weights)]
    assert "Window" not in plans[0]
    assert plans[1].count("ArrowEvalPython") == 1
    # a sample's probability is its task's number: the fitted intercepts differ where the tasks do
    seen = explain.local_surrogate(rows, Where(), COLUMNS, "id", samples=20, target=0).filter("feature = '(intercept)'")
    assert seen.select(F.round("weight")).distinct().count() > 8


@pytest.mark.parametrize("depth", [3, 9])
def test_local_surrogate_of_a_tree_is_that_of_its_samples(spark, depth):
    """A tree is scored where its samples are made: same samples, same weights, and only the rows are shuffled."""
    rng = np.random.default_rng(5)
    noisy = [(float(a), float(b), float(rng.random() < 0.5 + 0.4 * np.sign(a * b))) for a, b in rng.normal(size=(400, 2))]
    data = spark.createDataFrame(noisy, "a double, b double, label double")
    stages, _ = ml.fit_features(data, ["a", "b"])
    prepared = PipelineModel(stages=stages).transform(data)
    tree = ml.make_estimator("dt", maxDepth=depth).fit(prepared)
    assert (tree.numNodes > explain.SMALL_TREE) == (depth == 9)

    class Same:
        def transform(self, df):
            return tree.transform(df)

    # ids of any type; equal ones are one fit, also those that are missing
    vectors = prepared.limit(60).select("features").collect()
    rows = spark.createDataFrame([(None if i % 20 == 7 else f"r{i % 50}", v["features"]) for i, v in enumerate(vectors)], ["id", "features"])
    fast, slow = (explain.local_surrogate(rows, m, ["a", "b"], "id", samples=50, target=1) for m in (tree, Same()))
    assert fast._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got, expected = ({(r["id"], r["feature"]): r["weight"] for r in df.collect()} for df in (fast, slow))
    assert got.keys() == expected.keys() and len(got) == 3 * rows.select("id").distinct().count()
    assert max(abs(got[k] - expected[k]) for k in got) < 1e-9
    assert len({round(v, 6) for v in got.values()}) > 100
