from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.linalg import Vectors

from flowdrift.operators import margins, ml


def _points(n):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3)) * [1.0, 20.0, 0.1] + [0.0, 300.0, 5.0]
    return x, (x[:, 0] + (x[:, 1] - 300) / 20 + rng.normal(size=n) > 0.4).astype(int)


def _frame(spark, x, label):
    return spark.createDataFrame([(Vectors.dense(v), float(c)) for v, c in zip(x, label)], ["features", "label"])


@pytest.fixture(scope="module")
def points():
    return _points(1500)


@pytest.fixture(scope="module")
def rows(spark, points):
    return _frame(spark, *points).repartition(4)


def _loss(model, x, label, reg=0.01, scaled=True):
    w = model.coefficients.toArray()
    margin = (2 * label - 1) * (x @ w + model.intercept)
    return np.maximum(0, 1 - margin).mean() + reg / 2 * np.square(w * (x.std(axis=0, ddof=1) if scaled else 1)).sum()


def test_gradients_are_those_of_the_losses():
    rng = np.random.default_rng(1)
    z, w, d, steps = rng.normal(size=(60, 4)), rng.normal(size=4), rng.normal(size=4), np.array([0.0, 0.5, 2.0])
    losses, gradients = margins.hinge(z, w, d, steps)
    one = lambda v: margins.hinge(z, v, np.zeros(4), np.zeros(1))[0][0]
    for t, loss, gradient in zip(steps, losses, gradients):
        v = w + t * d
        assert np.isclose(loss, np.maximum(0, 1 - z @ v).sum())
        assert np.allclose(gradient, [(one(v + e) - one(v - e)) / 2e-6 for e in np.eye(4) * 1e-6], atol=1e-4)


@pytest.mark.parametrize("more", [{}, {"fitIntercept": False}, {"standardization": False}])
def test_a_fit_is_as_good_as_that_of_spark(rows, points, more):
    x, label = points
    settings = {"regParam": 0.01, "maxIter": 50, **more}
    ours, theirs = margins.LinearSvm(**settings).fit(rows), LinearSVC(**settings).fit(rows)
    scaled = more.get("standardization", True)
    assert isinstance(ours, LinearSVCModel) and ours.getMaxIter() == 50
    assert _loss(ours, x, label, scaled=scaled) <= _loss(theirs, x, label, scaled=scaled) + 1e-4
    assert "fitIntercept" not in more or ours.intercept == 0
    a, b = (m.transform(rows).select("prediction").collect() for m in (ours, theirs))
    assert np.mean([p == q for p, q in zip(a, b)]) > 0.98


def test_an_iteration_reads_the_rows_about_once(spark, rows):
    svm = ml.make_estimator("svm", kernel="linear").getStages()[0]
    spark.sparkContext.setJobGroup("svm passes", "")
    try:
        svm.fit(rows)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("svm passes"))
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert 5 < jobs < 1.5 * svm.getMaxIter()


def test_rows_of_one_partition_are_dealt_out(spark):
    x, label = _points(3 * margins.BLOCK_VALUES)
    svm = margins.LinearSvm(regParam=0.01, maxIter=15)
    apart = svm.fit(_frame(spark, x, label).repartition(8))
    model = svm.fit(_frame(spark, x, label).coalesce(1))
    assert np.allclose(model.coefficients.toArray(), apart.coefficients.toArray(), rtol=0.02, atol=0.02)


def test_constant_features_and_bad_rows(spark, points):
    x, label = points
    still = margins.LinearSvm(maxIter=5).fit(_frame(spark, np.column_stack([x, np.full(len(x), 7.0)]), label))
    assert still.coefficients[3] == 0 and still.numFeatures == 4
    for bad, wrong in ((x, label * 2), (np.where(x > 310, np.nan, x), label), (x[:0], label[:0])):
        with pytest.raises(Exception):
            frame = _frame(spark, bad, wrong) if len(bad) else _frame(spark, x, label).limit(0)
            margins.LinearSvm(maxIter=5).fit(frame)
