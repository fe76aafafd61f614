from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors

from flowdrift.operators import ml, nets

LAYERS = [3, 6, 4, 3]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 3))
    return x, ((x[:, 0] > 0.3).astype(int) + (x[:, 1] * x[:, 2] > 0)).astype(int)


@pytest.fixture(scope="module")
def rows(spark, points):
    return spark.createDataFrame([(Vectors.dense(v), float(c)) for v, c in zip(*points)], ["features", "label"])


def test_gradient_is_that_of_the_loss(points):
    x, label = points
    times = np.arange(len(x)) % 3 + 1.0
    rng = np.random.default_rng(0)
    w = rng.normal(size=sum(n * m + m for n, m in zip(LAYERS, LAYERS[1:])))
    loss = lambda v: nets.loss_and_gradient(nets._split_weights(v, LAYERS), x, label, times)[0]
    gradient = nets.loss_and_gradient(nets._split_weights(w, LAYERS), x, label, times)[1]
    steps = np.eye(len(w)) * 1e-5
    assert np.allclose(gradient, [(loss(w + s) - loss(w - s)) / 2e-5 for s in steps], rtol=1e-4, atol=1e-3)


def test_a_repeated_row_counts_as_often(points):
    x, label = points
    w = nets._split_weights(np.linspace(-1, 1, sum(n * m + m for n, m in zip(LAYERS, LAYERS[1:]))), LAYERS)
    once = nets.loss_and_gradient(w, x, label, np.full(len(x), 4.0))
    apart = nets.loss_and_gradient(w, np.repeat(x, 4, axis=0), np.repeat(label, 4), np.ones(4 * len(x)))
    assert np.isclose(once[0], apart[0]) and np.allclose(once[1], apart[1])


def test_a_net_that_fits_its_rows_makes_no_numbers_next_to_zero():
    """Numbers below the normal ones cost a core hundreds of times as much; the gradient is right without them."""
    rng = np.random.default_rng(2)
    layers = [5, 64, 32, 16, 2]
    flat = rng.normal(size=sum(n * m + m for n, m in zip(layers, layers[1:]))) * 20
    x = rng.normal(size=(512, 5))
    w = nets._split_weights(flat.astype(np.float32), layers)
    exact = nets._split_weights(flat.astype(np.float32).astype(float), layers)
    margins = [nets.loss_and_gradient(exact, x[i : i + 1], np.array([c]), np.ones(1))[0] for i in range(512) for c in (0, 1)]
    label = np.reshape(margins, (512, 2)).argmin(axis=1)
    label[0] = 1 - label[0]  # one row that it does not fit
    room = {}
    loss, gradient = nets.loss_and_gradient(w, x.astype(np.float32), label, np.ones(512, np.float32), room)
    for numbers in (gradient, *(a for pair in room[512] for a in pair[:1])):
        assert not ((numbers != 0) & (np.abs(numbers) < np.finfo(np.float32).tiny)).any()
    right_loss, right = nets.loss_and_gradient(exact, x.astype(np.float32).astype(float), label, np.ones(512))
    assert np.isclose(loss, right_loss, rtol=1e-4) and np.linalg.norm(gradient - right) < 1e-3 * np.linalg.norm(right)


def test_equal_rows_are_multiplied_once(rows):
    packed = nets._blocks(rows.union(rows).union(rows), "features", "label", 2700).collect()
    times = np.concatenate([np.frombuffer(b["times"], np.float32) for b in packed])
    assert len(times) == 900 and set(times) == {3.0}


def test_a_net_starts_and_ends_like_that_of_spark(spark, rows, points):
    x, label = points

    def loss(model):
        known = nets._split_weights(model.weights.toArray(), LAYERS)
        return nets.loss_and_gradient(known, x, label, np.ones(len(x)))[0] / len(x)

    ours = ml.make_estimator("mlp", "multi", 3, 3, hidden=[6, 4], maxIter=60)
    theirs = MultilayerPerceptronClassifier(layers=LAYERS, maxIter=60, seed=ml.SEED).fit(rows)
    start = ours._held(rows.limit(1))
    assert isinstance(ours, nets.NetClassifier) and np.isclose(loss(start), theirs.summary().objectiveHistory[0], rtol=0.02)
    model = ours.fit(rows)
    assert loss(model) < 1.15 * loss(theirs) and loss(model) < 0.5 * loss(start)
    assert model.getMaxIter() == 60 and not model.isSet(model.initialWeights)
    assert np.array_equal(ours.copy().fit(rows).weights.toArray(), model.weights.toArray())


def test_minimize_meets_the_minimum_of_a_valley():
    def cost(w):
        a, b = 1 - w[0], w[1] - w[0] ** 2
        return a * a + 100 * b * b, np.array([-2 * a - 400 * w[0] * b, 200 * b])

    w, losses = nets.minimize(cost, np.array([-1.2, 1.0]), 200, 1e-12)
    assert np.allclose(w, 1, atol=1e-4) and all(b <= a for a, b in zip(losses, losses[1:]))


def test_labels_and_rows_are_checked(rows):
    with pytest.raises(ValueError):
        ml.make_estimator("mlp", "binary", 3, 2).fit(rows)
    with pytest.raises(ValueError):
        ml.make_estimator("mlp", "multi", 3, 3).fit(rows.limit(0))
