"""Training of linear SVMs: one pass over blocks of rows tries all step lengths of an iteration."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Values of one block: it and its margins stay in the cache of a core.
BLOCK_VALUES = 16_384
# Step lengths that one pass tries; if none is good, a second pass tries as many shorter ones.
STEPS = 2.0 ** np.arange(1, -9, -1)
CORRECTIONS = 10
# Values of the loss that are looked back on, as in Spark's own optimiser.
MEMORY = 20

# Losses and gradients at the points w + t d for all step lengths t.
Cost = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def hinge(z: np.ndarray, w: np.ndarray, d: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed hinge losses and their gradients at ``w + t * d`` for every ``t`` of ``steps``.

    A row of ``z`` is the signed feature vector, its last value the sign alone (for the intercept).
    """
    margin, along = np.ascontiguousarray((z @ np.column_stack([w, d]).astype(z.dtype)).T)
    left = np.multiply.outer(-steps.astype(z.dtype), along)
    left += 1 - margin
    inside = (left > 0).astype(z.dtype)
    return np.maximum(left, 0, out=left).sum(axis=1, dtype=float), -(inside @ z).astype(float)


def minimize(cost: Cost, start: np.ndarray, steps: int, tol: float) -> tuple[np.ndarray, list[float]]:
    """L-BFGS that takes the best of the tried step lengths. Ends like Spark's own; returns the weights and the loss of each step."""
    w = start
    f, g = (a[0] for a in cost(w, np.zeros_like(w), np.zeros(1)))
    losses, pairs = [float(f)], deque(maxlen=CORRECTIONS)
    while len(losses) <= steps and np.linalg.norm(g) > max(tol * abs(f), 1e-8):
        d, shares = -g, []
        for s, y in reversed(pairs):
            shares.append((s @ d) / (s @ y))
            d = d - shares[-1] * y
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), share in zip(pairs, reversed(shares)):
            d = d + (share - (y @ d) / (s @ y)) * s
        slope, found = float(g @ d), None
        for tried in (STEPS, STEPS * STEPS[-1] / 4):
            tried = tried if pairs else tried / np.linalg.norm(g)
            values, slopes = cost(w, d, tried)
            i = int(np.argmin(values))
            if values[i] <= f + 1e-4 * tried[i] * slope:
                found = tried[i], values[i], slopes[i]
                break
        if found is None:
            if not pairs:
                break
            pairs.clear()  # once more along the gradient
            continue
        t, f, new = found
        if (t * d) @ (new - g) > 1e-12 * float(d @ d) * t * t:
            pairs.append((t * d, new - g))
        w, g = w + t * d, new
        losses.append(float(f))
        if len(losses) > MEMORY and max(losses[-MEMORY - 1 : -1]) - f <= tol * abs(losses[0]):
            break
    return w, losses


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, sign) as blocks of plain arrays."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            sign = batch.column("sign").to_numpy(zero_copy_only=False).astype(float)
            at = range(0, len(x), max(1, BLOCK_VALUES // x.shape[1]))
            columns = [[a[i : i + at.step].tobytes() for i in at] for a in (x, sign)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["x", "sign"])


def _unpack(block) -> tuple[np.ndarray, np.ndarray]:
    sign = np.frombuffer(block[1])
    return np.frombuffer(block[0]).reshape(len(sign), -1), sign


def _signed(block, centre: np.ndarray, scale: np.ndarray) -> bytes:
    """A block of rows as :func:`hinge` reads them, in single precision."""
    x, sign = _unpack(block)
    return (sign[:, None] * np.column_stack([(x - centre) * scale, np.ones(len(x))])).astype(np.float32).tobytes()


def _added(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def _moments(packed: Iterator) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows, and per feature the mean and the squared deviations from it."""
    n, mean, squares = 0, 0.0, 0.0
    for block in packed:
        x, _ = _unpack(block)
        n, mean, squares = _joined((n, mean, squares), (len(x), x.mean(axis=0), x.var(axis=0) * len(x)))
    if n:
        yield n, mean, squares


def _joined(a: tuple, b: tuple) -> tuple:
    n, off = a[0] + b[0], b[1] - a[1]
    return n, a[1] + off * (b[0] / n), a[2] + b[2] + off * off * (a[0] * b[0] / n)


class LinearSvm(LinearSVC):
    """Spark's linear SVM with its loss and parameters, fitted in fewer passes over the rows.

    The hinge loss has kinks, so Spark's line search looks at many step lengths in an iteration and
    reads all rows for each. A margin is linear in the step length: one pass here gives the losses
    and gradients of all of them. Rows are packed once into blocks that every pass reads; only sums
    reach the driver, one line of weights per task and step length. The result is Spark's own model.
    """

    def _fit(self, dataset: DataFrame) -> LinearSVCModel:
        if self.isDefined(self.weightCol) and self.getWeightCol():
            return super()._fit(dataset)
        label = F.col(self.getLabelCol()).cast("double")
        wrong = F.raise_error(F.concat(F.lit("not a label of two classes: "), F.coalesce(label.cast("string"), F.lit("NULL")))).cast("double")
        sign = F.when(label == 1, 1.0).when(label == 0, -1.0).otherwise(wrong)
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), sign.alias("sign"))
        raw = rows.mapInArrow(_pack, "x binary, sign binary").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            weights, intercept = self._weights(raw)
        finally:
            raw.unpersist()
        held = JavaWrapper._new_java_obj("org.apache.spark.ml.classification.LinearSVCModel", self.uid, Vectors.dense(weights), intercept)
        return self._copyValues(LinearSVCModel(held))

    def _weights(self, raw: RDD) -> tuple[np.ndarray, float]:
        """Weights of the features as they are given, and the intercept."""
        moments = raw.mapPartitions(_moments).collect()
        if not moments:
            raise ValueError("no training rows")
        n, mean, squares = reduce(_joined, moments)
        if not np.isfinite(squares).all():
            raise ValueError("features must be finite")
        std = np.sqrt(squares / max(n - 1, 1))
        # a constant feature gets no weight, as in Spark
        scale = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
        ridge = np.append(self.getRegParam() * (np.ones_like(std) if self.getStandardization() else scale**2), 0.0)
        # without an intercept the features keep their origin and its direction is left out
        centre, open_ = (mean, 1.0) if self.getFitIntercept() else (np.zeros_like(mean), 0.0)
        width, free = len(mean) + 1, np.append(np.ones_like(mean), open_)
        # few full partitions would leave cores idle in every pass
        tasks = min(raw.context.defaultParallelism, n * len(mean) // BLOCK_VALUES)
        dealt = raw.repartition(tasks) if len(moments) < tasks else raw
        blocks = dealt.map(lambda block: _signed(block, centre, scale)).persist(StorageLevel.MEMORY_AND_DISK)

        def cost(w: np.ndarray, d: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            def partial(packed: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                losses, gradients = np.zeros(len(steps)), np.zeros((len(steps), width))
                for block in packed:
                    more, slopes = hinge(np.frombuffer(block, np.float32).reshape(-1, width), w, d, steps)
                    losses += more
                    gradients += slopes
                yield losses, gradients

            losses, gradients = blocks.mapPartitions(partial).reduce(_added)
            at = w + steps[:, None] * d
            return losses / n + (ridge * at * at).sum(axis=1) / 2, gradients * free / n + ridge * at

        try:
            trained, _ = minimize(cost, np.zeros(width), self.getMaxIter(), self.getTol())
        finally:
            blocks.unpersist()
        weights = trained[:-1] * scale
        return weights, float(trained[-1] - weights @ centre)
