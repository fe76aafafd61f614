"""Training of feed-forward nets: Spark sums the gradient over blocks of rows, the few weights are stepped between the jobs."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one matrix product: the widest layer of a block stays in the cache of a core.
BLOCK_ROWS = 1024
# Fewer different rows than this are not dealt to another task.
TASK_ROWS = 4096
CORRECTIONS = 10
# Values of the loss that are looked back on, as in Spark's own optimiser.
MEMORY = 20


def _split_weights(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix (inputs x outputs) and bias of every layer, in the order of Spark's weight vector."""
    out, at = [], 0
    for n, m in zip(layers, layers[1:]):
        out.append((weights[at : at + n * m].reshape(n, m), weights[at + n * m : at + n * m + m]))
        at += n * m + m
    return out


Room = dict[int, list[tuple[np.ndarray, np.ndarray]]]


def loss_and_gradient(
    weights: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, label: np.ndarray, times: np.ndarray, room: Room | None = None
) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of a sigmoid net with a softmax at its end, and its gradient; row i counts ``times[i]`` times.

    ``room`` keeps the arrays of the layers for further calls. Numbers next to the smallest that the type
    can hold cost a core hundreds of times a normal one, and a net that fits its rows well is full of them. So a unit is never
    closer to 0 than the cube root of the smallest number, and slopes are rounded to multiples of what is
    far below the precision of any sum they enter.
    """
    kind = np.result_type(x, weights[0][0])
    tiny = float(np.finfo(kind).tiny)
    edge, grain = -np.log(tiny) / 3, kind.type(tiny**0.4)
    room = {} if room is None else room
    if len(x) not in room:
        room[len(x)] = [(np.empty((len(x), len(bias)), kind), np.empty((len(x), len(bias)), kind)) for _, bias in weights]
    seen, arrays = [x], room[len(x)]
    for (matrix, bias), (z, _) in zip(weights[:-1], arrays):
        np.matmul(seen[-1], matrix, out=z)
        z += bias
        np.negative(z, out=z)
        np.minimum(z, edge, out=z)
        np.exp(z, out=z)
        z += 1
        seen.append(np.reciprocal(z, out=z))
    matrix, bias = weights[-1]
    z = np.matmul(seen[-1], matrix, out=arrays[-1][0])
    z += bias
    z -= z.max(axis=1, keepdims=True)
    own = np.arange(len(x)), label
    right = z[own].astype(float)
    np.maximum(z, -2 * edge, out=z)
    np.exp(z, out=z)
    total = z.sum(axis=1, keepdims=True)
    loss = float(times.astype(float) @ (np.log(total[:, 0].astype(float)) - right))
    z /= total
    z[own] -= 1
    z *= times[:, None]
    parts = []
    for i in range(len(weights) - 1, -1, -1):
        z += grain
        z -= grain
        parts += [z.sum(axis=0), (seen[i].T @ z).ravel()]
        if i:
            z = np.matmul(z, weights[i][0].T, out=arrays[i - 1][1])
            z *= seen[i]
            z *= np.subtract(1, seen[i], out=seen[i])
    return loss, np.concatenate(parts[::-1])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, label, times) as blocks of plain arrays."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1)
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int32)
            times = batch.column("times").to_numpy(zero_copy_only=False).astype(np.float32)
            at = range(0, len(x), BLOCK_ROWS)
            columns = [[a[i : i + BLOCK_ROWS].tobytes() for i in at] for a in (x, label, times)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["x", "label", "times"])


def _blocks(dataset: DataFrame, features: str, label: str, rows: int) -> DataFrame:
    """Different rows with their counts, dealt evenly to the tasks in a fixed order and packed."""
    counted = (
        dataset.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("label"))
        .groupBy("x", "label")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    tasks = max(1, min(2 * dataset.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS))
    dealt = counted.repartition(tasks, "x", "label").sortWithinPartitions("x", "label")
    return dealt.mapInArrow(_pack, "x binary, label binary, times binary")


Point = tuple[float, float, float, np.ndarray]  # step length, loss, slope along the direction, gradient


def _between(left: Point, right: Point) -> float:
    """Minimum of the cubic through two points, kept off both ends."""
    (a, fa, da, _), (b, fb, db, _) = (left, right) if left[0] < right[0] else (right, left)
    d1 = da + db - 3 * (fa - fb) / (a - b)
    d2 = np.sqrt(max(d1 * d1 - da * db, 0.0))
    span = db - da + 2 * d2
    t = b - (b - a) * (db + d2 - d1) / span if span else (a + b) / 2
    return float(np.clip(t, a + 0.1 * (b - a), a + 0.9 * (b - a)))


def _step(at: Callable[[float], Point], start: Point, t: float) -> Point | None:
    """A point that meets the strong Wolfe conditions; None if there is none within the tries."""
    _, f, slope, _ = start
    low, high = start, None
    for i in range(20):
        here = at(t)
        if not np.isfinite(here[1]):
            t /= 2
        elif here[1] > f + 1e-4 * t * slope or (here[1] >= low[1] and (i or high)):
            high = here
        elif abs(here[2]) <= 0.9 * abs(slope):
            return here
        else:
            if here[2] * ((high[0] if high else np.inf) - low[0]) >= 0:
                high = low
            low = here
        if high is not None:
            t = _between(low, high)
        elif np.isfinite(here[1]):
            t *= 1.5
    return low if low is not start else None


def minimize(
    cost: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, tol: float
) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with strong Wolfe steps, which goes and ends as Spark's own does. Returns the weights and the loss of each step."""
    w = start
    f, g = cost(w)
    losses, pairs = [f], deque(maxlen=CORRECTIONS)
    while len(losses) <= steps and np.linalg.norm(g) > tol * abs(f):
        d, shares = -g, []
        for s, y in reversed(pairs):
            shares.append((s @ d) / (s @ y))
            d = d - shares[-1] * y
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), share in zip(pairs, reversed(shares)):
            d = d + (share - (y @ d) / (s @ y)) * s

        def at(t: float, d: np.ndarray = d, w: np.ndarray = w) -> Point:
            loss, gradient = cost(w + t * d)
            return t, loss, float(gradient @ d), gradient

        found = _step(at, (0.0, f, float(g @ d), g), 1.0 if pairs else 1.0 / float(np.linalg.norm(d)))
        if found is None:
            if not pairs:
                break
            pairs.clear()  # once more along the gradient
            continue
        t, f, _, new = found
        if (t * d) @ (new - g) > 0:
            pairs.append((t * d, new - g))
        w, g = w + t * d, new
        losses.append(f)
        if len(losses) > MEMORY and max(losses[-MEMORY - 1 : -1]) - f <= tol * abs(losses[0]):
            break
    return w, losses


class NetClassifier(Estimator):
    """Fits the net that ``net`` describes, on all rows, with its start weights, number of iterations and tolerance.

    The result is Spark's own model. Spark's fit multiplies blocks of 128 rows in the JVM;
    here equal rows are counted once and each task multiplies larger single-precision blocks
    with NumPy, while sums over blocks, weights and steps are in double precision. The cost of a
    step still is rows times weights. Partial gradients (one line of weights per task) are
    added up in a tree before the driver gets them.
    """

    def __init__(self, net: MultilayerPerceptronClassifier) -> None:
        super().__init__()
        self.net = net

    def copy(self, extra=None) -> NetClassifier:
        return NetClassifier(self.net.copy(extra))

    def _held(self, row: DataFrame, weights=None) -> MultilayerPerceptronClassificationModel:
        """Spark's model with the given weights, or with those that its training would start from."""
        still = self.net.copy({self.net.maxIter: 0})
        if weights is not None:
            still.setInitialWeights(Vectors.dense(weights))
        model = still.fit(row)
        if weights is not None:
            model.clear(model.initialWeights)
        model.set(model.maxIter, self.net.getMaxIter())
        return model

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        if self.net.getSolver() != "l-bfgs":
            return self.net.fit(dataset)
        features, label, layers = self.net.getFeaturesCol(), self.net.getLabelCol(), list(self.net.getLayers())
        rows, top = dataset.agg(F.count(F.lit(1)), F.max(label)).first()
        if not rows:
            raise ValueError("no training rows")
        if top >= layers[-1]:
            raise ValueError(f"label {top} of a net with {layers[-1]} classes")
        spark = dataset.sparkSession
        one = spark.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], [features, label])
        blocks = _blocks(dataset, features, label, rows).persist(StorageLevel.MEMORY_AND_DISK)
        lines = blocks.rdd

        def cost(weights: np.ndarray) -> tuple[float, np.ndarray]:
            def partial(packed) -> Iterator[tuple[float, np.ndarray]]:
                known = _split_weights(weights.astype(np.float32), layers)
                loss, gradient, room = 0.0, np.zeros(len(weights)), {}
                for b in packed:
                    x = np.frombuffer(b["x"], np.float32).reshape(-1, layers[0])
                    more, slope = loss_and_gradient(known, x, np.frombuffer(b["label"], np.int32), np.frombuffer(b["times"], np.float32), room)
                    loss += more
                    gradient += slope
                yield loss, gradient

            loss, gradient = lines.mapPartitions(partial).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
            return loss / rows, gradient / rows

        try:
            trained, _ = minimize(cost, self._held(one).weights.toArray(), self.net.getMaxIter(), self.net.getTol())
        finally:
            blocks.unpersist()
        return self._held(one, trained)
