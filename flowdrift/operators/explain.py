"""Model explanations as Spark jobs over many rows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.session import ensure_checkpoint_dir


def _unit(*parts: Column) -> Column:
    """Uniform number in (0, 1) from a hash of the parts: the same on every run and retry."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


# Vectors scored by one task: few input rows become many, so the rows are dealt out before they are unfolded.
SCORED_ROWS = 2_000_000
# The same where a task scores them itself, which takes a tenth of the time.
TREE_ROWS = 10_000_000
# Rows whose samples lie in the cache of a core together.
ROWS_AT_ONCE = 4
# Nodes of a tree that is evaluated whole for all samples; in a larger one each sample goes down its own path.
SMALL_TREE = 63


def _dealt(df: DataFrame, row_id: str, features: str, each: int, most: int = SCORED_ROWS) -> DataFrame:
    """``row_id`` and its features as an array ``_x``, in as many parts as ``each`` vectors per row need."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(4 * cores, -(-df.count() * each // most))
    return df.select(F.col(row_id), vector_to_array(features).alias("_x")).repartition(parts, F.col(row_id))


def shapley_attribution(
    df: DataFrame,
    model: Model,
    names: list[str],
    row_id: str,
    features: str = "features",
    permutations: int = 16,
    background: list[float] | None = None,
) -> DataFrame:
    """Attribution of each class probability to each feature, per row.

    For each row and sampled feature order, features move one at a time from the
    background (0 = training mean of scaled features) to the row's value; the
    change in probability is credited to the feature. Attributions of a row add
    up to its probability minus the background's. One (row, order) walk has one
    entry per feature plus one, whatever the table size. Each scored step counts for the
    feature that moved last and against the one that moves next, so the walks are summed
    where they are scored, without sorting their steps. ``row_id`` is unique and not null.
    """
    d = len(names)
    base = F.array(*[F.lit(float(b)) for b in (background or [0.0] * d)])
    walk = (
        _dealt(df, row_id, features, permutations * (d + 1))
        .withColumn("_perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
        .withColumn(
            "_order",
            F.transform(
                F.array_sort(
                    F.transform(
                        F.sequence(F.lit(0), F.lit(d - 1)),
                        lambda j: F.struct(_unit(F.col(row_id), F.col("_perm"), j).alias("u"), j.alias("j")),
                    )
                ),
                lambda s: s.getField("j"),
            ),
        )
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(d))))
        .withColumn("_on", F.slice("_order", F.lit(1), F.col("_step")))
    )
    x = [F.get("_x", F.lit(j)) for j in range(d)]
    mixed = F.array(*[F.when(F.array_contains("_on", F.lit(j)), x[j]).otherwise(F.get(base, F.lit(j))) for j in range(d)])
    scored = model.transform(walk.withColumn(features, array_to_vector(mixed))).select(
        row_id, F.get("_order", F.col("_step") - 1).alias("_last"), F.get("_order", F.col("_step")).alias("_next"),
        vector_to_array("probability").alias("_p"),
    )
    gains = {}
    for j in range(d):
        sign = F.when(F.col("_last") == j, 1.0).when(F.col("_next") == j, -1.0)
        for c in range(model.numClasses):
            gains[j, c] = (F.sum(sign * F.get("_p", F.lit(c))) / permutations).alias(f"_{j}_{c}")
    lines = [
        F.struct(F.lit(c).alias("class"), F.lit(names[j]).alias("feature"), F.col(f"_{j}_{c}").alias("attribution")) for j, c in gains
    ]
    return scored.groupBy(row_id).agg(*gains.values()).select(row_id, F.inline(F.array(*lines)))


def attribution_summary(attributions: DataFrame) -> DataFrame:
    """Mean absolute and mean attribution per class and feature."""
    return attributions.groupBy("class", "feature").agg(
        F.avg(F.abs("attribution")).alias("mean_abs"), F.avg("attribution").alias("mean")
    )


@dataclass(frozen=True)
class _Tree:
    """A decision tree as arrays by node: a leaf has itself as both children, so samples may stop there."""

    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray  # left of node i at 2 * i, right after it
    value: np.ndarray
    depth: int

    @staticmethod
    def of(model: Model, spark: SparkSession, features: str, target: int) -> _Tree | None:
        """The tree of ``model`` with the probability of class ``target`` in its leaves; None for another kind of model."""
        if not isinstance(model, DecisionTreeClassificationModel) or (model.getFeaturesCol(), model.getProbabilityCol()) != (features, "probability"):
            return None
        path = f"{ensure_checkpoint_dir(spark)}/tree-{uuid.uuid4().hex}"
        model.save(path)  # Spark's own format, a line for each node
        lines = spark.read.parquet(f"{path}/data").orderBy("id").collect()
        if any(r["leftChild"] >= 0 and r["split"]["numCategories"] != -1 for r in lines) or not 0 <= target < model.numClasses:
            return None
        inner = np.array([r["leftChild"] >= 0 for r in lines])
        own = np.arange(len(lines))
        stats = np.array([r["impurityStats"] for r in lines], dtype=float)
        return _Tree(
            np.array([max(r["split"]["featureIndex"], 0) for r in lines]),
            np.array([r["split"]["leftCategoriesOrThreshold"][0] if i else 0.0 for r, i in zip(lines, inner)]),
            np.stack([np.where(inner, [r[side] for r in lines], own) for side in ("leftChild", "rightChild")], axis=1).ravel(),
            np.divide(stats[:, target], stats.sum(axis=1), out=np.zeros(len(stats)), where=stats.sum(axis=1) != 0),
            model.depth,
        )

    def predict(self, z: np.ndarray) -> np.ndarray:
        """Probabilities (rows x samples) of ``z`` (rows x features x samples)."""
        rows, d, samples = z.shape
        if len(self.value) <= SMALL_TREE:
            return np.broadcast_to(self._whole(0, z), (rows, samples))
        flat, at = z.ravel(), np.zeros((rows, samples), dtype=np.int64)
        start = (np.arange(rows) * d * samples)[:, None] + np.arange(samples)
        for _ in range(self.depth):
            right = ~(flat[start + self.feature[at] * samples] <= self.threshold[at])  # NaN goes to the right, as in Spark
            at = self.children[2 * at + right]
        return self.value[at]

    def _whole(self, node: int, z: np.ndarray) -> np.ndarray | float:
        left, right = self.children[2 * node : 2 * node + 2]
        if left == node:
            return self.value[node]
        return np.where(z[:, self.feature[node]] <= self.threshold[node], self._whole(left, z), self._whole(right, z))


def _number(value: int) -> np.uint64:
    return np.uint64(value % 2**64)


_PRIMES = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5


def _times_prime(value: int | np.ndarray) -> np.uint64 | np.ndarray:
    """What ``xxhash64`` mixes in of an int."""
    return _number(value * _PRIMES[0]) if isinstance(value, int) else value.astype(np.uint64) * np.uint64(_PRIMES[0])


def _mix(h: np.ndarray, spare: np.ndarray) -> None:
    """Finish a step of Spark's ``xxhash64`` in place: ``h`` is the hash of the columns before plus the fifth prime and 4, crossed with the mixed-in int."""
    _, p2, p3, _ = map(np.uint64, _PRIMES)
    np.left_shift(h, np.uint64(23), out=spare)
    h >>= np.uint64(41)
    h |= spare
    h *= p2
    h += p3
    for shift, factor in ((33, p2), (29, p3), (32, None)):
        np.right_shift(h, np.uint64(shift), out=spare)
        h ^= spare
        if factor:
            h *= factor


# sin(x) / x by powers of x squared, to the last place for x within a quarter turn
_SINE = [(-1) ** i / float(math.factorial(2 * i + 1)) for i in range(11)]


class _Noise:
    """The standard normal numbers of :func:`local_surrogate`, as arrays: equal to its column expressions but for rounding.

    The arrays are used again for each call: there are twenty passes over them, which cost more in fresh memory.
    """

    def __init__(self, rows: int, d: int, samples: int) -> None:
        self.sample, self.feature = _times_prime(np.arange(samples)), _times_prime(np.arange(d))[:, None]
        self.narrow = [np.empty((rows, 1, samples), np.uint64) for _ in range(2)]
        self.whole = [np.empty((rows, d, samples), np.uint64) for _ in range(3)]
        self.normal = [np.empty((rows, d, samples)) for _ in range(3)]

    def of(self, seed: np.ndarray) -> np.ndarray:
        """Numbers (rows x features x samples) from the hash of each row's id; the first sample of a row is the row itself."""
        last = _number(_PRIMES[3] + 4)
        h, spare = (v[: len(seed)] for v in self.narrow)
        np.bitwise_xor((seed + last)[:, None, None], self.sample, out=h)
        _mix(h, spare)
        h += last
        inner, part, spare = (v[: len(seed)] for v in self.whole)
        np.bitwise_xor(h, self.feature, out=inner)
        _mix(inner, spare)
        inner += last
        radius, turn, power = (v[: len(seed)] for v in self.normal)
        for number, out in ((1, radius), (2, turn)):
            np.bitwise_xor(inner, _times_prime(number), out=part)
            _mix(part, spare)
            part &= np.uint64((1 << 52) - 1)
            np.copyto(out, part.view(np.int64), casting="unsafe")
            out += 0.5
            out *= 1 / float(1 << 52)
        np.log(radius, out=radius)
        radius *= -2
        np.sqrt(radius, out=radius)
        # the cosine of a turn is the sine of what its half lacks to a quarter
        turn -= 0.5
        np.abs(turn, out=turn)
        turn -= 0.25
        turn *= 2 * np.pi
        radius *= turn
        turn *= turn
        np.multiply(turn, _SINE[-1], out=power)
        for c in _SINE[-2:0:-1]:
            power += c
            power *= turn
        power += _SINE[0]
        radius *= power
        radius[:, :, 0] = 0.0
        return radius


def _tree_sums(dealt: DataFrame, tree: _Tree, row_id: str, d: int, samples: int, width: float, sums_type: T.StructType) -> DataFrame:
    """One line of sums for each ``row_id`` of ``dealt``, whose rows are dealt by it: samples are made, scored and summed in the task."""
    at = np.triu_indices(d + 2)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines(ids: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
            offsets = np.arange(len(ids) + 1, dtype=np.int32) * len(at[0])
            return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))], [row_id, "_sums"])

        noise = _Noise(ROWS_AT_ONCE, d, samples)
        room = np.ones((2, ROWS_AT_ONCE, d + 2, samples))
        open_id, open_sums = None, None  # the last row of a batch may go on in the next
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)[:, :d]
            seed = batch.column("_seed").to_numpy(zero_copy_only=False).view(np.uint64)
            sums = np.empty((n, len(at[0])))
            for i in range(0, n, ROWS_AT_ONCE):
                here = x[i : i + ROWS_AT_ONCE, :, None]
                z = noise.of(seed[i : i + ROWS_AT_ONCE])
                z += here
                full, weighted = room[:, : len(z)]
                full[:, -1] = tree.predict(z)
                gap = full[:, 1:-1]
                np.subtract(z, here, out=gap)
                np.multiply(gap, gap, out=z)
                weight = z.sum(axis=1, keepdims=True)
                weight /= -(width**2)
                np.multiply(full, np.exp(weight, out=weight), out=weighted)
                sums[i : i + ROWS_AT_ONCE] = np.matmul(weighted, full.transpose(0, 2, 1))[:, at[0], at[1]]
            ids = batch.column(row_id)
            if open_id is not None:
                ids, sums = pa.concat_arrays([open_id, ids]), np.vstack([open_sums, sums])
            code = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            ids, sums = ids.take(pa.array(first)), np.add.reduceat(sums, first)
            open_id, open_sums = ids[-1:], sums[-1:]
            if len(ids) > 1:
                yield lines(ids[:-1], sums[:-1])
        if open_id is not None:
            yield lines(open_id, open_sums)

    return dealt.withColumn("_seed", F.xxhash64(row_id)).sortWithinPartitions(row_id).mapInArrow(reduce, sums_type)


def local_surrogate(
    df: DataFrame,
    model: Model,
    names: list[str],
    row_id: str,
    features: str = "features",
    samples: int = 500,
    target: int = 1,
    ridge: float = 1e-3,
) -> DataFrame:
    """Weights of a local linear model around each row: (row, feature, weight), and an ``(intercept)``.

    Each row is perturbed with standard normal noise and scored. A weighted
    least-squares fit per row needs only sums over its samples (products of the
    inputs, products with the probability), so each Arrow batch of scored samples is
    reduced to one line of sums per row; only these lines are shuffled, and small
    systems are solved for many rows at once. A single decision tree is scored by the
    tasks that make the samples, so no sample leaves them and only the rows are
    shuffled; samples and weights are the same. ``row_id`` is unique and not null.
    """
    d = len(names)
    width = 0.75 * float(np.sqrt(d))
    at = np.triu_indices(d + 2)
    sums_type = T.StructType([df.schema[row_id], T.StructField("_sums", T.ArrayType(T.DoubleType()))])
    labels = F.array(*[F.lit(n) for n in ["(intercept)", *names]])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sums in batches:
            if not len(sums):
                yield pd.Series([], dtype=object)
                continue
            square = np.zeros((len(sums), d + 2, d + 2))
            square[:, at[0], at[1]] = square[:, at[1], at[0]] = np.vstack(sums.to_numpy())
            left = square[:, : d + 1, : d + 1] + ridge * np.eye(d + 1)
            yield pd.Series(list(np.linalg.solve(left, square[:, : d + 1, d + 1 :])[:, :, 0]))

    def fitted(total: DataFrame) -> DataFrame:
        weights = total.select(row_id, F.arrays_zip(labels.alias("feature"), solve("_sums").alias("weight")).alias("_w"))
        # never empty; the plain form would filter on the solution first and so solve twice
        return weights.select(row_id, F.inline_outer("_w").alias("feature", "weight"))

    if tree := _Tree.of(model, df.sparkSession, features, target):
        return fitted(_tree_sums(_dealt(df, row_id, features, samples, TREE_ROWS), tree, row_id, d, samples, width, sums_type))

    x = [F.get("_x", F.lit(j)) for j in range(d)]

    def noise(j: int) -> Column:
        radius = F.sqrt(-2 * F.ln(_unit(F.col(row_id), F.col("_s"), F.lit(j), F.lit(1))))
        return radius * F.cos(2 * np.pi * _unit(F.col(row_id), F.col("_s"), F.lit(j), F.lit(2)))

    # one expression per feature: unlike a function over an array, these are compiled
    noisy = (
        _dealt(df, row_id, features, samples)
        .withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .withColumn("_z", F.array(*[F.when(F.col("_s") == 0, x[j]).otherwise(x[j] + noise(j)) for j in range(d)]))
    )
    gap = F.array(*[F.get("_z", F.lit(j)) - x[j] for j in range(d)])
    scored = model.transform(noisy.withColumn(features, array_to_vector("_z"))).select(
        row_id, gap.alias("_gap"), F.get(vector_to_array("probability"), F.lit(target)).alias("_p")
    )

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            full = np.ones((n, d + 2))
            full[:, 1:-1] = batch.column("_gap").flatten().to_numpy(zero_copy_only=False).reshape(n, d)
            full[:, -1] = batch.column("_p").to_numpy(zero_copy_only=False)
            weight = np.exp(-(full[:, 1:-1] ** 2).sum(axis=1) / width**2)
            # samples of a row follow each other, so a row has one line in a batch, two if it goes on in the next
            ids = batch.column(row_id)
            code = pc.dictionary_encode(ids).indices.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            weighted = full * weight[:, None]
            sums = np.stack([(weighted[i:j].T @ full[i:j])[at] for i, j in zip(first, np.r_[first[1:], n])])
            offsets = np.arange(len(first) + 1, dtype=np.int32) * len(at[0])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))], [row_id, "_sums"])

    lines = scored.mapInArrow(reduce, sums_type)
    total = lines.groupBy(row_id).agg(F.collect_list("_sums").alias("_lines")).select(  # a line per batch that held the row
        row_id,
        F.reduce(
            F.slice("_lines", F.lit(2), F.size("_lines")), F.get("_lines", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
        ).alias("_sums"),
    )
    return fitted(total)
