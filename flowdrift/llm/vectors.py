"""Near duplicates of embeddings: int8 tile products with error bounds, exact cosines only where the bounds leave it open."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.llm.graph import components
from flowdrift.llm.text import empty_like, quoted
from flowdrift.session import materialize

SIMILAR = 0.9
TILE = 1024  # vectors of a tile; a product of two tiles is one dense array
STRIP_BYTES = 8 << 20  # of vectors in full precision; a task holds two strips
LEAST_STRIP = 512  # vectors; more strips than this allows are not worth a task each
STRIPS = 16  # strips of a small table, so that all cores have pairs of strips
EXACT = 1 << 17  # cosines recomputed at once
MOST_TASKS = 20_000  # beyond it a task gets several pairs of strips, one after the other
WIDE = 1 << 10  # components whose int8 products add up without rounding in single precision


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of ``x`` as unit vectors u: int8 rows q, their scales s, the errors |u - s q|, the lengths |s q|.

    The errors are rounded up by more than the double arithmetic can lose, so they bound the true ones.
    """
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    kept = scale[:, None] * q
    return q, scale, np.linalg.norm(unit - kept, axis=1) + 1e-9, np.linalg.norm(kept, axis=1) + 1e-9


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows (as floats): 1024 times 127 squared is below 2 to the 24th."""
    out = None
    for k in range(0, a.shape[1], WIDE):
        part = a[:, k : k + WIDE].astype(np.float32) @ b[:, k : k + WIDE].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


class _Strip:
    def __init__(self, row: dict):
        self.id = np.frombuffer(row["ids"], np.int64)
        self.weight = np.frombuffer(row["weights"], np.int64)
        n = len(self.id)
        self.x = np.frombuffer(row["vectors"], np.dtype(row["kind"])).reshape(n, -1)
        self.q = np.frombuffer(row["quantised"], np.int8).reshape(n, -1)
        self.scale, self.error, self.length = np.frombuffer(row["bounds"], np.float64).reshape(3, n)


def _links(a: _Strip, b: _Strip, i: int, j: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs of tile ``i`` of one strip and tile ``j`` of the other.

    With u = s q + r the product of two unit vectors differs from that of the quantised ones by |r_a| + |s q_a| |r_b|
    at most. Pairs surely above or below the threshold are decided by that; the others get their cosine.
    """
    one, two = slice(i, i + TILE), slice(j, j + TILE)
    about = _product(a.q[one], b.q[two]) * b.scale[two].astype(np.float32)
    # 1e-6 covers the rounding of the scales and products to single precision
    slack = a.error[one].max() + a.length[one].max() * b.error[two].max() + 1e-6
    reach = ((least - slack) / a.scale[one]).astype(np.float32)
    x, y = np.nonzero(about >= (reach - np.abs(reach) * np.float32(1e-6))[:, None])
    if not len(x):
        return x, y
    close = about[x, y] * a.scale[one][x]
    x, y = x + i, y + j
    bound = a.error[x] + a.length[x] * b.error[y] + 1e-6
    linked = close - bound >= least
    open_ = np.flatnonzero(~linked & (close + bound >= least))
    for k in range(0, len(open_), EXACT):
        some = open_[k : k + EXACT]
        linked[some] = cosine(a.x[x[some]].astype(np.float64), b.x[y[some]].astype(np.float64)) >= least
    return x[linked], y[linked]


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the components of places x and y in ``label`` (a place's label is the smallest place of its component)."""
    while True:
        p, q = label[x], label[y]
        apart = np.flatnonzero(p != q)
        if not len(apart):
            return
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


_PACKED = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("strip", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        *(T.StructField(c, T.BinaryType()) for c in ("ids", "weights", "vectors", "quantised", "bounds")),
    ]
)
_LINKED = T.StructType([T.StructField(c, T.LongType()) for c in ("node", "low", "n")])


def _pack(rows: pa.Table) -> pa.Table:
    width, strip = rows["width"][0].as_py(), rows["strip"][0].as_py()
    flat = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(rows.num_rows, width)
    q, scale, error, length = quantised(x.astype(np.float64))
    one = {
        "width": width, "strip": strip, "kind": x.dtype.str,
        "ids": rows["node"].to_numpy().astype(np.int64).tobytes(), "weights": rows["copies"].to_numpy().astype(np.int64).tobytes(),
        "vectors": np.ascontiguousarray(x).tobytes(), "quantised": q.tobytes(), "bounds": np.stack([scale, error, length]).tobytes(),
    }
    return pa.Table.from_pylist([one], empty_like(_PACKED))


def _compare(least: float):
    arrow = empty_like(_LINKED)

    def run(rows: pa.Table) -> pa.Table:
        alone = rows["t"][0].as_py() == rows["u"][0].as_py()
        if not alone and rows.num_rows == 1:
            return arrow.empty_table()  # no vector was dealt to the other strip
        strips = [_Strip(r) for r in rows.sort_by("strip").to_pylist()]
        a, b = strips[0], strips[-1]
        n = len(a.id)
        ids = a.id if alone else np.concatenate([a.id, b.id])
        shift = 0 if alone else n
        label, found = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for i in range(0, n, TILE):
            for j in range(i if alone else 0, len(b.id), TILE):
                x, y = _links(a, b, i, j, least)
                if alone and i == j:
                    x, y = x[x < y], y[x < y]
                if not len(x):
                    continue
                found += np.bincount(x, b.weight[y], len(ids)).astype(np.int64)
                found += np.bincount(y + shift, a.weight[x], len(ids)).astype(np.int64)
                _joined(label, x, y + shift)
        some = np.flatnonzero(found)
        return pa.table({"node": ids[some], "low": ids[label[some]], "n": found[some]}, schema=arrow)

    return run


def similar_vectors(vectors: DataFrame, least: float = SIMILAR, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of ``vectors``.

    Two vectors of one width are linked when their cosine in double precision is at least ``least`` (above zero).
    ``n_links`` counts the other rows that a row is linked with, ``component_id`` is the smallest id it reaches by
    links. A null, empty or zero vector and one with a null, NaN or infinite component is linked with nothing, and
    so are vectors of another width. Repeated rows are vectors of their own, linked with each other. A null id is no
    smallest id; where only null ids are joined, ``component_id`` is null and the rows are kept. Other columns have
    no effect.

    1. Equal vectors become one with a weight (a 128-bit key), so copies cost nothing later.
    2. Different ones are dealt to strips. A strip is one row: int8 vectors with a scale, a bound of the error for
       each vector, and the vectors themselves.
    3. A task compares two strips tile by tile. It emits one row for each vector that has links: how many, and the
       smallest member of its component in this task. No pair leaves a task.
    4. Components of these rows, then the result for each row by its key.

    All pairs are compared, which is the method; a task's memory is bounded by two strips and one tile product.
    """
    if not least > 0:
        raise ValueError("the threshold must be above zero")
    rows = vectors.select(quoted(vec_id).cast("long").alias("vec_id"), quoted(embedding).alias("vector"))
    zero = F.lit(0.0)
    usable = (
        (F.size("vector") > 0)
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists("vector", lambda v: v != zero)
    )
    key = F.unhex(F.md5(F.to_json(F.struct("vector")).cast("binary")))
    rows = rows.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), key))
    classes = rows.filter("key is not null").groupBy("key").agg(
        F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")
    )
    classes = materialize(classes.withColumns({"node": F.monotonically_increasing_id(), "width": F.size("vector")}))
    total = classes.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("width"), F.lit(0)).alias("values")).first()
    strips = max(1, -(-total["values"] * 4 // STRIP_BYTES), min(STRIPS, -(-total["rows"] // LEAST_STRIP)))
    placed = classes.withColumn("strip", F.pmod(F.xxhash64("node"), F.lit(strips)).cast("int"))
    packed = materialize(placed.select("width", "strip", "node", "copies", "vector").groupBy("width", "strip").applyInArrow(_pack, _PACKED))
    peers = packed.withColumn("peer", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    peers = peers.select(*packed.columns, F.least("strip", "peer").alias("t"), F.greatest("strip", "peer").alias("u"))
    # Pairs of strips are few bytes and much work, so their number is that of the tasks, whatever their size.
    tasks = min(strips * (strips + 1) // 2, MOST_TASKS)
    linked = materialize(peers.repartition(tasks, "width", "t", "u").groupBy("width", "t", "u").applyInArrow(_compare(least), _LINKED))
    labels = components(linked, "node", "low").withColumnsRenamed({"node": "_node", "label": "_label"})
    ids = classes.select("node", "least")
    lowest = labels.join(ids, F.col("node") == F.col("_node")).groupBy("_label").agg(F.min("least").alias("_low")).withColumnRenamed("_label", "_l")
    reached = labels.join(lowest, F.col("_label") == F.col("_l")).select("_node", "_l", "_low")
    links = linked.groupBy(F.col("node").alias("_linked")).agg(F.sum("n").alias("_n"))
    result = (
        classes.select("key", "node", "copies", "least")
        .join(links, F.col("node") == F.col("_linked"), "left")
        .join(reached, F.col("node") == F.col("_node"), "left")
        .select(
            F.col("key").alias("_key"),
            (F.col("copies") - 1 + F.coalesce("_n", F.lit(0))).alias("_links"),
            F.when(F.col("_l").isNull(), F.col("least")).otherwise(F.col("_low")).alias("_component"),
        )
    )
    result = materialize(result)  # as a table it leaves the join free to split a vector of many copies
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("_component"))
    return rows.join(result, F.col("key") == F.col("_key"), "left").select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
