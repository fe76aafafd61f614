"""Exact k nearest neighbours by Euclidean distance, with blocks that the triangle inequality rules out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.operators.ordering import number_rows
from flowdrift.session import materialize

# Training rows of one block; beyond MAX_BLOCKS blocks the blocks grow instead.
BLOCK_ROWS = 4096
MAX_BLOCKS = 16384
# Cells around pivots: as many as give each a quarter of a block's rows, up to MAX_PIVOTS.
CELLS = 4
MAX_PIVOTS = 1024
TEST_ROWS = 20_000
STEP = 256
# Numbers on each side of one tile of the search through further blocks: 65,536 rows of 64 dimensions.
TILE_VALUES = 1 << 22
# Fewer rows than that are still cut into so many parts on each side.
SIDES = 8
# Distances that one matrix product gives.
PRODUCT = 1 << 18


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T, 0.0)


_HITS = T.ArrayType(
    T.StructType(
        [T.StructField("squared", T.DoubleType()), T.StructField("id", T.LongType()), T.StructField("label", T.LongType())]
    )
)


_HITS_KIND = pa.list_(pa.struct([("squared", pa.float64()), ("id", pa.int64()), ("label", pa.int64())]))


@dataclass(frozen=True)
class Blocks:
    """Training rows by block, and what the pruning knows of each block: its pivot, the range of distances to it, its rows."""

    rows: DataFrame
    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray


def _flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of an Arrow column as a matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if whole.null_count:
        raise ValueError("a row without a vector")
    return whole.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(whole), -1)


def _with(batch: pa.RecordBatch, more: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The batch with further columns; its own are not touched."""
    return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more.values())], [*batch.schema.names, *more])


def _nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest pivot of each row and the distance to it."""
    right = np.ascontiguousarray(np.hstack([-2 * pivots, (pivots**2).sum(axis=1)[:, None]]).T)
    left = np.hstack([x, np.ones((len(x), 1))])
    own = np.concatenate([(left[i : i + STEP] @ right).argmin(axis=1) for i in range(0, len(x), STEP)])
    return own, np.sqrt(((x - pivots[own]) ** 2).sum(axis=1))


def cut_blocks(rows: DataFrame, block_rows: int | None = None) -> Blocks:
    """Cut training rows (``_id``, ``_label``, ``_x``) into cells around pivots and each cell into rings of bounded size.

    Pivots are rows in hash order. A row belongs to the nearest pivot; the rows of a
    cell are numbered by their distance to it, over ranges of (cell, distance), so a
    crowded cell is many blocks and never one task. Few rows are one block. Pivots (``MAX_PIVOTS`` at most)
    and one line per block (``MAX_BLOCKS`` and one more per cell) reach the driver.
    """
    total = rows.count()
    if not total:
        raise ValueError("no training rows")
    width = max(block_rows or BLOCK_ROWS, -(-total // MAX_BLOCKS))
    if total <= width:
        d = rows.select(F.size("_x").alias("d")).first()["d"]
        one = np.zeros(1)
        return Blocks(rows.withColumn("_block", F.lit(0).cast("long")), np.zeros((1, d)), one.astype(int), one, one + np.inf, one + total)
    wanted = min(MAX_PIVOTS, CELLS * total // width)
    chosen = rows.orderBy(F.xxhash64("_id"), "_id").limit(wanted).select("_x").collect()
    pivots = np.unique(np.array([r["_x"] for r in chosen], dtype=float), axis=0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _with(batch, dict(zip(("_cell", "_gap"), _nearest_pivot(_flat(batch.column("_x")), pivots))))

    schema = T.StructType([*rows.schema.fields, T.StructField("_cell", T.LongType()), T.StructField("_gap", T.DoubleType())])
    placed = number_rows(rows.mapInArrow(place, schema), ["_gap", "_id"], ["_cell"], "_place")
    ringed = materialize(placed.withColumn("_ring", F.floor((F.col("_place") - 1) / width)).drop("_place"))
    lines = (
        ringed.groupBy("_cell", "_ring")
        .agg(F.min("_gap").alias("low"), F.max("_gap").alias("high"), F.count(F.lit(1)).alias("size"))
        .orderBy("_cell", "_ring")
        .toPandas()
    )
    spark = rows.sparkSession
    numbers = spark.createDataFrame(
        [(int(c), int(r), i) for i, (c, r) in enumerate(zip(lines["_cell"], lines["_ring"]))], "_cell long, _ring long, _block long"
    )
    cut = ringed.join(F.broadcast(numbers), ["_cell", "_ring"]).select("_id", "_label", "_x", "_block")
    return Blocks(cut, pivots, *(lines[c].to_numpy() for c in ("_cell", "low", "high", "size")))


def _slack(x: np.ndarray, blocks: dict) -> np.ndarray:
    """What rounding may hide in a distance of each row, on the safe side."""
    reach = np.sqrt((blocks["pivots"] ** 2).sum(axis=1).max()) + blocks["high"].max()
    return 1e-6 * (1 + np.sqrt((x**2).sum(axis=1)) + reach)


def _rings(blocks: dict) -> dict:
    """``blocks`` with the first and last block of each cell, and the least and largest distance of its rows to the pivot."""
    cells = np.arange(len(blocks["pivots"]))
    start, end = (np.searchsorted(blocks["cell"], cells, side) for side in ("left", "right"))
    some, far = end > start, len(blocks["cell"]) - 1
    return {
        **blocks, "start": start, "end": end,
        "nearest": np.where(some, blocks["low"][np.minimum(start, far)], np.inf),
        "farthest": np.where(some, blocks["high"][end - 1], -np.inf),
    }


def _first(values: np.ndarray, start: np.ndarray, end: np.ndarray, wanted: np.ndarray, beyond: bool = False) -> np.ndarray:
    """For each search the first place from ``start`` on whose value, rising up to ``end``, is at least ``wanted`` (``beyond``: above it)."""
    start, end = start.copy(), end.copy()
    while (open_ := start < end).any():
        middle = (start + end) // 2
        at = values[np.minimum(middle, len(values) - 1)]
        below = open_ & ((at <= wanted) if beyond else (at < wanted))
        start, end = np.where(below, middle + 1, start), np.where(open_ & ~below, middle, end)
    return start


def _home(x: np.ndarray, blocks: dict) -> np.ndarray:
    """The block of each row: the ring of its nearest pivot that holds its distance or is nearest to it."""
    own, gap = _nearest_pivot(x, blocks["pivots"])
    start, end = blocks["start"][own], blocks["end"][own]
    after = np.minimum(_first(blocks["high"], start, end, gap), end - 1)
    before = np.maximum(after - 1, start)
    nearer = np.maximum(gap - blocks["high"][before], 0.0) <= np.maximum(np.maximum(blocks["low"][after] - gap, gap - blocks["high"][after]), 0.0)
    return np.where(start < end, np.where(nearer, before, after), 0)


def _others(x: np.ndarray, home: np.ndarray, worst: np.ndarray, k: int, blocks: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of groups of blocks that may hold a row nearer than the k-th of the home block, row after row and
    how many there are for each row, and the largest squared distance that counts.

    Cells are ruled out first; only the cells left are looked at ring by ring.
    """
    squared = _squares(x, blocks["pivots"])
    gap = np.sqrt(squared)
    slack = _slack(x, blocks)
    # a home block of fewer than k rows bounds nothing: k rows of all blocks lie within the far sides of the nearest ones
    open_rows = np.flatnonzero(np.isinf(worst))
    if len(open_rows) and blocks["size"].sum() >= k:
        far = gap[open_rows][:, blocks["cell"]] + blocks["high"]
        order = far.argsort(axis=1)
        enough = (blocks["size"][order].cumsum(axis=1) >= k).argmax(axis=1)
        reach = far[np.arange(len(far)), order[np.arange(len(far)), enough]]
        worst = worst.copy()
        worst[open_rows] = (reach + slack[open_rows]) ** 2
    radius = np.sqrt(worst + 2e-9) + slack
    row, cell = np.nonzero((gap - radius[:, None] <= blocks["farthest"]) & (gap + radius[:, None] >= blocks["nearest"]))
    # a row of another cell lies beyond the plane halfway between both pivots
    own = blocks["cell"][home]
    between, mine = blocks["apart"][own[row], cell], squared[np.arange(len(x)), own]
    plane = np.divide(squared[row, cell] - mine[row], 2 * between, out=np.zeros_like(between), where=between > slack[row])
    left = plane <= radius[row]
    row, cell = row[left], cell[left]
    near, reach = gap[row, cell], radius[row]
    start, end = blocks["start"][cell], blocks["end"][cell]
    first = _first(blocks["high"], start, end, near - reach)
    many = np.maximum(_first(blocks["low"], start, end, near + reach, beyond=True) - first, 0)
    row, block = np.repeat(row, many), np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    group = (np.searchsorted(blocks["first"], block, "right") - 1)[other := block != home[row]]
    row = row[other]
    new = np.r_[True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])][: len(row)]
    return group[new], np.bincount(row[new], minlength=len(x)), worst + 2e-9


class _Nearest:
    """The k nearest of the training rows ``t`` for each row of ``x``, block after block, within a limit that shrinks."""

    def __init__(self, x: np.ndarray, limit: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int) -> None:
        self.x, self.limit, self.t, self.ids, self.k = x, limit, t, ids, k
        self.squares = (x**2).sum(axis=1)
        own = (t**2).sum(axis=1)
        # one product gives the squared distance without the square of x
        self.left = np.hstack([x, np.ones((len(x), 1))])
        self.right = np.ascontiguousarray(np.hstack([-2 * t, own[:, None]]).T)
        self.error = 1e-9 + 1e-12 * (self.squares + own.max())
        self.squared = np.full((len(x), k), np.inf)
        self.place = np.full((len(x), k), -1)

    def meet(self, rows: np.ndarray, start: int, end: int) -> None:
        """Let ``rows`` of x see the training rows ``start`` to ``end``."""
        step = max(1, PRODUCT // (end - start))
        for i in range(0, len(rows), step):
            r = rows[i : i + step]
            apart = self.left[r] @ self.right[:, start:end]
            top = self.limit[r] - self.squares[r] + self.error[r]
            near = apart <= top[:, None]
            if end - start > self.k and np.count_nonzero(near) > 8 * self.k * len(r):
                kth = np.partition(apart, self.k - 1, axis=1)[:, self.k - 1]
                near &= apart <= (kth + 2 * self.error[r])[:, None]
            hit, at = np.nonzero(near)
            if len(hit):
                self._take(r[hit], start + at)

    def _take(self, rows: np.ndarray, places: np.ndarray) -> None:
        """Merge candidates into what is held, by (squared distance to 9 places, id)."""
        squared = np.round(((self.x[rows] - self.t[places]) ** 2).sum(axis=1), 9)
        last, k = self.squared[rows, -1], self.k
        ids = self.ids[places]
        ahead = (squared <= self.limit[rows]) & ((squared < last) | ((squared == last) & (ids < self.ids[self.place[rows, -1]])))
        rows, places, squared = rows[ahead], places[ahead], squared[ahead]
        changed = np.unique(rows)
        held = self.place[changed].ravel()
        kept = held >= 0
        rows = np.concatenate([rows, np.repeat(changed, k)[kept]])
        places = np.concatenate([places, held[kept]])
        squared = np.concatenate([squared, self.squared[changed].ravel()[kept]])
        order = np.lexsort((self.ids[places], squared, rows))
        rows, places, squared = rows[order], places[order], squared[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = rank < k
        self.squared[rows[best], rank[best]] = squared[best]
        self.place[rows[best], rank[best]] = places[best]
        self.limit[changed] = np.minimum(self.limit[changed], self.squared[changed, -1])


def _search(x: np.ndarray, home: np.ndarray, bound: np.ndarray, t: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int, blocks: dict) -> _Nearest:
    """Rows of ``x`` against training rows of some blocks (``at``, ascending), leaving out blocks as soon as the limit of a row rules them out."""
    found = _Nearest(x, bound, t, ids, k)
    numbers, starts = np.unique(at, return_index=True)
    pivots, slack, own = blocks["pivots"], _slack(x, blocks), blocks["cell"][home]
    mine = np.sqrt(((x - pivots[own]) ** 2).sum(axis=1))
    cell = gap = between = None
    for b, start, end in zip(numbers, starts, [*starts[1:], len(t)]):
        if cell != blocks["cell"][b]:
            cell = blocks["cell"][b]
            gap = np.sqrt(_squares(x, pivots[cell : cell + 1])[:, 0])
            between = np.sqrt(_squares(pivots, pivots[cell : cell + 1])[:, 0])[own]
            plane = np.divide(gap**2 - mine**2, 2 * between, out=np.zeros_like(between), where=between > slack)
        at_least = np.maximum(np.maximum(gap - blocks["high"][b], blocks["low"][b] - gap), plane)
        open_rows = np.flatnonzero((at_least <= np.sqrt(found.limit + 2e-9) + slack) & (home != b))
        found.meet(open_rows, start, end)
    return found


def _in_block(x: np.ndarray, bound: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int, pivot: np.ndarray) -> tuple[_Nearest, np.ndarray, np.ndarray]:
    """Rows of ``x`` against all training rows ``t`` of a block; what is found, and the orders of both sides in it.

    Both sides are ordered by their distance to the pivot. Some rows at about the distance of a row bound its k-th
    neighbour; rows whose distance to the pivot differs by more than that bound are left out.
    """
    gap, away = (np.sqrt(((side - pivot) ** 2).sum(axis=1)) for side in (x, t))
    mine, theirs = gap.argsort(kind="stable"), away.argsort(kind="stable")
    x, t, gap, away, bound = x[mine], t[theirs], gap[mine], away[theirs], bound[mine].copy()
    some = min(len(t), 2 * k + 6)
    if len(t) >= k:
        start = np.clip(np.searchsorted(away, gap) - some // 2, 0, len(t) - some)
        for i in range(0, len(x), STEP):
            near = t[start[i : i + STEP, None] + np.arange(some)]
            squared = ((near - x[i : i + STEP, None]) ** 2).sum(axis=2)
            bound[i : i + STEP] = np.minimum(bound[i : i + STEP], np.round(np.partition(squared, k - 1, axis=1)[:, k - 1], 9))
    found = _Nearest(x, bound, t, ids[theirs], k)
    slack = 1e-6 * (1 + np.sqrt((pivot**2).sum()) + max(gap[-1], away[-1]))
    for i in range(0, len(x), STEP):
        rows = np.arange(i, min(i + STEP, len(x)))
        reach = np.sqrt(found.limit[rows].max() + 2e-9) + slack
        first, last = np.searchsorted(away, gap[rows[0]] - reach), np.searchsorted(away, gap[rows[-1]] + reach, "right")
        if first < last:
            found.meet(rows, first, last)
    return found, mine, theirs


def _hits(found: _Nearest, ids: np.ndarray, labels: np.ndarray) -> pa.Array:
    """What a search has found as a list for each row, nearest first."""
    some = found.place >= 0
    places, ends = found.place[some], np.concatenate([[0], np.cumsum(some.sum(axis=1))])
    hits = pa.StructArray.from_arrays([pa.array(v) for v in (found.squared[some], ids[places], labels[places])], ["squared", "id", "label"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits).cast(_HITS_KIND)


def _visit(asked: DataFrame, blocks: Blocks, k: int, row_id: str, test_rows: int, many: int) -> DataFrame:
    """Candidates of each row (``row_id``, ``_x``, ``_block``, ``_bound``) in its block; one task for each (part of rows, block)."""
    if len(blocks.size) == 1:  # nothing to match: a join on the one block would be a nested loop
        n = asked.count()
        parts = max(-(-n // test_rows), min(many, n // 500), 1)
        lhs = asked.withColumn("_part", F.pmod(F.xxhash64(row_id), F.lit(parts).cast("long")))
        rhs = blocks.rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    else:
        # A block goes to as many tasks as its visitors need, counted without their vectors.
        parts = asked.groupBy("_block").agg(
            F.greatest(F.ceil(F.count(F.lit(1)) / test_rows), F.least(F.lit(many), F.floor(F.count(F.lit(1)) / 500)), F.lit(1)).alias("_parts")
        )
        parts = F.broadcast(parts)  # one line per block
        lhs = asked.join(parts, "_block").withColumn("_part", F.pmod(F.xxhash64(row_id), F.col("_parts"))).drop("_parts")
        rhs = blocks.rows.join(parts, "_block").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    out = T.StructType([asked.schema[row_id], T.StructField("hits", _HITS)])

    pivots, cell = blocks.pivots, blocks.cell

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({row_id: a[row_id].slice(0, 0), "hits": pa.array([], _HITS_KIND)})
        ids, labels = b["_id"].to_numpy(), b["_label"].to_numpy()
        pivot = pivots[cell[a["_block"][0].as_py()]]
        found, mine, theirs = _in_block(_flat(a["_x"]), a["_bound"].to_numpy(), _flat(b["_x"]), ids, k, pivot)
        return pa.table({row_id: a[row_id].take(pa.array(mine)), "hits": _hits(found, ids[theirs], labels[theirs])})

    keys = ["_block", "_part"]
    return lhs.groupBy(*keys).cogroup(rhs.groupBy(*keys)).applyInArrow(pair, out)


def knn(
    test: DataFrame,
    train: DataFrame,
    k: int,
    row_id: str,
    features: str,
    train_id: str,
    label: str,
    block_rows: int | None = None,
    test_rows: int = TEST_ROWS,
) -> DataFrame:
    """``row_id`` with its neighbours, nearest first: array of (squared, id, label).

    ``features`` is an array column of finite numbers on both sides; ``row_id`` and
    ``train_id`` are unique. The search is exact. Training rows lie in blocks: rings
    around pivots (:func:`cut_blocks`). A test row first meets the block it would lie
    in. The distance of the k-th row found there rules out every block that is
    further away by the triangle inequality (distance to the pivot against the ring)
    or by the plane between two pivots; the row meets only the blocks left, in tiles
    of many rows and blocks (:func:`_tiles`), and only candidates within that distance
    leave a task. The k best per row are picked by a ranked window, which Spark limits
    before the shuffle. With data that fills its dimensions evenly no block is ruled out
    and each row is compared with all of them, so the training side is meant to be log-sized.
    """
    rows = train.select(F.col(train_id).cast("bigint").alias("_id"), F.col(label).cast("bigint").alias("_label"), F.col(features).alias("_x"))
    return nearest_in(test, cut_blocks(distinct_enough(rows, k), block_rows), k, row_id, features, test_rows)


def homes(test: DataFrame, blocks: Blocks, row_id: str, features: str) -> DataFrame:
    """Each test row with its vector and the block it would lie in."""
    known = _rings({"pivots": blocks.pivots, "cell": blocks.cell, "low": blocks.low, "high": blocks.high})

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _with(batch, {"_block": _home(_flat(batch.column("_x")), known), "_bound": np.full(batch.num_rows, np.inf)})

    tested = test.select(F.col(row_id), F.col(features).alias("_x"))
    schema = T.StructType([*tested.schema.fields, T.StructField("_block", T.LongType()), T.StructField("_bound", T.DoubleType())])
    return materialize(tested.mapInArrow(home, schema))


def _groups(sizes: np.ndarray, rows: int) -> np.ndarray:
    """A number for each of some things in a row, so that those with equal numbers hold about ``rows`` rows together."""
    before = np.cumsum(sizes) - sizes
    return np.unique(before // max(rows, 1), return_inverse=True)[1]


def visits(first: DataFrame, placed: DataFrame, blocks: Blocks, k: int, row_id: str, shelf: np.ndarray | None = None) -> DataFrame:
    """One row for each further shelf of blocks that a test row has to meet; without ``shelf`` each block is one."""
    pivots, sides = blocks.pivots, {"cell": blocks.cell, "low": blocks.low, "high": blocks.high, "size": blocks.size}
    starts = np.arange(len(blocks.size)) if shelf is None else np.unique(shelf, return_index=True)[1]

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _rings({**sides, "pivots": pivots, "apart": np.sqrt(_squares(pivots, pivots)), "first": starts})
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                found, many, bound = _others(
                    _flat(part.column("_x")), part.column("_block").to_numpy(), part.column("_worst").to_numpy(zero_copy_only=False), k, known
                )
                shelves = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int32()), pa.array(found, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in (row_id, "_x", "_block")), shelves, pa.array(bound)], [row_id, "_x", "_block", "_shelves", "_bound"]
                ).filter(pa.array(many > 0))

    worst = F.when(F.size("hits") >= k, F.get("hits", F.lit(k - 1)).getField("squared")).otherwise(F.lit(float("inf")))
    asked = placed.select(row_id, "_x", "_block").join(first.select(row_id, worst.alias("_worst")), row_id)
    schema = T.StructType(
        [placed.schema[row_id], placed.schema["_x"], T.StructField("_block", T.LongType()), T.StructField("_shelves", T.ArrayType(T.LongType())),
         T.StructField("_bound", T.DoubleType())]
    )
    open_rows = materialize(asked.mapInArrow(others, schema))
    return open_rows.select(row_id, "_x", "_block", F.explode("_shelves").alias("_shelf"), "_bound")


def _tiles(first: DataFrame, placed: DataFrame, blocks: Blocks, k: int, row_id: str, test_rows: int) -> DataFrame:
    """Candidates of each row in the blocks beyond its own; one task for each (strip of test rows, shelf of blocks).

    A strip holds rows of consecutive home blocks, a shelf consecutive blocks. Both have a bounded number of rows, so a
    row is copied once for each strip or shelf it meets, however small the blocks are; inside a tile the blocks
    are left out row by row.
    """
    spark = placed.sparkSession
    most = max(1, TILE_VALUES // blocks.pivots.shape[1])
    total = int(blocks.size.sum())
    shelf = _groups(blocks.size, max(int(blocks.size.max()), min(most, -(-total // SIDES))))
    counted = {r["_block"]: r["count"] for r in placed.groupBy("_block").count().collect()}  # one line for each block
    asked = sum(counted.values())
    wide = max(test_rows, min(most, -(-asked // SIDES)))
    used = sorted(counted)
    strip = _groups(np.array([counted[b] for b in used]), wide)
    parts = [max(1, -(-counted[b] // wide)) for b in used]  # a crowded block is dealt to several strips
    lines = [(int(b), int(g), p) for b, g, p in zip(used, strip, parts)]
    strips = F.broadcast(spark.createDataFrame(lines, "_block long, _group long, _parts long"))
    shelves = F.broadcast(spark.createDataFrame([(i, int(v)) for i, v in enumerate(shelf)], "_block long, _shelf long"))

    lhs = visits(first, placed, blocks, k, row_id, shelf).join(strips, "_block")
    lhs = lhs.withColumn("_part", F.pmod(F.xxhash64(row_id), F.col("_parts"))).drop("_parts")
    keys = ["_group", "_part", "_shelf"]
    pairs = materialize(lhs.select(*keys).distinct())
    rhs = blocks.rows.join(shelves, "_block").join(F.broadcast(pairs), "_shelf")
    tasks = max(1, pairs.count())
    known = {"pivots": blocks.pivots, "cell": blocks.cell, "low": blocks.low, "high": blocks.high}

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({row_id: a[row_id].slice(0, 0), "hits": pa.array([], _HITS_KIND)})
        b = b.sort_by([("_block", "ascending"), ("_id", "ascending")])
        ids, labels = b["_id"].to_numpy(), b["_label"].to_numpy()
        found = _search(_flat(a["_x"]), a["_block"].to_numpy(), a["_bound"].to_numpy().copy(), _flat(b["_x"]), ids, b["_block"].to_numpy(), k, known)
        out = pa.table({row_id: a[row_id], "hits": _hits(found, ids, labels)})
        return out.filter(pa.array((found.place >= 0).any(axis=1)))

    out = T.StructType([placed.schema[row_id], T.StructField("hits", _HITS)])
    sides = (df.repartition(tasks, *keys).groupBy(*keys) for df in (lhs, rhs))
    return next(sides).cogroup(next(sides)).applyInArrow(tile, out)


def distinct_enough(rows: DataFrame, k: int) -> DataFrame:
    """Training rows without those that have ``k`` equal vectors of smaller id: they are no row's neighbour."""
    copies = Window.partitionBy(F.xxhash64("_x"), "_x").orderBy("_id")  # sorted by a number, then by the vectors
    return rows.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k).drop("_copy")


def nearest_in(test: DataFrame, blocks: Blocks, k: int, row_id: str, features: str, test_rows: int = TEST_ROWS) -> DataFrame:
    """:func:`knn` in training rows that are cut into blocks already."""
    many = max(1, test.sparkSession.sparkContext.defaultParallelism // len(blocks.size))  # few blocks still use all cores
    if len(blocks.size) == 1:  # the first block is all there is
        placed = test.select(row_id, F.col(features).alias("_x"), F.lit(0).cast("long").alias("_block"), F.lit(float("inf")).alias("_bound"))
        return _visit(placed, blocks, k, row_id, test_rows, many).withColumnRenamed("hits", "neighbours")
    placed = homes(test, blocks, row_id, features)
    first = materialize(_visit(placed, blocks, k, row_id, test_rows, many))
    further = _tiles(first, placed, blocks, k, row_id, test_rows)
    hits = first.unionByName(further).select(row_id, F.explode("hits").alias("hit"))
    best = Window.partitionBy(row_id).orderBy("hit.squared", "hit.id")
    top = hits.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k)
    return top.groupBy(row_id).agg(F.array_sort(F.collect_list("hit")).alias("neighbours"))


def knn_vote(neighbours: Column) -> Column:
    """Most frequent label of the neighbours, the smallest on a tie."""
    from flowdrift.operators.conformal import vote

    return vote(F.transform(neighbours, lambda n: n.getField("label")))


class KnnClassifier(Estimator):
    """Nearest-neighbour classifier over a feature vector; keeps the training rows."""

    def __init__(self, k: int = 5, features: str = "features", label: str = "label") -> None:
        super().__init__()
        self.k, self.features, self.label = k, features, label

    def copy(self, extra=None) -> KnnClassifier:
        return KnnClassifier(self.k, self.features, self.label)

    def _fit(self, dataset: DataFrame) -> KnnModel:
        rows = materialize(
            dataset.select(vector_to_array(self.features).alias("_x"), F.col(self.label).cast("bigint").alias("_label"))
            .withColumn("_id", F.monotonically_increasing_id())
        )
        classes = int(rows.agg(F.max("_label")).first()[0]) + 1
        return KnnModel(rows, self.k, self.features, classes)


class KnnModel(Model, MLWritable, MLReadable):
    """Adds ``prediction`` and ``probability`` (share of each class among the neighbours).

    The model is its training rows, so it is saved as a table beside the parameters.
    The blocks are cut at the first use. Scoring writes tables: batch frames only,
    a stream scores inside ``foreachBatch``.
    """

    def __init__(self, rows: DataFrame, k: int, features: str, classes: int) -> None:
        super().__init__()
        self.rows, self.k, self.features, self.classes = rows, k, features, classes
        self._blocks: Blocks | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self._blocks is None:
            self._blocks = cut_blocks(distinct_enough(self.rows.select("_id", "_label", "_x"), self.k))
        keyed = materialize(dataset.withColumn("_row", F.monotonically_increasing_id()))
        near = nearest_in(keyed.select("_row", vector_to_array(self.features).alias("_x")), self._blocks, self.k, "_row", "_x")
        labels = F.transform("neighbours", lambda n: n.getField("label"))
        share = F.transform(
            F.sequence(F.lit(0), F.lit(self.classes - 1)),
            lambda c: F.size(F.filter(labels, lambda x: x == c)) / F.size(labels),
        )
        votes = near.select("_row", knn_vote(F.col("neighbours")).cast("double").alias("prediction"), array_to_vector(share).alias("probability"))
        return keyed.join(votes, "_row").drop("_row")

    def write(self) -> KnnWriter:
        return KnnWriter(self)

    @classmethod
    def read(cls) -> KnnReader:
        return KnnReader()


class KnnWriter(MLWriter):
    """Parameters as metadata, training rows as a Parquet table."""

    def __init__(self, model: KnnModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model = self.model
        DefaultParamsWriter.saveMetadata(
            model, path, self.sparkSession, extraMetadata={"k": model.k, "features": model.features, "classes": model.classes}
        )
        model.rows.select("_id", "_label", "_x").write.parquet(f"{path}/rows")


class KnnReader(MLReader):
    """Reads what :class:`KnnWriter` has written; the rows are copied, so the saved folder may be replaced later."""

    def load(self, path: str) -> KnnModel:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = materialize(self.sparkSession.read.parquet(f"{path}/rows"))
        model = KnnModel(rows, about["k"], about["features"], about["classes"])
        model._resetUid(about["uid"])
        return model
