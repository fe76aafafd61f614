"""Adaptive controllers over long sequences.

A controller is a sequential fold per stream, and one stream may hold a third
of all rows. The sequence is therefore cut into blocks. What a block does to the
controller is summarised independently of the state it starts in (a linear map
for the moving average, a state-to-state table for the bounded controllers);
the small summaries are chained per stream, and each block is then replayed
from its true start. The results equal the row-by-row fold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.config import ChunkConfig, SignificanceConfig
from flowdrift.operators.ordering import in_blocks, number_rows, running_sums
from flowdrift.session import materialize

BLOCK = 10_000


def _field(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType, True) for n in names]


def affine_scan(gain: np.ndarray, add: np.ndarray, start: float = 0.0) -> np.ndarray:
    """All states of x -> gain[i] x + add[i] from ``start``: maps are composed over doubling distances, not row by row."""
    gain, add = gain.astype(float), add.astype(float)
    step = 1
    while step < len(gain):
        add[step:] = gain[step:] * add[:-step] + add[step:]
        gain[step:] = gain[step:] * gain[:-step]
        step *= 2
    return gain * start + add


def _linear_block(values: np.ndarray, decay: float, start: float = 0.0) -> np.ndarray:
    return affine_scan(np.full(len(values), decay), (1.0 - decay) * np.asarray(values, float), start)


def composed(maps: np.ndarray) -> np.ndarray:
    """One table for all rows of ``maps`` (state before to state after) one after the other, joined pair by pair."""
    if not len(maps):
        return np.arange(maps.shape[1])
    while len(maps) > 1:
        rest = maps[len(maps) // 2 * 2 :]
        maps = np.concatenate([np.take_along_axis(maps[1::2], maps[: len(maps) // 2 * 2 : 2], axis=1), rest])
    return maps[0]


def followed(maps: np.ndarray, start: int) -> np.ndarray:
    """The state before each row. Stretches of rows are composed side by side, chained, then followed side by side."""
    n, width = maps.shape
    stretch = max(1, int(np.sqrt(n)))
    whole = n // stretch
    side = maps[: whole * stretch].reshape(whole, stretch, width)
    ends = np.broadcast_to(np.arange(width), (whole, width))
    for k in range(stretch):
        ends = np.take_along_axis(side[:, k], ends, axis=1)
    state, starts = start, np.empty(whole, dtype=int)
    for k in range(whole):
        starts[k], state = state, ends[k, state]
    out, every = np.empty(n, dtype=int), np.arange(whole)
    for k in range(stretch):
        out[k : whole * stretch : stretch] = starts
        starts = side[every, k, starts]
    for k in range(whole * stretch, n):  # fewer than a stretch
        out[k], state = state, maps[k, state]
    return out


def repeated(maps: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Each row's table applied ``times`` times, by squaring."""
    out = np.broadcast_to(np.arange(maps.shape[1]), maps.shape).copy()
    times = np.asarray(times, dtype=np.int64).copy()
    while times.any():
        odd = times % 2 == 1
        out[odd] = np.take_along_axis(maps[odd], out[odd], axis=1)
        times //= 2
        if times.any():
            maps = np.take_along_axis(maps, maps, axis=1)
    return out


def moving_average(
    df: DataFrame, position: str, value: str, decay: float, by: list[str], name: str = "ema", block: int = BLOCK
) -> DataFrame:
    """Exponential moving average from 0 along positions 1, 2, ... of each stream."""
    parts = df.withColumn("_block", F.floor((F.col(position) - 1) / block)).withColumn("_v", F.col(value).cast("double"))
    keys = [*by, "_block"]

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position)
        local = _linear_block(pdf["_v"].to_numpy(), decay)
        head = pdf.iloc[[0]][keys]
        return head.assign(_gain=decay ** len(pdf), _end=local[-1])

    schema = T.StructType([*_field(parts, keys), T.StructField("_gain", T.DoubleType()), T.StructField("_end", T.DoubleType())])
    blocks = parts.select(*keys, position, "_v").groupBy(*keys).applyInPandas(summary, schema)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        after = affine_scan(pdf["_gain"].to_numpy(), pdf["_end"].to_numpy())
        return pdf[keys].assign(_start=np.concatenate([[0.0], after[:-1]]))

    schema = T.StructType([*_field(parts, keys), T.StructField("_start", T.DoubleType())])
    starts = blocks.groupBy(*by).applyInPandas(chain, schema)

    def replay(pdf: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position)
        return pdf.drop(columns="_v").assign(**{name: _linear_block(pdf["_v"].to_numpy(), decay, first["_start"].iloc[0])})

    out = T.StructType([*_field(parts, [*df.columns, "_block"]), T.StructField(name, T.DoubleType())])
    return (
        parts.groupBy(*keys)
        .cogroup(starts.groupBy(*keys))
        .applyInPandas(replay, out)
        .drop("_block")
    )


def drift_ema(
    chunks: DataFrame, position: str = "chunk_no", drift: str = "drift", decay: float = 0.9,
    by: list[str] | None = None, block: int = BLOCK,
) -> DataFrame:
    """Moving average of the cumulative drift rate; ``position`` counts chunks from 1 in each stream."""
    by = by or []
    counted = running_sums(chunks, by, position, {"_drifts": F.col(drift).cast("int")})
    rated = counted.withColumn("drift_rate", F.col("_drifts") / F.col(position)).drop("_drifts")
    return moving_average(rated, position, "drift_rate", decay, by, "drift_ema", block)


def finite_state_scan(
    df: DataFrame,
    position: str,
    by: list[str],
    start: int,
    tables: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]],
    name: str = "state",
    halo: int = 0,
    block: int = BLOCK,
) -> DataFrame:
    """State index after each row of a controller with finitely many states.

    ``tables`` maps a sorted pandas block (with the ``halo`` rows before it) to
    two integer matrices with one row per input row and one column per state:
    the state reported for the row and the state carried to the next row.
    """
    parts = in_blocks(df, position, halo, block) if halo else (
        df.withColumn("_block", F.floor((F.col(position) - 1) / block)).withColumn("_own", F.lit(True))
    )
    keys, columns = [*by, "_block"], df.columns

    def owned(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values(position, ignore_index=True)
        emit, carry = tables(pdf)
        own = pdf["_own"].to_numpy()
        return pdf[own], emit[own], carry[own]

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, _, carry = owned(pdf)
        if mine.empty:
            return pdf.iloc[:0][keys].assign(_map=pd.Series([], dtype=object))
        return mine.iloc[[0]][keys].assign(_map=[composed(carry).tolist()])

    schema = T.StructType([*_field(parts, keys), T.StructField("_map", T.ArrayType(T.IntegerType()))])
    blocks = parts.groupBy(*keys).applyInPandas(summary, schema)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        return pdf[keys].assign(_start=followed(np.stack(pdf["_map"].to_numpy()), start))

    schema = T.StructType([*_field(parts, keys), T.StructField("_start", T.IntegerType())])
    starts = blocks.groupBy(*by).applyInPandas(chain, schema)

    def replay(pdf: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        mine, emit, carry = owned(pdf) if len(pdf) else (pdf, np.empty((0, 1)), np.empty((0, 1)))
        before = followed(carry, int(first["_start"].iloc[0]) if len(first) else start)
        return mine[columns].assign(**{name: emit[np.arange(len(mine)), before]})

    out = T.StructType([*_field(df, df.columns), T.StructField(name, T.IntegerType())])
    return parts.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(replay, out)


def size_moves(config: ChunkConfig) -> np.ndarray:
    """Tables over the sizes (counted from the smallest one): keep, halve, grow by the step."""
    sizes = np.arange(config.min_size, config.max_size + 1)
    halved = np.maximum(config.min_size, sizes // 2) - config.min_size
    grown = np.minimum(config.max_size, sizes + config.step) - config.min_size
    return np.stack([np.arange(len(sizes)), halved, grown]).astype(np.int32)


def which_move(ema: np.ndarray, chunk_no: np.ndarray, config: ChunkConfig) -> np.ndarray:
    """Row of ``size_moves`` after chunk ``chunk_no`` (from 1); between two moves lie ``cooldown`` chunks."""
    due = (np.asarray(chunk_no) - 1) % (config.cooldown + 1) == 0
    return np.where(due & (ema > config.shrink_above), 1, np.where(due & (ema < config.grow_below), 2, 0))


def adaptive_chunks(
    chunks: DataFrame,
    config: ChunkConfig | None = None,
    position: str = "chunk_no",
    drift: str = "drift",
    by: list[str] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Chunk size after each chunk of a known drift sequence: adds ``drift_ema`` and ``chunk_size``."""
    config, by = config or ChunkConfig(), by or []
    averaged = materialize(drift_ema(chunks, position, drift, config.ema_decay, by, block))
    moves = size_moves(config)

    def tables(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = moves[which_move(pdf["drift_ema"].to_numpy(), pdf[position].to_numpy(), config)]
        return rows, rows

    scanned = finite_state_scan(averaged, position, by, config.init_size - config.min_size, tables, "_size", block=block)
    return scanned.withColumn("chunk_size", F.col("_size") + config.min_size).drop("_size")


def alpha_levels(config: SignificanceConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All reachable significance levels with the index one step up and one step down."""
    up = lambda a: round(min(a + config.step, config.max_alpha), 10)
    down = lambda a: round(max(a - config.step, config.min_alpha), 10)
    levels, queue = {round(config.min_alpha, 10)}, [round(config.min_alpha, 10)]
    while queue:
        a = queue.pop()
        for b in (up(a), down(a)):
            if b not in levels:
                levels.add(b)
                queue.append(b)
    ordered = sorted(levels)
    at = {a: i for i, a in enumerate(ordered)}
    return np.array(ordered), np.array([at[up(a)] for a in ordered]), np.array([at[down(a)] for a in ordered])


def alpha_moves(rates: np.ndarray, config: SignificanceConfig) -> np.ndarray:
    """Next level index for every row (drift rate per level) and every current level."""
    levels, up, down = alpha_levels(config)
    stay = np.arange(len(levels))
    return np.where(rates > config.increase_above, up, np.where(rates < config.decrease_below, down, stay))


def trailing_rates(p: np.ndarray, window: int, levels: np.ndarray) -> np.ndarray:
    """Share of the last ``window`` values (fewer at the start) below each level, per row."""
    below = np.vstack([np.zeros(len(levels)), np.cumsum(p[:, None] < levels[None, :], axis=0)])
    end = np.arange(1, len(p) + 1)
    begin = np.maximum(0, end - window)
    return (below[end] - below[begin]) / (end - begin)[:, None]


class Levels:
    """The significance controller of one stream between two of its rows: for each class the number of its level and its last p-values."""

    def __init__(self, config: SignificanceConfig, held: dict | None = None) -> None:
        self.config = config
        self.values = alpha_levels(config)[0]
        self.held: dict = {c: (int(level), list(seen)) for c, (level, seen) in (held or {}).items()}

    @property
    def lowest(self) -> int:
        return int(np.argmin(np.abs(self.values - self.config.min_alpha)))

    def alpha(self, cls) -> float:
        return float(self.values[self.held[cls][0]])

    def observe(self, classes: list, p_values: list[float]) -> None:
        """Add p-values to the windows of their classes, then let every known class take one step."""
        for cls in dict.fromkeys([*self.held, *classes]):
            level, seen = self.held.get(cls, (self.lowest, []))
            seen = [*seen, *(p for c, p in zip(classes, p_values) if c == cls)][-self.config.window :]
            rates = trailing_rates(np.array(seen), self.config.window, self.values)[-1:]
            self.held[cls] = int(alpha_moves(rates, self.config)[0, level]), seen

    def scan(self, classes: np.ndarray, p_values: np.ndarray) -> np.ndarray:
        """``observe`` for one row after the other; returns the level of each row's class after the row.

        A class is looked at apart: its rows give tables of moves, the rows of other classes repeat the last one.
        """
        n, out = len(classes), np.empty(len(classes))
        window = self.config.window
        for cls in dict.fromkeys([*self.held, *classes.tolist()]):
            at = np.flatnonzero(classes == cls)
            level, seen = self.held.get(cls, (self.lowest, []))
            values = np.concatenate([seen, p_values[at]])
            moves = alpha_moves(trailing_rates(values, window, self.values), self.config)
            if len(seen):
                early = np.array([at[0] if len(at) else n])
                level = int(repeated(moves[len(seen) - 1 : len(seen)], early)[0, level])
            if len(at):
                own = moves[len(seen) :]
                carry = repeated(own, np.diff(np.append(at, n)))
                before = followed(carry, level)
                out[at] = self.values[own[np.arange(len(at)), before]]
                level = int(carry[-1, before[-1]])
            self.held[cls] = level, values[-window:].tolist()
        return out


def adaptive_significance(
    df: DataFrame,
    config: SignificanceConfig | None = None,
    order: list[str] | None = None,
    by: list[str] | None = None,
    cls: str = "class",
    p_value: str = "p_value",
    block: int = BLOCK,
    start: Levels | None = None,
) -> DataFrame:
    """Significance level of each row's class after that row's p-value was added.

    Every row is one update of its stream: the level of every class seen so far
    takes one step, whether or not the row belongs to it. Between two rows of a
    class its window does not change, so the steps in between are repeated moves
    of one table. Adds ``step_no`` and ``alpha``. ``start`` is the controller before
    the first row of a single stream; its p-values come before the rows as rows that take no step.
    """
    config, by, order = config or SignificanceConfig(), by or [], order or ["step"]
    if start is not None and by:
        raise ValueError("a start is that of a single stream")
    levels, _, _ = alpha_levels(config)
    numbered = number_rows(df, order, by, "step_no")
    seeded = [] if start is None else [(c, p, k + 1, lvl) for c, (lvl, seen) in start.held.items() for k, p in enumerate(seen)]
    per_class = number_rows(numbered, ["step_no"], [*by, cls], "_nth").withColumns({"_seed": F.lit(None).cast("int")})
    if seeded:
        kind = {c: df.schema[c].dataType.simpleString() for c in (cls, p_value)}
        seeds = df.sparkSession.createDataFrame(seeded, f"`{cls}` {kind[cls]}, `{p_value}` double, _nth bigint, _seed int")
        held = seeds.groupBy(F.col(cls).alias("_c")).agg(F.count(F.lit(1)).alias("_held"))
        per_class = per_class.join(F.broadcast(held), F.col(cls).eqNullSafe(F.col("_c")), "left")  # one row for each class
        per_class = per_class.withColumn("_nth", F.col("_nth") + F.coalesce("_held", F.lit(0))).drop("_c", "_held")
        per_class = per_class.unionByName(seeds.withColumn("step_no", F.lit(0).cast("bigint")), allowMissingColumns=True)
    per_class = materialize(per_class)
    halo = config.window
    paired = in_blocks(per_class.select(*by, cls, "_nth", "step_no"), "_nth", 1, max(block, 2))
    after = Window.partitionBy(*by, cls, "_block").orderBy(F.desc("_nth"))
    gaps = (
        paired.withColumn("_next", F.lag("step_no").over(after))
        .groupBy(*by, cls, "_nth")
        .agg((F.max("_next") - F.max("step_no")).alias("_gap"))
        .withColumnsRenamed({c: f"_g{c}" for c in [*by, cls, "_nth"]})
    )
    match = F.lit(True)
    for c in [*by, cls, "_nth"]:
        match = match & F.col(c).eqNullSafe(F.col(f"_g{c}"))
    rows = per_class.join(gaps, match, "left").drop(*[f"_g{c}" for c in [*by, cls, "_nth"]])

    def tables(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        emit = alpha_moves(trailing_rates(pdf[p_value].to_numpy(dtype=float), config.window, levels), config)
        seed, gap = pdf["_seed"].to_numpy(dtype=float), pdf["_gap"].fillna(1).to_numpy()
        early = ~np.isnan(seed)
        steps = np.where(early, np.maximum(gap - 1, 0), gap)
        # the move is monotone in the level, so it settles within len(levels) repeats
        carry = repeated(emit, np.minimum(steps, len(levels)))
        carry[early] = np.take_along_axis(carry[early], np.broadcast_to(seed[early].astype(int)[:, None], carry[early].shape), axis=1)
        return emit, carry

    scanned = finite_state_scan(
        rows, "_nth", [*by, cls], int(np.argmin(np.abs(levels - config.min_alpha))), tables, "_level",
        halo=halo, block=max(block, halo),
    )
    alphas = F.array(*[F.lit(float(a)) for a in levels])
    return scanned.filter("_seed IS NULL").select(*df.columns, "step_no", F.get(alphas, F.col("_level")).alias("alpha"))
