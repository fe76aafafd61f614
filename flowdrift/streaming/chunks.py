"""Chunks whose verdicts steer the size of the next one, cut from a stream of tested rows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowdrift.config import ChunkConfig, SignificanceConfig
from flowdrift.functions.columns import parse_duration_us
from flowdrift.operators.control import Levels, size_moves, which_move

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "seq bigint, kind string, p_value double, row_drift boolean"
CHUNKED = "chunk_no bigint, chunk_rows bigint, drift boolean, alpha double, next_size bigint, whole boolean"


@dataclass
class ChunkLoop:
    """The loop of one stream between two chunks: size, moving average of the drift rate, significance levels.

    ``mode`` says how the rows of a chunk decide: its first row, any row, or a share of rows above ``rate``. With
    ``significance`` the first row's p-value is tested against the adaptive level of its class instead.
    """

    config: ChunkConfig
    mode: str = "first"
    rate: float = 0.0
    significance: SignificanceConfig | None = None
    size: int = 0
    ema: float = 0.0
    chunks: int = 0
    drifts: int = 0
    levels: Levels | None = None
    moves: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.size = self.size or self.config.init_size
        self.moves = size_moves(self.config)
        if self.significance is not None and self.levels is None:
            self.levels = Levels(self.significance)

    def dump(self) -> str:
        held = None if self.levels is None else [[c, level, seen] for c, (level, seen) in self.levels.held.items()]
        return json.dumps([self.size, self.ema, self.chunks, self.drifts, held])

    def load(self, text: str) -> ChunkLoop:
        self.size, self.ema, self.chunks, self.drifts, held = json.loads(text)
        if self.significance is not None:
            self.levels = Levels(self.significance, {c: (level, seen) for c, level, seen in held or []})
        return self

    def _closed(self, drift: bool) -> None:
        self.chunks += 1
        self.drifts += drift
        decay = self.config.ema_decay
        self.ema = decay * self.ema + (1.0 - decay) * (self.drifts / self.chunks)
        low = self.config.min_size
        self.size = low + int(self.moves[which_move(self.ema, self.chunks, self.config), self.size - low])

    def cut(self, rows: pd.DataFrame, flush: bool = False) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Rows in order, as those of whole chunks with the columns ``CHUNKED``, and the rest.

        One step per chunk; what a chunk's rows say comes from running sums. With ``flush`` the rest is a last chunk.
        """
        flags = rows["row_drift"].fillna(False).to_numpy(dtype=bool)
        upto = np.concatenate([[0], np.cumsum(flags)])
        classes, p_values = rows["kind"].to_numpy(dtype=object), rows["p_value"].to_numpy(dtype=float)
        found, at = [], 0
        while at < len(rows) and (at + self.size <= len(rows) or flush):
            end = min(at + self.size, len(rows))
            whole, hits, alpha = end - at == self.size, upto[end] - upto[at], None
            drift = {"first": bool(flags[at]), "any": hits > 0, "rate": hits > self.rate * (end - at)}[self.mode]
            if self.levels is not None and classes[at] is not None and not np.isnan(p_values[at]):
                self.levels.observe([classes[at]], [p_values[at]])
                alpha = self.levels.alpha(classes[at])
                drift = p_values[at] < alpha
            self._closed(bool(drift))
            found.append((self.chunks, end - at, bool(drift), alpha, self.size, whole))
            at = end
        names = [c.split()[0] for c in CHUNKED.split(", ")]
        per_chunk = pd.DataFrame(found, columns=names).astype({"alpha": float})
        own = per_chunk.loc[np.repeat(np.arange(len(found)), per_chunk["chunk_rows"].astype(int))].reset_index(drop=True)
        return pd.concat([rows.iloc[:at].reset_index(drop=True), own], axis=1), rows.iloc[at:]


# Rows of a stream that are cut at once; a longer micro-batch goes through in slices.
SLICE_ROWS = 100_000


class _Chunker(StatefulProcessor):
    """A value state holds the loop, a list state the rows of the unfinished chunk; a timer gives up waiting for more."""

    def __init__(self, settings: dict, wait_ms: int | None, event_time: bool) -> None:
        self.settings, self.wait_ms, self.event_time = settings, wait_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.loop = handle.getValueState("loop", "loop string")
        self.rest = handle.getListState("rest", ROW)
        self.due = handle.getValueState("due", "due bigint")

    def _loop(self) -> ChunkLoop:
        loop = ChunkLoop(**self.settings)
        return loop.load(self.loop.get()[0]) if self.loop.exists() else loop

    def _waiting(self) -> pd.DataFrame:
        held = list(self.rest.get()) if self.rest.exists() else []
        return pd.DataFrame(held, columns=[c.split()[0] for c in ROW.split(", ")])

    def _keep(self, loop: ChunkLoop, rest: pd.DataFrame) -> None:
        self.loop.update((loop.dump(),))
        self.rest.clear()
        if len(rest):
            self.rest.put([(int(r.seq), r[2], None if pd.isna(r.p_value) else float(r.p_value), None if pd.isna(r.row_drift) else bool(r.row_drift)) for r in rest.itertuples()])

    @staticmethod
    def _out(key, done: pd.DataFrame) -> pd.DataFrame:
        done.insert(0, "stream", key[0])
        return done.drop(columns=["kind", "p_value", "row_drift"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a micro-batch is held as plain arrays (21 bytes a row), sorted, and cut slice by slice
        names, parts, newest = {}, [], timerValues.getCurrentProcessingTimeInMs()
        for k, pdf in enumerate(rows):
            if self.event_time:
                newest = int(pdf["at_ms"].max()) if k == 0 else max(newest, int(pdf["at_ms"].max()))
            codes = pdf["kind"].map(lambda c: names.setdefault(c, len(names))).to_numpy(dtype=np.int32)
            flags = pdf["row_drift"].astype("boolean").to_numpy(dtype=np.int8, na_value=-1)
            parts.append((pdf["seq"].to_numpy(dtype=np.int64), codes, pdf["p_value"].to_numpy(dtype=float), flags))
        seqs, codes, p_values, flags = (np.concatenate(c) for c in zip(*parts))
        del parts
        order, known = np.argsort(seqs, kind="stable"), np.array([*names, None], dtype=object)
        loop, rest = self._loop(), self._waiting()
        for i in range(0, len(order), SLICE_ROWS):
            at = order[i : i + SLICE_ROWS]
            drift = pd.array(flags[at] > 0, dtype="boolean")
            drift[flags[at] < 0] = pd.NA
            fresh = pd.DataFrame({"seq": seqs[at], "kind": known[codes[at]], "p_value": p_values[at], "row_drift": drift})
            both = pd.concat([rest, fresh], ignore_index=True) if len(rest) else fresh
            done, rest = loop.cut(both.astype({"row_drift": "boolean"}))
            if len(done):
                yield self._out(key, done)
        self._keep(loop, rest)
        if self.wait_ms is not None:
            if self.due.exists():
                newest = max(newest, self.due.get()[0] - self.wait_ms)
                self.handle.deleteTimer(self.due.get()[0])
                self.due.clear()
            if len(rest):
                self.due.update((newest + self.wait_ms,))
                self.handle.registerTimer(newest + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        waiting = self._waiting()
        if len(waiting):
            loop = self._loop()
            done, rest = loop.cut(waiting.astype({"row_drift": "boolean"}), True)
            self._keep(loop, rest)
            yield self._out(key, done)

    def close(self) -> None:
        pass


def chunk_stream(
    df: DataFrame,
    key: str,
    seq: str = "seq",
    drift: str = "row_drift",
    cls: str | None = None,
    p_value: str | None = None,
    config: ChunkConfig | None = None,
    mode: str = "first",
    rate: float = 0.0,
    significance: SignificanceConfig | None = None,
    tail_after: str | None = None,
    ts: str | None = None,
) -> DataFrame:
    """Every row with the chunk it falls into: stream, seq, chunk_no, chunk_rows, drift, alpha, next_size, whole.

    Rows are cut in the order of ``seq`` into chunks of the size that the verdicts on the earlier chunks of the
    stream have led to. Rows that fill no chunk wait in the state for the next micro-batch. With ``tail_after`` a
    chunk that stays unfinished for that long is closed as it is (``whole`` is false): by processing time, or with
    ``ts`` by event time, when the watermark of ``df`` has passed the stream's newest row by that much.

    Rows of a later micro-batch come after those of an earlier one, whatever their ``seq``. A null flag is no drift.
    A stream is one sequence, so its micro-batch (four narrow columns) is one task; streams run in parallel.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the store that has lists and timers
    nothing = F.lit(None)
    slim = df.select(
        *([F.col(ts)] if ts else []),
        F.col(key).cast("string").alias("stream"), F.col(seq).cast("bigint").alias("seq"),
        (F.col(cls) if cls else nothing).cast("string").alias("kind"), (F.col(p_value) if p_value else nothing).cast("double").alias("p_value"),
        F.col(drift).cast("boolean").alias("row_drift"), (F.unix_millis(F.col(ts)) if ts else F.lit(0)).cast("bigint").alias("at_ms"),
    )
    settings = {"config": config or ChunkConfig(), "mode": mode, "rate": rate, "significance": significance}
    wait_ms = None if tail_after is None else parse_duration_us(tail_after) // 1000
    clock = "none" if wait_ms is None else "EventTime" if ts else "ProcessingTime"
    return slim.groupBy("stream").transformWithStateInPandas(
        _Chunker(settings, wait_ms, ts is not None), f"stream string, seq bigint, {CHUNKED}", "Append", clock
    )


def rechunk_stream(df: DataFrame, key: str, seq: str = "seq", drift: str = "drift", config: ChunkConfig | None = None, **tail) -> DataFrame:
    """``chunk_stream`` for known drift flags: the flag of a chunk's first row is its verdict."""
    return chunk_stream(df, key, seq, drift, config=config, **tail)


def chunk_table(chunked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for each chunk: first_seq, last_seq, rows, drift, alpha, next_size, whole."""
    return chunked.groupBy(*(by if by is not None else ["stream"]), "chunk_no").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("rows"),
        *[F.first(c).alias(c) for c in ("drift", "alpha", "next_size", "whole")],
    )
