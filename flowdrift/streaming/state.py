"""Keyed streaming state: bounded buffers and controllers, one stream key at a time.

State per key is bounded (the last rows, the last p-values). Rows of a
micro-batch are taken in the order of their sequence number, all at once: the
controllers are the tables of ``operators.control``, not a step per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowdrift.config import SignificanceConfig
from flowdrift.operators.control import Levels


# Rows of a stream that a controller takes at once; a longer micro-batch goes through in slices.
SLICE_ROWS = 50_000


def _in_order(batches: Iterator[pd.DataFrame], seq: str) -> pd.DataFrame:
    frames = list(batches)
    return pd.concat(frames).sort_values(seq, ignore_index=True) if frames else pd.DataFrame()


def significance_stream(
    df: DataFrame, key: str, seq: str = "seq", cls: str = "class", p_value: str = "p_value",
    config: SignificanceConfig | None = None,
) -> DataFrame:
    """Significance level of each row's class after its p-value was added, per stream.

    A stream's micro-batch is held as three plain arrays (20 bytes a row); the controller's tables and the rows
    that come out exist for one slice at a time.
    """
    config = config or SignificanceConfig()
    slim = df.select(F.col(key).cast("string").alias("stream"), F.col(seq).cast("bigint").alias("seq"),
                     F.col(cls).cast("string").alias("class"), F.col(p_value).cast("double").alias("p_value"))
    out = "stream string, seq bigint, class string, p_value double, alpha double"
    held = "classes array<string>, levels array<int>, seen array<array<double>>"

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else ([], [], [])
        control = Levels(config, {c: (level, seen) for c, level, seen in zip(*before)})
        names, parts = {}, []
        for pdf in batches:
            codes = pdf["class"].map(lambda c: names.setdefault(c, len(names))).to_numpy(dtype=np.int32)
            parts.append((pdf["seq"].to_numpy(dtype=np.int64), codes, pdf["p_value"].to_numpy(dtype=float)))
        seqs, codes, p_values = (np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0, t) for t in (np.int64, np.int32, float))
        del parts
        order, known = np.argsort(seqs, kind="stable"), np.array([*names, None], dtype=object)
        for i in range(0, len(order), SLICE_ROWS):
            at = order[i : i + SLICE_ROWS]
            classes = known[codes[at]]
            found = control.scan(classes, p_values[at])
            yield pd.DataFrame({"stream": keys[0], "seq": seqs[at], "class": classes, "p_value": p_values[at], "alpha": found})
        classes = list(control.held)
        state.update((classes, *([control.held[c][k] for c in classes] for k in (0, 1))))

    return slim.groupBy("stream").applyInPandasWithState(step, out, held, "append", GroupStateTimeout.NoTimeout)


def last_n_stream(df: DataFrame, key: str, n: int, seq: str = "seq", value: str = "value") -> DataFrame:
    """After each micro-batch the newest ``n`` values of every stream that received rows, oldest first."""
    kind = df.schema[value].dataType
    slim = df.select(F.col(key).cast("string").alias("stream"), F.col(seq).cast("bigint").alias("seq"), F.col(value).alias("value"))
    out = T.StructType([T.StructField("stream", T.StringType()), T.StructField("last_seq", T.LongType()), T.StructField("values", T.ArrayType(kind))])
    held = T.StructType([T.StructField("seqs", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(kind))])

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, values = (list(x) for x in state.get) if state.exists else ([], [])
        rows = _in_order(batches, "seq")
        newest = sorted(zip(seqs + rows["seq"].tolist(), values + rows["value"].tolist()), key=lambda r: r[0])[-n:]
        seqs, values = [r[0] for r in newest], [r[1] for r in newest]
        state.update((seqs, values))
        yield pd.DataFrame({"stream": [keys[0]], "last_seq": [seqs[-1]], "values": [values]})

    return slim.groupBy("stream").applyInPandasWithState(step, out, held, "update", GroupStateTimeout.NoTimeout)
