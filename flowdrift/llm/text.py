"""Helpers that several corpus operators share: words, hashes, safe column names, ordered prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.session import materialize

WORD = r"[^\x20\x09-\x0D]+"

# A..Z to a..z; every other ASCII character that is no letter or digit to a blank. Bytes above 0x7F stay.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def words(data: bytes) -> list[bytes]:
    """Words between ASCII white space (blank, 0x09 to 0x0D), which is what ``bytes.split`` cuts at."""
    return data.split()


def alnum_words(data: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits (lower-cased) and of non-ASCII characters."""
    return data.translate(_ALNUM).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until it clashes with no column (names are compared without case)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def empty_like(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: T.StructType
) -> DataFrame:
    """``mapInArrow`` for a function of one batch; its result is cast to ``schema``."""
    arrow = empty_like(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = fn(batch)
            if out is None:
                continue
            table = pa.Table.from_batches([out]) if isinstance(out, pa.RecordBatch) else out
            yield from table.cast(arrow).to_batches()

    return df.mapInArrow(run, schema)


def ordered_prefix(df: DataFrame, order: list[Column], group: Column, size: Column) -> tuple[DataFrame, DataFrame]:
    """Sort ``df`` by ranges of ``order`` and add distributed prefix sums.

    Returns the stored, sorted rows with ``_part`` (range), ``_row`` (position in
    the range) and ``_before`` (sum of ``size`` of earlier rows of the same ``group``
    in the range), and one small row per (range, group) with its ``_sum`` and ``_n``. Rows of a group are
    together when ``order`` starts with it. No task holds more than one range, and
    a group may span any number of ranges.
    """
    keyed = df.withColumns({"_group": group, "_size": size.cast("long")})
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType(
        [
            *ranged.schema.fields,
            T.StructField("_part", T.IntegerType()),
            T.StructField("_row", T.LongType()),
            T.StructField("_before", T.LongType()),
        ]
    )
    arrow = empty_like(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, carried, last, seen = TaskContext.get().partitionId(), 0, 0, None, False
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            table = pa.Table.from_batches([batch])
            at = {name: i for i, name in enumerate(table.column_names)}
            codes = table.column(at["_group"]).combine_chunks().dictionary_encode()
            codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
            ids = np.where(codes.indices.is_null(), -1, codes.indices.fill_null(0).to_numpy(zero_copy_only=False))
            sizes = table.column(at["_size"]).to_numpy().astype(np.int64)
            starts = np.ones(n, bool)
            starts[1:] = ids[1:] != ids[:-1]
            value = lambda i: None if ids[i] < 0 else codes.dictionary[int(ids[i])].as_py()  # noqa: B023, E731
            starts[0] = not seen or value(0) != last
            upto = np.cumsum(sizes)
            begin = np.flatnonzero(starts)
            run_no = np.cumsum(starts) - 1
            base = (upto - sizes)[begin] if len(begin) else np.zeros(0, np.int64)
            before = upto - sizes - np.where(run_no >= 0, base[np.maximum(run_no, 0)] if len(base) else 0, 0)
            before = before + np.where(run_no < 0, carried, 0)
            after = int(before[-1] + sizes[-1])
            last, carried, seen = value(n - 1), after, True
            for name, v in (
                ("_part", pa.array(np.full(n, part, np.int32))),
                ("_row", pa.array(np.arange(row, row + n, dtype=np.int64))),
                ("_before", pa.array(before)),
            ):
                table = table.append_column(name, v)
            row += n
            yield from table.cast(arrow).to_batches()

    stored = materialize(ranged.mapInArrow(run, schema))
    sums = materialize(stored.groupBy("_part", "_group").agg(F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_n")))
    return stored, sums
