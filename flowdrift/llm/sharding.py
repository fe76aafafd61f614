"""Contiguous shards with the smallest possible largest shard."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowdrift.llm.text import free_name, ordered_prefix, quoted
from flowdrift.session import materialize

SHARDS = 24
ROW_BYTES = 8
CELLS = 1 << 16


def greedy_cuts(ends: list[int], total: int, shards: int, capacity: int) -> list[int] | None:
    """Ends of the shards when each takes as much as fits; None if ``shards`` are not enough.

    ``ends`` are the allowed cut positions in ascending order, without 0 and with ``total``.
    """
    at, cuts = 0, []
    while at < total:
        if len(cuts) == shards:
            return None
        k = bisect_right(ends, at + capacity)
        if k == 0 or ends[k - 1] <= at:
            return None
        at = ends[k - 1]
        cuts.append(at)
    return cuts


def smallest_capacity(ends: list[int], total: int, shards: int, low: int, high: int) -> int:
    """The least capacity in [low, high] for which the greedy cut succeeds; ``high`` must succeed."""
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(ends, total, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _cells(positions: DataFrame, intervals: list[tuple[int, int]], width: int) -> tuple[list[int], bool]:
    """The last position of each cell of ``width`` inside the intervals, and whether those are all positions."""
    inside = F.lit(False)
    for a, b in intervals:
        inside = inside | F.col("position").between(a, b)
    rows = (
        positions.filter(inside)
        .groupBy(F.floor(F.col("position") / width).alias("cell"))
        .agg(F.max("position").alias("last"), F.min("position").alias("first"))
        .collect()  # bounded: at most some CELLS rows
    )
    return sorted(r["last"] for r in rows), all(r["first"] == r["last"] for r in rows)


def best_cuts(positions: DataFrame, total: int, shards: int, cells: int = CELLS) -> list[int]:
    """Ends of the shards for the smallest feasible capacity; ``positions`` are the allowed ends.

    A grid of cells, each with its last position, bounds the capacity within one
    cell and every cut of the greedy check within a few cells; the grid is then laid
    over those stretches alone, until a cell holds one position. The driver sees a
    bounded number of positions, whatever their number is.
    """
    intervals, low = [(0, total)], -(-total // shards)
    kept: list[int] = []
    width = total + 1
    while True:
        length = sum(b - a + 1 for a, b in intervals)
        width = max(1, min(-(-length // cells), width // 2))
        ends, exact = _cells(positions, intervals, width)
        ends = sorted({*ends, *kept, total})
        high = smallest_capacity(ends, total, shards, low, total)
        if exact:
            return greedy_cuts(ends, total, shards, high)
        low = max(low, high - width)
        # In between, the k-th cut lies behind the k-th cut of the low capacity on the known positions and before k times the high one.
        intervals, at, reach = [], 0, 0
        for _ in range(shards):
            k = bisect_right(ends, at + low)
            at = max(at, ends[k - 1] if k else 0)
            reach = min(total, reach + high)
            intervals.append((at, reach))
        merged: list[tuple[int, int]] = []
        for a, b in intervals:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        intervals, kept = merged, ends if width > 1 else kept


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each document, law ``bytes``.

    Size is the length in UTF-8 plus 8; null counts as an empty text. Equal texts are
    an atomic group; only a group that is larger than an even shard, so that no
    division into near equal shards has room for it, is cut between its documents. Groups
    are ordered by the MD5 of their text, documents in a group by id. The capacity
    is the smallest with which the ordered groups fit into ``shards`` contiguous
    shards. Slots count from 0 in each shard. An empty table gives no rows. Rows with
    equal id and text are interchangeable. ``keep`` names further columns to carry.
    """
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    extra = {c: free_name([*names, *(f"_{x}" for x in "group size part row before first text".split())], c) for c in keep or []}
    data = F.coalesce(quoted(text), F.lit(""))
    narrow = docs.select(
        quoted(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(data) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(data.cast("binary")).alias("text_crc32"),
        F.md5(data.cast("binary")).alias("_text"),
        *[quoted(c).alias(a) for c, a in extra.items()],
    )
    if not extra:
        narrow = materialize(narrow)
    groups = narrow.groupBy("_text").agg(F.sum("size").alias("_bytes"))
    groups = materialize(groups)
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    # Fewer groups than shards can be that large.
    large = groups.filter(F.col("_bytes") * shards > total).select(F.col("_text").alias("_large"))
    marked = narrow.join(F.broadcast(large), F.col("_text") == F.col("_large"), "left")
    marked = marked.withColumn("_sub", F.when(F.col("_large").isNotNull(), F.coalesce("doc_id", F.lit(-1)))).drop("_large")
    order = [F.col("_text"), F.col("_sub"), F.col("doc_id")]
    rows, sums = ordered_prefix(marked, order, F.lit(0), F.col("size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = materialize(
        sums.select(
            F.col("_part").alias("_p"),
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_bytes"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"),
        )
    )
    placed = rows.join(shift, F.col("_part") == F.col("_p")).withColumns({"_at": F.col("_before") + F.col("_bytes"), "_no": F.col("_row") + F.col("_rows")})
    atoms = placed.groupBy("_text", "_sub").agg(F.min("_at").alias("position")).filter("position > 0")
    cuts = best_cuts(materialize(atoms.select("position")), total, shards) if total else []
    number = F.lit(0)
    for c in cuts[:-1]:
        number = number + F.when(F.col("_at") >= c, 1).otherwise(0)
    dealt = placed.withColumn("shard", number.cast("int"))
    firsts = materialize(dealt.groupBy(F.col("shard").alias("_s")).agg(F.min("_no").alias("_from")))  # one row for each shard
    return dealt.join(F.broadcast(firsts), F.col("shard") == F.col("_s")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_no") - F.col("_from")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[quoted(a).alias(c) for c, a in extra.items()],
    )
