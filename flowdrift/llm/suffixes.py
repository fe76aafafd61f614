"""Removal of byte strings that occur more than once in a corpus, with suffix arrays built by Lyndon groups.

A string of ``LENGTH`` bytes is represented by its anchor, the leftmost of its
32-byte strings with the smallest hash: equal strings have equal anchors at equal
offsets. A run is the stretch of consecutive strings of a text that share an
anchor. Runs are compared only with runs of the same anchor. Runs whose whole
stretch is found twice are repeated as a whole; the others, one text for each
different stretch, go to a suffix array per anchor.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.llm.text import map_batches, mix64, quoted
from flowdrift.session import materialize

LENGTH = 200
GRAM = 32
BLOCK = 20  # symbols of the suffix array, aligned at the anchor
HOT_STRETCHES = 8000  # an anchor with more different stretches is split into single strings
PIECE = 2 << 20  # bytes that are hashed at once; positions have 24 bits


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array of a sequence of whole numbers, by linear grouping construction.

    Suffixes are first grouped by their first symbol. Groups are taken in descending
    order; each suffix finds the nearest earlier suffix of a lower group (its
    previous-smaller pointer), and the suffixes pointed at move into new groups
    behind the rest of theirs, the more often pointed at, the further back. In the
    end a group holds the suffixes with the same longest Lyndon prefix. The order
    inside the groups follows from one ascending pass over the finished part, along
    the pointers; nothing is renamed or sorted again.
    """
    n = len(symbols)
    place = sorted(range(n), key=symbols.__getitem__)
    where, group, end = [0] * n, [0] * n, {}
    first = 0
    for k, i in enumerate(place):
        if symbols[i] != symbols[place[first]]:
            end[first] = k
            first = k
        where[i], group[i] = k, first
    if n:
        end[first] = n
    pointer = [-1] * n
    top = n
    while top > 0:
        low = group[place[top - 1]]
        hits: dict[int, int] = {}
        for i in sorted(place[low:top]) if top - low > 1 else place[low:top]:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = pointer[j]
            pointer[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        levels: dict[int, dict[int, list[int]]] = {}
        for j, times in hits.items():
            levels.setdefault(times, {}).setdefault(group[j], []).append(j)
        for times in sorted(levels, reverse=True):
            for g, moved in levels[times].items():
                last = stop = end[g]
                for j in moved:
                    last -= 1
                    other, at = place[last], where[j]
                    place[at], where[other] = other, at
                    place[last], where[j] = j, last
                if last > g:
                    end[g] = last
                    end[last] = stop
                    for j in moved:
                        group[j] = last
        top = low
    free: dict[int, int] = {}
    out, done = [0] * n, [False] * n
    for k in range(-1, n):
        j = (n if k < 0 else out[k]) - 1
        while j >= 0 and not done[j]:
            g = group[j]
            at = free.get(g, g)
            out[at], done[j], free[g] = j, True, at + 1
            j = pointer[j]
    return out


_RNG = np.random.default_rng(23)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def find_runs(data: np.ndarray, owners_end: np.ndarray, powers: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Runs of concatenated texts: first start, number of starts, anchor offset, anchor hash, stretch hash.

    ``powers`` are those of ``_powers`` for more places than there are bytes; without them they are made here.
    """
    power, inverse = powers or _powers(len(data) + 1)
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    low = np.uint64(0xFFFFFF)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, span, count = LENGTH - GRAM + 1, 1, n - LENGTH + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:count], least[width - span : width - span + count])
    anchor = (least & low).astype(np.int64)
    begins = np.concatenate([[0], owners_end[:-1]])
    inside = np.zeros(n + 1, np.int32)
    long = owners_end - begins >= LENGTH
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, owners_end[long] - LENGTH + 1, -1)
    valid = np.cumsum(inside)[:count] > 0
    new = np.ones(count, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    edges = np.append(np.flatnonzero(new), count)
    first, length = edges[:-1], np.diff(edges)
    use = valid[first]
    first, length = first[use], length[use]
    offset = anchor[first] - first
    stretch = (sums[first + length + LENGTH - 1] - sums[first]) * inverse[first]
    stretch = mix64(mix64(stretch) ^ (length * 1000 + offset).astype(np.uint64))
    return first, length, offset, grams[anchor[first]], stretch


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, index of the text, offset in the text) of joined texts; a huge text goes in overlapping parts."""
    part, owner, shift, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            one = text[at : at + PIECE + LENGTH - 1]
            part.append(one), owner.append(i), shift.append(at)
            size += len(one)
            if size >= PIECE // 2:
                yield np.frombuffer(b"".join(part), np.uint8), np.cumsum([len(x) for x in part]), np.array(owner), np.array(shift)
                part, owner, shift, size = [], [], [], 0
    if part:
        yield np.frombuffer(b"".join(part), np.uint8), np.cumsum([len(x) for x in part]), np.array(owner), np.array(shift)


_RUN = T.StructType([T.StructField(c, T.BinaryType() if c == "mark" else T.LongType()) for c in ("anchor", "stretch", "doc_id", "mark", "at")])


def _mark(data: bytes) -> bytes:
    """128 bits that tell a text from the others of its id."""
    return xxhash.xxh3_128_digest(data)


def _runs(batch: pa.RecordBatch) -> pa.Table | None:
    """One row for each run; ``at`` packs first start, anchor offset and number of starts."""
    ids = batch.column(0)
    texts = [t or b"" for t in batch.column(1).to_pylist()]
    marks = pa.array([_mark(t) for t in texts], pa.binary())
    size = sum(map(len, texts)) + LENGTH * (1 + sum(len(t) // PIECE for t in texts))
    powers = _powers(min(size, 2 * PIECE) + 1)  # once a batch, no longer than its longest piece
    tables = []
    for data, ends, owner, shift in _pieces(texts):
        first, length, offset, anchor, stretch = find_runs(data, ends, powers)
        which = np.searchsorted(ends, first, side="right")
        begins = np.concatenate([[0], ends[:-1]])
        start = first - begins[which] + shift[which]
        at = (start << 16) | (offset << 8) | length
        row = pa.array(owner[which])
        tables.append(
            pa.table({"anchor": anchor.view(np.int64), "stretch": stretch.view(np.int64), "doc_id": ids.take(row), "mark": marks.take(row), "at": at})
        )
    return pa.concat_tables(tables) if tables else None


_PACKED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("mark", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("packed", T.BinaryType())]
)


def _pack(batch: pa.RecordBatch) -> pa.Table:
    press = zstandard.ZstdCompressor(level=1)
    texts = [t or b"" for t in batch.column(1).to_pylist()]
    return pa.table(
        {
            "doc_id": batch.column(0),
            "mark": pa.array([_mark(t) for t in texts], pa.binary()),
            "n_bytes": [len(t) for t in texts],
            "packed": pa.array([press.compress(t) for t in texts], pa.binary()),
        }
    )


_STRETCH = T.StructType(
    [
        T.StructField("anchor", T.LongType()),
        T.StructField("stretch", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("mark", T.BinaryType()),
        T.StructField("at", T.LongType()),
        T.StructField("split", T.BooleanType()),
        T.StructField("data", T.BinaryType()),
    ]
)


def _cut_out(batch: pa.RecordBatch) -> pa.Table | None:
    """The bytes of the wanted stretches of a document; those of hot anchors as one row for each string."""
    unpress = zstandard.ZstdDecompressor()
    out: dict[str, list] = {f.name: [] for f in _STRETCH.fields}
    names = batch.schema.names
    powers = _powers(256 + LENGTH)  # a stretch has no more starts than eight bits count
    seen = set()
    for doc_id, mark, packed, wanted in zip(*(batch.column(names.index(c)).to_pylist() for c in ("doc_id", "mark", "packed", "wanted")), strict=True):
        if (doc_id, mark) in seen:
            continue  # a row repeated with id and text has the same stretches
        seen.add((doc_id, mark))
        text = unpress.decompress(packed)
        for w in wanted:
            start, count = (w["at"] >> 16) & 0x7FFFFFFF, w["at"] & 0xFF
            data = text[start : start + count + LENGTH - 1]
            if not w["split"]:
                rows = [(w["anchor"], w["stretch"], w["n"], doc_id, mark, w["at"], False, data)]
            else:
                sums, (power, inverse) = np.zeros(len(data) + 1, np.uint64), powers
                np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * power[: len(data)], out=sums[1:])
                keys = mix64((sums[LENGTH:] - sums[:-LENGTH]) * inverse[:count]).view(np.int64)
                rows = [(w["anchor"], int(k), w["n"], doc_id, mark, (start + i) << 16 | 1, True, None) for i, k in enumerate(keys)]
            for row in rows:
                for f, v in zip(out, row, strict=True):
                    out[f].append(v)
    return pa.table({f.name: pa.array(out[f.name], type=t) for f, t in zip(_STRETCH.fields, _stretch_types(), strict=True)}) if out["n"] else None


def _stretch_types() -> list[pa.DataType]:
    return [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary()]


def repeated_starts(stretches: list[tuple[bytes, int]]) -> list[list[int]]:
    """Starts, in each stretch, of strings of ``LENGTH`` bytes that another stretch holds too.

    All stretches share an anchor; each comes with its offset. Blocks of ``BLOCK`` bytes, aligned at the anchor,
    are the symbols of one suffix array over all stretches. A string covers nine
    whole blocks, so equal strings start in one stretch of suffixes with nine equal
    symbols; the bytes before and behind the blocks are compared as they are.
    """
    whole = LENGTH // BLOCK - 1
    offsets = [o for _, o in stretches]
    texts = [t for t, _ in stretches]
    blocks, homes = [], []
    for r, text in enumerate(texts):
        for q in range(offsets[r] % BLOCK, len(text) - BLOCK + 1, BLOCK):
            blocks.append(text[q : q + BLOCK])
            homes.append((r, q))
        blocks.append(None)
        homes.append((r, -1))
    rank = {b: k for k, b in enumerate(sorted({b for b in blocks if b is not None}), len(texts))}
    symbols, separator = [], 0
    for b in blocks:
        if b is None:
            symbols.append(separator)  # a symbol of its own ends each stretch
            separator += 1
        else:
            symbols.append(rank[b])
    found: list[set[int]] = [set() for _ in texts]
    held, key = [], None

    def close() -> None:
        if len(held) < 2:
            return
        seen: dict[tuple[int, bytes], list[tuple[int, int]]] = defaultdict(list)
        for r, q in held:
            text = texts[r]
            for front in range(max(0, q + LENGTH - len(text)), min(BLOCK - 1, q) + 1):
                p = q - front
                seen[front, text[p:q] + text[q + whole * BLOCK : p + LENGTH]].append((r, p))
        for same in seen.values():
            if len(same) > 1:
                for r, p in same:
                    found[r].add(p)

    for i in suffix_array(symbols):
        r, q = homes[i]
        if q < 0 or q + whole * BLOCK > len(texts[r]):
            continue
        now = symbols[i : i + whole]
        if now != key:
            close()
            held, key = [], now
        held.append((r, q))
    close()
    return [sorted(x) for x in found]


_RANGE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("mark", T.BinaryType()), T.StructField("range", T.LongType())])


def _ranges_of(doc_id, mark: bytes, at: int, starts: list[int]) -> Iterator[tuple]:
    begin = (at >> 16) & 0x7FFFFFFF
    lo = None
    for k, p in enumerate(starts):
        lo = p if lo is None else lo
        if k + 1 == len(starts) or starts[k + 1] != p + 1:
            yield doc_id, mark, (begin + lo) << 32 | (p - lo + LENGTH)
            lo = None


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by (anchor, stretch): repeated parts of those that occur once as a whole."""
    key, held = None, {}

    def done() -> Iterator[tuple]:
        rows = list(held.values())
        if len(rows) > 1 and any(n == 1 for n, *_ in rows):
            for (n, doc_id, mark, at, _), starts in zip(rows, repeated_starts([(d, at >> 8 & 0xFF) for *_, at, d in rows]), strict=True):
                if n == 1 and starts:
                    yield from _ranges_of(doc_id, mark, at, starts)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        ids, marks, ranges = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.binary()), pa.array(ranges, pa.int64())], ["doc_id", "mark", "range"])

    ready: list[tuple] = []
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("anchor", "stretch", "n", "doc_id", "mark", "at", "data")]
        for anchor, stretch, n, doc_id, mark, at, data in zip(*columns, strict=True):
            if anchor != key:
                ready.extend(done())
                key, held = anchor, {}
                if len(ready) > 10_000:
                    yield packed(ready)
                    ready = []
            held.setdefault(stretch, (n, doc_id, mark, at, data))
    ready.extend(done())
    if ready:
        yield packed(ready)


_KEPT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
    ]
)


def _remove(batch: pa.RecordBatch) -> pa.Table:
    unpress = zstandard.ZstdDecompressor()
    names = batch.schema.names
    removed, spans, kept = [], [], []
    for packed, ranges in zip(*(batch.column(names.index(c)).to_pylist() for c in ("packed", "ranges")), strict=True):
        text = unpress.decompress(packed)
        parts, at, gone, runs, reach = [], 0, 0, 0, -1
        for r in sorted(ranges or []):
            start, stop = r >> 32, (r >> 32) + (r & 0xFFFFFFFF)
            if start > reach:
                runs += 1
                parts.append(text[at:start])
            gone += max(0, stop - max(start, at))
            at = reach = max(at, stop)
        parts.append(text[at:])
        removed.append(gone), spans.append(runs), kept.append(b"".join(parts))
    return pa.table({"doc_id": batch.column(names.index("doc_id")), "n_bytes": batch.column(names.index("n_bytes")), "n_removed": removed, "n_spans": spans, "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept), one for each row of ``docs``.

    Removed is every byte covered by a string of 200 bytes that also starts at
    another place of any text, the same one included. Texts are judged as they came.
    Null texts are empty, shorter texts lose nothing. Repeated rows are each other's
    copies and lose all such bytes. ``kept`` holds the remaining bytes. Ids may be
    null or repeated: a row is told from others by its id and a 128-bit hash of its text.

    1. Anchors that occur once are dropped after a pre-aggregated count.
    2. Stretches of the rest are counted. A stretch that occurs twice is removed.
    3. Of the anchors with several stretches, one text for each stretch is cut out
       and compared by suffix arrays. An anchor with more than ``HOT_STRETCHES`` of
       them is split: each string is counted by its own 128-bit key, so no task
       gathers a passage that a third of all rows shares.
    4. The removed ranges go to their documents.
    """
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("binary").alias("data"))
    runs = map_batches(rows, _runs, _RUN)
    often = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("anchor").alias("_anchor"))
    often = materialize(often)  # as a table it leaves the join with the runs free to split a hot anchor
    shared = materialize(runs.join(often, F.col("anchor") == F.col("_anchor")).drop("_anchor"))
    stretches = materialize(
        shared.groupBy("anchor", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "mark", "at")).alias("rep"))
    )
    several = stretches.groupBy(F.col("anchor").alias("_anchor")).agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("_least"))
    several = several.filter("kinds > 1 and _least = 1")
    wanted = (
        stretches.join(several, F.col("anchor") == F.col("_anchor"))
        .select(F.col("rep.doc_id").alias("_doc"), F.col("rep.mark").alias("_mark"), F.struct("anchor", "stretch", "n", F.col("rep.at").alias("at"), (F.col("kinds") > HOT_STRETCHES).alias("split")).alias("w"))
        .groupBy("_doc", "_mark")
        .agg(F.collect_list("w").alias("wanted"))
    )
    packed = map_batches(rows, _pack, _PACKED)
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    cut = materialize(map_batches(packed.join(wanted, same).select("doc_id", "mark", "packed", "wanted"), _cut_out, _STRETCH))
    by_suffix = (
        cut.filter("not split").repartition("anchor").sortWithinPartitions("anchor", "stretch").mapInArrow(_compare, _RANGE)
    )
    singles = cut.filter("split")
    twice = (
        singles.groupBy(F.col("anchor").alias("_a"), F.col("stretch").alias("_s"))
        .agg((F.count(F.lit(1)) + F.max(F.col("n") - 1)).alias("_n"))
        .filter("_n > 1")
    )
    from_at = (F.shiftright("at", 16).bitwiseAND(F.lit(0x7FFFFFFF)) * F.lit(1 << 32)) + F.col("at").bitwiseAND(F.lit(0xFF)) + F.lit(LENGTH - 1)
    as_range = ["doc_id", "mark", from_at.alias("range")]
    by_string = singles.join(twice, (F.col("anchor") == F.col("_a")) & (F.col("stretch") == F.col("_s"))).select(*as_range)
    copies = stretches.filter("n > 1").select(F.col("anchor").alias("_a"), F.col("stretch").alias("_s"))
    by_copy = shared.join(copies, (F.col("anchor") == F.col("_a")) & (F.col("stretch") == F.col("_s"))).select(*as_range)
    ranges = (
        by_copy.union(by_suffix).union(by_string)
        .groupBy(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"))
        .agg(F.collect_set("range").alias("ranges"))
    )
    return map_batches(packed.join(ranges, same, "left").select("doc_id", "n_bytes", "packed", "ranges"), _remove, _KEPT)
