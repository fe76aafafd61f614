"""Benchmark decontamination with one Aho-Corasick automaton over normalised word windows."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.llm.text import _ALNUM, alnum_words, empty_like, free_name, map_batches, quoted
from flowdrift.session import materialize

WINDOW = 13
SHARE = 20  # contaminated when at least one word in so many is hit
PART_BYTES = 4 << 20  # pattern text in one automaton; a larger benchmark takes several passes

_PAIR = T.StructType([T.StructField("item", T.StringType()), T.StructField("pattern", T.BinaryType())])


def _patterns(batch: pa.RecordBatch) -> pa.Table:
    items, patterns = [], []
    for item, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        found = alnum_words(data or b"")
        for i in range(max(len(found) - WINDOW + 1, 1) if found else 0):
            items.append(item)
            patterns.append(b" " + b" ".join(found[i : i + WINDOW]) + b" ")
    return pa.table({"item": pa.array(items, pa.string()), "pattern": pa.array(patterns, pa.binary())})


def build_automaton(pairs: list[tuple[str, bytes]]) -> ahocorasick.Automaton:
    """Automaton whose patterns carry their length in bytes and their items."""
    items: dict[bytes, list[str]] = {}
    for item, pattern in pairs:
        items.setdefault(pattern, []).append(item)
    automaton = ahocorasick.Automaton()
    for pattern, owners in items.items():
        automaton.add_word(pattern.decode("latin-1"), (len(pattern), owners))
    if items:
        automaton.make_automaton()
    return automaton


def find_hits(data: bytes, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit word ranges (from, to) in order of their ends, items with occurrences."""
    found = alnum_words(data)
    ranges, items = [], set()
    if found and len(automaton):
        # Bytes as characters: word boundaries and matches are the same, at one byte a character.
        for end, (size, owners) in automaton.iter((b" " + b" ".join(found) + b" ").decode("latin-1")):
            ranges.append((end - size + 1, end))
            items.update(owners)
    if ranges:
        blanks = np.cumsum([0] + [len(w) + 1 for w in found])
        ranges = [(int(np.searchsorted(blanks, a)), int(np.searchsorted(blanks, b))) for a, b in ranges]
    return len(found), ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending, disjoint, not adjacent ranges that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(data: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Code point spans of word ranges; normalising keeps every byte in its place, so offsets carry over."""
    if not ranges:
        return []
    inside = np.frombuffer(data.translate(_ALNUM), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in ranges]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("check", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("ranges", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", _SPANS),
    ]
)


def _scan(rows: DataFrame, shared) -> DataFrame:
    """Hits of one automaton in (doc_id, data) rows; ``shared`` is the broadcast of its patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton(shared.value)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _FOUND.fields if f.name != "doc_id"}
            for data in batch.column(1).to_pylist():
                data = data or b""
                n, ranges, items = find_hits(data, automaton)
                ranges = merged(ranges)
                out["check"].append(zlib.crc32(data))
                out["n_words"].append(n)
                out["ranges"].append([a << 32 | b for a, b in ranges])
                out["items"].append(sorted(items))
                out["spans"].append(original_spans(data, ranges))
            yield from pa.table({"doc_id": batch.column(0), **out}).cast(empty_like(_FOUND)).to_batches()

    return rows.mapInArrow(run, _FOUND)


def _united(batch: pa.RecordBatch) -> pa.Table:
    """The hits that several automata found in a text, as one automaton would have found them."""
    at = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names) if c != "doc_id"}
    out: dict[str, list] = {f.name: [] for f in _FOUND.fields if f.name != "doc_id"}
    for data, ranges, items in zip(at["data"], at["ranges"], at["items"], strict=True):
        data = data or b""
        whole = merged([(r >> 32, r & 0xFFFFFFFF) for r in ranges or []])
        out["check"].append(zlib.crc32(data))
        out["n_words"].append(len(alnum_words(data)))
        out["ranges"].append([a << 32 | b for a, b in whole])
        out["items"].append(sorted(set(items or [])))
        out["spans"].append(original_spans(data, whole))
    return pa.table({"doc_id": batch.column(batch.schema.names.index("doc_id")), **out})


_RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("spans", _SPANS),
        T.StructField("check", T.LongType()),
    ]
)


def _result(batch: pa.RecordBatch) -> pa.Table:
    at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
    hits, n_items, digests, bad = [], [], [], []
    for n, ranges, items in zip(at["n_words"].to_pylist(), at["ranges"].to_pylist(), at["items"].to_pylist(), strict=True):
        hit = sum(b - a for a, b in merged([(r >> 32, r & 0xFFFFFFFF) for r in ranges]))
        names = sorted(set(items))
        hits.append(hit), n_items.append(len(names)), bad.append(hit > 0 and SHARE * hit >= n)
        digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
    return pa.table(
        {"doc_id": at["doc_id"], "n_words": at["n_words"], "n_hit": hits, "n_items": n_items, "items_sha256": digests, "contaminated": bad, "spans": at["spans"], "check": at["check"]}
    )


def pattern_parts(benchmark: DataFrame, item_id: str, item_text: str, part_bytes: int) -> tuple[DataFrame, int]:
    """A stored table (item, pattern, part) of all patterns and the number of parts, each of at most about ``part_bytes``."""
    items = benchmark.select(F.coalesce(quoted(item_id).cast("string"), F.lit("")), quoted(item_text).cast("binary"))
    pairs = materialize(map_batches(items, _patterns, _PAIR).distinct())
    size = pairs.agg(F.sum(F.octet_length("pattern") + F.octet_length("item"))).first()[0] or 0
    parts = 1 if size <= part_bytes else -(-2 * size // part_bytes)
    return pairs.withColumn("part", F.pmod(F.xxhash64("item", "pattern"), F.lit(parts))), parts


def _broadcast_part(pairs: DataFrame, part: int):
    """The patterns of one part, at most about PART_BYTES of them."""
    rows = pairs.filter(F.col("part") == part).toLocalIterator()
    return pairs.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["pattern"])) for r in rows])


def _found(rows: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """Hits of all patterns in (doc_id, data) rows.

    Parts are taken in turn: one is sent out, used and released before the next, so the driver holds one at a time.
    Only documents with hits are stored in between. Their hits meet the text again for its spans.
    """
    if parts == 1:
        return _scan(rows, _broadcast_part(pairs, 0))
    hits = None
    for part in range(parts):
        shared = _broadcast_part(pairs, part)
        some = materialize(_scan(rows, shared).filter("size(ranges) > 0").select("doc_id", "check", "ranges", "items"))
        shared.destroy()
        hits = some if hits is None else hits.union(some)
    hits = hits.groupBy(F.col("doc_id").alias("_doc"), F.col("check").alias("_check")).agg(
        F.array_distinct(F.flatten(F.collect_list("ranges"))).alias("ranges"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.crc32(F.coalesce("data", F.lit(b""))) == F.col("_check"))
    return map_batches(rows.join(hits, same, "left").select("doc_id", "data", "ranges", "items"), _united, _FOUND)


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, check), one for each row of ``docs``.

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters.
    Each 13 consecutive words of an item, or all of a shorter one, are a pattern; a
    document is scanned once with the automaton of all patterns. ``spans`` are the
    hit stretches in code points of the original text, ``check`` is the CRC-32 of the
    text. Null texts have no words; a null item id counts as the empty id; equal items
    and repeated rows change nothing; with an empty benchmark nothing is hit.

    Patterns are counted first. More than ``part_bytes`` of them are dealt to several
    automata, each scanned in turn, and the hits of a document are joined by id and
    checksum; every column is the same.
    """
    pairs, parts = pattern_parts(benchmark, item_id, item_text, part_bytes)
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("binary").alias("data"))
    return map_batches(_found(rows, pairs, parts), _result, _RESULT)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; see ``contamination``.

    With one automaton the rows are judged where they are read, without a shuffle.
    """
    pairs, parts = pattern_parts(benchmark, "item_id", "text", part_bytes)
    if parts == 1:
        shared = _broadcast_part(pairs, 0)
        place = docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = build_automaton(shared.value)
            for batch in batches:
                clean = []
                for data in batch.column(place).cast(pa.binary()).to_pylist():
                    n, ranges, _ = find_hits(data or b"", automaton)
                    hit = sum(b - a for a, b in merged(ranges))
                    clean.append(not (hit > 0 and SHARE * hit >= n))
                yield batch.filter(pa.array(clean, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    key, sure = free_name(docs.columns, "_id"), free_name(docs.columns, "_crc")
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("binary").alias("data"))
    judged = map_batches(_found(rows, pairs, parts), _result, _RESULT)
    dirty = judged.filter("contaminated").select(F.col("doc_id").alias(key), F.col("check").alias(sure)).distinct()
    same = quoted(doc_id).cast("long").eqNullSafe(quoted(key)) & (F.crc32(F.coalesce(quoted(text), F.lit("")).cast("binary")) == quoted(sure))
    return docs.join(dirty, same, "left_anti")
