"""Periodic runs of words: difference-cover LCE with a sparse table, driving an enumeration on harmonic grids."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.llm.text import empty_like, quoted, words

LEAST = 6  # words of a run, at least
TIMES = 4  # whole periods of a run, at least
CHUNK_WORDS = 200_000  # texts are looked at together until they have so many words
GRID = 1 << 20  # pairs of places compared at once

# Every difference modulo PERIOD is one between two members of COVER.
PERIOD, COVER = 31, np.array([0, 1, 3, 8, 12, 18])


def _meeting() -> np.ndarray:
    """For (i mod PERIOD, (j - i) mod PERIOD): how far to go until both i and j are at covered places."""
    out = np.zeros((PERIOD, PERIOD), np.int64)
    covered = {int(x) for x in COVER}
    for i in range(PERIOD):
        for apart in range(PERIOD):
            out[i, apart] = next(h for h in range(PERIOD) if (i + h) % PERIOD in covered and (i + h + apart) % PERIOD in covered)
    return out


class Lce:
    """Longest common extension of any two places of ``a``.

    Only suffixes at covered places are sorted: first by their next ``PERIOD`` words, then by doubling, since a
    place and the one ``PERIOD`` further are covered alike. A query compares words until both places are covered
    (after fewer than ``PERIOD`` words) and takes the rest from the range minimum of the sorted suffixes' common
    prefixes. ``a`` has a value of its own at the end of each text, so nothing is common across texts.
    """

    def __init__(self, a: np.ndarray):
        per = len(COVER)
        n = len(a)
        self.meeting = _meeting()
        self.a = np.concatenate([a, np.zeros(2 * PERIOD, a.dtype)])
        number = np.arange(-(-n // PERIOD) * per)
        places = number // per * PERIOD + COVER[number % per]
        places = places[places < n]
        self.number_of = np.full(n + PERIOD, -1, np.int64)
        self.number_of[places] = np.arange(len(places))
        self._sort(places, per)

    def _sort(self, places: np.ndarray, per: int) -> None:
        m = len(places)
        bits = max(1, int(self.a.max()).bit_length())
        packed = max(1, 63 // bits)
        rank, open_ = np.zeros(m, np.int64), np.arange(m)
        for first in range(0, PERIOD, packed):
            if not len(open_):
                break
            key = np.zeros(len(open_), np.int64)
            for k in range(first, min(first + packed, PERIOD)):
                key = (key << bits) | self.a[places[open_] + k]
            open_ = self._refine(rank, open_, key)
        ranks, step = [rank.copy()], per
        while len(open_):
            later = open_ + step
            key = np.where(later < m, ranks[-1][np.minimum(later, m - 1)], -1)
            open_ = self._refine(rank, open_, key)
            ranks.append(rank.copy())
            step *= 2
        order = np.empty(m, np.int64)
        order[rank] = np.arange(m)
        x, y = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(m - 1, 0), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            same = np.flatnonzero((x < m) & (y < m))
            same = same[ranks[level][x[same]] == ranks[level][y[same]]]
            x[same] += per << level
            y[same] += per << level
            common[same] += PERIOD << level
        at, to = places[order[:-1]] + common, places[order[1:]] + common
        alive = np.arange(len(common))
        for _ in range(PERIOD):
            alive = alive[self.a[at[alive]] == self.a[to[alive]]]
            if not len(alive):
                break
            common[alive] += 1
            at[alive] += 1
            to[alive] += 1
        self.rank = rank
        self.least = [common.astype(np.int32)]
        while 2 << (len(self.least) - 1) <= len(common):
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _refine(rank: np.ndarray, open_: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Split the groups of equal rank by ``key``; a group's rank is the number of smaller suffixes. Returns what is still tied."""
        by = np.lexsort((key, rank[open_]))
        at, group, key = open_[by], rank[open_][by], key[by]
        n, place = len(at), np.arange(len(at))
        fresh, split = np.ones(n, bool), np.ones(n, bool)
        fresh[1:] = group[1:] != group[:-1]
        split[1:] = fresh[1:] | (key[1:] != key[:-1])
        begin = np.maximum.accumulate(np.where(fresh, place, 0))
        part = np.maximum.accumulate(np.where(split, place, 0))
        rank[at] = group + part - begin
        starts = np.flatnonzero(split)
        size = np.diff(np.append(starts, n))
        return at[np.repeat(size, size) > 1]

    def _sorted_common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        r, s = self.rank[self.number_of[i]], self.rank[self.number_of[j]]
        low, high = np.minimum(r, s), np.maximum(r, s)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            here = np.flatnonzero(level == k)
            table = self.least[k]
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << int(k))])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i and j (different ones) the number of equal words from there on."""
        out = np.zeros(len(i), np.int64)
        far = self.meeting[i % PERIOD, (j - i) % PERIOD]
        alive = np.arange(len(i))
        for step in range(PERIOD):
            if not len(alive):
                break
            there = far[alive] == step
            met = alive[there]
            if len(met):
                out[met] += self._sorted_common(i[met] + step, j[met] + step)
            alive = alive[~there]
            alive = alive[self.a[i[alive] + step] == self.a[j[alive] + step]]
            out[alive] += 1
        return out


def _grid(sizes: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (text, place, period): for each period q every 3 q-th word of each text that has another one q later.

    The words of a run that equal the one q later are 3 q in a row at least, so each run holds a place of its grid.
    The number of places is a harmonic sum over the periods.
    """
    most = np.where(sizes >= LEAST, sizes // TIMES, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    stride = (TIMES - 1) * period
    points = -(-(sizes[text] - period) // stride)
    upto = np.cumsum(points)
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + GRID, "right")))
        some = points[low:high]
        which = np.repeat(np.arange(low, high), some)
        k = np.arange(len(which)) - np.repeat(np.cumsum(some) - some, some)
        yield text[which], begins[text[which]] + k * stride[which], period[which]
        low = high


def runs_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (text, start, length, period) of texts of word numbers (0 and up), sorted by these."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    top = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    a = np.zeros(int(sizes.sum()) + len(texts) + 1, np.int64)
    a[0] = top
    for k, t in enumerate(texts):
        a[begins[k] : begins[k] + len(t)] = t
        a[begins[k] + len(t)] = top + 1 + k
    forward = backward = None
    found = []
    for text, at, period in _grid(sizes, begins):
        equal = np.flatnonzero(a[at] == a[at + period])
        text, at, period = text[equal], at[equal], period[equal]
        if not len(at):
            continue
        if forward is None:
            forward, backward = Lce(a), Lce(a[::-1])
        ahead = forward(at, at + period)
        behind = backward(len(a) - at - period, len(a) - at)
        length = ahead + behind + period
        good = np.flatnonzero(length >= np.maximum(LEAST, TIMES * period))
        # a run of period q comes up again for multiples of q: the same words, a larger period
        found.append(np.stack([text[good], (at - behind - begins[text])[good], length[good], period[good]]))
    every = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    every = every[:, np.lexsort(every[::-1])]
    first = np.ones(every.shape[1], bool)
    first[1:] = (every[:3, 1:] != every[:3, :-1]).any(axis=0)
    text, start, length, period = every[:, first]
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(_RUN)),
        T.StructField("best", _RUN),
        T.StructField("collapsed", T.BinaryType()),
    ]
)


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for run in runs:  # by start, then period, so the first of equal ones stays
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _look_at(ids: list, texts: list[list[bytes]]) -> dict:
    number = defaultdict(count().__next__)
    coded = [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]
    text, start, length, period = runs_of(coded)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    out = {"doc_id": ids, "n_words": [len(t) for t in texts], "runs": [], "best": [], "collapsed": []}
    name = lambda run: dict(zip(("start", "length", "period"), run, strict=True))
    for k, t in enumerate(texts):
        here = slice(cut[k], cut[k + 1])
        runs = list(zip(start[here].tolist(), length[here].tolist(), period[here].tolist(), strict=True))
        kept = t
        if runs:
            gone = np.zeros(len(t) + 1, np.int64)
            np.add.at(gone, start[here] + period[here], 1)
            np.add.at(gone, start[here] + length[here], -1)
            gone = np.cumsum(gone[:-1]) > 0
            kept = [w for w, dropped in zip(t, gone.tolist(), strict=True) if not dropped]
        best = _best(runs)
        out["runs"].append([name(r) for r in runs])
        out["best"].append(name(best) if best else None)
        out["collapsed"].append(b" ".join(kept))
    return out


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, runs, best, collapsed), one for each row of ``docs``.

    A run is a stretch of words with the smallest period q, of ``TIMES`` periods and ``LEAST`` words at least, that
    no neighbouring word extends. ``runs`` lists them (start, length, period) by start, then period; ``best`` is
    the one with the greatest length / period (ties: smallest start, then period) or null; ``collapsed`` joins the
    words by blanks, without those that a run contains after its first q words.

    Texts are independent, so nothing is shuffled: a task numbers the words of some texts, ends each text with a
    value of its own and looks at all of them in one pass, in time n log n of the longest text. Null and empty texts have no
    words, no runs and an empty ``collapsed``. Repeated rows and null ids give a row each. Other columns have no effect.
    """
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), F.coalesce(quoted(text).cast("binary"), F.lit(b"")).alias("data"))
    arrow = empty_like(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for one, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                split = words(data.as_py())
                ids.append(one), texts.append(split)
                held += len(split) + 1
                if held >= CHUNK_WORDS:
                    yield pa.RecordBatch.from_pydict(_look_at(ids, texts), arrow)
                    ids, texts, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pydict(_look_at(ids, texts), arrow)

    return rows.mapInArrow(run, _FOUND).withColumn("collapsed", F.col("collapsed").cast("string"))


def with_planted_periods(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) where one document in ten, by the CRC of its id, goes on with period p from its word a; p and a follow from the CRC.

    Other texts, null ids and texts without words stay as they are.
    """
    ids = quoted(doc_id).cast("long")
    h = F.crc32(ids.cast("string").cast("binary"))
    split = F.regexp_extract_all(quoted(text), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = docs.select(ids.alias("doc_id"), quoted(text).alias("text"), F.when(h % 10 == 0, split).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w").cast("long")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n))
    rows = rows.withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    place = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)
    planted = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", place(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def document_runs(docs: DataFrame) -> DataFrame:
    """Runs of the planted documents as numbers and digests."""
    found = periodic_runs(with_planted_periods(docs))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
