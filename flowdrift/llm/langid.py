"""Language identification by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.llm.text import map_batches, mix64, quoted
from flowdrift.session import materialize

CELLS = 1 << 14  # hashed byte n-grams of one to three letters
MAX_BITS = 63
UNDETERMINED = "und"
MARGIN = 0.2  # a lead of the best codeword below this is ambiguous

_LETTER = re.compile(r"[^\W\d_]")  # letters, and number characters such as ½ that are none
# Bytes of letters in lower case, everything else a blank; bytes above 0x7F stay as they are.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)], np.uint8)


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """One row of bits (-1, 1) for each class; all useful splits for few classes, random ones beyond."""
    if classes < 2:
        return np.zeros((classes, 0), np.int8)
    if (1 << (classes - 1)) - 1 <= MAX_BITS:
        columns = [[1] + [1 if (split >> c) & 1 else -1 for c in range(classes - 1)] for split in range((1 << (classes - 1)) - 1)]
        return np.array(columns, np.int8).T
    rng, picked = np.random.default_rng(seed), {}
    while len(picked) < MAX_BITS:
        column = rng.choice(np.array([-1, 1], np.int8), classes)
        if abs(int(column.sum())) < classes and column.tobytes() not in picked:
            picked[(column * column[0]).tobytes()] = column * column[0]
    return np.stack(list(picked.values()), axis=1)


def _pieces(texts: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cell of each n-gram, index of its text) for all texts, some bytes at a time."""
    part, owner, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), limit):
            one = b" " + text[at : at + limit + 2] + b" "
            part.append(one), owner.append(i)
            size += len(one)
            if size >= limit:
                yield _cells(part, owner)
                part, owner, size = [], [], 0
    if part:
        yield _cells(part, owner)


def _cells(part: list[bytes], owner: list[int]) -> tuple[np.ndarray, np.ndarray]:
    a = _FOLD[np.frombuffer(b"".join(part), np.uint8)].astype(np.uint64)
    who = np.repeat(np.array(owner, np.int64), [len(x) for x in part])
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 32) | (a[:-1] != 32)  # blanks in a row count once
    a, who = a[keep], who[keep]
    two = a[:-1] * np.uint64(256) + a[1:]
    three = two[:-1] * np.uint64(256) + a[2:]
    cells = [a + np.uint64(1 << 32), two + np.uint64(1 << 33), three + np.uint64(1 << 34)]
    owners = [who, np.where(who[:-1] == who[1:], who[1:], -1), np.where(who[:-2] == who[2:], who[2:], -1)]
    cell = (mix64(np.concatenate(cells)) % np.uint64(CELLS)).astype(np.int64)
    own = np.concatenate(owners)
    use = (own >= 0) & np.concatenate([a != 32, np.ones(len(two) + len(three), bool)])
    return cell[use], own[use]


_COUNT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to n-gram counts per language: one small table for each task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        names = sorted(set(langs))
        at = np.array([names.index(x) for x in langs], np.int64)
        for cell, own in _pieces(texts):
            flat = np.bincount(at[own] * CELLS + cell, minlength=len(names) * CELLS).reshape(len(names), CELLS)
            for k, name in enumerate(names):
                total[name] = total.get(name, 0) + flat[k]
    for name, counts in total.items():
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(counts[cells])], ["lang", "cell", "n"]
        )


def fit_bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codewords, weights of cells by bit) from n-gram counts by language: one naive-Bayes classifier for each bit.

    Languages weigh the same, however many documents they have.
    """
    words = codewords(len(counts))
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    weights = np.zeros((counts.shape[1], words.shape[1]))
    for b in range(words.shape[1]):
        weights[:, b] = np.log(share[words[:, b] > 0].mean(axis=0)) - np.log(share[words[:, b] < 0].mean(axis=0))
    return words, weights


def _margins(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Mean log-odds of the n-grams of each text, by bit."""
    sums, count = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for cell, own in _pieces(texts):
        order = np.argsort(own, kind="stable")
        cell, own = cell[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        if len(first):
            np.add.at(sums, own[first], np.add.reduceat(weights[cell], first, axis=0))
            np.add.at(count, own[first], np.diff(np.append(first, len(own))))
    return sums / np.maximum(count, 1)[:, None]


def decode(margins: np.ndarray, words: np.ndarray, bit_weights: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest codeword, shares of all codewords): logistic loss of every bit, weighted."""
    if words.shape[1] == 0:
        return np.zeros(len(margins), np.int64), np.ones((len(margins), len(words)))
    agreed = (margins * scale)[:, None, :] * words[None, :, :]
    loss = (np.logaddexp(0, -agreed) * bit_weights).sum(axis=2) / bit_weights.sum()
    share = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * words.shape[1])
    share /= share.sum(axis=1, keepdims=True)
    return loss.argmin(axis=1), share


def _scored_schema(bits: int) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("lang", T.StringType()),
            T.StructField("letters", T.BooleanType()),
            T.StructField("margins", T.ArrayType(T.DoubleType())),
        ]
    )


def _has_letter(data: bytes | None) -> bool:
    return bool(data) and any(m.group().isalpha() for m in _LETTER.finditer(data.decode("utf-8", "replace")))


_RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("ambiguous", T.BooleanType()),
    ]
)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, ambiguous), one for each row of ``docs``.

    Learns from the documents whose CRC-32 of the id as text, modulo 4, is not 2 (a
    null id counts as empty text), all of them: n-gram counts by language are added
    up per task and then over all tasks. Each bit of the codewords has a naive-Bayes
    classifier on these counts. A bit weighs the log-odds of its accuracy on the
    learning documents; its margins are scaled to unit spread there. The nearest
    codeword by weighted logistic loss wins; ``score`` is its share and
    ``ambiguous`` says that the lead over the second is below 0.2. Texts that are
    null or without letters are ``und`` with score 0 and ambiguous, as is every
    text when nothing can be learned. With one language all others get it.
    """
    held = F.pmod(F.crc32(F.coalesce(quoted(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    rows = docs.select(
        quoted(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), quoted(lang).cast("string").alias("lang"), quoted(text).cast("binary").alias("data")
    )
    learn = rows.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("data").isNotNull()).select("lang", "data")
    totals = learn.mapInArrow(_counted, _COUNT).groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = totals.toPandas()  # bounded: languages times CELLS
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), CELLS))
    counts[[langs.index(x) for x in found["lang"]], found["cell"].to_numpy()] = found["n"].to_numpy()
    words, weights = fit_bits(counts) if langs else (codewords(0), np.zeros((CELLS, 0)))

    def score(batch: pa.RecordBatch) -> pa.Table:
        texts = batch.column(3).to_pylist()
        margins = _margins([t or b"" for t in texts], weights)
        return pa.table(
            {
                "doc_id": batch.column(0),
                "held_out": batch.column(1),
                "lang": batch.column(2),
                "letters": [_has_letter(t) for t in texts],
                "margins": pa.array(list(margins), pa.list_(pa.float64())),
            }
        )

    bits = words.shape[1]
    scored = materialize(map_batches(rows, score, _scored_schema(bits)))
    known = scored.filter(~F.col("held_out") & F.col("letters") & F.col("lang").isin(langs))
    right, spread = np.ones(bits) * 0.5, np.ones(bits)
    if bits:
        sign = {name: [int(x) for x in words[k]] for k, name in enumerate(langs)}
        signs = F.create_map(*[x for name, s in sign.items() for x in (F.lit(name), F.array(*map(F.lit, s)))])
        wanted = known.withColumn("bits", signs[F.col("lang")])
        row = wanted.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(((F.col("margins")[b] * F.col("bits")[b]) > 0).cast("long")).alias(f"r{b}") for b in range(bits)],
            *[F.sqrt(F.avg(F.col("margins")[b] * F.col("margins")[b])).alias(f"s{b}") for b in range(bits)],
        ).first()
        right = np.array([(row[f"r{b}"] or 0) + 1 for b in range(bits)]) / ((row["n"] or 0) + 2)
        spread = np.array([row[f"s{b}"] or 1.0 for b in range(bits)])
    right = np.clip(right, 0.5 + 1e-3, 1 - 1e-6)
    bit_weights, scale = np.log(right / (1 - right)), 2.0 / np.maximum(spread, 1e-9)

    def decide(batch: pa.RecordBatch) -> pa.Table:
        at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        margins = np.array(at["margins"].to_pylist(), np.float64).reshape(batch.num_rows, bits)
        usable = [bool(x) and bool(langs) for x in at["letters"].to_pylist()]
        best, share = decode(margins, words, bit_weights, scale) if langs else (np.zeros(batch.num_rows, int), np.zeros((batch.num_rows, 1)))
        top = np.sort(share, axis=1)[:, ::-1]
        lead = top[:, 0] - (top[:, 1] if share.shape[1] > 1 else 0)
        return pa.table(
            {
                "doc_id": at["doc_id"],
                "held_out": at["held_out"],
                "lang_pred": [langs[b] if ok else UNDETERMINED for b, ok in zip(best, usable, strict=True)],
                "score": [float(share[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, usable, strict=True))],
                "ambiguous": [not ok or bool(x < MARGIN) for x, ok in zip(lead, usable, strict=True)],
            }
        )

    return map_batches(scored, decide, _RESULT)
