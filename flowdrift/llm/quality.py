"""Line-first cleaning: rules per line, then documents that lose too much are rejected."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowdrift.llm.text import map_batches, quoted, words

SYMBOLS = b"#*$%&|<>"
BOILERPLATE = (
    b"licensed under the",
    b"released under the",
    b"all rights reserved",
    b"terms of use",
    b"terms of service",
    b"privacy policy",
    b"cookie policy",
    b"use of cookies",
    b"enable javascript",
    b"lorem ipsum",
)
NAVIGATION = (b"|", b">", b"\xc2\xbb", b"\xc2\xb7", b"/")


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the document rule; shares are per cent."""

    min_words: int = 50
    max_repeat: int = 50
    max_marks: int = 15  # of a line's bytes: sentence marks
    max_symbols: int = 10  # of a line's bytes: symbols
    max_separators: int = 30  # of a line's words: navigation separators
    max_phrase_line: int = 40  # words of a line that a boilerplate phrase condemns; a longer line only mentions it
    max_lost: int = 50  # of a document's words


_MARKS = re.compile(rb"[.,;:!?]")
_BOILERPLATE = re.compile(b"|".join(re.escape(x) for x in BOILERPLATE))
# A line that ends without a sentence mark is a heading or a menu entry if it is this short.
_SHORT = 3
_CLOSED = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", b"\xe2\x80\xa6", b"\xc2\xbb")


def line_verdict(line: bytes, repeated: bool, rules: Rules) -> str | None:
    """The rule that removes a line with words, or None."""
    found = words(line)
    size = sum(map(len, found))
    if 100 * (size - sum(len(w.translate(None, SYMBOLS)) for w in found)) > rules.max_symbols * size:
        separators = sum(w in NAVIGATION for w in found)
        return "navigation" if 100 * separators > rules.max_separators * len(found) else "punctuation"
    if 100 * sum(w in NAVIGATION for w in found) > rules.max_separators * len(found):
        return "navigation"
    if len(found) > 2 and 100 * len(_MARKS.findall(line)) > rules.max_marks * size:
        return "punctuation"
    if len(found) < _SHORT and not found[-1].endswith(_CLOSED):
        return "navigation"
    if repeated or len(found) <= rules.max_phrase_line and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return None


def repeated_words(found: list[bytes]) -> int:
    """Words covered by a window of three words that occurs at least twice in the text."""
    n = len(found)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int64, n)
    v = len(ids) + 1
    if v < 1 << 20:
        windows = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:
        _, pairs = np.unique(a[:-1] * v + a[1:], return_inverse=True)
        windows = pairs[:-1] * v + a[2:]
    _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def judge(data: bytes, rules: Rules = Rules()) -> dict:  # noqa: B008
    """Base counts, verdict and cleaned text of one document."""
    found = words(data)
    lines, seen, duplicates, lost, kept_lines = data.split(b"\n"), set(), 0, 0, []
    for line in lines:
        own = words(line)
        if not own:
            kept_lines.append(line)
            continue
        repeated = line in seen
        duplicates += repeated
        seen.add(line)
        if line_verdict(line, repeated, rules) is None:
            kept_lines.append(line)
        else:
            lost += len(own)
    n, again = len(found), repeated_words(found)
    base_failed = n < rules.min_words or 100 * again > rules.max_repeat * n
    return {
        "n_words": n,
        "word_chars": len(b"".join(found).decode("utf-8", "replace")),
        "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_dup_lines": duplicates,
        "n_repeat_words": again,
        "n_lost_words": lost,
        "base_failed": base_failed,
        "kept": not base_failed and 100 * lost <= rules.max_lost * n,
        "cleaned": b"\n".join(kept_lines) if lost else data,
    }


_JUDGED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words")],
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Rows (doc_id, counts, base_failed, kept), one for each row of ``docs``.

    Each line with words is held against the rules: too many symbols or sentence
    marks (punctuation), mostly separators or a short open line (navigation), a known
    phrase in a line of at most 40 words or an equal earlier line (boilerplate). A document is kept if it passes
    the base rules and loses at most half of its words with the removed lines. Null
    texts have no words and fail. Lines are cut at ``\\n`` only.
    """

    def run(batch: pa.RecordBatch) -> pa.Table:
        judged = [judge(data or b"", rules) for data in batch.column(1).to_pylist()]
        return pa.table({"doc_id": batch.column(0), **{f.name: [j[f.name] for j in judged] for f in _JUDGED.fields[1:]}})

    return map_batches(docs.select(quoted(doc_id).cast("long"), quoted(text).cast("binary")), run, _JUDGED)


def cleaned_documents(docs: DataFrame, text: str = "text", chars: str | None = "n_chars", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The kept rows of ``docs`` with the removed lines taken out of the text and ``chars`` set to its new length.

    ``chars`` is left alone where it is null, no such column exists or nothing was removed.
    """
    place = docs.columns.index(text)
    length = docs.columns.index(chars) if chars in docs.columns else None

    def run(batch: pa.RecordBatch) -> pa.Table | None:
        column = batch.column(place).cast(pa.binary()).to_pylist()
        judged = [judge(data or b"", rules) for data in column]
        keep = pa.array([j["kept"] for j in judged], pa.bool_())
        table = pa.Table.from_batches([batch])
        clean = pa.array([None if d is None else j["cleaned"].decode("utf-8", "replace") for d, j in zip(column, judged, strict=True)], pa.string())
        table = table.set_column(place, table.field(place).name, clean)
        if length is not None:
            was = batch.column(length).to_pylist()
            now = [w if w is None or not j["n_lost_words"] else len(c) for w, j, c in zip(was, judged, clean.to_pylist(), strict=True)]
            table = table.set_column(length, table.field(length).name, pa.array(now, batch.column(length).type))
        return table.filter(keep)

    return map_batches(docs, run, docs.schema)
