"""Personal data: patterns find protected entities, corpus co-occurrence finds the terms that reveal them."""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.llm.text import map_batches, quoted
from flowdrift.session import materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
NEAR = 6  # words on each side of an entity that may reveal it
DISCLOSURE = 0.8  # share of an entity's information that a term may give away
CONFIDENCE = 0.8416  # normal quantile of the lower bound on a term's share of documents with the entity (80 %: doubt is for removal)

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind only skips starts inside a run of digits, which fail where the start of the run has failed.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = string.punctuation


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses; looks only around each @, so long words cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        local = text[done:at]
        size = len(local) - len(local.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if size else None
        if domain:
            yield at - size, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of the kinds, then of the starts."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _term(token: str) -> str:
    return token.strip(_TRIM).lower()


def _key(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def _entity(kind: str, value: str) -> int:
    return _key(f"{kind}:{value.lower() if kind == 'email' else _NOT_DIGIT.sub('', value) if kind != 'ip' else value}")


def _family(kind: str, value: str) -> int:
    """What a value shares with others of its kind: mail domain, network of 16 bits, card issuer, start of a phone number."""
    if kind == "email":
        own = value.rsplit("@", 1)[1].lower()
    elif kind == "ip":
        own = ".".join(value.split(".")[:2])
    else:
        own = _NOT_DIGIT.sub("", value)[: 6 if kind == "card" else 4]
    return _key(f"{kind} family:{own}")


def term_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """Words that are terms: at least two letters or digits, outside the base spans."""
    taken = sorted((a, b) for _, a, b in base)
    out, k = [], 0
    for m in _TOKEN.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            continue
        term = _term(m.group())
        if len(term) > 1:
            lead = len(m.group()) - len(m.group().lstrip(_TRIM))
            out.append((m.start() + lead, m.start() + lead + len(m.group().strip(_TRIM)), term))
    return out


_MENTION = T.StructType([T.StructField("entity", T.LongType()), T.StructField("near", T.ArrayType(T.LongType()))])
_FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
        T.StructField("base", T.StringType()),
        T.StructField("mentions", T.ArrayType(_MENTION)),
        T.StructField("words", T.ArrayType(T.LongType())),
        T.StructField("data", T.StringType()),
    ]
)


def _find(batch: pa.RecordBatch) -> pa.Table:
    """Base spans of each document; mentions, terms and the text itself only where there are any."""
    out: dict[str, list] = {f.name: [] for f in _FOUND.fields[1:]}
    for text in batch.column(1).to_pylist():
        spans = base_spans(text or "")
        for k in KINDS:
            out[f"n_{k}"].append(sum(s[0] == k for s in spans))
        out["base"].append(joined(spans))
        mentions, words = [], []
        if spans:
            terms = term_spans(text, spans)
            keys = [_key(t) for _, _, t in terms]
            starts = [a for a, _, _ in terms]
            words = sorted(set(keys))
            for kind, a, b in spans:
                at = int(np.searchsorted(starts, a))
                near = sorted(set(keys[max(0, at - NEAR) : at + NEAR]))
                mentions.extend({"entity": e, "near": near} for e in (_entity(kind, text[a:b]), _family(kind, text[a:b])))
        out["mentions"].append(mentions)
        out["words"].append(words)
        out["data"].append(text if spans else None)
    return pa.table({"doc_id": batch.column(0), **out})


_FREQUENCY = T.StructType([T.StructField("term", T.LongType()), T.StructField("n", T.LongType())])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, number of documents) for some documents at a time, so that the shuffle carries sums."""
    known: dict[bytes, int] = {}
    held: list[np.ndarray] = []
    size = 0

    def summed() -> pa.RecordBatch:
        terms, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n.astype(np.int64))], ["term", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            own = set()
            for token in set(text.encode().split()):
                h = known.get(token)
                if h is None:
                    if len(known) > 500_000:
                        known.clear()
                    term = _term(token.decode())
                    h = known[token] = _key(term) if len(term) > 1 else 0
                own.add(h)
            own.discard(0)
            held.append(np.fromiter(own, np.int64, len(own)))
            size += len(own)
        if size > 2_000_000:
            yield summed()
            held, size = [], 0
    if held:
        yield summed()


_RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("sanitised", T.StringType()),
    ]
)


def sanitise(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Base spans become their kind; of the terms, numbers and names are generalised and other words removed."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            at = max(at, b)
            continue
        own = text[a:b]
        word = f"<{kind.upper()}>" if kind != TERM else "<NUMBER>" if any(c.isdigit() for c in own) else "<NAME>" if own[:1].isupper() else ""
        out.extend((text[at:a], word))
        at = b
    out.append(text[at:])
    return "".join(out)


def _finish(batch: pa.RecordBatch) -> pa.Table:
    at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
    digests, spans, clean = [], [], []
    for base, text, flagged in zip(at["base"].to_pylist(), at["data"].to_pylist(), at["terms"].to_pylist(), strict=True):
        digests.append(hashlib.sha256(base.encode()).hexdigest())
        if text is None:
            spans.append(base), clean.append(None)
            continue
        found = base_spans(text)
        hot = set(flagged or [])
        if hot:
            found = found + [(TERM, a, b) for a, b, t in term_spans(text, found) if _key(t) in hot]
        spans.append(joined(found)), clean.append(sanitise(text, found))
    return pa.table(
        {"doc_id": at["doc_id"], **{f"n_{k}": at[f"n_{k}"] for k in KINDS}, "base_sha256": digests, "spans": spans, "sanitised": pa.array(clean, pa.string())}
    )


def _at_least(part: Column, whole: Column) -> Column:
    """Lower end of the Wilson interval of a share."""
    p, z2 = part / whole, CONFIDENCE * CONFIDENCE
    spread = F.sqrt(p * (1 - p) / whole + z2 / (4 * whole * whole))
    return (p + z2 / (2 * whole) - CONFIDENCE * spread) / (1 + z2 / whole)


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, sanitised), one for each row of ``docs``.

    Base spans are matches of four patterns. Each matched value is a protected
    entity, and so is its family (mail domain, network, card issuer, start of a phone
    number), which lets values that occur once count together. The kind itself is no
    secret: it stands in the sanitised text. With N documents an entity e holds
    IC(e) = log(N / df(e)), and a term t near it (six words on each side) gives away
    PMI(t; e) = log(P(e near t | t) N / df(e)). For the probability the lower end of
    its interval (80 % on one side) counts, which admits entities seen once and drops terms that
    stand mostly elsewhere. ``df`` counts all documents. A term that gives away at least
    ``disclosure`` of e is a span of kind ``term`` wherever it stands in a document
    that mentions e. ``sanitised`` is the text with base spans replaced by their kind
    and terms generalised or removed; null where there was nothing to replace, so
    documents without protected entities are left alone. Null texts are empty.
    Repeated rows get equal results and count as documents of their own.

    Only documents with entities carry their text and terms on. The counts that meet
    at one term are stored before, so that Spark can split a frequent one. A frequent term
    reveals few entities, so the last joins stay near the size of those documents.
    """
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("data"))
    found = materialize(map_batches(rows, _find, _FOUND).withColumn("row", F.monotonically_increasing_id()))
    counts = materialize(rows.select("data").mapInArrow(_frequencies, _FREQUENCY).groupBy("term").agg(F.sum("n").alias("df_term")))
    total = F.lit(float(max(found.count(), 1)))
    mention = found.filter("data is not null").select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    entities = mention.select("row", "entity").distinct()
    df_entity = entities.groupBy(F.col("entity").alias("_e")).agg(F.count(F.lit(1)).alias("df_entity"))
    near = mention.select("row", "entity", F.explode("near").alias("term")).distinct()
    both = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("df_both"))
    both = materialize(both.join(df_entity, F.col("entity") == F.col("_e")).drop("_e"))
    information = F.log(total / F.col("df_entity"))
    given = F.log(_at_least(F.col("df_both"), F.col("df_term")) * total / F.col("df_entity"))
    revealing = materialize(
        both.join(counts.withColumnRenamed("term", "_t"), F.col("term") == F.col("_t"))
        .filter((information > 0) & (given >= F.lit(disclosure) * information))
        .select(F.col("entity").alias("_e"), F.col("term").alias("_t"))
    )
    words = found.filter("data is not null").select("row", F.explode("words").alias("term"))
    hits = words.join(revealing, F.col("term") == F.col("_t")).select(F.col("row").alias("_r"), "_e", "term")
    terms = (
        hits.join(entities, (F.col("_r") == F.col("row")) & (F.col("_e") == F.col("entity")), "left_semi")
        .groupBy(F.col("_r").alias("_row")).agg(F.collect_set("term").alias("terms"))
    )
    return map_batches(found.join(terms, F.col("row") == F.col("_row"), "left").drop("mentions", "words", "row", "_row"), _finish, _RESULT)
