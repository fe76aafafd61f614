"""Toxicity by a classifier chain over word and word-stem features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.llm.text import map_batches, quoted
from flowdrift.session import materialize

CHAIN = ("low_quality", "toxic", "severe")
TRAIN_PER_CLASS = 8_000  # labelled documents of each class to learn from, about
TERMS = 1_500  # features of a model
STEMS = (3, 4, 5, 6)  # lengths of the word beginnings that are features next to whole words
MIN_DOCUMENTS = 5
FOLDS = 3
MARK_FEATURES = 2
THRESHOLD = 0.5

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _key(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) - (1 << 63)


class TermKeys:
    """Keys of a word and of its beginnings; remembers frequent words, in bounded memory."""

    def __init__(self, wanted: dict[int, int] | None = None, remembered: int = 300_000):
        self.wanted, self.remembered, self.known = wanted, remembered, {}

    def of(self, token: bytes) -> tuple[int, ...]:
        found = self.known.get(token)
        if found is None:
            word = token.strip(_PUNCTUATION).decode("utf-8", "replace").lower()
            keys = [_key(b"=" + word.encode())] if word else []
            keys += [_key(word[:n].encode()) for n in STEMS if len(word) >= n]
            if self.wanted is not None:
                keys = [self.wanted[k] for k in keys if k in self.wanted]
            if len(self.known) > self.remembered:
                self.known.clear()
            found = self.known[token] = tuple(keys)
        return found

    def document(self, data: bytes | None) -> set[int]:
        out: set[int] = set()
        for token in set((data or b"").split()):
            out.update(self.of(token))
        return out


def training_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, per_class: int) -> DataFrame:
    """Rows (doc_id, data, low_quality, toxic) of about ``per_class`` labelled documents of each class of ``toxic``.

    Those with the smallest hashes of their id are taken, by one threshold for each
    class. The ids, at most some ``per_class`` of each class, go to the documents, so
    no text is shuffled. Labels that are null, or differ between rows of one id, are not used.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("_id is not null and toxic in (0, 1)")
    known = known.groupBy("_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_t"), F.min("quality").alias("quality")).filter("toxic = _t")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("toxic") == value, F.lit(min(1.0, per_class / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64("_id", F.lit("train")), F.lit(1_000_000)) < share * 1_000_000
    sample = known.filter(drawn).select("_id", "toxic", (F.coalesce("quality", F.lit(1)) == 0).cast("int").alias("low_quality"))
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("binary").alias("data"))
    return rows.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).drop("_id")


_COUNTED = ("fold", "toxic")
_DF = T.StructType([T.StructField("term", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in _COUNTED], T.StructField("n", T.LongType())])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = TermKeys()
    for batch in batches:
        columns = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("data", *_COUNTED)]
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for data, *of in zip(*columns, strict=True):
            own = keys.document(data)
            held.setdefault(tuple(of), []).append(np.fromiter(own, np.int64, len(own)))
        for (fold, toxic), parts in held.items():
            terms, n = np.unique(np.concatenate(parts), return_counts=True)
            same = lambda v: pa.array(np.full(len(terms), v, np.int32))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(terms), same(fold), same(toxic), pa.array(n.astype(np.int64))], _DF.names)


@dataclass(frozen=True)
class Vocabulary:
    """The features of a model: keys of terms, and those of them that mark toxic texts."""

    terms: list[int]
    marks: set[int]


def pick_terms(sample: DataFrame, terms: int) -> list[Vocabulary]:
    """The terms that tell the classes apart best, for each fold without the rows of that fold, and last for all rows.

    ``sample`` has ``data``, ``toxic`` and ``fold``. One pass counts the documents of each term, fold and class.
    """
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy(*_COUNTED).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = materialize(sample.mapInArrow(_document_counts, _DF).groupBy("term", *_COUNTED).agg(F.sum("n").alias("n")))
    found = []
    for without in [*range(FOLDS), None]:
        n0, n1 = (sum(n for (fold, toxic), n in sizes.items() if toxic == c and fold != without) for c in (0, 1))
        used = parts if without is None else parts.filter(F.col("fold") != without)
        counts = used.groupBy("term").agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("c1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c0")
        )
        odds = F.log((F.col("c1") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("c0") + 0.5) / F.lit(n0 + 1.0))
        gap = F.abs(F.col("c1") / F.lit(max(n1, 1)) - F.col("c0") / F.lit(max(n0, 1)))
        # Terms that are many times as frequent in one class rank first, then frequent ones with any difference.
        best = (
            counts.filter(F.col("c1") + F.col("c0") >= MIN_DOCUMENTS)
            .withColumns({"odds": odds, "score": F.abs(odds) * F.sqrt(gap)})
            .orderBy(F.desc("score"), "term")
            .limit(terms)
            .collect()  # bounded by ``terms``
        )
        marks = {r["term"] for r in best if r["odds"] > 3 and r["c1"] >= max(MIN_DOCUMENTS, n1 // 200)}
        found.append(Vocabulary([r["term"] for r in best], marks))
    return found


def _places(vocabularies: list[Vocabulary]) -> tuple[dict[int, int], list[list[int]]]:
    """A number for each term of any vocabulary, and for each vocabulary the numbers of its features.

    Behind the terms of a vocabulary come two features of its own: a mark occurs, and not only once.
    """
    number: dict[int, int] = {}
    for v in vocabularies:
        for t in v.terms:
            number.setdefault(t, len(number))
    own = [[number[t] for t in v.terms] + [len(number) + k * MARK_FEATURES + j for j in range(MARK_FEATURES)] for k, v in enumerate(vocabularies)]
    return number, own


def _with_features(rows: DataFrame, vocabularies: list[Vocabulary], carried: list[str]) -> DataFrame:
    """``carried`` columns and the features of each text (``x``), numbered by ``_places``."""
    wanted, _ = _places(vocabularies)
    marks = [{wanted[t] for t in v.marks} for v in vocabularies]
    schema = T.StructType([*[rows.schema[c] for c in carried], T.StructField("x", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = TermKeys(wanted)
        for batch in batches:
            names = batch.schema.names
            found = []
            for data in batch.column(names.index("data")).to_pylist():
                own = [(keys.of(t), n) for t, n in Counter((data or b"").split()).items()]
                x = sorted({k for ks, _ in own for k in ks})
                for v, toxic in enumerate(marks):
                    hits = sum(n for ks, n in own if not toxic.isdisjoint(ks))
                    x += [len(wanted) + v * MARK_FEATURES + j for j in range(min(MARK_FEATURES, hits))]
                found.append(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in carried), pa.array(found, pa.list_(pa.int32()))], schema.names)

    return rows.mapInArrow(run, schema)


def _vectors(rows: DataFrame, features: list[int], earlier: tuple[str, ...]) -> DataFrame:
    """Adds ``features``: those of one vocabulary as a sparse vector, then the probabilities of earlier categories."""
    counted = CountVectorizerModel.from_vocabulary([str(k) for k in features], inputCol="_tokens", outputCol="_terms").setBinary(True)
    out = counted.transform(rows.withColumn("_tokens", F.col("x").cast("array<string>")))
    return VectorAssembler(inputCols=["_terms", *[f"p_{c}" for c in earlier]], outputCol="features").transform(out)


def _fit(rows: DataFrame, target: str):
    """Logistic regression with L2 penalty, or the one value of ``target`` if there are no two."""
    low, high = rows.agg(F.min(target), F.max(target)).first()
    if low is None or low == high:
        return low or 0
    return LogisticRegression(labelCol=target, maxIter=20, regParam=1e-4, standardization=False).fit(rows)


def _applied(model, rows: DataFrame, name: str) -> DataFrame:
    if isinstance(model, int):
        return rows.withColumn(name, F.lit(float(model)))
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.drop("rawPrediction", "probability", "prediction")


def out_of_fold(sample: DataFrame, features: list[list[int]], earlier: tuple[str, ...], target: str) -> DataFrame:
    """``sample`` stored with ``p_<target>`` of each row from a model that has seen nothing of the row's fold.

    Neither its terms nor its weights depend on that fold: fold k has the vocabulary ``features[k]``.
    """
    whole = None
    for fold in range(FOLDS):
        rows = _vectors(sample, features[fold], earlier)
        part = _applied(_fit(rows.filter(F.col("fold") != fold), target), rows.filter(F.col("fold") == fold), f"p_{target}")
        whole = part if whole is None else whole.union(part)
    return materialize(whole.drop("features", "_tokens", "_terms"))


def fit_chain(sample: DataFrame, features: list[list[int]]) -> tuple[list[np.ndarray], list[float], DataFrame]:
    """Weights and intercept of each category of ``CHAIN``, and the learning rows with their out-of-fold probabilities.

    A later category learns from out-of-fold probabilities of the earlier ones, as
    those of a model on its own learning rows would be too sure. Rows have the targets,
    ``x`` and ``fold``; the last of ``features`` are those of the whole sample.
    """
    weights, intercepts = [], []
    for k, target in enumerate(CHAIN):
        model = _fit(_vectors(sample, features[-1], CHAIN[:k]), target)
        if isinstance(model, int):
            weights.append(np.zeros(len(features[-1]) + k))
            intercepts.append(12.0 if model else -12.0)
        else:
            weights.append(model.coefficients.toArray())
            intercepts.append(float(model.intercept))
        if k + 1 < len(CHAIN):
            sample = out_of_fold(sample, features, CHAIN[:k], target)
    return weights, intercepts, sample


def chain_scores(present: list[int], weights: list[np.ndarray], intercepts: list[float], terms: int) -> list[float]:
    """Probabilities along the chain; each is an input of the later ones."""
    out: list[float] = []
    at = np.array(present, np.int64)
    for w, b in zip(weights, intercepts, strict=True):
        z = b + float(w[at].sum()) + sum(p * v for p, v in zip(out, w[terms:], strict=True))
        out.append(float(1 / (1 + np.exp(-np.clip(z, -50, 50)))))
    return out


def learning_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, per_class: int, terms: int) -> tuple[DataFrame, list[Vocabulary]]:
    """The stored learning rows with targets, fold and features, and the vocabularies that the features are of."""
    sample = training_sample(docs, labels, doc_id, text, per_class)
    fold = F.pmod(F.xxhash64(F.coalesce("data", F.lit(b"")), F.lit("fold")), F.lit(FOLDS)).cast("int")
    sample = materialize(sample.withColumns({"fold": fold, "severe": F.col("toxic") * F.col("low_quality")}))
    vocabularies = pick_terms(sample, terms)
    return materialize(_with_features(sample, vocabularies, ["fold", *CHAIN]).coalesce(8)), vocabularies


_RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType()), *[T.StructField(f"p_{c}", T.DoubleType()) for c in CHAIN], T.StructField("toxic", T.BooleanType()), T.StructField("severe", T.BooleanType())]
)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: int = TRAIN_PER_CLASS, terms: int = TERMS) -> DataFrame:
    """Rows (doc_id, p_low_quality, p_toxic, p_severe, toxic, severe), one for each row of ``docs``.

    The chain predicts low quality, then toxicity, then severe documents (labelled
    toxic and of low quality); each classifier also sees the probabilities of the
    earlier ones, out of fold while it learns. Folds go by a hash of the text, so copies
    of one text share a fold. Features are words and word beginnings
    that occur in a text, so a long text cannot dilute a few words. It learns from
    about ``per_class`` labelled documents with and as many without toxicity. A
    severe document is at least toxic. Texts that are null or empty have no features.
    Without labels nothing is found; with one class everything gets that class.
    Repeated rows get equal results, a null id included.
    """
    learn, vocabularies = learning_rows(docs, labels, doc_id, text, per_class, terms)
    weights, intercepts, _ = fit_chain(learn, _places(vocabularies)[1])
    chosen = vocabularies[-1:]
    n = len(chosen[0].terms) + MARK_FEATURES
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("binary").alias("data"))

    def score(batch: pa.RecordBatch) -> pa.Table:
        names = batch.schema.names
        p = [chain_scores(x, weights, intercepts, n) for x in batch.column(names.index("x")).to_pylist()]
        toxic = [v[1] >= THRESHOLD for v in p]
        return pa.table(
            {
                "doc_id": batch.column(names.index("doc_id")),
                **{f"p_{c}": [v[k] for v in p] for k, c in enumerate(CHAIN)},
                "toxic": toxic,
                "severe": [t and v[2] >= THRESHOLD for t, v in zip(toxic, p, strict=True)],
            }
        )

    return map_batches(_with_features(rows, chosen, ["doc_id"]), score, _RESULT)
