"""Merkle manifest, periodic runs and embedding links against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.llm import manifest, periodic, vectors
from tests.llm import brute


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


# --- manifest ---


def test_midstates_are_those_of_sha256():
    rng = np.random.default_rng(1)
    for blocks in (1, 2, 5):
        digests = rng.integers(0, 1 << 32, (blocks, 8, 7), dtype=np.uint64).astype(np.uint32)
        state = np.repeat(manifest._START[:, None], 7, axis=1)
        for d in digests:
            state = manifest.compress(state, manifest._hex_words(d))
        got = manifest._to_hex(manifest.compress(state, manifest._padding(np.full(7, blocks, np.uint32))))
        texts = ["".join(manifest._to_hex(d)[k] for d in digests) for k in range(7)]
        assert got == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


@pytest.mark.parametrize("fanout", [2, 3, 5])
@pytest.mark.parametrize("n", [1, 2, 3, 7, 27, 40])
def test_folding_equals_rebuilding(n, fanout):
    leaves = [brute.sha(f"leaf{k}") for k in range(n)]
    digest = manifest._from_hex(leaves)
    levels = manifest.build_levels(digest, manifest._height(n, fanout), fanout)
    plain = brute.levels(leaves, fanout)
    assert [manifest._to_hex(d) for d, _ in levels] == plain[1:]
    fresh = manifest._from_hex([brute.sha(f"other{k}") for k in range(n)])
    want = [brute.levels(leaves[:k] + [brute.sha(f"other{k}")] + leaves[k + 1 :], fanout)[-1][0] for k in range(n)]
    assert manifest._to_hex(manifest.fold_levels(fresh, np.arange(n), digest, levels, fanout)) == want
    for k in range(n):
        path = manifest._steps(k, plain[: len(levels)], levels, fanout)
        assert manifest._to_hex(manifest.fold_path(fresh[:, [k]], path)) == [want[k]]


def document_rows(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


@pytest.mark.parametrize("block", [4, 4096])
def test_manifest_against_brute_force(spark, make, odd_rows, monkeypatch, block):
    """Small blocks give several rounds; there are null ids, repeated rows, equal ids, nulls everywhere."""
    monkeypatch.setattr(manifest, "BLOCK", block)
    docs = make([*odd_rows, (70, None, None, None), (70, None, None, None), (None, None, None, None), (71, "lone", "xx", None)])
    docs = docs.withColumn("n_chars", F.when(F.col("doc_id") != 21, F.col("n_chars")))
    got = manifest.audited_documents(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert ordered(got.collect()) == ordered(brute.manifest(document_rows(docs)))


def test_manifest_with_wide_parents_and_paths(spark, make, odd_rows, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK", 9)
    docs = make(odd_rows)
    leaf = manifest.leaf_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    tree = manifest.manifest(docs, "lang", "doc_id", leaf, fanout=3)
    plain = brute.manifest(document_rows(docs), 3)
    rows = tree.audited(paths=True).collect()
    assert ordered(r[:5] for r in rows) == ordered(r[:5] for r in plain)
    for r in rows:
        assert r.verified and r.folded_root == tree.root
        path = [s.asDict() for s in r.path]
        assert manifest._to_hex(manifest.fold_path(manifest._from_hex([r.leaf]), path)) == [tree.root]


def test_manifest_of_nothing(make):
    assert manifest.audited_documents(make([])).count() == 0


def test_one_language_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK", 8)
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 290, "en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")
    )
    assert ordered(manifest.audited_documents(docs).collect()) == ordered(brute.manifest(document_rows(docs)))


# --- periodic runs ---


def test_cover_meets_every_difference():
    far = periodic._meeting()
    covered = {int(x) for x in periodic.COVER}
    for i in range(periodic.PERIOD):
        for d in range(periodic.PERIOD):
            assert (i + far[i, d]) % periodic.PERIOD in covered and (i + d + far[i, d]) % periodic.PERIOD in covered


def words_of(rng, n, kind):
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 40))]
        return [rng.choice("abcd") for _ in range(rng.randint(0, 9))] + unit * rng.randint(2, 9) + unit[: rng.randint(0, len(unit))]
    if kind == 2:
        return ["a"] * n
    return [f"w{rng.randint(0, 30)}" for _ in range(n)]


def test_extensions_against_brute_force():
    rng = random.Random(5)
    texts = [words_of(rng, rng.randint(1, 150), k % 4) for k in range(12)]
    a, top = [99], 1000
    for t in texts:
        a += [hash_of(w) for w in t] + [top]
        top += 1
    a = np.array(a, np.int64)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a)), np.arange(len(a))))
    i, j = i[i != j][::17], j[i != j][::17]
    got = periodic.Lce(a)(i, j)
    for x, y, n in zip(i, j, got, strict=True):
        k = 0
        while x + k < len(a) and y + k < len(a) and a[x + k] == a[y + k]:
            k += 1
        assert n == k


def hash_of(word):
    return sum(ord(c) << (5 * i) for i, c in enumerate(word)) % 97


@pytest.mark.parametrize("grid", [50, 1 << 20])
def test_runs_against_brute_force(monkeypatch, grid):
    monkeypatch.setattr(periodic, "GRID", grid)
    rng = random.Random(7)
    texts = [words_of(rng, rng.choice([0, 1, 5, 6, 7, 40, 200]), k % 4) for k in range(120)]
    number = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    got = list(zip(*(x.tolist() for x in periodic.runs_of([np.array([number[w] for w in t], np.int64) for t in texts])), strict=True))
    assert got == [(k, *r) for k, t in enumerate(texts) for r in brute.runs(t)]


@pytest.mark.parametrize("chunk", [10, 200_000])
def test_documents_against_brute_force(spark, make, odd_rows, monkeypatch, chunk):
    monkeypatch.setattr(periodic, "CHUNK_WORDS", chunk)
    rng = random.Random(9)
    more = [(100 + k, " ".join(words_of(rng, 60, k % 4)), "en", "a") for k in range(80)]
    rows = [*(r for r in odd_rows if r[1] is None or len(r[1]) < 20_000), *more, (None, "a b " * 9, "en", "a"), (200, "x\x0b" * 7 + "\xa0 y", None, None)]
    got = periodic.document_runs(make(rows))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert ordered(got.collect()) == ordered(brute.periodic([r[:2] for r in rows]))
    assert periodic.document_runs(make([])).count() == 0


def test_a_very_long_text(spark, make):
    """30,000 words of one kind and a long text with one long period."""
    unit = " ".join(f"u{k}" for k in range(4000))
    found = {r.doc_id: r for r in periodic.periodic_runs(make([(1, "same " * 30_000), (2, " ".join([unit] * 5))])).collect()}
    assert [tuple(r) for r in found[1].runs] == [(0, 30_000, 1)] and found[1].collapsed == "same"
    assert [tuple(r) for r in found[2].runs] == [(0, 20_000, 4000)] and found[2].collapsed == unit


# --- embeddings ---

VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("key", T.StringType()), T.StructField("Node", T.StringType())]
)


def odd_vectors(width=8):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=width)) for k in range(60)]
    base = rng.normal(size=width)
    rows += [(100 + k, base + rng.normal(size=width) * s) for k, s in enumerate(np.linspace(0.01, 0.9, 80))]
    rows += [(300 + k, base) for k in range(5)] + [(300, base), (None, base * 2), (None, -base), (None, rng.normal(size=width))]
    rows += [(400, np.zeros(width)), (401, np.full(width, np.nan)), (402, np.full(width, np.inf)), (403, base[: width // 2]), (404, base[: width // 2] * 3)]
    out = [(k, [float(np.float32(x)) for x in v]) for k, v in rows]
    return [*out, (405, None), (406, []), (407, [None] + [1.0] * (width - 1)), (None, None)]


@pytest.mark.parametrize("tile,strip", [(4, 7), (1024, 512)])
def test_links_against_brute_force(spark, monkeypatch, tile, strip):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "LEAST_STRIP", strip)
    rows = odd_vectors()
    df = spark.createDataFrame([(k, v, "x", "y") for k, v in rows], VECTORS).repartition(3)
    got = vectors.similar_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert ordered(got.collect()) == ordered(brute.similar(rows))


def test_links_of_doubles_and_of_nothing(spark):
    rows = [(k, [x * (1 + 1e-12 * k) for x in v] if v and None not in v else v) for k, v in odd_vectors(70) if k is not None]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ordered(vectors.similar_vectors(df).collect()) == ordered(brute.similar(rows))
    assert vectors.similar_vectors(df.limit(0)).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(6)
    for width in (3, 64, 1500):
        x = rng.normal(size=(60, width)) * rng.exponential(size=(60, width)) ** 2
        q, scale, error, length = vectors.quantised(x)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        close = vectors._product(q, q) * scale[:, None] * scale
        assert (np.abs(unit @ unit.T - close) <= error[:, None] + length[:, None] * error + 1e-6).all()
        exact = q.astype(np.int64) @ q.astype(np.int64).T
        assert (vectors._product(q, q) == exact).all()


def test_only_open_pairs_are_recomputed(monkeypatch):
    """Random vectors need no cosine, near copies are linked by their bounds; pairs close to the threshold are computed."""
    rng = np.random.default_rng(8)
    count = []
    exact = vectors.cosine
    monkeypatch.setattr(vectors, "cosine", lambda x, y: count.append(len(x)) or exact(x, y))

    def strip(x):
        q, *bounds = vectors.quantised(x)
        row = {"ids": np.arange(len(x)).tobytes(), "weights": np.ones(len(x), np.int64).tobytes(), "kind": x.dtype.str, "vectors": x.tobytes(), "quantised": q.tobytes(), "bounds": np.stack(bounds).tobytes()}
        return vectors._Strip(row)

    far = strip(rng.normal(size=(300, 64)))
    assert len(vectors._links(far, far, 0, 0, 0.9)[0]) == 300 and sum(count) == 0
    base = rng.normal(size=64)
    near = strip(base + rng.normal(size=(200, 64)) * 0.05)
    assert len(vectors._links(near, near, 0, 0, 0.9)[0]) == 40_000 and sum(count) == 0
    edge = base + rng.normal(size=(200, 64)) * 0.33
    x = strip(edge)
    got = set(zip(*(v.tolist() for v in vectors._links(x, x, 0, 0, 0.9)), strict=True))
    unit = edge / np.linalg.norm(edge, axis=1, keepdims=True)
    assert got == set(zip(*(v.tolist() for v in np.nonzero(unit @ unit.T >= 0.9)), strict=True))
    assert 0 < sum(count) < 20_000


def test_functions_sent_to_executors_stay_small():
    for fn in (periodic._look_at, vectors._compare(0.9), vectors._pack, manifest.build_levels, manifest.fold_path):
        assert len(cloudpickle.dumps(fn)) < 100_000
