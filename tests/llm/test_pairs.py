"""Near duplicates, decontamination and repeated strings against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from flowdrift.llm import decontam, graph, neardup, suffixes
from tests.llm import brute


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_near_duplicates_against_all_pairs(make, odd_rows):
    got = rows_of(neardup.near_duplicates(make(odd_rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near_duplicates([r[:2] for r in odd_rows]), key=repr)


def test_tiles_lose_no_link(make, monkeypatch):
    rng = random.Random(5)
    base = [f"t{k}" for k in range(60)]
    rows = [(k, " ".join(w if rng.random() > 0.03 else f"v{rng.randrange(9)}" for w in base)) for k in range(60)]
    monkeypatch.setattr(neardup, "TILE_ROWS", 7)
    got = rows_of(neardup.near_duplicates(make(rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near_duplicates(rows), key=repr)


def test_one_row_of_each_component_stays(make, odd_rows):
    docs = make(odd_rows)
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r[0] for r in kept.select("doc_id").collect()), key=repr)
    words = [(d, t) for d, t, *_ in odd_rows]
    expected = sorted({(d, c) for d, n, c, k in brute.near_duplicates(words) if k and n} | {(d, -1) for d, n, *_ in brute.near_duplicates(words) if not n}, key=repr)
    assert ids == sorted((d for d, _ in expected), key=repr)


def test_empty_tables(spark, make):
    none = make([])
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.without_near_duplicates(none).count() == 0
    assert suffixes.remove_repeats(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(none, items).count() == 0
    assert decontam.contamination(make([(1, "a b")]), items).first()["n_hit"] == 0


def test_min_max_values_agree_as_often_as_the_sets():
    rng = np.random.default_rng(0)
    shared, own = rng.integers(1, 1 << 63, 300, dtype=np.uint64), rng.integers(1, 1 << 63, 200, dtype=np.uint64)
    mm = neardup.MinMax(permutations=2000)
    a, b = mm.signature(np.concatenate([shared, own[:100]])), mm.signature(np.concatenate([shared, own[100:]]))
    assert abs((a == b).mean() - 300 / 500) < 0.03


def test_bands_lose_a_pair_at_the_threshold_as_rarely_as_stated():
    columns, rng, lost = neardup.MinMax().columns, np.random.default_rng(1), 0
    assert len(np.unique(columns)) == columns.size and all(len({c % neardup.PERMUTATIONS for c in band}) == len(band) for band in columns)
    for _ in range(20):
        same = rng.random((10_000, 2 * neardup.PERMUTATIONS)) < neardup.SIMILAR / 100
        lost += int((~same[:, columns].all(2).any(1)).sum())
    assert lost <= 8  # 4 in a million of 200,000; 78 when the bands shared 128 values


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in graph.components(edges, "a", "b").collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


ITEMS = [(10, None), (11, ""), (12, "w1"), (13, "One, TWO"), (14, "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11 a12 a13 a14 a15"), (15, "a3 a4 a5 a6 a7 a8 a9 a10 a11 a12 a13 a14 a15"), (15, "x1 x2"), (None, "é ñ")]
CHECKED = [
    (1, None), (2, ""), (3, "w1"), (4, "W1!w10 w1"), (5, "one---two"), (6, "A1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11 a12 a13 a14 a15 " + "q " * 400),
    (6, "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11 a12"), (7, "É ñ é ñ"), (8, "x1 x2 " + "p " * 39), (9, "x1 x2 " * 3000), (None, "x1 x2"), (9, "x1 x2 " * 3000),
]


@pytest.mark.parametrize("part_bytes", [decontam.PART_BYTES, 150])
def test_contamination(spark, make, part_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.contamination(make(CHECKED), items, part_bytes=part_bytes)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.contamination(CHECKED, ITEMS), key=repr)
    clean = decontam.without_contaminated(make(CHECKED), items, part_bytes=part_bytes)
    assert sorted((r[0] for r in clean.select("doc_id").collect()), key=repr) == sorted((d for d, *_, bad in brute.contamination(CHECKED, ITEMS) if not bad), key=repr)


def test_parts_give_every_column_alike(spark, make, odd_rows):
    """Many small automata and one large one, on texts with several hits, repeated rows and null ids."""
    rows = [*CHECKED, *odd_rows, (None, " ".join(f"x{k}" for k in range(1, 30))), (None, None)]
    items = spark.createDataFrame([*ITEMS, (50, odd_rows[8][1]), (51, odd_rows[8][1][200:500])], "item_id long, text string")
    one, many = (sorted(map(repr, decontam.contamination(make(rows), items, part_bytes=n).collect())) for n in (decontam.PART_BYTES, 150))
    assert one == many and any("start" in r for r in one)


def test_functions_sent_to_executors_stay_small(make, odd_rows):
    suffixes.find_runs(np.zeros(300_000, np.uint8), np.array([300_000]))
    described = neardup._describing()
    for fn in (suffixes._runs, suffixes.find_runs, described, neardup._confirm):
        assert len(cloudpickle.dumps(fn)) < 100_000


def test_spans_point_into_the_original(spark, make):
    text = "Före: ONE -- two! x1\tx2?"
    spans = decontam.contamination(make([(1, text)]), spark.createDataFrame(ITEMS, "item_id long, text string")).first()["spans"]
    assert [text[s["start"] : s["end"]] for s in spans] == ["ONE -- two! x1\tx2"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_is_the_sorted_order(s):
    assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("hot", [suffixes.HOT_STRETCHES, 2])
def test_repeats_against_all_strings(make, odd_rows, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_STRETCHES", hot)
    got = suffixes.remove_repeats(make(odd_rows)).withColumn("sha", F.sha2("kept", 256))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == sorted(brute.remove_repeats([r[:2] for r in odd_rows]), key=repr)


def test_texts_of_null_ids_with_one_checksum_keep_their_own_ranges(make):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, other, texts = noise(260), noise(230), {}
    while True:  # two texts with equal low bits of their CRC, which share passages with others at different places
        one, two = noise(40) + passage + noise(300), noise(400) + other + noise(60)
        texts.setdefault(brute.crc(one) & 0xFFFF, {})[0] = one
        texts.setdefault(brute.crc(two) & 0xFFFF, {})[1] = two
        pair = next((texts[brute.crc(t) & 0xFFFF] for t in (one, two) if len(texts[brute.crc(t) & 0xFFFF]) == 2), None)
        if pair:
            break
    rows = [(None, pair[0]), (None, pair[1]), (1, passage + noise(50)), (2, noise(20) + other)]
    got = suffixes.remove_repeats(make(rows)).withColumn("sha", F.sha2("kept", 256))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == sorted(brute.remove_repeats(rows), key=repr)


def test_null_ids_do_not_join_other_texts(make, monkeypatch):
    rng = random.Random(9)
    rows = []
    for _ in range(20):
        words = [f"n{rng.randrange(500)}" for _ in range(60)]
        rows += [(None, " ".join(words)), (None, " ".join([*words, "tail"]))]
    confirm = neardup._confirm

    def counted(batches):
        for batch in batches:
            assert batch.num_rows <= len(rows)  # one row for each class, not one for each pair of null ids
            yield batch

    monkeypatch.setattr(neardup, "_confirm", lambda batches: confirm(counted(batches)))
    got = rows_of(neardup.near_duplicates(make(rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near_duplicates(rows), key=repr)


def test_long_text_is_cut_into_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    text = bytes(random.Random(1).randrange(97, 123) for _ in range(5500))
    starts = []
    for data, ends, owner, shift in suffixes._pieces([b"short", text]):
        first, length, *_ = suffixes.find_runs(data, ends)
        begins = np.concatenate([[0], ends[:-1]])
        which = np.searchsorted(ends, first, side="right")
        assert set(owner.tolist()) == {1}
        for f, n, k in zip(first, length, which, strict=True):
            starts.extend(range(f - begins[k] + shift[k], f - begins[k] + shift[k] + n))
    assert sorted(starts) == list(range(len(text) - suffixes.LENGTH + 1))
