"""Mixing, sharding and the pipeline against brute force."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from flowdrift.llm import mixing, quality, sharding
from tests.llm import brute
from tests.llm.test_pairs import rows_of


def test_mix_against_brute_force(make, odd_rows):
    docs = make(odd_rows)
    got = mixing.mix(docs)
    assert rows_of(got, "doc_id", "size", "source_size", "taken") == sorted(((d, n, s, t) for d, n, s, _, t in brute.mix([(r[0], r[1], r[3]) for r in odd_rows])), key=repr)
    for (_, _, _, want), row in zip(sorted(((d, n, s, t) for d, n, s, t, _ in brute.mix([(r[0], r[1], r[3]) for r in odd_rows])), key=repr), rows_of(got, "doc_id", "size", "source_size", "target"), strict=True):
        assert row[3] == pytest.approx(want)
    taken = {r["source"]: (r["t"], r["w"]) for r in got.groupBy("source").agg({"taken": "sum", "target": "max"}).toDF("source", "t", "w").collect()}
    assert all({t, int(w)} == {t} or abs(t - w) <= 1 for t, w in (sorted(v) for v in taken.values()))


def test_copies_hold_the_words_that_the_mix_takes(make, odd_rows):
    docs = make(odd_rows)
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    words = copies.select(mixing.word_count(copies["text"]).alias("n")).agg({"n": "sum"}).first()[0]
    assert words == mixing.mix(docs).agg({"taken": "sum"}).first()[0]


def test_empty_mix_and_shards(make):
    assert mixing.mix(make([])).count() == 0
    assert mixing.mixed_documents(make([(1, None, None, None)])).count() == 0
    assert sharding.shard(make([])).count() == 0


def test_shards_against_brute_force(make, odd_rows):
    rows = odd_rows + [(100 + k, "same text again and again", "en", "a") for k in range(40)]
    got = sharding.shard(make(rows)).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == sorted((r[0], len(brute.data(r[1])) + 8, brute.crc(r[1])) for r in rows if r[0] is not None)
    load, slots = {}, {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(load.values()) == brute.shards([r[:2] for r in rows])
    assert all(0 <= s < 24 for s in load) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_groups_that_fit_a_shard_stay_whole(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        got = sharding.shard(docs)
        even = got.agg({"size": "sum"}).first()[0] / sharding.SHARDS
        cut = got.join(docs.select("doc_id", "text"), "doc_id").groupBy("text").agg(F.countDistinct("shard").alias("n"), F.sum("size").alias("bytes"))
        assert cut.filter("n > 1").filter(F.col("bytes") <= even).count() == 0


@pytest.mark.parametrize("cells", [32, 400, 1 << 16])
def test_cuts_do_not_depend_on_the_grid(spark, cells):
    rng = random.Random(cells)
    sizes = [rng.choice([1, 5, 9, 300]) for _ in range(500)]
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    positions = spark.createDataFrame([(e,) for e in ends[:-1]], "position long")
    capacity = sharding.smallest_capacity(ends, ends[-1], 7, 1, ends[-1])
    assert sharding.best_cuts(positions, ends[-1], 7, cells) == sharding.greedy_cuts(ends, ends[-1], 7, capacity)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=30), st.integers(1, 6))
def test_smallest_capacity(sizes, shards):
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    c = sharding.smallest_capacity(ends, ends[-1], shards, 1, ends[-1])
    assert sharding.greedy_cuts(ends, ends[-1], shards, c) is not None
    assert c == 1 or sharding.greedy_cuts(ends, ends[-1], shards, c - 1) is None


CLEAN = "The old house stood at the end of a long road, and nobody had lived there for many years.\nThen a family came from the city with two dogs and a piano, and they opened every window of the place.\nSoon the garden was green again, and people stopped at the gate to talk about the weather and the news."


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        (None, False), ("", False), (CLEAN, True), (CLEAN.replace("\n", " "), True), (CLEAN + "\nHome | News | About | Contact", True),
        ("\n".join(f"Home | About | Page {k}" for k in range(40)), False), (" ".join(f"word{k}###" for k in range(80)), False),
        ("\n".join(["same line of words here again."] * 30), False), (CLEAN + "\nAll rights reserved.", True), ("word " * 49, False),
    ],
)
def test_quality_verdicts(text, kept):
    assert quality.judge(brute.data(text))["kept"] is kept


def test_clean_documents_keep_their_text():
    assert quality.judge(CLEAN.encode())["cleaned"] == CLEAN.encode()
    assert quality.judge((CLEAN + "\nHome | News | About\n").encode())["cleaned"] == (CLEAN + "\n").encode()


def test_a_long_line_may_mention_a_boilerplate_phrase():
    prose = CLEAN.replace("\n", " ")
    long = prose + " Nobody reads the privacy policy of a shop. " + prose
    assert quality.judge(long.encode())["cleaned"] == long.encode()
    short = "See our Privacy Policy for more."
    assert quality.judge(f"{CLEAN}\n{short}\n".encode())["cleaned"] == (CLEAN + "\n").encode()


def test_quality_counts(make):
    rows = [(1, "a b c a b c d #$ \n\nx\nx\n"), (2, None), (2, None), (None, "é é é é"), (3, "|" * 100_000)]
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.quality(make(rows)).collect()}
    assert got == {(1, 10, 11, 2, 1, 6), (2, 0, 0, 0, 0, 0), (None, 4, 4, 0, 0, 4), (3, 1, 100_000, 100_000, 0, 0)}
    assert quality.quality(make([])).count() == 0 and quality.cleaned_documents(make([])).count() == 0


def test_pipeline_against_brute_force(spark, make, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(n // 4)) + "." for _ in range(4))
    texts = [prose(rng.choice([30, 80, 120, 200])) for _ in range(40)]
    texts += [texts[3] + " tail.", texts[3], texts[5], None, ""]
    item = " ".join(word() for _ in range(20))
    texts += [item + "\n" + prose(60), prose(1200) + "\n" + item, "Home | News\n" * 40]
    rows = [(k, t, "en", rng.choice(["a", "b", "c", None])) for k, t in enumerate(texts)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = []
    for d, t, _, s in rows:
        j = quality.judge(brute.data(t))
        if j["kept"]:
            kept.append((d, j["cleaned"].decode(), s))
    single = {d for d, n, c, k in brute.near_duplicates([(d, t) for d, t, _ in kept]) if k}
    kept = [r for r in kept if r[0] in single]
    dirty = {d for d, *_, bad in brute.contamination([(d, t) for d, t, _ in kept], [(1, item)]) if bad}
    kept = [r for r in kept if r[0] not in dirty]
    expected = {}
    for d, n, _, _, taken in brute.mix(kept):
        expected[d] = -(-taken // n) if taken else 0
    copies = {}
    for r in got:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert copies == {d: n for d, n in expected.items() if n}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "source mix", "sharding"]
