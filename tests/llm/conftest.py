from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        T.StructField("size", T.StringType()),
        T.StructField("_size", T.StringType()),
        T.StructField("Data", T.StringType()),
        T.StructField("_id", T.StringType()),
        T.StructField("shard", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) rows, with extra columns of clashing names."""

    def build(rows):
        full = [(r[0], r[1], (r + (None, None))[2], (r + (None, None))[3], None if r[1] is None else len(r[1]), "s", "t", "d", "i", "h") for r in map(tuple, rows)]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, short and very long ones, repeated rows, null ids, copies and near copies, shared passages."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)] + ["Ärger", "ñandú", "été"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage, long = prose(120), prose(70), prose(30_000)
    words = base.split()
    near = [" ".join(words[:-k] + [f"x{k}"] * k) for k in (1, 3, 6, 12, 20)]
    apart = " ".join(w if i % 9 else f"y{i}" for i, w in enumerate(words))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one", "en", "a"), (5, "one", "de", "b"),
        (6, "ONE two three four", "de", "b"), (7, "one two three four", None, "b"), (8, "one two three four five", "en", "c"),
        (9, base, "en", "c"), (10, base, "en", "c"), (10, base, "en", "c"), (11, base.upper(), "en", None), (12, apart, "fr", None),
        *[(20 + k, t, "en", "a") for k, t in enumerate(near)],
        *[(30 + k, prose(40) + " " + passage + "\n" + prose(25), "de", "hot") for k in range(12)],
        (50, long, "en", "hot"), (51, long + " tail", "en", "hot"), (52, "z" * 5000, "en", "hot"), (53, "ab" * 400, "en", "hot"),
        (None, base, "en", "d"), (None, passage, None, "d"), (60, passage[50:], "es", "d"), (61, prose(300) + "\n" + prose(90), "es", "é"),
    ]
    return rows
