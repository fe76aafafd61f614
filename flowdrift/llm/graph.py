"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdrift.session import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("h")).first()
    return row["n"], row["h"] or 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, label): every node that has an edge to another node, and the smallest node it reaches.

    Each round links the larger neighbours of a node to its smallest neighbour and
    then the smaller ones, so the number of rounds grows with the logarithm of the
    longest path. Minima are pre-aggregated, no task gathers the neighbours of a
    node, and each round is a stored table. Null ends and loops are ignored.
    """
    known = edges.filter(F.col(a) != F.col(b))
    e = materialize(known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(e)
    while state[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is its own minimum hands itself on; the larger ones now point below themselves
        large = materialize(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        star = large.join(low, F.col("u") == F.col("k"))
        small = star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.union(star.select("u", F.col("m").alias("v"))).distinct())
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
