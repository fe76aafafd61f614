"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets, whole epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowdrift.llm.text import WORD, free_name, ordered_prefix
from flowdrift.session import materialize

MOST_EPOCHS = 3  # a source is repeated so often at most
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row (source, source_size, target, before it: rank and weight) for each row (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. All sizes together
    are shared by weight. A target stops at ``MOST_EPOCHS`` times its source's size
    and the excess is shared again. In the order of size by weight the stopped
    sources come first, so one running sum finds them. The table has one row for
    each source, which is the granularity of a mixing configuration.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", (F.pmod(F.row_number().over(ranked) - 1, F.lit(3)) + 1).cast("double"))
    w = w.withColumn("most", F.lit(float(MOST_EPOCHS)) * F.col("source_size"))
    order = [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()]
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    w = w.withColumns(
        {
            "taken_before": F.coalesce(F.sum("most").over(earlier), F.lit(0.0)),
            "weights_left": F.sum("weight").over(rest),
            "total": F.sum("source_size").over(every).cast("double"),
        }
    )
    w = w.withColumn("stopped", (F.col("total") - F.col("taken_before")) * F.col("weight") >= F.col("most") * F.col("weights_left"))
    w = w.withColumns(
        {
            "fixed": F.coalesce(F.sum(F.when(F.col("stopped"), F.col("most"))).over(every), F.lit(0.0)),
            "open": F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(every),
        }
    )
    share = (F.col("total") - F.col("fixed")) * F.col("weight") / F.col("open")
    return w.select("source", "source_size", F.when(F.col("stopped"), F.col("most")).otherwise(share).alias("target"))


MIXED = ("size", "source_size", "target", "taken", "copies", "last_words")


def _mixed(docs: DataFrame, doc_id: int, counted: Column, source: int) -> DataFrame:
    """``docs`` with columns c0, c1, ... and the columns ``MIXED``; ids and sources are given by place."""
    ids, sources = F.col(f"c{doc_id}"), F.col(f"c{source}")
    keyed = docs.withColumns({"size": counted, "_order": F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(ids.cast("string"), F.lit(""))))})
    rows, sums = ordered_prefix(keyed, [sources, F.col("_order"), ids, F.col("size")], sources, F.col("size"))
    sizes = sums.groupBy(F.col("_group").alias("source")).agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(sizes).select(F.col("source").alias("_source"), "source_size", "target")
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select(F.col("_part").alias("_p"), F.col("_group").alias("_g"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    parts = materialize(parts.join(targets, F.col("_g").eqNullSafe(F.col("_source"))).drop("_source"))
    out = rows.join(parts, (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g")))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_before") + F.col("_shift"))))
    copies = F.when(F.col("size") > 0, whole + F.when(part > 0, 1).otherwise(0)).otherwise(F.lit(0))
    last = F.when(part > 0, part).when(whole > 0, F.col("size")).otherwise(F.lit(0))
    return out.select(
        *docs.columns,
        "size",
        "source_size",
        "target",
        (whole * F.col("size") + part).cast("long").alias("taken"),
        copies.cast("long").alias("copies"),
        last.cast("long").alias("last_words"),
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None) -> DataFrame:
    """The columns of ``docs`` and (size, source_size, target, taken, copies, last_words), one row for each document.

    Size is the number of words (or the column ``size``); null texts have none. In
    each source the documents are put into the order of a hash of their id and walked
    through as often as the target needs; the last pass ends exactly at the budget
    (the target without its fraction), inside a document if need be. ``taken`` counts
    the words taken from the document over all passes, ``copies`` the passes that
    reach it, ``last_words`` the words of the last copy. Null is a source of its own.
    Rows with equal id are ordered by their size, so equal rows may swap places, which
    no result shows. Columns of ``docs`` that clash with the new ones get underscores.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    counted = word_count(F.col(f"c{names.index(text)}")) if size is None else F.coalesce(F.col(f"c{names.index(size)}"), F.lit(0)).cast("long")
    out = _mixed(plain, names.index(doc_id), counted, names.index(source))
    final: list[str] = []
    for name in names:
        final.append(free_name([*MIXED, *final], name) if name.lower() in MIXED else name)
    return out.toDF(*final, *MIXED)


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as documents: one row for each copy, with the columns of ``docs``.

    The copy at which a budget ends keeps its first words, set apart by one blank.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    body = f"c{names.index(text)}"
    rows = _mixed(plain, names.index(doc_id), word_count(F.col(body)), names.index(source))
    rows = rows.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    cut = (F.col("_copy") == F.col("copies")) & (F.col("last_words") < F.col("size"))
    short = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), F.lit(1), F.col("last_words").cast("int")), " ")
    kept = rows.withColumn(body, F.when(cut, short).otherwise(F.col(body)))
    return kept.select(*plain.columns).toDF(*names)
