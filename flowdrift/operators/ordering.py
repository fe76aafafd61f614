"""Row order without a single-task sort.

Spark's window functions put one window partition into one task. The operators
here need a global order, or an order inside groups of which one may hold a
third of all rows. They therefore cut the order into pieces of bounded size,
work on each piece alone and carry small totals from piece to piece.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.session import materialize

RANGE_ROWS = 200_000
BLOCK_ROWS = 100_000


def with_range_bucket(df: DataFrame, value: str, name: str = "_bucket", buckets: int | None = None) -> DataFrame:
    """Add the index of the value range a row falls into; ranges hold similar row counts.

    The number of ranges follows from the number of rows, so that a range holds
    about ``RANGE_ROWS`` rows at every size; ``buckets`` sets it by hand. Only the
    cut points reach the driver. They are literals of the plan afterwards, so every
    branch and every retried task agrees on them.
    """
    # One range is still computed from the row: a literal would be folded, and joins on it lose their key.
    single = F.pmod(F.hash(value), F.lit(1)).cast("double")
    if buckets is None:
        buckets = -(-df.count() // RANGE_ROWS)
    if buckets < 2:
        return df.withColumn(name, single)
    cuts = df.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.5 / buckets)
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) < 3:
        return df.withColumn(name, single)
    return Bucketizer(splits=splits, inputCol=value, outputCol=name, handleInvalid="keep").transform(df)


def running_sums(
    df: DataFrame,
    by: list[str],
    order: str,
    sums: dict[str, Column],
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Inclusive running sums along ``order`` inside each ``by`` group.

    ``df`` has one row per (by, order): pre-aggregate ties first. Each window
    covers one (group, range) pair; the totals of earlier ranges are added to it.
    """
    parts = with_range_bucket(df, order, buckets=buckets)
    parts = parts.withColumns({f"_in_{k}": c for k, c in sums.items()})
    direction = F.desc if descending else F.asc
    earlier = Window.partitionBy(*by).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        parts.groupBy(*by, "_bucket")
        .agg(*[F.sum(f"_in_{k}").alias(f"_t_{k}") for k in sums])
        .select(
            *[F.col(c).alias(f"_k_{c}") for c in [*by, "_bucket"]],
            *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_c_{k}") for k in sums],
        )
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({f"_l_{k}": F.sum(f"_in_{k}").over(inside) for k in sums})
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_bucket"]])
    return local.join(carried, match, "left").select(
        *df.columns,
        *[(F.coalesce(F.col(f"_l_{k}"), F.lit(0)) + F.col(f"_c_{k}")).alias(k) for k in sums],
    )


def number_rows(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "row_no") -> DataFrame:
    """Exact 1-based row numbers along ``order``, globally or inside each ``by`` group.

    Range partitioning on the full key splits a hot group over many tasks. The
    sorted rows are written once, because the counts per partition and the
    numbered rows must come from the same sampled ranges.
    """
    by = by or []
    ordered = materialize(
        df.repartitionByRange(*by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("_mid", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_mid", 33))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        ordered.groupBy(*by, "_part")
        .agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(c).alias(f"_k_{c}") for c in [*by, "_part"]],
            (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        )
    )
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_part"]])
    return ordered.join(runs, match).select(*df.columns, (F.col("_mid") + F.col("_shift")).alias(name))


def in_blocks(df: DataFrame, position: str, halo: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Cut a numbered sequence into blocks that also hold the ``halo`` rows before them.

    Adds ``_block`` and ``_own``: a trailing window of ``halo + 1`` rows computed
    per block is right for the rows with ``_own``, and every row is owned once.
    """
    if halo > block:
        raise ValueError("halo must not exceed the block size")
    home = F.floor((F.col(position) - 1) / block)
    tail = F.pmod(F.col(position) - 1, F.lit(block)) >= block - halo
    copies = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home)) if halo else F.array(home)
    return df.withColumn("_block", F.explode(copies)).withColumn("_own", F.col("_block") == home)


def forward_fill(
    df: DataFrame, position: str, value: str, by: list[str], name: str, block: int = BLOCK_ROWS
) -> DataFrame:
    """Latest non-null ``value`` at or before each row, along an integer ``position`` unique inside ``by``."""
    parts = df.withColumn("_block", F.floor(F.col(position) / block))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        parts.groupBy(*by, "_block")
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(position))).alias("_last"))
        .select(
            *[F.col(c).alias(f"_k_{c}") for c in [*by, "_block"]],
            F.last("_last", ignorenulls=True).over(earlier).alias("_carry"),
        )
    )
    inside = Window.partitionBy(*by, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_block"]])
    return local.join(carried, match, "left").select(*df.columns, F.coalesce("_local", "_carry").alias(name))


def group_quantile(
    df: DataFrame,
    by: list[str],
    value: str,
    q: float,
    name: str = "quantile",
    buckets: int | None = None,
    counted: str | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantile per group, for groups of any size.

    Equal values are counted first; the two neighbours of the wanted rank are
    then found by running counts, so no task gathers the values of a group.
    ``counted`` names the count column of a stored table that already has one
    row per (by, value).
    """
    known = df.filter(F.col(value).isNotNull())
    if counted is None:
        counts = materialize(known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")))
    else:
        counts = known.select(*by, value, F.col(counted).alias("_n"))
    ranked = running_sums(counts, by, value, {"_upto": F.col("_n")}, buckets=buckets)
    sizes = counts.groupBy(*[F.col(b).alias(f"_g_{b}") for b in by]).agg(F.sum("_n").alias("_size"))
    rank = F.lit(float(q)) * (F.col("_size") - 1)
    first, upto = F.col("_upto") - F.col("_n"), F.col("_upto")
    holds = lambda r: (first <= r) & (upto > r)
    if by:
        match = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_g_{b}")) for b in by])
        joined = ranked.join(sizes, match)
    else:
        joined = ranked.withColumn("_size", counts.agg(F.sum("_n")).scalar())
    low, high = F.max("_lo"), F.max("_hi")
    return (
        joined.withColumn("_rank", rank)
        .withColumn("_lo", F.when(holds(F.floor("_rank")), F.col(value)))
        .withColumn("_hi", F.when(holds(F.ceil("_rank")), F.col(value)))
        .groupBy(*by)
        .agg(
            (low + (high - low) * (F.max("_rank") - F.floor(F.max("_rank")))).alias(name),
            F.max("_size").alias(f"{name}_n"),
        )
        .select(*by, name)
    )


def assign_chunks(df: DataFrame, n: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Fixed-size chunks in arrival order: adds ``row_no`` (from 1) and ``chunk_id`` (from 0)."""
    return number_rows(df, order, by).withColumn("chunk_id", F.floor((F.col("row_no") - 1) / n).cast("bigint"))


def _tie_break(df: DataFrame) -> Column:
    """A hash of the whole row: rows equal in their order are taken by it, so only identical rows are left to chance."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def _newest_rows(df: DataFrame, n: int, order: list[str], small: int) -> DataFrame:
    """The ``n`` largest rows by ``order``, found by narrowing down the place of the cut.

    A pass counts how many rows lie above each of some pivots of the open interval. The two pivots around the
    ``n``-th row bound the next interval, until that holds at most ``small`` rows; those alone are sorted. Rows
    above the interval are taken by a filter, so no task merges the candidates of all others. These passes read
    the columns of ``order`` alone; the whole row is looked at only where more than ``small`` rows are equal in them.
    """
    size = df.count()
    if size <= n:
        return df
    above, left, inside, tie = None, n, df, _tie_break(df)
    for last in (order, [*order, "_tie"]):
        inside = inside.withColumn("_tie", tie).withColumn("_key", F.struct(*last))
        alike = False  # all open rows have the same key
        while size > small and not alike:
            pivots = _pivots(inside, size, left)
            known = inside.sparkSession.createDataFrame([(pivots,)], T.StructType([T.StructField("_p", T.ArrayType(inside.schema["_key"].dataType))]))
            pivot = known.select("_p").scalar()
            counts = list(inside.agg(*[F.sum((F.col("_key") > pivot[i]).cast("long")) for i in range(len(pivots))]).first())
            # The n-th row is not above the pivot ``high`` and lies above the one before it.
            high = next((i for i, c in enumerate(counts) if c < left), None)
            low = len(pivots) - 1 if high is None else high - 1
            taken = 0 if high is None else counts[high]
            if taken:
                gone = inside.filter(F.col("_key") > pivot[high]).drop("_key", "_tie")
                above = gone if above is None else above.union(gone)
            if high is not None:
                inside = inside.filter(F.col("_key") <= pivot[high])
            if low >= 0:
                inside = inside.filter(F.col("_key") > pivot[low])
            left -= taken
            now = (size if low < 0 else counts[low]) - taken
            alike, size = now == size, now
        if not alike:
            break
    rest = _some_of(inside, left) if alike else inside.orderBy(*[F.desc(c) for c in [*order, "_tie"]]).limit(left)
    rest = rest.drop("_key", "_tie")
    return rest if above is None else above.union(rest)


DRAWN = 4096


def _pivots(inside: DataFrame, size: int, left: int) -> list:
    """Some keys drawn by their hashes, in ascending order as Spark compares them: a single one only if all keys are equal.

    Some of the drawn keys lie around the place of the ``left``-th largest row, closer together the nearer they are to it,
    the others are spread evenly. They are few, as every row is compared with each of them.
    """
    chance, share = F.xxhash64("_key", F.lit(size)), max(1, size // DRAWN)
    while True:
        drawn = inside.select("_key").filter(F.pmod(chance, F.lit(share)) == 0).distinct().orderBy(chance).limit(2 * DRAWN)
        found = [r["_key"] for r in drawn.orderBy("_key").collect()]
        if len(found) > 1 or share == 1:
            break
        share = max(1, share // 64)  # few different keys, of many rows each
    at = round(len(found) * (1 - left / size))
    near = {at + sign * 4**i for i in range(4) for sign in (-1, 1)}
    even = {i * len(found) // 4 for i in range(4)}
    return [found[i] for i in sorted(near | even | {len(found) - 1}) if 0 <= i < len(found)]


def _some_of(rows: DataFrame, n: int) -> DataFrame:
    """``n`` of identical rows: whole partitions first, then the beginning of one."""
    stored = materialize(rows.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    sizes = {r["p"]: r["n"] for r in stored.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    allowed, left = [], n
    for p in sorted(sizes):
        allowed.append((p, min(left, sizes[p])))
        left -= allowed[-1][1]
    quota = rows.sparkSession.createDataFrame(allowed, "_p bigint, _q bigint")
    inside = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(F.broadcast(quota), part == F.col("_p")).filter(inside < F.col("_q")).select(*rows.columns)


def last_n(df: DataFrame, n: int, order: list[str], by: list[str] | None = None, small: int = RANGE_ROWS) -> DataFrame:
    """The newest ``n`` rows, overall or per ``by`` group. Of rows with equal ``order`` those with the larger hash are newer.

    Overall the place of the cut is narrowed down by counting until at most ``small`` rows are open.
    Per group, Spark cuts each group to ``n`` rows before the shuffle for small
    ``n`` (window group limit); larger ``n`` goes through distributed numbering. The rows are the same.
    """
    if not by:
        return _newest_rows(df, n, order, small)
    tied = df.withColumn("_tie", _tie_break(df))
    if n <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in [*order, "_tie"]])
        return tied.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank", "_tie")
    numbered = number_rows(tied, [*order, "_tie"], by, "_rank")
    sizes = df.groupBy(*[F.col(b).alias(f"_g_{b}") for b in by]).agg(F.count(F.lit(1)).alias("_size"))
    match = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_g_{b}")) for b in by])
    return numbered.join(sizes, match).filter(F.col("_rank") > F.col("_size") - n).select(*df.columns)


def trailing_window_rows(
    df: DataFrame, end: str, chunk: str = "chunk_id", duration_us: int = 300_000_000
) -> DataFrame:
    """Rows in view after each chunk: those ending no earlier than the newest end so far minus the duration.

    Adds ``after_chunk``. The newest end only grows, so a row stays in view for
    one run of chunks; its last chunk comes from an as-of lookup, not a range join.
    """
    from flowdrift.operators.joins import asof_match

    micros = F.unix_micros(F.col(end))
    newest = df.groupBy(chunk).agg(F.max(micros).alias("_end"))
    newest = materialize(running_max(newest, chunk, "_end", "_newest").select(chunk, "_newest"))
    # last chunk whose newest end is at or before a given time
    reach = newest.groupBy("_newest").agg(F.max(chunk).alias("_last_chunk"))
    rows = df.withColumn("_limit", micros + F.lit(duration_us)).filter(F.col("_limit").isNotNull())
    match = asof_match(rows.select("_limit"), "_limit", reach.select("_newest"), "_newest")
    seen = (
        rows.join(match, F.col("_limit") == F.col("_left_time"))
        .join(reach, F.col("_right_time") == F.col("_newest"))
        .filter(F.col("_last_chunk") >= F.col(chunk))
    )
    return seen.select(
        *df.columns, F.explode(F.sequence(F.col(chunk), F.col("_last_chunk"))).alias("after_chunk")
    )


def running_max(df: DataFrame, position: str, value: str, name: str, block: int = BLOCK_ROWS) -> DataFrame:
    """Running maximum along an integer position that is unique in ``df``."""
    parts = df.withColumn("_block", F.floor(F.col(position) / block))
    # one row per block of positions
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        parts.groupBy("_block")
        .agg(F.max(value).alias("_m"))
        .select(F.col("_block").alias("_k_block"), F.max("_m").over(earlier).alias("_carry"))
    )
    inside = Window.partitionBy("_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn("_local", F.max(value).over(inside))
    return local.join(carried, F.col("_block") == F.col("_k_block"), "left").select(
        *df.columns, F.greatest("_local", "_carry").alias(name)
    )


def sliding_accuracy(
    df: DataFrame, order: list[str], correct: str, window: int = 100, block: int = BLOCK_ROWS
) -> DataFrame:
    """Mean correctness over the last ``window`` rows, from the first full window on."""
    block = max(block, window)
    parts = in_blocks(number_rows(df, order), "row_no", window - 1, block)
    w = Window.partitionBy("_block").orderBy("row_no").rowsBetween(-(window - 1), 0)
    return (
        parts.withColumn("sliding_accuracy", F.avg(F.col(correct).cast("double")).over(w))
        .filter(F.col("_own") & (F.col("row_no") >= window))
        .select(*df.columns, "row_no", "sliding_accuracy")
    )


def drift_intervals(df: DataFrame, chunk: str = "chunk_id", drift: str = "drift", by: list[str] | None = None) -> DataFrame:
    """Drift chunks with the number of chunks since the previous drift (NULL for the first)."""
    by = by or []
    drifted = number_rows(df.filter(F.col(drift)).select(*by, chunk), [chunk], by, "_no")
    parts = in_blocks(drifted, "_no", 1)
    w = Window.partitionBy(*by, "_block").orderBy("_no")
    return (
        parts.withColumn("drift_interval", F.col(chunk) - F.lag(chunk).over(w))
        .filter("_own")
        .select(*by, chunk, "drift_interval")
    )


def sort_flows(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Global order for a sink (a range-partitioned sort)."""
    return df.orderBy(F.desc(column) if descending else F.asc(column))


def best_by_stat(df: DataFrame, stat: str, value: str, modes: dict[str, str], default: str = "max") -> DataFrame:
    """Rows holding the best value of each statistic, ties kept.

    ``modes`` maps a statistic to ``max``, ``min``, ``both`` or ``all``. The
    extremes are one partial aggregation joined back to the rows.
    """
    unknown = set(modes.values()) - {"max", "min", "both", "all"}
    if unknown:
        raise ValueError(f"unknown mode: {sorted(unknown)}")
    table = F.create_map(*[F.lit(x) for kv in modes.items() for x in kv]) if modes else None
    mode = F.coalesce(F.element_at(table, F.col(stat)), F.lit(default)) if modes else F.lit(default)
    ends = df.groupBy(F.col(stat).alias("_s")).agg(F.max(value).alias("_max"), F.min(value).alias("_min"))
    wanted = F.array_compact(
        F.array(
            F.when(F.col("_mode").isin("max", "both") & (F.col(value) == F.col("_max")), F.lit("highest")),
            F.when(F.col("_mode").isin("min", "both") & (F.col(value) == F.col("_min")), F.lit("lowest")),
            F.when(F.col("_mode") == "all", F.lit("listed")),
        )
    )
    return (
        df.withColumn("_mode", mode)
        .join(ends, F.col(stat) == F.col("_s"))
        .withColumn("best", F.explode(wanted))
        .select(*df.columns, "best")
    )


def last_record_per_file(df: DataFrame, path: str = "path", line_no: str = "line_no", record: str = "text") -> DataFrame:
    """Last record of every file (partial aggregation, no sort)."""
    return df.groupBy(path).agg(F.max(line_no).alias(line_no), F.max_by(record, line_no).alias(record))
