"""Secret scan: broad candidates, then a random forest that removes false positives. DataFrame operations only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowdrift.llm.text import quoted
from flowdrift.session import materialize

SHORTEST = 16
SHORT = 6  # for values of a secret name and passwords in addresses
BEFORE, AFTER = 64, 32  # characters of context that a finding keeps
KNOWN_WORD = 20  # occurrences in the corpus that make a word known
TRAIN_PER_CLASS = 10_000
TREES, DEPTH = 40, 8
THRESHOLD = 0.5

# Public key formats and the words that name a secret or its opposite.
PROVIDER = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})$"
NAMES = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer)"
_KEY = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORTEST},}}(?![A-Za-z0-9+/_-])"
# Behind a secret name and : or =. The short look back comes first, as few places pass it.
_NAMED = NAMES.replace("(?i)", "(?i:") + r")[\"']?\s{0,2}[:=]\s{0,2}"
_VALUE = "|".join(
    [rf"(?<=[:=]\s{{0,2}}{q})(?<={_NAMED}{q})[^\s{q}]{{{SHORT},}}(?={q})" for q in "\"'"]
    + [rf"(?<=[:=]\s{{0,2}})(?<={_NAMED})(?:[^\s\"'<>&,;]|[&,;](?!\w{{1,32}}[=:])){{{SHORT - 1},}}[^\s\"'<>&,;.:)\]}}]"]
)
_ADDRESS = rf"(?<=:)(?<=://[^\s:/@\"']{{0,64}}:)[^\s/\"'<>]{{{SHORT},}}(?=@)"
# A whole key run that a value ends with stays as it is; else the longer value goes before the run.
CANDIDATE = rf"{_KEY}(?=$|[\s\"'<>&,;)\]}}])|{_VALUE}|{_ADDRESS}|{_KEY}"
HARMLESS = r"(?i)(commit|sha-?1|sha-?256|md5|checksum|digest|uuid|revision|isbn|card|invoice|order)"

FEATURES = [
    "size", "digits", "uppers", "lowers", "hexes", "others", "switches", "variety", "log_transition",
    "coverage", "longest_known", "slashes", "in_path", "in_address", "named", "assigned", "quoted", "harmless", "source_rate",
]


def _share(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit(kind)) / F.length(text)


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (doc_id, source, candidate, start, end, before, after, context), in code points.

    Candidates are runs of at least 16 key characters, and runs of at least 6 characters
    without blanks that are assigned to a secret name (up to the closing quote, or else up
    to a quote, angle bracket or next assignment) or stand as password in an address.
    ``before`` reaches back to the last candidate, ``context`` also over it.
    """
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(source).cast("string").alias("source"), quoted(text).alias("text"))
    rows = rows.filter(F.col("text").rlike(CANDIDATE)).withColumn("row", F.monotonically_increasing_id())
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("candidate"), F.split("text", CANDIDATE, -1).alias("gap"))
    # Gap k stands before candidate k, the last gap behind the last candidate.
    cut = F.transform(
        zipped,
        lambda x: F.struct(x["candidate"].alias("candidate"), F.length(x["gap"]).alias("n"), F.right(x["gap"], F.lit(BEFORE)).alias("before"), F.left(x["gap"], F.lit(AFTER)).alias("after")),
    )
    parts = materialize(rows.select("doc_id", "source", "row", F.posexplode(cut).alias("at", "x")).select("doc_id", "source", "row", "at", "x.*"))
    along = Window.partitionBy("row").orderBy("at")
    start = F.sum(F.col("n") + F.coalesce(F.length("candidate"), F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.length("candidate")
    context = F.right(F.concat(F.coalesce(F.lag("candidate").over(along), F.lit("")), "before"), F.lit(BEFORE))
    placed = parts.withColumns({"start": start, "after": F.lead("after").over(along), "context": context}).filter("candidate is not null")
    return placed.select("doc_id", "source", "candidate", "start", (F.col("start") + F.length("candidate")).alias("end"), "before", F.coalesce("after", F.lit("")).alias("after"), "context")


def known_words(docs: DataFrame, text: str = "text", least: int = KNOWN_WORD) -> DataFrame:
    """Rows (word, n): runs of 3 to 15 letters found ``least`` times in all documents, in lower case."""
    word = F.explode(F.regexp_extract_all(F.lower(quoted(text)), F.lit(r"(?<!\p{L})\p{L}{3,15}(?!\p{L})"), F.lit(0))).alias("word")
    return docs.select(word).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _grams(text: Column, n: int) -> Column:
    """All strings of ``n`` characters; none for shorter texts."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.substr(text, k, F.lit(n)))


def candidate_features(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """Per different candidate: shape, character transitions under the corpus words, coverage by their strings of four."""
    low = F.lower("candidate")
    pairs = words.select("n", F.explode(_grams(F.col("word"), 2)).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n"))
    firsts = pairs.groupBy(F.substring("gram", 1, 1).alias("c")).agg(F.sum("n").alias("all"))
    moves = pairs.join(firsts, F.substring("gram", 1, 1) == F.col("c")).select("gram", F.log(F.col("n") / F.col("all")).alias("p"))
    fours = words.select(F.explode(_grams(F.col("word"), 4)).alias("gram")).distinct().withColumn("seen", F.lit(1.0))
    moved = (
        candidates.select("candidate", F.explode_outer(_grams(low, 2)).alias("gram")).join(moves, "gram", "left")
        .groupBy("candidate").agg(F.avg(F.coalesce("p", F.lit(-9.0))).alias("log_transition"))
    )
    covered = (
        candidates.select("candidate", F.explode_outer(_grams(low, 4)).alias("gram")).join(fours, "gram", "left")
        .groupBy("candidate").agg(F.avg(F.coalesce("seen", F.lit(0.0))).alias("coverage"))
    )
    pieces = candidates.select("candidate", F.explode_outer(F.regexp_extract_all(low, F.lit(r"\p{L}{3,15}"), F.lit(0))).alias("word"))
    longest = (
        pieces.join(words.select("word", F.lit(1).alias("hit")), "word", "left")
        .groupBy("candidate").agg((F.coalesce(F.sum(F.when(F.col("hit") == 1, F.length("word"))), F.lit(0)) / F.length("candidate")).alias("longest_known"))
    )
    c = F.col("candidate")
    switches = F.regexp_count(c, F.lit("[0-9](?=[A-Za-z])")) + F.regexp_count(c, F.lit("[A-Za-z](?=[0-9])")) + F.regexp_count(c, F.lit("[a-z](?=[A-Z])"))
    shape = materialize(candidates.withColumns(
        {
            "size": F.log(F.length(c)),
            "digits": _share(c, "[0-9]"),
            "uppers": _share(c, "[A-Z]"),
            "lowers": _share(c, "[a-z]"),
            "hexes": _share(c, "[0-9a-fA-F]"),
            "others": _share(c, "[^A-Za-z0-9/]"),
            "slashes": _share(c, "/"),
            "switches": switches / F.length(c),
            "variety": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        }
    ))
    return shape.join(moved, "candidate").join(covered, "candidate").join(longest, "candidate")


def weak_label(candidate: Column, before: Column) -> Column:
    """1 for public key formats and mixed values assigned to a secret name or in an address, 0 for letters or digits alone and named checksums, else null."""
    mixed = candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]")
    assigned = before.rlike(NAMES + r"[\"']?\s{0,2}[:=]\s{0,2}[\"']?$") | before.rlike(r"://[^\s:/@\"']{0,64}:$")
    return (
        F.when(candidate.rlike(PROVIDER), 1).when(before.rlike(HARMLESS + r"\W{0,4}$"), 0).when(assigned & mixed, 1).when(~mixed, 0)
    )


def with_context(found: DataFrame) -> DataFrame:
    """Findings with the features of their surroundings and the label that rules give them (``rule``).

    Stored before the joins that follow, which keeps each generated method small.
    """
    flag = lambda c: c.cast("double")
    before, after = F.col("context"), F.col("after")
    return found.withColumns(
        {
            "in_path": flag(before.rlike(r"[/\\.~]$") | after.rlike(r"^[\\.][A-Za-z0-9]")),
            "in_address": flag(before.rlike("@$") | after.rlike("^@")),
            "named": flag(before.rlike(NAMES + r"\W{0,8}$")),
            "assigned": flag(before.rlike(r"[:=]\s{0,2}[\"']?$")),
            "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
            "harmless": flag(before.rlike(HARMLESS + r"\W{0,4}$")),
            "rule": weak_label(F.col("candidate"), before),
        }
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """Rows (doc_id, start, end, candidate_sha256, label, score, secret), one for each candidate.

    Candidates are runs of 16 or more key characters, and shorter or other values that are
    assigned to a secret name or stand as password in an address. The forest sees their length,
    character classes and transitions, how far known corpus words cover them, whether
    they stand in a path or address, the words before them and the share of candidates
    with a digit in their source. It learns from at most about ``per_class`` findings of
    each class that ``weak_label`` or a coverage of 0.8 decides, different in candidate and
    context, those with the smallest hashes. ``secret`` is the forest's verdict over all
    candidates. With labelled findings of one class only, or none, the labels themselves
    decide and the rest is no secret. Null and short texts have no candidates; repeated
    rows give repeated findings; a null source is a source of its own. The secret is
    reported by its digest, never in the clear.
    """
    found = materialize(with_context(findings(docs, doc_id, text, source)))
    words = materialize(known_words(docs, text))
    by_candidate = materialize(candidate_features(found.select("candidate").distinct(), words)).withColumnRenamed("candidate", "_c")
    rate = found.groupBy(F.col("source").alias("_s")).agg(F.avg(F.col("candidate").rlike("[0-9]").cast("double")).alias("source_rate"))
    rows = (
        found.join(by_candidate, F.col("candidate") == F.col("_c"))
        .join(rate, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("label", F.coalesce("rule", F.when(F.col("coverage") >= 0.8, 0)))
    )
    rows = materialize(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).drop(*FEATURES, "_c", "_s"))
    digest = F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256")
    labelled = rows.filter("label is not null").select("label", "features", F.xxhash64("candidate", "before").alias("key")).dropDuplicates(["key"])
    labelled = materialize(labelled)
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(sizes) < 2:
        score = F.coalesce(F.col("label"), F.lit(0)).cast("double")
        return rows.select("doc_id", "start", "end", digest, "label", score.alias("score"), (score >= THRESHOLD).alias("secret"))
    share = F.when(F.col("label") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
    train = labelled.filter(F.pmod("key", F.lit(1_000_000)) < share * 1_000_000)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, labelCol="label", featuresCol="features").fit(train)
    scored = forest.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "end", digest, "label", "score", (F.col("score") >= THRESHOLD).alias("secret"))
