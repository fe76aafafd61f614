"""Registered queries of the corpus operators and, where SQL can state the result, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from flowdrift.llm import decontam, langid, manifest, mixing, neardup, periodic, pii, quality, secret_scan, sharding, suffixes, toxicity, vectors
from flowdrift.llm.text import read
from flowdrift.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORDS = r"'[^\x20\x09-\x0D]+'"


@query(
    "op2_minhash_near_dedup",
    f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove_repeats(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op1_source_mix",
    f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source),
m AS (SELECT *, 3.0 * source_size AS most, sum(source_size) OVER ()::DOUBLE AS total FROM s),
o AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM m),
f AS (SELECT *, (total - used) * w >= most * w_left AS stopped FROM o),
t AS (
  SELECT source, source_size,
    CASE WHEN stopped THEN most ELSE
      (total - coalesce(sum(CASE WHEN stopped THEN most END) OVER (), 0)) * w / sum(CASE WHEN NOT stopped THEN w END) OVER () END::DOUBLE AS target
  FROM f),
x AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat('mix:', d.doc_id::VARCHAR)), d.doc_id, d.size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size * size
        + greatest(0, least(size, budget - budget // source_size * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM x
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sized = materialize(docs.withColumn("size", mixing.word_count(F.col("text"))).drop("text"))
    mixed = mixing.mix(sized, size="size")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op3_benchmark_decontamination",
    f"""
WITH b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS pattern
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
n AS (SELECT DISTINCT n FROM p),
c AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS pattern
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n)),
m AS (SELECT c.doc_id, c.i, c.n, p.item_id FROM c JOIN p ON c.pattern = p.pattern AND c.n = p.n),
h AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  coalesce(t.digest, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op6_minimax_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


@query("op4_toxicity_chain")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query(
    "op5_quality_rules",
    f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS i FROM d),
g AS (
  SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (
  SELECT doc_id, list(i) AS places FROM g WHERE c IS NOT NULL GROUP BY doc_id, a, b, c HAVING count(*) > 1),
r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, unnest(places) AS i FROM h), (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id),
s AS (SELECT doc_id, string_split(t, chr(10)) AS parts FROM d),
l AS (
  SELECT doc_id, i, line, regexp_extract_all(line, {_WORDS}) AS w
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM s)),
m AS (
  SELECT *, array_to_string(w, '') AS joined, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again,
    len(list_filter(w, lambda x: x IN ('|', '>', '»', '·', '/'))) AS bars
  FROM l WHERE len(w) > 0),
v AS (
  SELECT doc_id, len(w) AS n, again,
    100 * (strlen(joined) - strlen(regexp_replace(joined, '[#*$%&|<>]', '', 'g'))) > 10 * strlen(joined)
    OR 100 * bars > 30 * len(w)
    OR (len(w) > 2 AND 100 * len(regexp_extract_all(line, '[.,;:!?]')) > 15 * strlen(joined))
    OR (len(w) < 3 AND NOT regexp_matches(w[-1], '[.!?:;"'')…»]$'))
    OR again
    OR len(w) <= 40 AND regexp_matches({_LOWER.replace("text", "line")}, '{"|".join(x.decode() for x in quality.BOILERPLATE)}') AS bad
  FROM m),
c AS (SELECT doc_id, sum(again::INT) AS dup, sum(CASE WHEN bad THEN n ELSE 0 END) AS lost FROM v GROUP BY doc_id),
b AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost_words
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND 100 * n_lost_words <= 50 * n_words AS kept FROM f
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(read(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words"
    )


@query("op8_secret_forest")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"))


@query("op9_personal_data")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@query("op10_language_codes")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


# CRC-32 of the decimal id: one list element for each bit, the byte joins in at its first bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(xor(a, b) >> 1, 3988292384)
  ELSE xor(a, b) >> 1 END), 4294967295)"""


def _leaf_part(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_leaf_part(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree(name: str, leaves: str) -> str:
    """Nodes (g, lvl, i, n, h) of the trees over ``leaves`` (g, i, n, h)."""
    return f"""{name} AS (
  SELECT g, 0 AS lvl, i, n, h FROM {leaves}
  UNION ALL
  SELECT g, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, lvl, i // 2, n)"""


def _fold(name: str, start: str, tree: str) -> str:
    """Rows (doc_id, g, i, lvl, h, n): ``start`` (doc_id, g, i, h) folded up ``tree``; n = 1 at the top."""
    step = "sha256(CASE WHEN s.h IS NULL THEN f.h WHEN (f.i >> f.lvl) % 2 = 0 THEN f.h || s.h ELSE s.h || f.h END)"
    return f"""{name} AS (
  SELECT doc_id, s.g, s.i, 0 AS lvl, s.h, t.n FROM {start} s JOIN {tree} t ON t.g = s.g AND t.lvl = 0 AND t.i = s.i
  UNION ALL
  SELECT f.doc_id, f.g, f.i, f.lvl + 1, {step}, (f.n + 1) // 2
  FROM {name} f LEFT JOIN {tree} s ON s.g = f.g AND s.lvl = f.lvl AND s.i = xor(f.i >> f.lvl, 1) WHERE f.n > 1)"""


def _siblings(of: str, tree: str) -> str:
    """Rows (doc_id, h): the siblings on the way of ``of`` (doc_id, g, i) up ``tree``, joined level by level."""
    return f"""SELECT d.doc_id, string_agg(s.h, '' ORDER BY s.lvl) AS h
  FROM {of} d JOIN {tree} s ON s.g = d.g AND s.n > 1 AND s.i = xor(d.i >> s.lvl, 1) GROUP BY d.doc_id"""


@query(
    "op11_merkle_manifest",
    f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("n_chars")} AS leaf, {_leaf("n_chars + 1")} AS changed, coalesce({_CRC} % 7 = 0, false) AS hit
  FROM documents),
l AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM d),
{_tree("t", "l")},
s AS (SELECT '' AS g, g AS of, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM t WHERE n = 1),
{_tree("u", "s")},
r AS (SELECT h AS root FROM u WHERE n = 1),
b AS (SELECT doc_id, g, i, CASE WHEN hit THEN changed ELSE leaf END AS h FROM l),
{_fold("f", "b", "t")},
c AS (SELECT f.doc_id, s.g, s.i, f.h FROM f JOIN s ON s.of = f.g WHERE f.n = 1),
{_fold("e", "c", "u")},
low AS ({_siblings("l", "t")}),
high AS ({_siblings("c", "u")})
SELECT l.doc_id, l.leaf, s.h AS subroot, r.root, sha256(coalesce(low.h, '') || coalesce(high.h, '')) AS proof_sha256,
  e.h AS folded_root, e.h = r.root AS verified
FROM l JOIN s ON s.of = l.g JOIN e ON e.doc_id = l.doc_id AND e.n = 1 LEFT JOIN low ON low.doc_id = l.doc_id
  LEFT JOIN high ON high.doc_id = l.doc_id, r
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audited_documents(read(spark, sf_dir, "documents"))


@query(
    "op12_periodic_runs",
    f"""
WITH d AS MATERIALIZED (
  SELECT *, len(v) AS n FROM (
    SELECT doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS v FROM documents)),
a AS (SELECT *, CASE WHEN n > 0 THEN h // 10 % n END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM a),
w AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: v[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE v END AS w FROM p),
x AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM w),
e AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM x JOIN x y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM e),
r AS (
  SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM g GROUP BY doc_id, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)),
m AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY ALL),
k AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS digest
  FROM m GROUP BY doc_id),
b AS (
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
z AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM m),
c AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM x WHERE NOT EXISTS (FROM z WHERE z.doc_id = x.doc_id AND z.i = x.i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
  coalesce(digest, sha256('')) AS runs_sha256, sha256(coalesce(c.t, '')) AS collapsed_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.document_runs(read(spark, sf_dir, "documents"))


@query(
    "op13_embedding_near_dedup",
    """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
n AS (SELECT x, count(*) AS n FROM e GROUP BY x),
r AS (SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT r.vec_id, e.y FROM r JOIN e ON e.x = r.reached),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id)
SELECT d.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, d.vec_id = component_id AS kept
FROM embeddings d JOIN c ON c.vec_id = d.vec_id LEFT JOIN n ON n.x = d.vec_id
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_vectors(read(spark, sf_dir, "embeddings"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
