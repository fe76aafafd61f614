"""Queries: cleaning, projection and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdrift.functions import columns
from flowdrift.operators import clean, label
from flowdrift.plans.registry import query
from flowdrift.plans.tables import FINE, FLOWS_SQL, RAW_FLOWS_SQL, flows, raw_flows, rounded, table
from flowdrift.schema import NETFLOW_RENAMES

# NetFlow-style records derived from the flows; a few values are made unusable on purpose.
_NETFLOW_SELECT = """
  event_id,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE src_ip END AS "IPV4_SRC_ADDR",
  dst_ip AS "IPV4_DST_ADDR", src_port AS "L4_SRC_PORT", dst_port AS "L4_DST_PORT", protocol AS "PROTOCOL",
  CASE WHEN event_id % 89 = 0 THEN 'n/a' ELSE cast(1700000000000 + event_id * 1000 AS {text}) END AS "FLOW_START_MILLISECONDS",
  cast(1700000000000 + event_id * 1000 + flow_duration AS {text}) AS "FLOW_END_MILLISECONDS",
  flow_duration AS "FLOW_DURATION_MILLISECONDS",
  tot_bwd_pkts AS "IN_PKTS", tot_fwd_pkts AS "OUT_PKTS",
  totlen_bwd_pkts AS "IN_BYTES", totlen_fwd_pkts AS "OUT_BYTES",
  fwd_iat_min AS "SRC_TO_DST_IAT_MIN", fwd_iat_max AS "SRC_TO_DST_IAT_MAX",
  fwd_iat_mean AS "SRC_TO_DST_IAT_AVG",
  CASE WHEN event_id % 83 = 0 THEN cast('{inf}' AS double)
       WHEN event_id % 79 = 0 THEN cast('NaN' AS double) ELSE fwd_iat_std END AS "SRC_TO_DST_IAT_STDDEV",
  bwd_iat_min AS "DST_TO_SRC_IAT_MIN", bwd_iat_max AS "DST_TO_SRC_IAT_MAX",
  bwd_iat_mean AS "DST_TO_SRC_IAT_AVG", bwd_iat_std AS "DST_TO_SRC_IAT_STDDEV",
  label AS "Attack", CASE WHEN label = 'Benign' THEN 0 ELSE 1 END AS "Label"
"""
NETFLOW_SQL = f"""{RAW_FLOWS_SQL},
netflow AS (SELECT {_NETFLOW_SELECT.format(text="varchar", inf="Infinity")} FROM raw_flows)"""


def netflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowdrift.plans.tables import _split_columns

    text = _NETFLOW_SELECT.format(text="string", inf="Infinity").replace('"', "`")
    return raw_flows(spark, sf_dir).selectExpr(*_split_columns(text))


_TIMES = ("start_time", "end_time")
_RENAMED_SQL = ", ".join(
    f'epoch_us(make_timestamp(try_cast("{old}" AS bigint) * 1000)) AS {new}'
    if new in _TIMES
    else f'cast("{old}" * 1000 AS bigint) AS {new}'
    if new == "flow_duration"
    else f'"{old}" AS {new}'
    if new.endswith(("_ip", "_mean", "_std"))
    else f'cast("{old}" AS bigint) AS {new}'
    for old, new in NETFLOW_RENAMES.items()
)


@query(
    "b1_drop_index_column",
    f"WITH {RAW_FLOWS_SQL} SELECT event_id, src_ip FROM raw_flows",
)
def drop_index_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    exported = raw_flows(spark, sf_dir).select("event_id", "src_ip", F.col("event_id").alias("Unnamed: 0"))
    return clean.drop_index_column(exported)


@query(
    "b2_normalize_netflow",
    f"""WITH {NETFLOW_SQL}
SELECT event_id, {_RENAMED_SQL}, "Attack", cast("Label" AS bigint) AS "Label" FROM netflow""",
)
def normalize_netflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.normalize_netflow(netflow(spark, sf_dir)), 9)


@query(
    "b3_epoch_ms_to_ts",
    f"""WITH {NETFLOW_SQL}
SELECT event_id, epoch_us(make_timestamp(try_cast("FLOW_START_MILLISECONDS" AS bigint) * 1000)) AS start_time
FROM netflow""",
)
def epoch_ms_to_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = columns.epoch_ms_to_ts(F.col("FLOW_START_MILLISECONDS"))
    return rounded(netflow(spark, sf_dir).select("event_id", start.alias("start_time")))


@query(
    "b4_duration_ms_to_us",
    f"""WITH {NETFLOW_SQL}
SELECT event_id, cast("FLOW_DURATION_MILLISECONDS" * 1000 AS bigint) AS flow_duration FROM netflow""",
)
def duration_ms_to_us(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.normalize_netflow(netflow(spark, sf_dir)).select("event_id", "flow_duration"))


_DERIVED = (
    "fwd_pkt_len_mean bwd_pkt_len_mean pkt_len_mean flow_iat_mean down_up_ratio fwd_iat_tot bwd_iat_tot".split()
)


@query(
    "b5_derive_flow_features",
    f"WITH {FLOWS_SQL} SELECT event_id, {', '.join(f'round({c}, {FINE.get(c, 6)}) AS {c}' for c in _DERIVED)} FROM flows",
)
def derive_flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.derive_flow_features(raw_flows(spark, sf_dir)).select("event_id", *_DERIVED))


@query(
    "b6_nonfinite_to_null",
    f"""WITH {NETFLOW_SQL}
SELECT event_id, CASE WHEN isfinite("SRC_TO_DST_IAT_STDDEV") THEN "SRC_TO_DST_IAT_STDDEV" END AS fwd_iat_std
FROM netflow""",
)
def nonfinite_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean.drop_nonfinite(netflow(spark, sf_dir))
    return cleaned.select("event_id", F.col("SRC_TO_DST_IAT_STDDEV").alias("fwd_iat_std"))


@query(
    "b7_require_keys",
    f"""WITH {NETFLOW_SQL}
SELECT event_id, "IPV4_SRC_ADDR" AS src_ip FROM netflow WHERE "IPV4_SRC_ADDR" IS NOT NULL AND "IPV4_DST_ADDR" IS NOT NULL
AND "L4_SRC_PORT" IS NOT NULL AND "L4_DST_PORT" IS NOT NULL AND "PROTOCOL" IS NOT NULL
AND "FLOW_DURATION_MILLISECONDS" IS NOT NULL""",
)
def require_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.require_keys(clean.normalize_netflow(netflow(spark, sf_dir))).select("event_id", "src_ip")


@query(
    "clean_netflow",
    f"""WITH {NETFLOW_SQL}, n AS (SELECT event_id, {_RENAMED_SQL} FROM netflow WHERE "IPV4_SRC_ADDR" IS NOT NULL)
SELECT event_id, src_ip, start_time, end_time, flow_duration,
 CASE WHEN isfinite(fwd_iat_std) THEN round(fwd_iat_std, 6) END AS fwd_iat_std,
 round(CASE WHEN tot_fwd_pkts <> 0 THEN totlen_fwd_pkts / tot_fwd_pkts ELSE 0 END, 6) AS fwd_pkt_len_mean,
 round(CASE WHEN tot_bwd_pkts <> 0 THEN totlen_bwd_pkts / tot_bwd_pkts ELSE 0 END, 6) AS bwd_pkt_len_mean,
 round(CASE WHEN tot_fwd_pkts + tot_bwd_pkts > 1 THEN flow_duration / (tot_fwd_pkts + tot_bwd_pkts - 1) ELSE 0 END, 6)
   AS flow_iat_mean,
 round(fwd_iat_mean * (tot_fwd_pkts - 1), 6) AS fwd_iat_tot
FROM n""",
)
def clean_netflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ["event_id", "src_ip", "start_time", "end_time", "flow_duration", "fwd_iat_std", "fwd_pkt_len_mean"]
    cleaned = clean.clean_flows(netflow(spark, sf_dir), netflow=True)
    return rounded(cleaned.select(*kept, "bwd_pkt_len_mean", "flow_iat_mean", "fwd_iat_tot"))


@query(
    "b8_parse_flow_ts",
    """SELECT event_id, epoch_us(try_strptime(
  CASE WHEN event_id % 53 = 0 THEN 'unknown' ELSE strftime(ts, '%d-%m-%Y %H:%M') END, '%d-%m-%Y %H:%M')) AS parsed
FROM events""",
)
def parse_flow_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 53 == 0, F.lit("unknown")).otherwise(F.date_format("ts", "dd-MM-yyyy HH:mm"))
    events = table(spark, sf_dir, "events").withColumn("text", text)
    return rounded(events.select("event_id", columns.parse_flow_ts(F.col("text")).alias("parsed")))


@query(
    "b9_numeric_features",
    f"""WITH {RAW_FLOWS_SQL}
SELECT event_id, {", ".join(f"cast({c} AS bigint) AS {c}" for c in ("tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts", "flow_duration"))}
FROM raw_flows""",
)
def numeric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts", "flow_duration"]
    narrow = raw_flows(spark, sf_dir).select("event_id", "src_ip", "dst_ip", "src_port", "timestamp", "label", *wanted)
    kept = clean.drop_if_present(narrow)
    return rounded(kept.select(*clean.numeric_features(kept)))


@query(
    "b10_reindex_columns",
    f"""WITH {RAW_FLOWS_SQL}
SELECT cast(flow_duration AS double) AS flow_duration, NULL::double AS idle_mean, src_ip, event_id FROM raw_flows""",
)
def reindex_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = T.StructType(
        [
            T.StructField("flow_duration", T.DoubleType()),
            T.StructField("idle_mean", T.DoubleType()),
            T.StructField("src_ip", T.StringType()),
            T.StructField("event_id", T.LongType()),
        ]
    )
    return clean.reindex_columns(raw_flows(spark, sf_dir), wanted)


# Values with gaps: null where the bucket number is a multiple of seven.
_GAPS_SQL = """gaps AS (
SELECT event_id, event_type, event_id // 1000 AS chunk_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE value END AS a,
       CASE WHEN user_id % 5 = 0 THEN NULL ELSE cast(event_id % 1000 AS double) END AS b FROM events)"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        F.floor(F.col("event_id") / 1000).alias("chunk_id"),
        F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("a"),
        F.when(F.col("user_id") % 5 != 0, (F.col("event_id") % 1000).cast("double")).alias("b"),
    )


@query(
    "b11_fill_mean",
    f"""WITH {_GAPS_SQL}
SELECT event_id, round(coalesce(a, (SELECT avg(a) FROM gaps)), 6) AS a,
       round(coalesce(b, (SELECT avg(b) FROM gaps)), 6) AS b FROM gaps""",
)
def fill_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.fill_mean(gaps(spark, sf_dir), ["a", "b"]).select("event_id", "a", "b"))


@query(
    "b11_fill_mean_per_chunk",
    f"""WITH {_GAPS_SQL}
SELECT event_id, chunk_id, round(coalesce(a, avg(a) OVER (PARTITION BY chunk_id)), 6) AS a,
       round(coalesce(b, avg(b) OVER (PARTITION BY chunk_id)), 6) AS b FROM gaps""",
)
def fill_mean_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = clean.fill_mean(gaps(spark, sf_dir), ["a", "b"], by=["chunk_id"])
    return rounded(filled.select("event_id", "chunk_id", "a", "b"))


@query(
    "b13_fill_median",
    f"""WITH {_GAPS_SQL}
SELECT event_id, round(coalesce(a, (SELECT quantile_cont(a, 0.5) FROM gaps)), 6) AS a,
       round(coalesce(b, (SELECT quantile_cont(b, 0.5) FROM gaps)), 6) AS b FROM gaps""",
)
def fill_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.fill_median(gaps(spark, sf_dir), ["a", "b"]).select("event_id", "a", "b"))


@query(
    "b14_null_inf_profile",
    f"""WITH {NETFLOW_SQL}
SELECT 'IPV4_SRC_ADDR' AS "column", count(*) - count("IPV4_SRC_ADDR") AS nulls, 0::bigint AS infinities FROM netflow
UNION ALL SELECT 'SRC_TO_DST_IAT_STDDEV', count(*) FILTER ("SRC_TO_DST_IAT_STDDEV" IS NULL OR isnan("SRC_TO_DST_IAT_STDDEV")),
 count(*) FILTER (isinf("SRC_TO_DST_IAT_STDDEV")) FROM netflow
UNION ALL SELECT 'IN_PKTS', count(*) - count("IN_PKTS"), 0 FROM netflow""",
)
def null_inf_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.null_inf_profile(netflow(spark, sf_dir), ["IPV4_SRC_ADDR", "SRC_TO_DST_IAT_STDDEV", "IN_PKTS"])


@query(
    "b15_flag_empty_rows",
    f"WITH {_GAPS_SQL} SELECT event_id, a IS NULL AND b IS NULL AS is_empty FROM gaps",
)
def flag_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.flag_empty_rows(gaps(spark, sf_dir), ["a", "b"]).select("event_id", "is_empty")


@query(
    "b16_valid_ipv4",
    f"""WITH {RAW_FLOWS_SQL}, texts AS (
SELECT event_id, concat(src_ip, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '9' ELSE '.1' END) AS ip
FROM raw_flows)
SELECT event_id, ip, regexp_full_match(ip,
 '(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(\\.(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)){{3}}') AS is_valid FROM texts""",
)
def valid_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "9").otherwise(".1")
    texts = raw_flows(spark, sf_dir).select("event_id", F.concat("src_ip", tail).alias("ip"))
    return texts.withColumn("is_valid", columns.valid_ipv4(F.col("ip")))


# Predictions derived from the records: an error type counts as an attack once its value is high.
_PREDICTED_SQL = f"""{RAW_FLOWS_SQL}, predicted AS (
SELECT event_id, label, CASE WHEN totlen_fwd_pkts > 6000 THEN 'Benign' WHEN dst_port = 23 THEN 'TCPAttack'
 WHEN protocol = 17 THEN 'UDPAttack' ELSE 'Benign' END AS prediction FROM raw_flows)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = (
        F.when(F.col("totlen_fwd_pkts") > 6000, "Benign")
        .when(F.col("dst_port") == 23, "TCPAttack")
        .when(F.col("protocol") == 17, "UDPAttack")
        .otherwise("Benign")
    )
    return raw_flows(spark, sf_dir).select("event_id", "label", said.alias("prediction"))


@query(
    "b17_row_to_json",
    f"""WITH {_PREDICTED_SQL}
SELECT label, prediction, '{{"event_id":' || event_id || ',"label":"' || label || '","prediction":"' || prediction || '"}}'
 AS row_json FROM predicted WHERE label <> prediction""",
)
def row_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.row_to_json(predicted(spark, sf_dir))


@query(
    "c1_binary_label",
    f"""WITH {RAW_FLOWS_SQL}, l AS (SELECT event_id, CASE WHEN event_id % 31 <> 0 THEN label END AS label FROM raw_flows)
SELECT event_id, CASE WHEN label = 'Benign' THEN 0::bigint ELSE 1::bigint END AS "BinLabel" FROM l""",
)
def binary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    gapped = raw_flows(spark, sf_dir).withColumn("label", F.when(F.col("event_id") % 31 != 0, F.col("label")))
    return rounded(label.with_binary_label(gapped, "label").select("event_id", "BinLabel"))


_SPELLED_SQL = f"""{RAW_FLOWS_SQL}, spelled AS (
SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'normal' WHEN 2 THEN 'Malicious' WHEN 3 THEN '1'
  WHEN 4 THEN '0' WHEN 5 THEN 'attacK' WHEN 6 THEN '1.0' ELSE NULL END AS raw FROM raw_flows)"""


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*[F.lit(t) for t in ("BENIGN", "normal", "Malicious", "1", "0", "attacK", "1.0", None)])
    return raw_flows(spark, sf_dir).select("event_id", F.get(texts, (F.col("event_id") % 8).cast("int")).alias("raw"))


@query(
    "c2_normalize_label",
    f"""WITH {_SPELLED_SQL}
SELECT event_id, CASE WHEN raw IN ('BENIGN', 'normal', '0') THEN 0.0::double
 WHEN raw IN ('Malicious', '1') THEN 1.0::double ELSE try_cast(raw AS double) END AS value FROM spelled""",
)
def normalize_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelled(spark, sf_dir).select("event_id", columns.normalize_label(F.col("raw")).alias("value"))


@query(
    "c3_quarantine_good",
    f"""WITH {_SPELLED_SQL}
SELECT event_id, raw, CASE WHEN raw IN ('BENIGN', 'normal', '0') THEN 0::bigint ELSE 1::bigint END AS "BinLabel"
FROM spelled WHERE raw IN ('BENIGN', 'normal', '0', 'Malicious', '1', '1.0')""",
)
def quarantine_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(label.quarantine_bad_labels(spelled(spark, sf_dir), "raw")[0])


@query(
    "c3_quarantine_report",
    f"""WITH {_SPELLED_SQL}, bad AS (SELECT coalesce(raw, 'NULL') AS raw FROM spelled WHERE raw IS NULL OR raw = 'attacK')
SELECT count(*) AS bad_rows, (SELECT list(raw ORDER BY raw) FROM (SELECT DISTINCT raw FROM bad)) AS examples FROM bad""",
)
def quarantine_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.bad_label_report(label.quarantine_bad_labels(spelled(spark, sf_dir), "raw")[1], "raw")


@query(
    "c4_label_by_endpoint",
    f"""WITH {RAW_FLOWS_SQL}
SELECT event_id, cast(src_ip = '10.0.0.7' AND dst_ip = '192.168.1.1' AS bigint) AS "BinLabel" FROM raw_flows""",
)
def label_by_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = columns.label_by_endpoint(F.col("src_ip"), F.col("dst_ip"), "10.0.0.7", "192.168.1.1")
    return rounded(raw_flows(spark, sf_dir).select("event_id", hit.alias("BinLabel")))


@query(
    "c4_label_by_endpoints",
    f"""WITH {RAW_FLOWS_SQL}, pairs AS (SELECT DISTINCT src_ip, dst_ip FROM raw_flows WHERE label = 'TCPAttack')
SELECT f.event_id, cast(p.src_ip IS NOT NULL AS bigint) AS "BinLabel"
FROM raw_flows f LEFT JOIN pairs p ON f.src_ip = p.src_ip AND f.dst_ip = p.dst_ip""",
)
def label_by_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_flows = raw_flows(spark, sf_dir)
    pairs = all_flows.filter(F.col("label") == "TCPAttack").select("src_ip", "dst_ip")
    return rounded(label.label_by_endpoints(all_flows, pairs).select("event_id", "BinLabel"))


@query(
    "c5_passthrough_label",
    f"""WITH {NETFLOW_SQL} SELECT event_id, cast("Label" AS bigint) AS "BinLabel" FROM netflow""",
)
def passthrough_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(label.passthrough_label(netflow(spark, sf_dir)).select("event_id", "BinLabel"))


@query(
    "c6_encode_label",
    f"""WITH {RAW_FLOWS_SQL}, ids AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS id
 FROM (SELECT DISTINCT label FROM raw_flows))
SELECT event_id, label, cast(id AS bigint) AS label_id, label AS label_name,
       list_transform(range(3), lambda i: CASE WHEN i = id THEN 1.0::double ELSE 0.0::double END) AS label_vector
FROM raw_flows JOIN ids USING (label)""",
)
def encode_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    small = raw_flows(spark, sf_dir).select("event_id", "label")
    encoder = label.fit_label_encoder(small, "label")
    coded = label.one_hot_label(label.encode_label(small, encoder), "label_id")
    named = label.decode_label(coded, encoder, "label_id")
    return named.select(
        "event_id",
        "label",
        F.col("label_id").cast("bigint").alias("label_id"),
        "label_name",
        F.slice(vector_to_array("label_vector"), 1, len(encoder.labels)).alias("label_vector"),
    )


@query(
    "c7_decode_prediction",
    f"""WITH {RAW_FLOWS_SQL}
SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'Attack' ELSE 'Benign' END AS name,
  CASE event_id % 4 WHEN 0 THEN 'Benign' WHEN 1 THEN 'TCPAttack' WHEN 2 THEN 'UDPAttack' END AS class_name
FROM raw_flows""",
)
def decode_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Benign", "TCPAttack", "UDPAttack"]
    return raw_flows(spark, sf_dir).select(
        "event_id",
        columns.decode_prediction(F.col("event_id") % 2).alias("name"),
        columns.decode_prediction(F.col("event_id") % 4, names).alias("class_name"),
    )


@query(
    "c8_filter_known_labels",
    f"""WITH {_PREDICTED_SQL} SELECT event_id, label, prediction FROM predicted
WHERE label IN ('Benign', 'TCPAttack') AND prediction IN ('Benign', 'TCPAttack')""",
)
def filter_known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.filter_known_labels(predicted(spark, sf_dir), ["Benign", "TCPAttack"])


@query("c9_class_balance", f"WITH {RAW_FLOWS_SQL} SELECT label, count(*) AS rows FROM raw_flows GROUP BY label")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.class_balance(flows(spark, sf_dir), "label")
