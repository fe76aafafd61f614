"""Queries: sessions, hopping windows, entropy and joins over the derived flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowdrift.operators import features, joins
from flowdrift.plans.features import aggregated_features
from flowdrift.plans.registry import query
from flowdrift.plans.tables import FIVE, FLOWS_SQL, flows, rounded
from flowdrift.session import materialize

FIVE_BIG = "src_ip, dst_ip, src_port, cast(dst_port AS bigint) AS dst_port, cast(protocol AS bigint) AS protocol"


def _session_sql(source: str, wide: bool = False) -> str:
    cols = [
        "cast(sum(flow_duration) AS bigint) AS flow_duration",
        "cast(sum(tot_fwd_pkts) AS bigint) AS total_forward_packets",
        "cast(sum(tot_bwd_pkts) AS bigint) AS total_backward_packets",
        "cast(sum(totlen_fwd_pkts) AS bigint) AS total_bytes_forward",
        "cast(sum(totlen_bwd_pkts) AS bigint) AS total_bytes_backward",
        "round(avg(fwd_pkt_len_mean), 6) AS mean_packet_length_forward",
        "round(avg(bwd_pkt_len_mean), 6) AS mean_packet_length_backward",
        "round(avg(pkt_len_mean), 6) AS packet_size_mean",
        "round(avg(flow_iat_mean), 6) AS flow_iat_mean",
        "round(avg(down_up_ratio), 9) AS down_up_ratio",
    ]
    if source == "flowmeter":
        cols += [
            f"cast(sum({c}) AS bigint) AS {c}"
            for c in ("subflow_fwd_pkts", "subflow_bwd_pkts", "subflow_fwd_byts", "subflow_bwd_byts")
        ]
    for d in ("fwd", "bwd"):
        if source == "flowmeter":
            cols += [
                f"cast(max({d}_pkt_len_max) AS bigint) AS {d}_pkt_len_max",
                f"cast(min({d}_pkt_len_min) AS bigint) AS {d}_pkt_len_min",
                f"round(stddev_samp({d}_pkt_len_std), 6) AS {d}_pkt_len_std",
                f"round(avg({d}_blk_rate_avg), 6) AS {d}_blk_rate_avg",
            ]
            if wide:
                cols.append(f"round(avg({d}_pkt_len_mean), 6) AS {d}_pkt_len_mean")
        if source == "netflow" or wide:
            cols.append(f"round(avg({d}_iat_mean), 6) AS {d}_iat_mean")
        cols += [
            f"cast(max({d}_iat_max) AS bigint) AS {d}_iat_max",
            f"cast(min({d}_iat_min) AS bigint) AS {d}_iat_min",
            f"round(sum({d}_iat_tot), 6) AS {d}_iat_tot",
        ]
    cols += ["epoch_us(min(timestamp)) AS start_time", "epoch_us(max(timestamp)) AS end_time"]
    return f"""
SELECT *, total_forward_packets + total_backward_packets AS total_packets,
       total_bytes_forward + total_bytes_backward AS total_bytes
FROM (SELECT {FIVE_BIG}, {", ".join(cols)} FROM flows GROUP BY {FIVE})"""


@query("d1_session_features", f"WITH {FLOWS_SQL} {_session_sql('flowmeter')}")
def session_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.session_features(flows(spark, sf_dir)))


@query("d1_session_features_wide", f"WITH {FLOWS_SQL} {_session_sql('flowmeter', True)}")
def session_features_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.session_features(flows(spark, sf_dir), wide=True))


@query("d2_session_features_netflow", f"WITH {FLOWS_SQL} {_session_sql('netflow')}")
def session_features_netflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.session_features(flows(spark, sf_dir), source="netflow"))


def _hops_sql(size_us: int, step_us: int, with_first: bool = False) -> str:
    first = ""
    if with_first:
        first = "," + ",".join(
            f"arg_min({c}, (timestamp, event_id)) AS {c}" for c in ("src_ip", "dst_ip", "src_port")
        )
        first += "," + ",".join(
            f"cast(arg_min({c}, (timestamp, event_id)) AS bigint) AS {c}" for c in ("dst_port", "protocol")
        )
    return f"""
timed AS (SELECT *, epoch_us(timestamp) - (SELECT min(epoch_us(timestamp)) FROM flows) AS off FROM flows),
member AS (
  SELECT *, unnest(generate_series(
    greatest(0, cast(floor((off - {size_us}) / {step_us}) AS bigint) + 1), off // {step_us})) AS hop
  FROM timed),
inside AS (SELECT * FROM member WHERE off >= hop * {step_us} AND off < hop * {step_us} + {size_us}),
src_n AS (SELECT hop, src_ip AS ip, count(*) AS c FROM inside GROUP BY ALL),
dst_n AS (SELECT hop, dst_ip AS ip, count(*) AS c FROM inside GROUP BY ALL),
src_e AS (SELECT hop, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) AS src_ip_entropy_window FROM src_n GROUP BY hop),
dst_e AS (SELECT hop, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) AS dst_ip_entropy_window FROM dst_n GROUP BY hop),
agg AS (
  SELECT hop,
    cast(sum(tot_fwd_pkts) AS bigint) AS total_forward_packets_window,
    cast(sum(tot_bwd_pkts) AS bigint) AS total_backward_packets_window,
    cast(sum(totlen_fwd_pkts) AS bigint) AS total_forward_bytes_window,
    cast(sum(totlen_bwd_pkts) AS bigint) AS total_backward_bytes_window,
    round(avg(fwd_pkt_len_mean), 6) AS average_packet_size_fwd_window,
    round(avg(bwd_pkt_len_mean), 6) AS average_packet_size_bwd_window,
    cast(sum(flow_duration) AS bigint) AS flow_duration_window,
    count(*) AS packet_count_window,
    round(avg(fwd_iat_mean), 6) AS mean_iat_fwd_window,
    round(avg(fwd_iat_std), 6) AS stddev_iat_fwd_window,
    cast(min(fwd_iat_min) AS bigint) AS min_iat_fwd_window,
    cast(max(fwd_iat_max) AS bigint) AS max_iat_fwd_window,
    round(avg(bwd_iat_mean), 6) AS mean_iat_bwd_window,
    round(avg(bwd_iat_std), 6) AS stddev_iat_bwd_window,
    cast(min(bwd_iat_min) AS bigint) AS min_iat_bwd_window,
    cast(max(bwd_iat_max) AS bigint) AS max_iat_bwd_window,
    (max(off) - min(off)) / 1000000 + 1e-9 AS span
    {first}
  FROM inside GROUP BY hop),
hops AS (
  SELECT hop,
    (SELECT min(epoch_us(timestamp)) FROM flows) + hop * {step_us} AS start_time,
    (SELECT min(epoch_us(timestamp)) FROM flows) + hop * {step_us} + {size_us} AS end_time,
    agg.* EXCLUDE (hop, span),
    packet_count_window / span AS flow_rate_packets_window,
    total_forward_bytes_window / span AS flow_rate_bytes_window,
    total_forward_packets_window / (total_backward_packets_window + 1) AS flow_direction_ratio_window,
    total_forward_bytes_window / (total_backward_bytes_window + 1) AS byte_direction_ratio_window,
    src_ip_entropy_window, dst_ip_entropy_window
  FROM agg JOIN src_e USING (hop) JOIN dst_e USING (hop))"""


HOUR, QUARTER = 3_600_000_000, 900_000_000
RATES = (
    "flow_rate_packets_window",
    "flow_rate_bytes_window",
    "flow_direction_ratio_window",
    "byte_direction_ratio_window",
)


def hop_table(spark: SparkSession, sf_dir: str, with_first: bool = False) -> DataFrame:
    return features.hopping_features(
        flows(spark, sf_dir), "1h", "15min", with_first=with_first, order=["event_id"]
    )


@query("d3_hopping_features", f"WITH {FLOWS_SQL}, {_hops_sql(HOUR, QUARTER)} SELECT * EXCLUDE (hop) FROM hops")
def hopping_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hop_table(spark, sf_dir), skip=RATES)


@query(
    "d3_hopping_features_5s_1s",
    f"WITH {FLOWS_SQL}, {_hops_sql(5_000_000, 1_000_000)} SELECT * EXCLUDE (hop) FROM hops",
)
def hopping_features_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.hopping_features(flows(spark, sf_dir)), skip=RATES)


@query(
    "d3_hopping_features_uneven",
    f"WITH {FLOWS_SQL}, {_hops_sql(2_400_000_000, 1_500_000_000)} SELECT * EXCLUDE (hop) FROM hops",
)
def hopping_features_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size not a multiple of the step."""
    return rounded(features.hopping_features(flows(spark, sf_dir), "40min", "25min"), skip=RATES)


@query(
    "d4_hopping_features_first",
    f"WITH {FLOWS_SQL}, {_hops_sql(HOUR, QUARTER, True)} SELECT * EXCLUDE (hop) FROM hops",
)
def hopping_features_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hop_table(spark, sf_dir, with_first=True), skip=RATES)


@query(
    "d5_entropy",
    f"""WITH {FLOWS_SQL},
n AS (SELECT label, dst_port, src_ip, count(*) AS c FROM flows GROUP BY ALL)
SELECT label, cast(dst_port AS bigint) AS dst_port, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) AS src_ip_entropy
FROM n GROUP BY label, dst_port""",
)
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.entropy(flows(spark, sf_dir), "src_ip", ["label", "dst_port"], "src_ip_entropy"))


@query(
    "d6_window_rates",
    f"""WITH {FLOWS_SQL}, {_hops_sql(HOUR, QUARTER)}
SELECT start_time, {", ".join(RATES)} FROM hops""",
)
def window_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hop_table(spark, sf_dir).select("start_time", *RATES), skip=RATES)


@query(
    "d7_window_span",
    f"""WITH {FLOWS_SQL}, {_hops_sql(HOUR, QUARTER)}
SELECT start_time, (end_time - start_time) / 1000000 AS time_diff_seconds,
       end_time - start_time AS time_diff_us FROM hops""",
)
def window_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = features.window_span(hop_table(spark, sf_dir))
    micros = (F.expr("extract(DAY FROM time_diff)") * 86_400_000_000
              + F.expr("extract(HOUR FROM time_diff)") * 3_600_000_000
              + F.expr("extract(MINUTE FROM time_diff)") * 60_000_000
              + F.expr("extract(SECOND FROM time_diff)") * 1_000_000)
    return rounded(spans.select("start_time", "time_diff_seconds", micros.cast("bigint").alias("time_diff_us")))


@query(
    "d9_distinct_label_map",
    f"WITH {FLOWS_SQL} SELECT DISTINCT {FIVE_BIG}, label FROM flows",
)
def distinct_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(joins.distinct_label_map(flows(spark, sf_dir), ["label"]))


SESSIONS_SQL = f"sessions AS ({_session_sql('flowmeter')})"


@query(
    "e1_asof_join_backward",
    f"""WITH {FLOWS_SQL}, {_hops_sql(HOUR, QUARTER)}, {SESSIONS_SQL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY start_time ORDER BY src_ip DESC, dst_ip DESC, src_port DESC,
                               dst_port DESC, protocol DESC) AS rn FROM sessions)
SELECT h.start_time, h.end_time AS end_time_x, h.packet_count_window,
       s.src_ip, s.dst_ip, s.src_port, s.dst_port, s.protocol, s.total_packets, s.end_time AS end_time_y
FROM hops h ASOF LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) s ON h.start_time >= s.start_time""",
)
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = materialize(hop_table(spark, sf_dir).select("start_time", "end_time", "packet_count_window"))
    sessions = materialize(
        features.session_features(flows(spark, sf_dir)).select(
            "start_time", "end_time", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "total_packets"
        )
    )
    tie = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    return rounded(joins.asof_join_backward(hops, sessions, "start_time", "start_time", tie))


@query(
    "e1_asof_join_flows",
    f"""WITH {FLOWS_SQL}, {SESSIONS_SQL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY end_time ORDER BY src_ip DESC, dst_ip DESC, src_port DESC,
                               dst_port DESC, protocol DESC) AS rn FROM sessions)
SELECT f.event_id, s.src_ip, s.end_time AS session_end
FROM flows f ASOF LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) s ON epoch_us(f.timestamp) >= s.end_time""",
)
def asof_join_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flow with the latest session that had ended by then; early flows have none."""
    f = flows(spark, sf_dir)
    ended = features.session_features(f).withColumnRenamed("end_time", "session_end")
    tie = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    right = ended.select("session_end", *tie)
    joined = joins.asof_join_backward(f.select("event_id", "timestamp"), right, "timestamp", "session_end", tie)
    return rounded(joined.select("event_id", "src_ip", "session_end"))


@query(
    "e2_window_session_join",
    f"""WITH {FLOWS_SQL}, {_hops_sql(HOUR, QUARTER, True)}, {SESSIONS_SQL}
SELECT h.start_time AS start_time_x, h.end_time AS end_time_x, s.start_time AS start_time_y, s.end_time AS end_time_y,
       h.src_ip, h.dst_ip, h.src_port, h.dst_port, h.protocol, h.packet_count_window, s.total_packets, s.total_bytes
FROM hops h LEFT JOIN sessions s USING ({FIVE})""",
)
def window_session_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = hop_table(spark, sf_dir, with_first=True)
    joined = joins.window_session_join(hops, features.session_features(flows(spark, sf_dir)))
    keep = ["start_time_x", "end_time_x", "start_time_y", "end_time_y", "src_ip", "dst_ip", "src_port", "dst_port"]
    return rounded(joined.select(*keep, "protocol", "packet_count_window", "total_packets", "total_bytes"))


@query(
    "e3_label_join",
    f"""WITH {FLOWS_SQL}, {SESSIONS_SQL}, m AS (SELECT DISTINCT {FIVE}, label FROM flows)
SELECT s.src_ip, s.dst_ip, s.src_port, s.dst_port, s.protocol, s.total_packets, m.label
FROM sessions s LEFT JOIN m ON s.src_ip IS NOT DISTINCT FROM m.src_ip AND s.dst_ip IS NOT DISTINCT FROM m.dst_ip
 AND s.src_port IS NOT DISTINCT FROM m.src_port AND s.dst_port IS NOT DISTINCT FROM m.dst_port
 AND s.protocol IS NOT DISTINCT FROM m.protocol""",
)
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flows(spark, sf_dir)
    sessions = features.session_features(f).select(
        "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "total_packets"
    )
    return rounded(joins.label_join(sessions, joins.distinct_label_map(f, ["label"])))


@query(
    "e3_label_join_fanout",
    f"""WITH {FLOWS_SQL}, pairs AS (SELECT src_ip, dst_ip, count(*) AS flows FROM flows GROUP BY ALL),
m AS (SELECT DISTINCT src_ip, dst_ip, label FROM flows)
SELECT p.src_ip, p.dst_ip, p.flows, m.label FROM pairs p LEFT JOIN m USING (src_ip, dst_ip)""",
)
def label_join_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address pairs carry several labels, so rows fan out."""
    f = flows(spark, sf_dir)
    keys = ["src_ip", "dst_ip"]
    pairs = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("flows"))
    return joins.label_join(pairs, joins.distinct_label_map(f, ["label"], keys), keys)


@query(
    "d8_offset_seconds",
    f"""WITH {FLOWS_SQL}, {_hops_sql(HOUR, QUARTER)}
SELECT start_time AS start_time_x,
       round((start_time - (SELECT min(start_time) FROM hops)) / 1000000, 6) AS timestamp_offset_seconds FROM hops""",
)
def offset_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = hop_table(spark, sf_dir).select(F.col("start_time").alias("start_time_x"))
    return rounded(features.offset_seconds(hops))


AGGREGATED_SQL = f"""WITH {FLOWS_SQL}, {_hops_sql(HOUR, QUARTER)}, {SESSIONS_SQL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY start_time ORDER BY src_ip DESC, dst_ip DESC, src_port DESC,
                               dst_port DESC, protocol DESC) AS rn FROM sessions),
joined AS (
  SELECT h.* EXCLUDE (hop), s.* EXCLUDE (start_time, end_time, rn), s.end_time AS session_end
  FROM hops h ASOF LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) s ON h.start_time >= s.start_time)
SELECT j.* EXCLUDE (end_time, session_end), j.end_time AS end_time_x, j.session_end AS end_time_y, m.label,
       CASE WHEN m.label IS NOT DISTINCT FROM 'Benign' THEN 0::bigint ELSE 1::bigint END AS "BinLabel"
FROM joined j LEFT JOIN (SELECT DISTINCT {FIVE}, label FROM flows) m USING ({FIVE})"""


@query("aggregated_features", AGGREGATED_SQL)
def aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows to sessions and windows, as-of joined and labelled."""
    return rounded(aggregated_features(flows(spark, sf_dir), "1h", "15min", label="label"), skip=RATES)
