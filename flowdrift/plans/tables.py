"""Input tables and the flow views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowdrift.operators.clean import derive_flow_features


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FLOW_COLUMNS = """
  event_id, ts AS timestamp,
  concat('10.0.', cast(user_id {div} 256 AS {text}), '.', cast(user_id % 256 AS {text})) AS src_ip,
  concat('192.168.1.', cast(k % 4 AS {text})) AS dst_ip,
  1024 + user_id AS src_port,
  CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'purchase' THEN 8443
                  WHEN 'signup' THEN 22 ELSE 23 END AS dst_port,
  CASE WHEN k % 2 = 0 THEN 6 ELSE 17 END AS protocol,
  1 + k % 17 AS tot_fwd_pkts,
  event_id % 5 AS tot_bwd_pkts,
  cast(round(value * 100) AS bigint) AS totlen_fwd_pkts,
  (event_id % 5) * 64 AS totlen_bwd_pkts,
  1000 * (1 + event_id % 7) AS flow_duration,
  CASE event_type WHEN 'error' THEN 'TCPAttack' WHEN 'signup' THEN 'UDPAttack' ELSE 'Benign' END AS label,
  k % 5 AS fwd_iat_min, k % 5 + event_id % 11 AS fwd_iat_max,
  k % 5 + (event_id % 11) / 2 AS fwd_iat_mean, (event_id % 11) / 4 AS fwd_iat_std,
  k % 3 AS bwd_iat_min, k % 3 + event_id % 13 AS bwd_iat_max,
  k % 3 + (event_id % 13) / 2 AS bwd_iat_mean, (event_id % 13) / 4 AS bwd_iat_std,
  1 + k % 17 AS subflow_fwd_pkts, event_id % 5 AS subflow_bwd_pkts,
  cast(round(value * 100) AS bigint) AS subflow_fwd_byts, (event_id % 5) * 64 AS subflow_bwd_byts,
  100 + k % 60 AS fwd_pkt_len_max, k % 40 AS fwd_pkt_len_min, (k % 40) / 8 AS fwd_pkt_len_std,
  100 + event_id % 60 AS bwd_pkt_len_max, event_id % 40 AS bwd_pkt_len_min, (event_id % 40) / 8 AS bwd_pkt_len_std,
  (k % 10) / 4 AS fwd_blk_rate_avg, (event_id % 10) / 4 AS bwd_blk_rate_avg
"""


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records derived from ``events`` (one flow per event)."""
    events = (
        table(spark, sf_dir, "events")
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    )
    return events.selectExpr(*_split_columns(_FLOW_COLUMNS.format(div="div", text="string")))


def _split_columns(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    parts, depth, current = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += ch
    return [*parts, current.strip()]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records with the derived packet and inter-arrival features."""
    return derive_flow_features(raw_flows(spark, sf_dir))


RAW_FLOWS_SQL = f"""raw_flows AS (
SELECT {_FLOW_COLUMNS.format(div="//", text="varchar")}
FROM (SELECT *, cast(regexp_extract(props, '[0-9]+', 0) AS int) AS k FROM events))"""

FLOWS_SQL = f"""{RAW_FLOWS_SQL},
flows AS (
SELECT *,
  CASE WHEN tot_fwd_pkts <> 0 THEN totlen_fwd_pkts / tot_fwd_pkts ELSE 0 END AS fwd_pkt_len_mean,
  CASE WHEN tot_bwd_pkts <> 0 THEN totlen_bwd_pkts / tot_bwd_pkts ELSE 0 END AS bwd_pkt_len_mean,
  CASE WHEN tot_fwd_pkts + tot_bwd_pkts <> 0
       THEN (totlen_fwd_pkts + totlen_bwd_pkts) / (tot_fwd_pkts + tot_bwd_pkts) ELSE 0 END AS pkt_len_mean,
  CASE WHEN tot_fwd_pkts + tot_bwd_pkts > 1
       THEN flow_duration / (tot_fwd_pkts + tot_bwd_pkts - 1) ELSE 0 END AS flow_iat_mean,
  CASE WHEN tot_fwd_pkts > 0 THEN tot_bwd_pkts / tot_fwd_pkts ELSE 0 END AS down_up_ratio,
  fwd_iat_mean * (tot_fwd_pkts - 1) AS fwd_iat_tot,
  bwd_iat_mean * (tot_bwd_pkts - 1) AS bwd_iat_tot
FROM raw_flows)"""


# A ratio of small whole numbers often averages to half a unit of the sixth place, so it keeps more places.
FINE = {"down_up_ratio": 9}


def rounded(df: DataFrame, places: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round floating columns for comparison; whole numbers become bigint, times microseconds."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float") and f.name not in skip:
            c = F.round(c.cast("double"), max(places, FINE.get(f.name, 0)))
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.unix_micros(c.cast("timestamp"))
        out.append(c.alias(f.name))
    return df.select(*out)


FIVE = "src_ip, dst_ip, src_port, dst_port, protocol"
