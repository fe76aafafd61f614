"""Column lists and schemas of flow tables."""

from __future__ import annotations

from pyspark.sql import types as T

FIVE_TUPLE = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
REQUIRED_KEYS = [*FIVE_TUPLE, "flow_duration"]

# NetFlow column -> flow column.
NETFLOW_RENAMES = {
    "IPV4_SRC_ADDR": "src_ip",
    "IPV4_DST_ADDR": "dst_ip",
    "L4_SRC_PORT": "src_port",
    "L4_DST_PORT": "dst_port",
    "PROTOCOL": "protocol",
    "FLOW_START_MILLISECONDS": "start_time",
    "FLOW_END_MILLISECONDS": "end_time",
    "FLOW_DURATION_MILLISECONDS": "flow_duration",
    "IN_PKTS": "tot_bwd_pkts",
    "OUT_PKTS": "tot_fwd_pkts",
    "IN_BYTES": "totlen_bwd_pkts",
    "OUT_BYTES": "totlen_fwd_pkts",
    "SRC_TO_DST_IAT_MIN": "fwd_iat_min",
    "SRC_TO_DST_IAT_MAX": "fwd_iat_max",
    "SRC_TO_DST_IAT_AVG": "fwd_iat_mean",
    "SRC_TO_DST_IAT_STDDEV": "fwd_iat_std",
    "DST_TO_SRC_IAT_MIN": "bwd_iat_min",
    "DST_TO_SRC_IAT_MAX": "bwd_iat_max",
    "DST_TO_SRC_IAT_AVG": "bwd_iat_mean",
    "DST_TO_SRC_IAT_STDDEV": "bwd_iat_std",
}

# The flow-meter columns in file order.
FLOW_COLUMNS = """
src_ip dst_ip src_port dst_port protocol timestamp flow_duration
flow_byts_s flow_pkts_s fwd_pkts_s bwd_pkts_s
tot_fwd_pkts tot_bwd_pkts totlen_fwd_pkts totlen_bwd_pkts
fwd_pkt_len_max fwd_pkt_len_min fwd_pkt_len_mean fwd_pkt_len_std
bwd_pkt_len_max bwd_pkt_len_min bwd_pkt_len_mean bwd_pkt_len_std
pkt_len_max pkt_len_min pkt_len_mean pkt_len_std pkt_len_var
fwd_header_len bwd_header_len fwd_seg_size_min fwd_act_data_pkts
flow_iat_mean flow_iat_max flow_iat_min flow_iat_std
fwd_iat_tot fwd_iat_max fwd_iat_min fwd_iat_mean fwd_iat_std
bwd_iat_tot bwd_iat_max bwd_iat_min bwd_iat_mean bwd_iat_std
fwd_psh_flags bwd_psh_flags fwd_urg_flags bwd_urg_flags
fin_flag_cnt syn_flag_cnt rst_flag_cnt psh_flag_cnt ack_flag_cnt urg_flag_cnt ece_flag_cnt
down_up_ratio pkt_size_avg init_fwd_win_byts init_bwd_win_byts
active_max active_min active_mean active_std idle_max idle_min idle_mean idle_std
fwd_byts_b_avg fwd_pkts_b_avg bwd_byts_b_avg bwd_pkts_b_avg fwd_blk_rate_avg bwd_blk_rate_avg
fwd_seg_size_avg bwd_seg_size_avg cwr_flag_count
subflow_fwd_pkts subflow_bwd_pkts subflow_fwd_byts subflow_bwd_byts
BinLabel
""".split()

# Columns that identify a flow or carry its answer, never model features.
ID_AND_LABEL_COLUMNS = """
Label BinLabel Attack src_ip dst_ip src_port dst_port protocol timestamp device_id session_id
start_time end_time_x end_time_y start_time_x start_time_y time_diff time_diff_seconds
""".split()

# Features kept in the rolling log for NetFlow input.
NETFLOW_LOG_COLUMNS = """
totlen_bwd_pkts tot_bwd_pkts totlen_fwd_pkts tot_fwd_pkts flow_duration
fwd_iat_min fwd_iat_max fwd_iat_mean fwd_iat_std bwd_iat_min bwd_iat_max bwd_iat_mean bwd_iat_std
fwd_pkt_len_mean bwd_pkt_len_mean pkt_len_mean flow_iat_mean down_up_ratio fwd_iat_tot bwd_iat_tot
BinLabel
""".split()

_TEXT = {"src_ip", "dst_ip", "timestamp", "Label"}
_WHOLE = {"src_port", "dst_port", "protocol", "BinLabel"}


def flow_schema(columns: list[str] | None = None) -> T.StructType:
    """Explicit schema of a flow-meter file (no inference pass over the data)."""
    fields = []
    for name in columns or FLOW_COLUMNS:
        kind = T.StringType() if name in _TEXT else T.IntegerType() if name in _WHOLE else T.DoubleType()
        fields.append(T.StructField(name, kind, True))
    return T.StructType(fields)


def netflow_schema(label_columns: tuple[str, ...] = ("Label", "Attack")) -> T.StructType:
    """Explicit schema of a NetFlow file."""
    fields = []
    for name in NETFLOW_RENAMES:
        if name.endswith("_ADDR"):
            kind: T.DataType = T.StringType()
        elif name.startswith("L4_") or name == "PROTOCOL":
            kind = T.IntegerType()
        elif name.endswith(("_AVG", "_STDDEV")):
            kind = T.DoubleType()
        else:
            kind = T.LongType()
        fields.append(T.StructField(name, kind, True))
    for name in label_columns:
        fields.append(T.StructField(name, T.IntegerType() if name == "Label" else T.StringType(), True))
    return T.StructType(fields)
