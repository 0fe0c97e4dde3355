"""Features and network functions."""

from pyspark.sql import functions as F

from vigilflow import lookups as L
from vigilflow.catalog import views as V
from vigilflow.catalog.registry import query
from vigilflow.functions import features as X
from vigilflow.functions import network as N
from vigilflow.functions.numbers import safe_float

_E = "1e-8::DOUBLE"
_FP, _BP = '"Total Fwd Packets"', '"Total Backward Packets"'
_FB, _BB = f'("Total Length of Fwd Packets" + {_E})', f'("Total Length of Bwd Packets" + {_E})'
_T, _D = f"({_FP} + {_BP} + {_E})", '"Flow Duration"'
_SYN, _ACK, _PSH = '"SYN Flag Count"', '"ACK Flag Count"', '"PSH Flag Count"'
ENGINEERED_SQL = {
    "syn_flag_ratio": f"{_SYN} / {_T}",
    "ack_syn_ratio": f"{_ACK} / ({_SYN} + {_E})",
    "fin_flag_ratio": "0.0",
    "psh_flag_ratio": f"{_PSH} / {_T}",
    "flag_diversity": f"CAST({_SYN} > 0 AS INTEGER) + CAST({_ACK} > 0 AS INTEGER) + CAST({_PSH} > 0 AS INTEGER)",
    "bytes_per_pkt_fwd": f"{_FB} / ({_FP} + {_E})",
    "bytes_per_pkt_bwd": f"{_BB} / ({_BP} + {_E})",
    "pkt_size_ratio": "1.0",
    "fwd_bwd_pkt_ratio": f"{_FP} / ({_BP} + {_E})",
    "fwd_bwd_byte_ratio": f"{_FB} / {_BB}",
    "bwd_fwd_byte_ratio": f"{_BB} / {_FB}",
    "pkts_per_duration": f"{_T} / ({_D} + {_E})",
    "bytes_per_duration": f"({_FB} + {_BB}) / ({_D} + {_E})",
    "duration_log": f"ln(1 + {_D})",
    "slow_indicator": f"{_D} / {_T}",
    "iat_cv": "0.0",
    "fwd_pkt_len_cv": "0.0",
    "rst_flag_ratio": "0.0",
    "header_payload_ratio": "0.0",
    "active_idle_ratio": "0.0",
}
ENGINEERED_SELECT = ", ".join(f"CAST({sql} AS FLOAT) AS {name}" for name, sql in ENGINEERED_SQL.items())
KEYS = ", ".join(V.FLOW_KEY)


@query("F4_engineered_features", f"SELECT {KEYS}, {ENGINEERED_SELECT} FROM flows_v")
def f4(spark, sf):
    return X.engineer(V.flows(spark, sf)).select(*V.FLOW_KEY, *L.ENGINEERED_FEATURES)


# Mirror-flow records from line items: one gap in every kind of field.
_MIRROR = {
    "bidirectional_duration_ms": "CASE WHEN l_linenumber = 7 THEN 0.0E0 ELSE l_extendedprice END",
    "src2dst_duration_ms": "l_extendedprice / 2.0E0",
    "dst2src_duration_ms": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice / 4.0E0 END",
    "src2dst_packets": "CASE WHEN l_partkey % 10 = 0 THEN 0.0E0 ELSE l_quantity END",
    "dst2src_packets": "CASE WHEN l_partkey % 10 = 0 OR l_returnflag = 'R' THEN 0.0E0 ELSE l_quantity * 2.0E0 END",
    "src2dst_bytes": "l_quantity * 60.0E0",
    "dst2src_bytes": "l_quantity * 90.0E0",
    "src2dst_max_ps": "l_quantity + 40.0E0",
    "src2dst_min_ps": "40.0E0",
    "src2dst_mean_ps": "l_quantity / 2.0E0 + 40.0E0",
    "src2dst_stddev_ps": "l_tax * 100.0E0",
    "dst2src_max_ps": "l_quantity + 80.0E0",
    "dst2src_mean_ps": "l_quantity + 50.0E0",
    "bidirectional_stddev_ps": "l_discount * 100.0E0",
    "bidirectional_mean_ps": "l_quantity + 45.0E0",
    "bidirectional_min_ps": "40.0E0",
    "bidirectional_max_ps": "l_quantity + 80.0E0",
    "bidirectional_mean_piat_ms": "l_extendedprice / 100.0E0",
    "src2dst_max_piat_ms": "l_extendedprice / 50.0E0",
    "dst2src_min_piat_ms": "l_tax",
    "src2dst_syn_packets": "1.0E0",
    "dst2src_syn_packets": "CASE WHEN l_linenumber > 3 THEN 1.0E0 ELSE 0.0E0 END",
    "src2dst_ack_packets": "l_quantity",
    "dst2src_ece_packets": "2.0E0",
    "protocol": "CASE WHEN l_suppkey % 3 = 0 THEN 17 ELSE 6 END",
    "dst_port": "CAST(l_partkey % 65536 AS INTEGER)",
}
_MIRROR_SQL = {
    "Flow Duration": "bidirectional_duration_ms * 1000.0",
    "Total Fwd Packets": "src2dst_packets",
    "Total Backward Packets": "dst2src_packets",
    "Total Length of Fwd Packets": "src2dst_bytes",
    "Total Length of Bwd Packets": "dst2src_bytes",
    "Fwd Packet Length Max": "src2dst_max_ps",
    "Fwd Packet Length Min": "src2dst_min_ps",
    "Fwd Packet Length Mean": "src2dst_mean_ps",
    "Fwd Packet Length Std": "src2dst_stddev_ps",
    "Bwd Packet Length Max": "dst2src_max_ps",
    "Bwd Packet Length Mean": "dst2src_mean_ps",
    "Flow Bytes/s": "CASE WHEN bidirectional_duration_ms > 0 THEN (src2dst_bytes + dst2src_bytes) / (bidirectional_duration_ms / 1000.0) ELSE 0 END",
    "Flow Packets/s": "CASE WHEN bidirectional_duration_ms > 0 THEN (src2dst_packets + dst2src_packets) / (bidirectional_duration_ms / 1000.0) ELSE 0 END",
    "Fwd Packets/s": "CASE WHEN bidirectional_duration_ms > 0 THEN src2dst_packets / (bidirectional_duration_ms / 1000.0) ELSE 0 END",
    "Bwd Packets/s": "CASE WHEN bidirectional_duration_ms > 0 THEN dst2src_packets / (bidirectional_duration_ms / 1000.0) ELSE 0 END",
    "Flow IAT Mean": "bidirectional_mean_piat_ms * 1000.0",
    "Fwd IAT Total": "src2dst_duration_ms * 1000.0",
    "Fwd IAT Max": "src2dst_max_piat_ms * 1000.0",
    "Bwd IAT Total": "coalesce(dst2src_duration_ms, 0) * 1000.0",
    "Bwd IAT Min": "dst2src_min_piat_ms * 1000.0",
    "SYN Flag Count": "src2dst_syn_packets + dst2src_syn_packets",
    "ACK Flag Count": "src2dst_ack_packets",
    "ECE Flag Count": "dst2src_ece_packets",
    "Fwd Header Length": "CASE WHEN protocol = 6 THEN 40.0 ELSE 28.0 END * src2dst_packets",
    "Bwd Header Length": "CASE WHEN protocol = 6 THEN 40.0 ELSE 28.0 END * dst2src_packets",
    "Min Packet Length": "bidirectional_min_ps",
    "Max Packet Length": "bidirectional_max_ps",
    "Packet Length Mean": "bidirectional_mean_ps",
    "Packet Length Std": "bidirectional_stddev_ps",
    "Packet Length Variance": "bidirectional_stddev_ps * bidirectional_stddev_ps",
    "Average Packet Size": "bidirectional_mean_ps",
    "Avg Fwd Segment Size": "src2dst_mean_ps",
    "Avg Bwd Segment Size": "dst2src_mean_ps",
    "Subflow Fwd Packets": "src2dst_packets",
    "Subflow Fwd Bytes": "src2dst_bytes",
    "Subflow Bwd Packets": "dst2src_packets",
    "Subflow Bwd Bytes": "dst2src_bytes",
    "act_data_pkt_fwd": "src2dst_packets",
    "min_seg_size_forward": "src2dst_min_ps",
    "Destination Port": "dst_port",
}
ALL_FEATURES = [
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    *[f"{s} Packet Length {k}" for s in ("Fwd", "Bwd") for k in X.STATISTICS],
    "Flow Bytes/s", "Flow Packets/s", "Fwd Packets/s", "Bwd Packets/s",
    *[f"Flow IAT {k}" for k in X.STATISTICS], *[f"{s} IAT {k}" for s in ("Fwd", "Bwd") for k in ("Total", *X.STATISTICS)],
    *[f"{f} Flag Count" for f in (*X.TCP_FLAG_BITS, "ECE")],
    "Fwd Header Length", "Bwd Header Length", "Min Packet Length", "Max Packet Length", "Packet Length Mean", "Packet Length Std",
    "Packet Length Variance", "Average Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "act_data_pkt_fwd", "min_seg_size_forward", *X.UNMEASURED, "Destination Port",
]


def _features_sql(formulas: dict[str, str]) -> str:
    return ", ".join(f'CAST({formulas.get(n, "0.0")} AS DOUBLE) AS "{n}"' for n in ALL_FEATURES)


def _raw(columns: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{sql} AS {n}' for n, sql in {**_KEY, **columns}.items())} FROM lineitem"


_KEY = {"flow_key": "l_orderkey", "flow_line": "l_linenumber", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey"}


def _records(spark, sf, columns: dict[str, str]):
    return V.table(spark, sf, "lineitem").select(*[F.expr(sql).alias(n) for n, sql in {**_KEY, **columns}.items()])


@query("F5_P11_mirror_features", f"SELECT {KEYS}, {_features_sql(_MIRROR_SQL)} FROM ({_raw(_MIRROR)}) WHERE src2dst_packets + dst2src_packets <> 0")
def f5(spark, sf):
    return X.map_mirror_flows(_records(spark, sf, _MIRROR), tuple(V.FLOW_KEY)).select(*V.FLOW_KEY, *[f"`{c}`" for c in ALL_FEATURES])


_EXPORT = {
    "pkts": "CAST(CASE WHEN l_partkey % 10 = 0 THEN 0 ELSE l_quantity END AS BIGINT)",
    "octets": "CAST(l_quantity * 60.0E0 AS BIGINT)",
    "out_pkts": "CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity * 2.0E0 END AS BIGINT)",
    "out_octets": "CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity * 90.0E0 END AS BIGINT)",
    "duration_ms": "CASE WHEN l_linenumber = 7 THEN -5.0E0 ELSE l_extendedprice END",
    "proto": "CASE WHEN l_suppkey % 3 = 0 THEN 17 ELSE 6 END",
    "tcp_flags": "CAST(l_partkey % 64 AS INTEGER)",
    "dst_port": "CAST(l_partkey % 65536 AS INTEGER)",
}
_AVG_F = "CASE WHEN pkts > 0 THEN octets / pkts ELSE 0 END"
_AVG_B = "CASE WHEN out_pkts > 0 THEN out_octets / out_pkts ELSE 0 END"
_AVG = "CASE WHEN pkts + out_pkts > 0 THEN (octets + out_octets) / (pkts + out_pkts) ELSE (octets + out_octets) / 1.0 END"


def _per_second(what: str) -> str:
    return f"CASE WHEN duration_ms > 0 THEN ({what}) / (duration_ms / 1000.0::DOUBLE) ELSE 0 END"


_EXPORT_SQL = {
    "Flow Duration": "duration_ms * 1000.0", "Total Fwd Packets": "pkts", "Total Backward Packets": "out_pkts",
    "Total Length of Fwd Packets": "octets", "Total Length of Bwd Packets": "out_octets",
    **{f"Fwd Packet Length {k}": _AVG_F for k in ("Max", "Min", "Mean")},
    **{f"Bwd Packet Length {k}": _AVG_B for k in ("Max", "Min", "Mean")},
    "Flow Bytes/s": _per_second("octets + out_octets"), "Flow Packets/s": _per_second("pkts + out_pkts"),
    "Fwd Packets/s": _per_second("pkts"), "Bwd Packets/s": _per_second("out_pkts"), "Fwd IAT Total": "duration_ms * 1000.0",
    **{f"{flag} Flag Count": f"tcp_flags // {2 ** bit} % 2" for flag, bit in X.TCP_FLAG_BITS.items()},
    "Fwd Header Length": "CASE WHEN proto = 6 THEN 40.0 ELSE 28.0 END * pkts",
    "Bwd Header Length": "CASE WHEN proto = 6 THEN 40.0 ELSE 28.0 END * out_pkts",
    "Min Packet Length": f"CASE WHEN pkts > 0 THEN {_AVG_F} ELSE {_AVG_B} END",
    "Max Packet Length": _AVG, "Packet Length Mean": _AVG, "Average Packet Size": _AVG,
    "Avg Fwd Segment Size": _AVG_F, "Avg Bwd Segment Size": _AVG_B,
    "Subflow Fwd Packets": "pkts", "Subflow Fwd Bytes": "octets", "Subflow Bwd Packets": "out_pkts", "Subflow Bwd Bytes": "out_octets",
    "act_data_pkt_fwd": "pkts", "min_seg_size_forward": _AVG_F, "Destination Port": "dst_port",
}


@query("F7_netflow_features", f"SELECT {KEYS}, {_features_sql(_EXPORT_SQL)} FROM ({_raw(_EXPORT)})")
def f7(spark, sf):
    return X.map_netflow(_records(spark, sf, _EXPORT), tuple(V.FLOW_KEY)).select(*V.FLOW_KEY, *[f"`{c}`" for c in ALL_FEATURES])


@query(
    "P6_align_features",
    f"""SELECT {KEYS}, CAST("SYN Flag Count" AS FLOAT) AS "SYN Flag Count", CAST(0 AS FLOAT) AS "Idle Mean",
       CAST("Flow Duration" AS FLOAT) AS "Flow Duration" FROM flows_v""",
)
def p6(spark, sf):
    return X.align_features(V.flows(spark, sf), ["SYN Flag Count", "Idle Mean", "Flow Duration"], tuple(V.FLOW_KEY))


@query(
    "F6_safe_float",
    """SELECT event_id AS id, coalesce(CASE WHEN isnan(v) THEN NULL ELSE v END, -1.0) AS v FROM
       (SELECT event_id, TRY_CAST(CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'NaN' WHEN 2 THEN 'x' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v FROM events)""",
)
def f6(spark, sf):
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'NaN' WHEN 2 THEN 'x' ELSE CAST(value AS STRING) END")
    return V.table(spark, sf, "events").select(F.col("event_id").alias("id"), safe_float(raw, -1.0).alias("v"))


@query(
    "F8_J9_direction",
    f"SELECT id, {V.sql_internal('ip')} AS internal, {V.sql_direction('ip', 'src_ip')} AS direction FROM odd_ips",
)
def f8(spark, sf):
    return V.odd_ips(spark, sf).select("id", N.in_networks("ip").alias("internal"), N.flow_direction("ip", "src_ip").alias("direction"))


@query(
    "F9_F10_F16_address_plan",
    f"""SELECT id, CAST({V.sql_vlan('ip')} AS INTEGER) AS vlan, CAST({V.sql_building('ip')} AS INTEGER) AS building, {V.sql_switch('ip')} AS switch_ip,
       CAST({V.sql_vlan('src_ip')} AS INTEGER) AS src_vlan, CAST({V.sql_building('src_ip')} AS INTEGER) AS src_building, {V.sql_switch('src_ip')} AS src_switch FROM odd_ips""",
)
def f9(spark, sf):
    return V.odd_ips(spark, sf).select(
        "id", N.vlan_from_ip("ip").alias("vlan"), N.building_from_ip("ip").alias("building"), N.switch_for_ip("ip").alias("switch_ip"),
        N.vlan_from_ip("src_ip").alias("src_vlan"), N.building_from_ip("src_ip").alias("src_building"),
        N.switch_for_ip("src_ip").alias("src_switch"),
    )


@query(
    "F11_vlan_fallback",
    f"""SELECT id, CAST(sv AS INTEGER) AS src_vlan, CAST(dv AS INTEGER) AS dst_vlan, CAST(CASE WHEN v <> 0 THEN v WHEN sv <> 0 THEN sv ELSE dv END AS INTEGER) AS vlan_id FROM
       (SELECT id, CASE WHEN id % 3 = 0 THEN 77 ELSE 0 END AS v, CASE WHEN id % 4 = 0 THEN 88 ELSE {V.sql_vlan('ip')} END AS sv, {V.sql_vlan('src_ip')} AS dv FROM odd_ips)""",
)
def f11(spark, sf):
    own = F.when(F.col("id") % 3 == 0, F.lit(77)).otherwise(F.lit(0))
    src = F.when(F.col("id") % 4 == 0, F.lit(88)).otherwise(F.lit(0))
    vlans = N.resolve_vlans("ip", "src_ip", own, src, F.lit(None).cast("int"))
    return V.odd_ips(spark, sf).select("id", *[c.cast("int").alias(n) for n, c in vlans.items()])


@query("F12_severity", f"SELECT id, {V.case('label', L.SEVERITY, chr(39) + 'medium' + chr(39))} AS severity FROM (SELECT id, CASE WHEN id % 9 = 0 THEN 'Heartbleed' ELSE attack_type END AS label FROM pred)")
def f12(spark, sf):
    from vigilflow.functions.lookup import class_severity

    label = F.when(F.col("id") % 9 == 0, F.lit("Heartbleed")).otherwise(F.col("attack_type"))
    return V.predictions(spark, sf).select("id", class_severity(label).alias("severity"))


@query(
    "F23_map_position",
    f"""SELECT id, ([{', '.join(V.text(r[0]) for r in L.MAP_REGIONS)}])[1 + {V.sql_octet('src_ip', 1)} % 10] AS region,
       round(([{', '.join(str(r[1]) for r in L.MAP_REGIONS)}])[1 + {V.sql_octet('src_ip', 1)} % 10]::DOUBLE + ({V.sql_octet('src_ip', 3)} - 128) / 256.0::DOUBLE * 3, 6) AS lat,
       round(([{', '.join(str(r[2]) for r in L.MAP_REGIONS)}])[1 + {V.sql_octet('src_ip', 1)} % 10]::DOUBLE + ({V.sql_octet('src_ip', 4)} - 128) / 256.0::DOUBLE * 4, 6) AS lng FROM
       (SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE src_ip END AS src_ip FROM pred)""",
)
def f23(spark, sf):
    rows = V.predictions(spark, sf).select("id", F.when(F.col("id") % 10 != 0, F.col("src_ip")).alias("src_ip"))
    region, lat, lng = N.map_position("src_ip")
    return rows.select("id", region.alias("region"), F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng"))


@query(
    "F26_time_labels",
    """SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, strftime(created_at, '%Y-%m-%dT%H') AS hour, strftime(created_at, '%Y-%m-%d') AS day FROM pred""",
)
def f26(spark, sf):
    from vigilflow.operators.analytics import PERIODS

    return V.predictions(spark, sf).select(
        "id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("iso"),
        F.date_format("created_at", PERIODS["hour"]).alias("hour"), F.date_format("created_at", PERIODS["day"]).alias("day"),
    )


@query(
    "F27_switch_map",
    """SELECT event_id AS id, '10.0.0.' || event_id % 9 || ',10.0.1.' || user_id % 9 AS first_switches,
       CASE WHEN event_id % 2 = 0 THEN 'z' ELSE '10.9.9.9' END AS second_switches, 2 AS entries FROM events""",
)
def f27(spark, sf):
    text = F.concat(
        F.lit("bad:1.1.1.1, 110 : 10.0.0."), (F.col("event_id") % 9).cast("string"), F.lit("; 10.0.1."), (F.col("user_id") % 9).cast("string"),
        F.lit(" ;,noise,120:;,200:"), F.when(F.col("event_id") % 2 == 0, F.lit("10.9.9.9,200:z")).otherwise(F.lit("10.9.9.9")),
    )
    rows = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), N.parse_switch_map(text).alias("m"))
    return rows.select(
        "id", F.array_join(F.col("m")[F.lit(110)], ",").alias("first_switches"),
        F.array_join(F.col("m")[F.lit(200)], ",").alias("second_switches"), F.size("m").alias("entries"),
    )
