"""Flow, prediction and message tables derived from the given tables.

The test tables hold no network data, so the queries run on these derivations.
Column formulas that read the same in Spark and in the checking SQL are kept
once, as text; everything under test is written separately on both sides.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilflow import lookups as L
from vigilflow.operators.history import enrich_predictions

AS_OF = "2024-01-31 00:00:00"

PREDICTION = {
    "id": "event_id",
    "created_at": "ts",
    "attack_type": """CASE WHEN event_type IN ('view','signup') THEN 'BENIGN'
       WHEN event_type = 'click' THEN CASE event_id % 3 WHEN 0 THEN 'DDoS' WHEN 1 THEN 'DDoS Amplification' ELSE 'DDoS Volumetric' END
       WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'DoS Hulk' WHEN 1 THEN 'DoS GoldenEye' ELSE 'DoS Slow' END
       ELSE CASE event_id % 4 WHEN 0 THEN 'FTP-Patator' WHEN 1 THEN 'SSH-Patator' WHEN 2 THEN 'PortScan' ELSE 'Bot' END END""",
    "confidence": "CASE WHEN value > 100 THEN 1.0E0 ELSE value / 100.0E0 END",
    "src_ip": """CASE user_id % 5 WHEN 0 THEN concat('203.0.113.', user_id % 250)
       WHEN 1 THEN concat('10.20.0.', user_id % 250)
       WHEN 2 THEN concat('10.10.', 1 + user_id % 4, '.', user_id % 250)
       WHEN 3 THEN concat('10.51.', 1 + user_id % 4, '.', user_id % 250)
       ELSE concat('10.13.', 1 + user_id % 4, '.', user_id % 250) END""",
    "dst_ip": "CASE event_id % 3 WHEN 0 THEN '10.30.0.9' WHEN 1 THEN '8.8.8.8' ELSE '10.12.2.7' END",
    "dst_port": "CASE event_id % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 21 ELSE 53 END",
    "inference_ms": "value / 10.0E0",
    "user_id": "user_id",
}
FLOW = {
    "flow_key": "l_orderkey", "flow_line": "l_linenumber", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey",
    "Flow Duration": "l_extendedprice * 1000.0E0",
    "Total Fwd Packets": "l_quantity",
    "Total Backward Packets": "CASE WHEN l_returnflag = 'R' THEN 0.0E0 ELSE floor(l_quantity / 2.0E0) END",
    "Total Length of Fwd Packets": "l_quantity * 60.0E0",
    "Total Length of Bwd Packets": "CASE WHEN l_returnflag = 'R' THEN 0.0E0 ELSE l_quantity * 45.0E0 END",
    "SYN Flag Count": "CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0.0E0 END",
    "ACK Flag Count": "l_discount * 100.0E0",
    "PSH Flag Count": "l_tax * 100.0E0",
}
FLOW_KEY = ["flow_key", "flow_line", "l_partkey", "l_suppkey"]
FLOW_FEATURES = [c for c in FLOW if c not in FLOW_KEY]
FLOW_CLASSES = sorted(L.CLASS_TO_GROUP)
# One third of all flows are benign; the other classes share the rest.
FLOW_LABEL = "CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 + l_suppkey % 10 END"
ODD_IP = """CASE event_id % 13 WHEN 0 THEN concat('172.20.', user_id % 250, '.1') WHEN 1 THEN '172.32.0.1'
       WHEN 2 THEN concat('192.168.100.', user_id % 250) WHEN 3 THEN '192.168.1.5' WHEN 4 THEN 'abc' WHEN 5 THEN ''
       WHEN 6 THEN '10.5' WHEN 7 THEN '300.1.1.1' WHEN 8 THEN concat('10.21.0.', user_id % 250)
       WHEN 9 THEN concat('10.99.', user_id % 7, '.1') WHEN 10 THEN concat('10.10.', user_id % 9, '.4')
       WHEN 11 THEN '01.2.3.4' ELSE NULL END"""
ALERT_STATUS = "CASE id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'investigating' WHEN 2 THEN 'resolved' ELSE 'closed' END"
MESSAGE_IDS = [
    "%PORT_SECURITY-2-psecure_violation: ", "%SEC-6-IPACCESSLOGP: ", "%SEC-6-ipaccesslogdp: ", "%SSH-4-SSH_FAILED: ",
    "%SEC_LOGIN-4-LOGIN_FAILED: ", "%DHCP_SNOOPING-5-DHCP_SNOOPING_ERRMSG: ", "%OSPF-5-ADJCHG: ", "%ROUTING-5-ospf_adjchg: ",
    "%LINK-3-UPDOWN: ", "%SYS-5-changed: ", "%SYS-6-LOGOUT: ",
]


def text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def case(column: str, table: dict, default: str = "NULL") -> str:
    """SQL CASE over a constant table."""

    def literal(v) -> str:
        return text(v) if isinstance(v, str) else str(v)

    arms = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


def numbers(values) -> str:
    return "(" + ", ".join(str(v) for v in values) + ")"


def sql_severity(column: str) -> str:
    return case(column, L.SEVERITY, "'medium'")


def sql_group(column: str) -> str:
    return case(column, L.CLASS_TO_GROUP)


def sql_octet(ip: str, i: int) -> str:
    return f"TRY_CAST(split_part({ip}, '.', {i}) AS INTEGER)"


def sql_valid_ip(ip: str) -> str:
    byte = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return f"coalesce(regexp_full_match({ip}, '{byte}([.]{byte}){{3}}'), false)"


def sql_internal(ip: str) -> str:
    o = [sql_octet(ip, i) for i in range(1, 5)]
    return (
        f"({sql_valid_ip(ip)} AND coalesce({o[0]} = 10 OR ({o[0]} = 192 AND {o[1]} = 168 AND {o[2]} = 100)"
        f" OR ({o[0]} = 172 AND {o[1]} BETWEEN 16 AND 31), false))"
    )


def sql_direction(src: str, dst: str) -> str:
    s, d = sql_internal(src), sql_internal(dst)
    return (
        f"CASE WHEN NOT {s} AND {d} THEN 'INBOUND' WHEN {s} AND NOT {d} THEN 'OUTBOUND'"
        f" WHEN {s} AND {d} THEN 'LATERAL' ELSE 'UNKNOWN' END"
    )


def _sql_site(ip: str) -> str:
    return f"coalesce(len(string_split({ip}, '.')) = 4 AND split_part({ip}, '.', 1) = '10', false)"


def sql_vlan(ip: str) -> str:
    base, building = sql_octet(ip, 2), sql_octet(ip, 3)
    return (
        f"CASE WHEN {_sql_site(ip)} AND {building} IS NOT NULL AND {base} IN {numbers(L.BUILDING_VLAN_NAMES)}"
        f" AND {building} BETWEEN 1 AND 4 THEN {building} * 100 + {base}"
        f" WHEN {_sql_site(ip)} AND {building} IS NOT NULL AND {base} IN {numbers(L.GLOBAL_VLAN_BASES)} THEN {base} ELSE 0 END"
    )


def sql_building(ip: str) -> str:
    base, building = sql_octet(ip, 2), sql_octet(ip, 3)
    return (
        f"CASE WHEN {_sql_site(ip)} AND {base} IN {numbers(L.BUILDING_VLAN_NAMES)}"
        f" AND {building} BETWEEN 1 AND 4 THEN {building} ELSE 0 END"
    )


def sql_switch(ip: str) -> str:
    base, building = sql_octet(ip, 2), sql_octet(ip, 3)
    return (
        f"CASE WHEN {_sql_site(ip)} AND {base} IN {numbers(L.ACCESS_SWITCH_BASES)} AND {building} BETWEEN 1 AND 4"
        f" THEN '10.99.' || {building} || '.1' WHEN {_sql_site(ip)} AND {building} IS NOT NULL"
        f" AND {base} IN {numbers(L.CORE_SWITCH_BASES)} THEN '{L.CORE_SWITCH_IP}' END"
    )


def sql_escalate(severity: str, vlan: str) -> str:
    return (
        f"CASE WHEN {vlan} IN {numbers(L.CRITICAL_VLANS)} THEN 'critical' WHEN {vlan} IN {numbers(L.HIGH_VLANS)}"
        f" THEN CASE WHEN {severity} = 'critical' THEN 'critical' ELSE 'high' END ELSE {severity} END"
    )


def sql_rank(severity: str) -> str:
    return case(severity, {name: i for i, name in enumerate(L.SEVERITY_ORDER)})


def sql_fixed(value: str, digits: int) -> str:
    """Decimal text with fixed digits, rounded half-up on the shortest decimal form."""
    return f"CAST(CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DECIMAL(18, {digits})) AS VARCHAR)"


def _projection(columns: dict[str, str]) -> str:
    return ", ".join(f'{sql} AS "{name}"' for name, sql in columns.items())


# Checking-side definitions; a view may use the ones above it.
SQL_VIEWS = {
    "predictions_v": f"SELECT {_projection(PREDICTION)} FROM events",
    "pred": f"""SELECT *, attack_type <> 'BENIGN' AS is_attack, {sql_severity('attack_type')} AS severity,
       {sql_group('attack_type')} AS group_pred FROM predictions_v""",
    "placed": f"""SELECT *, {sql_vlan('src_ip')} AS src_vlan, {sql_vlan('dst_ip')} AS dst_vlan,
       CASE WHEN {sql_vlan('src_ip')} <> 0 THEN {sql_vlan('src_ip')} ELSE {sql_vlan('dst_ip')} END AS vlan_id,
       {sql_direction('src_ip', 'dst_ip')} AS flow_direction FROM pred""",
    "flows_v": f"SELECT {_projection(FLOW)} FROM lineitem",
    "labelled_flows": f"""SELECT {_projection(FLOW)}, ([{', '.join(text(c) for c in FLOW_CLASSES)}])[1 + {FLOW_LABEL}] AS "Label",
       l_suppkey % 10 AS file_id FROM lineitem""",
    "alerts_v": f"""SELECT id + 1000000 AS id, attack_type || ' detected' AS title, severity, {ALERT_STATUS} AS status,
       CASE WHEN id % 14 = 0 THEN NULL ELSE id END AS prediction_id, CASE WHEN id % 3 = 0 THEN 0 ELSE id % 2000 END AS created_by,
       created_at, created_at AS updated_at, CAST(NULL AS VARCHAR) AS notes FROM pred WHERE id % 7 = 0 AND is_attack""",
    "users_v": "SELECT c_custkey AS id, c_name AS username FROM customer",
    "labelled_v": f"""SELECT id, created_at, attack_type AS truth, CASE WHEN id % 10 = 0
       THEN ([{', '.join(text(c) for c in FLOW_CLASSES)}])[1 + list_position([{', '.join(text(c) for c in FLOW_CLASSES)}], attack_type) % 11]
       ELSE attack_type END AS pred, CASE id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'unseen' END AS phase FROM pred""",
    "odd_ips": f"SELECT event_id AS id, {ODD_IP} AS ip, {PREDICTION['src_ip']} AS src_ip FROM events",
    "messages_v": "SELECT doc_id, concat(CASE doc_id % 11 "
    + " ".join(f"WHEN {i} THEN {text(m)}" for i, m in enumerate(MESSAGE_IDS))
    + " END, text) AS msg FROM documents",
}


def with_views(sql: str) -> str:
    """Prefix the CTEs of all derived views a query names, in order."""

    def named(body: str) -> set[str]:
        return {v for v in SQL_VIEWS if re.search(rf"\b{v}\b", body)}

    todo, wanted = [sql], set()
    while todo:
        for view in named(todo.pop()) - wanted:
            wanted.add(view)
            todo.append(SQL_VIEWS[view])
    ctes = [f"{v} AS ({SQL_VIEWS[v]})" for v in SQL_VIEWS if v in wanted]
    if not ctes:
        return sql
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body[len('WITH '):]}"
    return f"WITH {', '.join(ctes)} {body}"


# Spark-side definitions.


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scored events with attack flag, severity and group."""
    return enrich_predictions(_select(table(spark, sf, "events"), PREDICTION))


def placed_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with VLANs and direction from their addresses."""
    from vigilflow.functions.network import flow_direction, resolve_vlans

    none = F.lit(None).cast("int")
    return predictions(spark, sf).withColumns(
        {
            **resolve_vlans("src_ip", "dst_ip", none, none, none),
            "flow_direction": flow_direction("src_ip", "dst_ip"),
        }
    )


def flows(spark: SparkSession, sf: str) -> DataFrame:
    return _select(table(spark, sf, "lineitem"), FLOW)


def labelled_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flows with a class (one third benign) and a source file."""
    names = F.array(*[F.lit(c) for c in FLOW_CLASSES])
    return table(spark, sf, "lineitem").select(
        *[F.expr(sql).alias(name) for name, sql in FLOW.items()],
        names[F.expr(FLOW_LABEL).cast("int")].alias("Label"),
        (F.col("l_suppkey") % 10).alias("file_id"),
    )


def learnable_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flows whose class follows from their features."""
    label = """CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_returnflag = 'R' THEN 'DDoS' WHEN l_discount > 0.05 THEN 'DDoS Amplification' ELSE 'DDoS Volumetric' END
       WHEN l_tax > 0.06 THEN 'PortScan'
       WHEN l_returnflag = 'R' THEN CASE WHEN l_quantity > 35 THEN 'DoS Hulk' WHEN l_quantity > 15 THEN 'DoS GoldenEye' ELSE 'DoS Slow' END
       WHEN l_discount > 0.07 THEN CASE WHEN l_quantity > 25 THEN 'FTP-Patator' ELSE 'SSH-Patator' END
       WHEN l_extendedprice > 60000 THEN 'Bot' ELSE 'BENIGN' END"""
    return table(spark, sf, "lineitem").select(
        *[F.expr(sql).alias(name) for name, sql in FLOW.items()], F.expr(label).alias("Label")
    )


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf).filter("id % 7 = 0 AND is_attack")
    return rows.select(
        (F.col("id") + 1_000_000).alias("id"),
        F.concat("attack_type", F.lit(" detected")).alias("title"),
        "severity",
        F.expr(ALERT_STATUS).alias("status"),
        F.when(F.col("id") % 14 != 0, F.col("id")).alias("prediction_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 2000).cast("long").alias("created_by"),
        "created_at",
        F.col("created_at").alias("updated_at"),
        F.lit(None).cast("string").alias("notes"),
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with a truth; every tenth is taken for the next class."""
    following = {c: FLOW_CLASSES[(i + 1) % len(FLOW_CLASSES)] for i, c in enumerate(FLOW_CLASSES)}
    from vigilflow.functions.lookup import lookup

    return predictions(spark, sf).select(
        "id", "created_at", F.col("attack_type").alias("truth"),
        F.when(F.col("id") % 10 == 0, lookup("attack_type", following)).otherwise(F.col("attack_type")).alias("pred"),
        F.expr("CASE id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'unseen' END").alias("phase"),
    )


def odd_ips(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.expr(ODD_IP).alias("ip"), F.expr(PREDICTION["src_ip"]).alias("src_ip")
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    heads = F.array(*[F.lit(m) for m in MESSAGE_IDS])
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(heads[(F.col("doc_id") % len(MESSAGE_IDS)).cast("int")], F.col("text")).alias("msg")
    )
