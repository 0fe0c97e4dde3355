"""Alerts, routing and responses."""

from pyspark.sql import functions as F

from vigilflow import lookups as L
from vigilflow.catalog import views as V
from vigilflow.catalog.registry import query
from vigilflow.functions import devices, messages, network, severity
from vigilflow.functions.lookup import class_group, class_severity, flow_service, normalise_label, protocol_label
from vigilflow.operators import alerts as A
from vigilflow.operators import response as R
from vigilflow.operators.history import matching, newest_first
from vigilflow.operators.routing import route

AT = "2024-01-31 01:02:03"


def _at():
    return F.lit(AT).cast("timestamp_ntz")


@query("P9_alert_filter", "SELECT id, title, status, severity FROM alerts_v WHERE status = 'open' AND severity = 'critical'")
def p9(spark, sf):
    return matching(V.alerts(spark, sf), "critical", status="open").select("id", "title", "status", "severity")


@query(
    "J1_alert_creators",
    "SELECT a.id, a.title, a.status, a.created_by, a.created_at, u.username AS creator_name FROM alerts_v a LEFT JOIN users_v u ON a.created_by = u.id",
)
def j1(spark, sf):
    rows = A.with_creator(V.alerts(spark, sf), V.users(spark, sf))
    return newest_first(rows.select("id", "title", "status", "created_by", "created_at", "creator_name"))


_UNALERTED = """FROM pred p WHERE is_attack AND id NOT IN (SELECT prediction_id FROM alerts_v WHERE prediction_id IS NOT NULL)"""


@query("J2_unalerted_attacks", f"SELECT id, attack_type, severity, confidence, src_ip, dst_ip, dst_port, created_at {_UNALERTED}")
def j2(spark, sf):
    return A.unalerted_attacks(V.predictions(spark, sf), V.alerts(spark, sf))


@query(
    "U2_set_difference",
    "SELECT id FROM pred WHERE is_attack EXCEPT SELECT prediction_id FROM alerts_v WHERE prediction_id IS NOT NULL",
)
def u2(spark, sf):
    return A.unalerted_attacks(V.predictions(spark, sf), V.alerts(spark, sf)).select("id")


@query(
    "J3_active_sessions",
    f"""SELECT o_orderkey AS token, o_custkey AS user_id, c_name AS username FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1999-06-01 00:00:00'""",
)
def j3(spark, sf):
    sessions = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("token"), F.col("o_custkey").alias("user_id"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
    )
    rows = A.active_sessions(sessions, V.users(spark, sf), F.lit("1999-06-01 00:00:00").cast("timestamp_ntz"))
    return rows.select("token", "user_id", "username")


_RAW = list(L.LABEL_MERGE) + ["Heartbleed", "DDoS SYN Flood"]


@query(
    "J4_F1_label_enrichment",
    f"""SELECT id, label, {V.case('label', L.CLASS_TO_GROUP)} AS grp, {V.case('label', L.SEVERITY, "'medium'")} AS severity FROM
       (SELECT id, {V.case('merged', L.FLOOD_MERGE, 'merged')} AS label FROM (SELECT id, {V.case('raw', L.LABEL_MERGE, 'raw')} AS merged FROM
       (SELECT event_id AS id, trim(([{', '.join(V.text(' ' + r + ' ') for r in _RAW)}])[1 + event_id % {len(_RAW)}]) AS raw FROM events)))""",
)
def j4(spark, sf):
    raw = F.array(*[F.lit(f" {r} ") for r in _RAW])[(F.col("event_id") % len(_RAW)).cast("int")]
    rows = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), normalise_label(raw).alias("label"))
    return rows.select("id", "label", class_group("label").alias("grp"), class_severity("label").alias("severity"))


@query(
    "J5_F24_service_names",
    f"""SELECT id, {V.case('dst', L.SERVICE_PORTS)} AS dst_service,
       coalesce({V.case('dst', L.SERVICE_PORTS)}, {V.case('src', L.SERVICE_PORTS)}) AS service,
       CASE WHEN proto <> 0 THEN {V.case('proto', L.PROTOCOL_NAMES, "'IP/' || proto")} END AS protocol FROM
       (SELECT event_id AS id, CAST(CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 600 END AS INTEGER) AS dst,
       CAST(user_id % 100 AS INTEGER) AS src, CAST(event_id % 20 AS INTEGER) AS proto FROM events)""",
)
def j5(spark, sf):
    rows = V.table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 600).cast("int").alias("dst"),
        (F.col("user_id") % 100).cast("int").alias("src"), (F.col("event_id") % 20).cast("int").alias("proto"),
    )
    from vigilflow.functions.lookup import service_label

    return rows.select(
        "id", service_label("dst").alias("dst_service"), flow_service("dst", "src").alias("service"),
        protocol_label("proto").alias("protocol"),
    )


_PATCHED = f"""SELECT a.id, a.title, CASE WHEN a.id % 5 = 0 THEN 'closed' WHEN a.id % 3 = 0 THEN 'resolved' ELSE a.status END AS status,
       CASE WHEN a.id % 3 = 0 THEN 'low' ELSE a.severity END AS severity, CASE WHEN a.id % 5 = 0 THEN 'late' END AS notes,
       CASE WHEN a.id % 5 = 0 THEN TIMESTAMP '2024-02-03 00:00:00' WHEN a.id % 3 = 0 THEN TIMESTAMP '2024-02-02 00:00:00' ELSE a.updated_at END AS updated_at
       FROM alerts_v a WHERE a.id % 11 <> 0"""


@query("J12_W4_alert_patches", _PATCHED)
def j12(spark, sf):
    rows = V.alerts(spark, sf)

    def patch(where: str, at: str, **values):
        cells = [F.lit(values.get(c)).cast("string").alias(c) for c in ("status", "severity", "notes")]
        return rows.filter(where).select("id", *cells, F.lit(at).cast("timestamp_ntz").alias("updated_at"))

    patches = (
        patch("id % 3 = 0", "2024-02-01 00:00:00", status="investigating", severity="low")
        .unionByName(patch("id % 3 = 0", "2024-02-02 00:00:00", status="resolved"))
        .unionByName(patch("id % 5 = 0", "2024-02-03 00:00:00", status="closed", notes="late"))
        .unionByName(rows.select((-F.col("id")).alias("id"), F.lit("x").alias("status"), F.lit("x").alias("severity"),
                                 F.lit("x").alias("notes"), F.lit("2024-02-04 00:00:00").cast("timestamp_ntz").alias("updated_at")))
    )
    out = A.apply_patches(rows, patches, rows.filter("id % 11 = 0"))
    return out.select("id", "title", "status", "severity", "notes", "updated_at")


_DESCRIPTION = f"""'Source: ' || src_ip || ' → ' || dst_ip || ':' || dst_port || ' | Confidence: ' || {V.sql_fixed('confidence * 100', 1)} || '%'"""


@query(
    "J13_F20_alert_backfill",
    f"""SELECT md5('alert|' || id) AS id, attack_type || ' detected' AS title, {_DESCRIPTION} AS description, severity, 'open' AS status,
       id AS prediction_id, 'analyst' AS created_by, TIMESTAMP '{AT}' AS created_at {_UNALERTED}""",
)
def j13(spark, sf):
    return A.backfill(V.predictions(spark, sf), V.alerts(spark, sf), "analyst", _at()).drop("updated_at")


@query(
    "F20_alert_text_blanks",
    f"""SELECT id, 'Source: ' || CASE WHEN id % 3 = 0 THEN 'unknown' ELSE src_ip END || ' → ' || CASE WHEN id % 5 = 0 THEN 'unknown' ELSE dst_ip END
       || ':' || CASE WHEN id % 2 = 0 THEN '?' ELSE CAST(dst_port AS VARCHAR) END || ' | Confidence: ' || {V.sql_fixed('confidence * 100', 1)} || '%' AS description FROM pred""",
)
def f20(spark, sf):
    src = F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.col("src_ip"))
    dst = F.when(F.col("id") % 5 != 0, F.col("dst_ip"))
    port = F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("dst_port"))
    return V.predictions(spark, sf).select("id", messages.alert_description(src, dst, port, "confidence").alias("description"))


@query(
    "S4_alert_append",
    f"SELECT count(*) AS stored, count(*) AS written {_UNALERTED}",
)
def s4(spark, sf):
    from vigilflow.session import fresh_folder
    from vigilflow.sources.sinks import append_alerts

    path = fresh_folder(spark, "alerts")
    new = A.backfill(V.predictions(spark, sf), V.alerts(spark, sf), "system", _at())
    new.limit(0).write.mode("overwrite").parquet(path)
    written = append_alerts(new, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("stored")).withColumn("written", F.lit(written).cast("long"))


@query(
    "A25_status_counts",
    """SELECT count(*) AS total, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'investigating') AS investigating,
       count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status IN ('open', 'investigating')) AS active FROM alerts_v""",
)
def a25(spark, sf):
    return A.status_counts(V.alerts(spark, sf))


@query(
    "F13_F15_escalation",
    f"""SELECT id, vlan_id, severity, {V.sql_escalate('severity', 'vlan_id')} AS final_severity,
       {V.case('vlan_id', L.VLAN_NAMES, "'VLAN' || vlan_id")} AS vlan_name FROM placed""",
)
def f13(spark, sf):
    rows = V.placed_predictions(spark, sf)
    return rows.select(
        "id", "vlan_id", "severity", severity.escalate("severity", "vlan_id").alias("final_severity"),
        network.vlan_name("vlan_id").alias("vlan_name"),
    )


@query(
    "F13_escalation_all_vlans",
    f"""SELECT id, vlan, sev, {V.sql_escalate('sev', 'vlan')} AS final_severity, {V.case('vlan', L.VLAN_NAMES, "'VLAN' || vlan")} AS vlan_name,
       {V.case('vlan', L.CONSOLE_VLAN_NAMES, f"CASE WHEN vlan BETWEEN 100 AND 499 THEN {V.case('vlan % 100', L.BUILDING_VLAN_NAMES)} || '-B' || (vlan // 100) END")} AS console_name,
       CASE WHEN vlan BETWEEN 100 AND 499 AND vlan NOT IN {V.numbers(L.CONSOLE_VLAN_NAMES)} AND vlan % 100 IN {V.numbers(L.BUILDING_VLAN_NAMES)} THEN 'B' || (vlan // 100) END AS building
       FROM (SELECT event_id AS id, CAST(event_id % 1000 AS INTEGER) AS vlan, (['info', 'medium', 'high', 'critical', 'low'])[1 + event_id % 5] AS sev FROM events)""",
)
def f13_all(spark, sf):
    names = F.array(*[F.lit(s) for s in ("info", "medium", "high", "critical", "low")])
    rows = V.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), (F.col("event_id") % 1000).cast("int").alias("vlan"),
        names[(F.col("event_id") % 5).cast("int")].alias("sev"),
    )
    shown, building = network.console_vlan("vlan")
    return rows.select(
        "id", "vlan", "sev", severity.escalate("sev", "vlan").alias("final_severity"), network.vlan_name("vlan").alias("vlan_name"),
        shown.alias("console_name"), building.alias("building"),
    )


@query(
    "F14_severity_compare",
    f"""SELECT id, coalesce({V.sql_rank('sev')} >= 2, true) AS alerts, coalesce({V.sql_rank('sev')} >= 2, false) AS responds
       FROM (SELECT event_id AS id, (['info', 'medium', 'high', 'critical', 'low'])[1 + event_id % 5] AS sev FROM events)""",
)
def f14(spark, sf):
    names = F.array(*[F.lit(s) for s in ("info", "medium", "high", "critical", "low")])
    rows = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), names[(F.col("event_id") % 5).cast("int")].alias("sev"))
    return rows.select("id", severity.reaches_or_unknown("sev", "high").alias("alerts"), severity.reaches("sev", "high").alias("responds"))


_ROUTED = f"""(SELECT *, {V.sql_escalate('severity', 'vlan_id')} AS final_severity FROM placed)
       WHERE (is_attack OR vlan_id IN {V.numbers(L.CRITICAL_VLANS)}) AND coalesce({V.sql_rank('final_severity')} >= 1, true)"""


@query("P12_alert_suppression", f"SELECT id, is_attack, vlan_id, final_severity FROM {_ROUTED}")
def p12(spark, sf):
    return route(V.placed_predictions(spark, sf)).select("id", "is_attack", "vlan_id", "final_severity")


_VLAN_NAME = V.case("vlan_id", L.VLAN_NAMES, "'VLAN' || vlan_id")


@query(
    "S13_F19_syslog_lines",
    f"""SELECT id, 136 + {V.case('final_severity', L.SYSLOG_SEVERITY, '6')} AS priority,
       CASE WHEN is_attack THEN 'IDS_ALERT' ELSE 'IDS_BENIGN' END || ' [vigilflow@0 attack_type="' || attack_type || '" confidence="' || {V.sql_fixed('confidence', 4)}
       || '" group_pred="' || group_pred || '" src_ip="' || src_ip || '" dst_ip="' || dst_ip || '" dst_port="' || dst_port || '" vlan_id="' || vlan_id
       || '" vlan_name="' || {_VLAN_NAME} || '" model_sev="' || severity || '"] VIGILFLOW-IDS [' || upper(final_severity) || '] ' || attack_type
       || ' detected on ' || {_VLAN_NAME} || ' (VLAN ' || vlan_id || ') src=' || src_ip || ' dst=' || dst_ip || ':' || dst_port
       || ' confidence=' || {V.sql_fixed('confidence * 100', 2)} || '%' AS body FROM {_ROUTED}""",
)
def s13(spark, sf):
    rows = route(V.placed_predictions(spark, sf))
    return rows.select(
        "id", messages.syslog_priority("final_severity").alias("priority"), messages.syslog_body("final_severity").alias("body")
    )


@query(
    "F19_sd_escape",
    """SELECT page_id, replace(replace(replace(html, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), ']', chr(92) || ']') AS escaped FROM pages""",
)
def f19(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", messages.sd_escape(F.col("html")).alias("escaped"))


_ELIGIBLE = f"""placed WHERE is_attack AND src_ip <> '' AND vlan_id NOT IN {V.numbers(L.MONITOR_VLANS)}
       AND coalesce({V.sql_rank('severity')} >= 2, false) AND {V.sql_switch('src_ip')} IS NOT NULL"""


@query("P13_J10_response_eligibility", f"SELECT id, src_ip, group_pred, vlan_id, {V.sql_switch('src_ip')} AS switch_ip FROM {_ELIGIBLE}")
def p13(spark, sf):
    return R.eligible(V.placed_predictions(spark, sf)).select("id", "src_ip", "group_pred", "vlan_id", "switch_ip")


def _repeat_sql(seconds: int) -> str:
    return f"""WITH RECURSIVE ev AS MATERIALIZED (SELECT id, src_ip, group_pred, created_at AS t FROM {_ELIGIBLE}),
       fires AS (SELECT src_ip, group_pred, min(t) AS t FROM ev GROUP BY 1, 2 UNION ALL
       SELECT e.src_ip, e.group_pred, min(e.t) FROM fires f JOIN ev e ON e.src_ip = f.src_ip AND e.group_pred = f.group_pred
       AND e.t > f.t + INTERVAL {seconds} SECOND GROUP BY 1, 2, f.t)
       SELECT min(e.id) AS id, f.src_ip, f.group_pred, f.t AS created_at FROM fires f JOIN ev e ON e.src_ip = f.src_ip
       AND e.group_pred = f.group_pred AND e.t = f.t GROUP BY 2, 3, 4"""


def _repeats(spark, sf, seconds, **tuning):
    rows = R.eligible(V.placed_predictions(spark, sf)).select("id", "src_ip", "group_pred", "created_at")
    return R.suppress_repeats(rows, seconds=seconds, **tuning)


@query("T5_suppression_ttl_300s", _repeat_sql(300))
def t5(spark, sf):
    return _repeats(spark, sf, 300)


@query("T5_suppression_ttl_1day", _repeat_sql(86_400))
def t5_day(spark, sf):
    return _repeats(spark, sf, 86_400)


@query("T5_suppression_split_keys", _repeat_sql(86_400))
def t5_split(spark, sf):
    return _repeats(spark, sf, 86_400, whole_key_rows=20, block_points=40, fan_in=2)


@query(
    "F32_F29_response_plan",
    f"""SELECT id, CASE WHEN group_pred = 'DDoS-family' THEN CASE WHEN flow_direction = 'LATERAL' THEN 'DDoS_ACL_BLOCK' ELSE 'EDGE_TAG' END
       WHEN group_pred = 'DoS-family' THEN 'DoS_ACL_BLOCK' WHEN group_pred = 'Brute-force' THEN 'BRUTE_ACL_BLOCK' || CASE WHEN id % 2 = 0 THEN ',BRUTE_PORT_SHUTDOWN' ELSE '' END
       WHEN id % 2 = 0 THEN upper(group_pred) || '_VLAN999_ISOLATE' ELSE upper(group_pred) || '_ACL_FALLBACK' END AS actions,
       CASE WHEN group_pred = 'DDoS-family' AND flow_direction <> 'LATERAL' THEN
       '<uid-message><version>1.0</version><type>update</type><payload><register><entry ip="' || src_ip || '"><tag><member>IDS-AUTO-BLOCK</member></tag></entry></register></payload></uid-message>'
       WHEN group_pred IN ('PortScan', 'Bot') AND id % 2 = 0 THEN
       'configure terminal;interface GigabitEthernet1/0/' || id % 48 || '; description ISOLATED-BY-IDS-20240131T010203Z-src-' || src_ip || '; switchport access vlan 999;exit;end'
       ELSE 'configure terminal;ip access-list extended ACL-IDS-BLOCK; deny ip host ' || src_ip || ' any log; permit ip any any;exit;interface vlan ' || vlan_id || '; ip access-group ACL-IDS-BLOCK in;exit;end' END AS first_commands,
       CASE WHEN group_pred = 'Brute-force' AND id % 2 = 0 THEN
       'configure terminal;interface GigabitEthernet1/0/' || id % 48 || '; description QUARANTINED-BY-IDS-20240131T010203Z-src-' || src_ip || '; shutdown;exit;end' END AS second_commands
       FROM placed WHERE is_attack""",
)
def f32(spark, sf):
    port = F.when(F.col("id") % 2 == 0, devices.expand_interface(F.concat(F.lit("Gi1/0/"), (F.col("id") % 48).cast("string"))))
    rows = R.plan(V.placed_predictions(spark, sf).filter("is_attack"), _at(), port)
    return rows.select(
        "id", F.array_join(F.transform("actions", lambda a: a["action"]), ",").alias("actions"),
        F.array_join(F.get("actions", 0)["commands"], ";").alias("first_commands"),
        F.array_join(F.get("actions", 1)["commands"], ";").alias("second_commands"),
    )


@query(
    "F29_rate_limit",
    """SELECT event_id AS id, 'configure terminal;interface Port-channel' || event_id % 8 || '; rate-limit input 100000000 12500000 25000000 conform-action transmit exceed-action drop;exit;end' AS commands FROM events""",
)
def f29(spark, sf):
    port = devices.expand_interface(F.concat(F.lit("Po"), (F.col("event_id") % 8).cast("string")))
    return V.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.array_join(devices.rate_limit(port), ";").alias("commands"))


_SHORT = ["Gi1/0/1", "Fa0/2", "Te1/1/3", "Po4", "Vl20", "Et0/5", "gi1/0/6", "Loopback0"]
_LONG = ["GigabitEthernet1/0/1", "FastEthernet0/2", "TenGigabitEthernet1/1/3", "Port-channel4", "Vlan20", "Ethernet0/5", "gi1/0/6", "Loopback0"]


@query(
    "F30_interface_names",
    f"SELECT event_id AS id, ([{', '.join(V.text(n) for n in _LONG)}])[1 + event_id % 8] AS interface FROM events",
)
def f30(spark, sf):
    short = F.array(*[F.lit(n) for n in _SHORT])[(F.col("event_id") % 8).cast("int")]
    return V.table(spark, sf, "events").select(F.col("event_id").alias("id"), devices.expand_interface(short).alias("interface"))


@query(
    "F31_mac_and_interface",
    """SELECT event_id AS id, CASE WHEN event_id % 6 <> 0 THEN printf('%04x.%04x.00aa', user_id % 65536, event_id % 65536) END AS mac,
       CASE WHEN event_id % 6 <> 0 AND event_id % 5 <> 0 THEN 'GigabitEthernet1/0/' || event_id % 48 END AS interface FROM events""",
)
def f31(spark, sf):
    mac = F.format_string("%04X.%04X.00AA", F.col("user_id") % 65536, F.col("event_id") % 65536)
    head = "Protocol  Address     Age (min)  Hardware Addr   Type   Interface\n"
    arp = F.when(F.col("event_id") % 6 == 0, F.lit(head)).otherwise(
        F.concat(F.lit(head + "Internet  10.10.1.5     0   "), mac, F.lit("  ARPA   Vlan110\n"))
    )
    trunk = F.concat(F.lit(" 110    "), F.lower(mac), F.lit("    DYNAMIC     Po1\r\n"))
    access = F.concat(F.lit(" 110    "), F.lower(mac), F.lit("    DYNAMIC     Gi1/0/"), (F.col("event_id") % 48).cast("string"), F.lit("\r\n"))
    shown = F.concat(F.lit("Vlan    Mac Address       Type        Ports\r\n"), trunk, F.when(F.col("event_id") % 5 != 0, access).otherwise(F.lit("")))
    rows = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), arp.alias("arp"), shown.alias("table"))
    rows = rows.withColumn("mac", devices.mac_from_arp("arp"))
    return rows.select("id", "mac", devices.interface_from_mac_table("table", "mac").alias("interface"))


@query(
    "F33_age_labels",
    """SELECT id, CASE WHEN age < 60 THEN age || 's ago' WHEN age < 3600 THEN age // 60 || 'm ' || age % 60 || 's ago'
       ELSE age // 3600 || 'h ' || age % 3600 // 60 || 'm ago' END AS age FROM
       (SELECT id, greatest(0, CAST(floor(epoch_us(TIMESTAMP '2024-01-30 12:00:00' - created_at) / 1000000) AS BIGINT)) AS age FROM
       (SELECT id, created_at FROM pred))""",
)
def f33(spark, sf):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return V.predictions(spark, sf).select("id", messages.age_label("created_at", now).alias("age"))


@query(
    "T9_shared_contacts",
    """SELECT dst_ip, src_ip, count(*) AS flows, count(*) FILTER (group_pred = 'Bot') > 0 AS is_bot FROM pred
       WHERE dst_ip IN (SELECT dst_ip FROM pred WHERE group_pred = 'Bot') GROUP BY 1, 2""",
)
def t9(spark, sf):
    return R.shared_contacts(V.predictions(spark, sf))
