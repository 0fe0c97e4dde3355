"""Binary capture formats, switch messages, as-of join, packets."""

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow import lookups as L
from vigilflow.catalog import views as V
from vigilflow.catalog.registry import query
from vigilflow.operators.flows import assign_flows, bidirectional_key, packets_to_flows
from vigilflow.operators.timeline import carry_forward
from vigilflow.sources import netflow as N
from vigilflow.sources.snmp import decode_traps
from vigilflow.sources.syslog import tag_messages


def _hex(value, size: int) -> Column:
    c = F.expr(value) if isinstance(value, str) else (F.lit(value) if isinstance(value, int) else value)
    return F.lpad(F.hex(c.cast("long")), size * 2, "0")


def sql_ip(number: str) -> str:
    return " || '.' || ".join(f"(({number}) // {256 ** k} % 256)" for k in (3, 2, 1, 0))


# -- v5: ten records per datagram, every seventh datagram cut short ----------

_V5 = {
    "src": "167772160 + user_id", "dst": "134744072 + event_id % 100", "pkts": "1 + event_id % 1000",
    "octets": "60 * (1 + event_id % 1000) + user_id", "first": "1000 + event_id % 100000",
    "sport": "1024 + user_id % 1000", "dport": "event_id % 1024", "flags": "event_id % 64",
    "proto": "CASE WHEN event_id % 3 = 0 THEN 17 ELSE 6 END",
}


def v5_packets(spark, sf):
    f = {k: F.expr(v) for k, v in _V5.items()}
    last = f["first"] + F.floor(F.col("value") * 10).cast("long") - 50
    record = F.concat(
        _hex(f["src"], 4), _hex(f["dst"], 4), _hex(0, 4), _hex(0, 4), _hex(f["pkts"], 4), _hex(f["octets"], 4),
        _hex(f["first"], 4), _hex(F.greatest(last, F.lit(0)), 4), _hex(f["sport"], 2), _hex(f["dport"], 2), _hex(0, 1), _hex(f["flags"], 1),
        _hex(f["proto"], 1), _hex(0, 9),
    )
    rows = V.table(spark, sf, "events").select("event_id", "ts", F.expr("event_id div 10").alias("packet_no"), record.alias("r"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "r"))), lambda e: e["r"]), "")
    packed = rows.groupBy("packet_no").agg(F.min("ts").cast("timestamp").alias("recv_ts"), F.count(F.lit(1)).alias("n"), body.alias("body"))
    payload = F.unhex(F.concat(_hex(5, 2), _hex(F.col("n"), 2), _hex(0, 16), _hex(0, 4), F.col("body")))
    size = F.length(payload) - F.when(F.col("packet_no") % 7 == 0, 20).otherwise(0)
    return packed.select(F.lit("10.99.0.1").alias("exporter"), "recv_ts", "packet_no", F.substring(payload, F.lit(1), size).alias("payload"))


_V5_SQL = f"""SELECT packet_no, record_no, {sql_ip('src')} AS src_ip, {sql_ip('dst')} AS dst_ip, sport AS src_port, dport AS dst_port, pkts, octets,
       CAST(greatest(greatest(first + ticks - 50, 0) - first, 0) AS DOUBLE) AS duration_ms, CAST(proto AS BIGINT) AS proto, flags AS tcp_flags, CAST(0 AS BIGINT) AS vlan_id FROM
       (SELECT event_id // 10 AS packet_no, CAST(row_number() OVER w - 1 AS INTEGER) AS record_no, count(*) OVER (PARTITION BY event_id // 10) AS n,
       {', '.join(f'{v} AS {k}' for k, v in _V5.items())}, CAST(floor(value * 10) AS BIGINT) AS ticks FROM events WINDOW w AS (PARTITION BY event_id // 10 ORDER BY event_id))
       WHERE NOT (packet_no % 7 = 0 AND record_no = n - 1)"""
_SHOWN = [
    "packet_no", "record_no", "src_ip", "dst_ip", "src_port", "dst_port", "CAST(pkts AS BIGINT) AS pkts",
    "CAST(octets AS BIGINT) AS octets", "duration_ms", "proto", "tcp_flags", "vlan_id",
]


@query("S7_netflow_v5", _V5_SQL)
def s7(spark, sf):
    return N.decode_v5(v5_packets(spark, sf)).selectExpr(*_SHOWN)


# -- v9 / IPFIX: sign-ups define templates, other events carry two records ---
# Layouts A and B hold the same bytes under exchanged meanings.

_LAYOUTS = [
    [(8, 4), (12, 4), (2, 4), (1, 4), (7, 2), (11, 2), (4, 1), (6, 1), (58, 2), (22, 4), (21, 4)],
    [(12, 4), (8, 4), (1, 4), (2, 4), (11, 2), (7, 2), (4, 1), (6, 1), (59, 2), (21, 4), (22, 4)],
]


def _record(extra: int) -> Column:
    parts = [
        (f"167772160 + user_id + {extra}", 4), ("3232235520 + event_id % 1000", 4), ("10 + event_id % 50", 4), ("600 + event_id % 5000", 4),
        ("1000 + user_id % 100", 2), (443, 2), (6, 1), ("event_id % 64", 1), ("event_id % 400", 2), (1000, 4), ("1000 + event_id % 777", 4),
    ]
    return F.concat(*[_hex(value, size) for value, size in parts])


def templated_packets(rows: DataFrame, ipfix: Column) -> DataFrame:
    """Datagrams of both framings from (batch or streamed) events; ``ipfix`` tells which."""
    template_id = _hex("256 + event_id % 2", 2)
    layouts = F.array(*[F.lit("".join(f"{t:04x}{n:04x}" for t, n in layout)) for layout in _LAYOUTS])
    layout = layouts[F.expr("event_id div 2 % 2").cast("int")]
    define = F.concat(F.when(ipfix, F.lit("0002")).otherwise(F.lit("0000")), _hex(8 + 4 * len(_LAYOUTS[0]), 2), template_id, _hex(len(_LAYOUTS[0]), 2), layout)
    data = F.concat(template_id, _hex(4 + 2 * 32 + 3, 2), _record(0), _record(1), F.lit("000000"))
    body = F.when(F.col("event_type") == "signup", define).otherwise(data)
    v9 = F.concat(_hex(9, 2), _hex(1, 2), _hex(0, 12), _hex(7, 4), body)
    v10 = F.concat(_hex(10, 2), _hex(F.length(body) / 2 + 16, 2), _hex(0, 8), _hex(7, 4), body)
    return rows.select(
        F.concat(F.lit("10.99.0."), (F.col("user_id") % 20).cast("string")).alias("exporter"), F.col("ts").cast("timestamp").alias("recv_ts"),
        F.col("event_id").alias("packet_no"), F.unhex(F.when(ipfix, v10).otherwise(v9)).alias("payload"),
    )


def _templated_sql(where: str = "true") -> str:
    a, b = "167772160 + user_id + r", "3232235520 + event_id % 1000"
    return f"""SELECT event_id AS packet_no, CAST(r AS INTEGER) AS record_no, CASE WHEN lay = 0 THEN {sql_ip(a)} ELSE {sql_ip(b)} END AS src_ip,
       CASE WHEN lay = 0 THEN {sql_ip(b)} ELSE {sql_ip(a)} END AS dst_ip, CASE WHEN lay = 0 THEN 1000 + user_id % 100 ELSE 443 END AS src_port,
       CASE WHEN lay = 0 THEN 443 ELSE 1000 + user_id % 100 END AS dst_port, CASE WHEN lay = 0 THEN 10 + event_id % 50 ELSE 600 + event_id % 5000 END AS pkts,
       CASE WHEN lay = 0 THEN 600 + event_id % 5000 ELSE 10 + event_id % 50 END AS octets,
       CAST(CASE WHEN lay = 0 THEN event_id % 777 ELSE -(event_id % 777) END AS DOUBLE) AS duration_ms, CAST(6 AS BIGINT) AS proto, event_id % 64 AS tcp_flags, event_id % 400 AS vlan_id
       FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id // 2 % 2 END IGNORE NULLS)
       OVER (PARTITION BY user_id % 20, event_id % 2 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS lay FROM events), (VALUES (0), (1)) k(r)
       WHERE event_type <> 'signup' AND lay IS NOT NULL AND {where}"""


@query("S8_J6_netflow_v9", _templated_sql())
def s8(spark, sf):
    return N.decode_templated(templated_packets(V.table(spark, sf, "events"), F.lit(False))).selectExpr(*_SHOWN)


@query("S9_ipfix", _templated_sql())
def s9(spark, sf):
    return N.decode_templated(templated_packets(V.table(spark, sf, "events"), F.lit(True))).selectExpr(*_SHOWN)


@query("S10_version_dispatch", f"SELECT * FROM ({_V5_SQL}) UNION ALL SELECT * FROM ({_templated_sql()})")
def s10(spark, sf):
    both = templated_packets(V.table(spark, sf, "events"), F.col("event_id") % 3 == 0)
    other = both.withColumn("payload", F.concat(F.unhex(F.lit("0007")), F.col("payload")))
    return N.decode(v5_packets(spark, sf).unionByName(both).unionByName(other)).selectExpr(*_SHOWN)


# Counters of 2^63 and more, and flags and protocol declared four bytes wide, with values past 2^31.
_WIDE = [(8, 4), (12, 4), (2, 8), (1, 12), (7, 2), (11, 2), (4, 4), (6, 4), (58, 2), (22, 4), (21, 4)]


def wide_packets(spark, sf):
    layout = "".join(f"{t:04x}{n:04x}" for t, n in _WIDE)
    size = sum(n for _, n in _WIDE)
    record = F.concat(
        _hex("167772160 + user_id", 4), _hex(3232235520, 4), F.lit("80000000"), _hex("event_id", 4), F.lit("000000FF"), _hex("event_id", 8),
        _hex(1000, 2), _hex(443, 2), F.lit("80000000"), F.lit("F0000012"), _hex("event_id % 400", 2), _hex(1000, 4), _hex("1000 + event_id % 777", 4),
    )
    define = f"0000{8 + 4 * len(_WIDE):04x}0100{len(_WIDE):04x}{layout}"
    data = F.concat(F.lit(f"0100{4 + size:04x}"), record)
    payload = F.concat(_hex(9, 2), _hex(2, 2), _hex(0, 12), _hex(7, 4), F.lit(define), data)
    return V.table(spark, sf, "events").select(
        F.lit("10.99.0.1").alias("exporter"), F.col("ts").cast("timestamp").alias("recv_ts"), F.col("event_id").alias("packet_no"), F.unhex(payload).alias("payload"),
    )


@query(
    "S8_F7_wide_counters",
    """SELECT event_id AS packet_no, CAST(9223372036854775808::HUGEINT + event_id AS VARCHAR) AS pkts,
       CAST(255::HUGEINT * 18446744073709551616::HUGEINT + event_id AS VARCHAR) AS octets, 2147483648 AS proto, 4026531858 AS tcp_flags,
       9223372036854775808.0::DOUBLE AS "Total Fwd Packets", 1.0::DOUBLE AS "SYN Flag Count", 0.0::DOUBLE AS "FIN Flag Count" FROM events""",
)
def s8_wide(spark, sf):
    records = N.decode_templated(wide_packets(spark, sf))
    shown = [F.col("pkts").cast("string").alias("wide_pkts"), F.col("octets").cast("string").alias("wide_octets")]
    rows = N.flow_envelopes(records.select("*", *shown), ("packet_no", "wide_pkts", "wide_octets", "proto", "tcp_flags"))
    # Ids stay far below the spacing of doubles near 2^63.
    total = (F.floor(F.col("`Total Fwd Packets`") / 2**40) * F.lit(2.0**40)).alias("Total Fwd Packets")
    return rows.select(
        "packet_no", F.col("wide_pkts").alias("pkts"), F.col("wide_octets").alias("octets"), "proto", "tcp_flags", total, "`SYN Flag Count`", "`FIN Flag Count`",
    )


@query(
    "S7_F11_flow_envelopes",
    f"""SELECT packet_no, src_ip, dst_ip, CAST({V.sql_vlan('src_ip')} AS BIGINT) AS src_vlan, {V.sql_direction('src_ip', 'dst_ip')} AS flow_direction,
       CAST(pkts AS DOUBLE) AS "Total Fwd Packets", round(octets / pkts, 6) AS "Packet Length Mean" FROM ({_V5_SQL})""",
)
def envelopes(spark, sf):
    rows = N.flow_envelopes(N.decode_v5(v5_packets(spark, sf)), ("packet_no",))
    return rows.select(
        "packet_no", "src_ip", "dst_ip", F.col("src_vlan").cast("long").alias("src_vlan"), "flow_direction", "`Total Fwd Packets`",
        F.round(F.col("`Packet Length Mean`"), 6).alias("Packet Length Mean"),
    )


# -- traps -------------------------------------------------------------------


def _ber(tag: int, *parts: bytes) -> bytes:
    value = b"".join(parts)
    size = len(value)
    return bytes([tag, size]) + value if size < 128 else bytes([tag, 0x82, size >> 8, size & 255]) + value


def _oid(text: str) -> bytes:
    numbers = [int(n) for n in text.split(".")]
    out = bytes([numbers[0] * 40 + numbers[1]])
    for n in numbers[2:]:
        chunk = [n & 127]
        while n := n >> 7:
            chunk.append(n & 127 | 128)
        out += bytes(reversed(chunk))
    return _ber(0x06, out)


TRAPS = [*L.TRAP_NAMES, "1.3.6.1.4.1.9.9.999.0.7"]
COMMUNITY = b"000000"


def _v2_body(oid: str) -> bytes:
    number = _ber(0x02, b"\x01")
    uptime = _ber(0x30, _oid("1.3.6.1.2.1.1.3.0"), _ber(0x43, b"\x05"))
    trap = _ber(0x30, _oid(L.TRAP_OID_MARK + ".0"), _oid(oid))
    return _ber(0xA6, number, number, number, _ber(0x30, uptime, trap))


def trap_bytes(kind: int, oid: str) -> bytes:
    """Kinds: v1, v2c, plain v3, encrypted v3, malformed."""
    if kind == 0:
        pdu = _ber(0xA4, _oid(oid), _ber(0x40, b"\x0a\x00\x00\x01"))
        return _ber(0x30, _ber(0x02, b"\x00"), _ber(0x04, COMMUNITY), pdu)
    if kind == 1:
        return _ber(0x30, _ber(0x02, b"\x01"), _ber(0x04, COMMUNITY), _v2_body(oid))
    flags = b"\x03" if kind == 3 else b"\x00"
    header = _ber(0x30, _ber(0x02, b"\x01"), _ber(0x02, b"\x05\xdc"), _ber(0x04, flags), _ber(0x02, b"\x03"))
    scoped = _ber(0x04, b"secret") if kind == 3 else _ber(0x30, _ber(0x04, b"eng"), _ber(0x04, b""), _v2_body(oid))
    whole = _ber(0x30, _ber(0x02, b"\x03"), header, _ber(0x04, b"usm"), scoped)
    return whole[:-1] if kind == 4 else whole


def trap_packets(spark, sf):
    """One trap per event; the community of v1 and v2c is the user's number."""
    options = F.array(*[F.lit(trap_bytes(kind, oid).hex()) for kind in range(5) for oid in TRAPS])
    slot = F.col("event_id") % 5 * len(TRAPS) + F.expr("event_id div 5") % len(TRAPS)
    own = F.hex(F.encode(F.lpad(F.col("user_id").cast("string"), 6, "0"), "UTF-8"))
    text = F.when(F.col("event_id") % 5 < 2, F.replace(options[slot.cast("int")], F.lit(COMMUNITY.hex()), own)).otherwise(options[slot.cast("int")])
    return V.table(spark, sf, "events").select(
        F.col("event_id").alias("trap_no"), F.concat(F.lit("10.99.1."), (F.col("user_id") % 250).cast("string")).alias("switch"),
        F.unhex(text).alias("payload"),
    )


@query(
    "S11_F18_snmp_traps",
    f"""SELECT trap_no, switch, version, community, trap_oid, kind = 3 AS encrypted, CASE WHEN kind <> 3 THEN {V.case('trap_oid', L.TRAP_NAMES, 'trap_oid')} END AS label,
       CASE WHEN kind <> 3 AND {V.case('trap_oid', L.TRAP_NAMES, 'trap_oid')} IN ('authenticationFailure', 'ciscoPortSecurityViolation', 'linkDown') THEN 'WARNING' ELSE 'INFO' END AS tier
       FROM (SELECT event_id AS trap_no, '10.99.1.' || user_id % 250 AS switch, event_id % 5 AS kind, CAST(least(event_id % 5 + 1, 3) AS INTEGER) AS version,
       CASE WHEN event_id % 5 < 2 THEN lpad(CAST(user_id AS VARCHAR), 6, '0') END AS community,
       CASE WHEN event_id % 5 <> 3 THEN ([{', '.join(V.text(t) for t in TRAPS)}])[1 + event_id // 5 % {len(TRAPS)}] END AS trap_oid FROM events) WHERE kind < 4""",
)
def s11(spark, sf):
    return decode_traps(trap_packets(spark, sf))


def _contains(words) -> str:
    return " OR ".join(f"contains(upper(msg), {V.text(w)})" for w in words)


@query(
    "S12_F17_syslog_tiers",
    f"SELECT doc_id, CASE WHEN {_contains(L.SYSLOG_WARNING_IDS)} THEN 'WARNING' WHEN {_contains(L.SYSLOG_INFO_IDS)} THEN 'INFO' ELSE 'DEBUG' END AS tier FROM messages_v",
)
def s12(spark, sf):
    return tag_messages(V.messages(spark, sf)).select("doc_id", "tier")


@query(
    "J6_latest_before",
    """SELECT event_id AS id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
       OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS template FROM events""",
)
def j6(spark, sf):
    rows = V.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "user_id", "ts", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("t"),
        F.date_trunc("DAY", "ts").alias("day"),
    )
    return carry_forward(rows, ["user_id"], ["ts", "id"], "t", "day", "template").select("id", "user_id", "template")


# -- packets to flows ----------------------------------------------------------

IDLE, ACTIVE = 86_400, 259_200
_PACKET = {
    "packet_id": "event_id", "ts": "ts",
    "src_ip": "CASE WHEN event_id % 3 = 0 THEN '10.30.0.9' ELSE concat('10.10.1.', user_id % 250) END",
    "src_port": "CAST(CASE WHEN event_id % 3 = 0 THEN 443 ELSE 1000 + user_id END AS INTEGER)",
    "dst_ip": "CASE WHEN event_id % 3 = 0 THEN concat('10.10.1.', user_id % 250) ELSE '10.30.0.9' END",
    "dst_port": "CAST(CASE WHEN event_id % 3 = 0 THEN 1000 + user_id ELSE 443 END AS INTEGER)",
    "protocol": "6", "bytes": "CAST(floor(value * 10) AS BIGINT)", "syn": "CAST(event_id % 2 AS INTEGER)",
}
_WALK = f"""walk AS (SELECT u, rn, ts, ts AS flow_start FROM ordered WHERE rn = 1 UNION ALL
       SELECT o.u, o.rn, o.ts, CASE WHEN o.ts - w.ts > INTERVAL {IDLE} SECOND OR o.ts > w.flow_start + INTERVAL {ACTIVE} SECOND THEN o.ts ELSE w.flow_start END
       FROM walk w JOIN ordered o ON o.u = w.u AND o.rn = w.rn + 1)"""
_ASSIGNED = f"""ordered AS (SELECT *, user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, packet_id) AS rn FROM
       (SELECT user_id, {', '.join(f'{v} AS {k}' for k, v in _PACKET.items())} FROM events)), {_WALK}"""


def packets(spark, sf):
    return V.table(spark, sf, "events").select(*[F.expr(v).alias(k) for k, v in _PACKET.items()])


@query("T7_flow_starts", f"WITH RECURSIVE {_ASSIGNED} SELECT o.packet_id, epoch_us(w.flow_start) AS flow_start FROM walk w JOIN ordered o USING (u, rn)")
def t7_starts(spark, sf):
    rows = assign_flows(bidirectional_key(packets(spark, sf)), idle=IDLE, active=ACTIVE)
    return rows.select("packet_id", "flow_start")


_SIDE = "src_ip = first_ip AND src_port = first_port"


def _stat(name: str, where: str, gap: str) -> str:
    return f"""count(*) FILTER ({where}) AS {name}_packets, CAST(coalesce(sum(bytes) FILTER ({where}), 0) AS BIGINT) AS {name}_bytes,
       round(coalesce(stddev_samp(bytes) FILTER ({where}), 0), 4) AS {name}_stddev_ps, round(coalesce(avg({gap}) FILTER ({where}), 0) + 1e-7, 6) AS {name}_mean_piat_ms,
       coalesce((epoch_us(max(ts) FILTER ({where})) - epoch_us(min(ts) FILTER ({where}))) / 1000.0::DOUBLE, 0) AS {name}_duration_ms,
       CAST(coalesce(sum(syn) FILTER ({where}), 0) AS BIGINT) AS {name}_syn_packets"""


@query(
    "T7_packets_to_flows",
    f"""WITH RECURSIVE {_ASSIGNED}, p AS (SELECT o.*, w.flow_start, first_value(src_ip) OVER f AS first_ip, first_value(src_port) OVER f AS first_port,
       epoch_us(o.ts - lag(o.ts) OVER f) / 1000.0::DOUBLE AS gap, epoch_us(o.ts - lag(o.ts) OVER (PARTITION BY w.u, w.flow_start, src_ip ORDER BY o.rn)) / 1000.0::DOUBLE AS own_gap
       FROM walk w JOIN ordered o USING (u, rn) WINDOW f AS (PARTITION BY w.u, w.flow_start ORDER BY o.rn))
       SELECT u AS user_id, epoch_us(flow_start) AS flow_start, first_ip AS src_ip, {_stat('bidirectional', 'true', 'gap')}, {_stat('src2dst', _SIDE, 'own_gap')},
       {_stat('dst2src', f'NOT ({_SIDE})', 'own_gap')} FROM p GROUP BY 1, 2, 3""",
)
def t7(spark, sf):
    return shown_flows(packets_to_flows(packets(spark, sf), idle=IDLE, active=ACTIVE))


def shown_flows(rows):
    """The columns of flow records that the checking SQL has."""
    user = F.greatest("src_port", "dst_port") - 1000
    shown = []
    for side in ("bidirectional", "src2dst", "dst2src"):
        shown += [f"{side}_packets", F.col(f"{side}_bytes").cast("long").alias(f"{side}_bytes")]
        shown.append(F.round(f"{side}_stddev_ps", 4).alias(f"{side}_stddev_ps"))
        # The tiny shift keeps exact ties from rounding apart in the two engines.
        shown.append(F.round(F.col(f"{side}_mean_piat_ms") + 1e-7, 6).alias(f"{side}_mean_piat_ms"))
        shown += [f"{side}_duration_ms", F.col(f"{side}_syn_packets").cast("long").alias(f"{side}_syn_packets")]
    return rows.select(user.cast("long").alias("user_id"), "flow_start", "src_ip", *shown)


# The same conversations without ports (ICMP): the key is then the pair of addresses.


@query(
    "T7_flow_starts_no_ports",
    f"""WITH RECURSIVE ordered AS (SELECT *, user_id % 250 AS u, row_number() OVER (PARTITION BY user_id % 250 ORDER BY ts, packet_id) AS rn FROM
       (SELECT user_id, {', '.join(f'{v} AS {k}' for k, v in _PACKET.items())} FROM events)), {_WALK}
       SELECT o.packet_id, epoch_us(w.flow_start) AS flow_start FROM walk w JOIN ordered o USING (u, rn)""",
)
def t7_no_ports(spark, sf):
    rows = packets(spark, sf).withColumns({"src_port": F.lit(None).cast("int"), "dst_port": F.lit(None).cast("int"), "protocol": F.lit(1)})
    return assign_flows(bidirectional_key(rows), idle=IDLE, active=ACTIVE).select("packet_id", "flow_start")
