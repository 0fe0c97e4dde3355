"""Operators against brute force, with hot keys forced through the split paths."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilflow import lookups as L
from vigilflow.functions import devices, messages, network, severity
from vigilflow.functions.features import engineer, map_mirror_flows
from vigilflow.functions.numbers import text_to_number
from vigilflow.operators import analytics, harmonise, history, metrics
from vigilflow.functions.devices import expand_interface
from vigilflow.operators.history import page
from vigilflow.operators.joins import lookup_join
from vigilflow.operators.ranking import band, digest
from vigilflow.operators.response import suppress_repeats
from vigilflow.operators.sampling import balance_classes
from vigilflow.operators.timeline import block_steps, carry_forward, greedy_marks, marks_after, step_through, with_previous
from vigilflow.sources.netflow import wide_number


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def brute_marks(points, ttl):
    last, out = None, []
    for at, forced in sorted(points):
        if last is None or at > last + ttl or (forced and at > last):
            out.append(at)
            last = at
    return out


@pytest.mark.parametrize("seed", range(6))
def test_block_steps_chain_to_the_greedy_result(seed):
    rng = random.Random(seed)
    ttl, block = 30, 40
    times = sorted({rng.randrange(1000) for _ in range(150)})
    forced = {t: rng.random() < 0.05 * (seed % 2) for t in times}
    last, got = None, []
    for b in range(0, 1000, block):
        own = np.array([t for t in times if b <= t < b + block], dtype=np.int64)
        if not len(own):
            continue
        pushed = np.array([forced[t] for t in own])
        got += [int(own[i]) for i in marks_after(own, pushed, ttl, last)]
        limit, exits = block_steps(own, pushed, ttl, b)
        last = step_through(last, np.array(limit), np.array(exits), ttl)
        assert last == got[-1]
    assert got == brute_marks([(t, forced[t]) for t in times], ttl)


def test_greedy_marks_same_for_whole_and_split_keys(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(5000), rng.random() < 0.02, i) for i in range(1500)]
    rows += [("cold", rng.randrange(5000), False, 2000 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, at long, forced boolean, id long")
    want = set()
    for key in ("hot", "cold"):
        points = {}
        for k, at, forced, i in rows:
            if k == key:
                was = points.get(at, (False, i))
                points[at] = (was[0] or forced, min(was[1], i))
        want |= {(key, at, points[at][1]) for at in brute_marks([(a, f) for a, (f, _) in points.items()], 100)}
    for limit, block, fan_in in ((10_000, 300, 64), (100, 300, 64), (100, 37, 2), (100, 5, 3)):
        got = greedy_marks(df, ["k"], "at", 100, "id", forced="forced", whole_key_rows=limit, block_points=block, fan_in=fan_in)
        assert {tuple(r) for r in got.collect()} == want


def test_points_of_one_time_are_one_on_both_paths(spark):
    df = spark.createDataFrame([(None, 0, 1, False), (None, 50, 5, False), (None, 50, 9, True), ("x", 50, 9, True), ("x", 50, 5, False)], "k string, at long, id long, f boolean")
    for limit in (10_000, 1):
        got = greedy_marks(df, ["k"], "at", 100, "id", forced="f", whole_key_rows=limit, block_points=10, fan_in=2)
        assert sorted(map(str, map(tuple, got.collect()))) == ["('x', 50, 5)", "(None, 0, 1)", "(None, 50, 5)"]


def test_one_key_with_dense_microseconds(spark):
    """No task holds the whole key: blocks of fifty points, chained two at a time."""
    times = [t for t in range(4000) if t % 7] + list(range(20_000, 21_000))
    df = spark.createDataFrame([("hot", t, t) for t in times], "k string, at long, id long")
    for ttl in (3, 90, 2500):
        got = greedy_marks(df, ["k"], "at", ttl, "id", whole_key_rows=10, block_points=50, fan_in=2)
        assert sorted(r["at"] for r in got.collect()) == brute_marks([(t, False) for t in times], ttl)


def test_deep_page_equals_shallow_page_with_null_times(spark):
    rows = [(i, None if i < 8 else 1_700_000_000 + i * 1000) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, s long").withColumn("created_at", F.timestamp_seconds("s").cast("timestamp_ntz"))
    for offset in (0, 5, 9, 11, 12, 15, 19, 25):
        pages = [[r["id"] for r in page(df, 6, offset, shallow=s).collect()] for s in (10_000, 0)]
        assert pages[0] == pages[1]


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(10)], "id long, g string")
    out = band(df, ["g"], digest(7, "g", "id"), [2])
    assert sorted((str(r["g"]), r["band"], r["n"]) for r in out.groupBy("g", "band").agg(F.count("*").alias("n")).collect()) == [
        ("None", 0, 2), ("None", 1, 3), ("a", 0, 2), ("a", 1, 3)]
    assert balance_classes(df, "g", ["id"], 3, 7).groupBy("g").count().count() == 2


def test_distinct_keys_have_distinct_digests(spark):
    rows = [("a|", "b"), ("a", "|b"), ("a", None), (None, "a"), ("a", "\\N"), ("a|b", None), ("", "")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(digest(1, "x", "y").alias("d")).distinct().count() == len(rows)


def test_wide_counters_are_exact(spark):
    values = ["8000000000000005", "FFFFFFFFFFFFFFFF", "0000000000000000000000000000002A", "010000000000000000", "", "FF" * 16]
    df = spark.createDataFrame([(i, bytearray.fromhex(v)) for i, v in enumerate(values)], "i int, b binary")
    got = {r["i"]: r["v"] for r in df.select("i", wide_number(F.hex("b")).alias("v")).collect()}
    assert [got[i] for i in range(5)] == [2**63 + 5, 2**64 - 1, 42, 2**64, 0] and got[5] is None


def test_long_interface_names_stay_whole(spark):
    name = "Gi" + "1" * 20_000
    got = spark.createDataFrame([(name,)], "n string").select(expand_interface("n").alias("n")).first()["n"]
    assert got.endswith("1" * 20_000)


def test_ttl_example_is_strict_and_not_extended(spark):
    rows = [("10.1.1.1", "Bot", t, i) for i, t in enumerate((0, 100, 300, 301, 700))]
    df = spark.createDataFrame(rows, "src_ip string, group_pred string, s long, id long").withColumn("created_at", F.timestamp_seconds("s"))
    fired = suppress_repeats(df).select(F.unix_seconds("created_at").alias("s")).collect()
    assert sorted(r["s"] for r in fired) == [0, 301, 700]


def test_carry_and_lag_cross_blocks(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(2)}", i, rng.randrange(100) if rng.random() < 0.1 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v long").withColumn("b", F.floor(F.col("i") / 7))
    got = {r["i"]: (r["last"], r["prev"]) for r in with_previous(carry_forward(df, ["k"], ["i"], "v", "b", "last"), ["k"], ["i"], "i", "b", "prev").collect()}
    last, prev = {}, {}
    for k, i, v in rows:
        last[k] = v if v is not None else last.get(k)
        assert got[i] == (last.get(k), prev.get(k))
        prev[k] = i


def test_bands_have_exact_sizes_with_one_hot_group(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 3500, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))))
    out = band(df, ["g"], digest(7, "g", "id"), [100, 150], prefix=1, group_bound=8)
    counts = {(r["g"], r["band"]): r["n"] for r in out.groupBy("g", "band").agg(F.count("*").alias("n")).collect()}
    sizes = {r["g"]: r["n"] for r in df.groupBy("g").agg(F.count("*").alias("n")).collect()}
    for g, n in sizes.items():
        assert [counts.get((g, b), 0) for b in range(3)] == [min(n, 100), min(max(n - 100, 0), 50), max(n - 150, 0)]
    again = band(df.repartition(7), ["g"], digest(7, "g", "id"), [100, 150], prefix=3)
    assert set(again.filter("band = 0").select("id").collect()) == set(out.filter("band = 0").select("id").collect())


def test_balancing_caps_and_draws(spark):
    df = spark.range(1000).withColumn("Label", F.expr("CASE WHEN id < 900 THEN 'big' WHEN id < 903 THEN 'tiny' ELSE 'mid' END"))
    out = balance_classes(df, "Label", ["id"], largest=300, smallest=50, class_bound=3)
    assert {r["Label"]: r["count"] for r in out.groupBy("Label").count().collect()} == {"big": 300, "tiny": 50, "mid": 97}
    assert out.filter("Label = 'tiny'").select("id").distinct().count() <= 3
    assert out.filter("Label <> 'tiny'").select("id").distinct().count() == 397


def test_salted_lookup_equals_broadcast(spark):
    facts = spark.range(400).withColumn("key", F.when(F.col("id") < 300, 1).otherwise(F.col("id")).cast("long"))
    dim = spark.range(0, 350).select(F.col("id").alias("key"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    for how in ("left", "inner"):
        salted = lookup_join(facts, dim, "key", "id", how, limit=0)
        assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, lookup_join(facts, dim, "key", "id", how).collect()), key=str)


@pytest.mark.parametrize("offset", [0, 37, 400, 990, 2000])
def test_deep_pages_equal_plain_offsets(spark, offset):
    df = spark.range(1000).withColumn("created_at", F.timestamp_seconds(1_700_000_000 + F.pmod(F.xxhash64("id"), F.lit(20_000)))).select("id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))
    want = history.newest_first(df).offset(offset).limit(25).collect()
    assert history.page(df, 25, offset, shallow=0).collect() == want


def test_metrics_match_a_hand_count(spark):
    rows = [("BENIGN", "BENIGN")] * 8 + [("BENIGN", "Bot")] * 2 + [("Bot", "Bot")] * 3 + [("Bot", "BENIGN")]
    cells = metrics.confusion(spark.createDataFrame(rows, "truth string, pred string"))
    got = metrics.summary(cells).first()
    assert got["accuracy"] == pytest.approx(11 / 14) and got["false_alarm_rate"] == pytest.approx(0.2)
    assert got["auc"] == pytest.approx((0.8 + 0.75) / 2)
    none = metrics.summary(metrics.confusion(spark.createDataFrame([("Bot", "DDoS")], "truth string, pred string"))).first()
    assert none["auc"] is None and none["false_alarm_rate"] is None and none["f1_macro"] == 0.0


def test_labels_and_columns():
    assert harmonise.canonical_header([" Tot Fwd Pkts", "Label "]) == ["Total Fwd Packets", "Label"]
    header = ["Src IP", "Fwd Header Length", " Fwd Header Length", "Fwd Header Length.1", "Dst Port", "Flow ID", "Label"]
    assert harmonise.kept_positions(header) == {"Fwd Header Length": 1, "Label": 6}
    assert harmonise.find_label(["a", " LABEL "]) == " LABEL " and harmonise.find_label(["a"]) is None
    assert len(L.LABEL_MERGE) == 49 and len(L.COLUMN_RENAMES) == 50 and len(L.TARGET_CLASSES) == 11


def test_number_parsing(spark):
    texts = ["1.5", " 2 ", "1e3", "1d", "inf", "-Infinity", "NaN", "abc", "", "1e999", None, "-.5", "3."]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text_to_number("t").alias("v"))
    assert [r["v"] for r in df.collect()] == [1.5, 2.0, 1000.0, None, None, None, None, None, None, None, None, -0.5, 3.0]


def test_engineered_features_of_known_flows(spark):
    syn = spark.createDataFrame([(100.0, 100.0, 0.0)], ["SYN Flag Count", "Total Fwd Packets", "Flow Duration"])
    row = engineer(syn).first()
    assert row["syn_flag_ratio"] == pytest.approx(1.0) and row["duration_log"] == 0.0 and row["flag_diversity"] == 1.0
    empty = engineer(spark.createDataFrame([(0.0,)], ["Flow Duration"])).first()
    assert all(np.isfinite(empty[c]) for c in L.ENGINEERED_FEATURES)
    assert dict(engineer(syn).dtypes)["iat_cv"] == "float"
    bad = engineer(spark.createDataFrame([(float("nan"), float("inf"))], ["SYN Flag Count", "Total Fwd Packets"])).first()
    assert bad["flag_diversity"] == 0.0 and bad["syn_flag_ratio"] == 0.0


def test_mirror_flows_without_packets_are_dropped(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "id int, src2dst_packets double, dst2src_packets double")
    rows = map_mirror_flows(df, ("id",)).collect()
    assert [r["id"] for r in rows] == [2] and len(rows[0]) == 72


@pytest.mark.parametrize("sev,vlan,want", [
    ("info", 151, "critical"), ("medium", 30, "critical"), ("medium", 111, "high"), ("critical", 60, "critical"),
    ("info", 20, "high"), ("medium", 110, "medium"), ("low", 111, "high"), ("low", 110, "low"), ("info", 0, "info"),
])
def test_escalation(spark, sev, vlan, want):
    assert one(spark, severity.escalate(F.lit(sev), F.lit(vlan))) == want


@pytest.mark.parametrize("ip,vlan,switch", [
    ("10.11.2.5", 211, "10.99.2.1"), ("10.20.0.1", 20, "10.99.0.252"), ("10.11.9.5", 0, None), ("8.8.8.8", 0, None),
    ("10.x.1.1", 0, None), ("10.99.3.1", 399, None), ("", 0, None), ("10.60.1.1", 60, None),
])
def test_address_plan(spark, ip, vlan, switch):
    assert one(spark, network.vlan_from_ip(F.lit(ip))) == vlan
    assert one(spark, network.switch_for_ip(F.lit(ip))) == switch


@pytest.mark.parametrize("src,dst,want", [
    ("8.8.8.8", "10.0.0.1", "INBOUND"), ("10.0.0.1", "8.8.8.8", "OUTBOUND"), ("172.16.0.1", "192.168.100.9", "LATERAL"),
    ("1.1.1.1", "192.168.1.1", "UNKNOWN"), ("bad", "10.0.0.1", "INBOUND"), ("172.32.0.1", "x", "UNKNOWN"),
])
def test_directions(spark, src, dst, want):
    assert one(spark, network.flow_direction(F.lit(src), F.lit(dst))) == want


def test_texts(spark):
    assert one(spark, messages.sd_escape(F.lit('a\\b"c]'))) == 'a\\\\b\\"c\\]'
    assert one(spark, messages.syslog_priority(F.lit("critical"))) == 138
    assert one(spark, messages.syslog_tier(F.lit("%X: ospf-5-adjchg"))) == "WARNING"
    assert one(spark, devices.expand_interface(F.lit("Te1/1"))) == "TenGigabitEthernet1/1"
    plan = one(spark, devices.response_plan(F.lit("Bot"), F.lit("LATERAL"), F.lit("10.1.1.1"), F.lit(110), F.lit(None).cast("string"), F.lit("2024-01-01").cast("timestamp")))
    assert [p["action"] for p in plan] == ["BOT_ACL_FALLBACK"]


def test_v5_truncation_and_wrong_version(spark):
    from vigilflow.sources.netflow import decode

    def record(first, last):
        return struct.pack(">4s4s4sHHIIIIHHBBBBHHBBH", b"\x0a\x00\x00\x01", b"\x08\x08\x08\x08", b"\0" * 4, 0, 0, 7, 420, first, last, 1234, 443, 0, 0x12, 6, 0, 0, 0, 0, 0, 0)

    head = struct.pack(">HHIIIIBBH", 5, 3, 0, 0, 0, 0, 0, 0, 0)
    rows = [(head + record(10, 25) + record(30, 20) + record(1, 2)[:40],), (b"\x00\x08" + head[2:] + record(1, 2),), (b"\x00",), (head[:20],)]
    df = spark.createDataFrame(rows, "payload binary").select(
        F.lit("e").alias("exporter"), F.lit("2024-01-01").cast("timestamp").alias("recv_ts"), F.lit(1).cast("long").alias("packet_no"), "payload"
    )
    got = decode(df).orderBy("record_no").collect()
    assert [(r["src_ip"], r["dst_port"], r["pkts"], r["duration_ms"], r["tcp_flags"]) for r in got] == [
        ("10.0.0.1", 443, 7, 15.0, 0x12), ("10.0.0.1", 443, 7, 0.0, 0x12)
    ]


def test_csv_row_cap_and_positions(spark, tmp_path):
    from vigilflow.sources.csv_flows import read_flow_csv

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_text(" Flow Duration, Src IP,Label\n" + "".join(f"{i},1.1.1.1,Benign\n" for i in range(50)))
    (tmp_path / "two.csv").write_text("Label,Tot Fwd Pkts\nBot,5\nBot,6\n")
    (tmp_path / "empty.csv").write_text("")
    rows = read_flow_csv(spark, str(tmp_path), max_rows_per_file=10, with_position=True)
    assert sorted(rows.columns) == ["Flow Duration", "Label", "Total Fwd Packets", "file", "row_in_file"]
    first = rows.filter("`Flow Duration` is not null").collect()
    assert sorted((int(r["Flow Duration"]), r["row_in_file"]) for r in first) == [(i, i) for i in range(10)]
    assert rows.count() == 12


def test_rows_of_reports_come_in_order(spark):
    rng = random.Random(5)
    kinds = [("DoS", "high"), ("Bot", "low"), ("PortScan", "low"), ("Benign", "info")]
    rows = [
        (k, s, k != "Benign", rng.random(), f"2024-01-{rng.randint(1, 9):02d} {rng.randint(0, 23):02d}:30:00")
        for k, s in (rng.choice(kinds) for _ in range(400))
    ]
    frame = spark.createDataFrame(rows, "attack_type string, severity string, is_attack boolean, confidence double, at string")
    frame = frame.select("*", F.col("at").cast("timestamp_ntz").alias("created_at")).repartition(7)
    for period, cut in (("hour", 13), ("day", 10)):
        got = [r["period"] for r in analytics.timeline(frame, period).collect()]
        assert got == sorted({r[4][:cut].replace(" ", "T") for r in rows})
    trends = [(r["day"], -r["n"], r["attack_type"]) for r in analytics.attack_trends(frame).collect()]
    assert trends == sorted(trends) and len(trends) == len({(r[0], r[4][:10]) for r in rows if r[2]})
    top = [(-r["n"], r["attack_type"]) for r in analytics.top_attacks(frame).collect()]
    assert top == sorted(top) and -sum(n for n, _ in top) == sum(r[2] for r in rows)
    days = [(r["day"] is None, r["day"] or "", r["severity"]) for r in analytics.severity_by_day(frame).collect()]
    assert days == sorted(days) and sum(d[0] for d in days) == len({r[1] for r in rows})
