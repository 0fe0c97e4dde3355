"""Keyed state across micro-batches: late truths, templates, flows."""

import uuid

from pyspark.sql import functions as F

from vigilflow.session import ROCKSDB, checkpoint_root
from vigilflow.streaming import flows, live, state


def in_batches(spark, batches, schema, run):
    """Rows of each micro-batch as one file; ``run`` starts the stream over what is new and gives the table so far."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    root = f"{checkpoint_root(spark)}/state-{uuid.uuid4().hex}"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/input")
        yield run(live.read_stream(spark, f"{root}/input", spark.read.parquet(f"{root}/input").schema, files_per_batch=1), root)


def test_truths_meet_their_ids_by_bucket(spark):
    schema = "id long, attack_type string, ground_truth string, at double"
    hour, big = 3600.0, 2**60 + 1
    batches = [
        [(i, "Bot", None, 1e9 + i) for i in range(300)] + [(big, "DDoS", "DDoS", 1e9), (7, "Other", "x", 1e9 + 100), (7, "Other", "y", 1e9 + 50), (7, "Other", None, 1e9 + 60)]
        + [(None, "None", None, 1e9), (None, "None", "n", 1e9 + 1), (1000, "No time", None, None)],
        [(5, "Late", "truth", 1e9 + 5 * hour), (8, "Late", None, 1e9 + 5 * hour), (big, "Late", "again", 1e9 + 1), (1000, "Late", "z", None), (None, "None", "m", 1e9 + 2)],
        [(9_000, "Far", None, 1e9 + 100 * hour)],  # moves the watermark past 30 hours
        [(5, "New", None, 1e9 + 101 * hour), (7, "New", "truth", 1e9 + 101 * hour)],
    ]

    def run(stream, root):
        timed = live.event_time(stream.withColumn("created_at", F.col("at").cast("timestamp")).drop("at"), "created_at", "10 hours")
        rows = state.merge_late_truth(timed, keep_hours=30, buckets=4)
        assert dict(rows.dtypes) == {"id": "bigint", "attack_type": "string", "ground_truth": "string", "version": "bigint"}
        live.broadcast(rows, f"{root}/rows", f"{root}/checkpoint", available_now=True).awaitTermination()
        return sorted((tuple(r) for r in spark.read.parquet(f"{root}/rows").select("id", "attack_type", "ground_truth", "version").collect()), key=repr)

    seen, found = [], in_batches(spark, batches, schema, run)
    for now in found:
        seen.append([r for r in now if r not in (seen and sum(seen, []))])
    first = [(i, "Bot", None, 0) for i in range(300)] + [(big, "DDoS", "DDoS", 0), (7, "Bot", "y", 1), (7, "Bot", "x", 2), (None, "None", None, 0), (None, "None", "n", 1), (1000, "No time", None, 0)]
    assert seen[0] == sorted(first, key=repr)
    assert seen[1] == sorted([(5, "Bot", "truth", 1), (big, "DDoS", "again", 1), (1000, "No time", "z", 1), (None, "None", "m", 2)], key=repr)
    assert seen[2] == [(9_000, "Far", None, 0)]
    assert seen[3] == sorted([(5, "New", None, 0), (7, "New", "truth", 0)], key=repr)  # forgotten after 30 hours


def test_templates_are_kept_between_batches(spark):
    head = lambda sets: (9).to_bytes(2, "big") + (9).to_bytes(2, "big") + bytes(12) + (7).to_bytes(4, "big") + sets
    define = lambda name, *sizes: bytes.fromhex(f"0000{8 + 4 * len(sizes):04x}{name:04x}{len(sizes):04x}" + "".join(f"{t:04x}{n:04x}" for t, n in zip((8, 12, 7), sizes)))
    data = lambda name, n: bytes.fromhex(f"{name:04x}{4 + n:04x}") + bytes(n)
    batches = [
        [("e", 10.0, 0, data(256, 8)), ("e", 30.0, 2, data(256, 8)), ("e", 20.0, 1, define(256, 4, 4)), ("e", None, 9, data(256, 8)), (None, 5.0, 3, define(256, 4, 4, 2))],
        [("e", 7.0, 10, data(256, 8)), (None, 1.0, 11, data(256, 10)), ("e", 50.0, 12, define(256, 4, 4, 2) + data(256, 10)), ("f", 60.0, 13, data(256, 8))],
        [("e", None, 20, define(257, 4, 4)), ("e", 40.0, 21, data(256, 20) + data(257, 8)), ("e", None, 22, data(257, 8))],
        [("e", 41.0, 30, data(257, 8))],
    ]
    shown = ["exporter", "at", "packet_no", "set_no", "record_no"]

    def run(stream, root):
        packets = stream.withColumn("recv_ts", F.col("at").cast("timestamp")).drop("at")
        state.follow_templated(packets, f"{root}/rows", f"{root}/templates", f"{root}/checkpoint", available_now=True).awaitTermination()
        rows = spark.read.parquet(f"{root}/rows").withColumn("at", F.col("recv_ts").cast("double"))
        return sorted((tuple(r) for r in rows.where("src_ip = '0.0.0.0'").select(*shown).collect()), key=repr)

    rows = [[(e, at, n, head(sets)) for e, at, n, sets in batch] for batch in batches]
    seen = list(in_batches(spark, rows, "exporter string, at double, packet_no long, payload binary", run))[-1]
    want = [("e", 30.0, 2, 0, 0), ("e", None, 9, 0, 0), ("e", 7.0, 10, 0, 0), (None, 1.0, 11, 0, 0), ("e", 50.0, 12, 1, 0)]
    want += [("e", 40.0, 21, 0, 0), ("e", 40.0, 21, 0, 1), ("e", None, 22, 0, 0), ("e", 41.0, 30, 0, 0)]
    assert seen == sorted(want, key=repr)


def live_rows(spark, batches, schema, keys, **timeouts):
    def run(stream, root):
        none = {c: F.lit(None).cast(k) for c, k in (("src_ip", "string"), ("src_port", "int"), ("dst_ip", "string"), ("dst_port", "int")) if c not in stream.columns}
        packets = live.event_time(stream.withColumn("ts", F.col("at").cast("timestamp")).withColumns(none), "ts", "10 seconds")
        flows.follow_flows(flows.live_flows(packets, keys, buckets=2, **timeouts), f"{root}/rows", f"{root}/checkpoint", available_now=True).awaitTermination()
        return flows.current_flows(spark, f"{root}/rows", keys)

    return list(in_batches(spark, batches, schema, run))[-1]


def test_conversations_of_a_bucket_are_kept_apart(spark):
    big = 2**60 + 1
    batches = [
        [(0, None, 100.0, 5), (1, big, 100.0, 7), (2, big + 1, 101.0, None), (3, None, 103.0, 1), (4, 9, 90.0, 2)],
        [(5, big, 104.0, 8), (6, None, 400.0, 3), (7, big + 1, 99.0, 1), (8, 9, 95.0, 4)],
        [(9, None, 402.0, 3), (10, big, 900.0, 1)],
    ]
    found = live_rows(spark, batches, "packet_id long, user_id long, at double, bytes long", ["user_id"], idle=5, active=20)
    got = sorted((tuple(r) for r in found.select("user_id", "flow_start", "bidirectional_packets", "bidirectional_bytes", "bidirectional_max_piat_ms").collect()), key=repr)
    want = [
        (None, 100_000_000, 2, 6, 3000.0), (None, 400_000_000, 2, 6, 2000.0), (big, 100_000_000, 2, 15, 4000.0), (big, 900_000_000, 1, 1, 0.0),
        (big + 1, 99_000_000, 2, 1, 2000.0), (9, 90_000_000, 2, 6, 5000.0),
    ]
    assert got == sorted(want, key=repr)


def test_ends_of_flows_keep_nulls_and_ages(spark):
    rows = [(i, 1000.0 + i, "a" if i % 3 else None, None if i % 3 else 7, None if i % 3 else "a", 7 if i % 3 else None, 10 * i, i % 2) for i in range(30)]
    rows += [(100 + i, 1000.0 + i, "", 1, "x|y", 2, None, None) for i in range(3)]
    rows = [(*r, "k" if r[0] < 100 else None, 6) for r in rows]
    schema = "packet_id long, at double, src_ip string, src_port int, dst_ip string, dst_port int, bytes long, syn int, name string, protocol int"
    found = live_rows(spark, [rows[:10] + rows[30:], rows[10:30]], schema, ["name", "protocol"], idle=5, active=8)
    shown = ["name", "protocol", "flow_start", "src_ip", "src_port", "dst_ip", "dst_port", "bidirectional_packets", "src2dst_bytes", "dst2src_syn_packets"]
    got = sorted((tuple(r) for r in found.select(shown).collect()), key=repr)
    want = [(None, 6, 1_000_000_000, "", 1, "x|y", 2, 3, 0, 0)]
    for low, high in ((0, 9), (9, 18), (18, 27), (27, 30)):
        mine = rows[low:high]
        same = [r for r in mine if r[2:4] == mine[0][2:4]]
        want.append(("k", 6, (1000 + low) * 1_000_000, *mine[0][2:6], len(mine), sum(r[6] for r in same), sum(r[7] for r in mine if r not in same)))
    assert got == sorted(want, key=repr)
