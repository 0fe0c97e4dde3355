"""Streaming flow records equal the batch form, and data sets meet their templates without moving."""

import random
import uuid

from pyspark.sql import functions as F

from vigilflow.operators.flows import bidirectional_key, packets_to_flows
from vigilflow.session import ROCKSDB, checkpoint_root
from vigilflow.sources.netflow import attach_templates, split_sets, stored_versions
from vigilflow.streaming import flows, live

SCHEMA = "packet_id long, ts timestamp, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, bytes long, syn int"


def packets(seed, n=400):
    """Seconds, so that several flows per conversation end by gap or by age; some lack sizes, ports or addresses."""
    draw = random.Random(seed)
    rows, at = [], 1_700_000_000.0
    for i in range(n):
        at += draw.choice([0, 0.5, 1, 2, 9])
        ends = draw.choice([("10.0.0.1", 1000), ("10.0.0.2", 2000), ("10.0.0.3", None), (None, 5)])
        there = ("10.0.0.9", 443)
        a, b = (ends, there) if draw.random() < 0.6 else (there, ends)
        rows.append((i, at, *a, *b, 6, draw.choice([None, 40, 60, 1500]), draw.choice([0, 1, None])))
    return rows


def as_frame(spark, rows):
    return spark.createDataFrame([(r[0], float(r[1]), *r[2:]) for r in rows], SCHEMA.replace("ts timestamp", "ts double")).withColumn("ts", F.col("ts").cast("timestamp"))


def plain(frame):
    names = sorted(set(frame.columns) - {"closed"})
    cells = lambda r: tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in names)
    return sorted((repr(cells(r)) for r in frame.collect()))


def test_after_every_batch_equals_the_batch_form(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    root = f"{checkpoint_root(spark)}/flows-{uuid.uuid4().hex}"
    rows, seen = packets(3), []
    draw = random.Random(9)
    # Rows swap places within some seconds, so late ones come in a later file; the watermark is wider.
    rows.sort(key=lambda r: r[1] + draw.uniform(0, 12))
    cuts = [0, 90, 91, 260, len(rows)]
    for step, (low, high) in enumerate(zip(cuts, cuts[1:])):
        seen += rows[low:high]
        as_frame(spark, rows[low:high]).coalesce(1).write.mode("append").parquet(f"{root}/input")
        stream = live.read_stream(spark, f"{root}/input", as_frame(spark, rows[:1]).schema, files_per_batch=1)
        keyed = bidirectional_key(live.event_time(stream, "ts", "30 seconds"))
        found = flows.live_flows(keyed, idle=8, active=20)
        flows.follow_flows(found, f"{root}/rows", f"{root}/checkpoint", available_now=True).awaitTermination()
        now = flows.current_flows(spark, f"{root}/rows")
        want = packets_to_flows(as_frame(spark, seen), idle=8, active=20)
        assert plain(now) == plain(want), step
    assert now.where("closed").count() > 20 and now.where("not closed").count() > 0


def test_data_sets_stay_where_they_are(spark):
    from vigilflow.catalog.capture_queries import templated_packets

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    sent = templated_packets(events, F.lit(False)).withColumn("exporter", F.lit("10.99.0.1"))  # one exporter sends all
    versions = stored_versions(sent)
    ready = attach_templates(split_sets(sent, "data"), versions)
    plan = ready._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    moved = attach_templates(split_sets(sent, "data"), versions, limit=0)
    columns = ["packet_no", "set_no", "record_size"]
    assert sorted(map(tuple, ready.select(columns).collect())) == sorted(map(tuple, moved.select(columns).collect()))


def test_versions_of_templates(spark):
    schema = "exporter string, recv_ts timestamp, packet_no long, payload binary"
    head = lambda sets: (9).to_bytes(2, "big") + (9).to_bytes(2, "big") + bytes(12) + (7).to_bytes(4, "big") + sets
    define = lambda *fields: bytes.fromhex(f"0000{8 + 4 * len(fields):04x}0100{len(fields):04x}" + "".join(f"{t:04x}{n:04x}" for t, n in fields))
    data = lambda n: bytes.fromhex(f"0100{4 + n:04x}") + bytes(n)
    one, two = define((1, 4)), define((1, 4), (2, 4))
    rows = [
        (0, data(4)), (10, one), (20, data(4)), (20, one), (4000, one), (4100, data(4)), (9000, two + data(8) + one + data(4)), (9000, data(4)),
        (90_000, data(4)), (90_001, two), (90_001, data(8)),
    ]
    frame = spark.createDataFrame([("e", float(at), i, head(p)) for i, (at, p) in enumerate(rows)], schema.replace("recv_ts timestamp", "recv_ts double"))
    frame = frame.withColumn("recv_ts", F.col("recv_ts").cast("timestamp"))
    found = attach_templates(split_sets(frame, "data"), stored_versions(frame))
    got = sorted((r["packet_no"], r["set_no"], r["record_size"]) for r in found.collect())
    assert got == [(2, 0, 4), (5, 0, 4), (6, 1, 8), (6, 3, 4), (7, 0, 4), (8, 0, 4), (10, 0, 8)]
