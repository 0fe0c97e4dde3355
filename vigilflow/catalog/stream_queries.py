"""Streaming forms (T1-T8, A31, O7), run over what is there and read back.

Results go to a file table, never through the driver's memory.  Every run gets its
own folder below the shared checkpoint root.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from vigilflow.catalog import views as V
from vigilflow.catalog.alert_queries import _repeat_sql
from vigilflow.catalog.capture_queries import ACTIVE, IDLE, _PACKET, _SHOWN, _templated_sql, shown_flows, templated_packets
from vigilflow.catalog.registry import ORACLES, query
from vigilflow.functions.lookup import class_group, class_severity
from vigilflow.operators.flows import bidirectional_key
from vigilflow.operators.history import enrich_predictions
from vigilflow.operators.response import eligible
from vigilflow.session import ROCKSDB, checkpoint_root
from vigilflow.streaming import flows, live, state


def _folder(spark) -> str:
    return f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, sf) -> DataFrame:
    """The events table as a file stream (a pattern also fits a single file)."""
    path = f"{sf}/events.parquet"
    return live.read_stream(spark, path + "*", spark.read.parquet(path).schema)


def _predictions(spark, sf, delay: str = "1 day") -> DataFrame:
    stream = _events(spark, sf).select(*[F.expr(sql).alias(name) for name, sql in V.PREDICTION.items()])
    return live.event_time(enrich_predictions(stream), "created_at", delay)


def _placed(stream: DataFrame) -> DataFrame:
    from vigilflow.functions.network import flow_direction, resolve_vlans

    none = F.lit(None).cast("int")
    return stream.withColumns(
        {**resolve_vlans("src_ip", "dst_ip", none, none, none), "flow_direction": flow_direction("src_ip", "dst_ip")}
    )


def _event_parts(spark, sf, root: str, parts: int = 4) -> DataFrame:
    """The events as a stream of ``parts`` micro-batches in time order; events without a time come first.

    Edges are approximate quantiles; each part is written by as many tasks as read it, into files of its own
    name, and a micro-batch takes the files of one part.
    """
    events = spark.read.parquet(f"{sf}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = events.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 10_000).alias("e")).first()["e"] or []
    part = sum((F.when(at >= edge, 1).otherwise(0) for edge in edges), F.lit(0))
    files = 4
    for i in range(parts):  # one write each, so that the files have an order
        events.filter(part == i).repartition(files).write.mode("append").parquet(f"{root}/input")
    return live.read_stream(spark, f"{root}/input", events.schema, files_per_batch=files)


def _in_parts(spark, sf, root: str, parts: int = 4) -> DataFrame:
    """The predictions as a stream of ``parts`` micro-batches in time order."""
    stream = _event_parts(spark, sf, root, parts)
    stream = stream.select(*[F.expr(sql).alias(name) for name, sql in V.PREDICTION.items()])
    return live.event_time(enrich_predictions(stream), "created_at", "1 day")


def _finish(stream: DataFrame, spark) -> DataFrame:
    """Append the stream's rows to a file table, wait, and read the table."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    root = _folder(spark)
    live.broadcast(stream, f"{root}/rows", f"{root}/checkpoint", available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


@query(
    "T3_live_timeline",
    f"""SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%dT%H') AS period, severity, count(*) AS total, count(*) FILTER (is_attack) AS attacks
       FROM pred GROUP BY 1, 2""",
)
def t3(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    root = _folder(spark)
    timeline = live.live_timeline(_in_parts(spark, sf, root))
    live.follow_timeline(timeline, f"{root}/rows", f"{root}/checkpoint", available_now=True).awaitTermination()
    rows = live.current_timeline(spark, f"{root}/rows")
    return rows.select(F.date_format("period_start", "yyyy-MM-dd'T'HH").alias("period"), "severity", "total", "attacks")


@query("T4_live_dedup", "SELECT id, attack_type FROM pred")
def t4(spark, sf):
    stream = _predictions(spark, sf, "40 days").select("id", "attack_type", "created_at")
    twice = stream.withColumn("copy", F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return _finish(live.unique_results(twice), spark).select("id", "attack_type")


@query("T4_late_truth", "SELECT id, attack_type, CASE WHEN id % 4 = 0 THEN attack_type END AS ground_truth FROM pred")
def t4_truth(spark, sf):
    stream = _predictions(spark, sf, "40 days").select("id", "attack_type", "created_at")
    late = F.when(F.col("id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    copies = stream.withColumn("again", F.explode(late))
    ready = copies.select(
        "id", "attack_type", F.when(F.col("again") == 1, F.col("attack_type")).alias("ground_truth"),
        (F.col("created_at") + F.make_interval(mins=F.col("again"))).alias("created_at"),
    )
    rows = _finish(state.merge_late_truth(ready), spark)
    return rows.groupBy("id").agg(
        F.max_by("attack_type", "version").alias("attack_type"), F.max_by("ground_truth", "version").alias("ground_truth")
    )


@query("T5_live_suppression", _repeat_sql(86_400))
def t5(spark, sf):
    stream = eligible(_placed(_predictions(spark, sf))).select("id", "src_ip", "group_pred", "created_at")
    rows = _finish(state.suppress_repeats(stream, 86_400), spark)
    return rows.select("id", "src_ip", "group_pred", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("T6_live_templates", _templated_sql())
def t6(spark, sf):
    root = _folder(spark)
    packets = templated_packets(_events(spark, sf), F.lit(False))
    state.follow_templated(packets, f"{root}/rows", f"{root}/templates", f"{root}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(f"{root}/rows").selectExpr(*_SHOWN)


@query(
    "T7_live_sessions",
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
       SELECT user_id, epoch_us(min(ts)) AS first_seen, count(*) AS packets, CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS BIGINT) AS bytes FROM s
       GROUP BY user_id, n""",
)
def t7(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    root = _folder(spark)
    none = {c: F.lit(None).cast(k) for c, k in (("src_ip", "string"), ("src_port", "int"), ("dst_ip", "string"), ("dst_port", "int"))}
    stream = live.event_time(_event_parts(spark, sf, root), "ts", "1 hour")
    packets = stream.withColumns({"bytes": F.floor(F.col("value") * 10).cast("long"), "packet_id": F.col("event_id"), **none})
    # Of a session the next event comes in less than 15 minutes; it has no end by age.
    rows = flows.live_flows(packets, ["user_id"], idle=900 - 1e-6, active=1e9)
    flows.follow_flows(rows, f"{root}/rows", f"{root}/checkpoint", available_now=True).awaitTermination()
    found = flows.current_flows(spark, f"{root}/rows", ["user_id"])
    return found.select("user_id", F.col("flow_start").alias("first_seen"), F.col("bidirectional_packets").alias("packets"), F.col("bidirectional_bytes").alias("bytes"))


@query("T7_live_flows", ORACLES["T7_packets_to_flows"])
def t7_flows(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    root = _folder(spark)
    stream = _event_parts(spark, sf, root).select(*[F.expr(v).alias(k) for k, v in _PACKET.items()])
    packets = bidirectional_key(live.event_time(stream, "ts", "2 hours"))
    rows = flows.live_flows(packets, idle=IDLE, active=ACTIVE)
    flows.follow_flows(rows, f"{root}/rows", f"{root}/checkpoint", available_now=True).awaitTermination()
    return shown_flows(flows.current_flows(spark, f"{root}/rows"))


def _detected(spark, sf) -> live.LiveTables:
    """The live pipeline over four micro-batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    root = _folder(spark)
    tables = live.LiveTables.under(root)
    stream = _in_parts(spark, sf, root).select(*V.PREDICTION)

    def score(batch: DataFrame) -> DataFrame:
        return _placed(
            batch.withColumns(
                {
                    "is_attack": F.col("attack_type") != "BENIGN", "severity": class_severity("attack_type"),
                    "group_pred": class_group("attack_type"),
                }
            )
        )

    live.detect(stream, score, tables, available_now=True).awaitTermination()
    return tables


@query(
    "T1_T2_live_rows",
    f"""SELECT 'prediction' AS kind, id, created_at FROM placed UNION ALL SELECT 'alert', id, created_at FROM placed WHERE is_attack
       UNION ALL SELECT 'response', id, created_at FROM ({_repeat_sql(300)})""",
)
def t2_rows(spark, sf):
    tables = _detected(spark, sf)
    parts = [
        spark.read.parquet(path).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col("created_at").cast("timestamp_ntz").alias("created_at"))
        for kind, path, key in (("prediction", tables.predictions, "id"), ("alert", tables.alerts, "prediction_id"), ("response", tables.responses, "id"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "T1_T2_live_detection",
    f"""SELECT (SELECT count(*) FROM placed) AS predictions, (SELECT count(*) FROM placed WHERE is_attack) AS alerts,
       (SELECT count(*) FROM (SELECT *, {V.sql_escalate('severity', 'vlan_id')} AS final_severity FROM placed)
        WHERE (is_attack OR vlan_id IN {V.numbers(V.L.CRITICAL_VLANS)}) AND coalesce({V.sql_rank('final_severity')} >= 1, true)) AS lines,
       (SELECT count(*) FROM ({_repeat_sql(300)})) AS responses""",
)
def t2(spark, sf):
    tables = _detected(spark, sf)

    def size(path: str, name: str) -> DataFrame:
        return spark.read.parquet(path).agg(F.count(F.lit(1)).alias(name))

    # Four single rows side by side.
    return (
        size(tables.predictions, "predictions").crossJoin(size(tables.alerts, "alerts"))
        .crossJoin(size(tables.lines, "lines")).crossJoin(size(tables.responses, "responses"))
    )


@query("T8_broadcast", "SELECT id, attack_type, severity FROM pred")
def t8(spark, sf):
    return _finish(_predictions(spark, sf).select("id", "attack_type", "severity"), spark)


@query(
    "A31_live_counters",
    """SELECT count(*) AS analysed, count(*) FILTER (is_attack) AS attacks,
       round(count(*) / ((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1000000.0::DOUBLE), 4) AS flows_per_second FROM pred""",
)
def a31(spark, sf):
    root = _folder(spark)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/counters")

    counters = live.live_counters(_predictions(spark, sf))
    writer = counters.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counters.schema).parquet(f"{root}/counters")


@query("O7_live_latest", "SELECT id, attack_type FROM pred ORDER BY created_at DESC, id LIMIT 200")
def o7(spark, sf):
    root = _folder(spark)
    stream = _in_parts(spark, sf, root).select("id", "attack_type", "created_at")
    live.latest_rows(stream, root, f"{root}/checkpoint", available_now=True).awaitTermination()
    return live.read_latest(spark, root).select("id", "attack_type")
