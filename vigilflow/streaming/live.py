"""Live detection: micro-batches scored, stored, alerted, routed and answered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilflow.operators.alerts import alerts_for
from vigilflow.operators.joins import match
from vigilflow.operators.response import BLOCK_SECONDS as ANSWER_SECONDS, eligible, plan, suppress_repeats
from vigilflow.operators.routing import alert_lines
from vigilflow.session import cut_lineage

BATCH_SECONDS = 2


@dataclass(frozen=True)
class LiveTables:
    """Folders of the four live outputs, of the last answers and of the checkpoint."""

    predictions: str
    alerts: str
    lines: str
    responses: str
    marks: str
    checkpoint: str

    @classmethod
    def under(cls, root: str) -> LiveTables:
        return cls(*[f"{root}/{n}" for n in ("predictions", "alerts", "lines", "responses", "marks", "checkpoint")])


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """File stream; the file limit bounds the size of a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermarked timestamp (zone-less times are read as UTC session time)."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch so that a replay replaces it instead of doubling it.

    Rows with a ``created_at`` lie by day, as the stored tables do, then by batch.
    """
    folders = ["batch_id"]
    if "created_at" in df.columns:
        df, folders = df.withColumn("event_date", F.to_date("created_at")), ["event_date", "batch_id"]
    (
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)
    )


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def fresh_responses(rows: DataFrame, marks: str, batch_id: int, seconds: int = ANSWER_SECONDS) -> DataFrame:
    """Of the events of a micro-batch those that fire: no key was answered within ``seconds`` before.

    ``marks`` keeps the last answer per key, one snapshot per batch, so a replayed batch starts from the same one.
    An answer is forgotten when the events have passed its block.
    """
    spark, keys, last = rows.sparkSession, ["src_ip", "group_pred"], f"{marks}/batch={batch_id - 1}"
    timed = rows.withColumn("_at", F.col("created_at").cast("timestamp"))
    wait = F.make_dt_interval(secs=F.lit(float(seconds)))
    before = None
    if exists(spark, last):
        before = spark.read.schema("src_ip string, group_pred string, _last timestamp").parquet(last)
        timed = match(timed, before, keys, "left")
        timed = timed.filter(F.col("_last").isNull() | (F.col("_at") > F.col("_last") + wait)).drop("_last")
    fired = suppress_repeats(timed.select(*keys, "id", F.col("_at").alias("created_at")), seconds=seconds)
    fired = cut_lineage(spark, fired)
    now = fired.groupBy(*keys).agg(F.max("created_at").alias("_last"))
    if before is not None:
        now = before.unionByName(now).groupBy(*keys).agg(F.max("_last").alias("_last"))
    newest = rows.agg(F.max(F.col("created_at").cast("timestamp")).alias("t")).first()["t"]
    if newest is not None:
        now = now.filter(F.col("_last") + wait >= F.lit(newest))
    now.write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
    return rows.join(fired.select("id"), "id", "left_semi")


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Run ``each`` per micro-batch, every two seconds or once over what is there."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{BATCH_SECONDS} seconds").start()


def detect(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], tables: LiveTables, available_now: bool = False
) -> StreamingQuery:
    """Score flows, then store predictions, alerts, alert lines and response plans.

    ``score`` gives prediction rows (ids derive from row keys, so a replayed batch is
    identical).  A response is planned only for events that no earlier answer, of this
    batch or one before, still blocks.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = score(batch).persist()
        try:
            at = F.col("created_at")
            write_batch(rows, tables.predictions, batch_id)
            write_batch(alerts_for(rows.filter("is_attack"), "system", at), tables.alerts, batch_id)
            write_batch(alert_lines(rows, at), tables.lines, batch_id)
            answered = fresh_responses(eligible(rows), tables.marks, batch_id)
            write_batch(plan(answered, at), tables.responses, batch_id)
        finally:
            rows.unpersist()

    return start(stream, each, tables.checkpoint, available_now)


def broadcast(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append every result to a table that any number of readers can follow."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{BATCH_SECONDS} seconds"}
    return writer.outputMode("append").trigger(**trigger).start()


def live_timeline(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts per window, open ones included; the stream carries a watermark on created_at."""
    counts = stream.groupBy(F.window("created_at", width).alias("w"), "severity").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_attack").alias("attacks")
    )
    return counts.select(F.col("w.start").alias("period_start"), "severity", "total", "attacks")


def follow_timeline(timeline: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Store the windows each micro-batch has changed; ``current_timeline`` reads their newest counts."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    writer = timeline.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{BATCH_SECONDS} seconds"}
    return writer.trigger(**trigger).start()


def current_timeline(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    newest = rows.groupBy("period_start", "severity").agg(F.max_by(F.struct("total", "attacks"), "batch_id").alias("_c"))
    return newest.select("period_start", "severity", "_c.*")


def live_counters(stream: DataFrame) -> DataFrame:
    """Running totals and flows per second between first and last event."""
    span = F.unix_micros(F.max("created_at")) - F.unix_micros(F.min("created_at"))
    seconds = F.greatest(F.lit(1.0), span / 1_000_000)
    return stream.agg(
        F.count(F.lit(1)).alias("analysed"), F.count_if("is_attack").alias("attacks"),
        F.round(F.count(F.lit(1)) / seconds, 4).alias("flows_per_second"),
    )


def unique_results(stream: DataFrame) -> DataFrame:
    """First copy of every id within the watermark."""
    return stream.dropDuplicatesWithinWatermark(["id"])


def live_sessions(stream: DataFrame, keys: list[str], at: str, idle: str) -> DataFrame:
    """Flow counts by idle gap; the state of a key is one open session."""
    gap = F.session_window(at, idle)
    return stream.groupBy(*keys, gap.alias("s")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes")
    ).select(*keys, F.col("s.start").alias("first_seen"), "packets", "bytes")


def latest_rows(stream: DataFrame, path: str, checkpoint: str, rows: int = 200, available_now: bool = False) -> StreamingQuery:
    """Keep a small table of the newest rows, rewritten per micro-batch.

    Two folders alternate by batch id, so readers always find a whole one: ``read_latest``
    takes the one the last finished batch names.
    """
    from vigilflow.operators.history import newest_first

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = newest_first(batch).limit(rows)
        if batch_id > 0:
            fresh = newest_first(fresh.unionByName(spark.read.parquet(f"{path}/slot={(batch_id - 1) % 2}"))).limit(rows)
        fresh.write.mode("overwrite").parquet(f"{path}/slot={batch_id % 2}")
        pointer = spark.createDataFrame([(batch_id % 2,)], "slot int")
        pointer.coalesce(1).write.mode("overwrite").parquet(f"{path}/newest/batch={batch_id}")

    return start(stream, each, checkpoint, available_now)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest rows as of the last finished micro-batch."""
    slot = spark.read.parquet(f"{path}/newest").agg(F.max_by("slot", "batch").alias("slot")).first()["slot"]
    return spark.read.parquet(f"{path}/slot={slot}")
