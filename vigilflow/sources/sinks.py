"""Writers; all tables are Parquet partitioned by day unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from vigilflow.functions.numbers import fixed_text
from vigilflow.operators.history import cutoff, expired

_RECORDS_PER_FILE = 5_000_000


def append_predictions(df: DataFrame, path: str) -> None:
    """Append by day; the rebalance hint lets AQE split days that are too big."""
    dated = df.withColumn("event_date", F.to_date("created_at"))
    (
        dated.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date")
        .option("maxRecordsPerFile", _RECORDS_PER_FILE).parquet(path)
    )


def append_alerts(df: DataFrame, path: str) -> int:
    """Append alerts and return how many were written (counted while writing)."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return int(seen.get["n"])


def read_predictions(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Prediction history; files of older schemas give null for later columns.

    With ``schema`` no file is opened to learn the columns; without it all footers are read and merged.
    """
    return spark.read.schema(schema).parquet(path) if schema else spark.read.option("mergeSchema", True).parquet(path)


def retain(spark: SparkSession, path: str, as_of: str, days: int) -> int:
    """Delete predictions older than the cutoff and return their number.

    Whole days are removed as folders; only the day of the cutoff is rewritten.
    """
    table = read_predictions(spark, path)
    deleted = expired(table, as_of, days).count()
    if not deleted:
        return 0
    start = cutoff(as_of, days=days)
    edge = F.to_date(start)
    kept = table.filter((F.col("event_date") == edge) & (F.col("created_at") >= start))
    old_days = [
        r["event_date"]
        for r in table.filter(F.col("event_date") < edge).select("event_date").distinct().toLocalIterator()
    ]
    edge_day = spark.range(1).select(edge.alias("d")).first()["d"]
    if kept.limit(1).count():
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    else:
        old_days.append(edge_day)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for day in old_days:
        fs.delete(fs_path(f"{path}/event_date={day}"), True)
    return deleted


def clear(spark: SparkSession, path: str) -> None:
    """Empty a table and keep its columns, the day included (as a folder of no rows)."""
    schema = read_predictions(spark, path).schema
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    data = [f for f in schema.fields if f.name != "event_date"]
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    empty = spark.createDataFrame([], StructType(data))
    empty.write.parquet(path if len(data) == len(schema.fields) else f"{path}/event_date=1970-01-01")


def log_export(df: DataFrame) -> DataFrame:
    """The ten text columns of the log export; null cells are empty."""

    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    port = F.when(F.col("dst_port") != 0, F.col("dst_port").cast("string"))
    return df.select(
        text(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("time"),
        text(F.col("src_ip")).alias("src_ip"),
        text(F.col("dst_ip")).alias("dst_ip"),
        text(port).alias("dst_port"),
        text(F.col("attack_type")).alias("prediction"),
        F.when(F.col("is_attack"), "1").otherwise("0").alias("is_attack"),
        text(fixed_text(F.col("confidence") * 100, 1)).alias("confidence"),
        text(F.col("severity")).alias("severity"),
        text(fixed_text(F.col("inference_ms"), 2)).alias("inference_ms"),
        text(F.col("ground_truth")).alias("ground_truth"),
    )


def write_log_export(df: DataFrame, path: str) -> None:
    log_export(df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_samples(df: DataFrame, path: str) -> None:
    """Sampled data sets as CSV, one folder per label."""
    df.write.mode("overwrite").partitionBy("Label").option("header", True).csv(path)


def write_alert_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Evaluation metrics as JSON lines."""
    metrics.write.mode("overwrite").json(path)
