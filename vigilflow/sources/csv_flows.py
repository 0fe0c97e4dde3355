"""Flow tables from CSV files with differing headers."""

from __future__ import annotations

from collections import defaultdict
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from vigilflow.functions.lookup import normalise_label
from vigilflow.functions.numbers import text_to_number
from vigilflow.operators.harmonise import find_label, kept_positions, union_all

ENCODING = "ISO-8859-1"
_ROW_BITS = (1 << 33) - 1


def list_csv_files(spark: SparkSession, folder: str) -> list[str]:
    """All CSV files below a folder in path order (names only)."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    walk, files = fs.listFiles(path, True), []
    while walk.hasNext():
        name = walk.next().getPath().toString()
        if name.endswith(".csv"):
            files.append(name)
    return sorted(files)


def read_header(spark: SparkSession, file: str) -> list[str] | None:
    """Header fields of one file (one small read); None for an unreadable file."""
    jvm = spark._jvm
    try:
        path = jvm.org.apache.hadoop.fs.Path(file)
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
        try:
            line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, ENCODING)).readLine()
        finally:
            stream.close()
    except Exception:  # a file that cannot be opened is skipped, like a corrupt one
        return None
    return [field.strip().strip('"') for field in line.split(",")] if line else None


def read_flow_csv(
    spark: SparkSession, folder: str, max_rows_per_file: int | None = None, with_position: bool = False
) -> DataFrame:
    """Harmonised union of all CSV files below a folder, all cells as text.

    Files are read together per header layout, by position: names are stripped and
    renamed, the first of equal names stays and metadata never leaves the scan.
    ``file`` names the source; ``row_in_file`` (0-based) is added on request.
    """
    files = list_csv_files(spark, folder)
    with ThreadPool(16) as pool:
        headers = pool.map(lambda f: read_header(spark, f), files)
    layouts: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for file, header in zip(files, headers):
        if header:
            layouts[tuple(header)].append(file)
    if not layouts:
        raise FileNotFoundError(f"no readable CSV file below {folder}")
    frames = [_read_layout(spark, list(header), group) for header, group in layouts.items()]
    if max_rows_per_file is None and not with_position:
        return union_all([f.drop("_block", "_row") for f in frames])
    placed = [place_in_file(f) for f in frames]
    if max_rows_per_file is not None:
        placed = [f.filter(F.col("row_in_file") < max_rows_per_file) for f in placed]
    return union_all([f if with_position else f.drop("row_in_file") for f in placed])


def _read_layout(spark: SparkSession, header: list[str], files: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    raw = (
        spark.read.schema(schema)
        .option("header", True).option("encoding", ENCODING)
        .option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True)
        .csv(files)
    )
    return raw.select(
        *[F.col(f"c{i}").alias(name) for name, i in kept_positions(header).items()],
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("_row"),
    )


def place_in_file(df: DataFrame) -> DataFrame:
    """Append ``row_in_file`` without ordering any rows.

    Rows of a split come in file order, so the position is the number of rows in
    earlier splits of the file (a small table) plus the place in the own split.
    """
    splits = df.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block")
    splits = splits.select(
        "file", "_block", "_first", (F.sum("_n").over(before) - F.col("_n")).alias("_before")
    )
    return (
        df.join(splits, ["file", "_block"])
        .withColumn("row_in_file", F.col("_before") + F.col("_row") - F.col("_first"))
        .drop("_block", "_row", "_first", "_before")
    )


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """Scoring input with an optional label.

    Headers are stripped but not renamed, features are finite numbers or null, and
    ``ground_truth`` is the unified label or null.
    """
    raw = spark.read.option("header", True).option("encoding", ENCODING).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    label = find_label(raw.columns)
    truth: Column = normalise_label(F.col(f"`{label}`")) if label else F.lit(None).cast("string")
    return raw.select(
        *[text_to_number(F.col(f"`{c}`")).alias(c) for c in raw.columns if c != label],
        truth.alias("ground_truth"),
    )
