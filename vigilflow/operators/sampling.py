"""Reproducible splits, caps and balancing.

"Random" order is the md5 of a seed and a unique row key, so samples do not
depend on partitioning, retries or lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilflow.operators.joins import match
from vigilflow.operators.ranking import band, digest, key_text, small


def split_per_file(
    df: DataFrame, file: str, key: list[str], train_rows: int, unseen_rows: int, seed: int = 42,
    file_bound: int | None = None,
) -> DataFrame:
    """Append ``split``: train, unseen or unused, by random rank within the file."""
    parts = band(
        df, [file], digest(seed, file, *key), [train_rows, train_rows + unseen_rows], group_bound=file_bound
    )
    names = F.array(F.lit("train"), F.lit("unseen"), F.lit("unused"))
    return parts.select(*df.columns, names[F.col("band")].alias("split"))


def cap_per_group(
    df: DataFrame, groups: list[str], key: list[str], rows: int, seed: int = 42, group_bound: int | None = None
) -> DataFrame:
    """At most ``rows`` random rows of every group."""
    parts = band(df, groups, digest(seed, *groups, *key), [rows], group_bound=group_bound)
    return parts.filter("band = 0").select(*df.columns)


def stratified_split(
    df: DataFrame, label: str, key: list[str], seed: int = 42, train: float = 0.70, validate: float = 0.15,
    class_bound: int | None = None,
) -> DataFrame:
    """Append ``split``: train, validation or test with equal shares in every class."""

    def share(part: float):
        return lambda n: F.floor(F.round(n * part, 6))

    parts = band(
        df, [label], digest(seed, label, *key), [share(train), share(train + validate)], group_bound=class_bound
    )
    names = F.array(F.lit("train"), F.lit("validation"), F.lit("test"))
    return parts.select(*df.columns, names[F.col("band")].alias("split"))


def balance_classes(
    df: DataFrame, label: str, key: list[str], largest: int = 100_000, smallest: int = 200, seed: int = 42,
    class_bound: int | None = None,
) -> DataFrame:
    """Cap big classes and draw small ones with replacement up to ``smallest``.

    Appends ``copy``: 0 for rows taken once, the draw number for drawn rows.
    Only classes below ``smallest`` rows are ever numbered row by row.
    """
    parts = band(df, [label], digest(seed, label, *key), [largest], group_bound=class_bound)
    plain = parts.filter((F.col("band") == 0) & (F.col("group_rows") >= smallest)).select(
        *df.columns, F.lit(0).cast("long").alias("copy")
    )
    small = parts.filter(F.col("group_rows") < smallest)
    numbered = small.withColumn(
        "_i", F.row_number().over(Window.partitionBy(label).orderBy(digest(seed, label, *key))) - 1
    )
    draws = (
        small.groupBy(label)
        .agg(F.first("group_rows").alias("_n"))
        .select(label, "_n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(smallest).cast("long"))).alias("copy"))
        .select(label, "copy", draw_index(seed, label, "copy", F.col("_n")).alias("_i"))
    )
    drawn = match(numbered, draws, [label, "_i"], "inner").select(*df.columns, "copy")
    return plain.unionByName(drawn)


def draw_index(seed: int, label: str, draw: str, size: Column) -> Column:
    """Reproducible pick of 0..size-1 for a draw with replacement."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit("draw"), key_text(label), F.col(draw).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % size


def sample_group_files(
    df: DataFrame, group: str, file: str, key: list[str], target: int, seed: int = 42, file_bound: int | None = None
) -> DataFrame:
    """Equal shares of ``target`` rows over the files of each group.

    Every file gives at most ``target div files`` random rows; the shares sum to
    no more than the target, so no further cap is needed.  ``Label`` becomes the
    group's name.
    """
    files = df.groupBy(group, file).count().groupBy(group).agg(F.count(F.lit(1)).alias("_files"))
    ready = match(df, files, [group], "inner", small(file_bound)).withColumn("_share", F.floor(F.lit(target) / F.col("_files")))
    parts = band(
        ready, [group, file, "_share"], digest(seed, file, *key), [lambda n: F.col("_share")], group_bound=file_bound
    )
    return parts.filter("band = 0").select(*df.columns).withColumn("Label", F.col(group))


def random_row(df: DataFrame, file: str, key: list[str], seed: int) -> DataFrame:
    """One row: a random file first, then a random row of it.

    Two minima instead of sorts; both combine on the map side.
    """
    pick = F.min_by(file, F.md5(F.concat_ws("|", F.lit(str(seed)), key_text(file))))
    chosen = df.agg(pick.alias("_file"))
    rows = df.join(F.broadcast(chosen), F.col(file).eqNullSafe(F.col("_file"))).drop("_file")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return rows.agg(F.min_by(whole, digest(seed, file, *key)).alias("_row")).filter("_row is not null").select("_row.*")
