"""Ranks within groups that stay exact and balanced when one group is huge.

A plain ``row_number`` sends a whole group to one task.  Here a group is ordered
by a digest, so its prefix is a fine, even and order-keeping partition: a small
table of prefix counts tells which prefix holds the wanted rank, and only that
prefix (1/4096 of a group) is ever ordered row by row.  The wide rows are not
shuffled at all: they are compared with the digest found for each cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilflow.functions.lookup import as_col
from vigilflow.operators.joins import match

Cut = int | Callable[[Column], Column]

# A per-group row is some 200 bytes, so this many groups stay near 20 MB.
BROADCAST_GROUPS = 100_000


def digest(seed: int | str, *keys: Column | str) -> Column:
    """Reproducible random order: md5 of the seed and a unique row key (distinct keys give distinct texts)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[key_text(k) for k in keys]))


def key_text(key: Column | str) -> Column:
    """Text of a key part: separators escaped, null told from every text."""
    text = as_col(key).cast("string")
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.coalesce(escaped, F.lit("\\N"))


def small(group_bound: int | None) -> bool:
    """Whether a per-group table may be broadcast: only when the number of groups is bounded."""
    return group_bound is not None and group_bound <= BROADCAST_GROUPS


def cut_digests(
    df: DataFrame,
    groups: Sequence[str],
    order: Column,
    cuts: Sequence[Cut],
    prefix: int = 3,
    group_bound: int | None = None,
) -> DataFrame:
    """Digests that bound the cuts; a cut may be a number or depend on the group.

    Per group: its size ``_n`` and the digest at every cut rank (1-based).

    ``_cut<i>`` is null when a group has fewer rows than the cut; ``_rank<i>`` is
    the cut itself (0 means nothing lies below it).
    """
    groups = list(groups)
    keyed = df.select(*groups, order.alias("_d")).withColumn("_p", F.substring("_d", 1, prefix))
    within = Window.partitionBy(*groups)
    counted = (
        keyed.groupBy(*groups, "_p")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_to", F.sum("_c").over(within.orderBy("_p")))
        .withColumn("_n", F.sum("_c").over(within))
    )
    ranks = [(F.lit(c) if isinstance(c, int) else c(F.col("_n"))).cast("long") for c in cuts]
    start = F.col("_to") - F.col("_c")
    inside = [(r > start) & (r <= F.col("_to")) for r in ranks]
    wanted = F.array_compact(F.array(*[F.when(hit, r - start) for r, hit in zip(ranks, inside)]))
    edges = counted.filter(F.size(wanted) > 0).select(*groups, "_p", "_n", start.alias("_from"), wanted.alias("_w"))
    located = (
        match(keyed, edges, [*groups, "_p"], "inner", small(group_bound))
        .withColumn("_r", F.row_number().over(Window.partitionBy(*groups, "_p").orderBy("_d")))
        .filter(F.array_contains("_w", F.col("_r").cast("long")))
        .select(*groups, (F.col("_from") + F.col("_r")).alias("_at"), "_d")
    )
    sizes = counted.groupBy(*groups).agg(F.max("_n").alias("_n"))
    found = located.groupBy(*groups).agg(F.map_from_entries(F.collect_set(F.struct("_at", "_d"))).alias("_found"))
    out = match(sizes, found, groups, "left")
    return out.select(
        *groups,
        "_n",
        *[r.alias(f"_rank{i}") for i, r in enumerate(ranks)],
        *[F.col("_found")[r].alias(f"_cut{i}") for i, r in enumerate(ranks)],
    )


def band(
    df: DataFrame,
    groups: Sequence[str],
    order: Column,
    cuts: Sequence[Cut],
    prefix: int = 3,
    group_bound: int | None = None,
) -> DataFrame:
    """Append ``band``: how many cuts lie below a row in its group's order.

    Rising cuts split every group by rank: band 0 holds the first ``cuts[0]``
    rows and so on.  The digest must be unique within a group; null is a group of
    its own.  Also appends the group size as ``group_rows``.

    ``group_bound`` is a known upper bound of the number of groups (class labels,
    listed files); with it the cut table is broadcast and the rows stay in place,
    without it Spark joins by its own size estimate.
    """
    table = cut_digests(df, groups, order, cuts, prefix, group_bound)
    joined = match(df.withColumn("_d", order), table, list(groups), "inner", small(group_bound))
    passed = [
        (
            (F.col(f"_rank{i}") <= 0)
            | ((F.col(f"_rank{i}") < F.col("_n")) & (F.col("_d") > F.col(f"_cut{i}")))
        ).cast("int")
        for i in range(len(cuts))
    ]
    return joined.select(
        *df.columns, sum(passed[1:], passed[0]).alias("band"), F.col("_n").alias("group_rows")
    )
