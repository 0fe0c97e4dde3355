"""Order-dependent operators over keyed events, split by time blocks.

One key may own a third of all events, so no window here is partitioned by the
key alone.  Rows are handled per (key, time block); what a block needs from
earlier ones is carried over by a table with one row per key and block, whose
size depends on the time span and not on the number of events.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from vigilflow.operators.joins import match
from vigilflow.session import cut_lineage

_MAX = np.iinfo(np.int64).max


def _carry(df: DataFrame, keys: Sequence[str], block: str, tail: Column) -> DataFrame:
    """Per (key, block): the last non-null ``tail`` of all earlier blocks."""
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.groupBy(*keys, block)
        .agg(tail.alias("_tail"))
        .select(*keys, block, F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, block: str, out: str
) -> DataFrame:
    """Append the latest non-null ``value`` at or before each row (as-of, backward).

    ``block`` must rise with the order.  Null keys are keys like others.
    """
    keys = list(keys)
    local = (
        Window.partitionBy(*keys, block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    at = F.when(F.col(value).isNotNull(), F.struct(*order))
    carried = _carry(df, keys, block, F.max_by(value, at))
    return (
        match(df, carried, [*keys, block], "left")
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(local), F.col("_carry")))
        .drop("_carry")
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, block: str, out: str
) -> DataFrame:
    """Append ``value`` of the previous row of the same key (lag across blocks)."""
    keys = list(keys)
    carried = _carry(df, keys, block, F.max_by(value, F.struct(*order)))
    local = Window.partitionBy(*keys, block).orderBy(*order)
    return (
        match(df, carried, [*keys, block], "left")
        .withColumn(out, F.coalesce(F.lag(value).over(local), F.col("_carry")))
        .drop("_carry")
    )


# --------------------------------------------------------------------------
# Greedy marks: a point is marked when it lies strictly more than ``ttl`` after
# the last marked point (or is forced); unmarked points do not extend the wait.


# Blocks of one key whose step functions are chained in one task.
FAN_IN = 64
HOUR = 3_600_000_000


def greedy_marks(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    ttl: int,
    tie: str,
    forced: str | None = None,
    whole_key_rows: int = 10_000,
    block_points: int = 100_000,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Marked points (keys, ``at``, ``tie``) of integer times ``at`` (microseconds).

    Rows at the same time are one point: forced if one of them is, with the smallest
    ``tie``.  Keys with few points are folded in one piece in the JVM.  Larger ones
    are cut into blocks of at most about ``2 * block_points`` points, however dense.
    Each block condenses to a step function from "last mark before the block" to "last
    mark after it"; these are composed ``fan_in`` at a time in a tree, so no task gets
    all blocks of a key, and every block then marks its own points from its known start.
    """
    keys = list(keys)
    flag = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    rows = df.select(*keys, F.col(at).cast("long").alias(at), tie, flag.alias("_f"))
    points = rows.groupBy(*keys, at).agg(F.max("_f").alias("_f"), F.min(tie).alias(tie)).select(*keys, at, tie, "_f")
    hot = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > whole_key_rows).select(*keys)
    small = _fold_whole(match(points, hot, keys, "left_anti"), keys, at, ttl, tie)
    return small.unionByName(_fold_blocks(match(points, hot, keys, "left_semi"), keys, at, ttl, tie, block_points, fan_in))


def _with_blocks(points: DataFrame, keys: list[str], at: str, span: int, block_points: int) -> DataFrame:
    """Append ``_b``: (span of time, number of the block in it).

    A slot of ``block_points`` microseconds holds no more points than that; slots of a
    span are joined to blocks by running counts, a table of at most one row per slot.
    """
    slotted = points.withColumns({"_hour": F.floor(F.col(at) / span), "_slot": F.floor(F.col(at) / block_points)})
    before = Window.partitionBy(*keys, "_hour").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        slotted.groupBy(*keys, "_hour", "_slot").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_part", F.floor(F.coalesce(F.sum("_c").over(before), F.lit(0)) / block_points))
        .select(*keys, "_hour", "_slot", "_part")
    )
    placed = match(slotted, numbered, [*keys, "_hour", "_slot"], "inner")
    return placed.withColumn("_b", F.struct("_hour", "_part")).drop("_hour", "_slot", "_part")


def _fold_whole(points: DataFrame, keys: list[str], at: str, ttl: int, tie: str) -> DataFrame:
    mark = f"array<struct<{at}: bigint, {tie}: {points.schema[tie].dataType.simpleString()}>>"
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(mark).alias("marks"))

    def step(state: Column, point: Column) -> Column:
        late = state["last"].isNull() | (point[at] > state["last"] + ttl)
        push = point["_f"] & (point[at] > state["last"])
        new = F.struct(point[at].alias(at), point[tie].alias(tie))
        marked = F.struct(point[at].alias("last"), F.concat(state["marks"], F.array(new)).alias("marks"))
        return F.when(late | push, marked).otherwise(state)

    series = F.sort_array(F.collect_list(F.struct(at, tie, "_f")))
    marks = F.explode(F.aggregate("_s", start, step, lambda s: s["marks"]))
    return points.groupBy(*keys).agg(series.alias("_s")).select(*keys, marks.alias("_m")).select(*keys, "_m.*")


def _fold_blocks(
    points: DataFrame, keys: list[str], at: str, ttl: int, tie: str, block_points: int, fan_in: int
) -> DataFrame:
    blocked = _with_blocks(points, keys, at, max(HOUR, 4 * ttl), block_points)
    order = blocked.groupBy(*keys, "_b").agg(F.min(at).alias("_from"))
    order = order.withColumn("_i", (F.row_number().over(Window.partitionBy(*keys).orderBy("_b")) - 1).cast("long"))
    # Points, block numbers and starts are read by every level: stored, they are made once.
    placed = cut_lineage(points.sparkSession, match(blocked, order, [*keys, "_b"], "inner").drop("_b"))
    key_fields = [f for f in placed.schema.fields if f.name in keys]
    long_list, number = T.ArrayType(T.LongType()), T.StructField("_i", T.LongType())
    steps_schema = T.StructType([*key_fields, number, T.StructField("_limit", long_list), T.StructField("_exit", long_list)])
    carry_schema = T.StructType([*key_fields, number, T.StructField("_last", T.LongType())])
    mark_schema = T.StructType([*key_fields, T.StructField(at, T.LongType()), points.schema[tie]])
    key_names = [f.name for f in key_fields]

    def condense(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        # Marks before the block are earlier than its first point.
        limit, exit_ = block_steps(*_sorted_points(pdf, at), ttl, int(first["_from"]))
        return pd.DataFrame([[*first[key_names], first["_i"], limit, exit_]], columns=steps_schema.names)

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        parts = [(np.asarray(a), np.asarray(b)) for a, b in zip(pdf["_limit"], pdf["_exit"])]
        limit, exit_ = compose_steps(parts, ttl)
        first = pdf.iloc[0]
        return pd.DataFrame([[*first[key_names], first["_i"] // fan_in, limit, exit_]], columns=steps_schema.names)

    def hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        start = pdf["_start"].iloc[0]
        last, out = None if pd.isna(start) else int(start), []
        for limit, exit_ in zip(pdf["_limit"], pdf["_exit"]):
            out.append(last)
            last = step_through(last, np.asarray(limit), np.asarray(exit_), ttl)
        return pdf[[*key_names, "_i"]].assign(_last=pd.array(out, dtype="Int64"))[carry_schema.names]

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        first = pdf["_last"].iloc[0]
        chosen = marks_after(*_sorted_points(pdf, at), ttl, None if pd.isna(first) else int(first))
        return pdf.iloc[chosen][mark_schema.names]

    spark = points.sparkSession
    levels = [cut_lineage(spark, placed.groupBy(*keys, "_i").applyInPandas(condense, steps_schema))]
    blocks = (levels[0].agg(F.max("_i")).first()[0] or 0) + 1
    while blocks > fan_in:
        up = levels[-1].groupBy(*keys, F.floor(F.col("_i") / fan_in).alias("_up")).applyInPandas(join_up, steps_schema)
        levels.append(cut_lineage(spark, up))
        blocks = -(-blocks // fan_in)
    carried = None
    for level in reversed(levels):
        parts = level.withColumn("_up", F.floor(F.col("_i") / fan_in))
        if carried is None:
            parts = parts.withColumn("_start", F.lit(None).cast("long"))
        else:
            above = carried.select(*keys, F.col("_i").alias("_up"), F.col("_last").alias("_start"))
            parts = match(parts, above, [*keys, "_up"], "inner")
        carried = parts.groupBy(*keys, "_up").applyInPandas(hand_down, carry_schema)
    known = match(placed, carried, [*keys, "_i"], "inner")
    return known.groupBy(*keys, "_i").applyInPandas(mark, mark_schema)


def _sorted_points(pdf: pd.DataFrame, at: str) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values(at)
    return pdf[at].to_numpy(np.int64), pdf["_f"].to_numpy(bool)


def _next_index(times: np.ndarray, pushed: np.ndarray, ttl: int) -> np.ndarray:
    """For every point, the index of the mark that follows if it is marked."""
    size = len(times)
    by_time = np.searchsorted(times, times + ttl, side="right")
    spots = np.append(np.flatnonzero(pushed), size)
    by_push = spots[np.searchsorted(spots, np.arange(size), side="right")]
    return np.minimum(by_time, by_push)


def block_steps(times, pushed, ttl: int, start: int) -> tuple[list[int], list[int]]:
    """Step function of a block: the mark that is last when the block ends.

    With ``e`` = last mark before the block + ttl, the result is the exit of the
    first step whose limit exceeds ``e``; without such a step nothing is marked.
    """
    size = len(times)
    follow = _next_index(times, pushed, ttl)
    end = np.where(follow == size, np.arange(size), follow.clip(max=size - 1))
    while True:  # pointer doubling: ends of chains point to themselves
        twice = end[end]
        if np.array_equal(twice, end):
            break
        end = twice
    # Entries beyond start + ttl cannot occur, and nothing passes a pushed point.
    last_entry = int(np.searchsorted(times, start + ttl, side="left"))
    if pushed.any():
        last_entry = min(last_entry, int(np.flatnonzero(pushed)[0]))
    entries = np.arange(min(last_entry, size - 1) + 1)
    limit = times[entries].copy()
    if last_entry < size:
        limit[-1] = _MAX
    exits = times[end[entries]]
    keep = np.append(exits[1:] != exits[:-1], True)
    return limit[keep].tolist(), exits[keep].tolist()


def step_through(last: int | None, limit: np.ndarray, exits: np.ndarray, ttl: int) -> int | None:
    """Last mark after a block, given the last mark before it."""
    if last is None:
        return int(exits[0])
    i = int(np.searchsorted(limit, last + ttl, side="right"))
    return int(exits[i]) if i < len(limit) else last


def compose_steps(parts: list[tuple[np.ndarray, np.ndarray]], ttl: int) -> tuple[list[int], list[int]]:
    """One step function for several blocks in a row; it has no more steps than the first one, plus one per block.

    A block without a step for a late entry leaves the last mark as it is; there the next blocks decide.
    """
    limits, exits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    low = np.iinfo(np.int64).min  # entries (last mark + ttl) below this limit are done
    for i, (limit, last) in enumerate(parts):
        fresh = limit > low
        if not fresh.any():
            continue
        limit, last = limit[fresh], last[fresh]
        for bounds, outs in parts[i + 1 :]:
            at = np.searchsorted(bounds, last + ttl, side="right")
            last = np.where(at < len(bounds), outs[np.minimum(at, len(bounds) - 1)], last)
        limits.append(limit)
        exits.append(last)
        low = limit[-1]
    limit, exit_ = np.concatenate(limits), np.concatenate(exits)
    keep = np.append(exit_[1:] != exit_[:-1], True)
    return limit[keep].tolist(), exit_[keep].tolist()


def marks_after(times, pushed, ttl: int, last: int | None) -> list[int]:
    """Places of all marks of a block, given the last mark before it."""
    size = len(times)
    follow = _next_index(times, pushed, ttl)
    i = 0
    if last is not None:
        i = int(np.searchsorted(times, last + ttl, side="right"))
        if pushed.any():
            i = min(i, int(np.flatnonzero(pushed)[0]))
    chosen = []
    while i < size:
        chosen.append(i)
        i = int(follow[i])
    return chosen
