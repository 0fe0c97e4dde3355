"""Joins to a dimension table when a few keys own most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 64 * 1024 * 1024


def planned_bytes(df: DataFrame) -> int:
    """Spark's size estimate of a frame (files for scans, upper bounds above)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_join(
    facts: DataFrame,
    dimension: DataFrame,
    key: str,
    spread: str,
    how: str = "left",
    salts: int = 16,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join facts to a dimension with unique keys.

    A dimension within ``limit`` bytes by Spark's estimate is broadcast.  A larger
    one is repeated ``salts`` times and joined on (key, salt), the salt being a
    hash of the ``spread`` column, so that a hot key meets its row in many tasks.
    """
    if planned_bytes(dimension) <= limit:
        return facts.join(F.broadcast(dimension), key, how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", broadcast: bool = False) -> DataFrame:
    """Join on ``keys`` where null equals null; the keys of ``left`` stay."""
    rest = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(f"`{k}`").alias(f"_m_{k}") for k in keys], *[F.col(f"`{c}`") for c in rest])
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_m_{k}`")) for k in keys]
    joined = left.join(F.broadcast(renamed) if broadcast else renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_m_{k}" for k in keys])
