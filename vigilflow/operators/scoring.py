"""Hierarchical scoring: scale, route to the group's model, build predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from vigilflow import lookups as L
from vigilflow.functions.lookup import class_severity, lookup
from vigilflow.functions.numbers import finite_or
from vigilflow.operators.ranking import digest

UNRANKED = 999


# -- scaler ----------------------------------------------------------------


def scaler_table(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population deviation per feature in one pass (long form)."""
    stats = df.agg(
        *[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(features)],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
                for i, c in enumerate(features)
            ]
        )
    )
    scale = F.when(F.col("r.std") > 0, F.col("r.std")).otherwise(F.lit(1.0))
    return stats.select(rows.alias("r")).select("r.feature", "r.mean", scale.alias("scale"))


def fit_scaler(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, scale) per feature; one row per feature reaches the driver."""
    rows = scaler_table(df, features).collect()
    return {r["feature"]: (float(r["mean"]), float(r["scale"])) for r in rows}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Standardised float32 features as plain expressions."""
    cells = {
        c: ((F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s)).cast("float") for c, (m, s) in scaler.items()
    }
    return df.withColumns(cells)


# -- hierarchical prediction -----------------------------------------------


# A level-2 model gives the frame (with columns of its own, if it needs any), the
# class and the probability map.
Level2 = Callable[[DataFrame], tuple[DataFrame, Column, Column]]


def hierarchical(
    df: DataFrame,
    level1: Callable[[DataFrame], DataFrame],
    level2: dict[str, Level2],
    groups: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Append ``group_pred``, ``attack_type`` and ``probabilities`` in one pass.

    ``level1`` appends ``group_pred``; of the level-2 results a row takes those of
    its own group.  (One branch per group would read the input and run level 1 once
    per group.)  Groups with one class, or without a model, give their first class
    with certainty.
    """
    groups = groups or L.GROUP_MEMBERS
    scored = level1(df)
    keep = scored.columns
    label = lookup("group_pred", {g: members[0] for g, members in groups.items()})
    chances = F.create_map(label, F.lit(1.0))
    for group, members in groups.items():
        if len(members) > 1 and group in level2:
            scored, own_label, own_chances = level2[group](scored)
            own = F.col("group_pred") == group
            label = F.when(own, own_label).otherwise(label)
            chances = F.when(own, own_chances).otherwise(chances)
    return scored.select(*[F.col(f"`{c}`") for c in keep], label.alias("attack_type"), chances.alias("probabilities"))


def probability_map(probability: Column, classes: list[str]) -> Column:
    """Class to probability, 4 decimals, non-finite as 0."""
    cells = F.transform(vector_to_array(probability), lambda p: F.round(finite_or(p, F.lit(0.0)), 4))
    return F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), cells)


def confidence(probabilities: Column | str) -> Column:
    """Largest class probability, 4 decimals."""
    p = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    return F.round(F.array_max(F.map_values(p)), 4)


def clean_map(values: Column) -> Column:
    """Map values that are not finite become 0."""
    return F.transform_values(values, lambda _, v: finite_or(v, F.lit(0.0)))


def rank_features(importance: DataFrame) -> DataFrame:
    """Sum importances over all sources and rank them from 1 (ties by name).

    The table has one row per feature, so one task may order it.
    """
    total = importance.groupBy("feature").agg(F.sum("importance").alias("importance"))
    return total.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("importance"), F.asc("feature")))
    )


def top_features(features: list[str], ranks: dict[str, int], n: int = 6) -> Column:
    """The n globally best ranked features with the row's scaled values."""
    best = sorted(features, key=lambda f: ranks.get(f, UNRANKED))[:n]
    return F.array(
        *[
            F.struct(
                F.lit(f).alias("name"),
                F.round(finite_or(F.col(f"`{f}`").cast("double"), F.lit(0.0)), 4).alias("value"),
                F.lit(ranks.get(f, UNRANKED)).alias("rank"),
            )
            for f in best
        ]
    )


def sorted_probabilities(probabilities: Column) -> Column:
    """Entries by falling probability (null counts as 0), ties by name."""
    entries = F.transform(
        F.map_entries(probabilities),
        lambda e: F.struct((-F.coalesce(e["value"], F.lit(0.0))).alias("k"), e["key"].alias("name")),
    )
    return F.transform(
        F.array_sort(entries), lambda e: F.struct(e["name"].alias("name"), (-e["k"]).alias("value"))
    )


def best_ranked(features: Column, n: int = 5) -> Column:
    """First n of the row's feature list by rank (no rank counts as last)."""
    keyed = F.transform(
        features, lambda f: F.struct(F.coalesce(f["rank"], F.lit(UNRANKED)).alias("k"), f.alias("f"))
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda e: e["f"])


def prediction_rows(
    scored: DataFrame, key: list[str], model: str, at: Column, ms_per_flow: Column | None = None, tie: list[str] | None = None
) -> DataFrame:
    """Complete scored rows into predictions.

    The id is a digest of the model, the row key (nulls and separators told apart) and the row's number among those of equal
    key, in the order of the ``tie`` columns (by default of a hash of all plain ones); hence the same on a retry, and unique
    whatever the keys.
    """
    plain = [F.col(f"`{f.name}`") for f in scored.schema.fields if isinstance(f.dataType, T.AtomicType)]
    same = Window.partitionBy("_key").orderBy(*([F.col(f"`{c}`") for c in tie] if tie else [F.xxhash64(*plain)]))
    numbered = scored.withColumn("_key", digest(model, *(F.col(f"`{k}`") for k in key))).withColumn("_copy", F.row_number().over(same))
    return numbered.withColumns(
        {
            "id": F.when(F.col("_copy") == 1, F.col("_key")).otherwise(F.md5(F.concat_ws("|", "_key", "_copy"))),
            "confidence": confidence("probabilities"),
            "is_attack": F.col("attack_type") != L.BENIGN,
            "severity": class_severity("attack_type"),
            "inference_ms": F.round(ms_per_flow, 3) if ms_per_flow is not None else F.lit(None).cast("double"),
            "model": F.lit(model),
            "created_at": at,
        }
    ).drop("_key", "_copy")


# -- rule stand-in for a trained model --------------------------------------


def rule_level1(df: DataFrame) -> DataFrame:
    """Transparent level-1 rules on engineered features (no trained model needed)."""
    group = (
        F.when(F.col("syn_flag_ratio") > 0.5, "DDoS-family")
        .when(F.col("fwd_bwd_pkt_ratio") > 1000, "DoS-family")
        .when(F.col("ack_syn_ratio") > 3e8, "Brute-force")
        .when(F.col("psh_flag_ratio") > 0.25, "PortScan")
        .when(F.col("slow_indicator") > 3e6, "Bot")
        .otherwise(L.BENIGN)
    )
    return df.withColumn("group_pred", group)


def rule_level2(group: str) -> Level2:
    """Rules that choose a class within a group by flow length."""
    classes = sorted(L.GROUP_MEMBERS[group])

    names = F.array(*[F.lit(c) for c in classes])
    slots = F.array(*[F.lit(i) for i in range(len(classes))])

    def score(df: DataFrame) -> tuple[DataFrame, Column, Column]:
        size = F.col("duration_log").cast("double")
        sized = df.withColumns({"_whole": F.floor(size).cast("int"), "_share": F.round(0.5 + (size - F.floor(size)) / 2, 4)})
        slot = F.col("_whole") % len(classes)
        other = F.round((1 - F.col("_share")) / (len(classes) - 1), 4)
        chances = F.transform(slots, lambda i: F.when(i == slot, F.col("_share")).otherwise(other))
        return sized, names[slot], F.map_from_arrays(names, chances)

    return score


def rule_score(df: DataFrame) -> DataFrame:
    """Hierarchical prediction by the rules; ``df`` has the engineered features."""
    level2 = {g: rule_level2(g) for g, members in L.GROUP_MEMBERS.items() if len(members) > 1}
    return hierarchical(df, rule_level1, level2)
