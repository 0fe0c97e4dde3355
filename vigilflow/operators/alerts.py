"""Alerts: creation from predictions, enrichment, patches, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow.functions.messages import alert_description, alert_title
from vigilflow.operators.joins import lookup_join

PATCHABLE = ("title", "description", "severity", "status", "assigned_to", "notes")


def with_creator(alerts: DataFrame, users: DataFrame) -> DataFrame:
    """Alerts with the name of their creator (null when unknown).

    One creator (the system) owns most alerts, so the join is salted unless the
    user table is small.
    """
    names = users.select(F.col("id").alias("created_by"), F.col("username").alias("creator_name"))
    return lookup_join(alerts, names, "created_by", spread="id")


def unalerted_attacks(predictions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Attacks no alert refers to; alerts without a prediction do not matter."""
    done = alerts.filter(F.col("prediction_id").isNotNull()).select(F.col("prediction_id").alias("id")).distinct()
    return (
        predictions.filter("is_attack")
        .join(done, "id", "left_anti")
        .select("id", "attack_type", "severity", "confidence", "src_ip", "dst_ip", "dst_port", "created_at")
    )


def alerts_for(attacks: DataFrame, created_by: str, as_of: Column) -> DataFrame:
    """One open alert per attack row.

    The id derives from the prediction, so a retried task writes the same alert.
    """
    return attacks.select(
        F.md5(F.concat_ws("|", F.lit("alert"), F.col("id").cast("string"))).alias("id"),
        alert_title("attack_type").alias("title"),
        alert_description("src_ip", "dst_ip", "dst_port", "confidence").alias("description"),
        "severity",
        F.lit("open").alias("status"),
        F.col("id").alias("prediction_id"),
        F.lit(created_by).alias("created_by"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )


def backfill(predictions: DataFrame, alerts: DataFrame, created_by: str, as_of: Column) -> DataFrame:
    """New alerts for every attack that has none."""
    return alerts_for(unalerted_attacks(predictions, alerts), created_by, as_of)


def apply_patches(alerts: DataFrame, patches: DataFrame, deletes: DataFrame) -> DataFrame:
    """Next alert snapshot: patches in time order, then deletes.

    A patch changes only the fields it fills, so the last non-null value of each
    field counts; patches of unknown ids are ignored.
    """
    fields = [c for c in PATCHABLE if c in alerts.columns and c in patches.columns]
    latest = patches.groupBy("id").agg(
        F.max("updated_at").alias("_at"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("updated_at"))).alias(f"_{c}") for c in fields],
    )
    gone = deletes.select("id").distinct()
    merged = alerts.join(latest, "id", "left").join(gone, "id", "left_anti")
    new = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields}
    new["updated_at"] = F.coalesce(F.col("_at"), F.col("updated_at"))
    return merged.withColumns(new).select(*alerts.columns)


def status_counts(alerts: DataFrame) -> DataFrame:
    """Totals by status; active means open or under investigation."""

    def having(*states: str) -> Column:
        return F.count_if(F.col("status").isin(list(states)))

    return alerts.agg(
        F.count(F.lit(1)).alias("total"), having("open").alias("open"),
        having("investigating").alias("investigating"), having("resolved").alias("resolved"),
        having("open", "investigating").alias("active"),
    )


def active_sessions(sessions: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Users behind the sessions that have not expired."""
    people = users.withColumnRenamed("id", "user_id")
    alive = sessions.filter(F.col("expires_at") > as_of)
    return lookup_join(alive, people, "user_id", spread="token", how="inner")
