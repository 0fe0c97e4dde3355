"""Alert routing: escalation, suppression and alert lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow import lookups as L
from vigilflow.functions.lookup import one_of
from vigilflow.functions.messages import syslog_line
from vigilflow.functions.severity import escalate, reaches_or_unknown


def route(df: DataFrame, minimum: str = "medium") -> DataFrame:
    """Predictions that raise an alert line, with their ``final_severity``.

    Escalation comes first.  Benign rows count only on critical VLANs.
    """
    vlan = F.coalesce(F.col("vlan_id"), F.lit(0))
    severity = F.coalesce(F.col("severity"), F.lit("info"))
    attack = F.coalesce(F.col("is_attack"), F.lit(False))
    return df.withColumn("final_severity", escalate(severity, vlan)).filter(
        (attack | one_of(vlan, L.CRITICAL_VLANS)) & reaches_or_unknown("final_severity", minimum)
    )


def alert_lines(df: DataFrame, at: Column, minimum: str = "medium", **names) -> DataFrame:
    """One RFC 5424 text line per routed prediction."""
    return route(df, minimum).select(syslog_line("final_severity", at, **names).alias("value"))
