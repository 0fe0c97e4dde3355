"""Severity ranks, escalation and the two threshold rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilflow import lookups as L
from vigilflow.functions.lookup import as_col, lookup, one_of


def severity_rank(severity: Column | str) -> Column:
    """0..3 in rising order; null for a name outside the order."""
    return lookup(severity, {name: i for i, name in enumerate(L.SEVERITY_ORDER)})


def reaches_or_unknown(severity: Column | str, minimum: str) -> Column:
    """Alert rule: at or above the minimum; unknown severities pass."""
    limit = L.SEVERITY_ORDER.index(minimum)
    return F.coalesce(severity_rank(severity) >= limit, F.lit(True))


def reaches(severity: Column | str, minimum: str) -> Column:
    """Response rule: at or above the minimum; unknown severities fail."""
    limit = L.SEVERITY_ORDER.index(minimum)
    return F.coalesce(severity_rank(severity) >= limit, F.lit(False))


def escalate(severity: Column | str, vlan: Column | str) -> Column:
    """Raise the severity by VLAN; it is never lowered."""
    sev = as_col(severity)
    raised = F.when(sev == "critical", sev).otherwise(F.lit("high"))
    return (
        F.when(one_of(vlan, L.CRITICAL_VLANS), F.lit("critical"))
        .when(one_of(vlan, L.HIGH_VLANS), raised)
        .otherwise(sev)
    )
