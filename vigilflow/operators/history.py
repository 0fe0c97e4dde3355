"""Prediction history: filters, windows, pages, retention, schema evolution."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow import lookups as L
from vigilflow.functions.lookup import as_col, class_group, class_severity

RECENT_COLUMNS = [
    "id", "attack_type", "confidence", "severity", "src_ip", "dst_ip", "created_at", "is_attack", "group_pred",
]
SLOTS = {
    "DAY": dt.timedelta(days=1),
    "HOUR": dt.timedelta(hours=1),
    "MINUTE": dt.timedelta(minutes=1),
    "SECOND": dt.timedelta(seconds=1),
}
ADDED_COLUMNS = {
    "vlan_id": "int", "src_port": "int", "protocol": "int", "src_vlan": "int", "dst_vlan": "int",
}


def enrich_predictions(df: DataFrame) -> DataFrame:
    """Attack flag, severity and level-1 group of each predicted class."""
    return df.withColumns(
        {
            "is_attack": F.col("attack_type") != L.BENIGN,
            "severity": class_severity("attack_type"),
            "group_pred": class_group("attack_type"),
        }
    )


def matching(df: DataFrame, severity: str | None = None, attack_only: bool = False, status: str | None = None) -> DataFrame:
    """Optional conjunctive filters; each reaches the file scan."""
    if severity:
        df = df.filter(F.col("severity") == severity)
    if attack_only:
        df = df.filter(F.col("is_attack"))
    if status:
        df = df.filter(F.col("status") == status)
    return df


def cutoff(as_of: str, window: str | None = None, days: int | None = None, legacy_text: bool = False) -> Column | None:
    """Start of a trailing window; None means no bound (an unknown window).

    ``legacy_text`` reproduces stores that compare ISO text: rows of the whole
    cutoff day then count as inside.
    """
    span = f"{days} DAYS" if days is not None else L.WINDOWS.get(window or "")
    if span is None:
        return None
    start = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {span}")
    return F.date_trunc("DAY", start).cast("timestamp_ntz") if legacy_text else start


def within(df: DataFrame, as_of: str, window: str | None = None, days: int | None = None, legacy_text: bool = False) -> DataFrame:
    """Rows at or after the cutoff (no upper bound)."""
    start = cutoff(as_of, window, days, legacy_text)
    if start is None:
        return df
    if "event_date" in df.columns:  # days before the cutoff are not read
        df = df.filter(F.col("event_date") >= F.to_date(start))
    return df.filter(F.col("created_at") >= start)


def newest_first(df: DataFrame) -> DataFrame:
    """Newest rows first, ties by id."""
    return df.orderBy(F.desc("created_at"), F.asc("id"))


def recent(df: DataFrame, rows: int = 10) -> DataFrame:
    """The latest rows in nine columns, whatever the window."""
    return newest_first(df.select(*RECENT_COLUMNS)).limit(rows)


def page(df: DataFrame, limit: int, offset: int = 0, shallow: int = 10_000) -> DataFrame:
    """One page of the newest-first list.

    A shallow page is a top-k.  For a deep one a count per day (a table of a few
    rows) finds the days the page lies in, so that only these are ordered and
    no task ever holds ``offset`` rows.
    """
    if offset + limit > shallow:
        df, offset = _narrow_to_page(df, limit, offset)
    return newest_first(df).offset(offset).limit(limit)


def _narrow_to_page(df: DataFrame, limit: int, offset: int) -> tuple[DataFrame, int]:
    """Descend from days to seconds; keep only the slots the page touches."""
    for unit, step in SLOTS.items():
        slot = F.date_trunc(unit, "created_at")
        counts = df.groupBy(slot.alias("slot")).count().orderBy(F.desc_nulls_last("slot"))
        passed, found, skipped = 0, [], 0
        for row in counts.toLocalIterator():
            if not found and passed + row["count"] > offset:
                skipped = passed
            passed += row["count"]
            if passed > offset:
                found.append(row["slot"])
                if passed >= offset + limit:
                    break
        if not found:
            return df.limit(0), 0
        times = [slot for slot in found if slot is not None]
        inside = F.lit(False)
        if times:
            inside = (F.col("created_at") >= F.lit(times[-1])) & (F.col("created_at") < F.lit(times[0] + step))
        # Rows without a time are the last slot of all.
        df = df.filter(inside | F.col("created_at").isNull() if None in found else inside)
        offset -= skipped
    return df, offset


def page_counts(df: DataFrame, size: int) -> DataFrame:
    """Total rows and pages (at least one)."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.greatest(F.lit(1), F.ceil(total / size)).cast("long").alias("pages"))


def page_summary(rows: DataFrame) -> DataFrame:
    """Shown, attack and benign counts of a page."""
    attacks = F.count_if("is_attack")
    return rows.agg(
        F.count(F.lit(1)).alias("shown"), attacks.alias("attacks"), (F.count(F.lit(1)) - attacks).alias("benign")
    )


def live_filter(df: DataFrame, view: str = "all", ip: str = "") -> DataFrame:
    """View switch plus a case-insensitive search in either address."""
    if view == "attacks":
        df = df.filter(F.col("is_attack"))
    elif view == "benign":
        df = df.filter(~F.col("is_attack"))
    elif view in ("critical", "high", "medium"):
        df = df.filter(F.col("severity") == view)
    query = ip.strip().lower()
    if query:
        hit = F.lower("src_ip").contains(query), F.lower("dst_ip").contains(query)
        df = df.filter(F.coalesce(hit[0], F.lit(False)) | F.coalesce(hit[1], F.lit(False)))
    return df


def result_filter(df: DataFrame, attack_type: str = "", severity: str = "", src_ip: str = "") -> DataFrame:
    """Filters of an uploaded batch: class, severity, source address part."""
    if attack_type:
        df = df.filter(F.col("attack_type") == attack_type)
    if severity:
        df = df.filter(F.col("severity") == severity)
    query = src_ip.strip().lower()
    return df.filter(F.lower("src_ip").contains(query)) if query else df


def result_order(by: str, descending: bool = False, tie: str = "id") -> list[Column]:
    """Sort keys of an uploaded batch; ties keep the upload order."""
    from vigilflow.functions.lookup import lookup

    key = {
        "confidence": F.coalesce(F.col("confidence"), F.lit(0.0)),
        "type": F.coalesce(F.col("attack_type"), F.lit("")),
        "severity": lookup("severity", L.SEVERITY_SORT, 4),
    }.get(by, as_col(tie))
    return [key.desc() if descending else key.asc(), F.col(tie).asc()]


def sorted_page(df: DataFrame, by: str, page_number: int, size: int, descending: bool = False, tie: str = "id") -> DataFrame:
    """A page of the sorted batch (the page is clamped to the last one by the caller)."""
    start = (max(page_number, 1) - 1) * size
    return df.orderBy(*result_order(by, descending, tie)).offset(start).limit(size)


def expired(df: DataFrame, as_of: str, days: int, legacy_text: bool = False) -> DataFrame:
    start = cutoff(as_of, days=days, legacy_text=legacy_text)
    if "event_date" in df.columns:
        df = df.filter(F.col("event_date") <= F.to_date(start))
    return df.filter(F.col("created_at") < start)


def with_added_columns(df: DataFrame) -> DataFrame:
    """Old prediction files: add the later, nullable columns that are missing."""
    missing = {c: F.lit(None).cast(t) for c, t in ADDED_COLUMNS.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def merge_truth(df: DataFrame, truths: DataFrame) -> DataFrame:
    """Fill ground truth that came in late, by id; the latest non-null one wins.

    ``truths``: id, ground_truth, seen_at.
    """
    late = (
        truths.filter(F.col("ground_truth").isNotNull())
        .groupBy("id").agg(F.max_by("ground_truth", "seen_at").alias("_late"))
    )
    return (
        df.join(late, "id", "left")
        .withColumn("ground_truth", F.coalesce("_late", "ground_truth"))
        .withColumn("correct", F.col("ground_truth") == F.col("attack_type"))
        .drop("_late")
    )
