"""Texts: switch events, traps, alert titles, syslog lines, ages."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from vigilflow import lookups as L
from vigilflow.functions.lookup import as_col, blank_to_null, lookup, one_of
from vigilflow.functions.network import vlan_name
from vigilflow.functions.numbers import fixed_text, percent_text


def _any_of(text: Column, words) -> Column:
    return text.rlike("|".join(re.escape(w).replace(r"\-", "-") for w in words))


def syslog_tier(message: Column | str) -> Column:
    """WARNING, INFO or DEBUG by the message ids found in the upper-cased text."""
    text = F.upper(as_col(message))
    return (
        F.when(_any_of(text, L.SYSLOG_WARNING_IDS), "WARNING")
        .when(_any_of(text, L.SYSLOG_INFO_IDS), "INFO")
        .otherwise("DEBUG")
    )


def trap_label(oid: Column | str) -> Column:
    """Name of a trap OID; unnamed OIDs stay text, an empty one is 'unknown'."""
    text = F.coalesce(blank_to_null(oid), F.lit("unknown"))
    return lookup(oid, L.TRAP_NAMES, text)


def trap_tier(label: Column | str) -> Column:
    return F.when(one_of(label, L.TRAP_WARNINGS), "WARNING").otherwise("INFO")


def alert_title(attack_type: Column | str) -> Column:
    return F.concat(as_col(attack_type), F.lit(" detected"))


def alert_description(src_ip, dst_ip, dst_port, confidence) -> Column:
    """``Source: a → b:port | Confidence: x.x%`` with stand-ins for blanks."""
    port = as_col(dst_port)
    return F.concat(
        F.lit("Source: "),
        F.coalesce(blank_to_null(src_ip), F.lit("unknown")),
        F.lit(" → "),
        F.coalesce(blank_to_null(dst_ip), F.lit("unknown")),
        F.lit(":"),
        F.coalesce(F.when(port != 0, port.cast("string")), F.lit("?")),
        F.lit(" | Confidence: "),
        percent_text(as_col(confidence), 1),
        F.lit("%"),
    )


def sd_escape(text: Column) -> Column:
    """Escape backslash, quote and bracket for structured data, backslash first."""
    for char in ("\\", '"', "]"):
        text = F.replace(text, F.lit(char), F.lit("\\" + char))
    return text


def syslog_priority(severity: Column | str) -> Column:
    """Facility * 8 + severity number; unknown severities are informational."""
    return F.lit(L.SYSLOG_FACILITY * 8) + lookup(severity, L.SYSLOG_SEVERITY, 6)


def syslog_message_id(is_attack: Column | str) -> Column:
    return F.when(as_col(is_attack), "IDS_ALERT").otherwise("IDS_BENIGN")


def syslog_body(final_severity: Column | str, product: str = "VIGILFLOW", sd_id: str = "vigilflow@0") -> Column:
    """Message id, structured data and text of an alert line.

    Reads the prediction columns attack_type, confidence, group_pred, src_ip,
    dst_ip, dst_port, vlan_id, severity, is_attack.
    """
    vlan = F.coalesce(F.col("vlan_id"), F.lit(0)).cast("string")
    port = F.coalesce(F.col("dst_port"), F.lit(0)).cast("string")
    name = vlan_name("vlan_id")
    confidence = F.coalesce(F.col("confidence"), F.lit(0.0))
    attack = F.coalesce(F.col("attack_type"), F.lit("UNKNOWN"))

    def text(column: str, default: str = "") -> Column:
        return F.coalesce(F.col(column), F.lit(default))

    params = [
        ("attack_type", sd_escape(attack)),
        ("confidence", fixed_text(confidence, 4)),
        ("group_pred", sd_escape(text("group_pred"))),
        ("src_ip", sd_escape(text("src_ip"))),
        ("dst_ip", sd_escape(text("dst_ip"))),
        ("dst_port", port),
        ("vlan_id", vlan),
        ("vlan_name", name),
        ("model_sev", text("severity", "info")),
    ]
    data = F.concat_ws(
        " ", F.lit(f"[{sd_id}"), *[F.concat(F.lit(f'{k}="'), v, F.lit('"')) for k, v in params]
    )
    message = F.concat(
        F.lit(f"{product}-IDS ["), F.upper(as_col(final_severity)), F.lit("] "),
        attack, F.lit(" detected on "), name, F.lit(" (VLAN "), vlan, F.lit(") src="),
        text("src_ip", "-"), F.lit(" dst="), text("dst_ip", "-"), F.lit(":"), port,
        F.lit(" confidence="), percent_text(confidence, 2), F.lit("%"),
    )
    return F.concat(syslog_message_id("is_attack"), F.lit(" "), data, F.lit("] "), message)


def syslog_line(
    final_severity: Column | str,
    at: Column,
    host: str = "sensor",
    app: str = "vigilflow",
    process: str = "-",
    **names,
) -> Column:
    """A complete RFC 5424 line; time, host and process are given, never read here."""
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat(
        F.lit("<"), syslog_priority(final_severity).cast("string"), F.lit(">1 "), stamp,
        F.lit(f" {host} {app} {process} "), syslog_body(final_severity, **names),
    )


def age_label(at: Column | str, now: Column) -> Column:
    """``Ns ago``, ``Nm Ns ago`` or ``Nh Nm ago``; future times read 0s."""

    def seconds(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    age = F.greatest(F.lit(0), F.floor((seconds(now) - seconds(as_col(at))) / 1_000_000)).cast("long")
    minutes, hours = F.floor(age / 60), F.floor(age / 3600)

    def piece(number: Column, unit: str) -> Column:
        return F.concat(number.cast("string"), F.lit(unit))

    return (
        F.when(age < 60, piece(age, "s ago"))
        .when(age < 3600, F.concat_ws(" ", piece(minutes, "m"), piece(age % 60, "s ago")))
        .otherwise(F.concat_ws(" ", piece(hours, "h"), piece(F.floor(age % 3600 / 60), "m ago")))
    )
