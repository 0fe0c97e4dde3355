"""Literal-map lookups for constant tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, functions as F

from vigilflow import lookups as L


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def literal_map(table: Mapping) -> Column:
    """A constant table as one folded map literal."""
    return F.create_map(*[F.lit(item) for pair in table.items() for item in pair])


def lookup(key: Column | str, table: Mapping, default=None) -> Column:
    """``table[key]``; missing keys give ``default`` (a value or a column)."""
    found = literal_map(table)[as_col(key)]
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def one_of(col: Column | str, values: Iterable) -> Column:
    """Null-free membership test."""
    return F.coalesce(as_col(col).isin(list(values)), F.lit(False))


def blank_to_null(col: Column | str) -> Column:
    """Null for the empty string, as in truth tests of the alert text rules."""
    c = as_col(col)
    return F.when(c != "", c)


def class_group(label: Column | str) -> Column:
    """Level-1 group of a class (null when the class is unknown)."""
    return lookup(label, L.CLASS_TO_GROUP)


def class_severity(label: Column | str) -> Column:
    """Severity of a class; unknown labels are medium."""
    return lookup(label, L.SEVERITY, L.DEFAULT_SEVERITY)


def normalise_label(label: Column | str, eleven_classes: bool = True) -> Column:
    """Trim, unify and (optionally) merge the flood classes; else pass through."""
    text = F.trim(as_col(label).cast("string"))
    merged = lookup(text, L.LABEL_MERGE, text)
    return lookup(merged, L.FLOOD_MERGE, merged) if eleven_classes else merged


def service_label(port: Column | str) -> Column:
    """Service name of a port; unknown, zero and null ports give null."""
    return lookup(port, L.SERVICE_PORTS)


def flow_service(dst_port: Column | str, src_port: Column | str) -> Column:
    """Service of the destination port, else of the source port."""
    return F.coalesce(service_label(dst_port), service_label(src_port))


def protocol_label(number: Column | str) -> Column:
    """Protocol name, ``IP/n`` when unnamed, null for 0 and null."""
    n = as_col(number)
    return F.when(n != 0, lookup(n, L.PROTOCOL_NAMES, F.concat(F.lit("IP/"), n.cast("string"))))
