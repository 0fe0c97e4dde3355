"""Safe numeric conversions."""

from __future__ import annotations

import sys

from pyspark.sql import Column, functions as F

from vigilflow.functions.lookup import as_col, bind

_LARGEST = sys.float_info.max
_PLAIN_NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def finite_or(value: Column, default: Column | None = None) -> Column:
    """``value`` when finite; NaN, infinities and null give ``default``."""
    kept = F.when(F.abs(value) <= _LARGEST, value)
    return kept if default is None else F.coalesce(kept, default)


def parse_number(text: Column | str) -> Column:
    """Number from plain decimal text, else null (an overflow gives an infinity).

    The pattern guard keeps out what a plain cast would accept ("1d", "NaN").
    """
    c = as_col(text)
    return F.when(c.rlike(_PLAIN_NUMBER), c.try_cast("double"))


def text_to_number(text: Column | str) -> Column:
    """Number from text; anything unparsable or not finite becomes null."""
    return bind(parse_number(text), lambda v: finite_or(v))


def safe_float(value: Column, default: float = 0.0) -> Column:
    """Float with a default for null and NaN; infinities are kept."""
    number = value.try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(None).cast("double")), F.lit(float(default)))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` where the denominator is positive, else 0."""
    return F.when(bottom > 0, F.try_divide(top, bottom)).otherwise(F.lit(0.0))


def percent_text(share: Column, digits: int) -> Column:
    """Share as a percentage with a fixed number of decimals.

    Rounded half-up as a decimal first, so text and number agree.
    """
    return F.round(share * 100, digits).cast(f"decimal(38,{digits})").cast("string")


def fixed_text(value: Column, digits: int) -> Column:
    return F.round(value, digits).cast(f"decimal(38,{digits})").cast("string")
