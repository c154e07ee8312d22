"""Exact numbers: locale parsing and formatting, growth and differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_decimal(raw: Column, scale: int = 6) -> Column:
    """Dots group thousands when groups of three follow; a comma is the decimal mark; (x) is negative; - alone is null."""
    text = F.regexp_replace(F.trim(raw), r"[%\s]", "")
    negative = text.rlike(r"^\(.*\)$")
    text = F.regexp_replace(text, r"[()+]", "")
    grouped = text.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$")
    plain = F.when(grouped, F.translate(text, ".", "")).otherwise(text)
    value = F.translate(plain, ",", ".").try_cast(f"decimal(38,{scale})")
    return F.when(negative, -value).otherwise(value)


def format_decimal(value: Column, places: int = 2) -> Column:
    """Dots between thousands and a decimal comma; halves round away from zero."""
    return F.translate(F.format_number(F.round(value, places), places), ",.", ".,")


def change_percent(old: Column, new: Column) -> Column:
    """(new - old) / |old| * 100; null at 0."""
    return F.try_divide((new - old) * 100, F.abs(old))


def prior_value(now: Column, percent: Column) -> Column:
    """What grew by percent to be now; null at -100."""
    return F.try_divide(now, 1 + percent / 100)


def cagr_percent(first: Column, last: Column, periods: Column) -> Column:
    """Yearly growth in percent; null unless both ends and the periods are positive."""
    ok = (first > 0) & (last > 0) & (periods > 0)
    return F.when(ok, (F.pow(last / first, F.lit(1.0) / periods) - 1) * 100)


def points_difference(old: Column, new: Column) -> Column:
    """Percentage points between two shares."""
    return (new - old) * 100
