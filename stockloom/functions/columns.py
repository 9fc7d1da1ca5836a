"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MONEY

# The characters a browser's String.trim() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    """'' counts as missing; other blanks stay."""
    return F.when(text != "", text)


def normalize_sku(text: Column) -> Column:
    return F.upper(js_trim(text))


def contains_text(columns: list[Column], needle: str) -> Column:
    """Case-insensitive substring test over several nullable columns."""
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.contains(F.lower(column), F.lit(needle.lower())), F.lit(False))
    return hit


_BLANKS = f"[{WHITESPACE}]*"


def number_lead(text: Column) -> Column:
    """The part of a text that reads as a decimal number from the start, '' when there is none."""
    number = r"(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    return F.regexp_extract(text, f"^{_BLANKS}([+-]?{number})", 1)


def number_of(lead: Column) -> tuple[Column, Column]:
    """Result of ``number_lead`` as (value at two decimals, out-of-range flag).

    Value is 0 when there is no number. The flag marks numbers a DECIMAL(10,2) cannot hold.
    """
    parsed = F.round(lead.try_cast("decimal(38,18)"), 2)
    found = F.coalesce(lead != "", F.lit(False))
    too_big = found & (parsed.isNull() | (F.abs(parsed) >= F.lit(100_000_000)))
    value = F.when(found & ~too_big, parsed.try_cast("decimal(10,2)")).otherwise(F.lit(0).cast(MONEY))
    return value, too_big


def whole_lead(text: Column) -> Column:
    """The part of a text that reads as a whole number from the start ('3.7' gives '3'), '' when there is none."""
    return F.regexp_extract(text, f"^{_BLANKS}([+-]?(?:0[xX][0-9a-fA-F]+|[0-9]+))", 1)


def whole_of(lead: Column) -> tuple[Column, Column]:
    """Result of ``whole_lead`` as (INT or NULL, out-of-range flag); '0x1f' is 31."""
    # An INT has at most ten digits, so anything that does not fit a BIGINT is out of range as well.
    hexa = F.conv(F.substring_index(F.lower(lead), "x", -1), 16, 10).try_cast("decimal(20,0)").try_cast("bigint")
    sign = F.when(lead.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    wide = F.when(F.contains(F.lower(lead), F.lit("x")), hexa * sign).otherwise(lead.try_cast("bigint"))
    found = F.coalesce(lead != "", F.lit(False))
    too_big = found & (wide.isNull() | ~wide.between(-2_147_483_648, 2_147_483_647))
    return F.when(found & ~too_big, wide.try_cast("int")), too_big


def number_prefix(text: Column) -> tuple[Column, Column]:
    return number_of(number_lead(text))


def whole_prefix(text: Column) -> tuple[Column, Column]:
    return whole_of(whole_lead(text))


def money(value: Column) -> Column:
    return value.cast(MONEY)


def margin_pct(sell: Column, cost: Column, empty: Column | None = None) -> Column:
    """Profit as a percentage of the price at two decimals; ``empty`` (default 0.00) where there is no price."""
    fallback = F.lit(0).cast(MONEY) if empty is None else empty
    return F.when(sell == 0, fallback).otherwise(F.round((sell - cost) / sell * 100, 2).cast(MONEY))


def instant(at: dt.datetime) -> Column:
    """A timestamp literal without time zone, whatever the zones of session and driver are."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def is_overdue(due: Column, as_of: dt.datetime) -> Column:
    """Midnight of the due date lies before ``as_of``: due today counts once the day has begun."""
    today = F.lit(as_of.date())
    late = due < today if as_of.time() == dt.time(0) else due <= today
    return F.coalesce(late, F.lit(False))


def days_until(due: Column, as_of: dt.datetime) -> Column:
    """Days left, rounded up. A part of a day never changes the rounded-up count, so dates are enough."""
    return F.date_diff(due, F.lit(as_of.date())).cast("int")
