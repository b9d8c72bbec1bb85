"""Column functions: nulls, safe arithmetic, stock codes, dates and times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as zero in a divisor.
EPS = 1e-9


def finite(x: Column) -> Column:
    """NULL for NaN and both infinities: the engine knows one missing value."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where |b| is at most EPS."""
    return F.when(F.abs(b) > EPS, F.try_divide(a, b))


def both(x: Column, y: Column, value: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), value)


def erf(x: Column) -> Column:
    """The error function by Abramowitz and Stegun 7.1.26 (absolute error below 1.5e-7)."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def code_digits(code: Column) -> Column:
    """The last six digits of a stock code."""
    return F.right(F.concat(F.lit("000000"), F.regexp_replace(code, r"\D", "")), F.lit(6))


def padded(code: Column) -> Column:
    return F.lpad(code.cast("string"), 6, "0")


def without_exchange(code: Column) -> Column:
    """SZ000001 and 000001.SZ become 000001."""
    return F.regexp_replace(F.regexp_replace(code, r"^(SH|SZ|BJ|NE)", ""), r"\.[A-Z]+$", "")


def exchange_of(code: Column) -> Column:
    """SH for codes that start with 6 (or 9), SZ for 0 and 3 (or 2), BJ for the rest."""
    first = F.substring(padded(code), 1, 1)
    return F.when(first.isin("6", "9"), "SH").when(first.isin("0", "2", "3"), "SZ").otherwise("BJ")


def with_exchange(code: Column) -> Column:
    return F.concat(exchange_of(code), padded(code))


def listed_in_shanghai_or_shenzhen(code: Column) -> Column:
    """By prefix where there is one, else by the first digit."""
    return F.when(code.rlike("^[A-Z]"), ~code.rlike("^(BJ|NE)")).otherwise(F.substring(code, 1, 1).isin("0", "3", "6"))


def date_of(number: Column) -> Column:
    """20240131 as a date; NULL for what is none."""
    return F.try_to_timestamp(number.cast("string"), F.lit("yyyyMMdd")).cast("date")


def number_of(date: Column) -> Column:
    return (F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)).cast("int")


def timestamp_of(date: Column, clock: Column) -> Column:
    """A date and HHMMSSmmm as a timestamp."""
    clock = clock.cast("long")
    seconds = F.pmod(F.floor(clock / 1000), F.lit(100)) + F.pmod(clock, F.lit(1000)) / 1000
    return F.make_timestamp(F.year(date), F.month(date), F.dayofmonth(date), F.floor(clock / 10000000).cast("int"), F.pmod(F.floor(clock / 100000), F.lit(100)).cast("int"), seconds.cast("decimal(8,6)"))


def within(clock: Column, start: int, end: int) -> Column:
    """A session from ``start`` to ``end``, past midnight if it ends before it starts."""
    return (clock >= start) & (clock <= end) if start <= end else (clock >= start) | (clock <= end)


def hit(price: Column, limit: Column) -> Column:
    """A price that touches its limit, to a relative error of 1e-4."""
    return F.coalesce(F.abs(F.try_divide(price - limit, F.nullif(limit, F.lit(0.0)))) < 1e-4, F.lit(False))
