"""Statistics of an array column (a window's values in order of time; NULL elements are missing)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalar import EPS, ratio


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it: inside a lambda Spark shares nothing."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def power(x: Column, k: int) -> Column:
    out = x
    for _ in range(k - 1):
        out = out * x
    return out


def present(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def count(a: Column) -> Column:
    return F.size(present(a)).cast("double")


def total(a: Column) -> Column:
    """The sum of what is present, 0 if nothing is."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def mean(a: Column) -> Column:
    return _mean_of(a, lambda x: x)


def _mean_of(a: Column, of) -> Column:
    """The mean of of(element) over what is present, in one pass."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        value = of(x)
        return F.when(value.isNull(), acc).otherwise(F.struct((acc["s"] + value).alias("s"), (acc["n"] + 1).alias("n")))

    return F.aggregate(a, start, add, lambda acc: F.try_divide(acc["s"], F.nullif(acc["n"], F.lit(0.0))))


def moment(a: Column, k: int) -> Column:
    """The k-th central moment. ``a`` is used twice: pass a plain column."""
    return bound(mean(a), lambda m: _mean_of(a, lambda x: power(x - m, k)))


def std(a: Column) -> Column:
    return F.sqrt(moment(a, 2))


def squares(a: Column) -> Column:
    """The sum of squared deviations of what is present, NULL if nothing is: one row after the other, in the steps that DuckDB's variance takes.

    Where two windows have the same variance (222, 154, ... against 222, 308, ...), the last digit decides on a comparison; Spark's own variance rounds otherwise.
    """
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def add(acc: Column, x: Column) -> Column:
        m = acc["m"] + (x - acc["m"]) / (acc["n"] + 1)
        return F.when(x.isNull(), acc).otherwise(F.struct((acc["n"] + 1).alias("n"), m.alias("m"), (acc["s"] + (x - m) * (x - acc["m"])).alias("s")))

    return F.aggregate(a, start, add, lambda acc: F.when(acc["n"] > 0, acc["s"]))


def _second_and(a: Column, k: int, body) -> Column:
    """body(struct of the second and the k-th central moment)."""
    return bound(bound(mean(a), lambda m: F.struct(_mean_of(a, lambda x: power(x - m, 2)).alias("m2"), _mean_of(a, lambda x: power(x - m, k)).alias("mk"))), body)


def skew(a: Column) -> Column:
    """The mean of cubed z-values, population deviation."""
    return _second_and(a, 3, lambda s: F.when(F.sqrt(s["m2"]) > EPS, F.try_divide(s["mk"], F.sqrt(s["m2"]) * s["m2"])))


def kurt(a: Column) -> Column:
    return _second_and(a, 4, lambda s: ratio(s["mk"], s["m2"] * s["m2"]) - 3)


def in_order(a: Column) -> Column:
    """What is present, sorted."""
    return F.array_sort(present(a))


def quantile(a: Column, q: float | Column) -> Column:
    """The linearly interpolated quantile of what is present."""
    return bound(in_order(a), lambda s: quantile_of_sorted(s, q))


def quantile_of_sorted(s: Column, q: float | Column) -> Column:
    at = (F.size(s) - 1) * (F.lit(q) if not isinstance(q, Column) else q)
    low = F.floor(at)
    lo, hi = F.get(s, low.cast("int")), F.get(s, F.ceil(at).cast("int"))
    return F.when(F.size(s) > 0, lo + (hi - lo) * (at - low))


def median(a: Column) -> Column:
    """The lower of the two middle values."""
    return bound(in_order(a), lambda s: F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")))


def cosine(a: Column, b: Column) -> Column:
    """Of what is present in each; products of pairs."""
    square = lambda c: total(F.transform(c, lambda x: x * x))
    return ratio(total(F.zip_with(a, b, lambda x, y: x * y)), F.sqrt(square(a)) * F.sqrt(square(b)))


def demeaned(a: Column) -> Column:
    return bound(mean(a), lambda m: F.transform(a, lambda x: x - m))


def ranks(a: Column) -> Column:
    """Ordinal ranks from 1 of what is present, ties in order of time; NULL elsewhere."""
    placed = F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    smaller = lambda o, p: (o["v"] < p["v"]) | ((o["v"] == p["v"]) & (o["i"] <= p["i"]))
    return bound(placed, lambda every: F.transform(every, lambda p: F.when(p["v"].isNotNull(), F.size(F.filter(every, lambda o: smaller(o, p))).cast("double"))))


def kept(a: Column, b: Column, keep) -> Column:
    """a where keep(element of b), NULL elsewhere."""
    return F.zip_with(a, b, lambda x, c: F.when(keep(c), x))


def running(a: Column) -> Column:
    """Cumulative sums; a missing element counts as 0."""
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda n: total(F.slice(a, F.lit(1), n)))


def last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)
