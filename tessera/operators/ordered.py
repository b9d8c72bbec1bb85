"""Operators that need the window's values in order: arrays of the last d rows and a few higher-order functions on them (``listed`` has those of many passes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions.scalar import EPS, finite, ratio
from tessera.operators.registry import operator
from tessera.plans.layers import Panel, Value


def _window(p: Panel, d: int, make, *values: Value) -> Value:
    """make() of the arrays of the last d rows, NULL in the first d - 1."""
    d = int(d)
    return p.each(lambda *a: p.full(d, make(*a)), *p.array(d, *values))


def _laid(p: Panel, value: Value) -> Value:
    """An intermediate array as a column of its own, so that it is computed once."""
    return p.flat(Value(value.column, True, value.depth))


@operator("vd", search=True)
def ts_med(p: Panel, x: Value, d: int) -> Value:
    """The lower median."""
    return _window(p, d, A.median, p.each(finite, x))


@operator("vd", search=True)
def ts_mad_med(p: Panel, x: Value, d: int) -> Value:
    """The median of distances from the rolling median."""
    return ts_med(p, p.each(lambda c, m: F.abs(c - m), x, ts_med(p, x, d)), d)


@operator("vd", search=True)
def ts_rank(p: Panel, x: Value, d: int) -> Value:
    """The last value's rank in its window over the number of values; of equal ones it counts as the last."""
    return _window(p, d, lambda a: F.try_divide(F.size(F.filter(a, lambda v: v <= A.last(a))).cast("double"), F.nullif(A.count(a), F.lit(0.0))) + 0 * A.last(a), p.each(finite, x))


# a selection of the window by quantiles of another value


def _edges(p: Panel, c: Value, *at: float) -> tuple[Value, ...]:
    """Quantiles of an array, from one sorted copy of it."""
    sorted_ = _laid(p, p.each(A.in_order, c))
    return tuple(_laid(p, p.each(lambda s, q=q: A.quantile_of_sorted(s, float(q)), sorted_)) for q in at)


def _banded(p: Panel, x: Value, cond: Value, d: int, low: float, high: float, low_keep, high_keep=None) -> tuple[Value, ...]:
    """x where the condition (element, low quantile, high quantile) holds, as arrays."""
    a, c = p.array(int(d), x, cond)
    lo, hi = _edges(p, c, low, high)
    keeps = [low_keep] if high_keep is None else [low_keep, high_keep]
    return tuple(_laid(p, p.each(lambda v, w, m, n, k=k: A.kept(v, w, lambda e: k(e, m, n)), a, c, lo, hi)) for k in keeps)


def _inside(e: Column, lo: Column, hi: Column) -> Column:
    return (e >= lo) & (e <= hi)


_STATS = {"mean": A.mean, "stddev": A.std, "skew": A.skew, "sum": A.total, "median": A.median}


def _select(name: str, stat, search: bool) -> None:
    def inside(p: Panel, x: Value, cond: Value, d: int, low: float, high: float) -> Value:
        (kept,) = _banded(p, x, cond, d, low, high, _inside)
        guard = (lambda c: c) if name == "sum" else (lambda c: p.full(int(d), c))
        return p.each(lambda k: guard(stat(k)), kept)

    inside.__doc__ = f"{name} of x where the other value is between its window's quantiles."
    operator("vvdqq", f"ts_{name}_selq", search=search)(inside)


for _name, _search in (("mean", True), ("stddev", True), ("skew", True), ("sum", False), ("median", True)):
    _select(_name, _STATS[_name], _search)


def _tails(name: str, stat, combine) -> None:
    def tails(p: Panel, x: Value, cond: Value, d: int, low: float, high: float) -> Value:
        below, above = _banded(p, x, cond, d, low, high, lambda e, lo, hi: e < lo, lambda e, lo, hi: e > hi)
        return p.each(lambda a, b: p.full(int(d), combine(stat(a), stat(b))), below, above)

    tails.__doc__ = f"{name} of x below the other value's low quantile against that above the high one."
    operator("vvdqq", f"ts_{name}_diff_selq")(tails)


_tails("mean", A.mean, lambda a, b: a - b)
_tails("stddev", A.std, ratio)  # a ratio, whatever the name says


@operator("vvdqqq", search=True)
def ts_qua_selq(p: Panel, x: Value, cond: Value, d: int, q: float, low: float, high: float) -> Value:
    (kept,) = _banded(p, x, cond, d, low, high, _inside)
    return p.each(lambda k: p.full(int(d), ratio(A.quantile(k, float(q)), A.mean(k))), kept)


@operator("vvdqq")
def ts_prodsum_selq(p: Panel, x: Value, cond: Value, d: int, low: float, high: float) -> Value:
    """The sum of products with the condition over the selection."""
    (kept,) = _banded(p, p.each(lambda a, b: a * b, x, cond), cond, d, low, high, _inside)
    return p.each(lambda k: p.full(int(d), A.total(k)), kept)


def _flipped(p: Panel, x: Value, cond: Value, d: int, low: float, high: float) -> tuple[Value, Value]:
    """Deviations from the window's mean, and the same with the sign turned outside the band."""
    a, c = p.array(int(d), x, cond)
    plain = _laid(p, p.each(A.demeaned, a))
    lo, hi = _edges(p, c, low, high)
    turned = _laid(p, p.each(lambda v, w, m, n: F.zip_with(v, w, lambda e, k: F.when(F.coalesce(_inside(k, m, n), F.lit(False)), e).otherwise(-e)), plain, c, lo, hi))
    return plain, turned


@operator("vvdqq")
def ts_mean_flip(p: Panel, x: Value, cond: Value, d: int, low: float, high: float) -> Value:
    return p.each(lambda t: p.full(int(d), A.mean(t)), _flipped(p, x, cond, d, low, high)[1])


def _flip(name: str, stat) -> None:
    def flip(p: Panel, x: Value, cond: Value, d: int, low: float, high: float) -> Value:
        return p.each(lambda a, b: p.full(int(d), stat(a) - stat(b)), *_flipped(p, x, cond, d, low, high))

    operator("vvdqq", f"ts_{name}_flip")(flip)


_flip("stddev", A.std)


# spreads between the tails


@operator("vdqq", search=True)
def ts_spread(p: Panel, x: Value, d: int, low: float, high: float) -> Value:
    """The mean of the upper tail less that of the lower; a tail of less than one row counts 0."""
    d = int(d)
    (a,) = p.array(d, x)
    lo, hi = _edges(p, a, float(low), 1 - float(high))

    def make(v: Column, m: Column, n: Column) -> Column:
        upper = A.mean(F.filter(v, lambda e: e >= n)) if high * d >= 1 else F.lit(0.0)
        lower = A.mean(F.filter(v, lambda e: e <= m)) if low * d >= 1 else F.lit(0.0)
        return p.full(d, upper - lower)

    return p.each(make, a, lo, hi)


@operator("vdqq")
def ts_spread_std(p: Panel, x: Value, d: int, low: float, high: float) -> Value:
    """The deviation of what is below the low quantile less that of what is above the high one."""
    below, above = _banded(p, x, x, d, low, high, lambda e, lo, hi: e < lo, lambda e, lo, hi: e > hi)
    return p.each(lambda a, b: p.full(int(d), A.std(a) - A.std(b)), below, above)


# what exceeds another value's quantile; NULL with a missing cell


def _above(name: str, stat) -> None:
    def build(p: Panel, x: Value, y: Value, q: float, d: int) -> Value:
        (kept,) = _banded(p, x, y, d, q, q, lambda e, lo, hi: e > hi)
        cells = p.array(int(d), x, y)
        return p.each(lambda k, a, b: p.full(int(d), F.when(A.count(a) + A.count(b) == 2 * int(d), stat(k))), kept, *cells)

    build.__doc__ = f"{name} of x where y is above its window's quantile."
    operator("vvqd", f"ts_{name}_gt_pct", search=True)(build)


for _name in ("mean", "stddev", "sum"):
    _above(_name, _STATS[_name])


@operator("vdE", search=True)
def ts_ewmv(p: Panel, x: Value, d: int, alpha: float | None = None) -> Value:
    """The weighted variance about ts_ewma, with its weights."""
    from tessera.operators.rolling import _ewma_weights, ts_ewma

    weights = _ewma_weights(int(d), alpha)
    (a,) = p.array(int(d), x)
    w = F.array(*(F.lit(v / sum(weights)) for v in weights))
    return p.each(lambda v, m: p.full(int(d), A.total(F.zip_with(v, w, lambda e, k: k * (e - m) * (e - m)))), a, p.flat(ts_ewma(p, x, d, alpha)))


@operator("vdE", search=True)
def ts_ewmstd(p: Panel, x: Value, d: int, alpha: float | None = None) -> Value:
    return p.each(F.sqrt, ts_ewmv(p, x, d, alpha))


# order and accumulation


def _sorted_by(p: Panel, x: Value, by: Value, d: int) -> tuple[Value, Value]:
    """The window of x in ascending and in descending order of ``by``; missing cells are the window's means."""
    a, b = p.array(d, x, by)
    filled = [_laid(p, p.each(lambda v: F.transform(v, lambda e: F.coalesce(e, A.mean(v))), v)) for v in (a, b)]
    pairs = lambda v, w, sign: F.transform(F.array_sort(F.zip_with(F.zip_with(w, F.sequence(F.lit(1), F.size(w)), lambda k, i: F.struct((sign * k).alias("k"), i.alias("i"))), v, lambda s, e: F.struct(s["k"].alias("k"), s["i"].alias("i"), e.alias("x")))), lambda s: s["x"])
    return tuple(_laid(p, p.each(lambda v, w, s=s: pairs(v, w, s), *filled)) for s in (1, -1))


@operator("vvdB")
def sort_by_another(p: Panel, x: Value, by: Value, d: int, descending: bool = False) -> Value:
    """An array: the window of x in the order of another value."""
    return p.each(lambda v: p.full(int(d), v), _sorted_by(p, x, by, int(d))[int(descending)])


@operator("vd", search=True)
def ts_max_drawdown(p: Panel, x: Value, d: int) -> Value:
    """The largest fall from a maximum in the window, relative to it; NULL with a missing cell."""
    step = lambda s, e: F.struct(F.greatest(s["top"], e).alias("top"), F.greatest(s["fall"], F.try_divide(F.greatest(s["top"], e) - e, F.nullif(F.greatest(s["top"], e), F.lit(0.0)))).alias("fall"))
    start = F.struct(F.lit(-1.7e308).alias("top"), F.lit(0.0).alias("fall"))
    return _window(p, d, lambda a: F.when(A.count(a) == int(d), F.aggregate(a, start, step)["fall"]), x)


@operator("v")
def loop_max_min(p: Panel, y: Value) -> Value:
    """A struct (zmax, zmin): the largest and smallest sum of the last 1 to 240 rows."""
    rows = p.over(lambda c: F.reverse(F.collect_list(F.coalesce(c, F.lit(0.0))).over(p.last(240))), y)
    sums = _laid(p, p.each(A.running, p.flat(rows)))
    return p.each(lambda s: F.struct(F.array_max(s).alias("zmax"), F.array_min(s).alias("zmin")), sums)
