"""Operators on the last d rows in order whose statistics need many passes over a window: numpy over the windows of many codes at once.

A window's rows are the first axis, so that sums go in order of time; NaN is a missing cell.
"""

from __future__ import annotations

import math

import numpy as np

from tessera.functions.scalar import EPS
from tessera.operators.registry import operator
from tessera.plans.layers import Panel, Value


def _windowed(kinds: str, name: str, search: bool = False):
    """Registers compute(windows..., numbers after d...); NULL in the first d - 1 rows."""

    def register(compute):
        def make(p: Panel, *args):
            values, (d, *numbers) = [a for a in args if isinstance(a, Value)], [a for a in args if not isinstance(a, Value)]
            return p.slide(lambda *windows: compute(*windows, *numbers), int(d), *values)

        make.__doc__ = compute.__doc__
        operator(kinds, name, search=search)(make)
        return compute

    return register


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(np.abs(b) > EPS, a / b, np.nan)


def nonzero(a: np.ndarray) -> np.ndarray:
    return np.where(a == 0, np.nan, a)


def count(a: np.ndarray) -> np.ndarray:
    return (~np.isnan(a)).sum(0).astype(float)


def total(a: np.ndarray) -> np.ndarray:
    """0 if nothing is present; row after row, as numpy adds a single window otherwise than many."""
    out = np.zeros(a.shape[1:])
    for row in np.where(np.isnan(a), 0.0, a):
        out += row
    return out


def mean(a: np.ndarray) -> np.ndarray:
    return total(a) / nonzero(count(a))


def demeaned(a: np.ndarray) -> np.ndarray:
    return a - mean(a)


def std(a: np.ndarray) -> np.ndarray:
    dev = demeaned(a)
    return np.sqrt(mean(dev * dev))


def skew(a: np.ndarray) -> np.ndarray:
    dev = demeaned(a)
    m2 = mean(dev * dev)
    return np.where(np.sqrt(m2) > EPS, mean(dev * dev * dev) / (np.sqrt(m2) * m2), np.nan)


def kurt(a: np.ndarray) -> np.ndarray:
    dev = demeaned(a)
    m2 = mean(dev * dev)
    return ratio(mean(dev * dev * dev * dev), m2 * m2) - 3


def at(a: np.ndarray, place: np.ndarray) -> np.ndarray:
    """a[place] of each window, missing outside of it."""
    found = np.take_along_axis(a, np.clip(place, 0, len(a) - 1).astype(int)[None], 0)[0]
    return np.where((place >= 0) & (place < len(a)), found, np.nan)


def quantiles(a: np.ndarray, *qs: float) -> list[np.ndarray]:
    """Linearly interpolated, of what is present."""
    s, n = np.sort(a, 0), count(a)
    out = []
    for q in qs:
        place = (n - 1) * float(q)
        low = np.floor(place)
        lo, hi = at(s, low), at(s, np.ceil(place))
        out.append(np.where(n > 0, lo + (hi - lo) * (place - low), np.nan))
    return out


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ratio(total(a * b), np.sqrt(total(a * a)) * np.sqrt(total(b * b)))


def ranks(a: np.ndarray) -> np.ndarray:
    """From 1, ties in order of time."""
    out = np.empty(a.shape)
    np.put_along_axis(out, np.argsort(a, axis=0, kind="stable"), np.arange(1.0, len(a) + 1)[:, None] + np.zeros(a.shape), 0)
    return np.where(np.isnan(a), np.nan, out)


def kept(a: np.ndarray, where: np.ndarray) -> np.ndarray:
    return np.where(where, a, np.nan)


def _inside(c: np.ndarray, low: float, high: float) -> np.ndarray:
    lo, hi = quantiles(c, low, high)
    return (c >= lo) & (c <= hi)


# selections by quantiles of another value


@_windowed("vvdqq", "ts_kurt_selq", search=True)
def ts_kurt_selq(x, cond, low, high):
    """kurt of x where the other value is between its window's quantiles."""
    return kurt(kept(x, _inside(cond, low, high)))


for _name, _stat in (("skew", skew), ("kurt", kurt)):

    @_windowed("vvdqq", f"ts_{_name}_diff_selq")
    def _tails(x, cond, low, high, stat=_stat):
        """The statistic of x below the other value's low quantile less that above the high one."""
        lo, hi = quantiles(cond, low, high)
        return stat(kept(x, cond < lo)) - stat(kept(x, cond > hi))

    @_windowed("vvdqq", f"ts_{_name}_flip")
    def _flip(x, cond, low, high, stat=_stat):
        plain, turned = _flipped(x, cond, low, high)
        return stat(plain) - stat(turned)


@_windowed("vvvdqq", "ts_sumprod_selq", search=True)
def ts_sumprod_selq(x, y, cond, low, high):
    """The sum of x times y's share of its sum over the selection; NULL with a missing cell."""
    whole = count(x) + count(y) + count(cond) == 3 * len(x)
    return np.where(whole, total(kept(x * y, _inside(cond, low, high))) / nonzero(total(y)), np.nan)


@_windowed("vvdqq", "ts_corr_selq")
def ts_corr_selq(x, cond, low, high):
    inside = _inside(cond, low, high)
    return cosine(demeaned(kept(x, inside)), demeaned(kept(cond, inside)))


def _flipped(x, cond, low, high):
    """Deviations from the window's mean, and the same with the sign turned outside the band."""
    plain = demeaned(x)
    return plain, np.where(_inside(cond, low, high), plain, -plain)


@_windowed("vvdqqq", "ts_qua_flip")
def ts_qua_flip(x, cond, q, low, high):
    plain, turned = _flipped(x, cond, low, high)
    return ratio(quantiles(plain, q)[0], mean(plain)) - ratio(quantiles(turned, q)[0], mean(turned))


@_windowed("vvdqq", "ts_corr_flip")
def ts_corr_flip(x, cond, low, high):
    return cosine(_flipped(x, cond, low, high)[1], demeaned(cond))


# selections by the ranks of x within the window


def _ranked(x, low, high):
    share = ranks(x) / np.maximum(count(x), 1)
    return (share >= low) & (share <= high)


for _name, _stat, _search in (("mean", mean, True), ("stddev", std, True), ("skew", skew, True), ("kurt", kurt, True), ("sum", total, False)):

    @_windowed("vvdqq", f"ts_cond_quantile_{_name}", search=_search)
    def _conditional(x, y, low, high, stat=_stat):
        """The statistic of y where x's share of ranks in the window is between low and high."""
        return stat(kept(y, _ranked(x, low, high)))


@_windowed("vvdqq", "ts_cond_quantile_corr")
def ts_cond_quantile_corr(x, y, low, high):
    inside = _ranked(x, low, high)
    return cosine(demeaned(kept(x, inside)), demeaned(kept(y, inside)))


@_windowed("vvd", "ts_rankcorr", search=True)
def ts_rankcorr(x, y):
    """Pearson correlation of the ranks in the window."""
    return cosine(demeaned(ranks(x)), demeaned(ranks(y)))


# spreads between the tails


def _cuts(x, cond, low, high):
    """x at the condition's order statistics: (cut of the lower tail, cut of the upper tail)."""
    d, n = len(x), count(cond)
    in_order = np.take_along_axis(x, np.argsort(cond, axis=0, kind="stable"), 0)
    place = lambda q: round(q * d) - 1 if q * d >= 0.5 else 0
    lo, hi = np.full(n.shape, float(place(low))), n - 1 - place(high)
    return at(in_order, np.where(lo < n, lo, -1)), at(in_order, hi)


@_windowed("vvdqq", "ts_spread_selq", search=True)
def ts_spread_selq(x, cond, low, high):
    """ts_spread with tails cut at the x that stands at the other value's order statistics."""
    lo, hi = _cuts(x, cond, low, high)
    return (mean(kept(x, x >= hi)) if high * len(x) >= 1 else 0.0) - (mean(kept(x, x <= lo)) if low * len(x) >= 1 else np.zeros(x.shape[1]))


@_windowed("vvdqq", "ts_spreadw_selq", search=True)
def ts_spreadw_selq(x, cond, low, high):
    """The same with each x weighted by its share of the other value's size in the tail."""

    def tail(inside):
        weight = kept(np.abs(cond), inside)
        return mean(x * weight / nonzero(total(weight)))

    lo, hi = _cuts(x, cond, low, high)
    return (tail(x >= hi) if high * len(x) >= 1 else 0.0) - (tail(x <= lo) if low * len(x) >= 1 else np.zeros(x.shape[1]))


# histograms


def _histogram(a, buckets):
    """Shares of equal buckets from the least to the largest value; the largest itself is in none."""
    lo, hi = np.fmin.reduce(a, 0), np.fmax.reduce(a, 0)
    edges = lo + (hi - lo) * (np.arange(buckets + 1) / buckets)[:, None]
    n = ((a[:, None] >= edges[:-1]) & (a[:, None] < edges[1:]) & (a < hi)[:, None]).sum(0).astype(float)
    return n / nonzero(total(n))


@_windowed("vdN", "ts_entropy", search=True)
def ts_entropy(x, buckets=10):
    """The histogram's entropy in bits over the number of buckets, plus log2 of it."""
    h = _histogram(x, int(buckets))
    return np.where(np.isnan(h[0]), np.nan, -total(h * np.log2(h + 1e-9)) / int(buckets) + math.log2(int(buckets)))


@_windowed("vvdN", "ts_cross_entropy", search=True)
def ts_cross_entropy(x, y, buckets=10):
    """The cross-entropy of x's histogram against y's, over the number of buckets, plus log2 of it."""
    return -total(_histogram(x, int(buckets)) * np.log2(_histogram(y, int(buckets)) + 1e-9)) / int(buckets) + math.log2(int(buckets))


@_windowed("vvdN", "ts_kl_diverg", search=True)
def ts_kl_diverg(x, y, buckets=10):
    """The divergence of x's histogram from y's in bits, over the number of buckets."""
    h, g = _histogram(x, int(buckets)), _histogram(y, int(buckets))
    return total(h * (np.log2(h + 1e-8) - np.log2(g + 1e-8))) / int(buckets)


# moments with weights, three values


@_windowed("vvvd", "ts_triple_corr", search=True)
def ts_triple_corr(x, y, z):
    """The sum of threefold products of deviations over the three root sums of squares."""
    u, v, w = (demeaned(a) for a in (x, y, z))
    su, sv, sw = (np.sqrt(total(a * a)) for a in (u, v, w))
    return np.where((su >= EPS) & (sv >= EPS), total(u * v * w) / nonzero(su * sv * sw), np.nan)


@_windowed("vvd", "ts_weighted_skew", search=True)
def ts_weighted_skew(x, weights):
    """The mean of weight share times cubed deviation over the cubed deviation of the pairs present."""
    dev, w = demeaned(kept(x, ~np.isnan(weights))), kept(weights, ~np.isnan(x))
    return mean(w / nonzero(total(w)) * dev * dev * dev) / nonzero(np.power(std(dev), 3))


@_windowed("vvd", "ts_weighted_kurt")
def ts_weighted_kurt(x, weights):
    """Weighted fourth moment over the squared weighted second, about the unweighted mean, less 3."""
    dev = demeaned(x)
    power = lambda n: ratio(total(np.power(dev, n) * weights), total(weights))
    return ratio(power(4), power(2) * power(2)) - 3


# order and accumulation


def _running_gap(x, by):
    """Running sums in ascending less those in descending order of ``by``; missing cells are the window's means."""
    a, b = (np.where(np.isnan(v), mean(v), v) for v in (x, by))
    up, down = (np.take_along_axis(a, np.argsort(k, axis=0, kind="stable"), 0) for k in (b, -b))
    return np.cumsum(np.where(np.isnan(up), 0.0, up), 0) - np.cumsum(np.where(np.isnan(down), 0.0, down), 0)


@_windowed("vvd", "ts_sort_diffcumsum", search=True)
def ts_sort_diffcumsum(x, by):
    """The sum of the gaps between the running sums in ascending and in descending order."""
    return total(_running_gap(x, by))


@_windowed("vvd", "ts_sort_diff_tailsubhead", search=True)
def ts_sort_diff_tailsubhead(x, by):
    """The mean gap of the first half less that of the rest."""
    gap, half = _running_gap(x, by), max(1, len(x) // 2)
    return mean(gap[:half]) - mean(gap[half:])


@_windowed("vd", "ts_hurst")
def ts_hurst(x):
    """Rescaled range of the window: ln(range of running deviations / sample deviation) over ln d."""
    dev, d = demeaned(x), len(x)
    path = kept(np.cumsum(np.where(np.isnan(dev), 0.0, dev), 0), ~np.isnan(dev))
    spread = np.sqrt(total(dev * dev) / np.float64(d - 1))
    return np.where(spread >= EPS, np.log(nonzero(np.fmax.reduce(path, 0) - np.fmin.reduce(path, 0)) / spread) / np.float64(math.log(d)), np.nan)
