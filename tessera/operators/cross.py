"""Operators across the codes of one row index. Ties are broken by code."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import EPS, erf, finite, ratio
from tessera.operators.registry import operator
from tessera.plans.layers import Panel, Value


def _across(name: str, make, kinds: str = "v", search: bool = True) -> None:
    n = kinds.lower().count("v")

    def build(p: Panel, *args):
        return p.over(lambda *c: make(*c, p.across, *args[n:]), *args[:n])

    build.__doc__ = f"{name} over the codes of a row index."
    operator(kinds, name, search=search)(build)


def _present(x: Column, value: Column) -> Column:
    return F.when(x.isNotNull(), value)


_across("cs_mean", lambda x, w: _present(finite(x), F.avg(x).over(w)))
_across("cs_demean", lambda x, w: x - F.avg(x).over(w))
_across("cs_sum", lambda x, w: F.sum(x).over(w))
_across("cs_min", lambda x, w: F.min(finite(x)).over(w))
_across("cs_max", lambda x, w: F.max(finite(x)).over(w), search=False)
_across("cs_stddev", lambda x, w: _present(x, F.nullif(F.stddev_pop(x).over(w), F.lit(0.0))))
_across("cs_normalize", lambda x, w: ratio(x - F.avg(x).over(w), F.avg(x).over(w)))  # over the mean, not the deviation
_across("cs_zscore", lambda x, w: ratio(x - F.avg(x).over(w), F.stddev_pop(x).over(w)), search=False)
_across("cs_market", lambda x, w: F.try_divide(F.sum(x).over(w) - x, F.nullif(F.count(x).over(w) - 1, F.lit(0))))
_across("cs_winsorize", lambda x, w: _present(x, F.least(F.greatest(x, F.avg(x).over(w) - 4 * F.stddev_pop(x).over(w)), F.avg(x).over(w) + 4 * F.stddev_pop(x).over(w))))
_across("cs_salience", lambda x, w: F.abs(x - F.avg(x).over(w)) / (0.01 + F.abs(x) + F.abs(F.avg(x).over(w))))
_across("cs_min_max_norm", lambda x, w: F.when(F.max(x).over(w) - F.min(x).over(w) <= EPS, _present(x, F.lit(0.5))).otherwise(F.try_divide(x - F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w))))
_across("cs_zscore_cdf_norm", lambda x, w: 0.5 * (1 + erf((x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + 1e-8) / 2**0.5)), search=False)
_across("cs_fillna_mean", lambda x, w: F.coalesce(finite(x), F.avg(finite(x)).over(w)), search=False)
_across("fill_with_mean", lambda x, w: F.coalesce(finite(x), F.avg(finite(x)).over(w)), search=False)
_across("cs_nan_proportion", lambda x, w: 1 - F.count(finite(x)).over(w) / F.count(F.lit(1)).over(w), search=False)
_across("cs_certain_value_proportion", lambda x, w, v: F.count_if(F.abs(x - v) < EPS).over(w) / F.count(F.lit(1)).over(w), kinds="vn", search=False)


# ranks


def _ordinal(p: Panel, x: Column) -> Column:
    """1, 2, ... of what is present, ties by code."""
    return F.when(x.isNotNull(), F.row_number().over(p.across.orderBy(x.asc_nulls_last(), "code"))).cast("double")


@operator("v", search=True)
def cs_rank(p: Panel, x: Value) -> Value:
    """The ordinal rank over the number of codes present."""
    return p.over(lambda c: _ordinal(p, finite(c)) / F.count(finite(c)).over(p.across), x)


@operator("v")
def cs_dense_rank(p: Panel, x: Value) -> Value:
    """The dense rank over the largest."""
    rank = p.over(lambda c: F.when(c.isNotNull(), F.dense_rank().over(p.across.orderBy(c.asc_nulls_last()))).cast("double"), p.each(finite, x))
    return p.over(lambda r: r / F.max(r).over(p.across), rank)


def _median(p: Panel, x: Value, *by: str) -> Value:
    """The lower median of the codes, in every cell: the value at half the ordinal ranks."""
    w = Window.partitionBy("t", *by)
    placed = p.over(lambda c: F.struct(F.row_number().over(w.orderBy(c.asc_nulls_last(), "code")).alias("k"), F.count(c).over(w).alias("n")), x)
    return p.over(lambda c, s: F.max(F.when(s["k"] == F.floor((s["n"] + 1) / 2), c)).over(w), x, placed)


@operator("v", search=True)
def cs_median(p: Panel, x: Value) -> Value:
    """The lower median; NULL where a code is missing."""
    return p.over(lambda c, m: F.when(F.count(c).over(p.across) == F.count(F.lit(1)).over(p.across), m), x, _median(p, x))


@operator("v", search=True)
def cs_abs_deviation(p: Panel, x: Value) -> Value:
    """The distance from the lower median."""
    return p.each(lambda c, m: F.abs(c - m), x, _median(p, x))


@operator("vN", search=True)
def cs_mad_winsorize(p: Panel, x: Value, n: float = 3) -> Value:
    """Clipped to the median and n median distances from it."""
    m = _median(p, x)
    mad = _median(p, p.flat(p.each(lambda c, v: F.abs(c - v), x, m)))
    return p.each(lambda c, v, s: _present(c, F.least(F.greatest(c, v - n * s), v + n * s)), x, m, mad)


@operator("vN", search=True)
def cs_rank_mad(p: Panel, x: Value, n_mad: float = 3.0) -> Value:
    """cs_rank clipped at the median of ranks and n times 1.4826 median distances."""
    return cs_mad_winsorize(p, cs_rank(p, x), n_mad * 1.4826)


@operator("vQQ", search=True)
def cs_rank_quantile(p: Panel, x: Value, low: float = 0.05, high: float = 0.95) -> Value:
    """cs_rank clipped to its own quantiles."""
    return p.over(lambda r: _present(r, F.least(F.greatest(r, F.percentile(r, F.lit(low)).over(p.across)), F.percentile(r, F.lit(high)).over(p.across))), cs_rank(p, x))


@operator("vqqB")
def cs_highlowtag(p: Panel, x: Value, low: float, high: float, zero: bool = False) -> Value:
    """1 strictly between two quantiles of the codes, else NULL (0 after the first day if asked)."""
    inside = p.over(lambda c: F.when((c > F.percentile(c, F.lit(low)).over(p.across)) & (c < F.percentile(c, F.lit(high)).over(p.across)), 1.0), x)
    return p.each(lambda c: F.when(F.col("t") >= 237, F.coalesce(c, F.lit(0.0))).otherwise(c), inside) if zero else inside


@operator("v", search=True)
def cs_leftright_range1(p: Panel, x: Value) -> Value:
    """The mean of the five codes to either side and the code itself, 0 if none is present."""
    return p.over(lambda c: F.coalesce(F.avg(c).over(p.across.orderBy("code").rowsBetween(-5, 5)), F.lit(0.0)), x)


# two values


@operator("vv", search=True)
def cs_orth(p: Panel, x: Value, y: Value) -> Value:
    """x less its projection on y; missing cells count as the whole panel's mean."""

    def filled(v: Value) -> Value:
        return p.each(F.coalesce, v, p.whole(F.avg, v))

    return p.over(lambda a, b: a - ratio(F.sum(a * b).over(p.across), F.sum(b * b).over(p.across)) * b, filled(x), filled(y))


for _name, _make in (("add", lambda y, o: y + o), ("sub", lambda y, o: y - o), ("mul", lambda y, o: y * o), ("div", ratio)):

    def _build(p: Panel, x: Value, y: Value, make=_make) -> Value:
        return p.each(make, y, cs_orth(p, x, y))

    operator("vv", f"cs_orth_{_name}")(_build)


def _line(x: Column, y: Column, w) -> tuple[Column, Column]:
    """(intercept, slope) of y on x over the pairs present."""
    pair = x.isNotNull() & y.isNotNull()
    a, b = F.when(pair, x), F.when(pair, y)
    slope = ratio(F.covar_pop(a, b).over(w), F.var_pop(a).over(w))
    return F.avg(b).over(w) - slope * F.avg(a).over(w), slope


@operator("vv", search=True)
def cs_regpred(p: Panel, x: Value, y: Value) -> Value:
    """The line of y on x, at x."""
    return p.over(lambda a, b: _line(a, b, p.across)[0] + _line(a, b, p.across)[1] * a, x, y)


@operator("vv", search=True)
def cs_regres(p: Panel, x: Value, y: Value) -> Value:
    """y less the line of y on x."""
    return p.each(lambda b, f: b - f, y, cs_regpred(p, x, y))


def _correlation(a: Column, b: Column, w) -> Column:
    pair = a.isNotNull() & b.isNotNull()
    x, y = F.when(pair, a), F.when(pair, b)
    return ratio(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))


@operator("vv")
def cs_corr(p: Panel, x: Value, y: Value) -> Value:
    """Pearson correlation over the codes, in every cell."""
    return p.over(lambda a, b: _correlation(a, b, p.across), x, y)


operator("vv", "corr_row")(lambda p, x, y: p.over(lambda a, b: F.when((F.count(a).over(p.across) == F.count(F.lit(1)).over(p.across)) & (F.count(b).over(p.across) == F.count(F.lit(1)).over(p.across)), _correlation(a, b, p.across)), x, y))
operator("vv", "corr_col", causal=False)(lambda p, x, y: p.over(lambda a, b: F.when((F.count(a).over(Window.partitionBy("code")) == F.count(F.lit(1)).over(Window.partitionBy("code"))) & (F.count(b).over(Window.partitionBy("code")) == F.count(F.lit(1)).over(Window.partitionBy("code"))), _correlation(a, b, Window.partitionBy("code"))), x, y))


@operator("vv", causal=False)
def adj_cs_corr(p: Panel, x: Value, y: Value) -> Value:
    """The mean of the row correlations over their deviation, over the whole panel."""
    return p.whole(lambda c: ratio(F.avg(c), F.stddev_pop(c)), cs_corr(p, x, y), by_row=True)


def _schmidt(p: Panel, values: tuple[Value, ...]) -> list[Value]:
    """Each value less its projections on the results before it."""
    out: list[Value] = []
    for v in values:
        rest = v
        for u in out:
            rest = p.over(lambda a, b, c: a - ratio(F.sum(c * b).over(p.across), F.sum(b * b).over(p.across)) * b, rest, u, v)
        out.append(p.flat(rest))
    return out


@operator("vvV")
def cs_schmidt(p: Panel, x: Value, *others: Value) -> Value:
    """x less its projection on each of the others in turn, all of the original x."""
    rest = x
    for u in others:
        rest = p.over(lambda a, b, c: a - ratio(F.sum(c * b).over(p.across), F.sum(b * b).over(p.across)) * b, rest, u, x)
    return rest


@operator("vvV")
def cs_schmidt_last(p: Panel, *values: Value) -> Value:
    return _schmidt(p, values)[-1]


@operator("vvV")
def cs_schmidt_sum(p: Panel, *values: Value) -> Value:
    return p.each(lambda *c: sum(c[1:], c[0]), *_schmidt(p, values))


# groups


def _grouped(name: str, make, search: bool = True) -> None:
    def build(p: Panel, x: Value, group: Value) -> Value:
        return p.over(lambda c, g: F.when(g.isNotNull(), make(c, Window.partitionBy("t", g))), x, p.flat(Value(group.column, True, group.depth)))

    build.__doc__ = f"{name} within the groups of a row index."
    operator("vv", name, search=search)(build)


_grouped("cs_group_demean", lambda x, w: x - F.avg(x).over(w))
_grouped("cs_group_demean_2", lambda x, w: x - F.avg(x).over(w))
_grouped("cs_group_neutralize", lambda x, w: x - F.avg(x).over(w), search=False)
_grouped("cs_group_norm", lambda x, w: (x - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w) + 1e-8))
_grouped("cs_group_rank", lambda x, w: F.when(x.isNotNull(), F.row_number().over(w.orderBy(x.asc_nulls_last(), "code"))) / F.count(x).over(w), search=False)
_grouped("cs_group_zscore", lambda x, w: F.when(F.count(x).over(w) >= 2, ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w))), search=False)


@operator("vvN", search=True)
def cs_group_rank_neutralize(p: Panel, x: Value, neutralizer: Value, groups: int = 5) -> Value:
    """The dense rank of x, over the largest, within quantile groups of the other value."""
    bucket = p.over(lambda c: sum((F.when(c > F.percentile(c, F.lit(k / groups)).over(p.across), 1).otherwise(0) for k in range(1, int(groups))), F.lit(0)) + F.when(c.isNull(), F.lit(None)).otherwise(0), neutralizer)
    rank = p.over(lambda c, g: F.when(c.isNotNull() & g.isNotNull(), F.dense_rank().over(Window.partitionBy("t", g).orderBy(c.asc_nulls_last()))).cast("double"), p.each(finite, x), bucket)
    return p.over(lambda r, g: r / F.max(r).over(Window.partitionBy("t", g)), rank, bucket)


@operator("vvN")
def cs_group_mean(p: Panel, x: Value, y: Value, groups: int = 5) -> Value:
    """An array: the mean of y in each of the groups of x's ranks."""
    bucket = p.each(lambda r: F.ceil(r * int(groups)), cs_rank(p, x))
    return p.over(lambda b, g: F.array(*(F.avg(F.when(g == k, b)).over(p.across) for k in range(1, int(groups) + 1))), y, bucket)


@operator("vvnn")
def cs_head_mean(p: Panel, x: Value, y: Value, head: int, tail: int) -> Value:
    """A struct (head, tail): the mean of y at the largest and at the smallest ranks of x."""
    rank = p.over(lambda c: F.struct(_ordinal(p, finite(c)).alias("k"), F.count(finite(c)).over(p.across).alias("n")), x)
    return p.over(lambda b, r: F.struct(F.avg(F.when(r["k"] > r["n"] - int(head), b)).over(p.across).alias("head"), F.avg(F.when(r["k"] <= int(tail), b)).over(p.across).alias("tail")), y, rank)


# distances from all other codes, by sorted prefix sums


def _mean_distance(p: Panel, x: Value) -> Value:
    """The mean of |x - x'| over the other codes: each value's place and the sums below and above it say it."""

    def make(c: Column) -> Column:
        order = p.across.orderBy(c.asc_nulls_last(), "code").rowsBetween(Window.unboundedPreceding, 0)
        n, k, below, whole = F.count(c).over(p.across), F.count(c).over(order), F.sum(c).over(order), F.sum(c).over(p.across)
        return F.when(c.isNotNull(), F.try_divide((2 * k - n) * c - 2 * below + whole, F.nullif(n - 1, F.lit(0))))

    return p.over(make, x)


@operator("v")
def cs_distance(p: Panel, x: Value) -> Value:
    return _mean_distance(p, x)


@operator("nvV", search=True)
def cs_mean_distance(p: Panel, kind: float, *values: Value) -> Value:
    """The mean distance from the other codes in several values: 1 Manhattan, 2 Euclidean over their number."""
    if kind == 1:
        return p.each(lambda *c: sum(c[1:], c[0]), *(_mean_distance(p, v) for v in values))
    from tessera.operators.grouped import mean_euclidean

    return mean_euclidean(p, *values)


@operator("vvNN")
def cs_decompose(p: Panel, x: Value, y: Value, n: float = 4, act: str | int = "sigmoid") -> Value:
    """x times the sigmoid (``act`` 0) or the hyperbolic tangent ("tanh" or 1) of y, clipped by median distances and scaled to 0 to 1."""
    from tessera.operators.registry import OPERATORS

    scaled = OPERATORS["cs_min_max_norm"].make(p, p.flat(cs_mad_winsorize(p, y, n)))
    return p.each((lambda a, b: a * F.tanh(b)) if act in ("tanh", 1) else (lambda a, b: a / (1 + F.exp(-b))), x, scaled)


def get_group_rank_cutpoint(total: int, groups: int, start: int = 1) -> tuple[list[int], list[int]]:
    """(low, high): ranks above low up to high are a group; ``total`` // ``groups`` each, what remains in the last."""
    step = total // groups
    if step < 1:
        raise ValueError("there are more groups than ranks")
    high = [step * (i + 1) + start - 1 for i in range(groups - 1)]
    return [step * i + start - 1 for i in range(groups)], [*high, total + start - 1]


def get_group_quantile_cutpoint(groups: int) -> tuple[list[float], list[float]]:
    """(low, high): shares of the groups; the first begins at -1, so that 0 is within."""
    step = 1 / groups
    return [-1.0, *(step * i for i in range(1, groups))], [*(step * (i + 1) for i in range(groups - 1)), 1.0]
