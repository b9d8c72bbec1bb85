"""Operators over the last d rows of a code that need no array: algebraic window frames."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions.scalar import EPS, finite, ratio
from tessera.operators.registry import operator
from tessera.plans.layers import Panel, Value


def _rolled(make, p: Panel, d: int, *values: Value) -> Value:
    """A window aggregate of the last d rows, NULL in the first d - 1."""
    return p.over(lambda *c: p.full(d, make(*c, p.last(d))), *values)


def _squares(p: Panel, x: Value, d: int) -> Value:
    """The sum of squared deviations in the last d rows, in a fixed order and rounding, as a column of its own."""
    (a,) = p.array(d, x)
    return p.flat(Value(A.squares(a.column), True, a.depth))


def _simple(name: str, make, kinds: str = "vd", search: bool = True) -> None:
    def build(p: Panel, x: Value, d: int) -> Value:
        return _rolled(make, p, int(d), x)

    build.__doc__ = f"{name} of the last d rows, missing ones skipped."
    operator(kinds, name, search=search)(build)


_simple("ts_mean", lambda x, w: F.avg(x).over(w))
_simple("ts_sum", lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0.0)))
_simple("ts_min", lambda x, w: F.min(finite(x)).over(w))
_simple("ts_max", lambda x, w: F.max(finite(x)).over(w))
_simple("ts_stddev", lambda x, w: F.stddev_pop(x).over(w))
_simple("ts_var", lambda x, w: F.var_pop(x).over(w))
_simple("ts_demean", lambda x, w: x - F.avg(x).over(w))
_simple("ts_zscore", lambda x, w: ratio(x - F.avg(x).over(w), F.stddev_pop(x).over(w)))
_simple("ts_skew", lambda x, w: F.when(F.stddev_pop(x).over(w) > EPS, F.skewness(x).over(w)))
_simple("ts_kurt", lambda x, w: F.when(F.var_pop(x).over(w) * F.var_pop(x).over(w) > EPS, F.kurtosis(x).over(w)))
_simple("ts_product", lambda x, w: F.product(F.coalesce(finite(x), F.lit(1.0))).over(w))
_simple("ts_counter", lambda x, w: F.count(x).over(w).cast("double"), search=False)
_simple("ts_demean_sum", lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0.0)) - F.count(x).over(w) * F.avg(x).over(w), search=False)


def _signed_mean(inner, outer):
    """The mean of what ``outer`` makes of the positive part's and of the negative part's mean, parts present only."""

    def make(x: Column, w) -> Column:
        up, down = outer(F.avg(inner(F.when(x > 0, x))).over(w)), -outer(F.avg(inner(F.when(x < 0, -x))).over(w))
        n = up.isNotNull().cast("int") + down.isNotNull().cast("int")
        return F.when(n > 0, (F.coalesce(up, F.lit(0.0)) + F.coalesce(down, F.lit(0.0))) / n)

    return make


_simple("ts_gmean", _signed_mean(F.log, F.exp))
_simple("ts_hmean", _signed_mean(lambda x: 1 / x, lambda m: 1 / m))


@operator("vd", search=True)
def ts_gmean_amean_diff(p: Panel, x: Value, d: int) -> Value:
    return p.each(lambda a, b: a - b, _of(p, "ts_gmean", x, d), _of(p, "ts_mean", x, d))


@operator("vd", search=True)
def ts_hmean_amean_diff(p: Panel, x: Value, d: int) -> Value:
    return p.each(lambda a, b: a - b, _of(p, "ts_hmean", x, d), _of(p, "ts_mean", x, d))


@operator("vd", search=True)
def ts_gmean_hmean_diff(p: Panel, x: Value, d: int) -> Value:
    return p.each(lambda a, b: a - b, _of(p, "ts_gmean", x, d), _of(p, "ts_hmean", x, d))


def _of(p: Panel, name: str, *args) -> Value:
    from tessera.operators.registry import OPERATORS

    return OPERATORS[name].make(p, *args)


@operator("vd", search=True)
def ts_delay(p: Panel, x: Value, d: int) -> Value:
    return p.over(lambda c: F.lag(c, int(d)).over(p.history), x)


@operator("vd", causal=False)
def ts_shift(p: Panel, x: Value, d: int) -> Value:
    """The value d rows ahead."""
    return p.over(lambda c: F.lead(c, int(d)).over(p.history), x)


@operator("v", causal=False)
def ts_pct(p: Panel, x: Value) -> Value:
    """The relative change to the next row."""
    return p.over(lambda c: finite(F.try_divide(F.lead(c).over(p.history) - c, c)), x)


@operator("vd", search=True)
def ts_delta(p: Panel, x: Value, d: int) -> Value:
    return p.over(lambda c: c - F.lag(c, int(d)).over(p.history), x)


@operator("vd", search=True)
def ts_return(p: Panel, x: Value, d: int) -> Value:
    return p.over(lambda c: ratio(c - F.lag(c, int(d)).over(p.history), F.lag(c, int(d)).over(p.history)), x)


@operator("vd", search=True)
def ts_mean_return(p: Panel, x: Value, d: int) -> Value:
    return _of(p, "ts_mean", ts_return(p, x, 1), d)


@operator("vd", search=True)
def ts_log_diff(p: Panel, x: Value, d: int) -> Value:
    """ln x less ln of x d rows ago; NULL unless both are positive."""
    positive = lambda c: F.when(c > 0, F.log(c))
    return p.over(lambda c: positive(c) - F.lag(positive(c), int(d)).over(p.history), x)


@operator("v")
def ts_diff_rows(p: Panel, x: Value) -> Value:
    """First differences; the first row itself."""
    return p.over(lambda c: F.when(F.col("t") == 0, c).otherwise(c - F.lag(c).over(p.history)), x)


@operator("vd")
def ts_fill(p: Panel, x: Value, t: int) -> Value:
    """Missing cells take the last value of at most t rows ago."""
    return p.over(lambda c: F.last(c, ignorenulls=True).over(p.history.rowsBetween(-int(t), 0)), x)


@operator("vdq")
def ts_count_above_threshold(p: Panel, x: Value, d: int, f: float) -> Value:
    """How many of the last d rows exceed f; shorter windows at the start count too."""
    return p.over(lambda c: F.count_if(c > F.lit(float(f))).over(p.last(int(d))).cast("double"), x)


@operator("vd")
def ts_psychology(p: Panel, x: Value, d: int) -> Value:
    """The share of rises in the last d steps."""
    up = p.over(lambda c: (c > F.lag(c).over(p.history)).cast("double"), x)
    return p.over(lambda u: p.full(int(d), F.coalesce(F.sum(u).over(p.last(int(d))), F.lit(0.0)) / int(d)), up)


# quantiles


@operator("vqd", search=True)
def ts_quantile(p: Panel, x: Value, q: float, d: int) -> Value:
    return _rolled(lambda c, w: F.percentile(c, F.lit(float(q))).over(w), p, int(d), x)


@operator("vqd", search=True)
def ts_qua(p: Panel, x: Value, q: float, d: int) -> Value:
    """The quantile over the mean."""
    return _rolled(lambda c, w: F.try_divide(F.percentile(c, F.lit(float(q))).over(w), F.nullif(F.avg(c).over(w), F.lit(0.0))), p, int(d), x)


@operator("vdq")
def ts_conc(p: Panel, x: Value, d: int, q: float) -> Value:
    """Concentration: the sum of q-th powers over the q-th power of the sum, of sizes for q <= 1."""
    size = F.abs if q <= 1 else (lambda c: c)
    e = F.lit(float(q))
    return _rolled(lambda c, w: ratio(F.sum(finite(F.pow(size(c), e))).over(w), finite(F.pow(F.sum(size(c)).over(w), e))), p, int(d), x)


# positions of extremes: the first occurrence wins


def _ago(p: Panel, d: int, x: Value, largest: bool) -> Value:
    """Rows since the extreme of the last d rows."""

    def make(c: Column) -> Column:
        value = finite(c)
        key = F.when(value.isNotNull(), F.struct((value if largest else -value).alias("v"), (-F.col("t")).alias("t")))
        return p.full(d, F.col("t") + F.max(key).over(p.last(d))["t"])

    return p.over(make, x)


@operator("vd", search=True)
def ts_argmin(p: Panel, x: Value, d: int) -> Value:
    """(rows since the minimum + 1) / d."""
    return p.each(lambda a: (a + 1) / F.lit(float(d)), _ago(p, int(d), x, False))


@operator("vd", search=True)
def ts_argmax(p: Panel, x: Value, d: int) -> Value:
    """(rows since the maximum + 1) / d."""
    return p.each(lambda a: (a + 1) / F.lit(float(d)), _ago(p, int(d), x, True))


@operator("vd")
def ts_dist_to_high(p: Panel, x: Value, d: int) -> Value:
    return p.each(lambda a: a.cast("double"), _ago(p, int(d), x, True))


@operator("vd")
def ts_dist_to_min(p: Panel, x: Value, d: int) -> Value:
    """Rows since the minimum; a missing cell counts as the smallest."""
    return p.each(lambda a: a.cast("double"), _ago(p, int(d), p.each(lambda c: F.coalesce(finite(c), F.lit(-1e308)), x), False))


# weights that depend on age only


@operator("vd", search=True)
def ts_decay_linear(p: Panel, x: Value, d: int) -> Value:
    """Weights 1 to d (the newest), over their sum; missing cells count 0."""
    d = int(d)

    def make(c: Column) -> Column:
        out = F.lit(0.0)
        for k in range(d):
            out = out + F.coalesce(F.lag(c, k).over(p.history) if k else c, F.lit(0.0)) * (2 * (d - k) / (d * (d + 1)))
        return p.full(d, out)

    return p.over(make, x)


def _ewma_weights(d: int, alpha: float | None) -> list[float]:
    """Of ages d - 1 down to 0: (1 - alpha) ** (d ... 1)."""
    alpha = 1 - 2 / (d + 1) if alpha is None else alpha
    return [(1 - alpha) ** k for k in range(d, 0, -1)]


@operator("vdE", search=True)
def ts_ewma(p: Panel, x: Value, d: int, alpha: float | None = None) -> Value:
    """A weighted mean of the last d rows; the first row is itself."""
    d, weights = int(d), _ewma_weights(int(d), alpha)

    def make(c: Column) -> Column:
        out = F.lit(0.0)
        for k in range(d):
            out = out + F.coalesce(F.lag(c, k).over(p.history) if k else c, F.lit(0.0)) * (weights[d - 1 - k] / sum(weights))
        return F.when(F.col("t") == 0, c).otherwise(p.full(d, out))

    return p.over(make, x)


@operator("vd", search=True)
def ts_poly2_trend(p: Panel, x: Value, d: int) -> Value:
    """The linear coefficient of a quadratic fit to time 0 to d - 1, times its R2; NULL with a missing cell.

    For a fixed d the fit is a fixed matrix, so that it is a sum of lags.
    """
    import numpy as np

    d = int(d)
    design = np.vander(np.arange(d, dtype=float), 3, increasing=True)
    solve = np.linalg.pinv(design)
    hat = design @ solve
    cells = p.over(lambda c: F.array(*(F.lag(c, d - 1 - k).over(p.history) if k < d - 1 else c for k in range(d))), x)

    def make(a: Column) -> Column:
        at = [F.get(a, F.lit(k)) for k in range(d)]
        dot = lambda row: sum((v * float(r) for v, r in zip(at, row, strict=True)), F.lit(0.0))
        m = sum(at, F.lit(0.0)) / d
        rest = sum((F.pow(at[k] - dot(hat[k]), F.lit(2)) for k in range(d)), F.lit(0.0))
        whole = sum((F.pow(v - m, F.lit(2)) for v in at), F.lit(0.0))
        return p.full(d, dot(solve[1]) * (1 - ratio(rest, whole)))

    return p.each(make, p.flat(cells))


# extremes


@operator("vdN", search=True)
def ts_scale(p: Panel, x: Value, d: int, constant: float = 0) -> Value:
    return _rolled(lambda c, w: finite(F.try_divide(c - F.min(c).over(w), F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0))) + constant), p, int(d), x)


@operator("vdnn")
def ts_norm2interval(p: Panel, x: Value, d: int, up: float, down: float) -> Value:
    return p.each(lambda c: c * (up - down) + down, ts_scale(p, x, d))


@operator("vd", search=True)
def ts_min_max_norm(p: Panel, x: Value, d: int) -> Value:
    """Rolling min-max scaling; 0.5 where the window is flat."""
    return _rolled(lambda c, w: F.when(F.max(c).over(w) - F.min(c).over(w) <= EPS, F.when(c.isNotNull(), 0.5)).otherwise(F.try_divide(c - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w))), p, int(d), x)


@operator("vdB", search=True)
def ts_max_change(p: Panel, x: Value, least_d: int = 1, drawdown: bool = True) -> Value:
    """The expanding maximum over the value less 1 (or the minimum), from row least_d - 1 on."""
    extreme = F.max if drawdown else F.min
    return p.over(lambda c: p.full(int(least_d), ratio(extreme(c).over(p.history.rowsBetween(Window.unboundedPreceding, 0)), c) - 1), x)


# two values: each side is demeaned by its own mean, products are of pairs


def _sums(p: Panel, x: Value, y: Value, d: int) -> Value:
    """A struct (xy, xx, yy, mx, my) of the last d rows: sums about each side's own mean, laid down once for a pair."""
    a, b = p.flat(x), p.flat(y)
    key = ("sums", d, str(a.column), str(b.column))
    if key not in p.memo:

        def make(x: Column, y: Column) -> Column:
            w = p.last(d)
            pair = x.isNotNull() & y.isNotNull()
            px, py = F.when(pair, x), F.when(pair, y)
            return F.struct(
                F.count(px).over(w).alias("n"), F.avg(px).over(w).alias("px"), F.avg(py).over(w).alias("py"), F.covar_pop(px, py).over(w).alias("c"),
                F.avg(x).over(w).alias("mx"), F.avg(y).over(w).alias("my"), (F.var_pop(x).over(w) * F.count(x).over(w)).alias("xx"), (F.var_pop(y).over(w) * F.count(y).over(w)).alias("yy"),
            )

        raw = p.flat(p.over(make, a, b))
        # products of pairs about the pairs' own means first, then moved to each side's: no large terms cancel
        xy = lambda r: F.coalesce(r["c"], F.lit(0.0)) * r["n"] + r["n"] * F.coalesce((r["px"] - r["mx"]) * (r["py"] - r["my"]), F.lit(0.0))
        whole = p.each(lambda r: F.struct(xy(r).alias("xy"), r["xx"].alias("xx"), r["yy"].alias("yy"), r["mx"].alias("mx"), r["my"].alias("my")), raw)
        p.memo[key] = p.flat(Value(whole.column, True, whole.depth))
    return p.memo[key]


def _paired(p: Panel, x: Value, y: Value, d: int, make) -> Value:
    """make() of the pair's sums, NULL in the first d - 1 rows."""
    return p.each(lambda s: p.full(int(d), finite(make(s))), _sums(p, x, y, int(d)))


@operator("vvd", search=True)
def ts_corr(p: Panel, x: Value, y: Value, d: int) -> Value:
    """Pearson correlation; NULL where a side has no spread."""
    return _paired(p, x, y, d, lambda s: F.when((F.sqrt(s["xx"]) > EPS) & (F.sqrt(s["yy"]) > EPS), F.try_divide(s["xy"], F.sqrt(s["xx"]) * F.sqrt(s["yy"]))))


@operator("vvd", search=True)
def ts_cov(p: Panel, x: Value, y: Value, d: int) -> Value:
    """The sum of products of deviations over d."""
    return _paired(p, x, y, d, lambda s: s["xy"] / int(d))


@operator("vdd", search=True)
def ts_autocorr(p: Panel, x: Value, d: int, shift: int) -> Value:
    return ts_corr(p, x, ts_delay(p, x, shift), d)


@operator("vvd")
def ts_cos_similar(p: Panel, x: Value, y: Value, d: int) -> Value:
    return _rolled(lambda a, b, w: ratio(F.coalesce(F.sum(a * b).over(w), F.lit(0.0)), F.sqrt(F.sum(a * a).over(w)) * F.sqrt(F.sum(b * b).over(w))), p, int(d), x, y)


@operator("vdd")
def ts_autocos(p: Panel, x: Value, d: int, shift: int) -> Value:
    return ts_cos_similar(p, x, ts_delay(p, x, shift), d)


@operator("vvd", search=True)
def ts_regbeta(p: Panel, x: Value, y: Value, d: int) -> Value:
    """The slope of y on x."""
    return _paired(p, x, y, d, lambda s: ratio(s["xy"], s["xx"]))


@operator("vvd", search=True)
def ts_regres(p: Panel, x: Value, y: Value, d: int) -> Value:
    """y less slope times x."""
    return p.each(lambda a, b, beta: b - beta * a, x, y, ts_regbeta(p, x, y, d))


def _fit(name: str, make, search: bool = True) -> None:
    """A statistic of the regression of y on x from (Sxy, Sxx, Syy, d)."""

    def build(p: Panel, x: Value, y: Value, d: int) -> Value:
        return _paired(p, x, y, d, lambda s: make(s["xy"], s["xx"], s["yy"], int(d)))

    build.__doc__ = f"{name}: y on x over the last d rows."
    operator("vvd", name, search=search)(build)


def _rss(sxy: Column, sxx: Column, syy: Column) -> Column:
    return F.greatest(syy - F.try_divide(sxy * sxy, F.nullif(sxx, F.lit(0.0))), F.lit(0.0))


_fit("ts_reg_r2", lambda xy, xx, yy, d: ratio(xy * xy, xx * yy))
_fit("ts_reg_betase", lambda xy, xx, yy, d: F.sqrt(ratio(_rss(xy, xx, yy), xx * (d - 2))))
_fit("ts_reg_resse", lambda xy, xx, yy, d: F.sqrt(_rss(xy, xx, yy) / (d - 1)))
_fit("ts_reg_tval", lambda xy, xx, yy, d: ratio(ratio(xy, xx), F.sqrt(_rss(xy, xx, yy)) / d))
_fit("ts_reg_Fvalue", lambda xy, xx, yy, d: ratio((d - 2) * ratio(xy * xy, xx * yy), 1 - ratio(xy * xy, xx * yy)))
# these three take the covariance's sum over the variance's mean for the slope: d times the usual one
_fit("ts_regsse", lambda xy, xx, yy, d: yy - 2 * ratio(xy, xx / d) * xy + F.pow(ratio(xy, xx / d), F.lit(2)) * xx, search=False)
_fit("ts_reg_rsquare", lambda xy, xx, yy, d: 1 - ratio(yy - 2 * ratio(xy, xx / d) * xy + F.pow(ratio(xy, xx / d), F.lit(2)) * xx, yy))
_fit("ts_reg_tvalue", lambda xy, xx, yy, d: ratio(ratio(xy, xx / d), F.sqrt(ratio(yy - 2 * ratio(xy, xx / d) * xy + F.pow(ratio(xy, xx / d), F.lit(2)) * xx, xx / d * (d - 2)))))


@operator("vvdN")
def ts_ridgebeta(p: Panel, x: Value, y: Value, d: int, lambda_: float = 0.1) -> Value:
    """The slope with a ridge: Sxy / (Sxx + lambda)."""
    return _paired(p, x, y, d, lambda s: F.try_divide(s["xy"], s["xx"] + lambda_))


@operator("vvdN")
def ts_ridgepred(p: Panel, x: Value, y: Value, d: int, lambda_: float = 0.1) -> Value:
    """What the ridge slope predicts for the last row."""
    return p.each(lambda a, s: p.full(int(d), s["my"] + F.try_divide(s["xy"], s["xx"] + lambda_) * (a - s["mx"])), x, _sums(p, x, y, int(d)))


@operator("vvvd", search=True)
def ts_partial_corr(p: Panel, x: Value, y: Value, z: Value, d: int) -> Value:
    """The correlation of x and y with z held fixed."""
    xy, xz, yz = ts_corr(p, x, y, d), ts_corr(p, x, z, d), ts_corr(p, y, z, d)
    return p.each(lambda a, b, c: ratio(a - b * c, F.sqrt(F.greatest((1 - b * b) * (1 - c * c), F.lit(0.0)))), xy, xz, yz)


@operator("vd", search=True)
def ts_first_deriv(p: Panel, x: Value, d: int) -> Value:
    """The slope of time on the value."""

    def make(c: Column, s: Column, w) -> Column:
        n = F.count(c).over(w)
        filled = F.coalesce(F.sum((F.col("t")) * c).over(w) - F.avg(c).over(w) * F.sum(F.when(c.isNotNull(), F.col("t"))).over(w), F.lit(0.0))
        return F.try_divide(filled, F.nullif(F.try_divide(s, n) * n, F.lit(0.0)))

    return _rolled(make, p, int(d), x, _squares(p, x, int(d)))


@operator("vdD", search=True)
def ts_second_deriv(p: Panel, x: Value, d1: int, d2: int | None = None) -> Value:
    d2 = int(d2 or d1)
    return p.each(lambda c: p.full(int(d1) + d2 - 1, c), ts_first_deriv(p, ts_first_deriv(p, x, d1), d2))


@operator("vd", search=True)
def ts_mad_mean(p: Panel, x: Value, d: int) -> Value:
    """The mean of distances from the rolling mean."""
    return _of(p, "ts_mean", p.each(F.abs, _of(p, "ts_demean", x, d)), d)


@operator("vd", search=True, causal=False)
def ts_std_ratio(p: Panel, x: Value, d: int) -> Value:
    """Sample deviation of what is at least 0 over that of what is below, in the window."""
    return _rolled(lambda c, w: ratio(F.stddev_samp(F.when(c >= 0, c)).over(w), F.stddev_samp(F.when(c < 0, c)).over(w)), p, int(d), x)


# accumulation along another value's moves; a missing cell in the window makes the result missing


def _along(p: Panel, x: Value, y: Value, d: int, step, product: bool) -> Value:
    d = int(d)
    moved = p.over(lambda a, b: step(a, F.lag(a).over(p.history), b, F.lag(b).over(p.history)), x, y)

    def make(a: Column, b: Column, m: Column) -> Column:
        tail = p.history.rowsBetween(-(d - 2), 0)
        whole = (F.count(a).over(p.last(d)) == d) & (F.count(b).over(p.last(d)) == d)
        first = F.lag(a, d - 1).over(p.history)
        grown = first * F.product(m).over(tail) if product else first + F.sum(m).over(tail)
        return p.full(d, F.when(whole, finite(grown) if d > 1 else a))

    return p.over(make, x, y, moved)


@operator("vvd", search=True)
def ts_obp(p: Panel, x: Value, y: Value, d: int) -> Value:
    """The window's first x, plus x where y rose, less x where it fell."""
    return _along(p, x, y, d, lambda a, _, b, b0: F.when(b > b0, a).when(b < b0, -a).otherwise(0.0), False)


@operator("vvd", search=True)
def ts_obn(p: Panel, x: Value, y: Value, d: int) -> Value:
    return _along(p, x, y, d, lambda a, _, b, b0: F.when(b > b0, -a).when(b < b0, a).otherwise(0.0), False)


@operator("vvd", search=True)
def ts_obpm(p: Panel, x: Value, y: Value, d: int) -> Value:
    """The window's first x times the growth of x where y rose."""
    return _along(p, x, y, d, lambda a, a0, b, b0: F.when(b > b0, F.try_divide(a, F.nullif(a0, F.lit(0.0)))).otherwise(1.0), True)


@operator("vvd", search=True)
def ts_obnm(p: Panel, x: Value, y: Value, d: int) -> Value:
    return _along(p, x, y, d, lambda a, a0, b, b0: F.when(b < b0, F.try_divide(a, F.nullif(a0, F.lit(0.0)))).otherwise(1.0), True)


# volatility of what remains after the cross-section's mean


def _volatility(name: str, keep) -> None:
    def build(p: Panel, x: Value, d: int) -> Value:
        rest = p.over(lambda c: c - F.avg(c).over(p.across), x)
        return p.over(lambda c, r: p.full(int(d), ratio(c, F.stddev_pop(keep(r)).over(p.last(int(d))))), x, rest)

    operator("vd", name, search=True)(build)


_volatility("ts_all_volatility", lambda r: r)
_volatility("ts_upside_volatility", lambda r: F.when(r > 0, r))
_volatility("ts_downside_volatility", lambda r: F.when(r < 0, r))


@operator("vddB", search=True)
def ts_autocorr_reg(p: Panel, x: Value, d: int, k: int, beta: bool = True) -> Value:
    """The slope (or intercept) of the autocorrelations 1 to k on the logarithm of their lag."""
    import numpy as np

    k = int(k)
    lx = np.log(np.arange(1, k + 1))
    weight = (lx - lx.mean()) / ((lx - lx.mean()) ** 2).sum()
    found = [ts_autocorr(p, x, d, i) for i in range(1, k + 1)]

    def make(*a: Column) -> Column:
        slope = sum((c * float(w) for c, w in zip(a, weight, strict=True)), F.lit(0.0))
        out = slope if beta else sum(a, F.lit(0.0)) / k - slope * float(lx.mean())
        return p.full(int(d) + k, out)

    return p.each(make, *found)


@operator("vd")
def ts_hawkes_pred_exp_fast(p: Panel, x: Value, d: int) -> Value:
    """Mean intensity plus excitation decaying exponentially: alpha the variance, beta 1 / mean of the last d rows (missing: 0)."""
    return _hawkes(p, x, int(d), lambda beta, age: F.exp(-beta * age))


@operator("vdN")
def ts_hawkes_pred_powerlaw_fast(p: Panel, x: Value, d: int, power: float = 1.5) -> Value:
    """The same with a power law of age + 1 for the decay."""
    return _hawkes(p, x, int(d), lambda beta, age: F.lit(float((age + 1) ** -power)))


def _hawkes(p: Panel, x: Value, d: int, decay) -> Value:
    zero = p.each(lambda c: F.coalesce(c, F.lit(0.0)), x)

    def make(c: Column) -> Column:
        w = p.last(d)
        mu = F.avg(c).over(w)
        alpha = F.least(F.greatest(F.var_samp(c).over(w), F.lit(1e-8)), F.lit(1e4))
        beta = F.least(F.greatest(F.try_divide(F.lit(1.0), F.nullif(mu + 1e-8, F.lit(0.0))), F.lit(1e-8)), F.lit(1e4))
        excited = F.lit(0.0)
        for age in range(d):
            excited = excited + F.coalesce(F.lag(c, age).over(p.history) if age else c, F.lit(0.0)) * decay(beta, age)
        early = F.when(F.col("t") == 0, c).otherwise(F.avg(c).over(p.history.rowsBetween(-10, -1)))
        return F.when(F.col("t") < d - 1, early).otherwise(F.least(F.greatest(mu + alpha * excited, F.lit(0.0)), F.lit(1e4)))

    return p.over(make, zero)


@operator("vvDDQNN", causal=False)
def ts_adaptive_sampling(p: Panel, x: Value, y: Value, base_window: int = 20, state_window: int = 60, quantile_level: float = 0.7, trend_coef: float = 1.2, noise_coef: float = 0.8) -> Value:
    """x held at trigger rows: where y reaches a threshold, its quantile over the last ``state_window`` rows times two factors.

    One is ``trend_coef`` where the mean of the last ``base_window`` rows is above that of the last ``state_window``, else 1; the other
    is ``trend_coef`` where the deviation of the last ``base_window`` rows is above the code's median of them over its whole
    history, else ``noise_coef``. Before a window is full its first full value counts. Before the first trigger x is that of the first row.
    """
    whole = lambda: p.history.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    started = lambda v: p.over(lambda c: F.coalesce(c, F.first(c, ignorenulls=True).over(whole())), v)
    last = lambda f, d: started(p.over(lambda b: p.full(d, f(b).over(p.last(d))), y))
    level = last(lambda b: F.percentile(b, F.lit(quantile_level)), state_window)
    short, long = last(F.avg, base_window), last(F.avg, state_window)
    deviation = lambda s, c: p.full(base_window, F.sqrt(F.try_divide(s, F.nullif(F.count(c).over(p.last(base_window)) - 1, F.lit(0)))))
    spread = started(p.over(deviation, _squares(p, y, int(base_window)), y))
    calm = p.over(lambda s: F.percentile(s, F.lit(0.5)).over(p.across.partitionBy("code")), spread)
    threshold = p.each(lambda q, a, b, s, m: q * F.when(a > b, trend_coef).otherwise(1.0) * F.when(s > m, trend_coef).otherwise(noise_coef), level, short, long, spread, calm)
    return p.over(lambda a, b, q: F.coalesce(F.last(F.when(b >= q, a), ignorenulls=True).over(p.history.rowsBetween(Window.unboundedPreceding, 0)), F.first(a).over(whole())), x, y, threshold)
