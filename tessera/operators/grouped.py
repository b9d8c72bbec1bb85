"""Operators that no window frame expresses: recursions, eigenvectors, mixtures, rolling least squares.

Each is a numpy kernel over one code's history (or one row index's codes), run by
``Panel.kernel``; ``NaN`` is a missing cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tessera.functions.scalar import EPS, ratio
from tessera.operators.registry import OPERATORS, operator
from tessera.plans.layers import Panel, Value


def windows(x: np.ndarray, d: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, d) if len(x) >= d else np.zeros((0, d))


def padded(x: np.ndarray, n: int) -> np.ndarray:
    """Results of full windows, missing ones before them."""
    return np.concatenate((np.full(n - len(x), np.nan), x))


def _filled(x: np.ndarray) -> np.ndarray:
    """Missing cells of each row as the row's mean."""
    with np.errstate(all="ignore"):
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return np.where(np.isfinite(x), x, np.nanmean(np.where(np.isfinite(x), x, np.nan), axis=-1, keepdims=True))


def _kernel(kinds: str, *names: str, causal: bool = True, search: bool = False, by: str = "code"):
    """Registers compute(arrays..., numbers...) as an operator."""

    def register(compute):
        n = kinds.lower().count("v")

        def make(p: Panel, *args):
            values, numbers = [a for a in args if isinstance(a, Value)], [a for a in args if not isinstance(a, Value)]
            return p.kernel(lambda *arrays: compute(*arrays, *numbers), *values, by=by)

        make.__doc__ = compute.__doc__
        for name in names or (compute.__name__,):
            operator(kinds, name, causal=causal, search=search, grouped=True)(make)
        assert n >= 0
        return compute

    return register


# recursions


@_kernel("vd", search=True)
def ts_ema(x: np.ndarray, d: int) -> np.ndarray:
    """The recursive mean with weight 2 / (d + 1), started at row d - 1 with the window's mean; a missing cell carries it on."""
    d, out = int(d), np.full(len(x), np.nan)
    if len(x) < d or not np.isfinite(x[:d]).any():
        return out
    a, last = 2 / (d + 1), np.nanmean(x[:d])
    out[d - 1] = last
    for i in range(d, len(x)):
        last = a * x[i] + (1 - a) * last if np.isfinite(x[i]) else last
        out[i] = last
    return out


@_kernel("vnd")
def ts_supersmoother_filter(x: np.ndarray, period: float, d: int) -> np.ndarray:
    """The two-pole low-pass recursion with the given cut-off period; NULL in the first d - 1 rows."""
    a = np.exp(-np.sqrt(2) * np.pi / period)
    c2, c3 = 2 * a * np.cos(np.sqrt(2) * np.pi / period), -a * a
    c1, out = 1 - c2 - c3, np.full(len(x), np.nan)
    for i in range(len(x)):
        if i < 2 or not np.isfinite(out[i - 1] + out[i - 2] + x[i - 1]):
            out[i] = x[i]
        else:
            out[i] = c1 * (x[i] + x[i - 1]) / 2 + c2 * out[i - 1] + c3 * out[i - 2]
    out[: int(d) - 1] = np.nan
    return out


# Weights of the two outside series in the variance that ts_garch returns.
OUTSIDE = (0.05, -0.03)


@_kernel("vVV")
def ts_garch(x: np.ndarray, *outside: np.ndarray, rounds: int = 300) -> np.ndarray:
    """The conditional variance of a GARCH(1,1) whose omega, alpha and beta are fitted by likelihood: ``rounds`` steps of Adam from (0.01, 0.1, 0.8).

    One or two outside series enter the likelihood with weights that are fitted too; in the variance that is returned
    they have the weights ``OUTSIDE``. Missing cells count as 0; where alpha + beta reaches 1 the result is missing.
    """
    if not len(x):
        return np.zeros(0)
    e2 = np.nan_to_num(x) ** 2
    more = [np.nan_to_num(y) for y in outside]
    theta = np.array([0.01, 0.1, 0.8, *(0.0 for _ in more)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    with np.errstate(all="ignore"):
        for k in range(1, rounds + 1):
            if theta[1] + theta[2] >= 1:
                break
            h, slopes = _variance(theta, e2, more)
            g = slopes @ (0.5 * (1 / h - e2 / h**2))
            if not np.isfinite(g).all():
                return np.full(len(x), np.nan)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - 0.01 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        if theta[1] + theta[2] >= 1:
            return np.full(len(x), np.nan)
        return _variance(np.array([*theta[:3], *OUTSIDE[: len(more)]]), e2, more)[0]


def _variance(theta: np.ndarray, e2: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The variance path and its derivatives by each parameter: linear recursions with factor beta, as convolutions with its powers."""
    omega, alpha, beta = theta[:3]
    n = len(e2)
    reach = n if abs(beta) >= 1 else min(n, int(-40 / np.log(max(abs(beta), 1e-8))) + 2)  # what lies further back has no weight in a double
    power = beta ** np.arange(n)

    def path(first: float, added: np.ndarray) -> np.ndarray:
        return power * first + np.convolve(np.concatenate(([0.0], added[: n - 1])), power[:reach])[:n]

    rest = 1 - alpha - beta
    h = path(omega / rest, omega + alpha * e2 + sum((w * y for w, y in zip(theta[3:], more, strict=True)), np.zeros(n)))
    by = [path(1 / rest, np.ones(n)), path(omega / rest**2, e2), path(omega / rest**2, h), *(path(0.0, y) for y in more)]
    return h, np.array(by)


# rescaled ranges and entropies


def hurst(x: np.ndarray) -> float:
    """The slope of ln(R/S) on ln(length) over whole chunks of each length that divides the series into 2 to T/2 parts."""
    n = len(x)
    points = []
    for parts in range(2, n // 2 + 1):
        if n % parts:
            continue
        chunks = x.reshape(parts, n // parts)
        dev = chunks - np.nanmean(chunks, 1, keepdims=True)
        run = np.nancumsum(dev, 1)
        s = np.sqrt(np.nanmean(dev * dev, 1))
        rs = (run.max(1) - run.min(1))[s > 1e-9] / s[s > 1e-9]
        if len(rs) and rs.mean() > 0:
            points.append((np.log(n // parts), np.log(rs.mean())))
    if len(points) < 2:
        return np.nan
    a, b = np.array(points).T
    return float(((a - a.mean()) * (b - b.mean())).sum() / ((a - a.mean()) ** 2).sum())


@_kernel("v", causal=False, search=True)
def rs_Hurst(x: np.ndarray) -> np.ndarray:
    """The Hurst exponent of the whole history, in every row."""
    return np.full(len(x), hurst(_filled(x[None])[0]))


@_kernel("vd", causal=False, search=True)
def ts_rs_Hurst(x: np.ndarray, d: int) -> np.ndarray:
    """The Hurst exponent of each block of d rows, in the block's rows."""
    out = np.full(len(x), np.nan)
    for i in range(0, len(x) - int(d) + 1, int(d)):
        out[i : i + int(d)] = hurst(_filled(x[None, i : i + int(d)])[0])
    return out


@_kernel("vndN")
def ts_apen(x: np.ndarray, m: int, d: int, r: float = 0.15) -> np.ndarray:
    """Approximate entropy of each window: patterns of m and m + 1 values within r deviations."""

    def phi(w: np.ndarray, k: int, tolerance: float) -> float:
        p = windows(w, k)
        near = (np.abs(p[:, None] - p[None]).max(2) <= tolerance).mean(1)
        return float(np.log(near).mean())

    out = np.full(len(x), np.nan)
    for i, w in enumerate(windows(x, int(d)), int(d) - 1):
        if np.isfinite(w).all() and w.std() > 0:
            out[i] = phi(w, int(m), r * w.std()) - phi(w, int(m) + 1, r * w.std())
    return out


@_kernel("vddddDDDDD")
def ts_dfa(x: np.ndarray, d: int, k: int, *scales: int) -> np.ndarray:
    """Fluctuation analysis: the slope of ln fluctuation on ln scale for ``scales`` (three to eight, rising).

    The fluctuation at scale s is the root mean square, over k blocks of s rows each, of the profile less each block's mean. The profile
    is the sum of the last d rows' deviations, each from the mean of its own last d rows (from one common mean they add up to
    nothing but rounding errors). Scales that do not reach back far enough take no part; with none the slope is 0.
    """
    n, d = len(x), int(d)
    logs = np.full((n, len(scales)), np.nan)
    import warnings

    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        apart = x - padded(np.nanmean(windows(x, d), 1), n)
        total = padded(np.nansum(windows(apart, d), 1), n)
        for j, s in enumerate(int(s) for s in scales):
            blocks = windows(total, int(k) * s).reshape(-1, int(k), s)
            if len(blocks):
                square = (blocks - np.nanmean(blocks, 2, keepdims=True)) ** 2
                fluctuation = np.sqrt(np.nanmean(square, (1, 2)))
                logs[int(k) * s - 1 :, j] = np.where(fluctuation > 0, np.log(fluctuation), np.nan)
        size = np.log(np.array(scales, float))
        size = size - size.mean()
        return np.nansum((logs - np.nanmean(logs, 1, keepdims=True)) * size, 1) / (size @ size)


# a mixture of two normal distributions in each window


def _mixture(x: np.ndarray, d: int, rounds: int) -> np.ndarray:
    """(mean 1, deviation 1, mean 2, deviation 2) per window, by expectation-maximisation from the median and the 80 % quantile."""
    w = _filled(windows(x, int(d)))
    out = np.full((len(x), 4), np.nan)
    if not len(w):
        return out
    mean = np.stack([np.median(w, 1), np.quantile(w, 0.8, axis=1)], 1)
    std = np.repeat(w.std(1, keepdims=True) + 1e-6, 2, 1)
    weight = np.full(mean.shape, 0.5)
    for _ in range(int(rounds)):
        z = (w[:, None] - mean[:, :, None]) / std[:, :, None]
        density = weight[:, :, None] * np.exp(-0.5 * z * z) / std[:, :, None]
        share = density / (density.sum(1, keepdims=True) + 1e-300)
        n = share.sum(2) + 1e-12
        mean = (share * w[:, None]).sum(2) / n
        std = np.sqrt((share * (w[:, None] - mean[:, :, None]) ** 2).sum(2) / n) + 1e-6
        weight = n / n.sum(1, keepdims=True)
    out[int(d) - 1 :] = np.stack([mean[:, 0], std[:, 0], mean[:, 1], std[:, 1]], 1)
    return out


for _i, _name in enumerate(("ts_gmm_1stmean", "ts_gmm_1ststd", "ts_gmm_2ndmean", "ts_gmm_2ndstd")):
    _kernel("vdN", _name)(lambda x, d, rounds=10, i=_i: _mixture(x, d, rounds)[:, i])


# rolling least squares


def _fits(y: np.ndarray, xs: tuple[np.ndarray, ...], d: int, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients with the intercept first, fitted values, y) of each window; missing cells are the window's means."""
    d = int(d)
    wy = _filled(windows(y, d))
    design = np.stack([np.ones_like(wy), *(_filled(windows(x, d)) for x in xs)], 2)
    ok = np.isfinite(design).all((1, 2)) & np.isfinite(wy).all(1)
    beta = np.full((len(wy), design.shape[2]), np.nan)
    gram = np.einsum("nij,nik->njk", design[ok], design[ok]) + ridge * np.eye(design.shape[2])
    beta[ok] = np.einsum("njk,nk->nj", np.linalg.pinv(gram), np.einsum("nij,ni->nj", design[ok], wy[ok]))
    return beta, np.einsum("nij,nj->ni", design, beta), wy


@_kernel("vdvV")
def ts_multiregsse(y: np.ndarray, *rest) -> np.ndarray:
    """The sum of squared residuals of y on several values."""
    xs, d = rest[:-1], rest[-1]
    _, fit, wy = _fits(y, xs, d)
    return padded(((wy - fit) ** 2).sum(1), len(y))


@_kernel("vdvV")
def ts_multiregrsquare(y: np.ndarray, *rest) -> np.ndarray:
    xs, d = rest[:-1], rest[-1]
    _, fit, wy = _fits(y, xs, d)
    with np.errstate(all="ignore"):
        return padded(1 - ((wy - fit) ** 2).sum(1) / ((wy - wy.mean(1, keepdims=True)) ** 2).sum(1), len(y))


@_kernel("vdvV")
def ts_multiregfvalue(y: np.ndarray, *rest) -> np.ndarray:
    """The F statistic of all slopes together."""
    xs, d = rest[:-1], rest[-1]
    _, fit, wy = _fits(y, xs, d)
    sse, sst = ((wy - fit) ** 2).sum(1), ((wy - wy.mean(1, keepdims=True)) ** 2).sum(1)
    with np.errstate(all="ignore"):
        return padded((sst - sse) / len(xs) / (sse / (int(d) - len(xs) - 1)), len(y))


@_kernel("vdvV")
def ts_multiregbeta(y: np.ndarray, *rest) -> np.ndarray:
    """The mean of the slopes."""
    return padded(_fits(y, rest[:-1], rest[-1])[0][:, 1:].mean(1), len(y))


@_kernel("vdvV")
def ts_multireg_alpha(y: np.ndarray, *rest) -> np.ndarray:
    """The intercept."""
    return padded(_fits(y, rest[:-1], rest[-1])[0][:, 0], len(y))


@_kernel("vvdn")
def ts_multiregression_getparams(y: np.ndarray, x: np.ndarray, d: int, i: int) -> np.ndarray:
    """The i-th coefficient, 0 the intercept."""
    return padded(_fits(y, (x,), d)[0][:, int(i)], len(y))


@_kernel("vvvdn")
def ts_multireg_2d(x1: np.ndarray, x2: np.ndarray, y: np.ndarray, d: int, which: int) -> np.ndarray:
    """Of y on two values: coefficient 0 to 2, 3 the sum of squared residuals."""
    beta, fit, wy = _fits(y, (x1, x2), d)
    return padded(((wy - fit) ** 2).sum(1) if int(which) == 3 else beta[:, int(which)], len(y))


@_kernel("vdnn")
def ts_VAR_get_params(y: np.ndarray, d: int, lags: int, i: int) -> np.ndarray:
    """The i-th coefficient of a rolling autoregression on so many lags, 0 the intercept."""
    xs = tuple(np.concatenate((np.full(k, np.nan), y[: len(y) - k])) for k in range(1, int(lags) + 1))
    return padded(_fits(y, xs, d)[0][:, int(i)], len(y))


@_kernel("vvdN")
def ts_ridgeregression_pred(y: np.ndarray, x: np.ndarray, d: int, lambda_: float = 100.0) -> np.ndarray:
    """The ridge fit's value in the last row; the intercept is penalised too."""
    return padded(_fits(y, (x,), d, lambda_)[1][:, -1], len(y))


@operator("vvdN", grouped=True)
def ts_ridgeregression_res(p: Panel, y: Value, x: Value, d: int, lambda_: float = 100.0) -> Value:
    return p.each(lambda a, b: a - b, y, OPERATORS["ts_ridgeregression_pred"].make(p, y, x, d, lambda_))


@_kernel("vvdN", "ts_reg_NWbetase", "ts_newey_west_se")
def _newey_west(x: np.ndarray, y: np.ndarray, d: int, lags: int | None = None) -> np.ndarray:
    """The slope's standard error robust to autocorrelation (Bartlett weights)."""
    d = int(d)
    lags = int(4 * (d / 100) ** (2 / 9)) if lags is None else int(lags)
    beta, fit, wy = _fits(y, (x,), d)
    wx = _filled(windows(x, d))
    u = (wx - wx.mean(1, keepdims=True)) * (wy - fit)
    s = (u * u).sum(1)
    for k in range(1, lags + 1):
        s = s + 2 * (1 - k / (lags + 1)) * (u[:, k:] * u[:, :-k]).sum(1)
    with np.errstate(all="ignore"):
        return padded(np.sqrt(np.maximum(s, 0)) / ((wx - wx.mean(1, keepdims=True)) ** 2).sum(1), len(y))


# across codes


@_kernel("vvV", by="t")
def cs_multireg_pred(y: np.ndarray, *xs: np.ndarray) -> np.ndarray:
    """The fit of y on several values over the codes."""
    design = np.stack([np.ones_like(y), *xs], 1)
    ok = np.isfinite(design).all(1) & np.isfinite(y)
    out = np.full(len(y), np.nan)
    if ok.sum() > design.shape[1]:
        out[ok] = design[ok] @ np.linalg.lstsq(design[ok], y[ok], rcond=None)[0]
    return out


@_kernel("nvvV", by="t")
def cs_PCA(*args) -> np.ndarray:
    """The codes' scores on a principal component (0 the first) of several standardised values; its largest loading is positive."""
    xs, which = np.stack(args[:-1], 1), int(args[-1])
    ok = np.isfinite(xs).all(1)
    out = np.full(len(xs), np.nan)
    if ok.sum() > 2:
        z = (xs[ok] - xs[ok].mean(0)) / np.where(xs[ok].std(0) > 1e-12, xs[ok].std(0), 1)
        _, vectors = np.linalg.eigh(z.T @ z)
        axis = vectors[:, -1 - which]
        out[ok] = z @ (axis * np.sign(axis[np.abs(axis).argmax()]))
    return out


def _sums_of_distances(own: np.ndarray, tile: int = 256) -> np.ndarray:
    """Each row's Euclidean distances from all rows, added up: square tiles that fit a cache, those above the diagonal for both sides."""
    out, columns = np.zeros(len(own)), np.ascontiguousarray(own.T)
    for i in range(0, len(own), tile):
        for j in range(i, len(own), tile):
            gap = columns[0, i : i + tile, None] - columns[0, None, j : j + tile]
            squares = np.multiply(gap, gap)
            for c in columns[1:]:
                np.subtract(c[i : i + tile, None], c[None, j : j + tile], out=gap)
                squares += np.multiply(gap, gap, out=gap)
            np.sqrt(squares, out=squares)
            out[i : i + tile] += squares.sum(1)
            if j > i:
                out[j : j + tile] += squares.sum(0)
    return out


def mean_euclidean(p: Panel, *values: Value) -> Value:
    """The mean Euclidean distance from the other codes, over the number of values: all pairs of codes of a row index, tile by tile."""

    def compute(*xs: np.ndarray) -> np.ndarray:
        x = np.stack(xs, 1)
        ok = np.isfinite(x).all(1)
        out = np.full(len(x), np.nan)
        if ok.sum() > 1:
            out[ok] = _sums_of_distances(x[ok]) / (ok.sum() - 1) / len(xs)
        return out

    return p.kernel(compute, *values, by="t")


def _with_all(p: Panel, cells: Value, d: int) -> Value:
    """The mean over all codes, the own one included, of the correlation of windows: with unit vectors, their sum says it all."""
    from tessera.functions import arrays as A

    dev = p.flat(Value(A.demeaned(cells.column), True, cells.depth))
    unit = p.each(lambda v: F.when(A.count(v) == d, F.transform(v, lambda e: ratio(e, F.sqrt(A.total(F.transform(v, lambda k: k * k)))))), dev)
    unit = p.flat(Value(unit.column, True, unit.depth))
    both = p.over(lambda u: F.struct(F.array(*(F.sum(F.get(u, F.lit(k))).over(p.across) for k in range(d))).alias("s"), F.count(F.get(u, F.lit(0))).over(p.across).alias("n")), unit)
    mean = p.each(lambda u, s: F.when(F.get(u, F.lit(0)).isNotNull(), F.try_divide(A.total(F.zip_with(u, s["s"], lambda a, b: a * b)), F.nullif(s["n"], F.lit(0)))), unit, p.flat(both))
    return p.flat(Value(mean.column, True, mean.depth))  # a number, so that no further exchange moves the arrays


@operator("vd", search=True)
def cs_marketcorr(p: Panel, x: Value, d: int) -> Value:
    """The mean correlation of a code's last d rows with those of all codes (1 with its own)."""
    (cells,) = p.array(int(d), x)
    return p.each(lambda c: p.full(int(d), c), _with_all(p, cells, int(d)))


@operator("vd", causal=False)
def cs_marketcorr2(p: Panel, x: Value, d: int) -> Value:
    """The same on blocks of d rows, in all the block's rows; the last whole block carries on."""
    d = int(d)
    found = p.flat(cs_marketcorr(p, x, d))
    at_end = p.each(lambda c: F.when((F.col("t") + 1) % d == 0, c), found)
    return p.over(lambda c: F.coalesce(F.first(c, ignorenulls=True).over(p.history.rowsBetween(0, d - 1)), F.last(c, ignorenulls=True).over(p.history.rowsBetween(Window.unboundedPreceding, 0))), at_end)


#: Codes of a block of the matrix of correlations, on average: a task holds the histories of two blocks and a strip of ``STRIP`` rows of their matrix.
BLOCK, STRIP = 4096, 256


def _moments(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(covariance, deviation, deviation) of each column pair over the rows that both have, population, by deviations from the pair's own means."""
    both = np.isfinite(u) & np.isfinite(v)
    n = both.sum(0)
    du, dv = (np.where(both, z - np.where(both, z, 0.0).sum(0) / n, 0.0) for z in (u, v))
    return (du * dv).sum(0) / n, np.sqrt((du * du).sum(0) / n), np.sqrt((dv * dv).sum(0) / n)


def pair_correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlations of the columns of a with those of b over the rows that both have; 0 where one does not vary.

    Products of matrices give the sums of all pairs; pairs whose deviation is small beside its sums are computed again one by one.
    """
    has = [np.isfinite(z).astype(float) for z in (a, b)]
    y = [np.where(h > 0, z, 0.0) for h, z in zip(has, (a, b), strict=True)]
    n = has[0].T @ has[1]
    with np.errstate(all="ignore"):
        ma, mb = y[0].T @ has[1] / n, has[0].T @ y[1] / n
        qa, qb = (y[0] * y[0]).T @ has[1] / n, has[0].T @ (y[1] * y[1]) / n
        va, vb = qa - ma * ma, qb - mb * mb
        cov = y[0].T @ y[1] / n - ma * mb
        unsure = (n > 1) & ((va <= 1e-6 * qa) | (vb <= 1e-6 * qb))
        size = np.sqrt(np.maximum(va, 0)) * np.sqrt(np.maximum(vb, 0))
        i, j = np.nonzero(unsure)
        for k in range(0, len(i), 1 << 14):
            at = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            c, s, r = _moments(a[:, at[0]], b[:, at[1]])
            cov[at], size[at] = c, s * r
        return np.where((n > 1) & (size > EPS), cov / size, 0.0)


def _products(table: pa.Table) -> pa.Table:
    """Of a pair of blocks: for each code of one block, by row index, the sum of x times its correlation over the codes of the other."""
    t = table.column("t").combine_chunks()
    length = max((int(v) for v in [pa.compute.max(t.flatten()).as_py()] if v is not None), default=-1) + 1
    owner, at = np.repeat(np.arange(len(t)), t.value_lengths().to_numpy()), t.flatten().to_numpy()
    x, y = np.full((length, len(t)), np.nan), np.full((length, len(t)), np.nan)
    for field, cells in (("x", x), ("y", y)):
        cells[at, owner] = table.column(field).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    y[~np.isfinite(y)] = np.nan
    x = np.where(np.isfinite(x), x, 0.0)
    with np.errstate(all="ignore"):
        y = y - np.where(np.isfinite(y), y, 0.0).sum(0) / np.isfinite(y).sum(0)  # correlations stay, sums keep more digits
    own, lo, hi = (table.column(c).to_numpy() for c in ("block", "lo", "hi"))
    first, second = np.nonzero(own == lo[0])[0], np.nonzero(own == hi[0])[0]
    out = np.zeros_like(x)
    for k in range(0, len(first), STRIP):
        strip = first[k : k + STRIP]
        c = pair_correlations(y[:, strip], y[:, second])
        out[:, second] += x[:, strip] @ c
        if lo[0] != hi[0]:
            out[:, strip] += x[:, second] @ c.T
    sums = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * length, pa.int32()), pa.array(out.T.ravel()))
    return pa.table({"code": table.column("code"), "other": pa.array(np.where(own == lo, hi, lo)), "sums": sums})


@operator("vv", causal=False)
def cs_marketcorrw(p: Panel, x: Value, y: Value) -> Value:
    """Each row of x times the matrix of the codes' correlations of y over the whole history; 0 becomes NULL.

    The matrix is never laid down: each pair of blocks of codes is one task, which multiplies strips of it by x as it makes them. Its work grows
    with the square of the codes, what is moved with codes times blocks.
    """
    x, y = p.flat(x), p.flat(y)
    frame = p.laid().select("code", F.col("t").cast("int").alias("t"), x.column.cast("double").alias("x"), y.column.cast("double").alias("y"))
    rows = frame.groupBy("code").agg(F.collect_list(F.struct("t", F.coalesce("x", F.lit(math.nan)).alias("x"), F.coalesce("y", F.lit(math.nan)).alias("y"))).alias("r"))
    count = rows.agg(F.greatest(F.ceil(F.count_if(F.size("r") > 0) / BLOCK), F.lit(1)).cast("int").alias("blocks"))  # of what it counts, so that one exchange serves both
    rows = rows.crossJoin(F.broadcast(count)).withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = rows.select("code", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), *(F.col(f"r.{c}").alias(c) for c in "txy"))
    sums = pairs.groupBy("lo", "hi").applyInArrow(_products, StructType([frame.schema["code"], StructField("other", IntegerType()), StructField("sums", ArrayType(DoubleType()))]))
    name = f"_m{len(p.memo)}"
    p.memo[("matrix", name)] = Value(F.col(name))
    add = lambda s, o: F.zip_with(s, o["sums"], lambda u, v: F.coalesce(u, F.lit(0.0)) + F.coalesce(v, F.lit(0.0)))
    whole = sums.groupBy("code").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("other", "sums"))), F.array().cast("array<double>"), add).alias("sums"))
    p.frame = p.frame.join(whole, "code", "left").select(*p.frame.columns, F.nullif(F.get("sums", F.col("t").cast("int")), F.lit(0.0)).alias(name))
    return Value(F.col(name))
