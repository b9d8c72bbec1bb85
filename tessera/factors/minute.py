"""Minute factor families over one-minute bars of a stock-day (open, high, low, close, volume in order of t).

``var`` is windows only. The other families are numpy over one stock-day (rolling windows take what is there), run in one
``applyInArrow`` pass for all of them; a family's outputs are named family_output. ``snapshot`` keeps the last bar.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.factors.recursion import _rolling, _shift, ewm, span
from tessera.plans.layers import ends, whole_groups

EPS, SMALL = 1e-9, 1e-5


def _window(x: np.ndarray, w: int) -> np.ndarray:
    """The last w values of each row, NaN before the first."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(w - 1, np.nan), x)), w)


def _count(x: np.ndarray, w: int) -> np.ndarray:
    return (~np.isnan(_window(x, w))).sum(1)


def _sum(x: np.ndarray, w: int) -> np.ndarray:
    return np.where(_count(x, w) > 0, np.nansum(_window(x, w), 1), np.nan)


def _mean(x: np.ndarray, w: int) -> np.ndarray:
    return _sum(x, w) / np.maximum(_count(x, w), 1)


def _centred(x: np.ndarray, w: int) -> np.ndarray:
    return _window(x, w) - _mean(x, w)[:, None]


def _std(x: np.ndarray, w: int) -> np.ndarray:
    n = _count(x, w)
    return np.where(n > 1, np.sqrt(np.nansum(_centred(x, w) ** 2, 1) / np.maximum(n - 1, 1)), np.nan)


def _max(x: np.ndarray, w: int) -> np.ndarray:
    return _rolling(np.max, x, w)


def _min(x: np.ndarray, w: int) -> np.ndarray:
    return _rolling(np.min, x, w)


def _moment(x: np.ndarray, w: int, k: int) -> np.ndarray:
    """Sample skewness (k 3) or excess kurtosis (k 4) of the last w values, bias-corrected; 0 where all are equal."""
    d, n = _centred(x, w), _count(x, w).astype(float)
    m2, mk = np.nansum(d**2, 1) / np.maximum(n, 1), np.nansum(d**k, 1) / np.maximum(n, 1)
    flat = m2 < 1e-28
    g = mk / np.where(flat, 1, m2) ** (k / 2)
    fixed = g * np.sqrt(n * (n - 1)) / np.where(n > 2, n - 2, 1) if k == 3 else (n - 1) / np.where(n > 3, (n - 2) * (n - 3), 1) * ((n + 1) * (g - 3) + 6)
    return np.where(n >= k, np.where(flat, 0.0, fixed), np.nan)


def _corr(x: np.ndarray, y: np.ndarray, w: int) -> np.ndarray:
    """Correlation of the last w pairs, of which two are needed; 0 where one of them does not vary."""
    x, y = np.where(np.isnan(y), np.nan, x), np.where(np.isnan(x), np.nan, y)
    a, b = _centred(x, w), _centred(y, w)
    sx, sy = np.nansum(a * a, 1), np.nansum(b * b, 1)
    varies = (sx > EPS) & (sy > EPS)
    return np.where(_count(x, w) > 1, np.where(varies, np.nansum(a * b, 1) / np.sqrt(np.where(varies, sx * sy, 1)), 0.0), np.nan)


def _unless_small(divisor: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x, 0 where the divisor is at most EPS."""
    return np.where(divisor <= EPS, 0.0, x)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(np.abs(b) <= EPS, 0.0, a / b)


def _or_own(x: np.ndarray) -> np.ndarray:
    """The value before, the own one where there is none."""
    before = _shift(x)
    return np.where(np.isnan(before), x, before)


def _true_range(h, low, c) -> np.ndarray:
    p = _shift(c)
    return np.fmax(h - low, np.fmax(np.abs(h - p), np.abs(low - p)))


def osod(o, h, low, c, v) -> dict[str, np.ndarray]:
    """Overbought and oversold: KDJ, bias, BR and AR, CCI (against the close, not the typical price)."""
    lo9, hi9 = _min(low, 9), _max(h, 9)
    rsv = 100 * (c - lo9) / (hi9 - lo9 + SMALL)
    k = ewm(np.where(np.isnan(rsv), 50.0, rsv), 1 / 3)
    d = ewm(k, 1 / 3)
    out = {"k": k, "d": d, "j": 3 * k - 2 * d}
    for w in (6, 12, 24):
        out |= {f"ma_{w}": _mean(c, w), f"bias_{w}": 100 * (c - _mean(c, w)) / _mean(c, w)}
    p = _or_own(c)
    for w in (7, 13, 26):
        out |= {f"br_{w}": 100 * _share(_sum(h - p, w), _sum(p - low, w)), f"ar_{w}": 100 * _share(_sum(h - o, w), _sum(o - low, w))}
    tp = (h + low + c) / 3
    for w in (5, 10, 20):
        mean = _mean(tp, w)
        out[f"cci_{w}"] = 100 * (tp - mean) / (_mean(np.abs(c - mean), w) + SMALL)
    return out


def energy(o, h, low, c, v) -> dict[str, np.ndarray]:
    """Directional movement, swing, strength, money flow."""
    p = _shift(c)
    tr = np.where(np.isnan(p), np.nan, _true_range(h, low, c))
    rise, fall = np.maximum(h - _shift(h), 0), np.maximum(_shift(low) - low, 0)
    dmp, dmn = np.where(rise > fall, rise, 0.0), np.where(rise < fall, fall, 0.0)
    atr = ewm(tr, span(14))
    dip, din = 100 * ewm(dmp, span(14)) / atr, 100 * ewm(dmn, span(14)) / atr
    dx = 100 * np.abs(dip - din) / (dip + din + SMALL)
    lo9, hi9 = _min(low, 9), _max(h, 9)
    swing = 0.5 * (hi9 - c) + 0.5 * (lo9 - c)
    pr = hi9 - lo9 + swing
    si = 15 * (c - _or_own(c) + swing) / (pr + SMALL)
    ret = c / p - 1
    gain, loss, up, down = np.maximum(ret, 0), np.maximum(-ret, 0), (ret > 0).astype(float), (ret < 0).astype(float)
    ag, al = _sum(gain, 14) / (_sum(up, 14) + SMALL), _sum(loss, 14) / (_sum(down, 14) + SMALL)
    flow = (h + low + c) / 3 * v
    return {
        "direction": np.sign(c - p), "tr": tr, "dmp": dmp, "dmn": dmn, "atr": atr, "dip": dip, "din": din, "dx": dx, "adx": ewm(dx, span(14)), "rsv": np.where(hi9 != lo9, 100 * (c - lo9) / (hi9 - lo9 + SMALL), 50.0),
        "pr": pr, "si": si, "asi": np.nancumsum(si), "bbi": (_mean(c, 3) + _mean(c, 6) + _mean(c, 12) + _mean(c, 24)) / 4, "minute_ret": ret, "rsi": 100 - 100 / (1 + _mean(gain, 14) / (_mean(loss, 14) + SMALL)),
        "avg_gain": ag, "avg_loss": al, "rsii": 100 * ag / (ag + al), "money_flow": flow, "mfi": 100 - 100 / (1 + _sum(flow * up, 14) / (_sum(flow * down, 14) + SMALL)), "vr": 100 * _sum(v * up, 12) / (_sum(v * down, 12) + SMALL),
        "obv": np.nancumsum(np.sign(c - p) * v),
    }


def terminal(o, h, low, c, v) -> dict[str, np.ndarray]:
    """Bands and channels: Bollinger, Keltner, mass, Donchian, adaptive line, CR."""
    m, s = _mean(c, 20), _std(c, 20)
    hl, hc, lc = h - low, h - _shift(c), low - _shift(c)
    if len(c) > 1:  # the first bar takes the second one's
        hc[0], lc[0] = hc[1], lc[1]
    center, atr = ewm(c, span(20)), ewm(np.fmax(hl, np.fmax(np.abs(hc), np.abs(lc))), span(20))
    hi, lo = _max(h, 20), _min(low, 20)
    out = {
        "boll_middle": m, "boll_upper": m + 2 * s, "boll_lower": m - 2 * s, "boll_width": 4 * s / c, "boll_pos": (c - m + 2 * s) / (4 * s), "kc_upper": center + 2 * atr, "kc_lower": center - 2 * atr, "kc_width": 4 * atr / c, "kc_pos": (c - center + 2 * atr) / (4 * atr),
        "mass": ewm(_finite(hl / (ewm(c, span(9)) - ewm(c, span(25)))), span(25)), "dc_upper": hi, "dc_lower": lo, "dc_width": (hi - lo) / c, "dc_pos": _unless_small(hi - lo, (c - lo) / (hi - lo)),
    }
    mids = {"1": (2 * c + h + low) / 4, "2": (h + low + c + o) / 4, "3": (h + low + c) / 3, "4": (h + low) / 2}
    alpha = np.abs(mids["1"] - _mean(mids["1"], 20)) / _mean(mids["1"], 20)
    line = np.zeros(len(c))
    for i in range(len(c)):
        line[i] = alpha[i] * c[i] + (1 - alpha[i]) * line[i - 1] if i else c[i]
    out |= {"alpha_xsii": alpha, "xsii": line}
    for name, mid in mids.items():
        q = _shift(mid)
        out[f"cr{name}"] = 100 * _sum(h - q, 26) / (_sum(q - low, 26) + SMALL)
    return out


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, np.nan)


def kline(o, h, low, c, v) -> dict[str, np.ndarray]:
    """Trend: MACD, aroon, price and volume together, counts, volatility."""
    p = _shift(c)
    e12, e26 = ewm(c, span(12)), ewm(c, span(26))
    dif = e12 - e26
    dea = ewm(dif, span(9))
    slope, change = e12 - _shift(e12), c - p
    ret = change / p
    place = lambda f, x: np.array([100.0 * (f(x[i - 24 : i + 1]) + 1) / 25 if i >= 24 else np.nan for i in range(len(x))])
    strength, pv_corr = np.tanh(dif / _max(np.abs(dif), 60)), _corr(ret, _finite(v / _shift(v) - 1), 20)
    up, down = place(np.argmax, h), place(np.argmin, low)
    gap = _mean(v, 12) - _mean(v, 26)
    signed = (c > p) * v - (c < p) * v
    edit = _sum(signed, 20)
    up_std, down_std = _std(np.where(change > 0, change, 0.0), 30), _std(np.where(change < 0, change, 0.0), 30)
    filled = np.nan_to_num(ret)
    skew, kurt = _moment(filled, 30, 3), _moment(filled, 30, 4)
    r30 = ewm(h - low, span(30))
    tp = (h + low + c) / 3
    up_pen, down_pen = np.maximum(h - _shift(tp), 0), np.maximum(_shift(tp) - low, 0)
    hist = dif - dea
    out = {
        "macd_signal": dea, "macd_hist": hist, "hist_slope": hist - _shift(hist, 5), "macd_strength": strength, "macd_gap": np.tanh(hist / _mean(np.abs(dif), 30)), "trend_momentum": np.tanh(dif * slope), "vmacd": gap - _mean(gap, 9),
        "aroon_up": up, "aroon_down": down, "aroon_diff": up - down, "pv_momentum": ret * np.nan_to_num(v / _shift(v)), "pv_corr": pv_corr, "ema_slope": slope, "trend_energy": slope * v, "long_short_energy": strength * pv_corr,
        "ret_skew": skew, "ret_skew_std": _std(skew, 30), "ret_kurt": kurt, "ret_kurt_std": _std(kurt, 30), "signed_vol": signed, "edit": edit, "epi": edit / (_sum(v, 20) + SMALL),
        "up_count": _sum((c > p).astype(float), 30), "down_count": _sum((c < p).astype(float), 30), "up_std": up_std, "down_std": down_std, "rvi": 100 * up_std / (up_std + down_std + SMALL),
        "vol_parkinson": np.log(h / low) ** 2 / (4 * np.log(2)), "chaikin_vol": 100 * (r30 - _shift(r30, 30)) / (_shift(r30, 30) + SMALL),
    }
    for w in (7, 13, 26):
        m = ewm(h - low, span(w))
        out |= {f"ppr_{w}": _share(_mean(up_pen, w), _mean(down_pen, w)), f"cvi_{w}": 100 * (m - _shift(m, w)) / m, f"psy_{w}": _inner_rises(c, w) / w * 100}
    return out


def _inner_rises(c: np.ndarray, w: int) -> np.ndarray:
    """How many changes within the last w values are rises: the first of them has none before it."""
    rose = (np.diff(c, prepend=np.nan) > 0).astype(float)
    return _sum(rose, w) - np.where(np.arange(len(c)) >= w, _shift(rose, w - 1), 0.0) if w > 1 else np.zeros(len(c))


def klineshape(o, h, low, c, v) -> dict[str, np.ndarray]:
    """Candles: where they close, bodies, overlaps, gaps, distances from means and highs; a range of zero gives 0."""
    hl, h1, l1, c1 = h - low, _shift(h), _shift(low), _shift(c)
    before, top, bottom, body, ma, high = h1 - l1, h - np.maximum(c, o), np.minimum(c, o) - low, c - o, _mean(c, 237), _max(h, 237)
    return {
        "close_location": _unless_small(hl, (h + low - 2 * c) / hl), "close_loc_before": _unless_small(before, (h1 + l1 - 2 * c) / before), "candle_ratio": _unless_small(bottom, top / bottom), "candle_skew": _unless_small(hl, (top - bottom) / hl),
        "body_size": body, "body_candle_ratio": np.where(top + bottom <= EPS, body / 1e-3, body / (top + bottom)), "doji": _unless_small(hl, np.abs(body) / hl), "overlap_ratio": _unless_small(before, np.maximum(0, np.minimum(h, h1) - np.maximum(low, l1)) / before),
        "gap_ratio": _unless_small(c1, (o - c1) / c1), "close_position": _unless_small(before, (c - l1) / before), "open_position": _unless_small(before, (o - l1) / before), "ma_bias": (c - ma) / (ma + SMALL), "mdd": 100 * (h - c) / h, "cum_mmd": 100 * (high - c) / high,
    }


FAMILIES: dict[str, Callable[..., dict[str, np.ndarray]]] = {"osod": osod, "energy": energy, "terminal": terminal, "kline": kline, "klineshape": klineshape}


def _all(*bars: np.ndarray) -> dict[str, np.ndarray]:
    with np.errstate(all="ignore"):
        return {f"{f}_{k}": x for f, make in FAMILIES.items() for k, x in make(*bars).items()}


def names() -> list[str]:
    return list(_all(*(np.arange(1.0, 6.0),) * 5))


def families(bars: DataFrame, *keys: str) -> DataFrame:
    """``bars`` with every family's outputs; one task per stock-day (``keys``: code, trade_date)."""
    out = names()
    columns = bars.columns
    schema = StructType([*bars.schema.fields, *(StructField(n, DoubleType()) for n in out)])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        found = _all(*(table.column(c).cast(pa.float64()).to_numpy() for c in ("open", "high", "low", "close", "volume")))
        table = table.select(columns)
        for n in out:
            v = np.asarray(found[n], float)
            table = table.append_column(n, pa.array(v, pa.float64(), mask=~np.isfinite(v)))
        return table

    return bars.groupBy(*(keys or ("code", "trade_date"))).applyInArrow(run, schema)


def var(bars: DataFrame, *keys: str) -> DataFrame:
    """``bars`` with the variance family: realised variance so far, its continuous and jump parts, by sign and size.

    gamma is the whole day's 99 % quantile of |r| and so looks ahead within the day.
    """
    keys = keys or ("code", "trade_date")
    w = Window.partitionBy(*keys).orderBy("t")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    out = bars.withColumn("_r", F.when((F.col("close") > 0) & (F.col("open") > 0), 100 * F.log(F.col("close") / F.col("open"))).otherwise(0.0))
    out = out.withColumns({"_v": F.pow(F.abs(F.col("_r") * F.lag("_r", 1).over(w) * F.lag("_r", 2).over(w)), F.lit(2 / 3)), "_g": F.percentile(F.abs("_r"), F.lit(0.99)).over(Window.partitionBy(*keys))})
    square = F.col("_r") * F.col("_r")
    large = F.abs("_r") > F.col("_g")
    total = lambda x: F.sum(x).over(past)
    sums = {"var_rv": total(square), "var_iv": F.coalesce(total(F.col("_v")), F.lit(0.0)), "var_rvl": total(F.when(large, square).otherwise(0.0)), "var_rsp": total(F.when(F.col("_r") > 0, square).otherwise(0.0)), "var_rsn": total(F.when(F.col("_r") < 0, square).otherwise(0.0)), "var_rvlp": total(F.when(large & (F.col("_r") > 0), square).otherwise(0.0)), "var_rvln": total(F.when(large & (F.col("_r") < 0), square).otherwise(0.0))}
    out = out.withColumns(sums)
    jump = lambda a, b: F.greatest(F.col(a) - b, F.lit(0.0))
    out = out.withColumns({"var_rvj": jump("var_rv", F.col("var_iv")), "var_rvjp": jump("var_rsp", F.col("var_iv") / 2), "var_rvjn": jump("var_rsn", F.col("var_iv") / 2)})
    small = lambda a, b: F.least(F.col(a), F.col(b))
    out = out.withColumns({"var_rvc": F.col("var_rv") - F.col("var_rvj"), "var_rvlj": small("var_rvj", "var_rvl"), "var_rvljp": small("var_rvjp", "var_rvlp"), "var_rvljn": small("var_rvjn", "var_rvln"), "var_srvj": F.col("var_rvjp") - F.col("var_rvjn")})
    return out.withColumns({"var_rvsj": F.col("var_rvj") - F.col("var_rvlj"), "var_rvsjp": F.col("var_rvjp") - F.col("var_rvljp"), "var_rvsjn": F.col("var_rvjn") - F.col("var_rvljn"), "var_srvlj": F.col("var_rvljp") - F.col("var_rvljn")}).withColumn("var_srvsj", F.col("var_rvsjp") - F.col("var_rvsjn")).drop("_r", "_v", "_g")


def snapshot(frame: DataFrame, *keys: str, suffix: str = "_min") -> DataFrame:
    """The last bar of each stock-day, factors renamed with a suffix."""
    keys = keys or ("code", "trade_date")
    plain = {*keys, "t", "open", "high", "low", "close", "volume", "amount", "ts", "n"}
    values = [c for c in frame.columns if c not in plain]
    last = frame.groupBy(*keys).agg(F.max_by(F.struct(*values), "t").alias("_l"))
    return last.select(*keys, *(F.col(f"_l.{c}").alias(c + suffix) for c in values))


# components of the book


def components(x: np.ndarray, n: int = 2, clip: float = 1e6) -> np.ndarray:
    """Scores on the first n axes of columns scaled by their deviation, not centred; each axis's largest loading is positive.

    Cells beyond ``clip`` count as it, missing ones as 0; a column that doesn't vary counts as 0. ``x``: rows by columns, or a stack of such tables.
    """
    if x.ndim == 2:
        return components(x[None], n, clip)[0]
    x = np.clip(np.where(np.isfinite(x), x, 0.0), -clip, clip)
    out = np.zeros((*x.shape[:2], n))
    std = x.std(1) if x.shape[1] else np.zeros(x.shape[::2])
    own = ~(std < 1e-12).all(1)
    if not own.any():
        return out
    x, std = x[own], std[own][:, None]
    scaled = np.where(std > 1e-12, x / np.where(std > 1e-12, std, 1), 0.0)
    _, _, axes = np.linalg.svd(scaled, full_matrices=False)
    axes = axes[:, :n] * np.sign(np.take_along_axis(axes[:, :n], np.abs(axes[:, :n]).argmax(2)[:, :, None], 2))
    out[own, :, : axes.shape[1]] = scaled @ axes.transpose(0, 2, 1)
    return out


def partial_least_squares(x: np.ndarray, y: np.ndarray, n: int = 2) -> np.ndarray:
    """x-scores of n steps of partial least squares of y on x, columns centred and scaled (sample deviation); each weight vector's largest entry is positive.

    Missing cells count as 0; fewer than three rows give 0. ``x``: rows by columns and ``y`` rows, or stacks of such.
    """
    if x.ndim == 2:
        return partial_least_squares(x[None], y[None], n)[0]
    out = np.zeros((*x.shape[:2], n))
    if x.shape[1] < 3:
        return out
    x, y = np.nan_to_num(x), np.nan_to_num(y)
    x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    sx, sy = x.std(1, ddof=1, keepdims=True), y.std(1, ddof=1, keepdims=True)
    x, y = x / np.where(sx > 0, sx, 1), (y / np.where(sy == 0, 1, sy))[:, :, None]
    going = np.ones(len(x), bool)
    for k in range(n):
        w = x.transpose(0, 2, 1) @ y
        size = np.linalg.norm(w, axis=1, keepdims=True)
        going &= size[:, 0, 0] >= 1e-12
        if not going.any():
            break
        w = w / np.where(size > 0, size, 1) * np.sign(np.take_along_axis(w, np.abs(w).argmax(1)[:, None], 1))
        t = x @ w
        out[going, :, k] = t[going, :, 0]
        inner = t.transpose(0, 2, 1) @ t
        inner = np.where(inner == 0, 1.0, inner)
        x = x - t @ ((x.transpose(0, 2, 1) @ t) / inner).transpose(0, 2, 1)
        y = y - t * (t.transpose(0, 2, 1) @ y) / inner
    return out


def strongest_frequencies(x: np.ndarray, window: int = 25, keep: int = 5, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean, last) of each window (shorter ones at the start) rebuilt from the ``keep`` strongest terms of its Fourier transform; of equals the later ones.

    ``place``: of several histories one after the other, each row's place in its own.
    """
    mean, last = np.full(len(x), np.nan), np.full(len(x), np.nan)
    place = np.arange(len(x)) if place is None else place
    size = np.minimum(place + 1, window)
    for m in np.unique(size):  # all windows of a length together
        ends = np.nonzero(size == m)[0]
        f = np.fft.fft(x[ends[:, None] + np.arange(1 - m, 1)], axis=1)
        sound = ~np.isnan(f).any(1)
        ends, f = ends[sound], f[sound]
        np.put_along_axis(f, np.argsort(np.abs(f) ** 2, axis=1, kind="stable")[:, : max(0, m - keep)], 0, axis=1)
        y = np.fft.ifft(f, axis=1).real
        mean[ends], last[ends] = y.mean(1), y[:, -1]
    return mean, last


def domains(level: Callable[[str], np.ndarray]) -> dict[str, np.ndarray]:
    """Columns of the book by what they say: shares of the sizes, imbalance of the first levels together, price steps per size, contrasts of neighbouring levels.

    ``level`` gives a column of the book by name (bp1, ...).
    """
    sizes = {s: np.stack([level(f"{s}v{i}") for i in range(1, 6)], 1) for s in "bs"}
    prices = {s: np.stack([level(f"{s}p{i}") for i in range(1, 6)], 1) for s in "bs"}
    so_far = {s: np.cumsum(v, 1) for s, v in sizes.items()}
    out = {f"order_{s}v": v / (v.sum(1, keepdims=True) + SMALL) for s, v in sizes.items()}
    out["imb"] = (so_far["b"] - so_far["s"]) / (so_far["b"] + so_far["s"] + SMALL)
    for s, label in (("b", "bid"), ("s", "ask")):
        v, p = sizes[s], prices[s]
        out[f"{label}_slope"] = (p - p[:, :1]) / (so_far[s] - v[:, :1] + SMALL)
        out[f"{label}_diff"] = (v[:, :-1] - v[:, 1:]) / (v[:, :-1] + v[:, 1:] + SMALL)
    return out


DOMAINS = ("order_bv", "order_sv", "imb", "bid_slope", "ask_slope", "bid_diff", "ask_diff")


#: Rows of whole groups that are computed together.
TOGETHER = 1 << 15


def _components_of(columns: dict[str, np.ndarray], ends: np.ndarray) -> np.ndarray:
    """The outputs of ``book_components`` for groups one after the other, of which ``ends`` marks the last rows; groups of one length are one stack."""
    last = np.nonzero(ends)[0]
    first = np.concatenate(([0], last[:-1] + 1))
    lengths = last - first + 1
    mid = (columns["bp1"] + columns["sp1"]) / 2
    ahead = np.append(np.diff(mid), np.nan)
    ahead[last] = np.nan
    by_domain = domains(columns.__getitem__)
    values = np.empty((len(mid), 4 * len(DOMAINS) + 2))
    for n in np.unique(lengths):
        rows = first[lengths == n][:, None] + np.arange(n)
        for i, d in enumerate(DOMAINS):
            x = by_domain[d][rows]
            values[rows, 2 * i : 2 * i + 2] = components(x)
            values[rows, 2 * (len(DOMAINS) + i) : 2 * (len(DOMAINS) + i) + 2] = partial_least_squares(x, ahead[rows])
    values[:, -2], values[:, -1] = strongest_frequencies(sum(columns[f"{s}v{i}"] for s in "bs" for i in range(1, 6)), place=np.arange(len(mid)) - np.repeat(first, lengths))
    return values


def book_components(book: DataFrame, *keys: str) -> DataFrame:
    """(keys, t, pca_domain_k, pls_domain_k, fft_mean, fft_last) of a day's five-level book: two components of each of ``DOMAINS`` over the day, and two against the
    next change of the mid (which looks ahead); the total size rebuilt from its strongest frequencies. Groups of ``keys`` (code, trade_date) come sorted, many to a
    call of numpy; a task holds ``TOGETHER`` rows, or its largest group."""
    keys = keys or ("code", "trade_date")
    names = [f"{s}{k}{i}" for s in "bs" for k in "pv" for i in range(1, 6)]
    out = [f"{kind}_{d}_{k}" for kind in ("pca", "pls") for d in DOMAINS for k in (1, 2)] + ["fft_mean", "fft_last"]
    narrow = book.select(*keys, "t", *(F.col(n).cast("double").alias(n) for n in names))
    schema = StructType([*narrow.select(*keys, "t").schema.fields, *(StructField(n, DoubleType()) for n in out)])
    marked = narrow.withColumn("_end", ends(*keys))

    def computed(table: pa.Table) -> list[pa.RecordBatch]:
        columns = {c: table.column(c).to_numpy().astype(float) for c in names}
        values = _components_of(columns, table.column("_end").to_numpy().astype(bool))
        base = table.select([*keys, "t"])
        for i, n in enumerate(out):
            base = base.append_column(n, pa.array(values[:, i], pa.float64(), mask=~np.isfinite(values[:, i])))
        return base.combine_chunks().to_batches()

    def run(batches):
        for table in whole_groups(batches, "_end", TOGETHER):
            yield from computed(table)

    return marked.mapInArrow(run, schema)
