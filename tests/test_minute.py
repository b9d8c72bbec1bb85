"""The minute families against plain pandas, written out from the definitions."""

import numpy as np
import pandas as pd
import pytest

from tessera.factors import minute


@pytest.fixture(scope="module")
def bars():
    rng = np.random.default_rng(9)
    n = 90
    c = 20 + np.cumsum(rng.normal(scale=0.1, size=n)).round(2)
    c[10:14] = c[9]  # a standstill
    o = np.concatenate(([20.0], c[:-1]))
    h, low = np.maximum(o, c) + rng.integers(0, 3, n) / 100, np.minimum(o, c) - rng.integers(0, 3, n) / 100
    return pd.DataFrame({"o": o, "h": h, "l": low, "c": c, "v": rng.integers(0, 50, n).astype(float)})


def wanted(b: pd.DataFrame) -> dict[str, pd.Series]:
    o, h, low, c, v = (b[x] for x in "ohlcv")
    eps = 1e-5
    roll = lambda x, w: x.rolling(w, min_periods=1)
    mean = lambda x, n: x.ewm(span=n, adjust=False).mean()
    tp, prev, own, ret, hl = (h + low + c) / 3, c.shift(1), c.shift(1).fillna(c), c.pct_change(), h - low
    out = {}
    rsv = ((c - roll(low, 9).min()) / (roll(h, 9).max() - roll(low, 9).min() + eps) * 100).fillna(50)
    out["osod_k"] = rsv.ewm(alpha=1 / 3, adjust=False).mean()
    out["osod_j"] = 3 * out["osod_k"] - 2 * out["osod_k"].ewm(alpha=1 / 3, adjust=False).mean()
    out["osod_bias_6"] = (c - roll(c, 6).mean()) / roll(c, 6).mean() * 100
    out["osod_br_13"] = roll(h - own, 13).sum() / roll(own - low, 13).sum() * 100
    out["osod_cci_10"] = (tp - roll(tp, 10).mean()) / (roll((c - roll(tp, 10).mean()).abs(), 10).mean() + eps) * 100
    tr = pd.Series(np.maximum.reduce([hl, (h - prev).abs(), (low - prev).abs()]))
    plus, minus = h.diff().clip(lower=0), (-low.diff()).clip(lower=0)
    atr, dmp, dmn = mean(tr, 14), mean(plus.where(plus > minus, 0), 14), mean(minus.where(plus < minus, 0), 14)
    dx = 100 * (100 * dmp / atr - 100 * dmn / atr).abs() / (100 * dmp / atr + 100 * dmn / atr + eps)
    pr = roll(h, 9).max() - roll(low, 9).min() + 0.5 * (roll(h, 9).max() - c) + 0.5 * (roll(low, 9).min() - c)
    si = 50 * (c - own + 0.5 * (roll(h, 9).max() - c) + 0.5 * (roll(low, 9).min() - c)) / (pr + eps) * 0.3
    gain, loss, up, down = ret.clip(lower=0), -ret.clip(upper=0), (ret > 0).astype(int), (ret < 0).astype(int)
    out |= {"energy_tr": tr, "energy_atr": atr, "energy_adx": mean(dx, 14), "energy_pr": pr, "energy_asi": si.cumsum(), "energy_rsi": 100 - 100 / (1 + roll(gain, 14).mean() / (roll(loss, 14).mean() + eps))}
    ag, al = roll(gain, 14).sum() / (roll(up, 14).sum() + eps), roll(loss, 14).sum() / (roll(down, 14).sum() + eps)
    out |= {"energy_rsii": ag / (ag + al) * 100, "energy_mfi": 100 - 100 / (1 + roll(tp * v * up, 14).sum() / (roll(tp * v * down, 14).sum() + eps)), "energy_vr": roll(v * up, 12).sum() / (roll(v * down, 12).sum() + eps) * 100}
    m, s = roll(c, 20).mean(), roll(c, 20).std()
    ktr = pd.Series(np.maximum.reduce([hl, (h - prev).bfill().abs(), (low - prev).bfill().abs()]))
    mid, band = mean(c, 20), 2 * mean(ktr, 20)
    out |= {"terminal_boll_width": 4 * s / c, "terminal_boll_pos": (c - (m - 2 * s)) / (4 * s), "terminal_kc_width": 2 * band / c, "terminal_kc_pos": (c - (mid - band)) / (2 * band)}
    out["terminal_mass"] = mean((hl / (mean(c, 9) - mean(c, 25))).replace([np.inf, -np.inf], np.nan), 25)
    for k, x in {1: (2 * c + h + low) / 4, 2: (c + h + low + o) / 4, 3: tp, 4: (h + low) / 2}.items():
        out[f"terminal_cr{k}"] = roll(h - x.shift(1), 26).sum() / (roll(x.shift(1) - low, 26).sum() + eps) * 100
    dif = mean(c, 12) - mean(c, 26)
    dea = mean(dif, 9)
    out |= {"kline_macd_hist": dif - dea, "kline_hist_slope": (dif - dea).diff(5), "kline_macd_strength": np.tanh(dif / roll(dif.abs(), 60).max()), "kline_macd_gap": np.tanh((dif - dea) / roll(dif.abs(), 30).mean()), "kline_ema_slope": mean(c, 12).diff()}
    gap = roll(v, 12).mean() - roll(v, 26).mean()
    pen_up, pen_down = (h - tp.shift(1)).clip(lower=0), (tp.shift(1) - low).clip(lower=0)
    filled = ret.fillna(0)
    out |= {"kline_vmacd": gap - roll(gap, 9).mean(), "kline_pv_momentum": ret * (v / v.shift(1)).fillna(0), "kline_ret_skew": roll(filled, 30).apply(lambda x: pd.Series(x).skew()), "kline_ret_kurt": roll(filled, 30).apply(lambda x: pd.Series(x).kurtosis())}
    out["kline_ret_skew_std"] = roll(out["kline_ret_skew"], 30).std()
    signed = (c > prev) * v - (c < prev) * v
    out |= {"kline_epi": roll(signed, 20).sum() / (roll(v, 20).sum() + eps), "kline_up_count": roll((c > prev).astype(int), 30).sum()}
    us, ds = roll(c.diff().where(c.diff() > 0, 0), 30).std(), roll(c.diff().where(c.diff() < 0, 0), 30).std()
    out |= {"kline_rvi": 100 * us / (us + ds + eps), "kline_vol_parkinson": np.log(h / low) ** 2 / (4 * np.log(2)), "kline_chaikin_vol": (mean(hl, 30) - mean(hl, 30).shift(30)) / (mean(hl, 30).shift(30) + eps) * 100}
    for w in (7, 26):
        out[f"kline_ppr_{w}"] = roll(pen_up, w).mean() / roll(pen_down, w).mean()
        out[f"kline_cvi_{w}"] = mean(hl, w).diff(w) / mean(hl, w) * 100
        out[f"kline_psy_{w}"] = roll(c, w).apply(lambda x: (x.diff() > 0).sum() / w * 100)  # noqa: B023
    top, bottom = h - np.maximum(c, o), np.minimum(c, o) - low
    shape = {"close_location": ((h - c) - (c - low)) / hl, "candle_ratio": top / bottom.where(bottom > 1e-9), "body_size": c - o, "doji": (c - o).abs() / hl, "gap_ratio": (o - prev) / prev, "mdd": (h - c) / h * 100, "cum_mmd": (h.cummax() - c) / h.cummax() * 100}
    return out | {f"klineshape_{k}": x for k, x in shape.items()}


def test_families_are_pandas(bars):
    found = minute._all(*(bars[x].to_numpy() for x in "ohlcv"))
    assert len(found) > 110
    with np.errstate(all="ignore"):
        want = wanted(bars)
    for name, x in want.items():
        a, b = np.asarray(found[name], float), np.asarray(x, float)
        sound = np.isfinite(b)
        assert sound.sum() > 25 and np.allclose(a[sound], b[sound], rtol=1e-7, atol=1e-9), name


def test_one_bar_is_enough():
    found = minute._all(*(np.array([x]) for x in (1.0, 2.0, 0.5, 1.5, 3.0)))
    assert all(len(x) == 1 for x in found.values())


def test_components_and_least_squares():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4)) + [0, 5, 1, 2]
    y = x @ [1.0, 0, 0, 0.5]
    scores = minute.components(x)
    scaled = x / x.std(0)
    values, vectors = np.linalg.eigh(scaled.T @ scaled)
    assert np.allclose(np.abs(scores[:, 0]), np.abs(scaled @ vectors[:, -1])) and (minute.components(np.ones((5, 3))) == 0).all()
    t = minute.partial_least_squares(x, y)
    assert abs(np.corrcoef(t[:, 0], y)[0, 1]) > 0.8 and abs(t[:, 0] @ t[:, 1]) < 1e-8 and (minute.partial_least_squares(x[:2], y[:2]) == 0).all()
    fit = np.linalg.lstsq(np.c_[np.ones(50), t], y, rcond=None)[0]
    assert ((np.c_[np.ones(50), t] @ fit - y) ** 2).sum() < 0.1 * ((y - y.mean()) ** 2).sum()


def test_components_of_many_groups_in_one_call():
    """Stacks of groups give what each group alone gives, whatever the lengths; a year's months of a code are not a call each."""
    rng = np.random.default_rng(2)
    lengths = [1, 2, 3, 30, 3, 7, 1, 30, 2]
    n = sum(lengths)
    columns = {f"{s}{k}{i}": rng.uniform(1, 9, n).round(2) for s in "bs" for k in "pv" for i in range(1, 6)}
    columns["bv2"][5] = np.nan
    ends = np.zeros(n, bool)
    ends[np.cumsum(lengths) - 1] = True
    together, at = minute._components_of(columns, ends), 0
    for size in lengths:
        own = {k: v[at : at + size] for k, v in columns.items()}
        by_domain = minute.domains(own.__getitem__)
        mid = (own["bp1"] + own["sp1"]) / 2
        ahead = np.append(np.diff(mid), np.nan)
        alone = [minute.components(by_domain[d]) for d in minute.DOMAINS] + [minute.partial_least_squares(by_domain[d], ahead) for d in minute.DOMAINS]
        mean, last = minute.strongest_frequencies(sum(own[f"{s}v{i}"] for s in "bs" for i in range(1, 6)))
        assert np.allclose(together[at : at + size], np.concatenate([*alone, mean[:, None], last[:, None]], 1), atol=1e-9, equal_nan=True)
        for i in range(size):  # the transform, window by window
            x = sum(own[f"{s}v{k}"] for s in "bs" for k in range(1, 6))[max(0, i - 24) : i + 1]
            f = np.fft.fft(x)
            f[np.argsort(np.abs(f) ** 2, kind="stable")[: max(0, len(f) - 5)]] = 0
            assert np.isnan(x).any() and np.isnan(mean[i]) or last[i] == pytest.approx(np.fft.ifft(f).real[-1])
        at += size


def test_book_components_keep_groups_whole(spark, monkeypatch):
    """Groups that lie across Arrow batches and calls."""
    from tessera.queries.research import book_components

    one = {(r.code, r.trade_date, r.t): r for r in book_components(spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.setattr(minute, "TOGETHER", 50)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = book_components(spark, "/root/testdata/sf0.001")
        found = frame.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == len(one) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    for r in found:
        assert tuple(r)[3:] == pytest.approx(tuple(one[r.code, r.trade_date, r.t])[3:], abs=1e-9, nan_ok=True)
    assert "FlatMapGroups" not in frame._jdf.queryExecution().optimizedPlan().toString()  # not a call for each group
