"""Recursions and kernels against plain re-derivations."""

import numpy as np
import pandas as pd
import pytest

from tessera.factors import minute
from tessera.factors.recursion import ewm, recursions
from tessera.operators import grouped
from tessera.plans.expression import evaluate


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(4)
    x = 50 + np.cumsum(rng.normal(size=60))
    x[[7, 8, 30]] = np.nan
    return x


def test_ewm_is_pandas(series):
    for alpha in (0.1, 0.5, 2 / 13):
        assert np.allclose(ewm(series, alpha), pd.Series(series).ewm(alpha=alpha, adjust=False).mean(), equal_nan=True)


def test_rolling_is_pandas(series):
    from tessera.factors.recursion import _rolling

    roll = pd.Series(series).rolling(5, min_periods=2)
    for f, want in ((np.min, roll.min()), (np.max, roll.max()), (np.sum, roll.sum()), (np.mean, roll.mean()), (np.median, roll.median())):
        assert np.allclose(_rolling(f, series, 5, 2), want, equal_nan=True)


def test_recursive_factors_are_pandas(series):
    c = pd.Series(series)
    ret = c.diff() / c.shift(1)
    out = recursions(series - 0.2, series + 1, series - 1, series, np.abs(series) * 3, ret.to_numpy(), np.full(len(c), 0.5))
    dif = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    assert np.allclose(out["macd_dif"], dif, equal_nan=True)
    assert np.allclose(out["macd_hist"], 2 * (dif - dif.ewm(span=9, adjust=False).mean()), equal_nan=True)
    gain, loss = ret.clip(lower=0).ewm(span=6, adjust=False).mean(), (-ret).clip(lower=0).ewm(span=6, adjust=False).mean()
    assert np.allclose(out["rsi_6"], 100 * gain / (gain + loss), equal_nan=True)


def test_rolling_regression(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=30), rng.normal(size=30)
    frame = spark.createDataFrame([("a", t, float(x[t]), float(y[t])) for t in range(30)], "code string, t int, x double, y double")
    out = evaluate(frame, {"b": "ts_multiregression_getparams(y, x, 10, 1)", "s": "ts_regbeta(x, y, 10)", "r": "ts_multiregrsquare(y, 10, x)", "r2": "ts_reg_r2(x, y, 10)", "c": "ts_corr(x, y, 10)"}).orderBy("t").toPandas()
    for t in range(9, 30):
        slope = np.polyfit(x[t - 9 : t + 1], y[t - 9 : t + 1], 1)[0]
        assert out.b[t] == pytest.approx(slope) and out.s[t] == pytest.approx(slope)
        assert out.r[t] == pytest.approx(out.r2[t]) and out.c[t] == pytest.approx(np.corrcoef(x[t - 9 : t + 1], y[t - 9 : t + 1])[0, 1])
    assert out.b[:9].isna().all()


def test_windows_by_numpy(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=25), rng.normal(size=25)
    x[5] = np.nan
    frame = spark.createDataFrame([("a", t, None if np.isnan(x[t]) else float(x[t]), float(y[t])) for t in range(25)], "code string, t int, x double, y double")
    out = evaluate(frame, {"k": "ts_kurt_selq(x, y, 8, 0.2, 0.9)", "f": "ts_skew_flip(x, y, 8, 0.2, 0.8)", "c": "ts_cond_quantile_mean(x, y, 8, 0.3, 0.8)", "e": "ts_entropy(y, 10)", "z": "ts_sort_diffcumsum(y, x, 6)"}).orderBy("t").toPandas()
    for t in range(9, 25):
        a, b = x[t - 7 : t + 1], y[t - 7 : t + 1]
        lo, hi = np.quantile(b, 0.2), np.quantile(b, 0.9)
        s = a[(b >= lo) & (b <= hi)]
        s = s[~np.isnan(s)]
        m2 = s.var()
        assert out.k[t] == pytest.approx(((s - s.mean()) ** 4).mean() / m2**2 - 3)
        dev = a - np.nanmean(a)
        turned = np.where((b >= lo) & (b <= np.quantile(b, 0.8)), dev, -dev)
        skew = lambda v: np.nanmean((v - np.nanmean(v)) ** 3) / np.nanstd(v) ** 3
        assert out.f[t] == pytest.approx(skew(dev) - skew(turned))
        share = np.full(8, np.nan)
        known = np.flatnonzero(~np.isnan(a))
        share[known[np.argsort(a[known], kind="stable")]] = np.arange(1, len(known) + 1) / len(known)
        assert out.c[t] == pytest.approx(b[(share >= 0.3) & (share <= 0.8)].mean())
        w = y[t - 9 : t + 1]
        n = np.histogram(w, np.linspace(w.min(), w.max(), 11))[0].astype(float)
        n[-1] -= 1  # the largest value is in no bucket
        q = n / n.sum()
        assert out.e[t] == pytest.approx(-(q * np.log2(q + 1e-9)).sum() / 10 + np.log2(10), abs=1e-6)
        u, v = y[t - 5 : t + 1], x[t - 5 : t + 1]
        v = np.where(np.isnan(v), np.nanmean(v), v)
        up, down = u[np.argsort(v, kind="stable")], u[np.argsort(-v, kind="stable")]
        assert out.z[t] == pytest.approx((np.cumsum(up) - np.cumsum(down)).sum())


def test_components_and_least_squares():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5))
    score = minute.components(x, 2)
    u, s, _ = np.linalg.svd(x / x.std(0), full_matrices=False)
    assert np.allclose(np.abs(np.corrcoef(score[:, 0], u[:, 0] * s[0])[0, 1]), 1)
    y = x[:, 0] * 2 + rng.normal(size=40) * 0.01
    t = minute.partial_least_squares(x, y, 2)
    assert abs(np.corrcoef(t[:, 0], y)[0, 1]) > 0.8 and abs(t[:, 0] @ t[:, 1]) < 1e-8


def test_hurst_of_noise_and_trend():
    rng = np.random.default_rng(0)
    assert 0.3 < grouped.hurst(rng.normal(size=512)) < 0.8 < grouped.hurst(np.arange(512.0))


def test_garch_follows_its_likelihood():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=80), rng.normal(size=80) ** 2 / 50
    e2, theta = x * x, np.array([0.02, 0.15, 0.7, 0.1])
    h, slopes = grouped._variance(theta, e2, [y])
    plain = [theta[0] / (1 - theta[1] - theta[2])]
    for t in range(1, 80):
        plain.append(theta[0] + theta[1] * e2[t - 1] + theta[2] * plain[-1] + theta[3] * y[t - 1])
    assert np.allclose(h, plain)
    for i in range(4):
        step = np.eye(4)[i] * 1e-6
        assert np.allclose(slopes[i], (grouped._variance(theta + step, e2, [y])[0] - grouped._variance(theta - step, e2, [y])[0]) / 2e-6, rtol=1e-4, atol=1e-6)
    loss = lambda h: (np.log(h) + e2 / h).sum()
    first = grouped._variance(np.array([0.01, 0.1, 0.8]), e2, [])[0]
    assert loss(grouped.ts_garch(x)) < loss(first)
    assert len(grouped.ts_garch(x, y, y)) == 80 and grouped.ts_garch(np.zeros(0)).size == 0


def test_fluctuations_rise_with_the_scale():
    rng = np.random.default_rng(5)
    walk, noise = np.cumsum(rng.normal(size=400)), rng.normal(size=400)
    a, b = (grouped.ts_dfa(v, 10, 4, 2, 4, 8, 16) for v in (walk, noise))
    assert np.nanmean(a[100:]) > np.nanmean(b[100:]) > 0 and (a[:14] == 0).all()


def test_adaptive_sampling_by_a_loop(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=40), rng.normal(size=40)
    frame = spark.createDataFrame([("a", t, float(x[t]), float(y[t])) for t in range(40)], "code string, t int, x double, y double")
    found = [r.v for r in evaluate(frame, {"v": "ts_adaptive_sampling(x, y, 5, 12)"}).orderBy("t").collect()]
    full = lambda f, d: pd.Series([f(y[max(0, t - d + 1) : t + 1]) if t >= d - 1 else np.nan for t in range(40)]).bfill().to_numpy()
    level, short, long, spread = full(lambda w: np.quantile(w, 0.7), 12), full(np.mean, 5), full(np.mean, 12), full(lambda w: w.std(ddof=1), 5)
    edge = level * np.where(short > long, 1.2, 1.0) * np.where(spread > np.sort(spread)[19], 1.2, 0.8)
    last, want = x[0], []
    for t in range(40):
        last = x[t] if y[t] >= edge[t] else last
        want.append(last)
    assert found == pytest.approx(want)


def test_adaptive_sampling_rounds_equal_deviations_like_its_sql(spark):
    """The windows up to rows 9 and 10 have the same variance; only the last digit says which is above the median."""
    import duckdb

    y = [154.0, 115.0, 221.0, 251.0, 222.0, 222.0, 255.0, None, 200.0, 362.0, 308.0, 126.0, 84.0]
    rows = [("a", t, float(t), v) for t, v in enumerate(y)]
    frame = spark.createDataFrame(rows, "code string, t int, x double, y double")
    c = duckdb.connect()
    c.execute("CREATE TABLE r (t INT, y DOUBLE)")
    c.executemany("INSERT INTO r VALUES (?, ?)", [(t, v) for _, t, _, v in rows])
    spread = [s for (s,) in c.execute("SELECT CASE WHEN t >= 9 THEN stddev_samp(y) OVER (ORDER BY t ROWS 9 PRECEDING) END FROM r ORDER BY t").fetchall()]
    assert spread[9] != spread[10] and spread[9] == pytest.approx(spread[10])
    held = [r.v for r in evaluate(frame, {"v": "ts_adaptive_sampling(x, y, 10, 10, 0.5)"}).orderBy("t").collect()]
    level = c.execute("""SELECT t, quantile_cont(y, 0.5) OVER w AS q, avg(y) OVER w AS a, stddev_samp(y) OVER w AS s, y FROM r WINDOW w AS (ORDER BY t ROWS 9 PRECEDING) ORDER BY t""").fetchall()
    q, s = ([level[max(t, 9)][k] for t in range(13)] for k in (1, 3))
    last, want = 0.0, []
    for t in range(13):
        last = float(t) if y[t] is not None and y[t] >= q[t] * (1.2 if s[t] > sorted(s)[6] else 0.8) else last
        want.append(last)
    assert held == want
    from tessera.operators.rolling import _squares
    from tessera.plans.layers import Panel

    p = Panel(frame)
    squares = _squares(p, p.field("y"), 10)
    found = [r.s for r in p.select({"s": squares}).orderBy("t").collect()]
    assert [(found[t] / (sum(v is not None for v in y[t - 9 : t + 1]) - 1)) ** 0.5 for t in range(9, 13)] == spread[9:]


def test_first_derivative_to_the_last_digit_of_its_sql(spark):
    import duckdb

    rows = [("a", t, float(v)) for t, v in enumerate(np.random.default_rng(8).uniform(900, 2000, 200))]
    c = duckdb.connect()
    c.execute("CREATE TABLE r (t INT, x DOUBLE)")
    c.executemany("INSERT INTO r VALUES (?, ?)", [(t, v) for _, t, v in rows])
    sql = "CASE WHEN t >= 5 THEN (sum(t * x) OVER w - avg(x) OVER w * sum(t) OVER w) / (var_pop(x) OVER w * count(x) OVER w) END"
    want = [v for (v,) in c.execute(f"SELECT {sql} FROM r WINDOW w AS (ORDER BY t ROWS 5 PRECEDING) ORDER BY t").fetchall()]
    frame = spark.createDataFrame(rows, "code string, t int, x double")
    assert [r.v for r in evaluate(frame, {"v": "ts_first_deriv(x, 6)"}).orderBy("t").collect()] == want


def _gappy(codes: int, rows: int) -> np.ndarray:
    y = np.random.default_rng(9).uniform(900, 2000, (rows, codes))
    y[np.random.default_rng(10).random(y.shape) < 0.6] = np.nan
    y[:, 3] = np.where(np.isnan(y[:, 3]), np.nan, 1234.5)  # does not vary
    y[: rows // 2, 4], y[rows // 2 :, 5] = np.nan, np.nan  # no row in common
    y[:, 6], y[2, 6] = np.nan, 1000.1  # one row
    y[:, 7], y[2:4, 7] = np.nan, (1e6, 1e6 + 1e-3)  # varies little beside its size
    return y


def test_correlations_of_all_pairs_by_products_of_matrices():
    y = _gappy(30, 20)
    got = grouped.pair_correlations(y[:, :11], y)
    for i in range(11):
        for j in range(30):
            both = np.isfinite(y[:, i]) & np.isfinite(y[:, j])
            u, v = y[both, i], y[both, j]
            size = u.std() * v.std() if both.sum() > 1 else 0
            want = ((u - u.mean()) * (v - v.mean())).mean() / size if size > 1e-9 else 0
            assert got[i, j] == pytest.approx(want, abs=1e-6 if 7 in (i, j) else 1e-11), (i, j)


def test_market_correlation_by_blocks(spark, monkeypatch):
    """No row for each pair of codes anywhere, and the same sums from several blocks as from the whole matrix."""
    monkeypatch.setattr(grouped, "BLOCK", 8)
    monkeypatch.setattr(grouped, "STRIP", 3)
    x, y = np.random.default_rng(11).normal(size=(20, 30)), _gappy(30, 20)
    y[:, 7] = np.nan
    rows = [(f"c{j:02d}", t, float(x[t, j]) if t else None, None if np.isnan(y[t, j]) else float(y[t, j])) for j in range(30) for t in range(20)]
    frame = evaluate(spark.createDataFrame(rows, "code string, t int, x double, y double"), {"v": "cs_marketcorrw(x, y)"})
    want = np.where(np.arange(20)[:, None] > 0, x, 0) @ grouped.pair_correlations(y, y)
    for r in frame.collect():
        found = want[r.t, int(r.code[1:])]
        assert r.v == (None if found == 0 else pytest.approx(found, abs=1e-9))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "corr" not in plan and "covar" not in plan


def test_euclidean_distances_by_tiles():
    own = np.random.default_rng(12).normal(size=(23, 3))
    want = np.sqrt(((own[:, None] - own[None]) ** 2).sum(2)).sum(1)
    assert grouped._sums_of_distances(own, tile=5) == pytest.approx(want) and grouped._sums_of_distances(own) == pytest.approx(want)


def test_windows_of_many_codes_in_one_call(spark, monkeypatch):
    """A code's windows are the same beside others as alone, whatever batches and calls they lie in; no higher-order function is left in the plan."""
    from tessera.plans import layers
    from tessera.queries.operators import LISTS

    monkeypatch.setattr(layers, "TOGETHER", 40)
    rng = np.random.default_rng(13)
    cells = lambda: [None if v < 0.15 else float(round(v, 1)) for v in rng.random(30)]  # noqa: E731  gaps and ties
    lengths = {"a": 1, "b": 5, "c": 30, "d": 8, "e": 7, "f": 12, "g": 9}
    rows = [(c, t, x, y, z) for c, n in lengths.items() for t, x, y, z in zip(range(n), cells(), cells(), cells(), strict=False)]
    frame = spark.createDataFrame(rows, "code string, t int, ret double, volume double, close double")
    wanted = {n: e for n, (e, _) in LISTS.items() if n not in ("ts_partial_corr", "ts_ewmstd")}  # from windows
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        together = evaluate(frame, wanted)
        plan = together._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and "collect_list" not in plan and "FlatMapGroups" not in plan
        found = {(r.code, r.t): tuple(r)[2:] for r in together.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == len(rows)
    assert all(v is None for (_, t), r in found.items() if t < 7 for v in r) and any(v is not None for r in found.values() for v in r)
    for code in "cdf":
        for r in evaluate(frame.where(f"code = '{code}'"), wanted).collect():
            assert found[code, r.t] == tuple(r)[2:]


def test_cut_points():
    from tessera.operators.cross import get_group_quantile_cutpoint, get_group_rank_cutpoint

    assert get_group_rank_cutpoint(11, 3) == ([0, 3, 6], [3, 6, 11]) and get_group_rank_cutpoint(10, 2, 4) == ([3, 8], [8, 13])
    assert get_group_quantile_cutpoint(4) == ([-1.0, 0.25, 0.5, 0.75], [0.25, 0.5, 0.75, 1.0])
