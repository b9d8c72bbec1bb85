"""The operators of the expression language over the monthly panel, one query per family, a column per operator."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.expression import evaluate
from tessera.sources.panel import MONTH_PANEL_SQL, month_panel


#: Large values are scaled by it before they are cut to single precision: decimal fractions then don't lie half-way.
SCALE = 0.7390851332151607


def rounded(frame: DataFrame, *keys: str) -> DataFrame:
    """Doubles to six digits behind the point, large ones to single precision, without a negative zero."""
    kinds = dict(frame.dtypes)
    return frame.select(*keys, *(_rounded(F.col(c)).alias(c) if kinds[c] == "double" else c for c in frame.columns if c not in keys))


def _rounded(x):
    return F.when(F.abs(x) < 1e5, F.floor(x * 1e6 + 0.5) / 1e6).when(F.abs(x) < 1e30, (x * SCALE).cast("float").cast("double") / SCALE).otherwise((x * SCALE / 1e30).cast("float").cast("double") / SCALE * 1e30) + F.lit(0.0)


def rounded_sql(e: str) -> str:
    return f"CASE WHEN abs({e}) < 1e5 THEN floor(({e}) * 1e6 + 0.5) / 1e6 WHEN abs({e}) < 1e30 THEN CAST(CAST(({e}) * {SCALE} AS FLOAT) AS DOUBLE) / {SCALE} ELSE CAST(CAST(({e}) * {SCALE} / 1e30 AS FLOAT) AS DOUBLE) / {SCALE} * 1e30 END + 0.0"


def W(d: int) -> str:
    return f"OVER (PARTITION BY code ORDER BY t ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


def full(d: int, e: str) -> str:
    return f"CASE WHEN t >= {d - 1} THEN {e} END"


def div(a: str, b: str) -> str:
    return f"CASE WHEN abs({b}) > 1e-9 THEN ({a}) / ({b}) END"


H, X = "OVER (PARTITION BY code ORDER BY t)", "OVER (PARTITION BY t)"


def lag(x: str, d: int) -> str:
    return f"lag({x}, {d}) {H}"


def lst(d: int, x: str) -> str:
    return f"list({x}) {W(d)}"


# statistics of a list l in SQL
def l_std(x: str) -> str:
    return f"list_aggregate({x}, 'stddev_pop')"


def l_dev(x: str) -> str:
    return f"list_transform({x}, lambda e: e - list_avg({x}))"


def l_moment(x: str, k: int) -> str:
    return f"list_avg(list_transform({x}, lambda e: power(e - list_avg({x}), {k})))"


def l_skew(x: str) -> str:
    return f"CASE WHEN {l_std(x)} > 1e-9 THEN {l_moment(x, 3)} / power({l_std(x)}, 3) END"


def l_kurt(x: str) -> str:
    return f"CASE WHEN power({l_moment(x, 2)}, 2) > 1e-9 THEN {l_moment(x, 4)} / power({l_moment(x, 2)}, 2) - 3 END"


def l_sum(x: str) -> str:
    return f"coalesce(list_sum({x}), 0.0)"


def l_quantile(x: str, q: float) -> str:
    return f"list_aggregate({x}, 'quantile_cont', {q})"


def l_median(x: str) -> str:
    s = f"list_sort(list_filter({x}, lambda e: e IS NOT NULL))"
    return f"{s}[(len({s}) + 1) // 2]"


_ERF = "(sign({x}) * (1 - ((((1.061405429 * {k} - 1.453152027) * {k} + 1.421413741) * {k} - 0.284496736) * {k} + 0.254829592) * {k} * exp(-({x}) * ({x}))))"


def erf(x: str) -> str:
    return _ERF.format(x=x, k=f"(1 / (1 + 0.3275911 * abs({x})))")


_LOG = "CASE WHEN abs({0}) > 1e-9 THEN ln(abs({0})) END"

ARITHMETIC = {
    "v_add": ("add(ret, close)", "ret + close"),
    "v_sub": ("sub(ret, close)", "ret - close"),
    "v_mul": ("mul(ret, close)", "ret * close"),
    "v_div": ("div(close, ret)", div("close", "ret")),
    "v_max": ("Max(high, close)", "CASE WHEN high IS NOT NULL AND close IS NOT NULL THEN greatest(high, close) END"),
    "v_min": ("Min(low, ret)", "CASE WHEN low IS NOT NULL AND ret IS NOT NULL THEN least(low, ret) END"),
    "v_abs": ("Abs(ret)", "abs(ret)"),
    "v_neg": ("neg(ret)", "-ret"),
    "v_inv": ("inv(ret)", div("1.0", "ret")),
    "v_sqrt": ("sqrt(ret)", "sqrt(abs(ret))"),
    "v_log": ("log(ret)", _LOG.format("ret")),
    "v_pow_half": ("Pow(ret, 0.5)", "power(abs(ret), 0.5)"),
    "v_pow3": ("pow(ret, 3)", "power(ret, 3)"),
    "v_nentexpo": ("nentexpo(mul_element_wise(ret, 0.01), 2)", "power(2, ret * 0.01)"),
    "v_pow_xy": ("pow_xy(close, mul_element_wise(ret, 0.001))", "power(close, ret * 0.001)"),
    "v_exp": ("exp(mul_element_wise(ret, 0.01))", "exp(ret * 0.01)"),
    "v_sigmoid": ("sigmoid(ret)", "1 / (1 + exp(-ret))"),
    "v_erf": ("erf(ret)", erf("ret")),
    "v_arctan": ("arctan(ret)", "atan(ret)"),
    "v_sign": ("sign(ret)", "CAST(sign(ret) AS DOUBLE)"),
    "v_sign_square": ("sign_square(ret)", "sign(ret) * ret * ret"),
    "v_indicator": ("indicator(ret)", "CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END"),
    "v_taylor_log": ("taylor_log_diff(ret)", f"2 * (abs(ret) - 1 - ({_LOG.format('ret')})) - power({_LOG.format('ret')}, 2)"),
    "v_taylor_exp": ("taylor_exp_diff(mul_element_wise(ret, 0.01))", "2 * (exp(ret * 0.01) - 1 - ret * 0.01) - power(ret * 0.01, 2)"),
    "v_ceil_scale": ("ceil_scale(ret, 4)", "ceil(ret * 4) / 4"),
    "v_floor_scale": ("floor_scale(ret, 4)", "floor(ret * 4) / 4"),
    "v_round_zero": ("round_zero_scale(ret, 4)", "sign(ret) * floor(abs(ret) * 4) / 4"),
    "v_times": ("mul_element_wise(ret, 3)", "ret * 3.0"),
    "v_boxcox": ("boxcox(close, 0.5)", "(power(close, 0.5) - 1) / 0.5"),
    "v_boxcox0": ("boxcox(close, 0)", "ln(close)"),
    "v_normal_log": ("normal_log_prob(ret, 0.1, 2)", "-power((ret - 0.1) / 2.0, 2) / 2 - ln(2) - 0.5 * ln(2 * pi())"),
    "v_normal_cdf": ("normal_cdf(ret)", f"0.5 * (1 + {erf('(ret / sqrt(2))')})"),
    "v_student": ("studentT_log_prob(ret, 5)", "lgamma(3) - lgamma(2.5) - 0.5 * ln(5 * pi()) - 3 * ln(1 + ret * ret / 5)"),
    "v_t_cdf2": ("t_cdf(ret, 2)", "0.5 + ret / (2 * sqrt(2 + ret * ret))"),
}

LOGIC = {
    "b_gt": ("is_gt(ret, 0.1)", "ret > 0.1"),
    "b_lt": ("is_lt(ret, 0.1)", "ret < 0.1"),
    "v_is_zero": ("is_zero(indicator(ret))", "nullif(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END, 0)"),
    "v_is_nan": ("is_nan(ret)", "CASE WHEN t >= 237 THEN coalesce(ret, 0) ELSE ret END"),
    "b_and2": ("bool_and2(is_gt(ret, 0), is_lt(ret, 0.2))", "ret > 0 AND ret < 0.2"),
    "b_or2": ("bool_or2(is_gt(ret, 0.3), is_lt(ret, -0.3))", "ret > 0.3 OR ret < -0.3"),
    "b_land": ("logical_and(ret, close)", "coalesce(ret <> 0, false) AND coalesce(close <> 0, false)"),
    "b_land_n": ("logical_and_n(ret, close, volume)", "coalesce(ret <> 0, false) AND coalesce(close <> 0, false) AND coalesce(volume <> 0, false)"),
    "b_lor": ("logical_or(ret, close)", "coalesce(ret <> 0, false) OR coalesce(close <> 0, false)"),
    "b_lnot": ("logical_not(ret)", "NOT coalesce(ret <> 0, false)"),
    "b_lxor": ("logical_xor(ret, close)", "coalesce(ret <> 0, false) <> coalesce(close <> 0, false)"),
    "v_filt": ("filt_cond(ret, is_gt(ret, 0))", "CASE WHEN ret > 0 THEN ret END"),
    "v_fill_xy": ("fill_xy_cond(is_gt(ret, 0), high, low)", "CASE WHEN ret > 0 THEN high ELSE low END"),
    "v_q_xn0": ("question_xn0(ret, high, low)", "CASE WHEN ret > 0 THEN high ELSE low END"),
    "v_q_not0": ("question_xisnot0(indicator(ret), high, low)", "CASE WHEN (CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) <> 0 THEN high ELSE low END"),
    "v_q_xm0": ("question_xm0(ret, high, low)", "CASE WHEN ret < 0 THEN high ELSE low END"),
    "v_q_xmy": ("question_xmy(open, close, high, low)", "CASE WHEN open > close THEN high ELSE low END"),
    "v_q_xisy": ("question_xisy(open, close, high, low)", "CASE WHEN open = close THEN high ELSE low END"),
    "v_reverse": ("reverse_cond(ret, is_gt(close, 1500))", "CASE WHEN close > 1500 THEN ret ELSE -ret END"),
    "v_fillna": ("fillna(ret, 7)", "coalesce(ret, 7.0)"),
    "b_approx": ("approx_eq(high, close)", "coalesce(high IS NOT DISTINCT FROM close OR abs(high - close) < 1e-9, false)"),
    "v_compare": ("compare_and_return(open, close, high, volume, low)", "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN CASE WHEN abs(open - close) <= 1e-9 THEN volume WHEN open > close THEN high ELSE low END END"),
    "v_const": ("create_like(ret, 2.5)", "CAST(2.5 AS DOUBLE)"),
    "v_nan": ("get_nan_tensor(ret)", "CAST(NULL AS DOUBLE)"),
    "v_bucket": ("bucket(ret, -0.5, 0.5, 0.1)", "CASE WHEN ret >= -0.5 AND ret < 0.5 THEN floor((ret + 0.5) / 0.1) + 1 END"),
    "v_voi_b": ("VOI_B(volume, close)", f"CASE WHEN close = {lag('close', 1)} THEN volume - {lag('volume', 1)} WHEN {lag('close', 1)} > close THEN volume WHEN {lag('close', 1)} < close THEN 0.0 END"),
    "v_voi_s": ("VOI_S(volume, close)", f"CASE WHEN close = {lag('close', 1)} THEN volume - {lag('volume', 1)} WHEN {lag('close', 1)} < close THEN volume WHEN {lag('close', 1)} > close THEN 0.0 END"),
    "v_fill_quantile": ("fill_with_quantile(ret, 0.8)", "(SELECT quantile_cont(ret, 0.8) FROM panel)"),
}

_HALF = lambda inner, sign: f"avg(CASE WHEN ret {sign} 0 THEN {inner} END) {W(5)}"


def _parts(up: str, down: str) -> str:
    return f"(coalesce({up}, 0) + coalesce({down}, 0)) / nullif(CAST(({up}) IS NOT NULL AS INT) + CAST(({down}) IS NOT NULL AS INT), 0)"


_GMEAN = _parts(f"exp({_HALF('ln(ret)', '>')})", f"-exp({_HALF('ln(-ret)', '<')})")
_HMEAN = _parts(f"1 / ({_HALF('1 / ret', '>')})", f"-1 / ({_HALF('1 / -ret', '<')})")
_WEIGHTS = [(1 - (1 - 2 / 6)) ** k for k in range(5, 0, -1)]


def _ago(d: int, largest: bool) -> str:
    return f"t - arg_{'max' if largest else 'min'}(t, CASE WHEN close IS NOT NULL THEN ROW({'close' if largest else 'close'}, {'-t' if largest else 't'}) END) {W(d)}"


ROLLING = {
    "ts_mean": ("ts_mean(close, 5)", full(5, f"avg(close) {W(5)}")),
    "ts_sum": ("ts_sum(close, 5)", full(5, f"coalesce(sum(close) {W(5)}, 0)")),
    "ts_min": ("ts_min(close, 5)", full(5, f"min(close) {W(5)}")),
    "ts_max": ("ts_max(close, 5)", full(5, f"max(close) {W(5)}")),
    "ts_stddev": ("ts_stddev(close, 5)", full(5, f"stddev_pop(close) {W(5)}")),
    "ts_var": ("ts_var(ret, 5)", full(5, f"var_pop(ret) {W(5)}")),
    "ts_demean": ("ts_demean(close, 5)", full(5, f"close - avg(close) {W(5)}")),
    "ts_zscore": ("ts_zscore(close, 5)", full(5, div(f"close - avg(close) {W(5)}", f"stddev_pop(close) {W(5)}"))),
    "ts_product": ("ts_product(add(ret, 1), 5)", full(5, f"product(coalesce(1 + ret, 1)) {W(5)}")),
    "ts_counter": ("ts_counter(ret, 5)", full(5, f"CAST(count(ret) {W(5)} AS DOUBLE)")),
    "ts_gmean": ("ts_gmean(ret, 5)", full(5, _GMEAN)),
    "ts_hmean": ("ts_hmean(ret, 5)", full(5, _HMEAN)),
    "ts_gmean_amean_diff": ("ts_gmean_amean_diff(ret, 5)", full(5, f"{_GMEAN} - avg(ret) {W(5)}")),
    "ts_hmean_amean_diff": ("ts_hmean_amean_diff(ret, 5)", full(5, f"{_HMEAN} - avg(ret) {W(5)}")),
    "ts_gmean_hmean_diff": ("ts_gmean_hmean_diff(ret, 5)", full(5, f"{_GMEAN} - {_HMEAN}")),
    "ts_delay": ("ts_delay(close, 3)", lag("close", 3)),
    "ts_shift": ("ts_shift(close, 2)", f"lead(close, 2) {H}"),
    "ts_pct": ("ts_pct(close)", f"(lead(close) {H} - close) / close"),
    "ts_delta": ("ts_delta(close, 3)", f"close - {lag('close', 3)}"),
    "ts_return": ("ts_return(close, 3)", div(f"close - {lag('close', 3)}", lag("close", 3))),
    "ts_mean_return": ("ts_mean_return(close, 5)", full(5, f"avg(ret) {W(5)}")),
    "ts_log_diff": ("ts_log_diff(close, 2)", f"ln(close) - ln({lag('close', 2)})"),
    "ts_diff_rows": ("ts_diff_rows(close)", f"CASE WHEN t = 0 THEN close ELSE close - {lag('close', 1)} END"),
    "ts_fill": ("ts_fill(close, 2)", f"coalesce(close, {lag('close', 1)}, {lag('close', 2)})"),
    "ts_count_above": ("ts_count_above_threshold(ret, 5, 0.1)", f"CAST(count(CASE WHEN ret > 0.1 THEN 1 END) {W(5)} AS DOUBLE)"),
    "ts_quantile": ("ts_quantile(close, 0.3, 5)", full(5, f"quantile_cont(close, 0.3) {W(5)}")),
    "ts_qua": ("ts_qua(close, 0.3, 5)", full(5, f"quantile_cont(close, 0.3) {W(5)} / avg(close) {W(5)}")),
    "ts_conc": ("ts_conc(close, 5, 2)", full(5, f"sum(close * close) {W(5)} / power(sum(close) {W(5)}, 2)")),
    "ts_conc_half": ("ts_conc(ret, 5, 0.5)", full(5, div(f"sum(sqrt(abs(ret))) {W(5)}", f"sqrt(sum(abs(ret)) {W(5)})"))),
    "ts_argmin": ("ts_argmin(close, 5)", full(5, f"(t - (arg_min(t, CASE WHEN close IS NOT NULL THEN ROW(close, -t) END) {W(5)}) + 1) / 5.0").replace("ROW(close, -t)", "ROW(close, t)").replace("- (arg", "- (arg")),
    "ts_decay_linear": ("ts_decay_linear(close, 4)", full(4, " + ".join(f"coalesce({lag('close', k) if k else 'close'}, 0) * {2 * (4 - k) / 20}" for k in range(4)))),
    "ts_ewma": ("ts_ewma(close, 5)", f"CASE WHEN t = 0 THEN close WHEN t >= 4 THEN " + " + ".join(f"coalesce({lag('close', k) if k else 'close'}, 0) * {_WEIGHTS[4 - k] / sum(_WEIGHTS)!r}" for k in range(5)) + " END"),
    "ts_scale": ("ts_scale(close, 5, 1)", full(5, f"(close - min(close) {W(5)}) / nullif(max(close) {W(5)} - min(close) {W(5)}, 0) + 1")),
    "ts_norm2interval": ("ts_norm2interval(close, 5, 3, 1)", full(5, f"(close - min(close) {W(5)}) / nullif(max(close) {W(5)} - min(close) {W(5)}, 0) * 2 + 1")),
    "ts_min_max_norm": ("ts_min_max_norm(close, 5)", full(5, f"CASE WHEN max(close) {W(5)} - min(close) {W(5)} <= 1e-9 THEN CASE WHEN close IS NOT NULL THEN 0.5 END ELSE (close - min(close) {W(5)}) / (max(close) {W(5)} - min(close) {W(5)}) END")),
    "ts_max_change": ("ts_max_change(close, 3)", full(3, f"max(close) OVER (PARTITION BY code ORDER BY t ROWS UNBOUNDED PRECEDING) / close - 1")),
    "ts_std_ratio": ("ts_std_ratio(ret, 12)", full(12, div(f"stddev_samp(CASE WHEN ret >= 0 THEN ret END) {W(12)}", f"stddev_samp(CASE WHEN ret < 0 THEN ret END) {W(12)}"))),
}

# pairs: each side about its own mean
_N = {"n": "count(CASE WHEN ret IS NOT NULL AND close IS NOT NULL THEN 1 END)"}


def _xy(d: int) -> tuple[str, str, str]:
    """(Sxy, Sxx, Syy) of ret and volume by lists of deviations."""
    a, b = f"({lst(d, 'ret')})", f"({lst(d, 'volume')})"
    dx, dy = f"list_transform({a}, lambda e: e - list_avg({a}))", f"list_transform({b}, lambda e: e - list_avg({b}))"
    return f"coalesce(list_sum(list_transform(list_zip({dx}, {dy}), lambda z: z[1] * z[2])), 0)", f"list_sum(list_transform({dx}, lambda e: e * e))", f"list_sum(list_transform({dy}, lambda e: e * e))"


PAIR_STATS = {
    "ts_corr": ("ts_corr(ret, volume, 8)", "CASE WHEN sqrt(xx) > 1e-9 AND sqrt(yy) > 1e-9 THEN xy / (sqrt(xx) * sqrt(yy)) END"),
    "ts_cov": ("ts_cov(ret, volume, 8)", "xy / 8"),
    "ts_regbeta": ("ts_regbeta(ret, volume, 8)", div("xy", "xx")),
    "ts_regres": ("ts_regres(ret, volume, 8)", f"volume - ({div('xy', 'xx')}) * ret"),
    "ts_reg_r2": ("ts_reg_r2(ret, volume, 8)", div("xy * xy", "(xx * yy)")),
    "ts_reg_betase": ("ts_reg_betase(ret, volume, 8)", f"sqrt({div('greatest(yy - xy * xy / nullif(xx, 0), 0)', '(xx * 6)')})"),
    "ts_reg_resse": ("ts_reg_resse(ret, volume, 8)", "sqrt(greatest(yy - xy * xy / nullif(xx, 0), 0) / 7)"),
    "ts_reg_tval": ("ts_reg_tval(ret, volume, 8)", div(f"({div('xy', 'xx')})", "(sqrt(greatest(yy - xy * xy / nullif(xx, 0), 0)) / 8)")),
    "ts_reg_Fvalue": ("ts_reg_Fvalue(ret, volume, 8)", div(f"6 * ({div('xy * xy', '(xx * yy)')})", f"(1 - ({div('xy * xy', '(xx * yy)')}))")),
    "ts_reg_rsquare": ("ts_reg_rsquare(ret, volume, 8)", "1 - (yy - 2 * (xy / (xx / 8)) * xy + power(xy / (xx / 8), 2) * xx) / yy"),
    "ts_regsse": ("ts_regsse(ret, volume, 8)", "yy - 2 * (xy / (xx / 8)) * xy + power(xy / (xx / 8), 2) * xx"),
    "ts_reg_tvalue": ("ts_reg_tvalue(ret, volume, 8)", "(xy / (xx / 8)) / sqrt((yy - 2 * (xy / (xx / 8)) * xy + power(xy / (xx / 8), 2) * xx) / (xx / 8 * 6))"),
    "ts_ridgebeta": ("ts_ridgebeta(ret, volume, 8, 0.1)", "xy / (xx + 0.1)"),
    "ts_ridgepred": ("ts_ridgepred(ret, volume, 8, 0.1)", "my + xy / (xx + 0.1) * (ret - mx)"),
    "ts_cos_similar": ("ts_cos_similar(ret, volume, 8)", div("coalesce(pxy, 0)", "(sqrt(pxx) * sqrt(pyy))")),
}

_BAND = "list_transform(list_zip({x}, c), lambda z: CASE WHEN {keep} THEN z[1] END)"
_IN, _LOW, _HIGH = "z[2] >= lo AND z[2] <= hi", "z[2] < lo", "z[2] > hi"
SELECTED = {
    "ts_mean_selq": ("ts_mean_selq(ret, volume, 8, 0.3, 0.8)", "list_avg(s)"),
    "ts_stddev_selq": ("ts_stddev_selq(ret, volume, 8, 0.3, 0.8)", l_std("s")),
    "ts_skew_selq": ("ts_skew_selq(ret, volume, 8, 0.3, 0.8)", l_skew("s")),
    "ts_sum_selq": ("ts_sum_selq(ret, volume, 8, 0.3, 0.8)", l_sum("s")),
    "ts_median_selq": ("ts_median_selq(ret, volume, 8, 0.3, 0.8)", l_median("s")),
    "ts_qua_selq": ("ts_qua_selq(close, volume, 8, 0.5, 0.3, 0.8)", f"{l_quantile('sc', 0.5)} / list_avg(sc)"),
    "ts_prodsum_selq": ("ts_prodsum_selq(ret, volume, 8, 0.3, 0.8)", l_sum("list_transform(list_zip(s, c), lambda z: z[1] * z[2])")),
    "ts_mean_diff_selq": ("ts_mean_diff_selq(ret, volume, 8, 0.3, 0.8)", "list_avg(a) - list_avg(b)"),
    "ts_stddev_diff_selq": ("ts_stddev_diff_selq(ret, volume, 8, 0.3, 0.7)", div(l_std("a7"), l_std("b7"))),
    "ts_mean_flip": ("ts_mean_flip(ret, volume, 8, 0.3, 0.8)", "list_avg(f)"),
    "ts_stddev_flip": ("ts_stddev_flip(ret, volume, 8, 0.3, 0.8)", f"{l_std('x')} - {l_std('f')}"),
    "ts_spread_std": ("ts_spread_std(volume, 8, 0.3, 0.7)", f"{l_std('list_filter(c, lambda e: e < lo)')} - {l_std('list_filter(c, lambda e: e > hi7)')}"),
    "ts_mean_gt_pct": ("ts_mean_gt_pct(ret, volume, 0.3, 8)", "CASE WHEN whole THEN list_avg(g) END"),
    "ts_stddev_gt_pct": ("ts_stddev_gt_pct(ret, volume, 0.3, 8)", f"CASE WHEN whole THEN {l_std('g')} END"),
    "ts_sum_gt_pct": ("ts_sum_gt_pct(ret, volume, 0.3, 8)", f"CASE WHEN whole THEN {l_sum('g')} END"),
    "ts_med": ("ts_med(ret, 8)", l_median("x")),
    "ts_skew": ("ts_skew(ret, 8)", l_skew("x")),
    "ts_spread": ("ts_spread(ret, 8, 0.3, 0.3)", f"list_avg(list_filter(x, lambda e: e >= {l_quantile('x', 0.7)})) - list_avg(list_filter(x, lambda e: e <= {l_quantile('x', 0.3)}))"),
    "ts_rank": ("ts_rank(close, 8)", "CASE WHEN close IS NOT NULL THEN len(list_filter(k, lambda e: e <= close)) / CAST(len(list_filter(k, lambda e: e IS NOT NULL)) AS DOUBLE) END"),
    "ts_max_drawdown": ("ts_max_drawdown(close, 8)", "CASE WHEN len(list_filter(k, lambda e: e IS NOT NULL)) = 8 THEN list_max(list_transform(range(1, 9), lambda i: (list_max(k[1:i]) - k[i]) / list_max(k[1:i]))) END"),
    "ts_ewmv": ("ts_ewmv(close, 8)", "list_sum(list_transform(list_zip(k, ws), lambda z: z[2] * power(z[1] - list_sum(list_transform(list_zip(k, ws), lambda y: coalesce(y[1], 0) * y[2])), 2)))"),
}
_W8 = [(1 - (1 - 2 / 9)) ** k for k in range(8, 0, -1)]

ACROSS = {
    "cs_mean": ("cs_mean(ret)", f"CASE WHEN ret IS NOT NULL THEN avg(ret) {X} END"),
    "cs_demean": ("cs_demean(ret)", f"ret - avg(ret) {X}"),
    "cs_sum": ("cs_sum(ret)", f"sum(ret) {X}"),
    "cs_min": ("cs_min(ret)", f"min(ret) {X}"),
    "cs_max": ("cs_max(ret)", f"max(ret) {X}"),
    "cs_stddev": ("cs_stddev(ret)", f"CASE WHEN ret IS NOT NULL THEN nullif(stddev_pop(ret) {X}, 0) END"),
    "cs_normalize": ("cs_normalize(close)", div(f"close - avg(close) {X}", f"avg(close) {X}")),
    "cs_zscore": ("cs_zscore(ret)", div(f"ret - avg(ret) {X}", f"stddev_pop(ret) {X}")),
    "cs_market": ("cs_market(ret)", f"(sum(ret) {X} - ret) / nullif(count(ret) {X} - 1, 0)"),
    "cs_winsorize": ("cs_winsorize(ret)", f"CASE WHEN ret IS NOT NULL THEN least(greatest(ret, avg(ret) {X} - 4 * stddev_pop(ret) {X}), avg(ret) {X} + 4 * stddev_pop(ret) {X}) END"),
    "cs_salience": ("cs_salience(ret)", f"abs(ret - avg(ret) {X}) / (0.01 + abs(ret) + abs(avg(ret) {X}))"),
    "cs_min_max_norm": ("cs_min_max_norm(ret)", f"CASE WHEN max(ret) {X} - min(ret) {X} <= 1e-9 THEN CASE WHEN ret IS NOT NULL THEN 0.5 END ELSE (ret - min(ret) {X}) / (max(ret) {X} - min(ret) {X}) END"),
    "cs_zscore_cdf": ("cs_zscore_cdf_norm(ret)", "0.5 * (1 + " + erf(f"((ret - avg(ret) {X}) / (stddev_samp(ret) {X} + 1e-8) / sqrt(2))") + ")"),
    "cs_fillna_mean": ("cs_fillna_mean(close)", f"coalesce(close, avg(close) {X})"),
    "cs_nan_proportion": ("cs_nan_proportion(close)", f"1 - count(close) {X} / CAST(count(*) {X} AS DOUBLE)"),
    "cs_value_proportion": ("cs_certain_value_proportion(sector, 3)", f"count(CASE WHEN abs(sector - 3) < 1e-9 THEN 1 END) {X} / CAST(count(*) {X} AS DOUBLE)"),
    "cs_rank": ("cs_rank(close)", f"CASE WHEN close IS NOT NULL THEN row_number() OVER (PARTITION BY t ORDER BY close NULLS LAST, code) END / CAST(count(close) {X} AS DOUBLE)"),
    "cs_leftright": ("cs_leftright_range1(ret)", "coalesce(avg(ret) OVER (PARTITION BY t ORDER BY code ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 0)"),
    "cs_highlowtag": ("cs_highlowtag(ret, 0.2, 0.8)", f"CASE WHEN ret > quantile_cont(ret, 0.2) {X} AND ret < quantile_cont(ret, 0.8) {X} THEN 1.0 END"),
    "cs_regpred": ("cs_regpred(ret, volume)", f"avg(CASE WHEN ret IS NOT NULL THEN volume END) {X} + {div(f'covar_pop(ret, volume) {X}', f'var_pop(CASE WHEN volume IS NOT NULL THEN ret END) {X}').replace('CASE WHEN abs', '(CASE WHEN abs', 1)}) * (ret - avg(CASE WHEN volume IS NOT NULL THEN ret END) {X})"),
    "cs_corr": ("cs_corr(ret, volume)", div(f"covar_pop(ret, volume) {X}", f"(stddev_pop(CASE WHEN volume IS NOT NULL THEN ret END) {X} * stddev_pop(CASE WHEN ret IS NOT NULL THEN volume END) {X})")),
    "cs_group_demean": ("cs_group_demean(close, sector)", "close - avg(close) OVER (PARTITION BY t, sector)"),
    "cs_group_neutralize": ("cs_group_neutralize(ret, sector)", "ret - avg(ret) OVER (PARTITION BY t, sector)"),
    "cs_group_norm": ("cs_group_norm(close, sector)", "(close - min(close) OVER (PARTITION BY t, sector)) / (max(close) OVER (PARTITION BY t, sector) - min(close) OVER (PARTITION BY t, sector) + 1e-8)"),
    "cs_group_rank": ("cs_group_rank(close, sector)", "CASE WHEN close IS NOT NULL THEN row_number() OVER (PARTITION BY t, sector ORDER BY close NULLS LAST, code) END / CAST(count(close) OVER (PARTITION BY t, sector) AS DOUBLE)"),
    "cs_group_zscore": ("cs_group_zscore(close, sector)", "CASE WHEN count(close) OVER (PARTITION BY t, sector) >= 2 AND abs(stddev_samp(close) OVER (PARTITION BY t, sector)) > 1e-9 THEN (close - avg(close) OVER (PARTITION BY t, sector)) / stddev_samp(close) OVER (PARTITION BY t, sector) END"),
}

_MED = "list_sort(list(close) FILTER (WHERE close IS NOT NULL) OVER (PARTITION BY t))"
LAYERED = {
    "cs_dense_rank": ("cs_dense_rank(close)", "dr / max(dr) OVER (PARTITION BY t)"),
    "cs_median": ("cs_median(volume)", "CASE WHEN count(volume) OVER (PARTITION BY t) = count(*) OVER (PARTITION BY t) THEN vm END"),
    "cs_abs_deviation": ("cs_abs_deviation(close)", "abs(close - cm)"),
    "cs_mad_winsorize": ("cs_mad_winsorize(close, 1)", "CASE WHEN close IS NOT NULL THEN least(greatest(close, cm - mad), cm + mad) END"),
    "cs_rank_quantile": ("cs_rank_quantile(close, 0.05, 0.95)", "CASE WHEN cr IS NOT NULL THEN least(greatest(cr, quantile_cont(cr, 0.05) OVER (PARTITION BY t)), quantile_cont(cr, 0.95) OVER (PARTITION BY t)) END"),
    "cs_orth": ("cs_orth(ret, volume)", f"fr - ({div('sum(fr * fv) OVER (PARTITION BY t)', '(sum(fv * fv) OVER (PARTITION BY t))')}) * fv"),
    "cs_orth_add": ("cs_orth_add(ret, volume)", f"volume + fr - ({div('sum(fr * fv) OVER (PARTITION BY t)', '(sum(fv * fv) OVER (PARTITION BY t))')}) * fv"),
    "cs_schmidt_last": ("cs_schmidt_last(volume, ret)", f"ret - ({div('sum(ret * volume) OVER (PARTITION BY t)', '(sum(volume * volume) OVER (PARTITION BY t))')}) * volume"),
    "cs_distance": ("cs_distance(ret)", "dist"),
    "ts_autocorr_base": ("ts_mean(abs(ts_demean(close, 5)), 5)", full(5, f"avg(adm) {W(5)}")),
    "ts_mad_mean": ("ts_mad_mean(close, 5)", full(5, f"avg(adm) {W(5)}")),
    "ts_psychology": ("ts_psychology(close, 6)", full(6, f"coalesce(sum(up) {W(6)}, 0) / 6")),
    "ts_all_volatility": ("ts_all_volatility(ret, 8)", full(8, div("ret", f"(stddev_pop(dm) {W(8)})"))),
    "ts_upside_volatility": ("ts_upside_volatility(ret, 8)", full(8, div("ret", f"(stddev_pop(CASE WHEN dm > 0 THEN dm END) {W(8)})"))),
    "ts_downside_volatility": ("ts_downside_volatility(ret, 8)", full(8, div("ret", f"(stddev_pop(CASE WHEN dm < 0 THEN dm END) {W(8)})"))),
    "ts_obp": ("ts_obp(volume, close, 5)", full(5, f"CASE WHEN count(volume) {W(5)} = 5 AND count(close) {W(5)} = 5 THEN {lag('volume', 4)} + sum(obp) {W(4)} END")),
    "ts_obn": ("ts_obn(volume, close, 5)", full(5, f"CASE WHEN count(volume) {W(5)} = 5 AND count(close) {W(5)} = 5 THEN {lag('volume', 4)} - sum(obp) {W(4)} END")),
    "ts_obpm": ("ts_obpm(volume, close, 5)", full(5, f"CASE WHEN count(volume) {W(5)} = 5 AND count(close) {W(5)} = 5 THEN {lag('volume', 4)} * product(obpm) {W(4)} END")),
    "ts_obnm": ("ts_obnm(volume, close, 5)", full(5, f"CASE WHEN count(volume) {W(5)} = 5 AND count(close) {W(5)} = 5 THEN {lag('volume', 4)} * product(obnm) {W(4)} END")),
    "cs_group_mean_1": ("ts_delay(cs_regres(ret, volume), 1)", f"lag(rr) {H}"),
}

_PLAIN = "SELECT * FROM panel"
_PAIRED = f"""
  SELECT *, avg(ret) {W(8)} AS mx, avg(volume) {W(8)} AS my, sum(ret * volume) {W(8)} AS pxy, sum(ret * ret) {W(8)} AS pxx, sum(volume * volume) {W(8)} AS pyy,
         {lst(8, "ret")} AS lx, {lst(8, "volume")} AS ly FROM panel"""
_PAIR_SUMS = """
  SELECT *, list_transform(lx, lambda e: e - mx) AS dx, list_transform(ly, lambda e: e - my) AS dy FROM (""" + _PAIRED + ")"
_PAIR_BASE = """
  SELECT *, coalesce(list_sum(list_transform(list_zip(dx, dy), lambda z: z[1] * z[2])), 0) AS xy,
         list_sum(list_transform(dx, lambda e: e * e)) AS xx, list_sum(list_transform(dy, lambda e: e * e)) AS yy FROM (""" + _PAIR_SUMS + ")"
_ARRAYS = f"""
  SELECT *, {lst(8, "ret")} AS x, {lst(8, "volume")} AS c, {lst(8, "close")} AS k, [{", ".join(repr(w / sum(_W8)) for w in _W8)}] AS ws,
         count(ret) {W(8)} = 8 AND count(volume) {W(8)} = 8 AS whole FROM panel"""
_QUANTILES = f"SELECT *, {l_quantile('c', 0.3)} AS lo, {l_quantile('c', 0.8)} AS hi, {l_quantile('c', 0.7)} AS hi7, list_avg(x) AS mx FROM ({_ARRAYS})"
_BANDS = f"""
  SELECT *, {_BAND.format(x='x', keep=_IN)} AS s, {_BAND.format(x='k', keep=_IN)} AS sc, {_BAND.format(x='x', keep=_LOW)} AS a, {_BAND.format(x='x', keep=_HIGH)} AS b,
         {_BAND.format(x='x', keep=_LOW)} AS a7, {_BAND.format(x='x', keep='z[2] > hi7')} AS b7, {_BAND.format(x='x', keep='z[2] > lo')} AS g,
         list_transform(list_zip(x, c), lambda z: CASE WHEN coalesce({_IN}, false) THEN z[1] - mx ELSE mx - z[1] END) AS f
  FROM ({_QUANTILES})"""
_RR = f"avg(CASE WHEN ret IS NOT NULL THEN volume END) {X} + (covar_pop(ret, volume) {X} / nullif(var_pop(CASE WHEN volume IS NOT NULL THEN ret END) {X}, 0)) * (ret - avg(CASE WHEN volume IS NOT NULL THEN ret END) {X})"
_LAYERS = f"""
  SELECT *, {_MED.replace('close', 'absd')} [(count(absd) OVER (PARTITION BY t) + 1) // 2] AS mad FROM (
    SELECT *, abs(close - cm) AS absd FROM (
      SELECT *, CASE WHEN close IS NOT NULL THEN CAST(dense_rank() OVER (PARTITION BY t ORDER BY close NULLS LAST) AS DOUBLE) END AS dr,
        {_MED}[(count(close) OVER (PARTITION BY t) + 1) // 2] AS cm, {_MED.replace('close', 'volume')}[(count(volume) OVER (PARTITION BY t) + 1) // 2] AS vm,
        CASE WHEN close IS NOT NULL THEN row_number() OVER (PARTITION BY t ORDER BY close NULLS LAST, code) END / CAST(count(close) {X} AS DOUBLE) AS cr,
        coalesce(ret, avg(ret) OVER ()) AS fr, coalesce(volume, avg(volume) OVER ()) AS fv, volume - ({_RR}) AS rr,
        CASE WHEN t >= 4 THEN abs(close - avg(close) {W(5)}) END AS adm, CASE WHEN close > {lag('close', 1)} THEN 1.0 WHEN close <= {lag('close', 1)} THEN 0.0 END AS up, ret - avg(ret) {X} AS dm,
        CASE WHEN close > {lag('close', 1)} THEN volume WHEN close < {lag('close', 1)} THEN -volume ELSE 0 END AS obp,
        CASE WHEN close > {lag('close', 1)} THEN volume / {lag('volume', 1)} ELSE 1 END AS obpm, CASE WHEN close < {lag('close', 1)} THEN volume / {lag('volume', 1)} ELSE 1 END AS obnm,
        CASE WHEN ret IS NOT NULL THEN list_sum(list_transform(list(ret) OVER (PARTITION BY t), lambda e: abs(e - ret))) / nullif(count(ret) {X} - 1, 0) END AS dist
      FROM panel))"""

# statistics of lists over the same windows of eight rows (ret: x, volume: c, close: k)


def l_cos(a: str, b: str) -> str:
    size = lambda v: f"coalesce(list_sum(list_transform({v}, lambda e: e * e)), 0)"
    return div(f"coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])), 0)", f"(sqrt({size(a)}) * sqrt({size(b)}))")


def l_running(a: str) -> str:
    return f"list_transform(range(1, len({a}) + 1), lambda i: list_sum({a}[1:i]))"


def l_ranks(a: str) -> str:
    return f"list_transform(range(1, len({a}) + 1), lambda i: CASE WHEN {a}[i] IS NOT NULL THEN CAST(len(list_filter(range(1, len({a}) + 1), lambda j: {a}[j] < {a}[i] OR ({a}[j] = {a}[i] AND j <= i))) AS DOUBLE) END)"


def l_shares(a: str, buckets: int = 10) -> str:
    """The histogram of what is present, as shares; the largest value is in no bucket."""
    low, span = f"list_min({a})", f"(list_max({a}) - list_min({a}))"
    edge = lambda b: f"({low} + {span} * (CAST({b} AS DOUBLE) / {buckets}))"
    return f"list_transform(range({buckets}), lambda b: CAST(len(list_filter({a}, lambda v: v >= {edge('b')} AND v < {edge('b + 1')} AND v < list_max({a}))) AS DOUBLE))"


def l_part(a: str) -> str:
    return f"list_transform({a}, lambda e: e / nullif(list_sum({a}), 0))"


def l_sorted(a: str, by: str, sign: int) -> str:
    """The list in the order of another one, missing cells as the means."""
    cell = lambda v, i: f"coalesce({v}[{i}], list_avg({v}))"
    return f"list_transform(list_sort(list_transform(range(1, len({a}) + 1), lambda i: {{'k': {sign} * {cell(by, 'i')}, 'i': i, 'x': {cell(a, 'i')}}})), lambda z: z.x)"


def _corr_of(a: str, b: str) -> str:
    """Of lists of deviations; missing where one does not vary."""
    size = lambda v: f"sqrt(list_sum(list_transform({v}, lambda e: e * e)))"
    return f"(CASE WHEN {size(a)} > 1e-9 AND {size(b)} > 1e-9 THEN coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])), 0) / ({size(a)} * {size(b)}) END)"


_TAIL = "list_avg(list_transform(list_zip(x, c), lambda z: CASE WHEN {keep} THEN z[1] * abs(z[2]) / nullif(list_sum(list_transform(list_zip(x, c), lambda y: CASE WHEN {other} THEN abs(y[2]) END)), 0) END))"
_PAIRED_X, _PAIRED_C = "list_transform(list_zip(x, c), lambda z: CASE WHEN z[2] IS NOT NULL THEN z[1] END)", "list_transform(list_zip(x, c), lambda z: CASE WHEN z[1] IS NOT NULL THEN z[2] END)"
_power = lambda n: div(f"list_sum(list_transform(list_zip(dx, c), lambda z: power(z[1], {n}) * z[2]))", l_sum("c"))
LISTS = {
    "ts_kurt_selq": ("ts_kurt_selq(ret, volume, 8, 0.3, 0.8)", l_kurt("s")),
    "ts_skew_diff_selq": ("ts_skew_diff_selq(ret, volume, 8, 0.3, 0.8)", f"({l_skew('a')}) - ({l_skew('b')})"),
    "ts_kurt_diff_selq": ("ts_kurt_diff_selq(ret, volume, 8, 0.3, 0.8)", f"({l_kurt('a')}) - ({l_kurt('b')})"),
    "ts_skew_flip": ("ts_skew_flip(ret, volume, 8, 0.3, 0.8)", f"({l_skew('x')}) - ({l_skew('f')})"),
    "ts_kurt_flip": ("ts_kurt_flip(ret, volume, 8, 0.3, 0.8)", f"({l_kurt('x')}) - ({l_kurt('f')})"),
    "ts_qua_flip": ("ts_qua_flip(ret, volume, 8, 0.5, 0.3, 0.8)", f"({div(l_quantile('dx', 0.5), 'list_avg(dx)')}) - ({div(l_quantile('f', 0.5), 'list_avg(f)')})"),
    "ts_corr_flip": ("ts_corr_flip(ret, volume, 8, 0.3, 0.8)", l_cos("f", "dc")),
    "ts_corr_selq": ("ts_corr_selq(ret, volume, 8, 0.3, 0.8)", l_cos(l_dev("s"), l_dev("cs"))),
    "ts_cond_quantile_mean": ("ts_cond_quantile_mean(ret, volume, 8, 0.2, 0.8)", "list_avg(q)"),
    "ts_cond_quantile_stddev": ("ts_cond_quantile_stddev(ret, volume, 8, 0.2, 0.8)", l_std("q")),
    "ts_cond_quantile_skew": ("ts_cond_quantile_skew(ret, volume, 8, 0.2, 0.8)", l_skew("q")),
    "ts_cond_quantile_kurt": ("ts_cond_quantile_kurt(ret, volume, 8, 0.2, 0.8)", l_kurt("q")),
    "ts_cond_quantile_sum": ("ts_cond_quantile_sum(ret, volume, 8, 0.2, 0.8)", l_sum("q")),
    "ts_cond_quantile_corr": ("ts_cond_quantile_corr(ret, volume, 8, 0.2, 0.8)", l_cos(l_dev("qx"), l_dev("q"))),
    "ts_rankcorr": ("ts_rankcorr(ret, volume, 8)", l_cos(l_dev("rx"), l_dev("rc"))),
    "ts_sumprod_selq": ("ts_sumprod_selq(ret, volume, close, 8, 0.3, 0.8)", "CASE WHEN whole AND len(list_filter(k, lambda e: e IS NOT NULL)) = 8 THEN coalesce(list_sum(list_transform(range(1, 9), lambda i: CASE WHEN k[i] >= list_aggregate(k, 'quantile_cont', 0.3) AND k[i] <= list_aggregate(k, 'quantile_cont', 0.8) THEN x[i] * c[i] END)), 0) / list_sum(c) END"),
    "ts_spread_selq": ("ts_spread_selq(ret, volume, 8, 0.3, 0.3)", "list_avg(list_filter(x, lambda e: e >= cut_hi)) - list_avg(list_filter(x, lambda e: e <= cut_lo))"),
    "ts_spreadw_selq": ("ts_spreadw_selq(ret, volume, 8, 0.3, 0.3)", f"{_TAIL.format(keep='z[1] >= cut_hi', other='y[1] >= cut_hi')} - {_TAIL.format(keep='z[1] <= cut_lo', other='y[1] <= cut_lo')}"),
    "ts_triple_corr": ("ts_triple_corr(ret, volume, close, 8)", "CASE WHEN sqrt(list_sum(list_transform(dx, lambda e: e * e))) >= 1e-9 AND sqrt(list_sum(list_transform(dc, lambda e: e * e))) >= 1e-9 THEN coalesce(list_sum(list_transform(range(1, 9), lambda i: dx[i] * dc[i] * dk[i])), 0) / nullif(sqrt(list_sum(list_transform(dx, lambda e: e * e))) * sqrt(list_sum(list_transform(dc, lambda e: e * e))) * sqrt(list_sum(list_transform(dk, lambda e: e * e))), 0) END"),
    "ts_weighted_skew": ("ts_weighted_skew(ret, volume, 8)", f"list_avg(list_transform(list_zip(px, pc), lambda z: z[2] / nullif(list_sum(pc), 0) * power(z[1] - list_avg(px), 3))) / nullif(power({l_std('px')}, 3), 0)"),
    "ts_weighted_kurt": ("ts_weighted_kurt(ret, volume, 8)", f"{div(f'({_power(4)})', f'(({_power(2)}) * ({_power(2)}))')} - 3"),
    "ts_entropy": ("ts_entropy(close, 8)", "CASE WHEN list_sum(hk) > 0 THEN -coalesce(list_sum(list_transform(hk, lambda e: e / list_sum(hk) * log2(e / list_sum(hk) + 1e-9))), 0) / 10 + log2(10) END"),
    "ts_cross_entropy": ("ts_cross_entropy(close, volume, 8)", "-coalesce(list_sum(list_transform(list_zip(hk, hc), lambda z: z[1] / nullif(list_sum(hk), 0) * log2(z[2] / nullif(list_sum(hc), 0) + 1e-9))), 0) / 10 + log2(10)"),
    "ts_kl_diverg": ("ts_kl_diverg(close, volume, 8)", "coalesce(list_sum(list_transform(list_zip(hk, hc), lambda z: z[1] / nullif(list_sum(hk), 0) * (log2(z[1] / nullif(list_sum(hk), 0) + 1e-8) - log2(z[2] / nullif(list_sum(hc), 0) + 1e-8)))), 0) / 10"),
    "ts_sort_diffcumsum": ("ts_sort_diffcumsum(ret, volume, 8)", "list_sum(list_transform(list_zip(up, down), lambda z: z[1] - z[2]))"),
    "ts_sort_diff_tailsubhead": ("ts_sort_diff_tailsubhead(ret, volume, 8)", "list_avg(list_transform(list_zip(up[1:4], down[1:4]), lambda z: z[1] - z[2])) - list_avg(list_transform(list_zip(up[5:8], down[5:8]), lambda z: z[1] - z[2]))"),
    "ts_partial_corr": ("ts_partial_corr(ret, volume, close, 8)", div(f"({_corr_of('dx', 'dc')}) - ({_corr_of('dx', 'dk')}) * ({_corr_of('dc', 'dk')})", f"sqrt(greatest((1 - power({_corr_of('dx', 'dk')}, 2)) * (1 - power({_corr_of('dc', 'dk')}, 2)), 0))")),
    "ts_ewmstd": ("ts_ewmstd(close, 8)", f"sqrt({SELECTED['ts_ewmv'][1]})"),
    "ts_hurst": ("ts_hurst(close, 8)", f"CASE WHEN sqrt(list_sum(list_transform(dk, lambda e: e * e)) / 7) >= 1e-9 THEN ln(nullif(list_max(pk) - list_min(pk), 0) / sqrt(list_sum(list_transform(dk, lambda e: e * e)) / 7)) / ln(8) END"),
}
_LISTED_1 = f"""
  SELECT *, {l_dev('x')} AS dx, {l_dev('c')} AS dc, {l_dev('k')} AS dk, {_BAND.format(x='c', keep=_IN)} AS cs, {l_ranks('x')} AS rx, {l_ranks('c')} AS rc, {_PAIRED_X} AS px, {_PAIRED_C} AS pc,
    {l_shares('k')} AS hk, {l_shares('c')} AS hc, {l_sorted('x', 'c', 1)} AS ascending, {l_sorted('x', 'c', -1)} AS descending,
    list_sort(list_filter(list_transform(range(1, 9), lambda i: {{'c': c[i], 'i': i, 'x': x[i]}}), lambda z: z.c IS NOT NULL)) AS by_c FROM ({_BANDS})"""
_INNER = "list_transform(list_zip({0}, rx), lambda z: CASE WHEN z[2] / len(list_filter(x, lambda e: e IS NOT NULL)) >= 0.2 AND z[2] / len(list_filter(x, lambda e: e IS NOT NULL)) <= 0.8 THEN z[1] END)"
_LISTED = f"""
  SELECT *, {_INNER.format('c')} AS q, {_INNER.format('x')} AS qx, {l_running('ascending')} AS up, {l_running('descending')} AS down, by_c[2].x AS cut_lo, by_c[len(by_c) - 1].x AS cut_hi,
    list_transform(range(1, len(dk) + 1), lambda i: CASE WHEN dk[i] IS NOT NULL THEN list_sum(dk[1:i]) END) AS pk FROM ({_LISTED_1})"""

# rows against earlier ones


def _acf(k: int) -> str:
    return _corr_of(l_dev("k"), l_dev(f"k{k}"))


_LX = [math.log(k) for k in (1, 2, 3)]
_ACF_WEIGHTS = [(x - sum(_LX) / 3) / sum((y - sum(_LX) / 3) ** 2 for y in _LX) for x in _LX]
_ALPHA5, _BETA5 = f"least(greatest(var_samp(z) {W(5)}, 1e-8), 1e4)", f"least(greatest(1.0 / nullif(avg(z) {W(5)} + 1e-8, 0), 1e-8), 1e4)"
_EARLY5 = f"CASE WHEN t = 0 THEN z ELSE avg(z) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END"


def l_filled(a: str) -> str:
    return f"list_transform({a}, lambda e: coalesce(e, list_avg({a})))"


def _hawkes(weight: Callable[[int], str]) -> str:
    excited = " + ".join(f"coalesce({lag('z', k) if k else 'z'}, 0) * ({weight(k)})" for k in range(5))
    return f"CASE WHEN t < 4 THEN {_EARLY5} ELSE least(greatest(avg(z) {W(5)} + {_ALPHA5} * ({excited}), 0), 1e4) END"


def _first_slope(x: str, d: int) -> str:
    return full(d, f"coalesce(sum(t * {x}) {W(d)} - avg({x}) {W(d)} * sum(CASE WHEN {x} IS NOT NULL THEN t END) {W(d)}, 0) / nullif(var_pop({x}) {W(d)} * count({x}) {W(d)}, 0)")


def _quadratic(d: int) -> str:
    """The linear coefficient of the least-squares parabola over 0 to d - 1 times its R2, by normal equations in exact fractions."""
    from fractions import Fraction as Q

    rows = [[Q(k) ** i for i in range(3)] for k in range(d)]
    gram = [[sum(r[i] * r[j] for r in rows) for j in range(3)] + [Q(int(i == j)) for j in range(3)] for i in range(3)]
    for i in range(3):  # Gauss-Jordan
        gram[i] = [v / gram[i][i] for v in gram[i]]
        for j in range(3):
            if j != i:
                gram[j] = [v - gram[j][i] * w for v, w in zip(gram[j], gram[i], strict=True)]
    solve = [[sum(gram[i][3 + j] * r[j] for j in range(3)) for r in rows] for i in range(3)]
    dot = lambda weights: "(" + " + ".join(f"{float(w)!r} * l{k}" for k, w in enumerate(weights)) + ")"
    fit = lambda k: dot([sum(rows[k][i] * solve[i][j] for i in range(3)) for j in range(d)])
    mean = f"(({' + '.join(f'l{k}' for k in range(d))}) / {d})"
    rest, whole = (f"({' + '.join(f'power(l{k} - {of(k)}, 2)' for k in range(d))})" for of in (fit, lambda k: mean))
    return f"{dot(solve[1])} * (1 - ({div(rest, whole)}))"


_FIRST_FULL = "OVER (PARTITION BY code ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_start = lambda x: f"coalesce({x}, first_value({x} IGNORE NULLS) {_FIRST_FULL})"
BEFORE = {
    "ts_autocorr": ("ts_autocorr(close, 8, 1)", full(8, _acf(1))),
    "ts_autocos": ("ts_autocos(close, 8, 1)", full(8, div(f"coalesce(sum(close * c1) {W(8)}, 0)", f"(sqrt(sum(close * close) {W(8)}) * sqrt(sum(c1 * c1) {W(8)}))"))),
    "ts_autocorr_reg": ("ts_autocorr_reg(close, 8, 3)", full(11, " + ".join(f"{_acf(k)} * {w!r}" for k, w in zip((1, 2, 3), _ACF_WEIGHTS, strict=True)))),
    "ts_first_deriv": ("ts_first_deriv(close, 6)", _first_slope("close", 6)),
    "ts_second_deriv": ("ts_second_deriv(close, 4)", full(7, _first_slope("slope4", 4))),
    "ts_hawkes_exp": ("ts_hawkes_pred_exp_fast(ret, 5)", _hawkes(lambda k: f"exp(-({_BETA5}) * {k})")),
    "ts_hawkes_power": ("ts_hawkes_pred_powerlaw_fast(ret, 5)", _hawkes(lambda k: repr((k + 1) ** -1.5))),
    "ts_mad_med": ("ts_mad_med(close, 6)", full(6, l_median("away6"))),
    "ts_poly2_trend": ("ts_poly2_trend(close, 8)", full(8, _quadratic(8))),
    "ts_demean_sum": ("ts_demean_sum(close, 5)", full(5, f"CASE WHEN count(close) {W(5)} > 0 THEN 0.0 END")),
    "ts_adaptive_sampling": ("ts_adaptive_sampling(ret, volume, 10, 20)", f"coalesce(last_value(CASE WHEN volume >= edge THEN ret END IGNORE NULLS) OVER (PARTITION BY code ORDER BY t ROWS UNBOUNDED PRECEDING), first_value(ret) {_FIRST_FULL})"),
    "ts_newey_west_se": ("ts_newey_west_se(volume, close, 8)", "CASE WHEN t >= 7 THEN " + f"sqrt(greatest(nw0 + 2 * (1 - 1 / 3.0) * nw1 + 2 * (1 - 2 / 3.0) * nw2, 0)) / nwx END"),
}
_BEFORE_1 = f"""
  SELECT *, {", ".join(f"lag(close, {k}) {H} AS c{k}" for k in (1, 2, 3))}, coalesce(ret, 0) AS z, {_first_slope("close", 4)} AS slope4, {", ".join(f"{lag('close', 7 - k) if k < 7 else 'close'} AS l{k}" for k in range(8))},
    {full(6, l_median(lst(6, "close")))} AS med6, {full(20, f"quantile_cont(volume, 0.7) {W(20)}")} AS q20, {full(10, f"avg(volume) {W(10)}")} AS a10, {full(20, f"avg(volume) {W(20)}")} AS a20, {full(10, f"stddev_samp(volume) {W(10)}")} AS s10 FROM panel"""
_BEFORE_2 = f"""SELECT *, {lst(8, "close")} AS k, {", ".join(f"{lst(8, f'c{k}')} AS k{k}" for k in (1, 2, 3))}, abs(close - med6) AS away, {_start("q20")} AS q, {_start("a10")} AS short, {_start("a20")} AS long, {_start("s10")} AS spread,
  {l_filled(lst(8, "volume"))} AS v, {l_filled(lst(8, "close"))} AS kf FROM ({_BEFORE_1})"""
_BEFORE_3 = f"""SELECT *, {lst(6, "away")} AS away6, q * CASE WHEN short > long THEN 1.2 ELSE 1.0 END * CASE WHEN spread > quantile_cont(spread, 0.5) OVER (PARTITION BY code) THEN 1.2 ELSE 0.8 END AS edge,
  {l_dev("v")} AS dv, {l_dev("kf")} AS dk FROM ({_BEFORE_2})"""
_SLOPE = "(list_sum(list_transform(list_zip(dv, dk), lambda z: z[1] * z[2])) / list_sum(list_transform(dv, lambda e: e * e)))"
_BEFORE_4 = f"""SELECT *, list_transform(range(1, len(dv) + 1), lambda i: dv[i] * (dk[i] - {_SLOPE} * dv[i])) AS u, list_sum(list_transform(dv, lambda e: e * e)) AS nwx FROM ({_BEFORE_3})"""
_BEFORE = "SELECT *, " + ", ".join(f"coalesce(list_sum(list_transform(range({k + 1}, len(u) + 1), lambda i: u[i] * u[i - {k}])), 0) AS nw{k}" for k in range(3)) + f" FROM ({_BEFORE_4})"

# codes against each other
_TMED = lambda x: f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL) {X})[(count({x}) {X} + 1) // 2]"
_ORTH = f"(fr - ({div(f'sum(fr * fv) {X}', f'(sum(fv * fv) {X})')}) * fv)"
_proj = lambda of, on: f"({div(f'sum({of} * {on}) {X}', f'(sum({on} * {on}) {X})')}) * {on}"
_row = lambda a, b, w: div(f"covar_pop({a}, {b}) {w}", f"(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) {w} * stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) {w})")
_ALL_CODES, _OWN = "OVER (PARTITION BY t)", "OVER (PARTITION BY code)"
_whole = lambda a, b, w: f"count({a}) {w} = count(*) {w} AND count({b}) {w} = count(*) {w}"
_SCALED = f"CASE WHEN max(vw) {X} - min(vw) {X} <= 1e-9 THEN CASE WHEN vw IS NOT NULL THEN 0.5 END ELSE (vw - min(vw) {X}) / (max(vw) {X} - min(vw) {X}) END"
CROSSED = {
    "cs_orth_sub": ("cs_orth_sub(ret, volume)", f"volume - {_ORTH}"),
    "cs_orth_mul": ("cs_orth_mul(ret, volume)", f"volume * {_ORTH}"),
    "cs_orth_div": ("cs_orth_div(ret, volume)", div("volume", _ORTH)),
    "cs_schmidt": ("cs_schmidt(close, volume, ret)", f"close - {_proj('close', 'volume')} - {_proj('close', 'ret')}"),
    "cs_schmidt_sum": ("cs_schmidt_sum(volume, close)", f"volume + close - {_proj('close', 'volume')}"),
    "cs_rank_mad": ("cs_rank_mad(close)", f"CASE WHEN cr IS NOT NULL THEN least(greatest(cr, crm - 3 * 1.4826 * {_TMED('crd')}), crm + 3 * 1.4826 * {_TMED('crd')}) END"),
    "cs_group_rank_neutralize": ("cs_group_rank_neutralize(close, volume, 5)", "dgr / max(dgr) OVER (PARTITION BY t, vb)"),
    "cs_decompose": ("cs_decompose(close, volume)", f"close / (1 + exp(-({_SCALED})))"),
    "cs_decompose_tanh": ("cs_decompose(close, volume, 4, 1)", f"close * tanh({_SCALED})"),
    "corr_row": ("corr_row(high, volume)", f"CASE WHEN {_whole('high', 'volume', _ALL_CODES)} THEN {_row('high', 'volume', _ALL_CODES)} END"),
    "corr_col": ("corr_col(high, volume)", f"CASE WHEN {_whole('high', 'volume', _OWN)} THEN {_row('high', 'volume', _OWN)} END"),
    "adj_cs_corr": ("adj_cs_corr(close, volume)", "(SELECT avg(r) / stddev_pop(r) FROM (SELECT t, corr(close, volume) AS r FROM panel GROUP BY t) WHERE r IS NOT NULL)"),
    "cs_marketcorr": ("cs_marketcorr(close, 6)", "mc"),
    "cs_marketcorr2": ("cs_marketcorr2(close, 6)", "coalesce(first_value(mce IGNORE NULLS) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), last_value(mce IGNORE NULLS) OVER (PARTITION BY code ORDER BY t ROWS UNBOUNDED PRECEDING))"),
    "cs_marketcorrw": ("cs_marketcorrw(ret, close)", "(SELECT nullif(sum(o.ret * m.c), 0) FROM panel o JOIN pairs m ON m.b = o.code WHERE o.t = base.t AND m.a = base.code)"),
    "cs_mean_distance_1": ("cs_mean_distance(1, close, volume)", "d_close + d_volume"),
    "cs_mean_distance_2": ("cs_mean_distance(2, close, volume)", "(SELECT sum(sqrt(power(o.close - base.close, 2) + power(o.volume - base.volume, 2))) / (count(*) - 1) / 2 FROM panel o WHERE o.t = base.t AND o.close IS NOT NULL AND o.volume IS NOT NULL AND base.close IS NOT NULL AND base.volume IS NOT NULL)"),
    "fill_with_mean": ("fill_with_mean(close)", f"coalesce(close, avg(close) {X})"),
    "cs_group_demean_2": ("cs_group_demean_2(close, sector)", "close - avg(close) OVER (PARTITION BY t, sector)"),
    "get_e_tensor": ("get_e_tensor(ret, 2.5)", "CAST(2.5 AS DOUBLE)"),
    "max": ("max(high, ret)", "CASE WHEN high IS NOT NULL AND ret IS NOT NULL THEN greatest(high, ret) END"),
    "min": ("min(low, ret)", "CASE WHEN low IS NOT NULL AND ret IS NOT NULL THEN least(low, ret) END"),
}
_away = lambda x: f"list_sum(list_transform(list({x}) {X}, lambda e: abs(e - {x}))) / nullif(count({x}) {X} - 1, 0)"
_CROSS_1 = f"""
  SELECT *, coalesce(ret, avg(ret) OVER ()) AS fr, coalesce(volume, avg(volume) OVER ()) AS fv, CASE WHEN close IS NOT NULL THEN row_number() OVER (PARTITION BY t ORDER BY close NULLS LAST, code) END / CAST(count(close) {X} AS DOUBLE) AS cr,
    {_TMED("volume")} AS vmed, CASE WHEN volume IS NOT NULL THEN {" + ".join(f"CASE WHEN volume > quantile_cont(volume, {k / 5}) {X} THEN 1 ELSE 0 END" for k in range(1, 5))} END AS vb, {lst(6, "close")} AS six,
    CASE WHEN close IS NOT NULL THEN {_away("close")} END AS d_close, CASE WHEN volume IS NOT NULL THEN {_away("volume")} END AS d_volume, count(close) {W(6)} = 6 AND t >= 5 AS all6 FROM panel"""
_CROSS_2 = f"""SELECT *, {_TMED("cr")} AS crm, abs(volume - vmed) AS vaway, CASE WHEN close IS NOT NULL AND vb IS NOT NULL THEN CAST(dense_rank() OVER (PARTITION BY t, vb ORDER BY close NULLS LAST) AS DOUBLE) END AS dgr,
  CASE WHEN all6 AND list_aggregate(six, 'stddev_pop') * sqrt(6) > 1e-9 THEN list_transform(six, lambda e: (e - list_avg(six)) / (list_aggregate(six, 'stddev_pop') * sqrt(6))) END AS unit FROM ({_CROSS_1})"""
_CROSS_3 = f"""SELECT *, abs(cr - crm) AS crd, CASE WHEN volume IS NOT NULL THEN least(greatest(volume, vmed - 4 * {_TMED("vaway")}), vmed + 4 * {_TMED("vaway")}) END AS vw,
  ({" + ".join(f"unit[{k}] * sum(unit[{k}]) {X}" for k in range(1, 7))}) / count(unit) {X} AS mc FROM ({_CROSS_2})"""
_CROSSED = f"SELECT *, CASE WHEN (t + 1) % 6 = 0 THEN mc END AS mce FROM ({_CROSS_3})"
_MARKETS = ("cs_marketcorr", "cs_marketcorr2", "cs_marketcorrw", "cs_mean_distance_1", "cs_mean_distance_2")
#: Correlations of all pairs of codes over the whole history.
_PAIRS = f"""pairs AS (SELECT x.code AS a, y.code AS b, {div("covar_pop(x.close, y.close)", "(stddev_pop(CASE WHEN y.close IS NOT NULL THEN x.close END) * stddev_pop(CASE WHEN x.close IS NOT NULL THEN y.close END))")} AS c FROM panel x JOIN panel y ON x.t = y.t GROUP BY ALL)"""

# rolling least squares by normal equations, recursions, self-similarity
def l_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


_DET = "(saa * sbb - sab * sab)"
_B1, _B2 = f"((say * sbb - sby * sab) / nullif({_DET}, 0))", f"((sby * saa - say * sab) / nullif({_DET}, 0))"
_B0 = f"(my - {_B1} * ma - {_B2} * mb)"
_SSE = f"(syy - {_B1} * say - {_B2} * sby)"
_RIDGE_DET = "(110.0 * (raa + 100) - ra * ra)"
_RIDGE = f"((ry * (raa + 100) - ra * ray) / {_RIDGE_DET} + (110.0 * ray - ra * ry) / {_RIDGE_DET} * la[10])"
_NEAR = lambda k: f"list_avg(list_transform(range(1, {14 - k}), lambda i: ln(len(list_filter(range(1, {14 - k}), lambda j: greatest({', '.join(f'abs(w[i + {q}] - w[j + {q}])' for q in range(k))}) <= 0.15 * wsd)) / CAST({13 - k} AS DOUBLE))))"


def _rescaled(parts: int, rows: int = 24) -> str:
    """The mean of range over deviation of the running deviations, over the chunks of a block that vary."""
    size = rows // parts
    each = []
    for c in range(parts):
        chunk = f"block[{c * size + 1}:{(c + 1) * size}]"
        dev = f"list_transform({chunk}, lambda e: e - list_avg({chunk}))"
        run = f"list_transform(range(1, {size + 1}), lambda i: list_sum(({dev})[1:i]))"
        each.append(f"CASE WHEN {l_std(chunk)} > 1e-9 THEN (list_max({run}) - list_min({run})) / {l_std(chunk)} END")
    return f"list_avg([{', '.join(each)}])"


_PARTS = (2, 3, 4, 6, 8, 12)
_POINTS = "list_filter([" + ", ".join(f"{{'x': ln({24 // q}), 'y': CASE WHEN rs{q} > 0 THEN ln(rs{q}) END}}" for q in _PARTS) + "], lambda z: z.y IS NOT NULL)"
_MEAN_X, _MEAN_Y = "list_avg(list_transform(pts, lambda z: z.x))", "list_avg(list_transform(pts, lambda z: z.y))"


def _fluctuation(s: int, k: int = 3) -> str:
    whole = f"list(total) {W(k * s)}"
    blocks = [f"({whole})[{j * s + 1}:{(j + 1) * s}]" for j in range(k)]
    squares = " || ".join(f"list_transform({b}, lambda e: power(e - list_avg({b}), 2))" for b in blocks)
    return full(k * s, f"CASE WHEN list_avg({squares}) > 0 THEN ln(sqrt(list_avg({squares}))) END")


_SCALES = (2, 3, 4, 5)
_SIZES = [math.log(q) - sum(map(math.log, _SCALES)) / 4 for q in _SCALES]
# where two ways of solving differ in the last digits, scaled down before both are rounded to six digits
FITS = {
    "multi_sse": ("ts_multiregsse(close, 10, volume, high)", _SSE),
    "multi_r2": ("ts_multiregrsquare(close, 10, volume, high)", f"1 - {_SSE} / syy"),
    "multi_f": ("ts_multiregfvalue(close, 10, volume, high)", f"(syy - {_SSE}) / 2 / ({_SSE} / 7)"),
    "multi_beta": ("mul_element_wise(ts_multiregbeta(close, 10, volume, high), 0.0001)", f"({_B1} + {_B2}) / 2 * 0.0001"),
    "multi_alpha": ("mul_element_wise(ts_multireg_alpha(close, 10, volume, high), 0.00001)", f"{_B0} * 0.00001"),
    "ols_1": ("ts_multiregression_getparams(close, volume, 10, 1)", "say / nullif(saa, 0)"),
    "ols_2d": ("mul_element_wise(ts_multireg_2d(volume, high, close, 10, 1), 0.0001)", f"{_B1} * 0.0001"),
    "ridge": ("ts_ridgeregression_pred(close, volume, 10)", _RIDGE),
    "ridge_rest": ("ts_ridgeregression_res(close, volume, 10)", f"close - {_RIDGE}"),
    "var_1": ("ts_VAR_get_params(close, 12, 2, 1)", full(12, "(v1y * v22 - v2y * v12) / nullif(v11 * v22 - v12 * v12, 0)")),
    "cs_multi": ("cs_multireg_pred(close, volume, high)", "CASE WHEN cok AND cn > 3 THEN cmy + cb1 * (volume - cma) + cb2 * (high - cmb) END"),
    "ts_ema": ("ts_ema(close, 5)", "ema"),
    "supersmoother": ("ts_supersmoother_filter(close, 10, 5)", "CASE WHEN t >= 4 THEN smooth END"),
    "apen": ("ts_apen(close, 2, 12)", full(12, f"CASE WHEN wn = 12 AND wsd > 0 THEN {_NEAR(2)} - {_NEAR(3)} END")),
    "hurst": ("rs_Hurst(close)", "CAST(NULL AS DOUBLE)"),  # 83 rows have no divisor
    "block_hurst": ("ts_rs_Hurst(close, 24)", f"CASE WHEN len(block) = 24 AND len(pts) > 1 THEN list_sum(list_transform(pts, lambda z: (z.x - {_MEAN_X}) * (z.y - {_MEAN_Y}))) / list_sum(list_transform(pts, lambda z: power(z.x - {_MEAN_X}, 2))) END"),
    "dfa": ("ts_dfa(close, 6, 3, 2, 3, 4, 5)", "(" + " + ".join(f"coalesce((f{q} - list_avg([f2, f3, f4, f5])) * {w!r}, 0)" for q, w in zip(_SCALES, _SIZES, strict=True)) + f") / {sum(w * w for w in _SIZES)!r}"),
}
_TEN = {"ly": "close", "la": "volume", "lb": "high"}
_FIT_0 = f"""SELECT *, lag(close, 1) {H} AS c1, lag(close, 2) {H} AS c2, close IS NOT NULL AND volume IS NOT NULL AND high IS NOT NULL AS cok, t // 24 AS part, {full(6, f"avg(close) {W(6)}")} AS m6 FROM panel"""
_FIT_1 = f"""SELECT *, {", ".join(f"{full(10, l_filled(lst(10, x)))} AS {n}" for n, x in _TEN.items())}, {l_filled(lst(12, "close"))} AS y12, {l_filled(lst(12, "c1"))} AS x12, {l_filled(lst(12, "c2"))} AS z12, {lst(12, "close")} AS w,
  {l_filled("list(close) OVER (PARTITION BY code, part ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")} AS block, {full(6, f"coalesce(sum(close - m6) {W(6)}, 0)")} AS total,
  count(CASE WHEN cok THEN 1 END) {X} AS cn, avg(CASE WHEN cok THEN close END) {X} AS cmy, avg(CASE WHEN cok THEN volume END) {X} AS cma, avg(CASE WHEN cok THEN high END) {X} AS cmb,
  {", ".join(f"covar_pop(CASE WHEN cok THEN {a} END, CASE WHEN cok THEN {b} END) {X} AS {n}" for n, a, b in (("caa", "volume", "volume"), ("cab", "volume", "high"), ("cbb", "high", "high"), ("cay", "volume", "close"), ("cby", "high", "close")))} FROM ({_FIT_0})"""
_FIT_2 = f"""SELECT *, {", ".join(f"{l_dev(n)} AS d{n[1]}" for n in _TEN)}, {l_dev("y12")} AS dy12, {l_dev("x12")} AS dx12, {l_dev("z12")} AS dz12, list_avg(ly) AS my, list_avg(la) AS ma, list_avg(lb) AS mb, list_sum(la) AS ra, list_sum(ly) AS ry,
  {l_dot("la", "la")} AS raa, {l_dot("la", "ly")} AS ray, list_aggregate(w, 'stddev_pop') AS wsd, len(list_filter(w, lambda e: e IS NOT NULL)) AS wn, {", ".join(f"{_rescaled(q)} AS rs{q}" for q in _PARTS)}, {", ".join(f"{_fluctuation(q)} AS f{q}" for q in _SCALES)},
  (cay * cbb - cby * cab) / nullif(caa * cbb - cab * cab, 0) AS cb1, (cby * caa - cay * cab) / nullif(caa * cbb - cab * cab, 0) AS cb2 FROM ({_FIT_1})"""
_FIT = f"""SELECT f.*, {", ".join(f"{l_dot('d' + a, 'd' + b)} AS s{a}{b}" for a, b in (("a", "a"), ("a", "b"), ("b", "b"), ("a", "y"), ("b", "y"), ("y", "y")))}, {_POINTS} AS pts,
  {", ".join(f"{l_dot(f'd{a}12', f'd{b}12')} AS v{n}" for n, a, b in (("11", "x", "x"), ("12", "x", "z"), ("22", "z", "z"), ("1y", "x", "y"), ("2y", "z", "y")))}, r.ema, r.smooth FROM ({_FIT_2}) f JOIN smoothed r ON r.code = f.code AND r.t = f.t"""
_A10 = math.exp(-math.sqrt(2) * math.pi / 10)
_C2, _C3 = 2 * _A10 * math.cos(math.sqrt(2) * math.pi / 10), -_A10 * _A10
_SMOOTHED = f"""starts AS (SELECT code, avg(close) AS m FROM panel WHERE t < 5 GROUP BY code),
smoothed(code, t, x, ema, smooth, before) AS (
  SELECT code, -1, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM (SELECT DISTINCT code FROM panel)
  UNION ALL
  SELECT p.code, p.t, p.close, CASE WHEN p.t = 4 THEN s.m WHEN p.t > 4 THEN CASE WHEN p.close IS NULL THEN r.ema ELSE p.close / 3 + r.ema * 2 / 3 END END,
    CASE WHEN p.t < 2 OR r.smooth IS NULL OR r.before IS NULL OR r.x IS NULL THEN p.close ELSE {1 - _C2 - _C3!r} * (p.close + r.x) / 2 + {_C2!r} * r.smooth + {_C3!r} * r.before END, r.smooth
  FROM smoothed r JOIN panel p ON p.code = r.code AND p.t = r.t + 1 JOIN starts s ON s.code = p.code)"""

# the last occurrence of the row structs above needs the first row of equals: smallest t for both extremes
ROLLING["ts_argmin"] = ("ts_argmin(close, 5)", full(5, f"(t - (min(CASE WHEN close IS NOT NULL THEN {{'v': close, 't': t}} END) {W(5)}).t + 1) / 5.0"))
ROLLING["ts_argmax"] = ("ts_argmax(close, 5)", full(5, f"(t - (min(CASE WHEN close IS NOT NULL THEN {{'v': -close, 't': t}} END) {W(5)}).t + 1) / 5.0"))
ROLLING["ts_dist_to_high"] = ("ts_dist_to_high(close, 5)", full(5, f"CAST(t - (min(CASE WHEN close IS NOT NULL THEN {{'v': -close, 't': t}} END) {W(5)}).t AS DOUBLE)"))
ROLLING["ts_dist_to_min"] = ("ts_dist_to_min(close, 5)", full(5, f"CAST(t - (min({{'v': coalesce(close, -1e308), 't': t}}) {W(5)}).t AS DOUBLE)"))

FAMILIES: dict[str, tuple[dict[str, tuple[str, str]], str]] = {
    "operators_arithmetic": (ARITHMETIC, _PLAIN),
    "operators_logic": (LOGIC, _PLAIN),
    "operators_rolling": (ROLLING, _PLAIN),
    "operators_pairs": (PAIR_STATS, _PAIR_BASE),
    "operators_selected": (SELECTED, _BANDS),
    "operators_across": (ACROSS, _PLAIN),
    "operators_layered": (LAYERED, _LAYERS),
    "operators_lists": (LISTS, _LISTED),
    "operators_before": (BEFORE, _BEFORE),
    "operators_fits": (FITS, _FIT),
    "operators_crossed": ({k: v for k, v in CROSSED.items() if k not in _MARKETS}, _CROSSED),
    "operators_markets": ({k: CROSSED[k] for k in _MARKETS}, _CROSSED),
}
#: Of these operators warm-up rows are NULL in SQL too.
_WARM = {"operators_pairs": 8, "operators_selected": 8, "operators_lists": 8}
_NO_WARM_UP = {"ts_sum_selq"}


def _query(columns: dict[str, tuple[str, str]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: rounded(evaluate(month_panel(spark, folder), {name: e for name, (e, _) in columns.items()}), "code", "t")


def _cell(name: str, e: str, warm: int) -> str:
    if name[:2] == "b_":
        return f"{e} AS {name}"
    if warm and name not in _NO_WARM_UP:
        e = full(warm, e)
    return f"CASE WHEN isfinite(CAST({e} AS DOUBLE)) THEN CAST({e} AS DOUBLE) END AS {name}"


def _sql(columns: dict[str, tuple[str, str]], base: str, warm: int) -> str:
    cells = ",\n  ".join(_cell(name, e, warm) for name, (_, e) in columns.items())
    outer = ",\n  ".join(name if name[:2] == "b_" else f"{rounded_sql(name)} AS {name}" for name in columns)
    more = _PAIRS if "cs_marketcorrw" in columns else _SMOOTHED if columns is FITS else ""
    return f"WITH {'RECURSIVE ' if columns is FITS else ''}{MONTH_PANEL_SQL},\n{more + ", " if more else ""}base AS ({base}),\ncells AS (SELECT code, t,\n  {cells}\nFROM base)\nSELECT code, t,\n  {outer}\nFROM cells"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(columns) for name, (columns, _) in FAMILIES.items()}
SQL: dict[str, str] = {name: _sql(columns, base, _WARM.get(name, 0)) for name, (columns, base) in FAMILIES.items()}
