"""Queries over the monthly panel: factor library, labels, universe, information coefficients, quantile returns; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.factors import daily
from tessera.plans import evaluate, labels, universe
from tessera.plans.expression import evaluate as expressions
from tessera.queries.operators import H, W, div, rounded, rounded_sql
from tessera.sources.panel import MONTH_PANEL_SQL, month_panel

FLAGSHIP = "cs_rank(ts_mean(ts_return(close, 1), 5))"


def _traded(spark: SparkSession, folder: str) -> DataFrame:
    """The panel with a turnover rate and a market value."""
    return month_panel(spark, folder).withColumns({"turnover_rate": F.col("volume") / 1000, "market_value": F.col("close") * 1e6})


def factors_windows(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(daily.windows(_traded(spark, folder)), "code", "t")


def factors_recursive(spark: SparkSession, folder: str) -> DataFrame:
    """mass_idx divides by differences of means that may be next to nothing: in thousands, so that six digits are sound."""
    return rounded(daily.recursive(month_panel(spark, folder)).withColumn("mass_idx", F.col("mass_idx") / 1000), "code", "t")


def factors_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Each code's factors on its last row, from at most 60 rows."""
    out = daily.pool(_flagged(spark, folder).withColumns({"turnover_rate": F.col("volume") / 1000, "market_value": F.col("close") * 1e6}))
    whole = [c for c, k in out.dtypes if k != "double"]
    return rounded(out, *whole)


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    """The panel with limits 10 % about the last close, and flags."""
    p = month_panel(spark, folder)
    return p.withColumns({"is_limit_up": (F.col("ret") > 0.1).cast("int"), "is_limit_down": (F.col("ret") < -0.1).cast("int"), "is_one_word_up": ((F.col("ret") > 0.1) & (F.col("open") == F.col("high"))).cast("int")})


def factors_limits(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(daily.limits(_flagged(spark, folder)), "code", "t", "consecutive_limit_up", "is_limit_up_today", "is_limit_down_today", "is_one_word_up_today")


def factors_known_before(spark: SparkSession, folder: str) -> DataFrame:
    one = expressions(month_panel(spark, folder), {"momentum": "ts_return(close, 5)"})
    return rounded(daily.known_before(one), "code", "t")


def _priced(spark: SparkSession, folder: str) -> DataFrame:
    """The panel with what labels need: price, pre_close, limits."""
    from pyspark.sql import Window

    prev = F.lag("close").over(Window.partitionBy("code").orderBy("t"))
    return month_panel(spark, folder).withColumns({"price": (F.col("open") + F.col("close")) / 2, "pre_close": prev, "limit_up": prev * 1.1, "limit_down": prev * 0.9, "buy_open": F.col("open"), "sell_open": F.col("open")})


def labels_forward(spark: SparkSession, folder: str) -> DataFrame:
    p = _priced(spark, folder)
    out = labels.winsorized(labels.forward_return(p), 3.0).select("code", "t", F.col("label").alias("forward"))
    out = out.join(labels.open_to_open(p).select("code", "t", F.col("label").alias("open_to_open")), ["code", "t"])
    return rounded(out.join(labels.close_to_preclose(p).select("code", "t", F.col("label").alias("close_to_preclose")), ["code", "t"]), "code", "t")


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    s = spark.read.parquet(f"{folder}/supplier.parquet")
    code = F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code")
    into = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("s_suppkey") % 50 * 20).cast("int")).alias("into_date")
    return s.select(code, into, F.when(F.col("s_suppkey") % 7 == 0, F.lit("1997-06-30").cast("date")).alias("out_date"))


def _universe(spark: SparkSession, folder: str) -> DataFrame:
    p = _priced(spark, folder)
    special = p.where((F.col("ret") < -0.8) & F.col("ret").isNotNull()).select("code", "trade_date", F.lit(1).alias("flag"))
    return universe.judged(p, _listed(spark, folder), special, prefixes=("00003",), limit="limit_up")


def universe_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return _universe(spark, folder).select("code", "t", "reason")


def universe_waterfall(spark: SparkSession, folder: str) -> DataFrame:
    return universe.waterfall(_universe(spark, folder))


def scored(spark: SparkSession, folder: str, **factors: str) -> DataFrame:
    """(factor, trade_date, code, score, label): expressions against the next row's return."""
    panel = month_panel(spark, folder)
    named = factors or {"momentum": FLAGSHIP, "volume": "cs_rank(ts_mean(volume, 3))"}
    values = expressions(panel, {**named, "label": "ts_shift(ret, 1)"}, "trade_date")
    return evaluate.long_form(values, list(named), "trade_date", "code", "label")


def ic_daily(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.daily_ic(scored(spark, folder)), "factor", "trade_date", "n")


SEGMENTS = {"train": (None, "1995-12-31"), "test": ("1996-01-01", None), "overall": (None, None)}


def ic_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.ic_summary(evaluate.daily_ic(scored(spark, folder)), SEGMENTS), "factor", "segment", "metric", "n")


def quantile_returns(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.quantile_returns(scored(spark, folder), 5, "factor", "trade_date"), "factor", "trade_date", "bucket", "n")


def group_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Five even groups a day, remainder in the last, against the label one row later, and their summary over 243 days."""
    groups = evaluate.even_groups(evaluate.shifted(scored(spark, folder)), 5, "factor", "trade_date")
    return rounded(evaluate.group_summary(groups, "factor"), "factor", "group", "n")


def top_tail(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.top_tail(scored(spark, folder), [5, 10], "factor", "trade_date"), "factor", "trade_date")


def performance(spark: SparkSession, folder: str) -> DataFrame:
    buckets = evaluate.quantile_returns(scored(spark, folder), 5, "factor", "trade_date").withColumn("ret", F.col("ret") / 100)
    return rounded(evaluate.performance(buckets, "factor", "bucket"), "factor", "bucket", "n")


def ensemble_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = scored(spark, folder).withColumnRenamed("factor", "model").where("score is not null")
    return rounded(evaluate.ensemble(s, ["momentum", "volume"]), "trade_date", "code")


def score_correlations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.score_correlations(scored(spark, folder).withColumnRenamed("factor", "model")), "a", "b")


def folds(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.folds(month_panel(spark, folder))


_P = "OVER (PARTITION BY code ORDER BY t)"


def r(agg: str, x: str, w: int, least: int | None = None) -> str:
    least = max(1, w // 2) if least is None else least
    return f"CASE WHEN count({x}) {W(w)} >= {least} THEN {agg}({x}) {W(w)} END"


_share = lambda a, b: f"CASE WHEN abs({b}) <= 1e-9 THEN 0.0 ELSE {a} / nullif({b}, 0) END"
_unless = lambda d, x: f"CASE WHEN {d} <= 1e-9 THEN 0.0 ELSE {x} END"
_ma = lambda w, least=None: f"({r('avg', 'close', w, least)})"
_sum = lambda x, w: f"({r('sum', x, w, 1)})"
_mean = lambda x, w, least=1: f"({r('avg', x, w, least)})"
_sd = lambda x, w, least=1: f"({r('stddev_samp', x, w, least)})"
_SECOND: dict[str, str] = {}
for _w in (5, 10, 20):
    _SECOND |= {f"ret_std_{_w}d": r("stddev_samp", "ret", _w), f"amplitude_mean_{_w}d": r("avg", "amp", _w), f"avg_amount_{_w}d": r("avg", "amount", _w), f"avg_volume_{_w}d": r("avg", "volume", _w), f"avg_turnover_{_w}d": r("avg", "turnover", _w)}
    _SECOND |= {f"ma{_w}": r("avg", "close", _w), f"momentum_{_w}d": f"close / nullif(lag(close, {_w}) {H}, 0)"}
for _w in (3, 5, 10, 20):
    _SECOND[f"cum_return_{_w}d"] = f"close / nullif(lag(close, {_w}) {H}, 0) - 1"
for _w in (5, 14, 20):
    _SECOND |= {f"atr_{_w}": r("avg", "tr", _w), f"atr_ratio_{_w}": f"({r('avg', 'tr', _w)}) / nullif(close, 0)"}
for _w in (7, 13, 26):
    _SECOND |= {f"br_{_w}": f"100 * ({_share(_sum('long', _w), _sum('short', _w))})", f"ar_{_w}": f"100 * ({_share(_sum('push', _w), _sum('pull', _w))})", f"psy_{_w}": f"{_sum('rose', _w)} / {_w}.0 * 100"}
for _w in (6, 12, 24):
    _SECOND[f"bias_{_w}"] = f"CASE WHEN {_ma(_w)} > 0 THEN 100 * (close - {_ma(_w)}) / {_ma(_w)} WHEN {_ma(_w)} IS NOT NULL THEN 0.0 END"
for _w in (5, 14, 20):
    _held = f"list_filter(list((high + low + close) / 3) {W(_w)}, lambda x: x IS NOT NULL)"
    _apart = f"list_avg(list_transform({_held}, lambda x: abs(x - list_avg({_held}))))"
    _SECOND[f"cci_{_w}"] = f"CASE WHEN (high + low + close) / 3 IS NOT NULL AND len({_held}) >= {_w // 2} THEN CASE WHEN {_apart} > 0 THEN ((high + low + close) / 3 - list_avg({_held})) / (0.015 * {_apart}) ELSE 0.0 END END"
for _w in (7, 13):
    _SECOND[f"ppr_{_w}"] = _share(_mean("up_pen", _w), _mean("down_pen", _w))
_GAIN, _LOSS = f"({_sum('gain', 14)} / ({_sum('upf', 14)} + 1e-5))", f"({_sum('loss', 14)} / ({_sum('downf', 14)} + 1e-5))"
_HI, _LO = f"({r('max', 'high', 20, 1)})", f"({r('min', 'low', 20, 1)})"
_HI9, _LO9 = f"({r('max', 'high', 9, 1)})", f"({r('min', 'low', 9, 1)})"
_FULL9 = f"({r('max', 'high', 9, 9)})", f"({r('min', 'low', 9, 9)})"
_SWING = f"(0.5 * ({_HI9} - close) + 0.5 * ({_LO9} - close))"
_PV = f"({_mean('ret0 * vol_pct', 20, 10)} - {_mean('ret0', 20, 10)} * {_mean('vol_pct', 20, 10)}) / ({_sd('ret0', 20, 10)} * {_sd('vol_pct', 20, 10)} + 1e-9)"
_AROON = f"100 * (1 + ({{0}}).t - greatest(t - 24, 0)) / CAST(least(t + 1, 25) AS DOUBLE)"
_UP25, _DOWN25 = f"min(CASE WHEN high IS NOT NULL THEN {{'v': -high, 't': t}} END) {W(25)}", f"min(CASE WHEN low IS NOT NULL THEN {{'v': low, 't': t}} END) {W(25)}"
_SECOND |= {
    "amount_ratio_5_20": f"{_mean('amount', 5, 2)} / nullif({_mean('amount', 20, 10)}, 0)",
    "turnover_ratio_5_20": f"{_mean('turnover', 5, 2)} / nullif({_mean('turnover', 20, 10)}, 0)",
    "log_market_value": "CASE WHEN close > 0 THEN ln(close * 1e6) END",
    "ma_bull_align": f"CASE WHEN {_ma(5)} > {_ma(10)} AND {_ma(10)} > {_ma(20)} THEN 1.0 ELSE 0.0 END",
    "price_above_ma_count": " + ".join(f"CASE WHEN close > {_ma(w)} THEN 1.0 ELSE 0.0 END" for w in (5, 10, 20)),
    "bb_width": f"2 * {_sd('close', 20, 10)} / nullif({_ma(20, 10)}, 0)",
    "bb_position": div(f"close - {_ma(20, 10)}", f"(2 * {_sd('close', 20, 10)})"),
    "rsii": f"{_GAIN} / ({_GAIN} + {_LOSS} + 1e-9) * 100",
    "bbi": f"({_ma(3, 1)} + {_ma(6, 1)} + {_ma(12, 1)} + {_ma(24, 1)}) / 4",
    "dma_10_20": f"{_ma(10, 1)} - {_ma(20, 1)}",
    "donchian_width": f"({_HI} - {_LO}) / nullif(close, 0)",
    "donchian_position": _unless(f"({_HI} - {_LO})", f"(close - {_LO}) / ({_HI} - {_LO})"),
    "vol_parkinson_d": "power(ln(high / low), 2) / (4 * ln(2))",
    "parkinson_vol_20d": f"CASE WHEN t >= 19 THEN sqrt(avg(power(ln(high) - ln(low), 2)) {W(20)} / (4 * ln(2))) END",
    "rvi": f"100 * {_sd('up_move', 30, 2)} / ({_sd('up_move', 30, 2)} + {_sd('down_move', 30, 2)} + 1e-5)",
    "ret_skew_30": f"CASE WHEN count(ret0) {W(30)} >= 10 THEN skewness(ret0) {W(30)} END",
    "ret_kurt_30": f"CASE WHEN count(ret0) {W(30)} >= 10 THEN kurtosis(ret0) {W(30)} END",
    "obv": "CASE WHEN signed IS NOT NULL THEN sum(signed) OVER (PARTITION BY code ORDER BY t ROWS UNBOUNDED PRECEDING) END",
    "mfi": f"100 - 100 / (1 + {_sum('flow * upf', 14)} / ({_sum('flow * downf', 14)} + 1e-5))",
    "vr_12": f"{_sum('volume * upf', 12)} / ({_sum('volume * downf', 12)} + 1e-5) * 100",
    "pv_momentum": f"ret * coalesce(volume / nullif(coalesce(lag(volume) {H}, volume), 0), 0)",
    "pv_corr": _PV,
    "edit_20": _sum("edit", 20), "epi_20": f"{_sum('edit', 20)} / ({_sum('volume', 20)} + 1e-5)",
    "up_count_30": _sum("up_tick", 30), "down_count_30": _sum("down_tick", 30),
    "em": "em0", "emv": _sum("em0", 14),
    "cr1": f"{_sum('high - mid1', 26)} / ({_sum('mid1 - low', 26)} + 1e-5) * 100",
    "close_location": _unless("hl", "((high - close) - (close - low)) / hl"),
    "close_loc_before": _unless("hl1", "((h1 - close) - (close - l1)) / hl1"),
    "candle_ratio": _unless("bear", "bull / bear"),
    "candle_skew": _unless("hl", "(bull - bear) / hl"),
    "body_size": "close - open",
    "body_candle_ratio": "CASE WHEN bull + bear <= 1e-9 THEN (close - open) / 1e-3 ELSE (close - open) / (bull + bear) END",
    "doji": _unless("hl", "abs(close - open) / hl"),
    "overlap_ratio": _unless("hl1", "CASE WHEN hl IS NOT NULL THEN greatest(0, least(high, h1) - greatest(low, l1)) / hl1 END"),
    "gap_ratio": _unless("c1", "(open - c1) / c1"),
    "close_position": _unless("hl1", "(close - l1) / hl1"),
    "open_position": _unless("hl1", "(open - l1) / hl1"),
    "ma_bias_60": f"(close - {_ma(60, 1)}) / ({_ma(60, 1)} + 1e-5)",
    "mdd_daily": "(high - close) / (high + 1e-9) * 100",
    "cum_mmd_60": f"(({r('max', 'high', 60, 1)}) - close) / (({r('max', 'high', 60, 1)}) + 1e-9) * 100",
    "aroon_up": _AROON.format(_UP25), "aroon_down": _AROON.format(_DOWN25), "aroon_diff": f"{_AROON.format(_UP25)} - {_AROON.format(_DOWN25)}",
    "pr_swing": f"({_HI9} - {_LO9}) + {_SWING}",
    "si_swing": f"50 * ((close - coalesce(c1, close)) + {_SWING}) / (({_HI9} - {_LO9}) + {_SWING} + 1e-5) * 0.3",
}
_THIRD = {
    "ret_skew_std": _sd("ret_skew_30", 30), "ret_kurt_std": _sd("ret_kurt_30", 30), "maemv": _mean("emv", 9), "vmacd": f"v_dif - {_mean('v_dif', 9)}",
    "asi_swing": "CASE WHEN si_swing IS NOT NULL THEN sum(si_swing) OVER (PARTITION BY code ORDER BY t ROWS UNBOUNDED PRECEDING) END",
}
_FIRST = f"""
lagged AS (SELECT *, volume / 1000 AS turnover, lag(close) {H} AS c1, lag(high) {H} AS h1, lag(low) {H} AS l1, lag((high + low + close) / 3) {H} AS tp1, lag((2 * close + high + low) / 4) {H} AS m1 FROM panel),
layer AS (
  SELECT *, coalesce(ret, 0) AS ret0, (high - low) / nullif(close, 0) AS amp, high - low AS hl, h1 - l1 AS hl1,
    list_max([high - low, abs(high - c1), abs(low - c1)]) AS tr, CASE WHEN ret > 0 THEN ret WHEN ret <= 0 THEN 0 END AS gain, CASE WHEN ret < 0 THEN -ret WHEN ret >= 0 THEN 0 END AS loss,
    CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END AS upf, CASE WHEN ret < 0 THEN 1.0 ELSE 0.0 END AS downf, CASE WHEN close - c1 > 0 THEN 1.0 ELSE 0.0 END AS rose,
    high - coalesce(c1, close) AS long, coalesce(c1, close) - low AS short, high - open AS push, open - low AS pull,
    CASE WHEN close - c1 > 0 THEN close - c1 ELSE 0.0 END AS up_move, CASE WHEN close - c1 < 0 THEN close - c1 ELSE 0.0 END AS down_move, sign(close - c1) * volume AS signed,
    (high + low + close) / 3 * volume AS flow, volume / nullif(lag(volume) {H}, 0) - 1 AS vol_pct,
    (CASE WHEN close > c1 THEN 1.0 ELSE 0.0 END - CASE WHEN close < c1 THEN 1.0 ELSE 0.0 END) * volume AS edit, CASE WHEN close > c1 THEN 1.0 ELSE 0.0 END AS up_tick, CASE WHEN close < c1 THEN 1.0 ELSE 0.0 END AS down_tick,
    CASE WHEN volume <= 1e-9 THEN 0.0 ELSE ((high + low) / 2 - (coalesce(h1, high) + coalesce(l1, low)) / 2) * (high - low) / volume END AS em0,
    coalesce(m1, (2 * close + high + low) / 4) AS mid1, CASE WHEN high - coalesce(tp1, (high + low + close) / 3) IS NOT NULL THEN greatest(high - coalesce(tp1, (high + low + close) / 3), 0) END AS up_pen,
    CASE WHEN coalesce(tp1, (high + low + close) / 3) - low IS NOT NULL THEN greatest(coalesce(tp1, (high + low + close) / 3) - low, 0) END AS down_pen,
    CASE WHEN close IS NOT NULL THEN high - greatest(close, open) END AS bull, CASE WHEN close IS NOT NULL THEN least(close, open) - low END AS bear
  FROM lagged)"""
_WINDOWS = f"{_FIRST}, second AS (SELECT code, t, {_mean('volume', 12)} - {_mean('volume', 26)} AS v_dif, " + ", ".join(f"{e} AS {n}" for n, e in _SECOND.items()) + " FROM layer)"


def _step(name: str, x: str, alpha: float) -> str:
    """The next state (mean m, weight w) of an exponential mean of ``x``: over a gap the weight of what was decays on."""
    m, w, a, x = f"r.{name}_m", f"r.{name}_w", repr(alpha), f"({x})"
    mean = f"CASE WHEN {m} IS NULL THEN {x} WHEN {x} IS NULL THEN {m} ELSE ({w} * (1 - {a}) * {m} + {a} * {x}) / ({w} * (1 - {a}) + {a}) END AS {name}_m"
    return f"{mean}, CASE WHEN {m} IS NULL OR {x} IS NOT NULL THEN 1.0 ELSE {w} * (1 - {a}) END AS {name}_w"


_EWM_1 = {"e12": ("close", 2 / 13), "e26": ("close", 2 / 27), "e9": ("close", 0.2), "e25": ("close", 2 / 26), "e20": ("close", 2 / 21), "atr": ("tr", 2 / 21), "hl30": ("hl", 2 / 31), "hl7": ("hl", 0.25), "hl13": ("hl", 2 / 14), "k": ("rsv", 0.5), "atr14": ("tr", 2 / 15), "dmp": ("dmp", 2 / 15), "dmn": ("dmn", 2 / 15)}
_EWM_1 |= {f"{n}{w}": (n, 2 / (w + 1)) for n in ("gain", "loss") for w in (6, 12, 24)}
_EWM_2 = {"dea": ("n.e12_m - n.e26_m", 0.2), "mass": ("n.hl / nullif(n.e9_m - n.e25_m, 0)", 2 / 26), "d": ("n.k_m", 0.5), "dx": ("100 * abs(100 * n.dmp_m / (n.atr14_m + 1e-12) - 100 * n.dmn_m / (n.atr14_m + 1e-12)) / (100 * n.dmp_m / (n.atr14_m + 1e-12) + 100 * n.dmn_m / (n.atr14_m + 1e-12) + 1e-12)", 2 / 15)}
_IN = "code, t, close, volume, hl, tr, gain, loss, rsv, base_mean, pv_corr, base, dmp, dmn"
_STATE = [f"{n}_{k}" for n in (*_EWM_1, *_EWM_2) for k in ("m", "w")]
_NEXT_1 = ", ".join(_step(n, f"i.{x}", a) for n, (x, a) in _EWM_1.items())
_NEXT_2 = ", ".join(_step(n, x, a).replace("r.", "n.old_") for n, (x, a) in _EWM_2.items())
_OLD = ", ".join(f"r.{n}_{k} AS old_{n}_{k}" for n in _EWM_2 for k in ("m", "w"))
_ALPHA = "abs(i.base - i.base_mean) / (i.base_mean + 1e-9)"
_RECURSION = f"""
inputs AS (SELECT code, t, close, volume, hl, tr, gain, loss, CASE WHEN {_FULL9[0]} - {_FULL9[1]} > 0 THEN 100 * (close - {_FULL9[1]}) / ({_FULL9[0]} - {_FULL9[1]}) ELSE 50.0 END AS rsv,
  {_mean('(2 * close + high + low) / 4', 20)} AS base_mean, {_PV} AS pv_corr, (2 * close + high + low) / 4 AS base,
  CASE WHEN greatest(high - h1, 0) > greatest(l1 - low, 0) AND high - h1 IS NOT NULL AND l1 - low IS NOT NULL THEN greatest(high - h1, 0) ELSE 0.0 END AS dmp,
  CASE WHEN greatest(high - h1, 0) < greatest(l1 - low, 0) AND high - h1 IS NOT NULL AND l1 - low IS NOT NULL THEN greatest(l1 - low, 0) ELSE 0.0 END AS dmn FROM layer),
rec({_IN}, {', '.join(_STATE)}, xsii) AS (
  SELECT code, -1 AS t, {', '.join('CAST(NULL AS DOUBLE)' for _ in range(12))}, {', '.join('CAST(NULL AS DOUBLE)' if x.endswith('_m') else 'CAST(1 AS DOUBLE)' for x in _STATE)}, CAST(0 AS DOUBLE) FROM (SELECT DISTINCT code FROM panel)
  UNION ALL
  SELECT {', '.join(f'n.{x.strip()}' for x in _IN.split(','))}, {', '.join(f'n.{n}_{k}' for n in _EWM_1 for k in ('m', 'w'))}, {_NEXT_2}, n.xsii
  FROM (SELECT {', '.join(f'i.{x.strip()}' for x in _IN.split(','))}, {_NEXT_1}, {_OLD},
          CASE WHEN i.close IS NULL THEN r.xsii WHEN i.t = 0 THEN i.close ELSE coalesce({_ALPHA}, 0) * i.close + (1 - coalesce({_ALPHA}, 0)) * r.xsii END AS xsii
        FROM rec r JOIN inputs i ON i.code = r.code AND i.t = r.t + 1) n),
states AS (SELECT *, e12_m - e26_m AS dif, 2 * (e12_m - e26_m - dea_m) AS hist FROM rec WHERE t >= 0),
moved AS (SELECT *, e12_m - lag(e12_m) {H} AS slope, tanh(dif / (({r('max', 'abs(dif)', 60, 1)}) + 1e-9)) AS strength FROM states)"""
_RECURSIVE = {f"rsi_{w}": f"100 * gain{w}_m / nullif(gain{w}_m + loss{w}_m, 0)" for w in (6, 12, 24)}
_RECURSIVE |= {
    "macd_dif": "dif", "macd_dea": "dea_m", "macd_hist": "hist", "hist_slope": f"hist - lag(hist, 5) {H}", "macd_strength": "strength", "macd_signal_gap": f"tanh((dif - dea_m) / ({_mean('abs(dif)', 30)} + 1e-9))",
    "trend_momentum": "tanh(dif * slope)", "ema_slope": "slope", "trend_energy": "slope * volume", "long_short_energy": "strength * pv_corr",
    "kc_width": "4 * atr_m / nullif(close, 0)", "kc_position": "(close - (e20_m - 2 * atr_m)) / nullif(4 * atr_m, 0)", "chaikin_vol": f"(hl30_m - lag(hl30_m, 30) {H}) / (lag(hl30_m, 30) {H} + 1e-5) * 100", "mass_idx": "mass_m",
    "cvi_7": f"(hl7_m - lag(hl7_m, 7) {H}) / (hl7_m + 1e-9) * 100", "cvi_13": f"(hl13_m - lag(hl13_m, 13) {H}) / (hl13_m + 1e-9) * 100", "alpha_xsii": "abs(base - base_mean) / (base_mean + 1e-9)", "xsii": "xsii",
    "macd_cross": "sign(dif - dea_m)", "dip_d": "100 * dmp_m / (atr14_m + 1e-12)", "din_d": "100 * dmn_m / (atr14_m + 1e-12)", "adx_d": "dx_m", "kdj_k": "k_m", "kdj_d": "d_m", "kdj_j": "3 * k_m - 2 * d_m",
}


def _wrapped(inner: str, keys: str, columns: dict[str, str] | tuple[str, ...], source: str) -> str:
    """``WITH inner SELECT keys, rounded columns FROM source``."""
    cells = columns if isinstance(columns, dict) else {c: c for c in columns}
    first = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in cells.items())
    outer = ", ".join(f"{rounded_sql(n)} AS {n}" for n in cells)
    return f"WITH {inner}, cells AS (SELECT {keys}, {first} FROM {source}) SELECT {keys}, {outer} FROM cells"


_FLAGS = f"""flagged AS (SELECT *, CASE WHEN ret > 0.1 THEN 1 ELSE 0 END AS u, CASE WHEN ret < -0.1 THEN 1 ELSE 0 END AS d, CASE WHEN ret > 0.1 AND open = high THEN 1 ELSE 0 END AS o FROM panel),
premiums AS (SELECT *, CASE WHEN t >= 2 AND lag(u) {H} > 0 AND lag(close) {H} > 0 THEN (open - lag(close) {H}) / lag(close) {H} END AS pr FROM flagged)"""
_LIMITS = {f"limit_{n}_count_{w}d": f"sum({c}) {W(w)}" for n, c in (("up", "u"), ("down", "d")) for w in (3, 5, 10, 20)}
_LIMITS |= {f"one_word_up_count_{w}d": f"sum(o) {W(w)}" for w in (5, 10)} | {"seal_proxy_ow_per_lu_10d": div(f"sum(o) {W(10)}", f"(sum(u) {W(10)})"), "limit_up_premium_mean": f"avg(pr) {W(19)}", "limit_up_premium_median": f"quantile_cont(pr, 0.5) {W(19)}"}
_RUN = "CAST(t - coalesce(max(CASE WHEN u = 0 THEN t END) OVER (PARTITION BY code ORDER BY t ROWS UNBOUNDED PRECEDING), -1) AS INTEGER) AS consecutive_limit_up"
_TODAY = "u AS is_limit_up_today, d AS is_limit_down_today, o AS is_one_word_up_today"
_LIMITS_SQL = _wrapped(f"{MONTH_PANEL_SQL}, {_FLAGS}, runs AS (SELECT *, {_RUN}, {_TODAY} FROM premiums)", "code, t, consecutive_limit_up, is_limit_up_today, is_limit_down_today, is_one_word_up_today", _LIMITS, "runs")

_LAST = "(SELECT max(t) FROM whole)"
_RECENT = f"panel AS (SELECT * EXCLUDE (t), CAST(t - greatest({_LAST} - 59, 0) AS INTEGER) AS t FROM whole WHERE t > {_LAST} - 60)"
_FLAGGED = ("consecutive_limit_up", "is_limit_up_today", "is_limit_down_today", "is_one_word_up_today")
_POOL = {n: n for n in _SECOND} | _THIRD
_POOL_SQL = f"""WITH RECURSIVE {MONTH_PANEL_SQL.replace('panel AS (', 'whole AS (')}, {_RECENT}, {_WINDOWS}, {_RECURSION}, {_FLAGS}, runs AS (SELECT *, {_RUN}, {_TODAY} FROM premiums),
a AS (SELECT code, t, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _POOL.items())} FROM second), b AS (SELECT code, t, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _RECURSIVE.items())} FROM moved),
c AS (SELECT code, t, {', '.join(_FLAGGED)}, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _LIMITS.items())} FROM runs)
SELECT a.code, {', '.join(_FLAGGED)}, {', '.join(f'{rounded_sql(n)} AS {n}' for n in (*_POOL, *_RECURSIVE, *_LIMITS))}
FROM a JOIN b ON a.code = b.code AND a.t = b.t JOIN c ON c.code = a.code AND c.t = a.t WHERE a.t = (SELECT max(t) FROM panel)"""

_PRICED = f"priced AS (SELECT *, (open + close) / 2 AS price, lag(close) {H} AS pre_close FROM panel), quoted AS (SELECT *, pre_close * 1.1 AS lu, pre_close * 0.9 AS ld FROM priced)"
_HIT = "coalesce(abs(({0} - {1}) / nullif({1}, 0)) < 1e-4, false)"
_LABELS = f"""{_PRICED}, raw AS (
  SELECT code, t, lead(price) {H} / nullif(price, 0) * coalesce(close / nullif(lead(pre_close) {H}, 0), 1) - 1 AS f0,
    CASE WHEN NOT ({_HIT.format('open', 'lu')} OR coalesce(lead({_HIT.format('open', 'ld')}) {H}, false)) THEN lead(open) {H} / open - 1 END AS open_to_open,
    CASE WHEN NOT ({_HIT.format('close', 'lu')} OR coalesce(lead({_HIT.format('close', 'lu')} OR {_HIT.format('close', 'ld')}) {H}, false)) THEN lead(close) {H} / nullif(lead(pre_close) {H}, 0) - 1 END AS close_to_preclose
  FROM quoted), clipped AS (SELECT *, CASE WHEN f0 IS NOT NULL THEN least(greatest(f0, avg(f0) OVER (PARTITION BY t) - 3 * coalesce(stddev_samp(f0) OVER (PARTITION BY t), 0)), avg(f0) OVER (PARTITION BY t) + 3 * coalesce(stddev_samp(f0) OVER (PARTITION BY t), 0)) END AS forward FROM raw)"""
_REASONS = f"""{_PRICED}, listing AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, DATE '1992-01-01' + CAST(s_suppkey % 50 * 20 AS INT) AS into_date, CASE WHEN s_suppkey % 7 = 0 THEN DATE '1997-06-30' END AS out_date FROM supplier),
reasons AS (SELECT q.code, q.t, q.trade_date, CASE WHEN into_date IS NULL THEN 'not_listed' WHEN q.trade_date <= into_date + 20 THEN 'new_listing' WHEN out_date IS NOT NULL AND q.trade_date >= out_date - 20 THEN 'near_delisting'
  WHEN coalesce(max(CASE WHEN ret < -0.8 THEN 1 END) OVER (PARTITION BY q.code ORDER BY q.t ROWS UNBOUNDED PRECEDING), 0) = 1 THEN 'special_treatment' WHEN starts_with(q.code, '00003') THEN 'excluded_prefix'
  WHEN price IS NULL OR price <= 0 THEN 'no_price' WHEN {_HIT.format('price', 'lu')} THEN 'limit_up' END AS reason FROM quoted q LEFT JOIN listing l ON l.code = q.code)"""

_SCORED = f"""m0 AS (SELECT *, {div(f'close - lag(close) {H}', f'(lag(close) {H})')} AS r1, lead(ret) {H} AS label FROM panel),
m1 AS (SELECT *, CASE WHEN t >= 4 THEN avg(r1) {W(5)} END AS a, CASE WHEN t >= 2 THEN avg(volume) {W(3)} END AS b FROM m0),
m2 AS (SELECT *, CASE WHEN a IS NOT NULL THEN row_number() OVER (PARTITION BY t ORDER BY a NULLS LAST, code) END / CAST(count(a) OVER (PARTITION BY t) AS DOUBLE) AS sa,
  CASE WHEN b IS NOT NULL THEN row_number() OVER (PARTITION BY t ORDER BY b NULLS LAST, code) END / CAST(count(b) OVER (PARTITION BY t) AS DOUBLE) AS sb FROM m1),
scored AS (SELECT 'momentum' AS factor, trade_date, code, sa AS score, label FROM m2 UNION ALL SELECT 'volume', trade_date, code, sb, label FROM m2),
valid AS (SELECT * FROM scored WHERE score IS NOT NULL AND label IS NOT NULL)"""
_CORR = "CASE WHEN stddev_pop({0}) * stddev_pop({1}) > 1e-9 THEN covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"
_IC = f"""{_SCORED}, ranks AS (SELECT *, rank() OVER (PARTITION BY factor, trade_date ORDER BY score) + (count(*) OVER (PARTITION BY factor, trade_date, score) - 1) / 2.0 AS rs,
  rank() OVER (PARTITION BY factor, trade_date ORDER BY label) + (count(*) OVER (PARTITION BY factor, trade_date, label) - 1) / 2.0 AS rl FROM valid),
ic AS (SELECT factor, trade_date, count(*) AS n, {_CORR.format('score', 'label')} AS ic, {_CORR.format('rs', 'rl')} AS rank_ic FROM ranks GROUP BY factor, trade_date HAVING count(*) >= 10)"""
_SUMMARY = f"""{_IC}, rows AS (SELECT factor, s.segment, m.metric, CASE WHEN m.metric = 'ic' THEN ic ELSE rank_ic END AS value FROM ic
  JOIN (VALUES ('train', DATE '0001-01-01', DATE '1995-12-31'), ('test', DATE '1996-01-01', DATE '9999-12-31'), ('overall', DATE '0001-01-01', DATE '9999-12-31')) s(segment, a, b) ON trade_date BETWEEN s.a AND s.b
  CROSS JOIN (VALUES ('ic'), ('rank_ic')) m(metric)),
summary AS (SELECT factor, segment, metric, avg(value) AS mean, stddev_samp(value) AS std, {div('avg(value)', 'stddev_samp(value)')} AS icir, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, count(*) AS n FROM rows WHERE value IS NOT NULL GROUP BY ALL)"""
_RANKED = f"{_SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY factor, trade_date ORDER BY score, code) AS k, count(*) OVER (PARTITION BY factor, trade_date) AS nn FROM valid)"
_BUCKETS = f"{_RANKED}, buckets AS (SELECT factor, trade_date, CAST(ceil(k * 5 / CAST(nn AS DOUBLE)) AS INT) AS bucket, avg(label) AS ret, count(*) AS n FROM ranked GROUP BY ALL)"
_EVEN = f"""{_SCORED}, moved AS (SELECT factor, trade_date, code, score, lead(label) OVER (PARTITION BY factor, code ORDER BY trade_date) AS label FROM scored),
sound AS (SELECT *, row_number() OVER (PARTITION BY factor, trade_date ORDER BY score, code) - 1 AS k, count(*) OVER (PARTITION BY factor, trade_date) AS nn FROM moved WHERE score IS NOT NULL AND label IS NOT NULL),
evened AS (SELECT factor, trade_date, CAST(least(k // (nn // 5) + 1, 5) AS INTEGER) AS g, avg(label) AS ret FROM sound WHERE nn >= 10 GROUP BY ALL),
summed AS (SELECT factor, g AS "group", avg(ret) * 243 AS ann_ret, stddev_pop(ret) * sqrt(243) AS ann_vol, sum(ret) AS total, count(*) AS n, avg(ret) * 243 / (stddev_pop(ret) * sqrt(243) + 1e-9) AS sharpe FROM evened GROUP BY factor, g)"""
_TOP = f"{_RANKED}, tops AS (SELECT factor, trade_date, " + ", ".join(f"avg(CASE WHEN k > nn - {k} THEN label END) AS top_{k}, avg(CASE WHEN k <= {k} THEN label END) AS tail_{k}" for k in (5, 10)) + " FROM ranked GROUP BY ALL)"
_PERFORMANCE = f"""{_BUCKETS}, nav AS (SELECT factor, bucket, trade_date, ret / 100 AS ret, product(1 + ret / 100) OVER w AS nav FROM buckets WINDOW w AS (PARTITION BY factor, bucket ORDER BY trade_date ROWS UNBOUNDED PRECEDING)),
falls AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY factor, bucket ORDER BY trade_date ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS fall FROM nav),
perf AS (SELECT factor, bucket, avg(ret) * 242 AS ann_return, stddev_samp(ret) * sqrt(242) AS ann_vol, {div('avg(ret) * 242', '(stddev_samp(ret) * sqrt(242))')} AS sharpe, min(fall) AS max_drawdown,
  avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, arg_max(nav, trade_date) - 1 AS total_return, count(*) AS n FROM falls GROUP BY factor, bucket)"""
_ENSEMBLE = f"""{_SCORED}, z AS (SELECT trade_date, code, (score - avg(score) OVER (PARTITION BY factor, trade_date)) / (stddev_samp(score) OVER (PARTITION BY factor, trade_date) + 1e-8) AS z FROM scored WHERE score IS NOT NULL),
e AS (SELECT trade_date, code, avg(z) AS s FROM z GROUP BY ALL), ez AS (SELECT trade_date, code, (s - avg(s) OVER (PARTITION BY trade_date)) / (stddev_samp(s) OVER (PARTITION BY trade_date) + 1e-8) AS score FROM e)"""
_SC = f"""{_SCORED}, daily AS (SELECT x.factor AS a, y.factor AS b, x.trade_date, {_CORR.format('CASE WHEN y.score IS NOT NULL THEN x.score END', 'CASE WHEN x.score IS NOT NULL THEN y.score END')} AS c
  FROM scored x JOIN scored y ON x.trade_date = y.trade_date AND x.code = y.code AND x.factor < y.factor GROUP BY ALL), means AS (SELECT a, b, avg(c) AS correlation FROM daily GROUP BY a, b)"""

_MP = MONTH_PANEL_SQL
QUERIES = {f.__name__: f for f in (factors_windows, factors_recursive, factors_pool, factors_limits, factors_known_before, labels_forward, universe_reasons, universe_waterfall, ic_daily, ic_summary, quantile_returns, group_returns, top_tail, performance, ensemble_scores, score_correlations, folds)}
SQL = {
    "factors_windows": _wrapped(f"{_MP}, {_WINDOWS}", "code, t", {n: n for n in _SECOND} | _THIRD, "second"),
    "factors_recursive": _wrapped(f"RECURSIVE {_MP}, {_FIRST}, {_RECURSION}", "code, t", _RECURSIVE | {"mass_idx": "mass_m / 1000"}, "moved"),
    "factors_limits": _LIMITS_SQL,
    "factors_pool": _POOL_SQL,
    "factors_known_before": _wrapped(f"{_MP}, m AS (SELECT *, {div(f'close - lag(close, 5) {H}', f'(lag(close, 5) {H})')} AS m5 FROM panel)", "code, t", {"momentum": f"lag(m5) {H}"}, "m"),
    "labels_forward": _wrapped(f"{_MP}, {_LABELS}", "code, t", ("forward", "open_to_open", "close_to_preclose"), "clipped"),
    "universe_reasons": f"WITH {_MP}, {_REASONS} SELECT code, t, reason FROM reasons",
    "universe_waterfall": f"WITH {_MP}, {_REASONS} SELECT trade_date, count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS kept, " + ", ".join(f"count(*) FILTER (WHERE reason = '{x}') AS {x}" for x in universe.REASONS) + " FROM reasons GROUP BY trade_date",
    "ic_daily": _wrapped(f"{_MP}, {_IC}", "factor, trade_date, n", ("ic", "rank_ic"), "ic"),
    "ic_summary": _wrapped(f"{_MP}, {_SUMMARY}", "factor, segment, metric, n", ("mean", "std", "icir", "win_rate"), "summary"),
    "quantile_returns": _wrapped(f"{_MP}, {_BUCKETS}", "factor, trade_date, bucket, n", ("ret",), "buckets"),
    "group_returns": _wrapped(f"{_MP}, {_EVEN}", 'factor, "group", n', ("ann_ret", "ann_vol", "total", "sharpe"), "summed"),
    "top_tail": _wrapped(f"{_MP}, {_TOP}", "factor, trade_date", ("top_5", "tail_5", "top_10", "tail_10"), "tops"),
    "performance": _wrapped(f"{_MP}, {_PERFORMANCE}", "factor, bucket, n", ("ann_return", "ann_vol", "sharpe", "max_drawdown", "win_rate", "total_return"), "perf"),
    "ensemble_scores": _wrapped(f"{_MP}, {_ENSEMBLE}", "trade_date, code", ("score",), "ez"),
    "score_correlations": _wrapped(f"{_MP}, {_SC}", "a, b", ("correlation",), "means"),
    "folds": f"WITH {_MP}, f AS (SELECT date_trunc('month', min(trade_date)) AS f FROM panel) SELECT DISTINCT trade_date, CAST(floor(date_diff('month', f, date_trunc('month', trade_date)) / 3.0) AS INT) AS fold FROM panel, f",
}
