"""The flagship query, operators without SQL, further factor libraries, backtests, studies and the search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.factors import book as books
from tessera.factors import futures, minute
from tessera.operators import rl
from tessera.plans import backtest, evaluate, study
from tessera.plans import search as searches
from tessera.plans.expression import evaluate as expressions
from tessera.plans.layers import Panel
from tessera.queries.markets import _IC, _SCORED, FLAGSHIP, _wrapped, scored
from tessera.queries.operators import H, W, div, full, l_kurt, l_skew, lag, rounded, l_moment, l_sorted
from tessera.queries.ticks import _BOOK
from tessera.sources.panel import MONTH_PANEL_SQL, month_panel
from tessera.sources.ticks import SEQUENCE, book, collapsed, levels, orders


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The daily information coefficients of a ranked momentum expression against the next bar's return."""
    return rounded(evaluate.daily_ic(scored(spark, folder, momentum=FLAGSHIP)), "factor", "trade_date", "n")


#: Operators whose kernels or conventions SQL doesn't express; their values are tested against numpy.
KERNELS = {
    "garch": "ts_garch(ret)", "garch_x": "ts_garch(ret, ret, ret)", "gmm_1m": "ts_gmm_1stmean(close, 12)", "gmm_1s": "ts_gmm_1ststd(close, 12)", "gmm_2m": "ts_gmm_2ndmean(close, 12)", "gmm_2s": "ts_gmm_2ndstd(close, 12)", "cs_pca": "cs_PCA(0, close, volume, ret)",
}
#: Flattened: a struct's fields and an array's elements as columns of their own.
STRUCTURED = {"loop": "loop_max_min(ret)", "sorted": "sort_by_another(ret, volume, 5)", "group_mean": "cs_group_mean(close, ret, 5)", "head": "cs_head_mean(close, ret, 5, 5)"}


def operators_kernels(spark: SparkSession, folder: str) -> DataFrame:
    return expressions(month_panel(spark, folder), KERNELS)


def operators_structured(spark: SparkSession, folder: str) -> DataFrame:
    """Operators with structs and arrays for results, flattened."""
    out = expressions(month_panel(spark, folder), STRUCTURED)
    flat = {"loop_max": F.col("loop.zmax"), "loop_min": F.col("loop.zmin"), "head": F.col("head.head"), "tail": F.col("head.tail")}
    flat |= {f"{c}_{k + 1}": F.get(c, F.lit(k)) for c in ("sorted", "group_mean") for k in range(5)}
    return rounded(out.select("code", "t", *(v.cast("double").alias(k) for k, v in flat.items())), "code", "t")


_CR = "CASE WHEN close IS NOT NULL THEN row_number() OVER (PARTITION BY t ORDER BY close NULLS LAST, code) END"
_STRUCTURES = f"""s0 AS (SELECT *, list(coalesce(ret, 0)) {W(240)} AS back, list(ret) {W(5)} AS r5, list(volume) {W(5)} AS v5, {_CR} AS k, count(close) OVER (PARTITION BY t) AS n FROM panel),
s1 AS (SELECT *, list_transform(range(1, len(back) + 1), lambda i: list_sum(list_reverse(back)[1:i])) AS sums, {l_sorted('r5', 'v5', 1)} AS sorted, ceil(k / CAST(n AS DOUBLE) * 5) AS g FROM s0)"""
_STRUCTURE = {"loop_max": "list_max(sums)", "loop_min": "list_min(sums)", "head": "avg(CASE WHEN k > n - 5 THEN ret END) OVER (PARTITION BY t)", "tail": "avg(CASE WHEN k <= 5 THEN ret END) OVER (PARTITION BY t)"}
_STRUCTURE |= {f"sorted_{i}": full(5, f"sorted[{i}]") for i in range(1, 6)} | {f"group_mean_{i}": f"avg(CASE WHEN g = {i} THEN ret END) OVER (PARTITION BY t)" for i in range(1, 6)}


def operators_moments(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(expressions(month_panel(spark, folder), {"ts_kurt": "ts_kurt(volume, 8)", "ts_skew": "ts_skew(volume, 8)"}), "code", "t")


_MOMENTS = f"m0 AS (SELECT *, list(volume) {W(8)} AS x FROM panel)"


def operators_rl(spark: SparkSession, folder: str) -> DataFrame:
    """The second operator set: transforms of the volume, and an expression step by step."""
    p = Panel(month_panel(spark, folder))
    x = p.field("volume")
    values = {n: rl.transformed(p, n, x) for n in ("abs", "neg", "sqrt", "log", "sign", "inv", "identity", "cs_rank", "ts_mean_5", "ts_sum_5", "ts_stddev_5", "ts_rank_5", "ts_delay_5", "ts_delta_5", "ts_decay_linear_5", "ts_zscore_5", "ts_min_5", "ts_max_5", "ts_skew_5", "ts_kurt_5", "cs_demean", "cs_normalize")}
    values["sigmoid"] = rl.transformed(p, "sigmoid", p.field("ret"))
    values |= {n: rl.step_by_step(p, f"temp=ret;temp={n}(temp,ts_delay_5(close))") for n in ("add", "mul", "max", "min")}
    values["ts_corr_5"] = rl.ts_corr(p, x, p.field("ret"), 5)
    values["steps"] = rl.step_by_step(p, "temp=ts_mean_5(close);temp=div(temp,ts_mean_10(close));temp=sub(temp,identity(ret))")
    return rounded(p.select({f"rl_{k}": v for k, v in values.items()}), "code", "t")


_RL = {
    "rl_abs": "abs(volume)", "rl_neg": "-volume", "rl_sqrt": "sqrt(abs(volume))", "rl_log": "CASE WHEN abs(volume) > 1e-9 THEN ln(abs(volume)) END", "rl_sign": "sign(volume)", "rl_inv": div("1.0", "volume"), "rl_identity": "volume",
    "rl_cs_rank": "CASE WHEN volume IS NOT NULL THEN row_number() OVER (PARTITION BY t ORDER BY volume NULLS FIRST, code) / CAST(count(volume) OVER (PARTITION BY t) AS DOUBLE) END",
    "rl_ts_mean_5": full(5, f"avg(volume) {W(5)}"), "rl_ts_sum_5": full(5, f"coalesce(sum(volume) {W(5)}, 0)"), "rl_ts_stddev_5": full(5, f"sqrt(var_pop(volume) {W(5)} + 1e-9)"),
    "rl_ts_rank_5": full(5, "CASE WHEN volume IS NOT NULL THEN len(list_filter(l5, lambda e: e < volume)) / CAST(len(list_filter(l5, lambda e: e IS NOT NULL)) AS DOUBLE) END"), "rl_ts_delay_5": lag("volume", 5), "rl_ts_delta_5": f"volume - {lag('volume', 5)}",
    "rl_ts_decay_linear_5": full(5, " + ".join(f"coalesce({lag('volume', k) if k else 'volume'}, 0) * {2 * (5 - k) / 30}" for k in range(5))), "rl_ts_zscore_5": full(5, f"(volume - avg(volume) {W(5)}) / greatest(stddev_pop(volume) {W(5)}, 1e-9)"),
    "rl_ts_min_5": full(5, f"min(volume) {W(5)}"), "rl_ts_max_5": full(5, f"max(volume) {W(5)}"), "rl_sigmoid": "1 / (1 + exp(-ret))", "rl_add": f"ret + {lag('close', 5)}", "rl_mul": f"ret * {lag('close', 5)}",
    "rl_max": f"CASE WHEN ret IS NOT NULL AND {lag('close', 5)} IS NOT NULL THEN greatest(ret, {lag('close', 5)}) END", "rl_min": f"CASE WHEN ret IS NOT NULL AND {lag('close', 5)} IS NOT NULL THEN least(ret, {lag('close', 5)}) END",
    "rl_ts_skew_5": full(5, f"({l_moment('l5', 3)}) / (power(greatest({l_moment('l5', 2)}, 1e-9), 1.5) + 1e-9)"), "rl_ts_kurt_5": full(5, f"({l_moment('l5', 4)}) / (power(greatest({l_moment('l5', 2)}, 1e-9), 2) + 1e-9) - 3"),
    "rl_cs_demean": "volume - avg(volume) OVER (PARTITION BY t)", "rl_cs_normalize": "CASE WHEN count(volume) OVER (PARTITION BY t) = count(*) OVER (PARTITION BY t) THEN (volume - avg(volume) OVER (PARTITION BY t)) / greatest(stddev_samp(volume) OVER (PARTITION BY t), 1e-9) END",
    "rl_ts_corr_5": full(5, "coalesce(list_sum(list_transform(list_zip(l5, r5), lambda z: (z[1] - list_avg(l5)) * (z[2] - list_avg(r5)))), 0) / (sqrt(greatest(list_sum(list_transform(l5, lambda e: power(e - list_avg(l5), 2))), 1e-9)) * sqrt(greatest(list_sum(list_transform(r5, lambda e: power(e - list_avg(r5), 2))), 1e-9)) + 1e-9)"),
    "rl_steps": full(10, f"{div(f'avg(close) {W(5)}', f'(avg(close) {W(10)})')} - ret").replace("CASE WHEN abs", "(CASE WHEN abs", 1).replace("END - ret", "END) - ret"),
}


def _future_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """The book as ticks of one session per code, with cumulative volume and turnover in hundredths: sums of whole numbers are exact."""
    w = Window.partitionBy("code").orderBy("seq")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    b = book(spark, folder)
    return b.select("code", F.lit("day").alias("session"), F.row_number().over(w).alias("t"), *(f"{side}{k}{i}" for side in "bs" for k in "pv" for i in range(1, 6)), F.col("price").alias("last"), F.sum("volume").over(past).alias("cum_volume"), F.sum(F.round(F.col("price") * F.col("volume") * 100)).over(past).alias("cum_turnover"))


def futures_factors(spark: SparkSession, folder: str) -> DataFrame:
    out = futures.computed(_future_ticks(spark, folder), 100.0).drop("session")
    return rounded(out, "code", "t")


def futures_basic(spark: SparkSession, folder: str) -> DataFrame:
    out = futures.computed(_future_ticks(spark, folder), 100.0)
    return rounded(out.select("code", "t", *_BASIC), "code", "t")


_BASIC = ("vol_slice_imbalance", "spread", "price_diff_40", "order_flow_imbalance", "effective_spread", "vol_diff", "vol_rank_imbalance", "vol_continue_increase_imbalance")
_PAST = "OVER (PARTITION BY code ORDER BY t ROWS UNBOUNDED PRECEDING)"
_or0 = lambda x: f"coalesce({x}, 0)"
_centre = lambda side: f"({' + '.join(f'{side}p{i} * {side}v{i}' for i in range(1, 6))}) / nullif({' + '.join(f'{side}v{i}' for i in range(1, 6))}, 0)"
_FT = f"""{_BOOK}, ticks AS (SELECT *, CAST(row_number() OVER (PARTITION BY code ORDER BY seq) AS INTEGER) AS t, (bp1 + sp1) / 2 AS mid, price AS last FROM book),
w0 AS (SELECT *, CASE WHEN t > 1 THEN volume ELSE 0.0 END AS vol, CASE WHEN t > 1 AND volume > 0 THEN round(price * volume * 100) / 100 / volume ELSE 0.0 END AS ave, lag(bp1) {H} AS pb, lag(sp1) {H} AS ps, lag(bv1) {H} AS lb, lag(sv1) {H} AS ls, lag(bv2) {H} AS lb2, lag(sv2) {H} AS ls2,
  list(bv1) {W(60)} AS b60, list(sv1) {W(60)} AS s60, coalesce(bv1 - lag(bv1) {H}, 0) AS db, coalesce(sv1 - lag(sv1) {H}, 0) AS ds, (bv1 - sv1) / nullif(bv1 + sv1, 0) AS vi, {_centre('b')} AS bid_part, {_centre('s')} AS ask_part FROM ticks),
w1 AS (SELECT *, list_reduce(list(db) {W(64)}, lambda y, x: 0.5 * y + 0.5 * x) AS eb, list_reduce(list(ds) {W(64)}, lambda y, x: 0.5 * y + 0.5 * x) AS es,
  CASE WHEN vol > 0 AND ps <> pb THEN CASE WHEN ave >= ps THEN vol WHEN ave < ps AND ave > pb THEN vol * (ave - pb) / (ps - pb) ELSE 0.0 END ELSE 0.0 END AS buy FROM w0),
w2 AS (SELECT *, vol - buy AS sell, coalesce(stddev_samp(vi) {W(20)}, 0) AS sd, CASE WHEN ave <> 0 THEN ave - mid ELSE 0.0 END AS tpi FROM w1),
w3 AS (SELECT *, round_even((CASE WHEN sp1 = {_or0('ps')} THEN ds + buy ELSE 0.0 END) + (CASE WHEN sp1 > {_or0('ps')} THEN buy - {_or0('ls')} + sv1 - {_or0('ls2')} ELSE 0.0 END) + (CASE WHEN sp1 < {_or0('ps')} THEN sv1 + buy ELSE 0.0 END), 0) AS ask_in,
  round_even((CASE WHEN bp1 = {_or0('pb')} THEN db + sell ELSE 0.0 END) + (CASE WHEN bp1 < {_or0('pb')} THEN sell - {_or0('lb')} + bv1 - {_or0('lb2')} ELSE 0.0 END) + (CASE WHEN bp1 > {_or0('pb')} THEN bv1 + sell ELSE 0.0 END), 0) AS bid_in FROM w2)"""
_run = lambda x: f"(t - max(CASE WHEN NOT {x} > 0 THEN t END) {_PAST}) - (t - max(CASE WHEN NOT {x} < 0 THEN t END) {_PAST})"
_rank = lambda a, x: f"len(list_filter({a}, lambda v: v <= {x})) / CAST(len({a}) AS DOUBLE)"
_swing = lambda x: div(f"max({x}) {W(20)} - min({x}) {W(20)}", x)
_share = lambda f, x, n: div(f"{x}", f"({f}({x}) {W(n)})") if f == "max" else div(f"{f}({x}) {W(n)}", x)
_WEIGHTS = (0.04025942, 0.02776354, 0.02156791, 0.02247671, 0.02048048, 0.02905635, 0.05213158, 0.04469997, -0.42357886)  # fixed values
_FUTURES = {
    "vol_slice_imbalance": "vi", "trade_price_imbalance": "tpi", "price_dist": f"(mid - avg(bid_part) {W(10)}) - (avg(ask_part) {W(10)} - mid)",
    "active_buy_vol": "buy", "active_sell_vol": "sell", "active_buy_sell_imbalance": "(buy - sell) / (1 + vol)", "trade_price_vol_imbalance": "tpi * ln(1 + abs(buy - sell))",
    "price_diff_40": f"coalesce(mid - lag(mid, 40) {H}, 0)", "price_diff_10": f"coalesce(mid - lag(mid, 60) {H}, 0)", "order_submit_ask": "ask_in", "order_submit_bid": "bid_in", "order_submit_imbalance": "ask_in - bid_in",
    "vol_order_imbalance": "(bv1 - CASE WHEN bp1 = coalesce(pb, bp1) THEN coalesce(lb, bv1) WHEN bp1 < coalesce(pb, bp1) THEN coalesce(lb2, bv2) ELSE 0 END) - (sv1 - CASE WHEN sp1 = coalesce(ps, sp1) THEN coalesce(ls, sv1) WHEN sp1 > coalesce(ps, sp1) THEN coalesce(ls2, sv2) ELSE 0 END)",
    "order_flow_imbalance": f"(CASE WHEN bp1 >= {_or0('pb')} THEN bv1 ELSE 0 END) - (CASE WHEN bp1 < {_or0('pb')} THEN {_or0('lb')} ELSE 0 END) - (CASE WHEN sp1 <= {_or0('ps')} THEN sv1 ELSE 0 END) + (CASE WHEN sp1 > {_or0('ps')} THEN {_or0('ls')} ELSE 0 END)",
    "vol_slice_imbalance_div_std": "CASE WHEN sd = 0 THEN vi ELSE vi / sd END", "vol_time_series_imbalance": f"({_share('max', 'bv1', 10)}) - ({_share('max', 'sv1', 10)})",
    "vol_conv": "coalesce(" + " + ".join(f"{w} * lag(vi, {8 - k}) {H}" for k, w in enumerate(_WEIGHTS)) + ", 0)",
    "vol_diff": "1 / (1 + exp(-(db - ds) / 15)) - 0.5", "vol_time_series_min_imbalance": f"({_share('min', 'sv1', 40)}) - ({_share('min', 'bv1', 40)})", "vol_max_diff_imbalance": f"({_swing('sv1')}) - ({_swing('bv1')})",
    "effective_spread": f"avg(last - mid) {W(20)}", "spread": "sp1 - bp1", "vol_rank_imbalance": f"{_rank('s60', 'sv1')} - {_rank('b60', 'bv1')}",
    "vol_continue_increase_imbalance": f"({_run('db')}) - ({_run('ds')})", "exp_vol_continue_increase_imbalance": f"({_run('eb')}) - ({_run('es')})", "mid": "mid",
}
for _n in (20, 40, 60, 80, 100, 120):
    _next = f"OVER (PARTITION BY code ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {_n} FOLLOWING)"
    _FUTURES |= {f"frt_{_n}": f"coalesce(lead(mid, {_n}) {H} - mid, 0)", f"log_frt_{_n}": f"coalesce(ln(lead(mid, {_n}) {H}) - ln(mid), 0)", f"frt_{_n}_abs": f"abs(coalesce(lead(mid, {_n}) {H} - mid, 0))"}
    _FUTURES[f"mdf_frt_{_n}"] = f"coalesce(CASE WHEN lead(mid, {_n}) {H} IS NOT NULL THEN max(mid) {_next} + min(mid) {_next} - 2 * mid END, 0)"


def _hour_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars of the events as the minute bars of a day: (code, trade_date, t, ...)."""
    from tessera.sources.ticks import ohlcv

    t = spark.read.parquet(f"{folder}/events.parquet").select((F.col("user_id") % 20).cast("string").alias("code"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.struct("ts", "event_id").alias("turn"))
    bars = ohlcv(t, "1 hour", "turn").withColumn("trade_date", F.to_date("ts"))
    return bars.withColumn("t", F.row_number().over(Window.partitionBy("code", "trade_date").orderBy("ts")) - 1).drop("ts", "n", "amount")


def minute_families(spark: SparkSession, folder: str) -> DataFrame:
    """The last bar of each stock-day with all minute families."""
    return minute.snapshot(minute.families(minute.var(_hour_bars(spark, folder))))


def minute_jumps(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.factors.daily import jump_variation

    return rounded(jump_variation(_hour_bars(spark, folder)), "code", "trade_date")


_JUMPS = """ev AS (SELECT CAST(user_id % 20 AS VARCHAR) AS code, ts, event_id, value AS price FROM events),
bars AS (SELECT code, CAST(ts AS DATE) AS trade_date, date_trunc('hour', ts) AS h, arg_min(price, {'a': ts, 'b': event_id}) AS open, arg_max(price, {'a': ts, 'b': event_id}) AS close FROM ev GROUP BY ALL),
r AS (SELECT code, trade_date, h, CASE WHEN close > 0 AND open > 0 THEN 100 * ln(close / open) ELSE 0 END AS r FROM bars),
v AS (SELECT *, power(abs(r * lag(r, 1) OVER w * lag(r, 2) OVER w), 2.0 / 3) AS v, quantile_cont(abs(r), 0.99) OVER (PARTITION BY code, trade_date) AS q FROM r WINDOW w AS (PARTITION BY code, trade_date ORDER BY h)),
s AS (SELECT code, trade_date, sum(r * r) AS rv, coalesce(sum(v), 0) AS iv, sum(CASE WHEN r > 0 THEN r * r ELSE 0 END) AS rsp, sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) AS rsn, sum(CASE WHEN abs(r) > q THEN r * r ELSE 0 END) AS rvl FROM v GROUP BY code, trade_date)"""
_JUMP_COLUMNS = {"rv": "rv", "iv": "iv", "rvj": "greatest(rv - iv, 0)", "rvc": "rv - greatest(rv - iv, 0)", "rsp": "rsp", "rsn": "rsn", "rvjp": "greatest(rsp - iv / 2, 0)", "rvjn": "greatest(rsn - iv / 2, 0)", "srvj": "greatest(rsp - iv / 2, 0) - greatest(rsn - iv / 2, 0)", "rvl": "rvl", "rvlj": "least(rvl, greatest(rv - iv, 0))", "rvsj": "greatest(rv - iv, 0) - least(rvl, greatest(rv - iv, 0))"}


def book_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the book of each code and month."""
    lines = orders(spark, folder).withColumn("trade_date", F.to_date(F.date_trunc("month", "trade_date")))
    return minute.book_components(levels(lines.withColumn("t", F.row_number().over(Window.partitionBy("code", "trade_date").orderBy(*SEQUENCE))), "t"))


def book_information(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of the amounts, entropies and mutual information of rounded prices and sizes, of each code and month."""
    b = book(spark, folder).withColumns({c: F.floor(F.col(c) / 200) for c in ("price", "bp1", "sp1")} | {"minute": F.to_date(F.date_trunc("month", "trade_date")), "amount": F.col("price") * F.col("volume")})
    return rounded(books.information(b), "code", "minute")


_SINGLES, _INFORMED = ("price", "volume", "bp1", "sp1", "bv1", "sv1"), (("price", "bp1"), ("volume", "bv1"), ("price", "volume"), ("bp1", "sp1"))
_part = lambda *c: f"count(*) OVER (PARTITION BY code, minute, {', '.join(c)}) / CAST(count(*) OVER (PARTITION BY code, minute) AS DOUBLE)"
_INFORMATION = f"""{_BOOK}, ticks AS (SELECT code, CAST(date_trunc('month', trade_date) AS DATE) AS minute, floor(price / 200) AS price, floor(bp1 / 200) AS bp1, floor(sp1 / 200) AS sp1, bv1, sv1, volume, price * volume AS amount FROM book),
shares AS (SELECT *, {', '.join(f'{_part(c)} AS p_{c}' for c in _SINGLES)}, {', '.join(f'{_part(a, b)} AS p_{a}_{b}' for a, b in _INFORMED)} FROM ticks),
told AS (SELECT code, minute, quantile_cont(amount, 0.9) AS amount_high, quantile_cont(amount, 0.1) AS amount_low, (quantile_cont(amount, 0.1) - min(amount)) / (max(amount) - min(amount) + 1e-5) AS amount_low_min,
  (quantile_cont(amount, 0.9) - quantile_cont(amount, 0.1)) / (max(amount) - min(amount) + 1e-5) AS amount_high_low, {', '.join(f'CASE WHEN count(*) > 1 THEN -avg(ln(p_{c} + 1e-9)) END AS entropy_{c}' for c in _SINGLES)},
  {', '.join(f'CASE WHEN count(*) > 1 THEN avg(ln(p_{a}_{b} / (p_{a} * p_{b} + 1e-9) + 1e-9)) END AS information_{a}_{b}' for a, b in _INFORMED)},
  {', '.join(f'CASE WHEN count(*) > 1 THEN -avg(ln(p_{a}_{b} / (p_{b} + 1e-9) + 1e-9)) END AS entropy_{a}_given_{b}' for a, b in _INFORMED)} FROM shares GROUP BY code, minute)"""
_TOLD = ("amount_high", "amount_low", "amount_low_min", "amount_high_low", *(f"entropy_{c}" for c in _SINGLES), *(f"information_{a}_{b}" for a, b in _INFORMED), *(f"entropy_{a}_given_{b}" for a, b in _INFORMED))


def book_entropies(spark: SparkSession, folder: str) -> DataFrame:
    """Entropies of rounded prices and quantities per code and month, and their mutual information."""
    t = spark.read.parquet(f"{folder}/lineitem.parquet")
    ticks = t.select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("code"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("minute"), F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 200).alias("price"), F.col("l_quantity").cast("long").alias("volume"))
    return rounded(books.entropies(ticks), "code", "minute")


_ENTROPY = """t AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS minute, floor(l_extendedprice / l_quantity / 200) AS price, CAST(l_quantity AS BIGINT) AS volume FROM lineitem),
p AS (SELECT code, minute, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT code, minute, price, count(*) AS n FROM t GROUP BY ALL) GROUP BY code, minute),
v AS (SELECT code, minute, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT code, minute, volume, count(*) AS n FROM t GROUP BY ALL) GROUP BY code, minute),
j AS (SELECT code, minute, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT code, minute, price, volume, count(*) AS n FROM t GROUP BY ALL) GROUP BY code, minute),
e AS (SELECT p.code, p.minute, p.h AS entropy_price, v.h AS entropy_volume, p.h + v.h - j.h AS mutual_information FROM p JOIN v USING (code, minute) JOIN j USING (code, minute))"""


def event_backtest(spark: SparkSession, folder: str) -> DataFrame:
    """Five strategies of a ranked expression: top 5, bottom 5 and three slices."""
    panel = month_panel(spark, folder)
    history = Window.partitionBy("code").orderBy("t")
    prices = panel.select("code", "t", F.col("close").alias("price"), (F.lag("close").over(history) * 11).alias("limit_up"), (F.lag("close").over(history) * 0.1).alias("limit_down"))
    scores = expressions(panel, {"score": FLAGSHIP})
    return backtest.simulated(prices, backtest.targets(scores, (5,), (5,), 3))


def study_exposure(spark: SparkSession, folder: str) -> DataFrame:
    """Exposures of each code from its months of 1995: imbalance, trades, volume."""
    t = spark.read.parquet(f"{folder}/lineitem.parquet").where("year(l_shipdate) = 1995")
    trades = t.select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("code"), F.to_date("l_shipdate").alias("trade_date"), F.when(F.col("l_linenumber") % 2 == 0, "B").otherwise("S").alias("bs"), F.col("l_quantity").cast("double").alias("vol"))
    out = study.exposure(study.order_imbalance(trades), "oib", "n_trades", "total_vol")
    return rounded(out, "code", "n_days")


_EXP_NAMES = ("oib", "n_trades", "total_vol")
_NEAREST = "list_sort(list({0}))[CAST(floor((count({0}) - 1) * {1} + 0.5) AS INT) + 1]"
_EXPOSURE = f"""d AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS trade_date, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE -l_quantity END AS s, l_quantity AS q FROM lineitem WHERE year(l_shipdate) = 1995),
days AS (SELECT code, trade_date, sum(s) / CAST(sum(q) AS DOUBLE) AS oib, count(*) AS n_trades, CAST(sum(q) AS DOUBLE) AS total_vol FROM d GROUP BY code, trade_date),
means AS (SELECT code, count(DISTINCT trade_date) AS n_days, {", ".join(f"avg({c}) AS {c}_mean_raw" for c in _EXP_NAMES)} FROM days GROUP BY code),
bounds AS (SELECT {", ".join(f"{_NEAREST.format(f'{c}_mean_raw', 0.01)} AS {c}_lo, {_NEAREST.format(f'{c}_mean_raw', 0.99)} AS {c}_hi" for c in _EXP_NAMES)} FROM means),
clipped AS (SELECT means.*, {", ".join(f"least(greatest({c}_mean_raw, {c}_lo), {c}_hi) AS {c}_mean" for c in _EXP_NAMES)} FROM means, bounds),
z AS (SELECT *, {", ".join(f"({c}_mean - avg({c}_mean) OVER ()) / stddev_samp({c}_mean) OVER () AS E_{c}_z" for c in _EXP_NAMES)} FROM clipped)"""


def _did(spark: SparkSession, folder: str) -> DataFrame:
    panel = month_panel(spark, folder)
    size = panel.where("year(trade_date) = 1995").groupBy("code").agg(F.avg("volume").alias("E"))
    return study.did_panel(panel.select("code", "trade_date", "volume", "ret"), size, "1996-07-01", "E")


def study_panel(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_did(spark, folder), "code", "trade_date", "post")


_DID = f"""{MONTH_PANEL_SQL}, ex AS (SELECT code, avg(volume) AS e FROM panel WHERE year(trade_date) = 1995 GROUP BY code),
did AS (SELECT p.code, p.trade_date, CAST(CASE WHEN p.trade_date >= DATE '1996-07-01' THEN 1 ELSE 0 END AS TINYINT) AS post, p.volume, p.ret, ex.e AS "E", CASE WHEN p.trade_date >= DATE '1996-07-01' THEN 1 ELSE 0 END * ex.e AS "post_E" FROM panel p LEFT JOIN ex ON p.code = ex.code)"""


def study_regression(spark: SparkSession, folder: str) -> DataFrame:
    """The two-way fixed-effects coefficient of post x exposure on volume, with each kind of clustering."""
    panel = _did(spark, folder).withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    rows = []
    for cluster in ("time", "entity", "both", "none"):
        found = study.two_way(panel, "volume", ["post_E"], cluster=cluster)
        rows.append((cluster, found["post_E"]["coef"], found["post_E"]["se"], found["n"]["n"]))
    return rounded(spark.createDataFrame(rows, "cluster string, coef double, se double, n double"), "cluster")


_TWFE = f"""{_DID}, b AS (SELECT code, trade_date, coalesce(volume, 0) AS y, "post_E" AS x FROM did WHERE "post_E" IS NOT NULL),
s AS (SELECT code, trade_date, y - avg(y) OVER (PARTITION BY code) - avg(y) OVER (PARTITION BY trade_date) + avg(y) OVER () AS y, x - avg(x) OVER (PARTITION BY code) - avg(x) OVER (PARTITION BY trade_date) + avg(x) OVER () AS x FROM b),
k AS (SELECT sum(x * y) / sum(x * x) AS beta, sum(x * x) AS xx, CAST(count(*) AS DOUBLE) AS n, count(DISTINCT code) AS ne, count(DISTINCT trade_date) AS nt FROM s),
u AS (SELECT s.*, x * (y - beta * x) AS sc, y - beta * x AS u FROM s, k),
m AS (SELECT (SELECT sum(q * q) FROM (SELECT sum(sc) AS q FROM u GROUP BY trade_date)) AS mt, (SELECT sum(q * q) FROM (SELECT sum(sc) AS q FROM u GROUP BY code)) AS me, (SELECT sum(sc * sc) FROM u) AS mi, (SELECT sum(u * u) FROM u) AS rss),
out AS (SELECT c.cluster, beta AS coef, CASE c.cluster WHEN 'time' THEN sqrt(mt) / xx WHEN 'entity' THEN sqrt(me) / xx WHEN 'both' THEN sqrt(greatest(mt + me - mi, 0)) / xx ELSE sqrt(rss / (n - 1 - ne - nt + 1) / xx) END AS se, n FROM k, m, (VALUES ('time'), ('entity'), ('both'), ('none')) c(cluster))"""


def expression_search(spark: SparkSession, folder: str) -> DataFrame:
    """A short search: the last generation's expressions with their metrics."""
    panel = expressions(month_panel(spark, folder), {"close": "close", "volume": "volume", "ret": "ret", "label": "ts_shift(ret, 1)"}).persist()
    try:
        space = searches.Space(("close", "volume", "ret"), ("add", "sub", "div", "cs_rank", "ts_mean", "ts_delta", "ts_stddev", "ts_return", "ts_corr", "ts_max", "ts_min", "cs_demean"))
        people = searches.search(panel, space, generations=2, population=8, depth=3, seed=1)
    finally:
        panel.unpersist()
    return spark.createDataFrame([(i, str(p.tree), p.rank, *(float(p.metrics[o]) for o in searches.OBJECTIVES)) for i, p in enumerate(people)], "place int, expression string, front int, " + ", ".join(f"{o} double" for o in searches.OBJECTIVES))


def book_last(spark: SparkSession, folder: str) -> DataFrame:
    """The last snapshot of each code and month as a whole, missing values kept."""
    b = book(spark, folder).withColumn("trade_date", F.to_date(F.date_trunc("month", "trade_date")))
    return rounded(collapsed(b.select("code", "trade_date", "seq", "price", "bp5", "sv5"), "code", "trade_date", order="seq", skip_missing=False), "code", "trade_date")


_LAST = f"{_BOOK}, m AS (SELECT *, CAST(date_trunc('month', trade_date) AS DATE) AS d FROM book), l AS (SELECT code, d AS trade_date, arg_max_null(price, seq) AS price, arg_max_null(bp5, seq) AS bp5, arg_max_null(sv5, seq) AS sv5 FROM m GROUP BY code, d)"

QUERIES = {f.__name__: f for f in (flagship, operators_kernels, operators_structured, operators_moments, operators_rl, futures_factors, futures_basic, minute_families, minute_jumps, book_components, book_information, book_entropies, book_last, event_backtest, study_exposure, study_panel, study_regression, expression_search)}
_MP = MONTH_PANEL_SQL
SQL = {
    "flagship": _wrapped(f"{_MP}, {_IC.replace(' UNION ALL SELECT ' + chr(39) + 'volume' + chr(39) + ', trade_date, code, sb, label FROM m2', '')}", "factor, trade_date, n", ("ic", "rank_ic"), "ic"),
    "operators_moments": _wrapped(f"{_MP}, {_MOMENTS}", "code, t", {"ts_kurt": full(8, l_kurt("x")), "ts_skew": full(8, l_skew("x"))}, "m0"),
    "operators_structured": _wrapped(f"{_MP}, {_STRUCTURES}", "code, t", _STRUCTURE, "s1"),
    "operators_rl": _wrapped(f"{_MP}, m0 AS (SELECT *, list(volume) {W(5)} AS l5, list(ret) {W(5)} AS r5 FROM panel)", "code, t", _RL, "m0"),
    "futures_factors": _wrapped(_FT, "code, t", _FUTURES, "w3"),
    "futures_basic": _wrapped(_FT, "code, t", {n: _FUTURES[n] for n in _BASIC}, "w3"),
    "minute_jumps": _wrapped(_JUMPS, "code, trade_date", _JUMP_COLUMNS, "s"),
    "book_entropies": _wrapped(_ENTROPY, "code, minute", ("entropy_price", "entropy_volume", "mutual_information"), "e"),
    "book_information": _wrapped(_INFORMATION, "code, minute", _TOLD, "told"),
    "book_last": _wrapped(_LAST, "code, trade_date", ("price", "bp5", "sv5"), "l"),
    "study_exposure": _wrapped(_EXPOSURE, "code, n_days", tuple(x for c in _EXP_NAMES for x in (f"{c}_mean_raw", f"{c}_mean", f"E_{c}_z")), "z"),
    "study_panel": _wrapped(_DID, "code, trade_date, post", ("volume", "ret", "E", "post_E"), "did"),
    "study_regression": _wrapped(_TWFE, "cluster", ("coef", "se", "n"), "out"),
}
assert _SCORED
