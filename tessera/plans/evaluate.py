"""How good scores are: information coefficients, quantile and top-k returns, performance, drawdowns, ensembles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import ratio


def correlation(x: Column, y: Column) -> Column:
    """Pearson over the pairs present, as an aggregate; NULL without spread."""
    pair = x.isNotNull() & y.isNotNull()
    a, b = F.when(pair, x), F.when(pair, y)
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_rank(x: str, *by: str) -> Column:
    """Ranks with the mean of ties."""
    w = Window.partitionBy(*by)
    return F.when(F.col(x).isNotNull(), F.rank().over(w.orderBy(F.col(x).asc_nulls_last())) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2)


def long_form(frame: DataFrame, factors: list[str], *keys: str) -> DataFrame:
    """(keys, factor, score): all factors evaluated by one job."""
    return frame.unpivot(list(keys), factors, "factor", "score")


def daily_ic(scores: DataFrame, least: int = 10, date: str = "trade_date") -> DataFrame:
    """(factor, date, n, ic, rank_ic) from rows (factor, date, score, label): two aggregates of one shuffle by (factor, date)."""
    valid = scores.where(F.col("score").isNotNull() & F.col("label").isNotNull())
    ranked = valid.withColumns({"_rs": average_rank("score", "factor", date), "_rl": average_rank("label", "factor", date)})
    out = ranked.groupBy("factor", date).agg(F.count("*").alias("n"), correlation(F.col("score"), F.col("label")).alias("ic"), correlation(F.col("_rs"), F.col("_rl")).alias("rank_ic"))
    return out.where(F.col("n") >= least)


def ic_summary(ic: DataFrame, segments: dict[str, tuple[str | None, str | None]], date: str = "trade_date") -> DataFrame:
    """(factor, segment, metric, mean, std, icir, win_rate, n); segments may overlap, so each row is counted in every one it is in."""
    inside = F.array(*(F.when((F.col(date) >= F.lit(a or "0001-01-01").cast("date")) & (F.col(date) <= F.lit(b or "9999-12-31").cast("date")), F.lit(name)) for name, (a, b) in segments.items()))
    rows = ic.withColumn("segment", F.explode(F.array_compact(inside))).unpivot(["factor", "segment"], ["ic", "rank_ic"], "metric", "value").where("value is not null")
    m, s = F.avg("value"), F.stddev_samp("value")
    return rows.groupBy("factor", "segment", "metric").agg(m.alias("mean"), s.alias("std"), ratio(m, s).alias("icir"), F.avg((F.col("value") > 0).cast("double")).alias("win_rate"), F.count("*").alias("n"))


def ranked(scores: DataFrame, *by: str) -> DataFrame:
    """rows with k (1: the smallest score; ties by code) and n of their group."""
    valid = scores.where(F.col("score").isNotNull() & F.col("label").isNotNull())
    w = Window.partitionBy(*by)
    return valid.withColumns({"k": F.row_number().over(w.orderBy("score", "code")), "n": F.count("*").over(w)})


def quantile_returns(scores: DataFrame, groups: int, *by: str) -> DataFrame:
    """(by, bucket 1 to groups, ret, n): the mean label of each quantile group, groups by ceil(k * groups / n)."""
    r = ranked(scores, *by).withColumn("bucket", F.ceil(F.col("k") * groups / F.col("n")).cast("int"))
    return r.groupBy(*by, "bucket").agg(F.avg("label").alias("ret"), F.count("*").alias("n"))


def top_tail(scores: DataFrame, ks: list[int], *by: str) -> DataFrame:
    """(by, top_k..., tail_k...): the mean label of the largest and of the smallest k scores."""
    r = ranked(scores, *by)
    return r.groupBy(*by).agg(*(F.avg(F.when(F.col("k") > F.col("n") - k, F.col("label"))).alias(f"top_{k}") for k in ks), *(F.avg(F.when(F.col("k") <= k, F.col("label"))).alias(f"tail_{k}") for k in ks))


def performance(returns: DataFrame, *by: str, date: str = "trade_date", ret: str = "ret", days: int = 242) -> DataFrame:
    """(by, ann_return, ann_vol, sharpe, max_drawdown, win_rate, total_return, n) of return series in order of date."""
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    nav = returns.where(F.col(ret).isNotNull()).withColumn("_nav", F.product(1 + F.col(ret)).over(w))
    fall = nav.withColumn("_fall", F.try_divide(F.col("_nav"), F.greatest(F.max("_nav").over(w), F.lit(1.0))) - 1)
    m, s = F.avg(ret), F.stddev_samp(ret)
    return fall.groupBy(*by).agg((m * days).alias("ann_return"), (s * days**0.5).alias("ann_vol"), ratio(m * days, s * days**0.5).alias("sharpe"), F.min("_fall").alias("max_drawdown"), F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"), (F.max_by("_nav", date) - 1).alias("total_return"), F.count("*").alias("n"))


def standardised(scores: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """score less its group's mean over its sample deviation + 1e-8."""
    w = Window.partitionBy(*by)
    return scores.withColumn(score, (F.col(score) - F.avg(score).over(w)) / (F.stddev_samp(score).over(w) + 1e-8))


def score_correlations(scores: DataFrame, date: str = "trade_date") -> DataFrame:
    """(a, b, correlation): the mean over dates of the correlations of each two models' scores (rows: model, date, code, score)."""
    left = scores.select(F.col("model").alias("a"), date, "code", F.col("score").alias("x"))
    right = scores.select(F.col("model").alias("b"), date, "code", F.col("score").alias("y"))
    daily = left.join(right, [date, "code"]).where("a < b").groupBy("a", "b", date).agg(correlation(F.col("x"), F.col("y")).alias("c"))
    return daily.groupBy("a", "b").agg(F.avg("c").alias("correlation"))


def chosen(icir: dict[str, float], correlations: dict[tuple[str, str], float], least_icir: float = 0.0, most: float = 0.85) -> list[str]:
    """Models by falling ICIR, each kept if its correlation with all kept before is at most ``most``."""
    kept: list[str] = []
    for m in sorted((m for m, v in icir.items() if v >= least_icir), key=lambda m: (-icir[m], m)):
        if all(abs(correlations.get((min(m, k), max(m, k)), 0.0)) <= most for k in kept):
            kept.append(m)
    return kept


def ensemble(scores: DataFrame, models: list[str], date: str = "trade_date") -> DataFrame:
    """The mean of the models' standardised scores, standardised again by date."""
    one = standardised(scores.where(F.col("model").isin(models)), "model", date).groupBy(date, "code").agg(F.avg("score").alias("score"))
    return standardised(one, date)


def folds(dates: DataFrame, months: int = 3, date: str = "trade_date") -> DataFrame:
    """(date, fold): blocks of so many months from the first date's month on."""
    first = dates.agg(F.trunc(F.min(date), "month").alias("_first"))
    return dates.select(date).distinct().crossJoin(F.broadcast(first)).select(date, F.floor(F.months_between(F.trunc(date, "month"), "_first") / months).cast("int").alias("fold"))


def field_correlations(panel: DataFrame, fields: list[str], by: str = "t") -> DataFrame:
    """(a, b, correlation): of each two fields over the codes, missing cells as the row index's median, averaged over row indices; one aggregate for all pairs."""
    w = Window.partitionBy(by)
    filled = panel.select(by, *(F.coalesce(F.col(c), F.percentile(c, F.lit(0.5)).over(w)).alias(c) for c in fields))
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :]]
    daily = filled.groupBy(by).agg(*(correlation(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs))
    means = daily.agg(*(F.avg(f"`{a}|{b}`").alias(f"{a}|{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("correlation")) for a, b in pairs))
    return means.select(F.inline(rows))


def even_groups(scored: DataFrame, groups: int = 20, *by: str) -> DataFrame:
    """(by, group, ret, n): the mean label of n // ``groups`` rows each in the order of the score, what remains in the last group.

    ``by`` (trade_date) names a day; days with fewer than two rows a group are left out. Ties go by code.
    """
    by = by or ("trade_date",)
    day = Window.partitionBy(*by)
    valid = scored.where(F.col("score").isNotNull() & F.col("label").isNotNull())
    placed = valid.withColumns({"_k": F.row_number().over(day.orderBy("score", "code")) - 1, "_n": F.count("*").over(day)}).where(F.col("_n") >= 2 * groups)
    group = F.least(F.floor(F.col("_k") / F.floor(F.col("_n") / groups)) + 1, F.lit(groups)).cast("int").alias("group")
    return placed.groupBy(*by, group).agg(F.avg("label").alias("ret"), F.count("*").alias("n"))


def group_summary(groups: DataFrame, *by: str, day: str = "trade_date", days: int = 243) -> DataFrame:
    """(by, group, ann_ret, ann_vol, sharpe, total, n): of a group's daily returns, added up and not compounded; population deviation."""
    out = groups.groupBy(*by, "group").agg((F.avg("ret") * days).alias("ann_ret"), (F.stddev_pop("ret") * math.sqrt(days)).alias("ann_vol"), F.sum("ret").alias("total"), F.countDistinct(day).alias("n"))
    return out.withColumn("sharpe", F.col("ann_ret") / (F.col("ann_vol") + 1e-9))


def shifted(scored: DataFrame, rows: int = 1) -> DataFrame:
    """Scores against the label ``rows`` days later of the same code; what has none is left out."""
    if rows <= 0:
        return scored
    later = F.lead("label", rows).over(Window.partitionBy(*(c for c in ("factor", "code") if c in scored.columns)).orderBy("trade_date"))
    return scored.withColumn("label", later).where(F.col("label").isNotNull())


def factor_report(scores: DataFrame, segments: dict[str, tuple[str | None, str | None]], groups: int = 10, least: int = 10) -> DataFrame:
    """(factor, segment, metric, IC statistics, and of the largest against the smallest group: mean, deviation, days): an IC scan and a group backtest of many factors at once."""
    ic = ic_summary(daily_ic(scores, least), segments)
    days = even_groups(scores, groups, "factor", "trade_date")
    gap = days.groupBy("factor", "trade_date").agg((F.max(F.when(F.col("group") == groups, F.col("ret"))) - F.max(F.when(F.col("group") == 1, F.col("ret")))).alias("gap"))
    spread = gap.groupBy("factor").agg(F.avg("gap").alias("spread_mean"), F.stddev_samp("gap").alias("spread_std"), F.count("gap").alias("spread_days"))
    return ic.join(spread, "factor", "left")
