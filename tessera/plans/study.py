"""Policy studies: stock-day outcomes, exposures, difference-in-differences panels, fixed-effects regressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import ratio

KEYS = ["code", "trade_date"]


def effective_spread(fills: DataFrame) -> DataFrame:
    """Per stock-day of fills (price, vol, mid): counts, volume, and twice the distance from the mid in basis points, weighted by volume."""
    known = F.when(F.col("mid") > 0, F.col("vol"))
    num = F.sum(2 * F.abs(F.col("price") - F.col("mid")) / F.when(F.col("mid") > 0, F.col("mid")) * 10000 * F.col("vol"))
    out = fills.groupBy(*KEYS).agg(F.count("*").alias("n_trades"), F.sum("vol").alias("volume_sum"), F.sum(F.col("price") * F.col("vol")).alias("dollar_vol"), num.alias("es_bps_num"), F.sum(known).alias("es_bps_den"))
    return out.withColumn("es_bps", F.try_divide(F.col("es_bps_num"), F.col("es_bps_den")))


def realized_variance(mids: DataFrame, order: str) -> DataFrame:
    """The sum of squared log changes of positive mids within a stock-day."""
    from pyspark.sql import Window

    step = F.log("mid") - F.lag(F.log("mid")).over(Window.partitionBy(*KEYS).orderBy(order))
    return mids.where("mid > 0").withColumn("r", step).groupBy(*KEYS).agg(F.sum(F.col("r") * F.col("r")).alias("rv_mid"))


def amihud(mids: DataFrame, fills: DataFrame, order: str) -> DataFrame:
    """The day's absolute change of the mid per million traded."""
    move = mids.where("mid > 0").groupBy(*KEYS).agg(F.abs(F.max_by("mid", order) / F.min_by("mid", order) - 1).alias("move"))
    money = fills.groupBy(*KEYS).agg(F.sum(F.col("price") * F.col("vol")).alias("money"))
    return move.join(money, KEYS, "left").select(*KEYS, (ratio(F.col("move"), F.col("money")) * 1000000).alias("amihud"))


def order_imbalance(trades: DataFrame) -> DataFrame:
    """Per stock-day of trades (bs 'B' or 'S', vol): signed volume over all, count, volume."""
    buys, sells = F.sum(F.when(F.col("bs") == "B", F.col("vol"))), F.sum(F.when(F.col("bs") == "S", F.col("vol")))
    both = F.coalesce(buys, F.lit(0.0)) + F.coalesce(sells, F.lit(0.0))
    return trades.where(F.col("bs").isin("B", "S")).groupBy(*KEYS).agg(ratio(F.coalesce(buys, F.lit(0.0)) - F.coalesce(sells, F.lit(0.0)), both).alias("oib"), F.count("*").alias("n_trades"), both.alias("total_vol"))


def nearest_quantile(column: str, q: float) -> Column:
    """The order statistic nearest to the q-quantile (halves up): an exact aggregate."""
    s = F.array_sort(F.collect_list(column))
    return F.get(s, F.floor((F.size(s) - 1) * q + 0.5).cast("int"))


def exposure(days: DataFrame, *columns: str, clip: float = 0.01) -> DataFrame:
    """Per code the means over its days, clipped at two quantiles over all codes, and their z-values; one row per code goes through one aggregate."""
    means = days.groupBy("code").agg(F.countDistinct("trade_date").alias("n_days"), *(F.avg(c).alias(f"{c}_mean_raw") for c in columns))
    bounds = means.agg(*(nearest_quantile(f"{c}_mean_raw", q).alias(f"{c}_{k}") for c in columns for k, q in (("lo", clip), ("hi", 1 - clip))))
    out = means.crossJoin(F.broadcast(bounds))
    for c in columns:
        out = out.withColumn(f"{c}_mean", F.when(F.col(f"{c}_mean_raw").isNotNull(), F.least(F.greatest(f"{c}_mean_raw", f"{c}_lo"), F.col(f"{c}_hi")))).drop(f"{c}_lo", f"{c}_hi")
    moments = out.agg(*(f(f"{c}_mean").alias(f"{c}_{k}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))))
    out = out.crossJoin(F.broadcast(moments))
    for c in columns:
        out = out.withColumn(f"E_{c}_z", ratio(F.col(f"{c}_mean") - F.col(f"{c}_m"), F.col(f"{c}_s"))).drop(f"{c}_m", f"{c}_s")
    return out


def did_panel(outcomes: DataFrame, exposures: DataFrame, policy_date: str, *names: str) -> DataFrame:
    """Outcomes with their code's exposures, post (from the policy date on), and the interactions post_<exposure>."""
    panel = outcomes.join(exposures.select("code", *names), "code", "left").withColumn("post", (F.col("trade_date") >= F.lit(policy_date).cast("date")).cast("byte"))
    return panel.withColumns({f"post_{n}": F.col("post") * F.col(n) for n in names})


def two_way(panel: DataFrame, y: str, xs: list[str], entity: str = "code", time: str = "trade_date", cluster: str = "time", tolerance: float = 1e-10, rounds: int = 50) -> dict[str, dict[str, float]]:
    """Coefficients of y on xs with entity and time effects: {name: coef, se, t}, and n.

    Effects are swept out by alternating means (one pass suffices where every entity has every date); the normal
    equations and the clusters' scores are aggregates of a few numbers. ``cluster``: time, entity, both or none.
    """
    from pyspark.sql import Window

    names = [y, *xs]
    frame = panel.select(F.col(entity).alias("e"), F.col(time).alias("d"), *(F.col(c).cast("double").alias(c) for c in names)).dropna().persist()
    try:
        n, entities, times = frame.agg(F.count("*"), F.countDistinct("e"), F.countDistinct("d")).first()
        if n <= entities + times + len(xs):
            return {"n": {"n": float(n)}}
        if n == entities * times:  # balanced: closed form
            over = {k: Window.partitionBy(k) for k in "ed"}
            swept = frame.select("e", "d", *((F.col(c) - F.avg(c).over(over["e"]) - F.avg(c).over(over["d"])).alias(c) for c in names))
            grand = frame.agg(*(F.avg(c).alias(c) for c in names)).first()
            swept = swept.select("e", "d", *((F.col(c) + F.lit(grand[c])).alias(c) for c in names))
        else:
            swept = frame
            for k in range(rounds):
                for by in "ed":
                    swept = swept.select("e", "d", *((F.col(c) - F.avg(c).over(Window.partitionBy(by))).alias(c) for c in names))
                swept = _written(swept)
                worst = swept.groupBy("e").agg(*(F.abs(F.avg(c)).alias(c) for c in names)).agg(*(F.max(c) for c in names)).first()
                if max(worst) < tolerance:
                    break
        k = len(xs)
        moments = swept.agg(*(F.sum(F.col(a) * F.col(b)) for i, a in enumerate(xs) for b in [*xs[i:], y])).first()
        import numpy as np

        gram, rhs, at = np.zeros((k, k)), np.zeros(k), 0
        for i in range(k):
            for j in range(i, k):
                gram[i, j] = gram[j, i] = moments[at]
                at += 1
            rhs[i] = moments[at]
            at += 1
        inverse = np.linalg.pinv(gram)
        beta = inverse @ rhs
        rest = F.col(y) - sum((F.col(x) * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0))
        scores = swept.select("e", "d", rest.alias("u"), *((F.col(x) * rest).alias(f"s{i}") for i, x in enumerate(xs)))

        def meat(*by: str) -> np.ndarray:
            sums = scores.groupBy(*by).agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k))) if by else scores
            row = sums.agg(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(k))).first()
            return np.array(row, float).reshape(k, k)

        if cluster == "none":
            sigma = scores.agg(F.sum(F.col("u") * F.col("u"))).first()[0] / (n - k - entities - times + 1)
            cov = sigma * inverse
        else:
            inner = {"time": lambda: meat("d"), "entity": lambda: meat("e"), "both": lambda: meat("d") + meat("e") - meat("e", "d")}[cluster]()
            cov = inverse @ inner @ inverse
        out = {x: {"coef": float(b), "se": (s := math.sqrt(max(cov[i, i], 0.0))), "t": float(b) / s if s else math.nan} for i, (x, b) in enumerate(zip(xs, beta, strict=True))}
        return out | {"n": {"n": float(n)}}
    finally:
        frame.unpersist()


def _written(df: DataFrame) -> DataFrame:
    """``df`` materialised so that rounds don't stack up in the plan: a checkpoint in the session's folder where one is named."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        return df.persist()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def grid(panel: DataFrame, outcomes: list[str], interactions: list[str], **options) -> list[dict]:
    """One row per outcome and interaction; a regression that fails is a row with its error."""
    rows = []
    for y in outcomes:
        for x in interactions:
            try:
                rows.append({"outcome": y, "interaction": x, **two_way(panel, y, [x], **options).get(x, {}), "error": None})
            except Exception as e:  # noqa: BLE001  a row of the grid, not the end of it
                rows.append({"outcome": y, "interaction": x, "error": str(e)[:200]})
    return rows
