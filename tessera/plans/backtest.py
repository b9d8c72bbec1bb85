"""The event backtest: a fold over dates for each strategy, many strategies in parallel.

Spark prepares for each strategy the rows that it can need, its targets and the rows on which they may still be
held; the fold itself is sequential by nature and runs as one Python task per strategy.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = "strategy string, t long, nav double, cash double, holdings long, bought long, sold long, delayed long, skipped long"


@dataclass(frozen=True)
class Costs:
    commission: float = 0.00025
    stamp_duty: float = 0.0005
    slippage_bps: float = 0.0
    lot: int = 100
    capital: float = 1_000_000.0


def targets(scores: DataFrame, tops: tuple[int, ...] = (), tails: tuple[int, ...] = (), groups: int = 0) -> DataFrame:
    """(strategy, t, code): the largest and smallest k scores of a row index, and the slices int(g / G * n) of its ranks."""
    valid = scores.where(F.col("score").isNotNull())
    r = valid.withColumns({"k": F.row_number().over(Window.partitionBy("t").orderBy("score", "code")), "n": F.count("*").over(Window.partitionBy("t"))})
    names = [F.when(F.col("k") > F.col("n") - k, F.lit(f"top_{k}")) for k in tops] + [F.when(F.col("k") <= k, F.lit(f"tail_{k}")) for k in tails]
    for g in range(groups):
        names.append(F.when((F.col("k") > F.floor(F.col("n") * g / groups)) & (F.col("k") <= F.floor(F.col("n") * (g + 1) / groups)), F.lit(f"group_{g + 1}")))
    return r.select("t", "code", F.explode(F.array_compact(F.array(*names))).alias("strategy"))


def simulated(prices: DataFrame, wanted: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per strategy and date (COLUMNS).

    ``prices``: (t, code, price, limit_up, limit_down); ``wanted``: ``targets``. Each date everything held is sold first: a stock
    without price or at its lower limit is kept and tried again. Then cash is split equally among the date's targets that have a price
    below their upper limit and are not held, in whole lots; what is too dear for a lot is skipped. Cash never falls below zero.
    """
    # what was bought is sold on the next date on which it can be: rows after that are not needed
    order = Window.partitionBy("code").orderBy("t")
    sells = F.col("price").isNotNull() & (F.col("price") > 0) & ~F.coalesce(_hits("price", "limit_down"), F.lit(False))
    after = order.rowsBetween(1, Window.unboundedFollowing)
    until = prices.select("code", "t", F.coalesce(F.min(F.when(sells, F.col("t"))).over(after), F.max("t").over(after), F.col("t")).alias("_until"))
    spans = wanted.join(until, ["t", "code"], "left").select("strategy", "code", F.col("t").alias("_from"), F.explode(F.sequence("t", F.coalesce("_until", "t"))).alias("t"))
    spans = spans.groupBy("strategy", "code", "t").agg(F.max(F.col("t") == F.col("_from")).alias("want"))
    rows = spans.join(prices.select("t", "code", "price", "limit_up", "limit_down"), ["t", "code"], "left")
    days = wanted.select("strategy").distinct().crossJoin(prices.select("t").distinct())  # strategies x dates: a row without a code each
    rows = rows.unionByName(days, allowMissingColumns=True)
    return rows.groupBy("strategy").applyInPandas(lambda frame: fold(frame, costs), COLUMNS)


def _hits(price: str, limit: str) -> Column:
    p, x = F.col(price), F.col(limit)
    return (x != 0) & (F.abs(p - x) / F.abs(x) < 1e-4)


def fold(frame: pd.DataFrame, costs: Costs) -> pd.DataFrame:
    """The days of one strategy."""
    name = frame["strategy"].iloc[0]
    cash, shares, last, out = costs.capital, {}, {}, []
    slip = costs.slippage_bps / 10_000
    for t, day in frame.sort_values(["t", "code"]).groupby("t"):
        price = {r.code: (r.price, r.limit_up, r.limit_down) for r in day.itertuples() if pd.notna(r.price) and r.price > 0}
        bought = sold = delayed = skipped = 0
        for code in sorted(shares):
            p = price.get(code)
            if p is None or _at(p[0], p[2]):
                delayed += 1
                continue
            money = shares.pop(code) * p[0] * (1 - slip)
            cash += money * (1 - costs.commission - costs.stamp_duty)
            sold += 1
        choice = [c for c in day.loc[day["want"].eq(True), "code"] if c not in shares]
        free = [c for c in choice if c in price and not _at(price[c][0], price[c][1])]
        skipped += len(choice) - len(free)
        each = cash / len(free) if free else 0.0
        for code in free:
            p = price[code][0] * (1 + slip)
            n = int(each / (p * (1 + costs.commission)) // costs.lot) * costs.lot
            if n <= 0:
                skipped += 1
                continue
            cash -= n * p * (1 + costs.commission)
            shares[code] = n
            bought += 1
        last.update({c: p[0] for c, p in price.items()})
        nav = cash + sum(n * last.get(c, 0.0) for c, n in shares.items())
        out.append((name, int(t), nav, cash, len(shares), bought, sold, delayed, skipped))
    return pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])


def _at(price: float, limit: float) -> bool:
    return pd.notna(limit) and limit != 0 and abs(price - limit) / abs(limit) < 1e-4
