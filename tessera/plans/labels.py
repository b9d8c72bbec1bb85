"""Labels: what a stock returns after a row's date. Shifts go by the panel's row index, so that a suspended stock has no label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions.scalar import hit

def history() -> WindowSpec:
    return Window.partitionBy("code").orderBy("t")


def lead(x: str, n: int = 1) -> Column:
    return F.lead(x, n).over(history())


def day_prices(minutes: DataFrame, start: int, end: int, kind: str = "twap") -> DataFrame:
    """(trade_date, code, price) of a time of day: twap (mean), vwap (amount over volume), close (last) or open (first)."""
    inside = minutes.where((F.col("minute") >= start) & (F.col("minute") <= end))
    price = {"twap": F.avg("close"), "vwap": F.try_divide(F.sum("amount"), F.nullif(F.sum("volume"), F.lit(0.0))), "close": F.max_by("close", "minute"), "open": F.min_by("open", "minute")}[kind]
    return inside.groupBy("trade_date", "code").agg(price.alias("price"))


def open_at(minutes: DataFrame, minute: int, otherwise: int | None = None) -> DataFrame:
    """(trade_date, code, price): the open of a minute, on days that have none of it that of another minute, for all codes of the day."""
    rows = minutes.where(F.col("minute").isin([m for m in (minute, otherwise) if m is not None]))
    day = rows.groupBy("trade_date").agg(F.max((F.col("minute") == minute).cast("int")).alias("_has"))  # one row per day
    chosen = F.when(F.col("_has") == 1, F.lit(minute)).otherwise(F.lit(otherwise))
    return rows.join(day, "trade_date").where(F.col("minute") == chosen).groupBy("trade_date", "code").agg(F.min_by("open", "minute").alias("price"))


def day_volume(minutes: DataFrame, start: int = 925, end: int = 1500) -> DataFrame:
    """(trade_date, code, volume) of a time of day."""
    return minutes.where((F.col("minute") >= start) & (F.col("minute") <= end)).groupBy("trade_date", "code").agg(F.sum("volume").alias("volume"))


def forward_return(panel: DataFrame, price: str = "price") -> DataFrame:
    """panel with label: price to the next row's price, corrected for splits by close over the next row's pre_close (1 where missing)."""
    split = F.coalesce(F.try_divide(F.col("close"), F.nullif(lead("pre_close"), F.lit(0.0))), F.lit(1.0)) if "pre_close" in panel.columns else F.lit(1.0)
    return panel.withColumn("label", F.try_divide(lead(price), F.nullif(F.col(price), F.lit(0.0))) * split - 1)


def open_to_open(panel: DataFrame, buy: str = "buy_open", sell: str = "sell_open") -> DataFrame:
    """panel with label: bought at this row's open and sold at the next one's; NULL if bought at limit-up or sold at limit-down."""
    value = F.try_divide(lead(sell), F.nullif(F.col(buy), F.lit(0.0))) - 1
    blocked = hit(F.col(buy), F.col("limit_up")) | F.coalesce(F.lead(hit(F.col(sell), F.col("limit_down"))).over(history()), F.lit(False))
    return panel.withColumn("label", F.when(~blocked, value))


def close_to_preclose(panel: DataFrame) -> DataFrame:
    """panel with label: the next row's close over its pre_close; NULL if this close is at limit-up, or the next at either limit."""
    value = F.try_divide(lead("close"), F.nullif(lead("pre_close"), F.lit(0.0))) - 1
    end = hit(F.col("close"), F.col("limit_up")) | hit(F.col("close"), F.col("limit_down"))
    blocked = hit(F.col("close"), F.col("limit_up")) | F.coalesce(F.lead(end).over(history()), F.lit(False))
    return panel.withColumn("label", F.when(~blocked, value))


def winsorized(panel: DataFrame, sigma: float = 3.0, label: str = "label") -> DataFrame:
    """label clipped to its date's mean and ``sigma`` sample deviations."""
    w = Window.partitionBy("t")
    m, s = F.avg(label).over(w), F.coalesce(F.stddev_samp(label).over(w), F.lit(0.0))
    return panel.withColumn(label, F.when(F.col(label).isNotNull(), F.least(F.greatest(F.col(label), m - sigma * s), m + sigma * s)))
