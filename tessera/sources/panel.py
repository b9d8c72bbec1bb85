"""Panels from trades: bars, calendar, dense grid, null normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import finite


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """(code, ts, price, volume, amount, order...): line items as trades of their supplier's code."""
    t = spark.read.parquet(f"{folder}/lineitem.parquet")
    code = F.lpad(F.col("l_suppkey").cast("string"), 6, "0")
    return t.select(code.alias("code"), F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").cast("double").alias("volume"), F.col("l_extendedprice").alias("amount"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("turn"))


def bars(ticks: DataFrame, period: str = "month") -> DataFrame:
    """One bar per code and calendar period: open and close by the order of trades, high, low, sums. One shuffle, partial aggregates."""
    day = F.to_date(F.date_trunc(period, "ts")).alias("trade_date")
    return ticks.groupBy("code", day).agg(
        F.min_by("price", "turn").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "turn").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount")
    )


def dense(frame: DataFrame, *fields: str, key: str = "trade_date") -> DataFrame:
    """(code, trade_date, t, fields): a row for every code on every date, t counting dates from 0; non-finite cells are NULL.

    Dates and codes are distinct values only: both tables are small against the panel, whose size their product is.
    """
    fields = fields or tuple(c for c in frame.columns if c not in ("code", key))
    dates = frame.select(key).distinct().withColumn("t", F.row_number().over(Window.orderBy(key)) - 1)
    grid = frame.select("code").distinct().crossJoin(dates)
    kinds = dict(frame.dtypes)
    cells = frame.select("code", key, *(finite(F.col(f)).alias(f) if kinds[f] in ("double", "float") else F.col(f) for f in fields))
    return grid.join(cells, ["code", key], "left")


def month_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly panel: open, high, low, close, volume, amount, ret (close to close), sector."""
    panel = dense(bars(trades(spark, folder)))
    history = Window.partitionBy("code").orderBy("t")
    panel = panel.withColumn("ret", F.try_divide(F.col("close") - F.lag("close").over(history), F.lag("close").over(history)))
    sector = spark.read.parquet(f"{folder}/supplier.parquet").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), F.col("s_nationkey").cast("double").alias("sector"))
    return panel.join(sector, "code", "left")


MONTH_PANEL_SQL = """
li AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date,
         l_extendedprice / l_quantity AS px, l_quantity AS qty, l_extendedprice AS amt,
         row_number() OVER (PARTITION BY l_suppkey, date_trunc('month', l_shipdate)
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k
  FROM lineitem),
bars AS (
  SELECT code, trade_date, min_by(px, k) AS open, max(px) AS high, min(px) AS low, max_by(px, k) AS close,
         CAST(sum(qty) AS DOUBLE) AS volume, sum(amt) AS amount
  FROM li GROUP BY code, trade_date),
dates AS (SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT trade_date FROM bars)),
grid AS (
  SELECT c.code, d.trade_date, d.t, b.open, b.high, b.low, b.close, b.volume, b.amount
  FROM (SELECT DISTINCT code FROM bars) c CROSS JOIN dates d LEFT JOIN bars b ON b.code = c.code AND b.trade_date = d.trade_date),
panel AS (
  SELECT g.*, g.close / lag(g.close) OVER (PARTITION BY g.code ORDER BY g.t) - 1 AS ret, CAST(s.s_nationkey AS DOUBLE) AS sector
  FROM grid g LEFT JOIN supplier s ON lpad(CAST(s.s_suppkey AS VARCHAR), 6, '0') = g.code)
"""
