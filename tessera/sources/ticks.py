"""Ticks and order books: collapse, resampling, as-of joins, grids, and the books and quotes that the tables stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = (1, 2, 3, 4, 5)


def minute_grid(closing: bool = True) -> list[int]:
    """The 237 minutes of a session as HHMM: 0931 to 1130 and 1301 to 1457 by closing time, 0930 to 1129 and 1300 to 1456 by opening time."""
    first = (9 * 60 + 30, 13 * 60)
    minutes = [m + k + closing for m, n in zip(first, (120, 117), strict=True) for k in range(n)]
    return [m // 60 * 100 + m % 60 for m in minutes]


def collapsed(snapshots: DataFrame, *keys: str, order: str = "seq_num", skip_missing: bool = True) -> DataFrame:
    """One row per key: every other column's value at the largest ``order``; with ``skip_missing`` the last value that is present, column by column."""
    columns = [c for c in snapshots.columns if c not in (*keys, order)]
    if skip_missing:
        return snapshots.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))
    last = snapshots.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_last"))
    return last.select(*keys, "_last.*")


def trade_totals(stream: DataFrame, *keys: str) -> DataFrame:
    """Trades (type 'T') of an order and trade stream: volume, amount and count per key."""
    traded = F.col("type") == "T"
    return stream.groupBy(*keys).agg(F.sum(F.when(traded, F.col("volume"))).alias("volume"), F.sum(F.when(traded, F.col("price") * F.col("volume"))).alias("amount"), F.count_if(traded).alias("trades"))


def ohlcv(ticks: DataFrame, interval: str, order: str = "ts") -> DataFrame:
    """Bars of an interval: open, high, low, close by the order of ticks, volume, amount, number."""
    return (
        ticks.groupBy("code", F.window("ts", interval).alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("amount"), F.count("*").alias("n"))
        .select("code", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "amount", "n")
    )


def on_grid(bars: DataFrame, interval: str, fill: tuple[str, ...] = (), zero: tuple[str, ...] = ()) -> DataFrame:
    """Bars at every interval between a code's first and last one: ``fill`` columns carry the last value on, ``zero`` columns are 0 where there is none."""
    span = bars.groupBy("code").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select("code", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {interval}"))).alias("ts"))
    out = grid.join(bars, ["code", "ts"], "left")
    past = Window.partitionBy("code").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in fill} | {c: F.coalesce(c, F.lit(0)) for c in zero})


def as_of(left: DataFrame, right: DataFrame, by: str, on: str, *values: str) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or before ``on``, of the same ``by``.

    One union and one window per ``by``: no range join. Rows of the right side at the same moment count. Values may be
    missing in the row that is found; ties of the right side go to the greatest values.
    """
    kept = left.columns
    tagged = left.select(F.struct(*kept).alias("_l"), F.col(by).alias("_by"), F.col(on).alias("_on"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*values).alias("r")).schema[0].dataType).alias("_r"))
    other = right.select(F.lit(None).cast(tagged.schema["_l"].dataType).alias("_l"), F.col(by), F.col(on), F.lit(0), F.struct(*values)).toDF(*tagged.columns)
    past = Window.partitionBy("_by").orderBy("_on", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.unionByName(other).withColumn("_r", F.last("_r", ignorenulls=True).over(past)).where("_side = 1")
    return out.select("_l.*", *(F.col(f"_r.{v}").alias(v) for v in values))


def sampled_evenly(frame: DataFrame, n: int = 237, order: str = "ts") -> DataFrame:
    """n rows of each code at equal distances in its order, the first and the last among them (all rows if it has fewer)."""
    w = Window.partitionBy("code")
    ranked = frame.withColumns({"_k": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    # row k is taken if some i in 0 ... n - 1 has floor(i * (rows - 1) / (n - 1)) = k
    first = F.ceil(F.col("_k") * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    taken = (F.col("_n") <= n) | ((first <= n - 1) & (F.floor(first * (F.col("_n") - 1) / (n - 1)) == F.col("_k")))
    return ranked.where(taken).drop("_k", "_n")


# what the driver's tables stand for


def book(spark: SparkSession, folder: str) -> DataFrame:
    """A five-level book: one snapshot per line item, prices around the trade's, sizes from its quantity and order."""
    return levels(orders(spark, folder))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """The nine columns of line items that say a snapshot: what is shuffled before ``levels`` makes 20 of them is less than half as wide."""
    t = spark.read.parquet(f"{folder}/lineitem.parquet")
    return t.select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("code"), F.to_date("l_shipdate").alias("trade_date"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


#: The order of snapshots.
SEQUENCE = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")


def levels(t: DataFrame, *more: str) -> DataFrame:
    """The book of ``orders``, with further columns of theirs."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    sides: list[Column] = []
    for i in LEVELS:
        sides += [(px * (1 - i * F.col("l_discount") / 10)).alias(f"bp{i}"), (F.col("l_quantity") + i + F.col("l_orderkey") * i % 7).cast("double").alias(f"bv{i}"), (px * (1 + i * F.col("l_tax") / 10)).alias(f"sp{i}"), (F.col("l_quantity") + 6 - i + F.col("l_orderkey") * (i + 2) % 5).cast("double").alias(f"sv{i}")]
    return t.select("code", "trade_date", F.struct(*SEQUENCE).alias("seq"), px.alias("price"), F.col("l_quantity").cast("double").alias("volume"), *more, *sides)


def events(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(code, ts, event_id, price): events of a kind as ticks of one of 20 codes."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    return e.where(F.col("event_type") == kind).select((F.col("user_id") % 20).alias("code"), "ts", "event_id", F.col("value").alias("price"))
