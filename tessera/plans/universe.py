"""Which stocks may be traded when, and why the others may not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import hit

REASONS = ("not_listed", "new_listing", "near_delisting", "special_treatment", "excluded_prefix", "no_price", "limit_up")


def judged(panel: DataFrame, listing: DataFrame | None = None, special: DataFrame | None = None, least_days: int = 20, buffer_days: int = 20, historical: bool = True, prefixes: tuple[str, ...] = ("300", "688"), price: str = "price", limit: str | None = None) -> DataFrame:
    """``panel`` with reason: the first rule that excludes a row, NULL where none does.

    ``listing``: (code, into_date, out_date), joined by code; ``special``: (code, trade_date, flag) sparse, carried
    forward by code, for good if ``historical``. Calendar days count.
    """
    out = panel
    if listing is not None:
        out = out.join(listing.select("code", "into_date", "out_date"), "code", "left")
    else:
        out = out.withColumns({"into_date": F.lit("1900-01-01").cast("date"), "out_date": F.lit(None).cast("date")})
    if special is not None:
        out = out.join(special.select("code", "trade_date", F.col("flag").cast("int").alias("_flag")), ["code", "trade_date"], "left")
        past = Window.partitionBy("code").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        state = F.max("_flag").over(past) if historical else F.last("_flag", ignorenulls=True).over(past)
        out = out.withColumn("_st", F.coalesce(state, F.lit(0)) == 1).drop("_flag")
    else:
        out = out.withColumn("_st", F.lit(False))
    day = F.col("trade_date")
    reason = F.when(F.col("into_date").isNull(), "not_listed").when(day <= F.date_add("into_date", least_days), "new_listing")
    reason = reason.when(F.col("out_date").isNotNull() & (day >= F.date_sub("out_date", buffer_days)), "near_delisting").when(F.col("_st"), "special_treatment")
    for p in prefixes:
        reason = reason.when(F.col("code").startswith(p), "excluded_prefix")
    reason = reason.when(F.col(price).isNull() | (F.col(price) <= 0), "no_price")
    if limit is not None:
        reason = reason.when(hit(F.col(price), F.col(limit)), "limit_up")
    return out.withColumn("reason", reason).drop("into_date", "out_date", "_st")


def waterfall(rows: DataFrame) -> DataFrame:
    """(trade_date, total, kept, one count per reason): a fixed set of columns, one aggregate."""
    return rows.groupBy("trade_date").agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("kept"), *(F.count_if(F.col("reason") == r).alias(r) for r in REASONS))
