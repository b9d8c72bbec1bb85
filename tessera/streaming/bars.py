"""Streams of ticks: bars by event time with watermarks, and exponential means as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaming_bars(ticks: DataFrame, interval: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Bars of (code, ts, price, volume): the aggregation of ``sources.ticks.ohlcv`` with a watermark; late ticks beyond it are dropped by contract."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy("code", F.window("ts", interval).alias("w"))
        .agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n"))
        .select("code", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "n")
    )


def streaming_ema(ticks: DataFrame, alpha: float) -> DataFrame:
    """(code, ts, ema) after each micro-batch's last tick of a code: the recursion's value is the state, one number per code."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else None
        at = None
        for frame in frames:
            for ts, price in frame.sort_values("ts")[["ts", "price"]].itertuples(index=False):
                value = price if value is None else alpha * price + (1 - alpha) * value
                at = ts
        if value is not None:
            state.update((value,))
            yield pd.DataFrame({"code": [key[0]], "ts": [at], "ema": [value]})

    return ticks.groupBy("code").applyInPandasWithState(step, "code long, ts timestamp, ema double", "value double", "update", GroupStateTimeout.NoTimeout)
