"""Named factors: functions of a panel that give a column each, computed together in one select."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.factors.daily import history, lag, rolled
from tessera.functions.scalar import ratio

Factor = Callable[[], Column]
REGISTRY: dict[str, Factor] = {}


def factor(name: str) -> Callable[[Factor], Factor]:
    """Registers a function that returns a column over (code, t) panels; windows of windows belong into ``factors.daily``."""

    def register(make: Factor) -> Factor:
        if name in REGISTRY:
            raise ValueError(f"factor {name!r} is registered")
        REGISTRY[name] = make
        return make

    return register


def compute_all(panel: DataFrame, names: list[str] | None = None, known_before: bool = True) -> DataFrame:
    """(code, t, the named factors or all); with ``known_before`` each row holds what was known before its date."""
    names = sorted(REGISTRY) if names is None else names
    out = panel.select("code", "t", *(REGISTRY[n]().alias(n) for n in names))
    return out.select("code", "t", *(F.lag(n).over(history()).alias(n) for n in names)) if known_before else out


@factor("momentum_20d")
def _momentum() -> Column:
    return F.try_divide(F.col("close"), lag("close", 20)) - 1


@factor("volatility_20d")
def _volatility() -> Column:
    return rolled(F.stddev_samp, F.col("ret"), 20)


@factor("volume_mean_10d")
def _volume() -> Column:
    return rolled(F.avg, F.col("volume"), 10)


@factor("boll_pos_norm")
def _bollinger() -> Column:
    m, s = rolled(F.avg, F.col("close"), 20, 10), rolled(F.stddev_samp, F.col("close"), 20, 10)
    return ratio(F.col("close") - m, 2 * s)


def cr_family(panel: DataFrame, rows: int = 26) -> DataFrame:
    """(code, t, CR2, CR3, CR4): strengths about the mean of open, high, low and close, of high and low, and of high, low and close; CR2 is clipped at 0."""
    prices = {"CR2": (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4, "CR3": (F.col("high") + F.col("low")) / 2, "CR4": (F.col("high") + F.col("low") + F.col("close")) / 3}
    steps = panel.select("code", "t", *(c for n, p in prices.items() for c in (F.greatest(F.col("high") - F.lag(p).over(history()), F.lit(0.0)).alias(f"{n}_u"), F.greatest(F.lag(p).over(history()) - F.col("low"), F.lit(0.0)).alias(f"{n}_d"))))
    value = lambda n: ratio(100 * rolled(F.sum, F.col(f"{n}_u"), rows, 1), rolled(F.sum, F.col(f"{n}_d"), rows, 1))
    return steps.select("code", "t", F.greatest(value("CR2"), F.lit(0.0)).alias("CR2"), value("CR3").alias("CR3"), value("CR4").alias("CR4"))
