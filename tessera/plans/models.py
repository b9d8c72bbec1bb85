"""Models over a panel: any MLlib regressor as a plug-in, out-of-fold scores, ensembles of the nearest folds, the WPCC metric."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Model, Pipeline
from pyspark.ml.base import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import ratio
from tessera.plans.evaluate import correlation, standardised

PLUG_INS = {"linear": lambda: LinearRegression(regParam=1e-3, featuresCol="features", labelCol="label"), "trees": lambda: GBTRegressor(maxIter=20, maxDepth=4, featuresCol="features", labelCol="label", seed=0)}


def trained(panel: DataFrame, features: list[str], estimator: Estimator | None = None) -> Model:
    """A fitted pipeline; rows with a missing feature or label take no part."""
    rows = panel.dropna(subset=[*features, "label"])
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), estimator or PLUG_INS["linear"]()]).fit(rows)


def scored(model: Model, panel: DataFrame, features: list[str], *keys: str) -> DataFrame:
    """(keys, score) of rows with all features."""
    return model.transform(panel.dropna(subset=features)).select(*keys, F.col("prediction").alias("score"))


def rolling(panel: DataFrame, features: list[str], folds: list[int], estimator: str = "linear") -> dict[int, Model]:
    """For each fold (column ``fold``) the model of all others."""
    return {k: trained(panel.where(F.col("fold") != k), features, PLUG_INS[estimator]()) for k in folds}


def out_of_fold(models: dict[int, Model], panel: DataFrame, features: list[str], *keys: str) -> DataFrame:
    """Scores of every row by the model that has not seen its fold."""
    return reduce(DataFrame.union, (scored(m, panel.where(F.col("fold") == k), features, *keys) for k, m in sorted(models.items())))


def nearest_ensemble(models: dict[int, Model], panel: DataFrame, features: list[str], date: str = "trade_date", n: int = 4) -> DataFrame:
    """(date, code, score): the mean of the last n folds' predictions, standardised by date."""
    last = sorted(models)[-n:]
    every = reduce(DataFrame.union, (scored(models[k], panel, features, date, "code") for k in last))
    return standardised(every.groupBy(date, "code").agg(F.avg("score").alias("score")), date)


def wpcc(scores: DataFrame, date: str = "trade_date", half: float = 0.5) -> DataFrame:
    """(date, wpcc): correlation of score and label weighted by the score's rank, the largest weighing 1 and halving every ``half`` of the codes."""
    from pyspark.sql import Window

    w = Window.partitionBy(date)
    valid = scores.where(F.col("score").isNotNull() & F.col("label").isNotNull())
    weighted = valid.withColumn("_w", F.pow(F.lit(0.5), (F.row_number().over(w.orderBy(F.desc("score"), "code")) - 1) / F.count("*").over(w) / half))
    means = weighted.groupBy(date).agg((F.sum(F.col("_w") * F.col("score")) / F.sum("_w")).alias("ms"), (F.sum(F.col("_w") * F.col("label")) / F.sum("_w")).alias("ml"))
    both = weighted.join(means, date)
    s, y = F.col("score") - F.col("ms"), F.col("label") - F.col("ml")
    return both.groupBy(date).agg(ratio(F.sum(F.col("_w") * s * y), F.sqrt(F.sum(F.col("_w") * s * s)) * F.sqrt(F.sum(F.col("_w") * y * y))).alias("wpcc"))


def importance(models: dict[int, Model], features: list[str]) -> dict[str, float]:
    """The mean over folds of each feature's importance (trees) or absolute coefficient (linear)."""
    total = dict.fromkeys(features, 0.0)
    for m in models.values():
        last = m.stages[-1]
        values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
        for f, v in zip(features, values, strict=True):
            total[f] += float(v) / len(models)
    return total


def similarity(a: DataFrame, b: DataFrame, least: int = 2) -> float:
    """The mean over row indices of the correlation of two scores (code, t, score); 0 where all are flat."""
    both = a.select("code", "t", F.col("score").alias("x")).join(b.select("code", "t", F.col("score").alias("y")), ["code", "t"])
    one = both.groupBy("t").agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("n"), correlation(F.col("x"), F.col("y")).alias("c")).where(F.col("n") >= least)
    return one.agg(F.coalesce(F.avg("c"), F.lit(0.0))).first()[0]
