import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.factors import registry
from tessera.plans import models
from tessera.sources.panel import month_panel


def panel(spark):
    rng = np.random.default_rng(0)
    rows = [(f"{c:06d}", t, t // 4, float(a := rng.normal()), float(b := rng.normal()), float(2 * a - b + rng.normal() * 0.1)) for c in range(12) for t in range(16)]
    return spark.createDataFrame(rows, "code string, trade_date int, fold int, a double, b double, label double")


def test_folds_never_see_themselves(spark):
    frame = panel(spark)
    found = models.rolling(frame, ["a", "b"], [0, 1, 2, 3])
    scores = models.out_of_fold(found, frame, ["a", "b"], "trade_date", "code")
    assert scores.count() == frame.count()
    joined = scores.join(frame, ["trade_date", "code"])
    assert joined.stat.corr("score", "label") > 0.98
    weight = models.importance(found, ["a", "b"])
    assert weight["a"] == pytest.approx(2, abs=0.1) and weight["b"] == pytest.approx(1, abs=0.1)
    assert models.wpcc(joined).agg(F.min("wpcc")).first()[0] > 0.8
    assert models.nearest_ensemble(found, frame, ["a", "b"]).count() == frame.count()


def test_similarity(spark):
    frame = panel(spark).select("code", F.col("trade_date").alias("t"), F.col("a").alias("score"))
    assert models.similarity(frame, frame.withColumn("score", -F.col("score"))) == pytest.approx(-1)
    assert models.similarity(frame, frame.withColumn("score", F.lit(1.0))) == 0.0


def test_registry(spark, data):
    frame = month_panel(spark, data)
    out = registry.compute_all(frame)
    assert set(out.columns) == {"code", "t", *registry.REGISTRY}
    now = registry.compute_all(frame, ["momentum_20d"], known_before=False)
    pair = out.select("code", "t", F.col("momentum_20d").alias("m")).join(now.withColumn("t", F.col("t") + 1), ["code", "t"])
    assert pair.where("not (m <=> momentum_20d)").count() == 0
    assert registry.cr_family(frame).where("CR2 < 0").count() == 0
    with pytest.raises(ValueError):
        registry.factor("momentum_20d")(lambda: F.lit(0))


def test_simulated_similarity_and_field_correlations(spark):
    from tessera.plans import search
    from tessera.plans.evaluate import field_correlations
    from tessera.plans.expression import parse

    a, b = parse("ts_mean(x, 3)"), parse("add(ts_mean(x, 3), mul_element_wise(y, 0.001))")
    assert search.simulated_similarity(spark, a, b, rows=20, codes=20) > 0.99
    joined = search.random_panel(spark, ["x", "y", "z"], 40, 50, correlation=[[1, 0.9, 0], [0.9, 1, 0], [0, 0, 1]])
    found = {(r.a, r.b): r.correlation for r in field_correlations(joined, ["x", "y", "z"]).collect()}
    assert found["x", "y"] > 0.8 and abs(found["x", "z"]) < 0.15 and len(found) == 3
