import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.plans import backtest, evaluate, search, study, universe
from tessera.sources import files, ticks
from tessera.streaming.bars import streaming_bars, streaming_ema


def test_minute_grid():
    assert len(ticks.minute_grid()) == len(ticks.minute_grid(False)) == 237
    assert ticks.minute_grid()[0] == 931 and ticks.minute_grid()[-1] == 1457 and ticks.minute_grid(False)[0] == 930


def test_as_of_takes_the_row_at_the_same_moment(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "code string, ts int, id int")
    right = spark.createDataFrame([("a", 5, 50.0), ("a", 3, 30.0), ("b", 10, 1.0)], "code string, ts int, q double")
    out = {r.id: r.q for r in ticks.as_of(left, right, "code", "ts", "q").collect()}
    assert out == {1: 50.0, 2: None, 3: None}


def test_collapse_conventions_differ(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, None, 3.0)], "code string, seq_num int, p double, v double")
    assert ticks.collapsed(rows, "code").first()["p"] == 1.0
    assert ticks.collapsed(rows, "code", skip_missing=False).first()["p"] is None


def test_backtest_invariants(spark):
    rng = np.random.default_rng(0)
    rows = [(f"{c:06d}", t, float(20 + 5 * rng.random()), 1e9, 0.0, float(rng.random())) for c in range(8) for t in range(30)]
    rows[10] = (*rows[10][:2], None, *rows[10][3:])
    frame = spark.createDataFrame(rows, "code string, t int, price double, limit_up double, limit_down double, score double")
    out = backtest.simulated(frame.drop("score"), backtest.targets(frame.select("code", "t", "score"), (3,), (3,), 2), backtest.Costs(capital=100_000.0)).toPandas()
    assert set(out.strategy) == {"top_3", "tail_3", "group_1", "group_2"}
    assert (out.cash >= 0).all() and (out.nav > 0).all() and (out.groupby("strategy").t.is_monotonic_increasing).all()


def test_backtest_needs_only_rows_it_may_hold(spark):
    """The same days as a fold over all prices of all codes that a strategy ever wants."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(8)
    rows = [(f"c{i}", t, None if rng.random() < 0.1 else round(float(rng.uniform(5, 15)), 2), 15.0, 5.0) for i in range(12) for t in range(30)]
    rows = [(c, t, x if x is None or rng.random() > 0.15 else 5.0, hi, lo) for c, t, x, hi, lo in rows]
    prices = spark.createDataFrame(rows, "code string, t int, price double, limit_up double, limit_down double")
    scores = spark.createDataFrame([(c, t, float(rng.normal())) for c, t, *_ in rows if t % 4 != 3], "code string, t int, score double")
    wanted = backtest.targets(scores, (3,), (2,), 2)
    costs = backtest.Costs(capital=50_000.0)
    out = backtest.simulated(prices, wanted, costs).toPandas().sort_values(["strategy", "t"]).reset_index(drop=True)
    every = prices.toPandas().merge(wanted.toPandas().assign(want=True), on=["t", "code"], how="left")
    whole = []
    for name in sorted(out.strategy.unique()):
        own = wanted.where(f"strategy = '{name}'").select("code").distinct().toPandas().code
        frame = prices.toPandas()[lambda f, own=own: f.code.isin(own)].assign(strategy=name).merge(every.loc[every.strategy == name, ["t", "code", "want"]], on=["t", "code"], how="left")
        whole.append(backtest.fold(frame, costs))
    want = pd.concat(whole).reset_index(drop=True)
    assert len(out) == len(want) and np.allclose(out.drop(columns="strategy").astype(float), want.drop(columns="strategy").astype(float))


def test_backtest_limits_and_lots():
    def day(t, price, up=None, down=None, want=True):
        return ("s", t, "a", price, up, down, want)

    frame = pd.DataFrame([day(0, 10.0, 11.0, 9.0), day(1, 9.0, 10.0, 9.0, None), day(2, 9.5, 10.0, 8.0, None), day(3, 10.0, 10.0, 8.0), day(4, 5000.0, 6000.0, 1.0)], columns=["strategy", "t", "code", "price", "limit_up", "limit_down", "want"])
    out = backtest.fold(frame, backtest.Costs(capital=10_000.0))
    assert out.bought.tolist() == [1, 0, 0, 0, 0] and out.sold.tolist() == [0, 0, 1, 0, 0]
    assert out.delayed.tolist() == [0, 1, 0, 0, 0] and out.skipped.tolist() == [0, 0, 0, 1, 1]  # at the limit; too dear for a lot


def test_two_way_effects_of_an_unbalanced_panel(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{i}", j, i * 1.0 + j * 0.5 + 2.0 * (x := float(rng.normal())) + float(rng.normal()) * 0.1, x) for i in range(12) for j in range(10) if rng.random() > 0.2]
    frame = spark.createDataFrame(rows, "code string, trade_date int, y double, x double")
    found = study.two_way(frame, "y", ["x"], cluster="both")
    d = pd.DataFrame(rows, columns=["c", "t", "y", "x"])
    design = np.column_stack([d.x, pd.get_dummies(d.c).to_numpy(float), pd.get_dummies(d.t).to_numpy(float)[:, 1:]])
    assert found["x"]["coef"] == pytest.approx(np.linalg.lstsq(design, d.y, rcond=None)[0][0], abs=1e-6)


def test_average_ranks(spark):
    rows = spark.createDataFrame([("d", v) for v in (1.0, 2.0, 2.0, 3.0, None)], "g string, x double")
    assert sorted(r.k for r in rows.withColumn("k", evaluate.average_rank("x", "g")).where("x is not null").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_chosen_models():
    assert evaluate.chosen({"a": 0.5, "b": 0.4, "c": 0.3, "d": -1}, {("a", "b"): 0.9, ("a", "c"): 0.2}) == ["a", "c"]


def test_waterfall_counts_every_row_once(spark):
    rows = spark.createDataFrame([("1", 0, 5.0), ("2", 0, None), ("3", 0, 0.0)], "code string, t int, price double").withColumn("trade_date", F.lit("2020-01-01").cast("date"))
    out = universe.waterfall(universe.judged(rows, prefixes=())).first()
    assert out.total == 3 and out.kept == 1 and out.no_price == 2


def test_search_is_seeded_and_typed(spark):
    space = search.Space.of(("close", "volume"))
    trees = [search.Trees(space, 3).tree(4) for _ in range(2)]
    assert str(trees[0]) == str(trees[1])
    from tessera.plans.expression import parse

    maker = search.Trees(space, 1)
    for _ in range(60):
        a, b = maker.tree(4), maker.tree(3)
        for t in (a, maker.mutated(a, 4), *maker.crossed(a, b, 5)):
            assert parse(str(t)).depth <= 5


def test_fronts_and_survivors():
    people = [search.Individual(search.Node("field", n), dict.fromkeys(search.OBJECTIVES, v)) for n, v in (("a", 1.0), ("b", 0.5), ("c", 0.7))]
    assert [[str(p.tree) for p in f] for f in search.fronts(people)] == [["a"], ["c"], ["b"]]
    assert [str(p.tree) for p in search.survivors(people, 2)] == ["a", "c"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k % 2, (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=17 * k)).to_pydatetime(), float(k % 7), 1.0) for k in range(60)]
    frame = spark.createDataFrame(rows, "code long, ts timestamp, price double, volume double")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = streaming_bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars").start()
    query.processAllAvailable()
    query.stop()
    batch = ticks.ohlcv(frame, "1 minute").select("code", "ts", "open", "high", "low", "close", "volume", "n")
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, batch.collect()))
    query = streaming_ema(stream, 0.5).writeStream.outputMode("update").format("memory").queryName("ema").start()
    query.processAllAvailable()
    query.stop()
    from tessera.factors.recursion import ewm

    want = {c: ewm(np.array([r[2] for r in rows if r[0] == c]), 0.5)[-1] for c in (0, 1)}
    assert {r.code: r.ema for r in spark.table("ema").collect()} == pytest.approx(want)


def test_feather_wide_and_partitions(spark, tmp_path):
    import pyarrow.feather

    wide = pd.DataFrame({"TRADE_DATE": pd.to_datetime(["2024-01-02", "2024-01-03"]), "1": [1.25, 2.5], "000002": [3.75, 4.0]})
    pyarrow.feather.write_feather(wide, str(tmp_path / "20240102.fea"))
    (tmp_path / "broken.fea").write_bytes(b"nothing")
    frame = files.read_feather(spark, str(tmp_path / "2024*.fea"))
    long = files.long_from_wide(frame, "CLOSE_PRICE")
    assert {(str(r.trade_date), r.code): r.CLOSE_PRICE for r in long.collect()} == {("2024-01-02", "000001"): 1.25, ("2024-01-03", "000001"): 2.5, ("2024-01-02", "000002"): 3.75, ("2024-01-03", "000002"): 4.0}
    assert files.unreadable(str(tmp_path / "*.fea")) == [str(tmp_path / "broken.fea")]
    files.write_partitioned(long, str(tmp_path / "out"), "trade_date", sort=("code",))
    back = files.between(spark.read.parquet(str(tmp_path / "out")), "2024-01-03", None)
    assert back.count() == 2 and files.calendar(back).count() == 1
    single = files.wide_from_long(long, "CLOSE_PRICE", ["000001", "000002"], single=True)
    assert dict(single.dtypes)["000001"] == "float" and [r["000002"] for r in single.collect()] == [3.75, 4.0]


def test_day_prices(spark):
    from tessera.plans import labels

    rows = [("d1", "a", 930, 1.0, 2.0, 10.0, 15.0), ("d1", "b", 931, 5.0, 6.0, 10.0, 55.0), ("d2", "a", 931, 7.0, 8.0, 10.0, 75.0), ("d2", "b", 1501, 9.0, 9.0, 1.0, 9.0)]
    frame = spark.createDataFrame(rows, "trade_date string, code string, minute int, open double, close double, volume double, amount double")
    price = lambda out: {(r.trade_date, r.code): r.price for r in out.collect()}
    assert price(labels.open_at(frame, 930, 931)) == {("d1", "a"): 1.0, ("d2", "a"): 7.0}
    assert price(labels.day_prices(frame, 930, 1500, "vwap")) == {("d1", "a"): 1.5, ("d1", "b"): 5.5, ("d2", "a"): 7.5}
    assert price(labels.day_prices(frame, 930, 1500)) == {("d1", "a"): 2.0, ("d1", "b"): 6.0, ("d2", "a"): 8.0}
    assert labels.day_volume(frame).agg(F.sum("volume")).first()[0] == 30.0


def test_search_helpers(spark):
    days = list(range(20))
    assert all(b - a == 4 and 0 <= a < 15 for a, b in search.date_windows(days, 5, 50, seed=3)) and search.date_windows(days, 30) == [(0, 19)]
    assert search.novelty_score(0.07, -0.07, []) == pytest.approx(0.02) and search.novelty_score(0.0, 0.0, [0.5, -0.5]) == pytest.approx(-0.2)
    assert search.novelty_score(0, 0, [], [[1, 2, 3, 4, 5], [0, 2, 6, 4, 0]]) == pytest.approx((1 + 0 + 0 + 0 + 1) / 7)
    rows = [(f"c{i:02d}", t, float(i + t % 3), float((i * 7 + t) % 5), float(i)) for i in range(12) for t in range(6)]
    panel = spark.createDataFrame(rows, "code string, t int, good double, noise double, label double")
    assert [f for f, _ in search.screened(panel, ["noise", "good"])] == ["good", "noise"]
    one = search.Individual(search.Node("field", "good"), {"ic": 0.5})
    told = search.summary([[], [one, one]])
    assert told[0]["n"] == 0 and (told[1]["n"], told[1]["different"], told[1]["best"], told[1]["expression"]) == (2, 1, 0.5, "good")


def test_factor_report_and_even_groups(spark):
    rows = [("f", f"2024-01-{d:02d}", f"c{i:02d}", float(i), float(i) / 100) for d in range(1, 5) for i in range(23)]
    scores = spark.createDataFrame(rows, "factor string, trade_date string, code string, score double, label double").withColumn("trade_date", F.col("trade_date").cast("date"))
    sizes = {r.group: r.n for r in evaluate.even_groups(scores, 5, "factor", "trade_date").where("trade_date = '2024-01-01'").collect()}
    assert sizes == {1: 4, 2: 4, 3: 4, 4: 4, 5: 7}  # what remains is in the last
    out = evaluate.factor_report(scores, {"all": (None, None)}, groups=5).where("metric = 'ic'").collect()
    assert len(out) == 1 and out[0].mean == pytest.approx(1.0) and out[0].spread_days == 4 and out[0].spread_mean == pytest.approx(0.19 - 0.015)
    assert evaluate.even_groups(scores, 12, "factor", "trade_date").count() == 0  # fewer than two rows a group


def test_files_of_other_shapes(spark, tmp_path):
    import pandas as pd

    from tessera.sources import files

    wide = pd.DataFrame({"1": [1.25, None], "000002": [3.75, 4.0]}, index=pd.DatetimeIndex(["2024-01-02", "2024-01-03"]))
    wide.to_pickle(tmp_path / "CLOSE.pkl")
    out = {(str(r.trade_date), r.code): r.close for r in files.read_pickled(spark, f"file://{tmp_path}/*.pkl", "close").collect()}
    assert out == {("2024-01-02", "000001"): 1.25, ("2024-01-02", "000002"): 3.75, ("2024-01-03", "000002"): 4.0}
    for code in ("600000", "600001"):
        pd.DataFrame({"Price": [0, 2, 3], "vol": [0, 5, 6]}).to_feather(tmp_path / f"{code}.fea")
    rows = files.read_stock_files(spark, f"file://{tmp_path}/*.fea", "code string, price double, vol long", {"Price": "price"}, skip=1).orderBy("code", "price").collect()
    assert [tuple(r) for r in rows] == [("600000", 2.0, 5), ("600000", 3.0, 6), ("600001", 2.0, 5), ("600001", 3.0, 6)]
    a, b = spark.createDataFrame([("x", 1, 2)], "code string, p int, q int"), spark.createDataFrame([("x", 9, 3), ("y", 8, 4)], "code string, p int, r int")
    assert sorted(map(tuple, files.merged([a, b]).collect())) == [("x", 1, 2, 3), ("y", None, None, 4)]
    a.write.parquet(f"{tmp_path}/own.parquet")
    files.register_tables(spark, f"file://{tmp_path}", "own")
    assert spark.sql("SELECT sum(p) AS s FROM own").first().s == 1
