import pytest

from tessera.operators import OPERATORS
from tessera.plans.expression import build, evaluate, parse, shared
from tessera.plans.layers import Panel


def panel(spark, rows=None):
    rows = rows or [(c, t, float(10 + t + 3 * k) if (c, t) != ("b", 3) else None, float(1 + (t * (k + 2)) % 5)) for k, c in enumerate("abc") for t in range(12)]
    return spark.createDataFrame(rows, "code string, t int, x double, y double")


def test_parse_and_text():
    tree = parse("cs_rank(ts_mean(ts_return(close, 1), 5))")
    assert str(tree) == "cs_rank(ts_mean(ts_return(close, 1), 5))"
    assert tree.fields == {"close"} and tree.depth == 4 and tree.causal
    assert str(parse("-close / (open + 2)")) == "div(neg(close), add(open, 2))"
    assert not parse("ts_shift(close, 1)").causal


@pytest.mark.parametrize("text", ["ts_mean(", "no_such(close)", "ts_mean(close)", "ts_mean(close, 5, 6, 7)", "close.real", "ts_corr(close, 5)", "[1]"])
def test_bad_expressions_are_refused(text):
    with pytest.raises(ValueError):
        parse(text)


def test_unknown_field(spark):
    with pytest.raises(KeyError):
        evaluate(panel(spark), {"o": "ts_mean(nothing, 3)"})


def test_equal_subtrees_are_one(spark):
    p = Panel(panel(spark))
    a, b = build(p, parse("ts_mean(x, 3)")), build(p, parse("add(ts_mean(x, 3), y)"))
    assert a is build(p, parse("ts_mean(x, 3)")) and b is not a
    assert shared([parse("ts_mean(x, 3)"), parse("add(ts_mean(x, 3), y)")]) == {"ts_mean(x, 3)": 2}


def test_one_exchange_serves_all_windows_of_a_code(spark, capsys):
    evaluate(panel(spark), {"a": "ts_mean(ts_delta(x, 1), 3)", "b": "ts_corr(x, y, 4)", "c": "ts_max(y, 5)"}).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(code") == 1 and "Python" not in plan


CAUSAL = sorted(n for n, o in OPERATORS.items() if o.causal and not o.grouped and o.kinds in ("vd", "vvd", "v", "vv", "vdqq", "vvdqq"))


def test_nothing_causal_looks_ahead(spark):
    """Rows up to a cut are the same whether later rows are there or not."""
    rows = [(c, t, float((7 * t + 5 * k * k) % 11) - 3.5, float((3 * t * t + k) % 7) + 1) for k, c in enumerate("abcd") for t in range(14)]
    arguments = {"v": ["x"], "vv": ["x", "y"], "vd": ["x", "4"], "vvd": ["x", "y", "4"], "vdqq": ["x", "4", "0.3", "0.7"], "vvdqq": ["x", "y", "4", "0.3", "0.7"]}
    named = {f"o{i}": f"{n}({', '.join(arguments[OPERATORS[n].kinds])})" for i, n in enumerate(CAUSAL) if n not in ("loop_max_min", "sort_by_another", "get_nan_tensor")}
    names = list(named)
    for k in range(0, len(names), 30):
        part = {n: named[n] for n in names[k : k + 30]}
        whole = {(r.code, r.t): r for r in evaluate(panel(spark, rows), part).collect() if r.t < 10}
        cut = {(r.code, r.t): r for r in evaluate(panel(spark, [r for r in rows if r[1] < 10]), part).collect()}
        for key, row in cut.items():
            for n in part:
                a, b = row[n], whole[key][n]
                assert a == b or isinstance(a, float) and a == pytest.approx(b, rel=1e-9, abs=1e-12), part[n]


def test_constant_missing_and_short_windows(spark):
    rows = [("a", t, 5.0, None) for t in range(4)] + [("b", t, float(t), 1.0 if t else None) for t in range(4)]
    out = {(r.code, r.t): r for r in evaluate(panel(spark, rows), {"corr": "ts_corr(x, y, 3)", "z": "ts_zscore(x, 3)", "m": "ts_mean(y, 3)", "s": "ts_sum(y, 3)", "d": "div(x, sub(x, x))", "long": "ts_mean(x, 9)"}).collect()}
    assert out["a", 3].corr is None and out["a", 3].z is None and out["a", 3].m is None and out["a", 3].s == 0.0
    assert out["b", 1].m is None and out["b", 2].m == 1.0 and out["b", 3].d is None and all(r.long is None for r in out.values())


def test_nan_and_infinity_become_null(spark):
    rows = [("a", 0, float("nan"), 1.0), ("a", 1, float("inf"), 2.0), ("a", 2, 800.0, 3.0)]
    out = evaluate(panel(spark, rows), {"x": "add(x, 0)", "e": "exp(x)"}).orderBy("t").collect()
    assert [r.x for r in out] == [None, None, 800.0] and [r.e for r in out] == [None] * 3
