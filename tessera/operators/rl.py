"""The second operator set, for step-by-step expressions: 6 binary operations and 71 transforms, with conventions of their own.

They differ from the operators of the same names in ``tessera.operators``: small constants in divisors,
ranks from 0, sample deviations across codes, infinities of empty windows. ``transforms()`` is the fixed list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions.scalar import both, ratio
from tessera.operators.elementwise import log
from tessera.plans.layers import Panel, Value

TINY = 1e-9
WINDOWS = (5, 10, 20, 40, 60)

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda x, y: x + y,
    "sub": lambda x, y: x - y,
    "mul": lambda x, y: x * y,
    "div": ratio,
    "max": lambda x, y: both(x, y, F.greatest(x, y)),
    "min": lambda x, y: both(x, y, F.least(x, y)),
}

UNARY: dict[str, Callable[[Panel, Value], Value]] = {
    "abs": lambda p, x: p.each(F.abs, x),
    "neg": lambda p, x: p.each(F.negative, x),
    "sqrt": lambda p, x: p.each(lambda c: F.sqrt(F.abs(c)), x),
    "log": lambda p, x: p.each(log, x),
    "sign": lambda p, x: p.each(F.signum, x),
    "inv": lambda p, x: p.each(lambda c: ratio(F.lit(1.0), c), x),
    "sigmoid": lambda p, x: p.each(lambda c: 1 / (1 + F.exp(-c)), x),
    "identity": lambda p, x: x,
    # ranks start at the number of missing codes: a missing code counts as the smallest
    "cs_rank": lambda p, x: p.over(lambda c: F.when(c.isNotNull(), F.row_number().over(p.across.orderBy(c.asc_nulls_first(), "code")) / F.count(c).over(p.across)), x),
    "cs_demean": lambda p, x: p.over(lambda c: c - F.avg(c).over(p.across), x),
    # the deviation of a row index with a missing code is missing
    "cs_normalize": lambda p, x: p.over(lambda c: F.when(F.count(c).over(p.across) == F.count(F.lit(1)).over(p.across), (c - F.avg(c).over(p.across)) / F.greatest(F.stddev_samp(c).over(p.across), F.lit(TINY))), x),
}


def _frame(make) -> Callable[[Panel, Value, int], Value]:
    return lambda p, x, d: p.over(lambda c: p.full(d, make(c, p.last(d))), x)


def _moment(k: int) -> Callable[[Panel, Value, int], Value]:
    def build(p: Panel, x: Value, d: int) -> Value:
        (a,) = p.array(d, x)
        m2 = lambda v: F.greatest(A.moment(v, 2), F.lit(TINY))
        out = (lambda v: A.moment(v, 3) / (F.pow(m2(v), F.lit(1.5)) + TINY)) if k == 3 else (lambda v: A.moment(v, 4) / (m2(v) * m2(v) + TINY) - 3)
        return p.each(lambda v: p.full(d, out(v)), a)

    return build


def _decay(p: Panel, x: Value, d: int) -> Value:
    def make(c: Column) -> Column:
        terms = [F.coalesce(F.lag(c, k).over(p.history) if k else c, F.lit(0.0)) * (2 * (d - k) / (d * (d + 1))) for k in range(d)]
        return p.full(d, sum(terms[1:], terms[0]))

    return p.over(make, x)


def _rank(p: Panel, x: Value, d: int) -> Value:
    """How many values of the window are strictly smaller, over those present."""
    (a,) = p.array(d, x)
    return p.each(lambda v: p.full(d, F.when(A.last(v).isNotNull(), F.size(F.filter(v, lambda e: e < A.last(v))) / F.greatest(A.count(v), F.lit(1.0)))), a)


ROLLING: dict[str, Callable[[Panel, Value, int], Value]] = {
    "ts_mean": _frame(lambda c, w: F.avg(c).over(w)),
    "ts_sum": _frame(lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0.0))),
    "ts_stddev": _frame(lambda c, w: F.sqrt(F.var_pop(c).over(w) + TINY)),
    "ts_rank": _rank,
    "ts_delay": lambda p, x, d: p.over(lambda c: F.lag(c, d).over(p.history), x),
    "ts_delta": lambda p, x, d: p.over(lambda c: c - F.lag(c, d).over(p.history), x),
    "ts_min": _frame(lambda c, w: F.coalesce(F.min(c).over(w), F.lit(float("inf")))),
    "ts_max": _frame(lambda c, w: F.coalesce(F.max(c).over(w), F.lit(float("-inf")))),
    "ts_skew": _moment(3),
    "ts_kurt": _moment(4),
    "ts_decay_linear": _decay,
    "ts_zscore": _frame(lambda c, w: (c - F.avg(c).over(w)) / F.greatest(F.stddev_pop(c).over(w), F.lit(TINY))),
}


def ts_corr(p: Panel, x: Value, y: Value, d: int) -> Value:
    """Correlation with small constants in the divisor, a missing cell counting as its window's mean; not a transform."""
    a, b = (p.flat(Value(A.demeaned(v.column), True, v.depth)) for v in p.array(d, x, y))
    size = lambda v: F.sqrt(F.greatest(A.total(F.transform(v, lambda e: e * e)), F.lit(TINY)))
    return p.each(lambda m, n: p.full(d, A.total(F.zip_with(m, n, lambda u, v: u * v)) / (size(m) * size(n) + TINY)), a, b)


def transforms() -> list[str]:
    """The 71 transforms in order: unary ones, then each rolling one with each window."""
    return [*UNARY, *(f"{name}_{d}" for name in ROLLING for d in WINDOWS)]


def transformed(p: Panel, name: str, x: Value) -> Value:
    if name in UNARY:
        return UNARY[name](p, x)
    base, _, d = name.rpartition("_")
    return ROLLING[base](p, x, int(d))


def step_by_step(p: Panel, text: str) -> Value:
    """``temp=ts_mean_5(close);temp=add(temp,cs_rank(volume))``: each step applies a binary operation to temp and a transformed field."""
    temp: Value | None = None
    for step in filter(None, (s.strip() for s in text.split(";"))):
        target, _, body = step.partition("=")
        if target.strip() != "temp" or not body:
            raise ValueError(f"not a step: {step!r}")
        body = body.strip()
        if body.split("(")[0] in BINARY and "," in body:
            op, _, inner = body.partition("(")
            left, _, right = inner[:-1].partition(",")
            if left.strip() != "temp" or temp is None:
                raise ValueError(f"a step combines temp with a transform: {step!r}")
            temp = p.each(BINARY[op], temp, _term(p, right.strip()))
        else:
            temp = _term(p, body)
    if temp is None:
        raise ValueError("no steps")
    return temp


def _term(p: Panel, text: str) -> Value:
    if "(" not in text:
        return p.field(text)
    name, _, inner = text.partition("(")
    return transformed(p, name.strip(), p.field(inner.rstrip(")").strip()))
