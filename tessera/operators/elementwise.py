"""Operators on each cell. A result outside the reals is NULL; an operator of NULL is NULL unless it says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalar import EPS, both, erf, finite, ratio
from tessera.operators.registry import OPERATORS, operator
from tessera.plans.layers import Panel, Value


def _each(kinds: str, *names: str, search: bool = True, causal: bool = True):
    """An operator from a function of columns and numbers: values come first, numbers behind."""

    def register(f):
        n = kinds.lower().count("v")

        def make(p: Panel, *args):
            return p.each(lambda *c: f(*c, *args[n:]), *args[:n])

        make.__doc__ = f.__doc__
        for name in names:
            operator(kinds, name, search=search, causal=causal)(make)
        return f

    return register


def true(x: Column) -> Column:
    """A number as a truth value: NULL and 0 are false."""
    return F.coalesce(x.cast("double") != 0, F.lit(False))


def power(x: Column, e: float) -> Column:
    return finite(F.pow(F.abs(x) if e <= 1 else x, F.lit(float(e))))


def log(x: Column) -> Column:
    return F.when(F.abs(x) > EPS, F.log(F.abs(x)))


_each("vv", "add")(lambda x, y: finite(x + y))
_each("vv", "sub")(lambda x, y: finite(x - y))
_each("vv", "mul")(lambda x, y: finite(x * y))
_each("vv", "div")(ratio)
_each("vv", "Max", "max")(lambda x, y: both(x, y, F.greatest(x, y)))
_each("vv", "Min", "min")(lambda x, y: both(x, y, F.least(x, y)))
_each("v", "Abs", "abs")(F.abs)
_each("v", "neg")(F.negative)
_each("v", "inv")(lambda x: ratio(F.lit(1.0), x))
_each("v", "sqrt")(lambda x: F.sqrt(F.abs(x)))
_each("v", "log")(log)
_each("ve", "Pow", "pow")(power)
_each("v", "exp", search=False)(lambda x: finite(F.exp(x)))
_each("ve", "nentexpo", search=False)(lambda x, e: finite(F.pow(F.lit(float(e)), x)))
_each("vv", "pow_xy", search=False)(lambda x, y: finite(F.pow(x, y)))
_each("v", "sigmoid")(lambda x: 1 / (1 + F.exp(-x)))
_each("v", "erf")(erf)
_each("v", "arctan")(F.atan)
_each("v", "sign")(F.signum)
_each("v", "sign_square", search=False)(lambda x: F.signum(x) * x * x)
_each("v", "indicator")(lambda x: F.coalesce((x > 0).cast("double"), F.lit(0.0)))
_each("v", "taylor_log_diff")(lambda x: 2 * (F.abs(x) - 1 - log(x)) - log(x) * log(x))
_each("v", "taylor_exp_diff")(lambda x: finite(2 * (F.exp(x) - 1 - x) - x * x))
_each("vn", "ceil_scale")(lambda x, n: F.ceil(x * n) / F.lit(float(n)))
_each("vn", "floor_scale")(lambda x, n: F.floor(x * n) / F.lit(float(n)))
_each("vn", "round_zero_scale")(lambda x, n: F.signum(x) * F.floor(F.abs(x) * n) / F.lit(float(n)))
_each("vn", "mul_element_wise", search=False)(lambda x, k: x * F.lit(float(k)))
_each("ve", "boxcox")(lambda x, lam: F.when(x > 0, F.log(x)) if lam == 0 else finite((F.pow(x, F.lit(float(lam))) - 1) / lam))
_each("vNN", "normal_log_prob")(lambda x, loc=0.0, scale=1.0: -F.pow((x - loc) / scale, F.lit(2)) / 2 - math.log(scale) - 0.5 * math.log(2 * math.pi))
_each("vNN", "normal_cdf")(lambda x, loc=0.0, scale=1.0: 0.5 * (1 + erf(x / math.sqrt(2))))


@_each("vN", "studentT_log_prob", search=False)
def _(x: Column, df: float = 5) -> Column:
    """The log-density of Student's t."""
    constant = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return F.lit(constant) - (df + 1) / 2 * F.log1p(x * x / df)


@_each("vn", "t_cdf", search=False)
def t_cdf(x: Column, df: float) -> Column:
    """Student's t distribution function for whole df, by its finite trigonometric series (Abramowitz and Stegun 26.7.3 and 26.7.4)."""
    df = int(df)
    theta = F.atan(x / math.sqrt(df))
    c = F.cos(theta)
    if df == 1:
        area = 2 / math.pi * theta
    else:
        term, series = (c, c) if df % 2 else (F.lit(1.0), F.lit(1.0))
        for k in range(3 if df % 2 else 2, df, 2):
            term = term * c * c * (k - 1) / k
            series = series + term
        area = 2 / math.pi * (theta + F.sin(theta) * series) if df % 2 else F.sin(theta) * series
    return (1 + area) / 2


_each("vn", "is_gt", search=False)(lambda x, v: x > F.lit(float(v)))
_each("vn", "is_lt", search=False)(lambda x, v: x < F.lit(float(v)))
_each("v", "is_zero")(lambda x: F.nullif(x, F.lit(0.0)))
_each("vv", "bool_and2", search=False)(lambda a, b: a.cast("boolean") & b.cast("boolean"))
_each("vv", "bool_or2", search=False)(lambda a, b: a.cast("boolean") | b.cast("boolean"))
_each("vv", "logical_and", search=False)(lambda a, b: true(a) & true(b))
_each("vv", "logical_or", search=False)(lambda a, b: true(a) | true(b))
_each("v", "logical_not", search=False)(lambda a: ~true(a))
_each("vv", "logical_xor", search=False)(lambda a, b: true(a) != true(b))
_each("vv", "filt_cond", search=False)(lambda x, cond: F.when(true(cond), x))
_each("vvv", "fill_xy_cond", search=False)(lambda cond, x, y: F.when(true(cond), x).otherwise(y))
_each("vvv", "question_xn0", search=False)(lambda x, y, z: F.when(x > 0, y).otherwise(z))
_each("vvv", "question_xisnot0", search=False)(lambda x, y, z: F.when(F.coalesce(x != 0, F.lit(True)), y).otherwise(z))
_each("vvv", "question_xm0", search=False)(lambda x, y, z: F.when(x < 0, y).otherwise(z))
_each("vvvv", "question_xmy", search=False)(lambda x, y, z, w: F.when(x > y, z).otherwise(w))
_each("vvvv", "question_xisy", search=False)(lambda x, y, z, w: F.when(x == y, z).otherwise(w))
_each("vv", "reverse_cond", search=False)(lambda x, cond: F.when(true(cond), x).otherwise(-x))
_each("vn", "fillna", search=False)(lambda x, v: F.coalesce(finite(x), F.lit(float(v))))
_each("vvN", "approx_eq", search=False)(lambda x, y, eps=EPS: F.coalesce(x.eqNullSafe(y) | (F.abs(x - y) < eps), F.lit(False)))
_each("vvvvvN", "compare_and_return")(lambda a, b, c, d, e, eps=EPS: both(a, b, F.when(F.abs(a - b) <= eps, d).when(a > b, c).otherwise(e)))
_each("vn", "create_like", "get_e_tensor", search=False)(lambda x, v: F.lit(float(v)))
_each("v", "get_nan_tensor", search=False)(lambda x: F.lit(None).cast("double"))
_each("vnnn", "bucket", search=False)(lambda x, start, end, step: F.when((x >= start) & (x < end), F.floor((x - start) / step) + 1).cast("double"))


@operator("vvV")
def logical_and_n(p: Panel, *values: Value) -> Value:
    """True where all of any number of values are."""

    def every(*c: Column) -> Column:
        out = true(c[0])
        for x in c[1:]:
            out = out & true(x)
        return out

    return p.each(every, *values)


@operator("v", search=True)
def is_nan(p: Panel, x: Value) -> Value:
    """Missing cells become 0 after the first day of 237 minutes."""
    return p.each(lambda c: F.when(F.col("t") >= 237, F.coalesce(c, F.lit(0.0))).otherwise(c), x)


@operator("vv", search=True)
def VOI_B(p: Panel, x: Value, y: Value) -> Value:
    """Volume x at bid y: its change where y is the same, x where y falls, 0 where it rises."""
    return p.over(lambda a, b: F.when(b == F.lag(b).over(p.history), a - F.lag(a).over(p.history)).when(F.lag(b).over(p.history) > b, a).when(F.lag(b).over(p.history) < b, 0.0), x, y)


@operator("vv", search=True)
def VOI_S(p: Panel, x: Value, y: Value) -> Value:
    """Volume x at ask y: its change where y is the same, x where y rises, 0 where it falls."""
    return p.over(lambda a, b: F.when(b == F.lag(b).over(p.history), a - F.lag(a).over(p.history)).when(F.lag(b).over(p.history) < b, a).when(F.lag(b).over(p.history) > b, 0.0), x, y)


@operator("vQ", causal=False)
def fill_with_quantile(p: Panel, x: Value, q: float = 0.8) -> Value:
    """The q-quantile of the whole panel in every cell: a broadcast of one row."""
    return p.whole(lambda c: F.percentile(c, F.lit(float(q))), x)


assert OPERATORS
