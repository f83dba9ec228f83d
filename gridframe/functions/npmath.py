"""NumPy's elementwise functions as Spark expressions with NumPy's results.

Every function takes columns (or numbers) and returns a column. Where Spark
raises, gives NULL, truncates or orders NaN otherwise than NumPy, the expression
carries the guard. A few functions without a Spark counterpart run as Arrow-fed
pandas functions; they are marked so in PYTHON_BACKED.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

INF, NAN = float("inf"), float("nan")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x.item() if isinstance(x, np.generic) else x)


def dbl(x) -> Column:
    return col(x).cast("double")


def nan() -> Column:
    return F.lit(NAN)


def inf(sign: int = 1) -> Column:
    return F.lit(sign * INF)


# Arithmetic


def add(a, b) -> Column:
    return col(a) + col(b)


def subtract(a, b) -> Column:
    return col(a) - col(b)


def multiply(a, b) -> Column:
    return col(a) * col(b)


def divide(a, b) -> Column:
    a, b = dbl(a), dbl(b)
    by_zero = F.when(F.isnan(a) | (a == 0), nan()).otherwise(F.when((a > 0) != signbit(b), inf()).otherwise(inf(-1)))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def floor_divide(a, b, integer: bool = False) -> Column:
    if integer:
        a, b = col(a), col(b)
        safe = F.when(b == 0, 1).otherwise(b)
        return F.when(b == 0, 0).otherwise(whole_quotient(a - mod(a, b, True), safe)).cast("long")
    a, b = dbl(a), dbl(b)
    return F.when(b == 0, divide(a, b)).when(is_inf(a), nan()).otherwise(floor(divide(a - mod(a, b), b) + F.lit(0.5)))


def whole_quotient(a: Column, b: Column) -> Column:
    """a / b where b divides a, exact for 64-bit integers."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def mod(a, b, integer: bool = False) -> Column:
    """Remainder with the divisor's sign."""
    if integer:
        a, b = col(a), col(b)
        safe = F.when(b == 0, 1).otherwise(b)
        r = a % safe
        return F.when(b == 0, 0).when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r).cast("long")
    a, b = dbl(a), dbl(b)
    safe = F.when(b == 0, 1.0).otherwise(b)
    r = a % safe
    r = F.when((b == 0) | is_inf(a), nan()).when(is_inf(b) & ~F.isnan(a), F.when((a == 0) | ((a < 0) == (b < 0)), a).otherwise(b)).otherwise(F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r))
    return r


def fmod(a, b, integer: bool = False) -> Column:
    """Remainder with the dividend's sign."""
    a, b = (col(a), col(b)) if integer else (dbl(a), dbl(b))
    if integer:
        return F.when(b == 0, 0).otherwise(a % F.when(b == 0, 1).otherwise(b)).cast("long")
    return F.when((b == 0) | is_inf(a), nan()).when(is_inf(b), a).otherwise(a % F.when(b == 0, 1.0).otherwise(b))


def divmod_(a, b, integer: bool = False) -> tuple[Column, Column]:
    return floor_divide(a, b, integer), mod(a, b, integer)


def power(a, b, integer: bool = False) -> Column:
    if integer:
        return F.pow(dbl(a), dbl(b)).cast("long")
    return F.pow(dbl(a), dbl(b))


def int_power(a, n: int) -> Column:
    """a to a fixed whole power, by exact products."""
    if n < 0:
        raise ValueError("integers to negative integer powers are not allowed")
    out, square = F.lit(1).cast("long"), col(a)
    while n:
        if n & 1:
            out = out * square
        n >>= 1
        if n:
            square = square * square
    return out


def negative(a) -> Column:
    return -col(a)


def positive(a) -> Column:
    return col(a)


def absolute(a) -> Column:
    return F.abs(col(a))


def square(a) -> Column:
    return col(a) * col(a)


def reciprocal(a, integer: bool = False) -> Column:
    if integer:
        a = col(a)
        return F.when(a == 1, 1).when(a == -1, -1).otherwise(0).cast("long")
    return divide(F.lit(1.0), a)


# Comparisons: NaN is unequal to everything, and neither less nor greater.


def _number(*xs: Column) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & ~F.isnan(dbl(x))
    return out


def less(a, b) -> Column:
    return (col(a) < col(b)) & _number(a, b)


def less_equal(a, b) -> Column:
    return (col(a) <= col(b)) & _number(a, b)


def greater(a, b) -> Column:
    return (col(a) > col(b)) & _number(a, b)


def greater_equal(a, b) -> Column:
    return (col(a) >= col(b)) & _number(a, b)


def equal(a, b) -> Column:
    return (col(a) == col(b)) & _number(a, b)


def not_equal(a, b) -> Column:
    return ~equal(a, b)


# Exponentials and logarithms


def exp2(a) -> Column:
    return F.pow(F.lit(2.0), dbl(a))


def _log(f: Callable, pole: float) -> Callable:
    def out(a) -> Column:
        a = dbl(a)
        return F.when(a == pole, inf(-1)).when(F.isnan(a) | (a < pole), nan()).otherwise(f(a))

    return out


log, log2, log10 = _log(F.log, 0.0), _log(F.log2, 0.0), _log(F.log10, 0.0)
log1p = _log(F.log1p, -1.0)


def logaddexp(a, b) -> Column:
    a, b = dbl(a), dbl(b)
    return F.when(F.isnan(a) | F.isnan(b), nan()).when(a == b, a + F.log(F.lit(2.0))).otherwise(F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))


def logaddexp2(a, b) -> Column:
    a, b = dbl(a), dbl(b)
    return F.when(F.isnan(a) | F.isnan(b), nan()).when(a == b, a + 1.0).otherwise(F.greatest(a, b) + F.log1p(exp2(-F.abs(a - b))) / F.log(F.lit(2.0)))


# Signs, extrema, rounding


def signbit(a) -> Column:
    """True for negatives and the negative zero."""
    a = dbl(a)
    return (a < 0) | ((a == 0) & a.cast("string").startswith("-"))


def sign(a) -> Column:
    return F.signum(dbl(a)) + 0.0  # of the negative zero: 0.0


def copysign(a, b) -> Column:
    return F.when(signbit(b), -F.abs(dbl(a))).otherwise(F.abs(dbl(a)))


def maximum(a, b) -> Column:
    return F.greatest(col(a), col(b))  # NaN is the greatest in Spark


def minimum(a, b) -> Column:
    return F.when(~_number(a, b), F.greatest(col(a), col(b))).otherwise(F.least(col(a), col(b)))


def fmax(a, b) -> Column:
    a, b = dbl(a), dbl(b)
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def fmin(a, b) -> Column:
    return F.least(dbl(a), dbl(b))


def clip(a, low=None, high=None) -> Column:
    if low is not None:
        a = maximum(a, low)
    return a if high is None else minimum(a, high)


def heaviside(a, at_zero) -> Column:
    a = dbl(a)
    return F.when(F.isnan(a), a).when(a < 0, 0.0).when(a > 0, 1.0).otherwise(dbl(at_zero))


def _by_whole(f: Callable) -> Callable:
    def out(a) -> Column:
        a = dbl(a)
        near = F.abs(a) < 2.0**52  # beyond, all doubles are whole
        return F.when(near, f(F.when(near, a).otherwise(0.0)).cast("double")).otherwise(a)

    return out


floor, ceil = _by_whole(F.floor), _by_whole(F.ceil)


def trunc(a) -> Column:
    a = dbl(a)
    return F.when(a < 0, ceil(a)).otherwise(floor(a))


def rint(a) -> Column:
    return F.rint(dbl(a))


def round_(a, decimals: int = 0) -> Column:
    """Half to even, as numpy does it: scaled, rounded, scaled back."""
    if decimals == 0:
        return rint(a)
    scale = 10.0 ** abs(decimals)
    return F.rint(dbl(a) * scale) / scale if decimals > 0 else F.rint(dbl(a) / scale) * scale


# Tests


def isnan(a) -> Column:
    return F.isnan(dbl(a))


def is_inf(a: Column) -> Column:
    return F.abs(a) == INF


def isinf(a) -> Column:
    return is_inf(dbl(a))


def isfinite(a) -> Column:
    return ~isnan(a) & ~isinf(a)


def isclose(a, b, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    a, b = dbl(a), dbl(b)
    near = F.when(is_inf(a) | is_inf(b), a == b).otherwise(F.abs(a - b) <= dbl(atol) + dbl(rtol) * F.abs(b))
    return F.when(F.isnan(a) | F.isnan(b), (F.isnan(a) & F.isnan(b)) if equal_nan else F.lit(False)).otherwise(near)


# Logic and bits


def truth(a) -> Column:
    return col(a).cast("double") != 0.0


def logical_and(a, b) -> Column:
    return truth(a) & truth(b)


def logical_or(a, b) -> Column:
    return truth(a) | truth(b)


def logical_xor(a, b) -> Column:
    return truth(a) != truth(b)


def logical_not(a) -> Column:
    return ~truth(a)


def bitwise_and(a, b, boolean: bool = False) -> Column:
    return (col(a) & col(b)) if boolean else col(a).bitwiseAND(col(b))


def bitwise_or(a, b, boolean: bool = False) -> Column:
    return (col(a) | col(b)) if boolean else col(a).bitwiseOR(col(b))


def bitwise_xor(a, b, boolean: bool = False) -> Column:
    return (col(a) != col(b)) if boolean else col(a).bitwiseXOR(col(b))


def invert(a, boolean: bool = False) -> Column:
    return ~col(a) if boolean else F.bitwise_not(col(a))


def left_shift(a, b) -> Column:
    a, b = col(a).cast("long"), col(b).cast("int")
    return F.when((b < 0) | (b >= 64), F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", a, b))


def right_shift(a, b) -> Column:
    a, b = col(a).cast("long"), col(b).cast("int")
    return F.when((b < 0) | (b >= 64), F.when(a < 0, F.lit(-1).cast("long")).otherwise(F.lit(0).cast("long"))).otherwise(F.call_function("shiftright", a, b))


def gcd(a, b) -> Column:
    """Euclid's remainders, 92 of them at most for 64-bit integers."""
    start = F.struct(F.abs(col(a).cast("long")).alias("x"), F.abs(col(b).cast("long")).alias("y"))

    def step(s: Column, _: Column) -> Column:
        y = s["y"]
        return F.struct(F.when(y == 0, s["x"]).otherwise(y).alias("x"), F.when(y == 0, 0).otherwise(s["x"] % F.when(y == 0, 1).otherwise(y)).cast("long").alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def lcm(a, b) -> Column:
    a, b = col(a).cast("long"), col(b).cast("long")
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), 0).otherwise(whole_quotient(F.abs(a), F.when(g == 0, 1).otherwise(g)) * F.abs(b)).cast("long")


# Spacing of doubles: no Spark expression reaches their bits.


def _backed(function: Callable, *columns) -> Column:
    """A NumPy function of doubles, run on the executors."""

    def one(a: pd.Series) -> pd.Series:
        return pd.Series(function(a.to_numpy()))

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(function(a.to_numpy(), b.to_numpy()))

    return F.pandas_udf(one if len(columns) == 1 else two, DoubleType())(*map(dbl, columns))


def nextafter(a, b) -> Column:
    return _backed(np.nextafter, a, b)


def spacing(a) -> Column:
    return _backed(np.spacing, a)


PYTHON_BACKED = {"nextafter", "spacing"}


def _one(f: Callable) -> Callable:
    return lambda a: f(dbl(a))


def _two(f: Callable) -> Callable:
    return lambda a, b: f(dbl(a), dbl(b))


def arctan2(a, b) -> Column:
    """Spark's atan2 takes the negative zero for 0."""
    a = dbl(a)
    angle = F.atan2(a, dbl(b))
    flat = F.when(signbit(b), F.lit(-math.pi)).otherwise(F.lit(-0.0))
    return F.when((a == 0) & signbit(a) & ~F.isnan(dbl(b)), flat).when((a == 0) & ~F.isnan(dbl(b)), F.when(signbit(b), F.lit(math.pi)).otherwise(F.lit(0.0))).otherwise(angle)


exp, expm1, sqrt, cbrt = map(_one, (F.exp, F.expm1, F.sqrt, F.cbrt))
sin, cos, tan, arcsin, arccos, arctan = map(_one, (F.sin, F.cos, F.tan, F.asin, F.acos, F.atan))
sinh, cosh, tanh, arcsinh, arccosh, arctanh = map(_one, (F.sinh, F.cosh, F.tanh, F.asinh, F.acosh, F.atanh))
hypot, float_power = map(_two, (F.hypot, F.pow))
deg2rad = radians = _one(F.radians)
rad2deg = degrees = _one(F.degrees)

#: name: (function, kind of result). Kinds: float, same (as the operands'), bool, int.
UNARY: dict[str, tuple[Callable, str]] = (
    {n: (globals()[n], "float") for n in "exp exp2 expm1 log log2 log10 log1p sqrt cbrt sin cos tan arcsin arccos arctan deg2rad rad2deg degrees radians sinh cosh tanh arcsinh arccosh arctanh spacing".split()}
    | {n: (globals()[n], "whole") for n in "floor ceil trunc rint sign".split()}
    | {n: (globals()[n], "same") for n in "square reciprocal negative positive absolute invert".split()}
    | {n: (globals()[n], "bool") for n in "isnan isinf isfinite signbit logical_not".split()}
)
BINARY: dict[str, tuple[Callable, str]] = (
    {n: (globals()[n], "float") for n in "divide float_power arctan2 hypot logaddexp logaddexp2 copysign nextafter heaviside".split()}
    | {n: (globals()[n], "same") for n in "add subtract multiply floor_divide mod fmod power maximum minimum fmax fmin bitwise_and bitwise_or bitwise_xor".split()}
    | {n: (globals()[n], "bool") for n in "less less_equal greater greater_equal equal not_equal logical_and logical_or logical_xor".split()}
    | {n: (globals()[n], "int") for n in "gcd lcm left_shift right_shift".split()}
)
ALIASES = {"remainder": "mod", "true_divide": "divide", "conj": "conjugate", "abs": "absolute"}
