"""Scalar words as Column expressions, all inside whole-stage code generation.

Numbers are doubles. Comparisons tolerate EPS; booleans become -1 and 0 by ``flag`` where the stack language needs them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
TINY = 1e-12


def _c(x: Column | float | int) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def integer(x: Column | float) -> Column:
    """Towards zero, as 32-bit integer."""
    return _c(x).cast("int")


def mod(a: Column, b: Column | float) -> Column:
    return (integer(a) % integer(b)).cast("double")


def fmod(a: Column, b: Column | float) -> Column:
    return _c(a) % _c(b)


def divmod_plain(a: Column, b: Column | float) -> tuple[Column, Column]:
    """Remainder and unfloored quotient."""
    return fmod(a, b), _c(a) / _c(b)


def muldiv(a: Column, b: Column | float, c: Column | float) -> Column:
    return _c(a) * _c(b) / _c(c)


def muldivmod(a: Column, b: Column | float, c: Column | float) -> tuple[Column, Column]:
    """Remainder and floored quotient of a*b by c."""
    return (_c(a) * _c(b)) % _c(c), F.floor(_c(a) * _c(b) / _c(c)).cast("double")


def bit_and(a: Column, b: Column | float) -> Column:
    return integer(a).bitwiseAND(integer(b)).cast("double")


def bit_or(a: Column, b: Column | float) -> Column:
    return integer(a).bitwiseOR(integer(b)).cast("double")


def bit_xor(a: Column, b: Column | float) -> Column:
    return integer(a).bitwiseXOR(integer(b)).cast("double")


def invert(a: Column) -> Column:
    return F.bitwise_not(integer(a)).cast("double")


def rshift(a: Column, n: int) -> Column:
    return F.shiftright(integer(a), n).cast("double")


def lshift(a: Column, n: int) -> Column:
    return F.shiftleft(integer(a), n).cast("double")


def half_away(x: Column) -> Column:
    """Rounded to an integer, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def sat(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(x)))


def ln(x: Column) -> Column:
    """Clamped from below, so that it is finite."""
    return F.ln(F.greatest(_c(x), F.lit(TINY)))


def log10(x: Column) -> Column:
    return F.log10(F.greatest(_c(x), F.lit(TINY)))


def ln_scalar(x: Column) -> Column:
    """The scalar word: 0 from EPS down."""
    return F.when(_c(x) > EPS, F.ln(_c(x))).otherwise(0.0)


def log10_scalar(x: Column) -> Column:
    return F.when(_c(x) > EPS, F.log10(_c(x))).otherwise(0.0)


def root(x: Column) -> Column:
    return F.sqrt(F.greatest(_c(x), F.lit(0.0)))


def relu(x: Column) -> Column:
    return F.greatest(_c(x), F.lit(0.0))


def leaky(x: Column, a: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(a * x)


def elu(x: Column, a: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(a * (F.exp(x) - 1.0))


SELU_SCALE, SELU_NEGATIVE = 1.0507009873554805, 1.7580993408473766


def selu(x: Column) -> Column:
    return F.when(x > 0, SELU_SCALE * x).otherwise(SELU_NEGATIVE * (F.exp(x) - 1.0))


UNARY = {
    "abs": F.abs,
    "negate": lambda x: -x,
    "exp": F.exp,
    "ln": ln,
    "log": log10,
    "tanh": F.tanh,
    "relu": relu,
    "sigmoid": sigmoid,
    "sqrt": root,
    "1/x": lambda x: F.lit(1.0) / x,
    "sat": sat,
    "sin": F.sin,
    "cos": F.cos,
    "selu": selu,
    # One parameter each: transform() would pass the place as a second one.
    "leakyrelu": lambda x: leaky(x),
    "elu": lambda x: elu(x),
}

BINARY = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b}


def flag(condition: Column) -> Column:
    """-1 for true, 0 for false."""
    return F.when(condition, -1).otherwise(0)


def equal(a: Column, b: Column | float) -> Column:
    return F.abs(_c(a) - _c(b)) < EPS


def less(a: Column, b: Column | float) -> Column:
    return (_c(a) - _c(b)) < -EPS


def greater(a: Column, b: Column | float) -> Column:
    return (_c(a) - _c(b)) > EPS


def unsigned(a: Column | float) -> Column:
    return F.pmod(integer(a).cast("bigint"), F.lit(1 << 32))


def broken(x: Column) -> Column:
    """Neither finite nor null."""
    return F.isnan(x) | (F.abs(x) == F.lit(math.inf))


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded, and without minus zero."""
    return F.round(x, digits) + F.lit(0.0)
