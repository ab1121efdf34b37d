"""Words on array columns (one sample's flattened values), by higher-order functions: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import scalar as S


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def tensor_scalar(x: Column, op: str, s: float) -> Column:
    return F.transform(x, lambda e: S.BINARY[op](e, F.lit(float(s))))


def scalar_tensor(s: float, op: str, x: Column) -> Column:
    """The scalar is the left operand."""
    return F.transform(x, lambda e: S.BINARY[op](F.lit(float(s)), e))


def tensor_tensor(x: Column, op: str, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: S.BINARY[op](a, b))


def unary(x: Column, word: str) -> Column:
    return F.transform(x, S.UNARY[word])


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, e: a + e)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def with_value(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, not anew in each lambda that uses it."""
    return F.transform(F.array(value), f)[0]


def softmax(x: Column) -> Column:
    """Shifted by the maximum. Maximum, exponentials and sum are computed once a row, each bound as an array of one."""
    exps = with_value(F.array_max(x), lambda top: F.transform(x, lambda e: F.exp(e - top)))
    return with_value(exps, lambda z: with_value(total(z), lambda s: F.transform(z, lambda e: e / s)))


def log_softmax(x: Column) -> Column:
    norm = with_value(F.array_max(x), lambda top: F.ln(total(F.transform(x, lambda e: F.exp(e - top)))) + top)
    return with_value(norm, lambda z: F.transform(x, lambda e: e - z))


def argmax(x: Column) -> Column:
    """Place of the first maximum, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def gradfill(n: int, v: float = 1.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.lit(v) * j / F.lit(float(n)))


def linear(x: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """W x + b with literal parameters; for wide layers use operators.layers."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in weights])
    b = F.array(*[F.lit(float(v)) for v in bias])
    return F.zip_with(F.transform(rows, lambda w: dot(x, w)), b, lambda p, q: p + q)


