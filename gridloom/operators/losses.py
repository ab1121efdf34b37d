"""Losses and targets over coordinate outputs (n, c, o) with targets t; all divide by the number of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS, TINY = 1e-6, 1e-12


def per_cell(name: str, o: Column, t: Column) -> Column:
    if name == "mse":
        return (o - t) * (o - t)
    if name == "bce":
        return -(t * F.ln(o + EPS) + (1.0 - t) * F.ln(1.0 - o + EPS))
    if name == "ce":
        return -(t * F.ln(F.greatest(o, F.lit(TINY))))
    if name == "nll":
        return -(t * o)
    raise ValueError(name)


def loss(df: DataFrame, name: str) -> DataFrame:
    """One row: loss of (n, c, o, t)."""
    return df.agg((F.sum(per_cell(name, F.col("o"), F.col("t"))) / F.countDistinct("n")).alias("loss"))


def loss_rows(df: DataFrame, name: str, o: str = "o", t: str = "t") -> DataFrame:
    """The same from arrays, one sample a row: nothing but the sums is shuffled."""
    cell = F.aggregate(F.zip_with(o, t, lambda a, b: per_cell(name, a, b)), F.lit(0.0), lambda a, e: a + e)
    return df.agg((F.sum(cell) / F.count("*")).alias("loss"))


def onehot(label: Column, classes: int) -> Column:
    """Array of classes; a label out of range marks class 0."""
    k = F.when((label >= 0) & (label < classes), label).otherwise(0)
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == k, 1.0).otherwise(0.0))


def hit(df: DataFrame, o: str = "o", t: str = "t") -> DataFrame:
    """Sum of the target at the first maximum of the output."""
    at = F.array_position(F.col(o), F.array_max(o)).cast("int")
    return df.agg(F.sum(F.element_at(F.col(t), at)).alias("hit"))
