"""Matrices and NHWC tensors in coordinate form.

A tensor is a DataFrame (n, h, w, c, v), a matrix (i, j, v), a vector (i, v); absent cells are zero in contractions.
Every operator is a plan of projections, equi-joins and aggregations: contraction is a join on the inner index and a sum
that combines on the map side.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar as S

#: A matrix or vector of at most so many cells is broadcast to a contraction. Joined by a shuffle, as many tasks as it has inner
#: indices would get all cells of the other side, each with a sum for nearly every cell of the product.
BROADCAST = 1 << 20


def spread(b: DataFrame, size: int) -> DataFrame:
    """b of so many cells, as the smaller side of a contraction."""
    return F.broadcast(b) if size <= BROADCAST else b


def matrix(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    """From literals; rows must be of one length."""
    if len({len(r) for r in rows}) > 1:
        raise ValueError("rows of different lengths")
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "i int, j int, v double")


def vector(spark: SparkSession, values: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")


def tensor(df: DataFrame, values: str, shape: tuple[int, int, int], key: str) -> DataFrame:
    """(n, h, w, c, v) from one array of h*w*c values a row, channel last."""
    _, w, c = shape
    return df.select(F.col(key).alias("n"), F.posexplode(F.col(values).cast("array<double>")).alias("k", "v")).select(
        "n",
        F.expr(f"cast(k div {w * c} as int)").alias("h"),
        F.expr(f"cast(k div {c} % {w} as int)").alias("w"),
        F.expr(f"cast(k % {c} as int)").alias("c"),
        "v",
    )


def to_rows(t: DataFrame) -> DataFrame:
    """(n, x) with the values of each sample in order."""
    return t.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "w", "c", "v"))), lambda s: s["v"]).alias("x"))


def constant(spark: SparkSession, h: int, w: int, v: Column | float) -> DataFrame:
    """zeros, ones, fill: v may be an expression over i and j."""
    cells = spark.range(h * w).select(F.expr(f"cast(id div {w} as int)").alias("i"), F.expr(f"cast(id % {w} as int)").alias("j"))
    return cells.select("i", "j", (v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias("v"))


def gradfill(spark: SparkSession, h: int, w: int, v: float = 1.0) -> DataFrame:
    return constant(spark, h, w, (F.col("i") * w + F.col("j")) * v / F.lit(float(h * w)))


def eye(spark: SparkSession, h: int, w: int | None = None) -> DataFrame:
    return constant(spark, h, w or h, F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))


def rand(spark: SparkSession, h: int, w: int, seed: int) -> DataFrame:
    """Uniform over (0, 1]."""
    return constant(spark, h, w, 1.0 - F.rand(seed))


def randn(spark: SparkSession, h: int, w: int, seed: int) -> DataFrame:
    return constant(spark, h, w, F.randn(seed))


def map_values(t: DataFrame, f) -> DataFrame:
    return t.withColumn("v", f(F.col("v")))


def combine(a: DataFrame, b: DataFrame, op: str, on: list[str]) -> DataFrame:
    """Element by element where both have a cell; leave n out of ``on`` to broadcast a single sample b over all of a."""
    right = b.select(*on, F.col("v").alias("__v"))
    return a.join(right, on).withColumn("v", S.BINARY[op](F.col("v"), F.col("__v"))).drop("__v")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def upper(a: DataFrame) -> DataFrame:
    return a.withColumn("v", F.when(F.col("j") >= F.col("i"), F.col("v")).otherwise(0.0))


def lower(a: DataFrame) -> DataFrame:
    """With ones on the diagonal."""
    return a.withColumn("v", F.when(F.col("i") == F.col("j"), 1.0).when(F.col("j") < F.col("i"), F.col("v")).otherwise(0.0))


def cut(a: DataFrame, j0: int, j1: int, i0: int, i1: int) -> DataFrame:
    """Columns [j0, j1) and rows [i0, i1), -1 for the end; indices start at 0 again."""
    keep = (F.col("j") >= j0) & (F.col("i") >= i0)
    if j1 >= 0:
        keep &= F.col("j") < j1
    if i1 >= 0:
        keep &= F.col("i") < i1
    return a.where(keep).select((F.col("i") - i0).alias("i"), (F.col("j") - j0).alias("j"), "v")


def reshape(a: DataFrame, w_old: int, w_new: int) -> DataFrame:
    """Same values in the same order at another width."""
    k = F.col("i").cast("bigint") * w_old + F.col("j")
    return a.select(F.expr(f"cast((cast(i as bigint) * {w_old} + j) div {w_new} as int)").alias("i"), (k % w_new).cast("int").alias("j"), "v")


def element(a: DataFrame, i: int, j: int) -> DataFrame:
    return a.where((F.col("i") == i) & (F.col("j") == j)).select("v")


def with_element(a: DataFrame, i: int, j: int, v: float) -> DataFrame:
    return a.withColumn("v", F.when((F.col("i") == i) & (F.col("j") == j), F.lit(float(v))).otherwise(F.col("v")))


def overlay(a: DataFrame, new: DataFrame) -> DataFrame:
    """Cells of new instead of a's, where it has some."""
    fresh = new.select("i", "j", F.col("v").alias("__v"))
    return a.join(fresh, ["i", "j"], "left").select("i", "j", F.coalesce("__v", "v").alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    right = x.select(F.col("i").alias("j"), F.col("v").alias("y"))
    return a.join(right, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("y")).alias("v"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("i", F.col("v").alias("y")), "i").agg(F.sum(F.col("v") * F.col("y")).alias("v"))


def batch_matmul(a: DataFrame, b: DataFrame, shared: bool = False) -> DataFrame:
    """(n, i, j, v) by (n, i, j, v), sample by sample; with ``shared`` b is one matrix (i, j, v) for all samples, see spread()."""
    on = ["k"] if shared else ["n", "k"]
    left = a.select("n", "i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(*([] if shared else ["n"]), F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, on).groupBy("n", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def sample_matmul(df: DataFrame, values: str, shape: tuple[int, int], m: list[list[float]], key: str) -> DataFrame:
    """(n, i, j, v) of samples of h*w values, one array a row, each times one matrix of literals.

    Rows of one key add up before the product: a task holds a row of w sums for each row of a sample, instead of a sum for each
    cell, and moves no more than that. A value that is missing or null is absent; a sample's row that has none gives nulls.
    """
    h, w = shape
    if len(m) != w or len({len(r) for r in m}) != 1:
        raise ValueError(f"samples of {h} x {w}, and {[len(r) for r in m]} values in the rows of the matrix")
    rows = df.select(F.col(key).alias("n"), F.posexplode(F.array(*[F.slice(values, i * w + 1, w) for i in range(h)])).alias("i", "x"))
    sums = rows.groupBy("n", "i").agg(*[F.sum(F.get("x", F.lit(k)).cast("double")).alias(f"x{k}") for k in range(w)])
    x = [F.col(f"x{k}") for k in range(w)]
    some = F.coalesce(*x).isNotNull()
    product = [F.when(some, reduce(add, [F.coalesce(x[k], F.lit(0.0)) * float(m[k][j]) for k in range(w)])) for j in range(len(m[0]))]
    return sums.select("n", "i", F.posexplode(F.array(*product)).alias("j", "v"))


def gemm(alpha: float, beta: float, a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """alpha a b + beta c: both terms go through one aggregation."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    terms = left.join(right, "k").select("i", "j", (alpha * F.col("x") * F.col("y")).alias("v"))
    return terms.unionByName(c.select("i", "j", (beta * F.col("v")).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def chain_order(shapes: list[tuple[int, int]]) -> tuple:
    """Nested pairs of operand numbers that multiply the chain with the fewest scalar products."""
    n = len(shapes)
    cost = {(i, i): (0, i) for i in range(n)}
    for span in range(1, n):
        for i in range(n - span):
            j = i + span
            cost[i, j] = min(
                ((cost[i, k][0] + cost[k + 1, j][0] + shapes[i][0] * shapes[k][1] * shapes[j][1], (cost[i, k][1], cost[k + 1, j][1])) for k in range(i, j)),
                key=lambda x: x[0],
            )
    return cost[0, n - 1][1]


def matmul_chain(operands: list[DataFrame], shapes: list[tuple[int, int]]) -> DataFrame:
    def go(tree) -> DataFrame:
        return operands[tree] if isinstance(tree, int) else matmul(go(tree[0]), go(tree[1]))

    return go(chain_order(shapes))
