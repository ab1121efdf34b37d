"""Registry and shared inputs of the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SIDE, CLASSES, WIDTH = 8, 10, 64


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, x)."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def cells(df: DataFrame, x: Column | str = "x", key: str = "vec_id") -> DataFrame:
    """(key, k, v) of an array column, rounded."""
    return df.select(key, F.posexplode(x).alias("k", "v")).select(key, "k", S.tidy(F.col("v")).alias("v"))


def image(spark: SparkSession, d: str) -> DataFrame:
    """(n, h, w, c, v): embeddings as 8 x 8 x 1."""
    from gridloom.operators import coo

    return coo.tensor(table(spark, d, "embeddings"), "embedding", (SIDE, SIDE, 1), "vec_id")


def weight(o: int, k: int) -> float:
    return ((o * 31 + k * 17) % 101 - 50) / 500.0


def bias(o: int) -> float:
    return (o % 7 - 3) / 10.0


#: SQL: the embeddings cell by cell; the image; weights and biases.
E = "e AS (SELECT vec_id, label, CAST(unnest(generate_series(0, 63)) AS INTEGER) AS k, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings)"
IMG = f"{E}, img AS (SELECT vec_id AS n, k // 8 AS h, k % 8 AS w, v FROM e)"
W = "wt AS (SELECT CAST(o AS INTEGER) AS o, CAST(k AS INTEGER) AS k, ((o * 31 + k * 17) % 101 - 50) / 500.0::DOUBLE AS w FROM range(10) a(o), range(64) b(k))"
LOGITS = f"{E}, {W}, z AS (SELECT vec_id, label, o, sum(v * w) + (o % 7 - 3) / 10.0::DOUBLE AS z FROM e JOIN wt USING (k) GROUP BY vec_id, label, o)"
PROBS = f"{LOGITS}, p AS (SELECT vec_id, label, o, exp(z - max(z) OVER q) / sum(exp(z - zm)) OVER q AS p FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS zm FROM z) WINDOW q AS (PARTITION BY vec_id))"


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def over_cells(expr: str) -> str:
    return f"WITH {E} SELECT vec_id, k, {r6(expr)} AS v FROM e"
