"""Shapes, contractions and linear algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import coo, linalg
from gridloom.queries.base import CLASSES, E, WIDTH, W, embeddings, image, query, r6, table, weight
from gridloom.sources import summary


def rows20(spark: SparkSession, d: str, n: int = 20) -> DataFrame:
    """The first n embeddings as a matrix (i, j, v)."""
    return embeddings(spark, d).where(F.col("vec_id") < n).select(F.col("vec_id").cast("int").alias("i"), F.posexplode("x").alias("j", "v"))


def out(t: DataFrame) -> DataFrame:
    return t.withColumn("v", S.tidy(F.col("v")))


A = f"{E}, a AS (SELECT CAST(vec_id AS INTEGER) AS i, k AS j, v FROM e WHERE vec_id < 20)"


@query("shape_flatten_reshape", f"WITH {A} SELECT CAST((i * 64 + j) // 32 AS INTEGER) AS i, CAST((i * 64 + j) % 32 AS INTEGER) AS j, {r6('v')} AS v FROM a")
def shape_flatten_reshape(spark: SparkSession, d: str) -> DataFrame:
    return out(coo.reshape(rows20(spark, d), WIDTH, 32))


@query("shape_transpose", f"WITH {A} SELECT j AS i, i AS j, {r6('v')} AS v FROM a")
def shape_transpose(spark: SparkSession, d: str) -> DataFrame:
    return out(coo.transpose(rows20(spark, d)))


@query("shape_slice", f"WITH {A} SELECT i - 5 AS i, j - 8 AS j, {r6('v')} AS v FROM a WHERE j >= 8 AND j < 24 AND i >= 5")
def shape_slice(spark: SparkSession, d: str) -> DataFrame:
    return out(coo.cut(rows20(spark, d), 8, 24, 5, -1))


@query("shape_triangles", f"WITH {A} SELECT i, j, {r6('CASE WHEN j >= i THEN v ELSE 0 END')} AS up, {r6('CASE WHEN i = j THEN 1 WHEN j < i THEN v ELSE 0 END')} AS low FROM a WHERE j < 20")
def shape_triangles(spark: SparkSession, d: str) -> DataFrame:
    a = rows20(spark, d).where("j < 20")
    up, low = coo.upper(a).withColumnRenamed("v", "up"), coo.lower(a).withColumnRenamed("v", "low")
    return up.join(low, ["i", "j"]).select("i", "j", S.tidy(F.col("up")).alias("up"), S.tidy(F.col("low")).alias("low"))


@query("shape_dim_same", "SELECT 20 AS h, 64 AS w, true AS same, false AS other, 1280::BIGINT AS cells")
def shape_dim_same(spark: SparkSession, d: str) -> DataFrame:
    """Shape of a matrix, and comparison with that of itself and of its transpose."""
    a = rows20(spark, d)
    dim = a.agg((F.max("i") + 1).alias("h"), (F.max("j") + 1).alias("w"), F.count("*").alias("cells"))
    t = coo.transpose(a).agg((F.max("i") + 1).alias("th"), (F.max("j") + 1).alias("tw"))
    return dim.crossJoin(t).select("h", "w", ((F.col("h") == F.col("h")) & (F.col("w") == F.col("w"))).alias("same"), ((F.col("h") == F.col("th")) & (F.col("w") == F.col("tw"))).alias("other"), "cells")


@query("elem_get_set", f"WITH {A} SELECT i, j, {r6('CASE WHEN i = 3 AND j = 4 THEN 9.5 ELSE v END')} AS v, {r6('(SELECT v FROM a WHERE i = 7 AND j = 8)')} AS got FROM a")
def elem_get_set(spark: SparkSession, d: str) -> DataFrame:
    a = rows20(spark, d)
    got = coo.element(a, 7, 8).select(S.tidy(F.col("v")).alias("got"))
    return out(coo.with_element(a, 3, 4, 9.5)).crossJoin(F.broadcast(got))


@query("shape_overlay", f"WITH {A} SELECT i, j, {r6('CASE WHEN i < 2 AND j < 2 THEN i * 2 + j ELSE v END')} AS v FROM a")
def shape_overlay(spark: SparkSession, d: str) -> DataFrame:
    return out(coo.overlay(rows20(spark, d), coo.matrix(spark, [[0, 1], [2, 3]])))


@query(
    "tile_layout",
    f"WITH {E} SELECT CAST(vec_id // 5 * 10 + k // 8 AS INTEGER) AS y, CAST(vec_id % 5 * 10 + k % 8 AS INTEGER) AS x, 0 AS c, CAST(trunc(least(255, greatest(0, v * 256))) AS INTEGER) AS pixel FROM e WHERE vec_id < 20",
)
def tile_layout(spark: SparkSession, d: str) -> DataFrame:
    return summary.tile(image(spark, d).where("n < 20"), 5, 8, 8)


@query(
    "image_pixels",
    f"WITH {E}, s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM e WHERE vec_id < 20) SELECT vec_id AS n, k // 8 AS h, k % 8 AS w, 0 AS c, CAST(trunc(least(255, greatest(0, (v - m) * 64 / s))) AS INTEGER) AS pixel FROM e, s WHERE vec_id < 20",
)
def image_pixels(spark: SparkSession, d: str) -> DataFrame:
    return summary.pixels(image(spark, d).where("n < 20"))


@query("matmul_gram", f"WITH {A} SELECT x.i, y.i AS j, {r6('sum(x.v * y.v)')} AS v FROM a x JOIN a y USING (j) GROUP BY x.i, y.i".replace("USING (j)", "ON x.j = y.j"))
def matmul_gram(spark: SparkSession, d: str) -> DataFrame:
    a = rows20(spark, d)
    return out(coo.matmul(a, coo.transpose(a)))


@query("matmul_blocks", f"WITH {E} SELECT CAST(x.k AS INTEGER) AS i, CAST(y.k AS INTEGER) AS j, {r6('sum(x.v * y.v)')} AS v FROM e x JOIN e y ON x.vec_id = y.vec_id GROUP BY x.k, y.k")
def matmul_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Transpose of all embeddings times themselves, by tiles."""
    a = rows20(spark, d, 1 << 30)
    return out(linalg.block_matmul(coo.transpose(a), a, 64))


def pattern(a: int, b: int):
    return lambda i, j: ((i * a + j * b) % 101 - 50) / 50.0


@query(
    "matmul_tiles",
    f"WITH a AS (SELECT i, k, ((i * 31 + k * 17) % 101 - 50) / 50.0::DOUBLE AS v FROM range(100) r(i), range(130) s(k)), b AS (SELECT k, j, ((k * 13 + j * 7) % 101 - 50) / 50.0::DOUBLE AS v FROM range(130) r(k), range(70) s(j)) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r6('sum(a.v * b.v)')} AS v FROM a JOIN b USING (k) GROUP BY i, j",
)
def matmul_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Dense tiles, with edges that don't fill theirs."""
    a, b = linalg.dense_tiles(spark, 100, 130, 32, pattern(31, 17)), linalg.dense_tiles(spark, 130, 70, 32, pattern(13, 7))
    return out(linalg.untiled(linalg.tile_matmul(a, b, 32), 100, 70, 32))


@query("matvec", f"WITH {E} SELECT CAST(vec_id AS INTEGER) AS i, {r6('sum(v * ((k % 5) - 2))')} AS v FROM e GROUP BY vec_id")
def matvec(spark: SparkSession, d: str) -> DataFrame:
    return out(coo.matvec(rows20(spark, d, 1 << 30), F.broadcast(coo.vector(spark, [k % 5 - 2 for k in range(WIDTH)]))))


@query(
    "matmul_batch_broadcast",
    f"WITH {E}, m AS (SELECT i, j, ((i * 8 + j) % 7 - 3) / 2.0::DOUBLE AS v FROM range(8) a(i), range(8) b(j)) SELECT vec_id AS n, k // 8 AS i, CAST(m.j AS INTEGER) AS j, {r6('sum(e.v * m.v)')} AS v FROM e JOIN m ON e.k % 8 = m.i GROUP BY vec_id, k // 8, m.j",
)
def matmul_batch_broadcast(spark: SparkSession, d: str) -> DataFrame:
    """Each 8 x 8 sample times one matrix."""
    m = [[((i * 8 + j) % 7 - 3) / 2.0 for j in range(8)] for i in range(8)]
    return out(coo.sample_matmul(table(spark, d, "embeddings"), "embedding", (8, 8), m, "vec_id"))


@query(
    "gemm_alpha_beta",
    f"WITH {A}, g AS (SELECT x.i AS i, y.i AS j, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.j = y.j GROUP BY x.i, y.i) SELECT i, j, {r6('2 * v + 0.5 * (i * 20 + j) / 400')} AS v FROM g",
)
def gemm_alpha_beta(spark: SparkSession, d: str) -> DataFrame:
    a = rows20(spark, d)
    return out(coo.gemm(2.0, 0.5, a, coo.transpose(a), coo.gradfill(spark, 20, 20)))


@query(
    "matmul_chain",
    f"WITH {A}, {W}, g AS (SELECT a.i, wt.o, sum(a.v * wt.w) AS v FROM a JOIN wt ON a.j = wt.k GROUP BY a.i, wt.o), h AS (SELECT g.i, wt.k AS j, sum(g.v * wt.w) AS v FROM g JOIN wt USING (o) GROUP BY g.i, wt.k) SELECT i, j, {r6('v')} AS v FROM h",
)
def matmul_chain(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings, weights transposed, weights: the order of multiplication is chosen by shape."""
    w = coo.matrix(spark, [[weight(o, k) for k in range(WIDTH)] for o in range(CLASSES)])
    return out(coo.matmul_chain([rows20(spark, d), coo.transpose(w), w], [(20, WIDTH), (WIDTH, CLASSES), (CLASSES, WIDTH)]))


M3 = [[2.0, 2.0, 5.0], [1.0, 1.0, 1.0], [4.0, 6.0, 8.0]]


@query("det_3x3", "WITH p AS (SELECT 0.1 * r_regionkey AS s FROM region WHERE r_regionkey = 0) SELECT round((2 + s) * (1 * 8 - 1 * 6) - 2 * (1 * 8 - 1 * 4) + 5 * (1 * 6 - 1 * 4), 6)::DOUBLE + 0.0 AS v FROM p")
def det_3x3(spark: SparkSession, d: str) -> DataFrame:
    return out(linalg.det(coo.matrix(spark, M3)))


@query("solve_3x3", "SELECT CAST(i AS INTEGER) AS i, CAST(v AS DOUBLE) AS v FROM (VALUES (0, 8), (1, -1), (2, -8)) t(i, v)")
def solve_3x3(spark: SparkSession, d: str) -> DataFrame:
    return out(linalg.solve(coo.matrix(spark, [[5, 7, 4], [3, -1, 3], [6, 7, 5]]), coo.vector(spark, [1, 1, 1])))


def normal(spark: SparkSession, d: str) -> DataFrame:
    """Gram matrix of ten embeddings plus the unit matrix: well conditioned."""
    a = rows20(spark, d, 10)
    return coo.gemm(1.0, 1.0, a, coo.transpose(a), coo.eye(spark, 10))


IDENTITY = "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(10) a(i), range(10) b(j)"
ZEROS = "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, 0.0::DOUBLE AS v FROM range(10) a(i), range(10) b(j)"


@query("inverse_residual", IDENTITY)
def inverse_residual(spark: SparkSession, d: str) -> DataFrame:
    m = normal(spark, d)
    return out(coo.matmul(m, linalg.inverse(m)))


@query("luinv_residual", IDENTITY)
def luinv_residual(spark: SparkSession, d: str) -> DataFrame:
    m = normal(spark, d)
    return out(coo.matmul(linalg.lu_inverse(m), m))


@query("plu_residual", ZEROS)
def plu_residual(spark: SparkSession, d: str) -> DataFrame:
    """P A - L U."""
    m = normal(spark, d)
    parts = linalg.plu(m)
    lu = parts.where("part = 'LU'").select("i", "j", "v")
    return out(coo.gemm(1.0, -1.0, parts.where("part = 'P'").select("i", "j", "v"), m, coo.matmul(coo.lower(lu), coo.upper(lu))))


@query("matdiv_residual", ZEROS)
def matdiv_residual(spark: SparkSession, d: str) -> DataFrame:
    """(A / B) B - A."""
    m = normal(spark, d)
    a = coo.gradfill(spark, 10, 10)
    return out(coo.gemm(1.0, -1.0, coo.matmul(a, linalg.inverse(m)), m, a))


@query("embed_rows", "SELECT 'emb.' || vec_id AS name, label, len(embedding) AS width FROM embeddings")
def embed_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("emb."), F.col("vec_id").cast("string")).alias("name"), "label", F.size("embedding").cast("bigint").alias("width"))


#: A matrix of zeros in its last row and column, and its square, cell by cell.
HOLED = [[1.0, 2.0, 0.0], [3.0, 4.0, 0.0], [0.0, 0.0, 0.0]]


@query("matmul_blocks_zeros", "SELECT * FROM (VALUES (0, 0, 7.0::DOUBLE), (0, 1, 10.0), (0, 2, 0.0), (1, 0, 15.0), (1, 1, 22.0), (1, 2, 0.0), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 0.0)) t(i, j, v)")
def matmul_blocks_zeros(spark: SparkSession, d: str) -> DataFrame:
    """Zero cells of a product by tiles stay, over the tiles' borders too."""
    m = coo.matrix(spark, HOLED)
    return out(linalg.block_matmul(m, m, 2))


@query("det_singular", "SELECT CASE WHEN k < 2 THEN 0.0::DOUBLE ELSE 4.0 END AS v FROM range(3) r(k)")
def det_singular(spark: SparkSession, d: str) -> DataFrame:
    """Of a product with zeros, of sparse cells of a known shape, and of a regular product."""
    m, regular = coo.matrix(spark, HOLED), coo.matrix(spark, [[1.0, 2.0], [3.0, 4.0]])
    sparse = spark.createDataFrame([(0, 0, 1.0)], "i int, j int, v double")
    found = linalg.det(linalg.block_matmul(m, m, 2)).union(linalg.det(sparse, (2, 2))).union(linalg.det(linalg.block_matmul(regular, regular, 2)))
    return out(found)
