"""Dense linear algebra: block products, and factorisations of small square matrices.

A product of large matrices runs on blocks: each side is cut into tiles, tiles meet by their inner block number, NumPy
multiplies them, and Spark adds up the partial products by output tile. Factorisations are sequential in the pivots, so
they gather one matrix, of at most MAX_SIDE rows, into one task. They take its shape, or find it in one aggregation: a cell
that isn't there is zero, in the last row or column too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SIDE = 4096
PIVOT = 1e-6


class Singular(ValueError):
    """No pivot of at least PIVOT."""


def plu_dense(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Row order, packed L\\U (unit diagonal of L left out) and the permutation's sign; partial pivoting."""
    u = np.array(a, float)
    n = len(u)
    order, sign = np.arange(n), 1
    for z in range(n):
        p = z + int(np.argmax(np.abs(u[z:, z])))
        if abs(u[p, z]) < PIVOT:
            raise Singular(f"column {z}")
        if p != z:
            u[[z, p]] = u[[p, z]]
            order[[z, p]] = order[[p, z]]
            sign = -sign
        u[z + 1 :, z] /= u[z, z]
        u[z + 1 :, z + 1 :] -= np.outer(u[z + 1 :, z], u[z, z + 1 :])
    return order, u, sign


def inverse_dense(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with partial pivoting."""
    n = len(a)
    m = np.hstack([np.array(a, float), np.eye(n)])
    for z in range(n):
        p = z + int(np.argmax(np.abs(m[z:, z])))
        if abs(m[p, z]) < PIVOT:
            raise Singular(f"column {z}")
        m[[z, p]] = m[[p, z]]
        m[z] /= m[z, z]
        others = np.arange(n) != z
        m[others] -= np.outer(m[others, z], m[z])
    return m[:, n:]


def solve_plu(order: np.ndarray, lu: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Forward, then back substitution, for a vector or the columns of a matrix."""
    x = np.array(b, float)[order]
    for z in range(len(lu)):
        x[z + 1 :] -= np.multiply.outer(lu[z + 1 :, z], x[z])
    for z in range(len(lu) - 1, -1, -1):
        x[z] = x[z] / lu[z, z]
        x[:z] -= np.multiply.outer(lu[:z, z], x[z])
    return x


def det_dense(a: np.ndarray) -> float:
    try:
        _, lu, sign = plu_dense(a)
    except Singular:
        return 0.0
    diagonal = np.diag(lu)
    return float(sign * np.prod(np.sign(diagonal)) * np.exp(np.log(np.abs(diagonal)).sum()))


def _dense(frame: pd.DataFrame, side: int) -> np.ndarray:
    out = np.zeros((side, side))
    out[frame["i"].to_numpy(), frame["j"].to_numpy()] = frame["v"].to_numpy()
    return out


def _cells(a: np.ndarray, part: str = "") -> pd.DataFrame:
    i, j = np.indices(a.shape)
    out = pd.DataFrame({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "v": a.ravel()})
    return out.assign(part=part) if part else out


def side_of(a: DataFrame, shape: tuple[int, int] | None = None) -> int:
    """The side of a square matrix of at most MAX_SIDE, before any cell of it is gathered."""
    h, w = shape or tuple(int(x or 0) for x in a.agg(F.max("i") + 1, F.max("j") + 1).first())
    if h != w:
        raise ValueError(f"not square: {(h, w)}")
    if h > MAX_SIDE:
        raise ValueError(f"a side of {h}: factorisations take {MAX_SIDE} at most")
    return h


def _gathered(a: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return a.groupBy().applyInPandas(lambda frame: f(frame), schema)


def inverse(a: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    n = side_of(a, shape)
    return _gathered(a, lambda x: _cells(inverse_dense(_dense(x, n))), "i int, j int, v double")


def lu_inverse(a: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """Through the factorisation and substitution."""
    n = side_of(a, shape)

    def f(x: pd.DataFrame) -> pd.DataFrame:
        order, lu, _ = plu_dense(_dense(x, n))
        return _cells(solve_plu(order, lu, np.eye(n)))

    return _gathered(a, f, "i int, j int, v double")


def plu(a: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """(part, i, j, v): part 'P' with P A = L U, and 'LU' packed."""
    n = side_of(a, shape)

    def f(x: pd.DataFrame) -> pd.DataFrame:
        order, lu, _ = plu_dense(_dense(x, n))
        return pd.concat([_cells(np.eye(len(lu))[order], "P"), _cells(lu, "LU")])[["part", "i", "j", "v"]]

    return _gathered(a, f, "part string, i int, j int, v double")


def det(a: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    n = side_of(a, shape)
    return _gathered(a, lambda x: pd.DataFrame({"v": [det_dense(_dense(x, n))]}), "v double")


def solve(a: DataFrame, b: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """x (i, v) with A x = b."""
    n = side_of(a, shape)
    both = a.select("i", "j", "v").unionByName(b.select("i", F.lit(-1).alias("j"), "v"))

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        side = frame["j"] < 0
        m = _dense(frame[~side], n)
        right = np.zeros(n)
        right[frame["i"][side].to_numpy()] = frame["v"][side].to_numpy()
        order, lu, _ = plu_dense(m)
        x = solve_plu(order, lu, right)
        return pd.DataFrame({"i": np.arange(len(x), dtype=np.int32), "v": x})

    return _gathered(both, f, "i int, v double")


def blocks(a: DataFrame, side: int) -> DataFrame:
    """(bi, bj, cells) tiles of at most side x side cells from (i, j, v); cells are (row * side + column, v)."""
    key = (F.col("i") % side) * side + F.col("j") % side
    tile = [F.expr(f"cast(i div {side} as int)").alias("bi"), F.expr(f"cast(j div {side} as int)").alias("bj")]
    return a.select(*tile, F.struct(key.cast("int").alias("k"), "v").alias("cell")).groupBy("bi", "bj").agg(F.collect_list("cell").alias("cells"))


def _tile(k: np.ndarray, v: np.ndarray, side: int) -> np.ndarray:
    out = np.zeros(side * side)
    out[k] = v
    return out.reshape(side, side)


def _there(k: np.ndarray, side: int) -> np.ndarray:
    """1 where a tile has a cell."""
    return _tile(k, np.ones(len(k)), side)


def block_matmul(a: DataFrame, b: DataFrame, side: int = 256) -> DataFrame:
    """a b of (i, j, v) matrices by tiles: 2 * side**3 operations for each 16 * side**2 bytes that move.

    A cell is there, zero or not, wherever a row of a and a column of b have a cell in common, as in coo.matmul.
    """
    left = blocks(a, side).select("bi", F.col("bj").alias("bk"), F.col("cells").alias("x"))
    right = blocks(b, side).select(F.col("bi").alias("bk"), "bj", F.col("cells").alias("y"))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(batch.schema.get_field_index("x")), batch.column(batch.schema.get_field_index("y"))
            bi, bj = batch.column(batch.schema.get_field_index("bi")).to_pylist(), batch.column(batch.schema.get_field_index("bj")).to_pylist()
            for r in range(batch.num_rows):
                p, q = _pair(x[r].values), _pair(y[r].values)
                m = _tile(*p, side) @ _tile(*q, side)
                i, j = np.nonzero(_there(p[0], side) @ _there(q[0], side))
                cols = [pa.array((bi[r] * side + i).astype(np.int32)), pa.array((bj[r] * side + j).astype(np.int32)), pa.array(m[i, j])]
                yield pa.RecordBatch.from_arrays(cols, ["i", "j", "v"])

    return left.join(right, "bk").select("bi", "bj", "x", "y").mapInArrow(product, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def _pair(cells: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    return cells.field(0).to_numpy(), cells.field(1).to_numpy()


TILE = "bi int, bj int, tile array<double>"


def dense_tiles(spark: SparkSession, h: int, w: int, side: int, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(bi, bj, tile) of the h x w matrix f(i, j), made where the tiles will be; edge tiles are padded with zeros."""
    across = -(-w // side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                bi, bj = divmod(t, across)
                i, j = np.indices((side, side))
                i, j = i + bi * side, j + bj * side
                yield _tile_row(bi, bj, np.where((i < h) & (j < w), f(i, j), 0.0))

    n = across * -(-h // side)
    return spark.range(0, n, 1, min(n, spark.sparkContext.defaultParallelism)).mapInArrow(run, TILE)


def _tile_row(bi: int, bj: int, m: np.ndarray) -> pa.RecordBatch:
    values = pa.ListArray.from_arrays(pa.array([0, m.size], pa.int32()), pa.array(np.ascontiguousarray(m, float).ravel()))
    return pa.RecordBatch.from_arrays([pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), values], ["bi", "bj", "tile"])


def tile_matmul(a: DataFrame, b: DataFrame, side: int) -> DataFrame:
    """Product of two tiled matrices, tiled: pairs of tiles move to their output tile and are added up as they come."""
    left = a.select("bi", F.col("bj").alias("bk"), F.col("tile").alias("x"))
    right = b.select(F.col("bi").alias("bk"), "bj", F.col("tile").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            bi, bj = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for r in range(batch.num_rows):
                if (bi[r], bj[r]) != at:
                    if at is not None:
                        yield _tile_row(*at, total)
                    at, total = (bi[r], bj[r]), np.zeros((side, side))
                x, y = (batch.column(c)[r].values.to_numpy().reshape(side, side) for c in (2, 3))
                total += x @ y
        if at is not None:
            yield _tile_row(*at, total)

    pairs = left.join(right, "bk").select("bi", "bj", "x", "y")
    return pairs.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(run, TILE)


def untiled(t: DataFrame, h: int, w: int, side: int) -> DataFrame:
    """(i, j, v) of a tiled matrix."""
    cells = t.select("bi", "bj", F.posexplode("tile").alias("k", "v"))
    i, j = F.expr(f"bi * {side} + k div {side}").cast("int"), F.expr(f"bj * {side} + k % {side}").cast("int")
    return cells.select(i.alias("i"), j.alias("j"), "v").where((F.col("i") < h) & (F.col("j") < w))
