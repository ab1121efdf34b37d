"""Sharding along a Hilbert curve, for pruning of files by several metadata columns at once.

Each column is quantised to 2**bits codes of about equally many rows (equal values never part; null is less than all).
The codes are a cell's coordinates, and a cell's index on the Hilbert curve its place in the order. Cells are cut into
runs of about ``target_bytes`` along the curve; a cell larger than that is spread over as many shards as it needs.
A shard's rows lie close together in every column, so that the minima and maxima of its file exclude it from most queries.

Cells are at most 2**(bits * columns), whatever the table's size and 2**20 at most, so the table of cells may be sorted by
one task and broadcast; rows move once, to their shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import col, cut, map_batches, table, unused

#: Most bits of all columns together: the table of cells (40 bytes a row) is broadcast.
CELL_BITS = 20


@dataclass(frozen=True)
class Settings:
    columns: tuple[str, ...] = ("source", "lang", "n_chars")
    bits: int = 6
    target_bytes: int = 32 << 20
    max_partitions: int = 100_000


def hilbert(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of coordinates (rows, dimensions), by Skilling's transposition."""
    x = [c.astype(np.int64).copy() for c in coordinates.T]
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    index = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | (((x[i] ^ t) >> b) & 1)
    return index


def codes(docs: DataFrame, name: str, bits: int) -> Column:
    """The code of column ``name``: which of 2**bits parts of equally many rows its value falls into.

    Distinct values are counted range by range, so that a column of very many needs no single task. Only the least value
    of each code reaches the driver.
    """
    counts = docs.groupBy(col(name).alias("v")).agg(F.count("*").alias("n"))
    ranged = cut(counts.repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("p")))
    # One row for each partition.
    ranges = ranged.groupBy("p").agg(F.sum("n").alias("all")).selectExpr("p", "sum(all) over (order by p) - all as earlier", "sum(all) over () as total")
    within = "coalesce(sum(n) over (partition by p order by v nulls first rows between unbounded preceding and 1 preceding), 0)"
    before = ranged.join(F.broadcast(ranges), "p").selectExpr("v", f"earlier + {within} as b", "total")
    coded = before.where("v is not null").selectExpr("v", f"cast(b * {1 << bits} div total as int) as code")
    bounds = coded.groupBy("code").agg(F.min("v").alias("v")).orderBy(F.col("code").desc()).collect()
    if not bounds:
        return F.lit(0)
    value = col(name)
    out = F.when(value >= F.lit(bounds[0]["v"]), bounds[0]["code"])
    for r in bounds[1:]:
        out = out.when(value >= F.lit(r["v"]), r["code"])
    return out.otherwise(0)


def size(docs: DataFrame) -> Column:
    return F.coalesce(F.octet_length(col("text")), F.lit(0)).cast("bigint")


def spread(docs: DataFrame) -> Column:
    """A number of 28 bits from a row's id, if there is one, and text, so that rows without an id spread as well."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("null")) for c in ("doc_id", "text") if c in docs.columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 7), 16, 10).cast("bigint")


def place(docs: DataFrame, s: Settings) -> tuple[DataFrame, int]:
    """docs with columns curve_index and shard_id, not yet moved; and how many shards there are."""
    d = len(s.columns)
    if s.bits * d > CELL_BITS:
        raise ValueError(f"more than {CELL_BITS} bits")
    own = [c for c in docs.columns if c.lower() not in ("curve_index", "shard_id")]
    packed: Column = F.lit(0).cast("bigint")
    for name in s.columns:
        packed = packed * (1 << s.bits) + codes(docs, name, s.bits)
    cells = docs.select(packed.alias("cell"), size(docs).alias("bytes")).groupBy("cell").agg(F.sum("bytes").alias("bytes"))

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell = batch.column(0).to_numpy()
        at = np.stack([(cell >> (s.bits * (d - 1 - i))) & ((1 << s.bits) - 1) for i in range(d)], 1)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert(at, s.bits))], ["cell", "bytes", "h"])

    on_curve = map_batches(cells, index, "cell bigint, bytes bigint, h bigint")
    cell, number, held, start, pieces, at = unused(docs, "cell", "spread", "bytes", "start", "pieces", "at")
    runs = cut(
        on_curve.selectExpr(
            f"cell as {cell}",
            "h as curve_index",
            f"bytes as {held}",
            f"coalesce(sum(bytes) over (order by h rows between unbounded preceding and 1 preceding), 0) as {start}",
            f"greatest(1, cast(round(bytes / cast({s.target_bytes} as double)) as bigint)) as {pieces}",
        )
    )
    total = runs.agg(F.sum(held)).first()[0] or 0
    joined = docs.select(*[col(c) for c in own], packed.alias(cell), spread(docs).alias(number)).join(F.broadcast(runs), cell)
    joined = joined.withColumn(at, F.expr(f"{start} + (2 * ({number} % {pieces}) + 1) * {held} div (2 * {pieces})"))
    return joined.select(*[col(c) for c in own], "curve_index", F.expr(f"{at} div {s.target_bytes}").alias("shard_id")), total // s.target_bytes + 1


def apply(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs, all rows and columns, with curve_index and shard_id: each shard in one partition, in curve order within.

    A partition holds one shard, or a run of them where there are more than max_partitions. Columns of these two names
    in docs are replaced; others may have any name. Nulls of a dimension have the least code, and null texts no bytes;
    rows with equal dimensions share a cell. A shard has at most twice target_bytes, but for texts that are longer and for
    rows that repeat both id and text, which stay together. An empty table gives an empty result.
    """
    placed, shards = place(docs, s)
    n = min(shards, s.max_partitions)
    moved = placed.repartitionById(n, F.expr(f"cast(shard_id * {n} div {shards} as int)"))
    return moved.sortWithinPartitions("shard_id", "curve_index", *([col("doc_id")] if "doc_id" in placed.columns else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))


def sql(s: Settings = Settings()) -> str:
    """The same for DuckDB: the transposition step by step, each a common table expression."""
    d, bits = len(s.columns), s.bits
    steps: list[str] = []

    def step(**new: str) -> None:
        steps.append(", ".join(f"{e} AS {n}" for n, e in new.items()))

    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            if i == 0:
                step(x0=f"CASE WHEN x0 & {q} <> 0 THEN xor(x0, {p}) ELSE x0 END")
            else:
                t = f"CASE WHEN x{i} & {q} <> 0 THEN 0 ELSE xor(x0, x{i}) & {p} END"
                step(**{"x0": f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {p}) ELSE xor(x0, {t}) END", f"x{i}": f"xor(x{i}, {t})"})
        q >>= 1
    for i in range(1, d):
        step(**{f"x{i}": f"xor(x{i}, x{i - 1})"})
    q = 1 << (bits - 1)
    while q > 1:
        step(t=f"CASE WHEN x{d - 1} & {q} <> 0 THEN xor(t, {q - 1}) ELSE t END")
        q >>= 1
    index = " + ".join(f"((xor(x{i}, t) >> {b}) & 1) * {1 << (b * d + d - 1 - i)}" for b in range(bits) for i in range(d))
    dims = "".join(
        f"""b{i} AS (SELECT v, CAST(b * {1 << bits} // total AS BIGINT) AS code FROM (SELECT {c} AS v,
  coalesce(sum(count(*)) OVER (ORDER BY {c} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
  sum(count(*)) OVER () AS total FROM documents GROUP BY {c})),
"""
        for i, c in enumerate(s.columns)
    )
    chain = "s0 AS (SELECT *, x0 AS c0" + "".join(f", x{i} AS c{i}" for i in range(1, d)) + ", CAST(0 AS BIGINT) AS t FROM cells)"
    for k, new in enumerate(steps):
        chain += f",\ns{k + 1} AS (SELECT * REPLACE ({new}) FROM s{k})"
    joins = " ".join(f"JOIN b{i} ON documents.{c} IS NOT DISTINCT FROM b{i}.v" for i, c in enumerate(s.columns))
    return f"""
WITH {dims}coded AS (SELECT documents.*, {", ".join(f"b{i}.code AS x{i}" for i in range(d))} FROM documents {joins}),
cells AS (SELECT {", ".join(f"x{i}" for i in range(d))}, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM coded GROUP BY ALL),
{chain},
curve AS (SELECT {", ".join(f"c{i}" for i in range(d))}, bytes, {index} AS h FROM s{len(steps)}),
runs AS (SELECT *, CAST(coalesce(sum(bytes) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  greatest(1, CAST(round(bytes / CAST({s.target_bytes} AS DOUBLE)) AS BIGINT)) AS k FROM curve)
SELECT coded.* EXCLUDE ({", ".join(f"x{i}" for i in range(d))}), CAST(h AS BIGINT) AS curve_index,
  CAST((start + (2 * (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, 'null')), 1, 7) AS BIGINT) % k) + 1) * bytes // (2 * k)) // {s.target_bytes} AS BIGINT) AS shard_id
FROM coded JOIN runs ON {" AND ".join(f"coded.x{i} = runs.c{i}" for i in range(d))}
"""
