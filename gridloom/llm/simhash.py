"""SimHash near-dedup by segment-popcount embedding.

A fingerprint of 256 bits (the signs of summed word hashes, each distinct word once) is cut into 128 segments of two bits.
The counts of set bits of its segments embed it into a grid, where Manhattan distance never exceeds Hamming distance.
``tables`` projections of the grid to ``segments`` coordinates each give every fingerprint its cells; the range-join takes
the pairs that share a cell, drops those whose popcounts are further apart than ``distance`` (the lower bound), and
verifies the rest exactly on all 256 bits. A pair at distance d agrees in one coordinate with probability
(1-d/256)**2 + (d/256)**2 / 2, which sets the recall: 0.90 for pairs that differ in all 40 bits, 0.97 at 36, 0.99 at 33.
Groups are the connected components of the verified pairs, so that a pair that is missed mostly meets by way of others.

A cell of more than SMALL rows is searched component by component: a row that was reached is compared only to those that
were not and, by the triangle inequality, may be near; one link tells how it was reached. Thousands of copies of a
document thereby cost about as many comparisons, not their square, and a cell gives no more links than it has rows. Only
components that are alike in 12 coordinates and yet further apart than ``distance`` are compared each with each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import bytesnp as B
from gridloom.llm.common import col, cut, map_batches, pick, table, unused

BITS, LANES = 256, 4
#: Rows of a cell up to which all pairs are compared at once.
SMALL = 64
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], B.U64)
#: For each byte value, its eight bits in eight lanes of a byte each.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(B.U64).ravel()


@dataclass(frozen=True)
class Settings:
    """distance: most differing bits of a near copy; segments: coordinates of a projection; tables: projections.

    rows: fingerprints of small cells that are joined at once; a larger cell is held whole, 40 bytes a row.
    """

    distance: int = 40
    segments: int = 12
    tables: int = 112
    rows: int = 100_000


def fingerprint(words: np.ndarray) -> np.ndarray:
    """Four words of 64 bits from the hashes of a text's distinct words."""
    n = len(words)
    lanes = _SPREAD[B.mix(words[:, None] * _SEEDS[None, :]).view(np.uint8).reshape(n, 32)]
    # Sums of 255 rows at most fit into lanes of a byte.
    part = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)
    ones = part.view(np.uint8).reshape(len(part), BITS).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view(B.U64)


def fingerprint_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (rows, 4) of the texts, and which texts have a word at all."""
    w = B.split_words(B.fold(texts), B.PUNCTUATION)
    out = np.zeros((len(texts), LANES), B.U64)
    some = np.diff(w.first) > 0
    for i in np.flatnonzero(some):
        out[i] = fingerprint(np.unique(w.hash[w.first[i] : w.first[i + 1]]))
    return out, some


def node(prints: np.ndarray) -> np.ndarray:
    """A number for each fingerprint (rows, 4)."""
    out = np.zeros(len(prints), B.U64)
    for k in range(LANES):
        out = B.mix(out + prints[:, k])
    return out.view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, node, f0..f3) by row; th tells texts under one doc_id apart. Texts without a word have no fingerprint."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, some = fingerprint_batch(batch.column(2))
        keep = pa.array(some)
        prints = prints[some]
        cols = [batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(node(prints))]
        cols += [pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(LANES)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "node", "f0", "f1", "f2", "f3"])

    rows = pick(docs, doc_id="doc_id", text="text").where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    return map_batches(rows, f, "doc_id bigint, th bigint, node bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint", 1000)


def projections(s: Settings) -> np.ndarray:
    """For each table a column of weights: 3**i at its i-th segment. The choice is fixed."""
    weights = np.zeros((BITS // 2, s.tables), np.int64)
    for t in range(s.tables):
        order = np.argsort(B.mix(np.arange(BITS // 2, dtype=B.U64) + B.U64(1 + 1000 * t)), kind="stable")
        weights[order[: s.segments], t] = 3 ** np.arange(s.segments)
    return weights


def popcounts(prints: np.ndarray) -> np.ndarray:
    """(rows, 128) counts of set bits, of two bits each."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), 32), axis=1, bitorder="little")
    return bits[:, 0::2] + bits[:, 1::2]


def cells(prints: np.ndarray, s: Settings) -> np.ndarray:
    """(rows, tables) grid cells; the table is part of the cell's number."""
    return popcounts(prints).astype(np.int64) @ projections(s) * s.tables + np.arange(s.tables)


def close_pairs(cell: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs within a cell (rows sorted by cell) at most distance apart, the bound before the distance."""
    ones = np.bitwise_count(prints).astype(np.int16)
    left, right = [], []
    alive = np.arange(len(cell))
    step = 1
    while True:
        alive = alive[alive + step < len(cell)]
        alive = alive[cell[alive] == cell[alive + step]]
        if not len(alive):
            break
        near = alive[np.abs(ones[alive] - ones[alive + step]).sum(1) <= distance]
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]).sum(1, dtype=np.int64) <= distance]
        left.append(near)
        right.append(near + step)
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def cell_links(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of linked rows of one cell: their connected components are those of all pairs at most distance apart.

    Each component starts at a row that is compared to all the rest; by the triangle inequality only such rows can be near
    a member as are about as far from that first row.
    """
    left, right = [], []
    rest = np.arange(len(prints))
    while len(rest) > 1:
        away = np.bitwise_count(prints[rest] ^ prints[rest[0]]).sum(1, dtype=np.int64)
        order = np.argsort(away, kind="stable")
        ids, away = rest[order], away[order]
        alive = np.ones(len(ids), bool)
        alive[0] = False
        todo = [0]
        while todo:
            x = todo.pop()
            lo, hi = np.searchsorted(away, [away[x] - distance, away[x] + distance + 1])
            near = lo + np.flatnonzero(alive[lo:hi])
            if len(near):
                near = near[np.bitwise_count(prints[ids[near]] ^ prints[ids[x]]).sum(1, dtype=np.int64) <= distance]
                alive[near] = False
                left.append(np.full(len(near), ids[x]))
                right.append(ids[near])
                todo += near.tolist()
        rest = np.sort(ids[alive])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def links(cell: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of rows (sorted by cell) that are linked within their cells."""
    edge = np.flatnonzero(np.diff(cell)) + 1
    first = np.concatenate([[0], edge]) if len(cell) else edge
    size = np.diff(np.append(first, len(cell)))
    few = np.flatnonzero(np.repeat(size <= SMALL, size))
    x, y = close_pairs(cell[few], prints[few], distance)
    left, right = [few[x]], [few[y]]
    for at, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        x, y = cell_links(prints[at : at + n], distance)
        left.append(x + at), right.append(y + at)
    return np.concatenate(left), np.concatenate(right)


def whole_cells(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows, or of one larger cell, that hold whole cells; batches are sorted by cell, the first column."""
    ready: list[pa.RecordBatch] = []
    tail: list[pa.RecordBatch] = []
    waiting, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column(0).to_numpy()
        if c[-1] != last:
            # All that went before the batch's last cell is whole.
            whole = int(np.searchsorted(c, c[-1]))
            ready += [*tail, batch.slice(0, whole)]
            waiting += sum(b.num_rows for b in tail) + whole
            tail, last = [batch.slice(whole)], c[-1]
            if waiting >= rows:
                yield pa.Table.from_batches(ready)
                ready, waiting = [], 0
        else:
            tail.append(batch)
    if ready or tail:
        yield pa.Table.from_batches(ready + tail)


def near_links(prints: DataFrame, s: Settings) -> DataFrame:
    """(a, b), a < b, of distinct nodes of prints (f0..f3) within the distance; what is near is connected by them.

    Only the cell and the fingerprint move: the node's number follows from the latter. Rows go out table by table, so that
    what a shuffle block compresses to doesn't depend on how many blocks there are.
    """

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = np.stack([batch.column(k).to_numpy() for k in range(LANES)], 1).view(B.U64)
        at = np.tile(np.arange(len(f)), s.tables)
        cell = cells(np.ascontiguousarray(f), s).T.ravel()
        cols = [pa.array(np.ascontiguousarray(cell))] + [pa.array(f[at, k].view(np.int64)) for k in range(LANES)]
        return pa.RecordBatch.from_arrays(cols, ["cell", "f0", "f1", "f2", "f3"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_cells(batches, s.rows):
            f = np.ascontiguousarray(np.stack([t.column(1 + k).to_numpy() for k in range(LANES)], 1).view(B.U64))
            x, y = links(t.column(0).to_numpy(), f, s.distance)
            a, b = node(f[x]), node(f[y])
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    grid = map_batches(prints.select("f0", "f1", "f2", "f3"), explode, "cell bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint", 2000)
    return grid.repartition("cell").sortWithinPartitions("cell").mapInArrow(join, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): alternating large-star and small-star steps until nothing changes.

    Each round is stored reliably; rounds grow with the logarithm of the largest component's diameter.
    """
    edges = cut(edges.where("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct())
    state = None
    while True:
        # Large star: every larger neighbour of u gets the least of u's neighbourhood.
        both = edges.union(edges.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        # Small star: u and its smaller neighbours get the least of those.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v as u", "m as v").union(low.selectExpr("u", "m as v"))
        edges = cut(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.selectExpr("u as node", "v as root").union(edges.selectExpr("v as node", "v as root").distinct())
        state = tuple(now)


def groups(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, th, root) of every row that has a near copy; root names the group."""
    rows = cut(fingerprints(docs))
    nodes = rows.groupBy("node").agg(*[F.first(f"f{k}").alias(f"f{k}") for k in range(LANES)], F.count("*").alias("n"))
    roots = components(near_links(nodes, s))
    # Rows of one fingerprint form a group without any pair.
    alone = nodes.where("n > 1").select("node").join(roots, "node", "left_anti").selectExpr("node", "node as root")
    return rows.select("doc_id", "th", "node").join(roots.union(alone), "node").select("doc_id", "th", "root")


def apply(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, keep_doc_id, copies): every row in a group of near copies, and the row of its group that stays.

    The row with the least doc_id of a group stays (null ids after all others); copies is the group's size in rows.
    Documents without a near copy aren't in the result. Null texts and texts without a word have no copies; equal texts
    always are copies; rows that repeat an id count as rows of their own. An empty table gives an empty result. Other
    columns are ignored.
    """
    found = groups(docs, s)
    best = found.groupBy("root").agg(F.min("doc_id").alias("keep_doc_id"), F.count("*").alias("copies"))
    return found.join(best, "root").select("doc_id", "keep_doc_id", "copies")


def keep(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs, all its columns whatever their names, with one row of each group of near copies: the least doc_id (nulls
    last), then the least text hash.

    Rows without a word all stay. Of rows that repeat both id and text one stays, by the hash of its other columns.
    """
    ordered = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))
    found = groups(docs, s).select("root", ordered.alias("row"))
    best = found.groupBy("root").agg(F.min("row").alias("best"))
    key, none, th, first, place = unused(docs, "key", "none", "th", "first", "place")
    # Join and numbering agree in their keys, so that rows move once.
    verdict = found.distinct().join(best, "root").select(F.coalesce("row.doc_id", F.lit(0)).alias(key), F.col("row.none").alias(none), F.col("row.th").alias(th), (F.col("row") == F.col("best")).alias(first))
    keyed = docs.select("*", F.coalesce(col("doc_id"), F.lit(0)).alias(key), col("doc_id").isNull().alias(none), F.xxhash64(col("text")).alias(th))
    joined = keyed.join(verdict, [key, none, th], "left")
    number = F.row_number().over(Window.partitionBy(key, none, th).orderBy(F.xxhash64(*[col(c) for c in docs.columns])))
    return joined.withColumn(place, number).where(col(first).isNull() | (col(first) & (col(place) == 1))).select(*[col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))
