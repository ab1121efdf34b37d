"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are ordered by a hash of id and text and cut into blocks. Block i (from 1) of a source of weight w is released at
slot floor((i-1)/w) and due at ceil(i/w); each slot serves, of the released blocks, the one due first. Weights are
multiples of 1/cycle that sum to 1, so that the schedule repeats after ``cycle`` slots: it is worked out once, for one
cycle, and every row finds its slot by arithmetic. At each slot every source is less than one block from its share.

When a source runs out its slots fall away, and the others keep their proportions to each other. No row is left out. The
schedule is made in the driver and has at least eight slots for each source, so sources should be thousands, not millions.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import col, table, unused


@dataclass(frozen=True)
class Settings:
    """weights by source, or None for count**temper; block: rows; cycle: slots, doubled until there are eight for each
    source and no source's share is less than one slot."""

    weights: Mapping[str | None, float] | None = None
    temper: float = 0.7
    block: int = 16
    cycle: int = 1024


def whole_weights(weights: Mapping[str | None, float], cycle: int) -> tuple[dict[str | None, int], int]:
    """Slots of a cycle for each source: largest remainders, one at least; and the cycle's length."""
    if not weights:
        return {}, cycle
    if min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    # The least weight has a slot of its own, up to 2**20 slots; below that it is served too often.
    while cycle < 8 * len(weights) or cycle * min(weights.values()) < sum(weights.values()) and cycle < 1 << 20:
        cycle *= 2
    names = sorted(weights, key=lambda n: (n is None, n or ""))
    total = sum(weights.values())
    share = {n: weights[n] / total * cycle for n in names}
    slots = {n: max(1, int(share[n])) for n in names}
    rest = cycle - sum(slots.values())
    order = sorted(names, key=lambda n: slots[n] - share[n])
    for n in order[: max(0, rest)]:
        slots[n] += 1
    for n in reversed(order * (1 + cycle // len(order))):
        if sum(slots.values()) == cycle:
            break
        if slots[n] > 1:
            slots[n] -= 1
    return slots, cycle


def schedule(slots: Mapping[str | None, int], cycle: int) -> list[tuple[str | None, int, int]]:
    """(source, block of the cycle from 0, slot) of one cycle, by earliest deadline among the released; ties by name."""
    rank = {n: k for k, n in enumerate(sorted(slots, key=lambda n: (n is None, n or "")))}
    waiting = [(0, rank[n], n, 0) for n in slots]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for t in range(cycle if slots else 0):
        while waiting and waiting[0][0] <= t:
            _, r, n, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * cycle // slots[n]), r, n, i))
        _, r, n, i = heapq.heappop(ready)
        out.append((n, i, t))
        if i + 1 < slots[n]:
            heapq.heappush(waiting, ((i + 1) * cycle // slots[n], r, n, i + 1))
    return out


def key() -> Column:
    """A row's place in its source: 32 hexadecimal digits from id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(col("doc_id").cast("string"), F.lit("null")), F.coalesce(col("text"), F.lit("null"))))


def placed(docs: DataFrame, keep: list[str], s: Settings) -> tuple[DataFrame, str, str, str]:
    """The columns ``keep`` of docs with a rank, a block and a slot, and the names of these three.

    A source is ranked bucket by bucket of the key, so that a hot source needs no single task. Rows of one key are told
    apart by all that is kept; those that are equal throughout take the places of one another.
    """
    spark = docs.sparkSession
    h, bucket, source, none, rank, block, slot, before, cycles, turn, start = unused(docs, "h", "bucket", "of_source", "no_source", "rank", "block", "slot", "before", "per_cycle", "turn", "at_turn")
    # Windows and joins agree in their keys, so that rows move once for all of them.
    named = [F.coalesce(col("source").cast("string"), F.lit("")).alias(source), col("source").isNull().alias(none)]
    rows = docs.select(*[col(c) for c in keep], *named, key().alias(h)).withColumn(bucket, F.substring(col(h), 1, 3))
    counts = docs.select(*named, F.substring(key(), 1, 3).alias(bucket)).groupBy(source, none, bucket).agg(F.count("*").alias("n"))
    earlier = counts.withColumn(before, F.sum("n").over(Window.partitionBy(source, none).orderBy(bucket)) - F.col("n")).drop("n")
    by_source = {None if r[1] else r[0]: r[2] for r in counts.groupBy(source, none).agg(F.sum("n").alias("n")).collect()}
    weights = {n: s.weights.get(n, 0) if s.weights is not None else c**s.temper for n, c in by_source.items()}
    missing = [n for n, w in weights.items() if not w > 0]
    if missing:
        raise ValueError(f"sources without a weight: {missing[:5]}")
    share, cycle = whole_weights(weights, s.cycle)
    # A row for each slot of the cycle, which the driver has made: small enough to broadcast.
    plan = pd.DataFrame([(n or "", n is None, share[n], i, t) for n, i, t in schedule(share, cycle)], columns=[source, none, cycles, turn, start])
    plan = F.broadcast(spark.createDataFrame(plan, f"{source} string, {none} boolean, {cycles} int, {turn} bigint, {start} int"))
    shares = F.broadcast(spark.createDataFrame(pd.DataFrame([(n or "", n is None, c) for n, c in share.items()], columns=[source, none, cycles]), f"{source} string, {none} boolean, {cycles} int"))
    rest = [F.xxhash64(*[col(c) for c in keep])] if keep else []
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(source, none, bucket).orderBy(h, *rest)))
    ranked = ranked.join(earlier, [source, none, bucket]).withColumn(rank, (col(before) + col(rank)).cast("bigint"))
    ranked = ranked.join(shares, [source, none]).withColumn(block, F.floor((col(rank) - 1) / s.block).cast("bigint"))
    ranked = ranked.withColumn(turn, col(block) % col(cycles))
    done = ranked.join(plan, [source, none, cycles, turn])
    done = done.withColumn(slot, (F.floor(col(block) / col(cycles)) * cycle + col(start)).cast("bigint"))
    return done.select(*[col(c) for c in keep], col(rank), col(block), col(slot)), rank, block, slot


def apply(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, source, rank, block, slot) of every row: the mix is their order by slot, then rank.

    A null source is a source of its own; a source without a positive weight is an error. Repeated rows take places one
    after the other; null ids and texts are ordered by what they have. An empty table gives an empty result. Other
    columns are ignored.
    """
    rows, rank, block, slot = placed(docs, ["doc_id", "source"], s)
    return rows.select(col("doc_id"), col("source"), col(rank).alias("rank"), col(block).alias("block"), col(slot).alias("slot"))


def order(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs, all rows and columns whatever their names, as partitions in the order of the mix, each sorted.

    Written as Parquet, the part files by number and the rows in each are the mix. Every row has its own place, rows that
    repeat too. Columns of maps can't be ordered and are an error.
    """
    rows, rank, _, slot = placed(docs, docs.columns, s)
    return rows.repartitionByRange(col(slot), col(rank)).sortWithinPartitions(col(slot), col(rank)).select(*[col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))


def sql(s: Settings = Settings()) -> str:
    """The same for DuckDB, for the default weights and up to cycle / 8 sources: the schedule slot by slot."""
    released = f"floor(done * {s.cycle} / share) <= t"
    return f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS c FROM documents GROUP BY source),
w AS (SELECT source, pow(c, {s.temper}) / sum(pow(c, {s.temper})) OVER () * {s.cycle} AS exact FROM n),
f AS (SELECT source, exact, CAST(greatest(1, floor(exact)) AS BIGINT) AS base FROM w),
shares AS (SELECT source, base + CASE WHEN row_number() OVER (ORDER BY base - exact, source NULLS LAST) <= {s.cycle} - sum(base) OVER () THEN 1 ELSE 0 END AS share FROM f),
steps AS (
  SELECT 0 AS t, source, share, CAST(0 AS BIGINT) AS done, false AS served FROM shares
  UNION ALL
  SELECT t + 1, source, share, done + CASE WHEN place = 1 THEN 1 ELSE 0 END, place = 1
  FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN {released} THEN 0 ELSE 1 END, ceil((done + 1) * {s.cycle} / share), source NULLS LAST) AS place FROM steps)
  WHERE t < {s.cycle}),
turns AS (SELECT source, share, done - 1 AS turn, t - 1 AS t FROM steps WHERE served),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, 'null'))) AS rank FROM documents)
SELECT doc_id, r.source, rank, (rank - 1) // {s.block} AS block, CAST((rank - 1) // {s.block} // share * {s.cycle} + t AS BIGINT) AS slot
FROM ranked r JOIN turns ON r.source IS NOT DISTINCT FROM turns.source AND (rank - 1) // {s.block} % share = turn
"""
