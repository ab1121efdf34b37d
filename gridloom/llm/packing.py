"""Packing by minimum bin slack.

Documents are packed into sequences of ``capacity`` tokens, window by window. For each sequence the largest piece left is
set; a bitset subset-sum dynamic program over the multiset of remaining lengths then finds the fill closest to capacity,
and is walked back to how many pieces of each length make it up. A document longer than a sequence fills whole sequences
of its own, and its rest is packed with the others, so no token is dropped.

Lengths are UTF-8 bytes (the tokens of a byte-level model), unless a column has them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import col, table


@dataclass(frozen=True)
class Settings:
    """capacity: tokens of a sequence; window: documents packed together, in sequences() of at most window_bytes;
    length: column of token counts, if any."""

    capacity: int = 8192
    window: int = 1024
    window_bytes: int = 16 << 20
    length: str | None = None


def fill(lengths: dict[int, int], room: int) -> dict[int, int]:
    """Counts by length, at most those of ``lengths``, whose sum is the greatest that fits into room."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in sorted((x for x in lengths if 0 < x <= room), reverse=True):
        before, left, unit = reach, min(lengths[size], room // size), 1
        while left:
            n = min(unit, left)
            reach |= (reach << (size * n)) & mask
            left -= n
            unit *= 2
        if reach != before:
            steps.append((size, before))
        if reach >> room:
            break
    rest = reach.bit_length() - 1
    out: dict[int, int] = {}
    for size, before in reversed(steps):
        n = 0
        while not (before >> rest) & 1:
            rest -= size
            n += 1
        if n:
            out[size] = n
    return out


def pack(pieces: list[tuple[int, object]], capacity: int) -> list[list[tuple[int, object]]]:
    """Bins of (length, what) pieces of at most capacity each; pieces of equal length go in the order given."""
    by: dict[int, list] = {}
    for size, what in reversed(pieces):
        by.setdefault(size, []).append(what)
    count = {size: len(of) for size, of in by.items()}
    empty = [(0, what) for what in reversed(by.pop(0, []))]
    count.pop(0, None)
    bins = []
    while count:
        largest = max(count)
        take = {largest: 1}
        count[largest] -= 1
        for size, n in fill(count, capacity - largest).items():
            take[size] = take.get(size, 0) + n
            count[size] -= n
        bins.append([(size, by[size].pop()) for size, n in take.items() for _ in range(n)])
        count = {size: n for size, n in count.items() if n}
    # Empty documents need no room: they ride along, or make up a sequence where nothing else does.
    if empty:
        if not bins:
            bins.append([])
        bins[-1] += empty
    return bins


SCHEMA = "window string, bin int, doc_ids array<bigint>, lengths array<int>, total int, slack int"


def bins_of(sizes: list[int], s: Settings) -> list[list[tuple[int, int, int]]]:
    """Sequences of (row, start, length) from the rows' numbers of tokens."""
    out: list[list[tuple[int, int, int]]] = []
    pieces: list[tuple[int, object]] = []
    for i, n in enumerate(sizes):
        whole = n // s.capacity
        out += [[(i, k * s.capacity, s.capacity)] for k in range(whole)]
        if n % s.capacity or not n:
            pieces.append((n % s.capacity, (i, whole * s.capacity)))
    return out + [[(*what, size) for size, what in b] for b in pack(pieces, s.capacity)]


def pack_windows(rows: DataFrame, s: Settings) -> DataFrame:
    """rows (window, at, doc_id, n) to sequences. Documents of a window are taken in the order of (at, doc_id, n)."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at", "doc_id", "n"], kind="stable", na_position="last")
        ids = [None if pd.isna(x) else int(x) for x in frame["doc_id"]]
        out = bins_of([int(n) for n in frame["n"]], s)
        total = [sum(size for *_, size in b) for b in out]
        return pd.DataFrame(
            {
                "window": frame["window"].iloc[0],
                "bin": range(len(out)),
                "doc_ids": [[ids[i] for i, *_ in b] for b in out],
                "lengths": [[size for *_, size in b] for b in out],
                "total": total,
                "slack": [s.capacity - t for t in total],
            }
        )

    return rows.groupBy("window").applyInPandas(one, SCHEMA)


def token_count(docs: DataFrame, s: Settings) -> Column:
    return F.coalesce(F.greatest(col(s.length), F.lit(0)) if s.length else F.octet_length(col("text")), F.lit(0)).cast("bigint")


def windows_of(rows: DataFrame, s: Settings) -> DataFrame:
    """rows (doc_id, n) in windows: (window, at, doc_id, n), every row of rows once.

    Equal rows are counted, not listed: their places are a range of numbers, in the order of a hash of both columns, and a
    range is cut at the windows' borders. So neither null nor repeated ids make a window larger than the others.
    """
    counted = rows.groupBy("doc_id", "n").agg(F.count("*").alias("times")).withColumn("h", F.xxhash64("doc_id", "n")).withColumn("bucket", F.pmod("h", F.lit(4096)).cast("int"))
    # Two steps: a few thousand buckets in one task, and the rows of each bucket in their own.
    buckets = counted.groupBy("bucket").agg(F.sum("times").alias("all")).select("bucket", (F.sum("all").over(Window.orderBy("bucket")) - F.col("all")).alias("before"))
    within = F.sum("times").over(Window.partitionBy("bucket").orderBy("h", "doc_id", "n").rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.withColumn("within", F.coalesce(within, F.lit(0))).join(F.broadcast(buckets), "bucket").withColumn("at", F.col("before") + F.col("within"))
    window = F.explode(F.sequence(F.expr(f"at div {s.window}"), F.expr(f"(at + times - 1) div {s.window}"))).alias("w")
    cut = placed.select("doc_id", "n", "at", "times", window)
    first, stop = F.greatest(F.col("at"), F.col("w") * s.window), F.least(F.col("at") + F.col("times"), (F.col("w") + 1) * s.window)
    return cut.select(F.col("w").cast("string").alias("window"), "doc_id", "n", F.explode(F.sequence(first, stop - 1)).alias("at")).select("window", "at", "doc_id", "n")


def apply(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(window, bin, doc_ids, lengths, total, slack): one row for each sequence, over every row of docs.

    A window is a run of ``window`` rows in the order of a hash of id and length; the last has what is left. A null text
    or length counts as 0 tokens; documents of 0 tokens are listed with the last sequence of their window. Repeated rows
    are pieces of their own; rows of equal length, or without an id, are taken in the windows' order. An empty table gives
    an empty result. Other columns are ignored.
    """
    return pack_windows(windows_of(docs.select(col("doc_id").cast("bigint").alias("doc_id"), token_count(docs, s).alias("n")), s), s)


SEQUENCES = "window string, bin int, doc_ids array<bigint>, starts array<bigint>, lengths array<int>, total int, slack int, content binary"


def sequences(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(window, bin, doc_ids, starts, lengths, total, slack, content) of docs, in the order that docs have.

    A window is a run of rows of one partition and file of at most ``window`` rows and, unless one text is longer, of at
    most ``window_bytes``; no row moves. Windows are named by the file's part number and first byte, or by the partition
    where docs aren't read from files, and their own number, so that sorting by (window, bin) gives the order of the files.
    A piece is bytes start to start + length of the UTF-8 text of the document at its place in doc_ids; content has the
    bytes of all pieces one after another. Nulls, empty texts and repeated rows are as in apply.
    """
    if s.length:
        raise ValueError("sequences are made of bytes")
    part = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), "-[0-9a-f]{8}-[0-9a-f-]{27}|[.][a-z.]*$", "")
    types = (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary())
    names = ["window", "bin", "doc_ids", "starts", "lengths", "total", "slack", "content"]

    def packed(window: str, ids: list[int | None], raw: list[bytes]) -> pa.RecordBatch:
        out = bins_of([len(x) for x in raw], s)
        total = [sum(size for *_, size in b) for b in out]
        cols = [[window] * len(out), list(range(len(out))), [[ids[i] for i, *_ in b] for b in out], [[at for _, at, _ in b] for b in out]]
        cols += [[[n for *_, n in b] for b in out], total, [s.capacity - t for t in total], [b"".join(raw[i][at : at + n] for i, at, n in b) for b in out]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        partition = context.partitionId() if context else 0
        last, number, size = None, 0, 0
        ids: list[int | None] = []
        raw: list[bytes] = []
        for batch in batches:
            for name, at, doc, text in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(3).cast(pa.large_binary()).to_pylist(), strict=True):
                text = text or b""
                file = f"{name}@{at:015d}" if name else f"partition-{partition:06d}"
                if ids and (file != last or len(ids) == s.window or size + len(text) > s.window_bytes):
                    yield packed(f"{last}:{number:09d}", ids, raw)
                    ids, raw, size, number = [], [], 0, number + 1 if file == last else 0
                elif file != last:
                    number = 0
                last = file
                ids.append(doc), raw.append(text)
                size += len(text)
        if ids:
            yield packed(f"{last}:{number:09d}", ids, raw)

    rows = docs.select(part.alias("part"), F.input_file_block_start().alias("at"), col("doc_id").cast("bigint").alias("doc_id"), col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SEQUENCES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))
