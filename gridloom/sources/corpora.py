"""Image corpora as DataFrames (sample_id, label, x, h, w, c), x the scaled H*W*C values, and mini-batches of them.

Files are read whole by Spark's binary reader (a corpus of many files is read in parallel) and decoded in Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.session import scratch

SCHEMA = "sample_id bigint, label int, x array<double>, h int, w int, c int"
IDX_IMAGES, IDX_LABELS = 0x803, 0x801
CIFAR_SIDE, CIFAR_CHANNELS = 32, 3
CIFAR_RECORD = 1 + CIFAR_SIDE * CIFAR_SIDE * CIFAR_CHANNELS


def scaled(pixels: np.ndarray, mean: float, scale: float) -> np.ndarray:
    if abs(scale) < 1e-6:
        scale = 1.0
    return (pixels.astype(float) - mean) / scale


def idx_images(data: bytes) -> np.ndarray:
    """(count, H, W) bytes."""
    magic, n, h, w = struct.unpack_from(">IIII", data)
    if magic != IDX_IMAGES or len(data) != 16 + n * h * w:
        raise ValueError("not an IDX image file")
    return np.frombuffer(data, np.uint8, n * h * w, 16).reshape(n, h, w)


def idx_labels(data: bytes) -> np.ndarray:
    magic, n = struct.unpack_from(">II", data)
    if magic != IDX_LABELS or len(data) != 8 + n:
        raise ValueError("not an IDX label file")
    return np.frombuffer(data, np.uint8, n, 8)


def cifar(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Labels, and images (count, 32, 32, 3) out of one plane for each colour."""
    if len(data) % CIFAR_RECORD:
        raise ValueError("not whole records")
    r = np.frombuffer(data, np.uint8).reshape(-1, CIFAR_RECORD)
    return r[:, 0], r[:, 1:].reshape(-1, CIFAR_CHANNELS, CIFAR_SIDE, CIFAR_SIDE).transpose(0, 2, 3, 1)


def _batch(first: int, labels: np.ndarray, images: np.ndarray, mean: float, scale: float) -> Iterator[pa.RecordBatch]:
    n, h, w, c = images.shape
    for lo in range(0, n, 4096):
        x = scaled(images[lo : lo + 4096].reshape(-1, h * w * c), mean, scale)
        k = len(x)
        off = pa.array(np.arange(0, x.size + 1, h * w * c, dtype=np.int32))
        same = [pa.array(np.full(k, v, np.int32)) for v in (h, w, c)]
        ids = pa.array(np.arange(first + lo, first + lo + k, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([ids, pa.array(labels[lo : lo + k].astype(np.int32)), pa.ListArray.from_arrays(off, pa.array(x.ravel())), *same], ["sample_id", "label", "x", "h", "w", "c"])


def read_idx(spark: SparkSession, images: str, labels: str, mean: float = 0.0, scale: float = 256.0) -> DataFrame:
    """An image file and its label file; differing counts are an error."""
    pair = spark.read.format("binaryFile").load(images).select(F.col("content").alias("a")).crossJoin(spark.read.format("binaryFile").load(labels).select(F.col("content").alias("b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, y = idx_images(b.column(0)[i].as_py()), idx_labels(b.column(1)[i].as_py())
                if len(x) != len(y):
                    raise ValueError(f"{len(x)} images, {len(y)} labels")
                yield from _batch(0, y, x[..., None], mean, scale)

    return pair.mapInArrow(run, SCHEMA)


def read_cifar(spark: SparkSession, path: str, mean: float = 0.0, scale: float = 256.0) -> DataFrame:
    """One file or a folder of them; samples are numbered through the files in order of their names."""
    files = spark.read.format("binaryFile").load(path)
    starts = files.select("path", (F.col("length") / CIFAR_RECORD).cast("bigint").alias("n"))
    starts = starts.select("path", (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                y, x = cifar(b.column(0)[i].as_py())
                yield from _batch(b.column(1)[i].as_py(), y, x, mean, scale)

    return files.join(starts, "path").select("content", "first").mapInArrow(run, SCHEMA)


REGISTRY: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register(name: str, reader: Callable[[SparkSession], DataFrame]) -> None:
    """Name a corpus, such as mnist_train, for dataset()."""
    REGISTRY[name] = reader


def samples(spark: SparkSession, name: str) -> DataFrame:
    """A registered corpus."""
    if name not in REGISTRY:
        raise KeyError(f"no corpus {name}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](spark)


def dataset(spark: SparkSession, name: str, batch: int, order: str = "sample_id") -> DataFrame:
    """A registered corpus in mini-batches."""
    return batched(samples(spark, name), batch, order)


class Ordered:
    """The rows of df in the order of a column, written once, in ranges that are each sorted and numbered.

    A batch is read from the ranges that hold it, so that a pass over all batches sorts once. Ranges are cut by a sample: a
    plan that makes them twice can cut them at two places, so that rows' numbers and the sizes of the ranges before them must
    come from the same files.
    """

    def __init__(self, df: DataFrame, order: str) -> None:
        spark = df.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = df.repartitionByRange(parts, order).withColumn("__p", F.spark_partition_id()).sortWithinPartitions("__p", order)
        marked = ranged.withColumn("__m", F.monotonically_increasing_id() % F.lit(1 << 33))
        path = scratch(spark)
        marked.write.partitionBy("__p").parquet(path)
        self.rows = spark.read.schema(marked.schema).parquet(path)
        #: (range, rows before it, its rows), in order.
        self.ranges: list[tuple[int, int, int]] = []
        self.n = 0
        for p, n in sorted(tuple(r) for r in self.rows.groupBy("__p").count().collect()):
            self.ranges.append((p, self.n, n))
            self.n += n

    def batch(self, k: int, size: int) -> DataFrame:
        """Rows k * size to (k + 1) * size, the last batch may be partial; beyond it there are none."""
        whole, pieces = [], []
        for p, before, n in self.ranges:
            lo, hi = max(0, k * size - before), min(n, (k + 1) * size - before)
            if lo == 0 and hi == n:
                whole.append(p)
            elif lo < hi:
                pieces.append((F.col("__p") == p) & (F.col("__m") >= lo) & (F.col("__m") < hi))
        if whole or not pieces:
            pieces.append(F.col("__p").isin(whole))
        return reduce(DataFrame.union, [self.rows.where(x) for x in pieces]).drop("__p", "__m")


def batched(df: DataFrame, size: int, order: str, dense: bool = False) -> DataFrame:
    """df with batch_id: ``size`` consecutive samples each, the last may be partial.

    With dense ids from 0 (dense=True) a row knows its batch. Otherwise samples are counted in two steps, by range and within,
    so that no single task sorts them all.
    """
    if dense:
        return df.withColumn("batch_id", F.expr(f"cast({order} div {size} as bigint)"))
    ordered = Ordered(df, order)
    before = df.sparkSession.createDataFrame([r[:2] for r in ordered.ranges], "__p int, __b bigint")
    return ordered.rows.join(F.broadcast(before), "__p").withColumn("batch_id", F.expr(f"(__b + __m) div {size}")).drop("__p", "__m", "__b")


def fetch(df: DataFrame, k: int) -> DataFrame:
    """Batch k; an empty result means the corpus is done."""
    return df.where(F.col("batch_id") == k)


def normalize(x: Column, mean: float, scale: float) -> Column:
    """(x - mean) / scale of an array; a scale of about 0 counts as 1."""
    scale = 1.0 if abs(scale) < 1e-6 else scale
    return F.transform(x, lambda e: (e - mean) / scale)


def tensor_bytes(n: int, h: int, w: int, c: int, values: np.ndarray) -> bytes:
    """Raw tensor file: mark, shape, values times 256 as bytes."""
    return b"T4" + struct.pack("<4I", h, w, c, n) + np.clip(np.asarray(values, float) * 256, 0, 255).astype(np.uint8).tobytes()


def tensor_from_bytes(data: bytes) -> tuple[tuple[int, int, int, int], np.ndarray]:
    if data[:2] != b"T4":
        raise ValueError("not a raw tensor")
    h, w, c, n = struct.unpack_from("<4I", data, 2)
    return (n, h, w, c), np.frombuffer(data, np.uint8, n * h * w * c, 18).astype(float) / 256
