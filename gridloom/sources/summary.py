"""Summaries of a run: append-only tables of scalars, texts, histograms, images, tiles, embeddings and graphs; PNG and
record framing for those who want files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import write_bytes


class Run:
    """A folder of summary tables; ``step`` is stamped on all that is written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.step = spark, path, 0

    def at(self, step: int) -> Run:
        self.step = step
        return self

    def _append(self, kind: str, df: DataFrame) -> None:
        df.withColumn("step", F.lit(self.step).cast("bigint")).withColumn("wall_time", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/{kind}")

    def scalar(self, tag: str, value: float) -> None:
        self._append("scalar", self.spark.createDataFrame([(tag, float(value))], "tag string, value double"))

    def text(self, tag: str, text: str) -> None:
        self._append("text", self.spark.createDataFrame([(tag, text)], "tag string, text string"))

    def histogram(self, tag: str, df: DataFrame, value: str, buckets: int) -> None:
        self._append("histogram", histogram(df, value, buckets).withColumn("tag", F.lit(tag)))

    def image(self, tag: str, df: DataFrame) -> None:
        self._append("image", pixels(df).withColumn("tag", F.lit(tag)))

    def tile(self, tag: str, df: DataFrame, wide: int, h: int, w: int) -> None:
        self._append("tile", tile(df, wide, h, w).withColumn("tag", F.lit(tag)))

    def embed(self, tag: str, df: DataFrame, key: str, x: str) -> None:
        """Values tab by tab and the samples' names, two texts in the same order, and what a projector needs to find them."""
        rows = df.select(F.concat(F.lit(f"{tag}."), F.col(key).cast("string")).alias("name"), F.array_join(F.transform(x, lambda e: e.cast("string")), "\t").alias("values"))
        # Both are written in the order of (name, values), which doesn't depend on how rows came.
        for column, folder in (("values", "tensors"), ("name", "metadata")):
            rows.orderBy("name", "values").select(column).write.mode("append").text(f"{self.path}/embed/{tag}/{folder}")
        at = f"{self.path}/embed/{tag}"
        config = f'embeddings {{\n  tensor_name: "{tag}"\n  tensor_path: "{at}/tensors"\n  metadata_path: "{at}/metadata"\n}}\n'
        write_bytes(self.spark, f"{at}/projector_config.pbtxt", config.encode())

    def graph(self, model) -> None:
        self._append("graph", model.graph(self.spark))

    def hparams(self, session: str, values: dict[str, float | str], metrics: dict[str, float]) -> None:
        self._append("hparam", self.spark.createDataFrame([(session, k, str(v)) for k, v in values.items()], "session string, name string, value string"))
        self._append("metric", self.spark.createDataFrame([(session, k, float(v)) for k, v in metrics.items()], "session string, name string, value double"))

    def read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}")


def histogram(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """(bucket, hi, n): equal widths between minimum and maximum, an empty bucket 0 below; the top one takes the maximum.

    Two aggregations, both combined on the map side; a constant column gives one bucket.
    """
    v = F.col(value).cast("double")
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("top")).where("lo is not null")
    width = (F.col("top") - F.col("lo")) / buckets
    place = F.when(F.col("top") > F.col("lo"), F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor((v - F.col("lo")) / width)))).otherwise(0) + 1
    filled = df.where(v.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    last = F.when(F.col("top") > F.col("lo"), F.lit(buckets)).otherwise(1)
    bounds = ends.select("*", F.explode(F.sequence(F.lit(0), last)).alias("bucket"))
    hi = F.when(F.col("bucket") == last, F.col("top") + 1e-10).otherwise(F.col("lo") + width * F.col("bucket"))
    return bounds.join(filled, "bucket", "left").select("bucket", hi.alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def clamp(v: Column) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), v)).cast("int")


def pixels(t: DataFrame) -> DataFrame:
    """(n, h, w, c, pixel) of a tensor (n, h, w, c, v): (v - mean) * 64 / std over all of it, around the middle of nothing."""
    stats = t.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scaled = F.when(F.col("s") > 0, (F.col("v") - F.col("m")) * 64.0 / F.col("s")).otherwise(0.0)
    return t.crossJoin(F.broadcast(stats)).select("n", "h", "w", "c", clamp(scaled).alias("pixel"))


def tile(t: DataFrame, wide: int, h: int, w: int, border: int = 2) -> DataFrame:
    """(y, x, c, pixel): samples side by side, ``wide`` in a row, with a border between them; values times 256."""
    y = F.expr(f"cast(n div {wide} as int)") * (h + border) + F.col("h")
    x = (F.col("n") % wide).cast("int") * (w + border) + F.col("w")
    return t.select(y.cast("int").alias("y"), x.cast("int").alias("x"), "c", clamp(F.col("v") * 256.0).alias("pixel"))


def png(rgb: np.ndarray) -> bytes:
    """A PNG file of (H, W, 3) or (H, W, 1) bytes."""
    h, w, c = rgb.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


_CRC32C = np.zeros(256, np.uint32)
for _i in range(256):
    _v = _i
    for _ in range(8):
        _v = (_v >> 1) ^ (0x82F63B78 if _v & 1 else 0)
    _CRC32C[_i] = _v


def masked_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = int(_CRC32C[(crc ^ b) & 255]) ^ (crc >> 8)
    crc ^= 0xFFFFFFFF
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def record(payload: bytes) -> bytes:
    """Length and payload, each followed by its masked checksum."""
    n = struct.pack("<Q", len(payload))
    return n + struct.pack("<I", masked_crc(n)) + payload + struct.pack("<I", masked_crc(payload))


def records(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        payload = data[at + 12 : at + 12 + n]
        if struct.unpack_from("<I", data, at + 8)[0] != masked_crc(data[at : at + 8]) or struct.unpack_from("<I", data, at + 12 + n)[0] != masked_crc(payload):
            raise ValueError("broken record")
        out.append(payload)
        at += 16 + n
    return out
