"""What the corpus operators share: table access, reliable checkpoints, Arrow mapping."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset.

    Unset on a cluster it is an error: a folder of the driver's machine can't be reached by the executors.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="gridloom-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return named or current


def cut(df: DataFrame) -> DataFrame:
    """df, stored reliably; its lineage ends here and survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Frees the disk of shuffles to which nothing refers any more, in Python and then in the driver's JVM; its cleaner
    works by itself, but only when memory runs short."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/gridloom-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the JVM delete a folder when it ends, with the session."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def col(name: str) -> Column:
    """The column of exactly this name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names; whatever else df has can't clash with those."""
    return df.select(*[col(there).alias(here) for here, there in names.items()])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from every column of df in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes of text that are worked on at once, about: NumPy holds several arrays of 8 bytes for each of them.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, rows: int | None, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most ``rows`` rows and ``size`` bytes of texts; a longer text has a slice of its own."""
    n = batch.num_rows
    total = np.zeros(n + 1, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            total[1:] += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
    np.cumsum(total, out=total)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
        end = min(n, end, at + (rows or n))
        yield batch.slice(at, end - at)
        at = end


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int | None = None) -> DataFrame:
    """df through f, Arrow batch by Arrow batch, in slices of at most ``rows`` rows and SLICE_BYTES bytes of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                yield f(part)

    return df.mapInArrow(run, schema)


def map_named(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType, rows: int) -> DataFrame:
    """As map_batches, for columns of any name: Spark resolves what it hands to Python by name, where dots fail."""
    names, out = df.columns, schema.names
    places = StructType([StructField(f"_{i}", x.dataType, True) for i, x in enumerate(schema)])

    def renamed(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = f(pa.RecordBatch.from_arrays(batch.columns, names))
        return pa.RecordBatch.from_arrays(got.columns, [f"_{i}" for i in range(len(out))])

    return map_batches(df.toDF(*[f"_{i}" for i in range(len(names))]), renamed, places, rows).toDF(*out)


def list_array(values: pa.Array, lengths) -> pa.ListArray:
    """Rows of a list column from their values one after another and the rows' lengths."""
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), values)
