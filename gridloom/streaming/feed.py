"""Mini-batch feeding and training by Structured Streaming: files arrive, each micro-batch is a mini-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def each_batch(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run f on every micro-batch of what there is, once, and end; the checkpoint resumes after the last one done."""
    query = stream.writeStream.foreachBatch(f).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def train(stream: DataFrame, model, step: Callable, checkpoint: str, targets: str = "t") -> list[int]:
    """backprop and step(model) for every micro-batch; returns the numbers of the batches."""
    done: list[int] = []

    def f(df: DataFrame, k: int) -> None:
        model.backprop(df, targets)
        step(model)
        done.append(k)

    each_batch(stream, f, checkpoint)
    return done


def counts(stream: DataFrame, key: str, time: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window start, key, n, total) of a stream with a value column, by event time with a watermark."""
    grouped = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def running(df: DataFrame, batch: str, value: str) -> DataFrame:
    """Running count and sum over batches: each batch is aggregated before the window sees it."""
    per = df.groupBy(batch).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    return per.selectExpr(batch, f"sum(n) over (order by {batch}) as seen", f"sum(s) over (order by {batch}) as total")
