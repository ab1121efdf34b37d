"""Mini-batches, streams, corpora and summaries."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.plans.model import Model
from gridloom.queries.base import E, embeddings, query, r6, table
from gridloom.queries.layers import IMAGE, dense, samples
from gridloom.session import scratch, write_bytes
from gridloom.sources import corpora, summary
from gridloom.streaming import feed


@query("batch_assign", "SELECT vec_id // 64 AS batch_id, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM embeddings GROUP BY 1")
def batch_assign(spark: SparkSession, d: str) -> DataFrame:
    b = corpora.batched(table(spark, d, "embeddings").select("vec_id"), 64, "vec_id")
    return b.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


@query("batch_fetch", "SELECT vec_id, label FROM embeddings WHERE vec_id // 64 = 7")
def batch_fetch(spark: SparkSession, d: str) -> DataFrame:
    """The last, partial batch at the smallest sizes; ids are dense, so the filter reaches the scan."""
    x = table(spark, d, "embeddings").select("vec_id", "label")
    return corpora.fetch(corpora.batched(x, 64, "vec_id", dense=True), 7).drop("batch_id")


@query("batch_normalize", f"WITH {E} SELECT vec_id, k, {r6('(v - 0.05) / 0.5')} AS v FROM e")
def batch_normalize(spark: SparkSession, d: str) -> DataFrame:
    x = embeddings(spark, d).select("vec_id", corpora.normalize(F.col("x"), 0.05, 0.5).alias("x"))
    return x.select("vec_id", F.posexplode("x").alias("k", "v")).withColumn("v", S.tidy(F.col("v")))


@query("tensor_normalize", f"WITH {E}, s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM e) SELECT vec_id, k, {r6('(v - m) / s')} AS v FROM e, s")
def tensor_normalize(spark: SparkSession, d: str) -> DataFrame:
    """By the mean and deviation of all values: one small row joins them all."""
    t = embeddings(spark, d).select("vec_id", F.posexplode("x").alias("k", "v"))
    s = t.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return t.crossJoin(F.broadcast(s)).select("vec_id", "k", S.tidy((F.col("v") - F.col("m")) / F.col("s")).alias("v"))


@query("epoch_counts", "WITH b AS (SELECT vec_id // 64 AS batch_id, count(*) AS n, sum(label) AS s FROM embeddings GROUP BY 1) SELECT batch_id, CAST(sum(n) OVER (ORDER BY batch_id) AS BIGINT) AS seen, CAST(sum(s) OVER (ORDER BY batch_id) AS BIGINT) AS total FROM b")
def epoch_counts(spark: SparkSession, d: str) -> DataFrame:
    b = corpora.batched(table(spark, d, "embeddings").select("vec_id", "label"), 64, "vec_id", dense=True)
    return feed.running(b, "batch_id", "label")


@query("rewind_epochs", "SELECT CAST(e AS INTEGER) AS epoch, vec_id // 100 AS batch_id, count(*) AS n FROM embeddings, range(2) r(e) GROUP BY 1, 2")
def rewind_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Two passes over the same batches."""
    b = corpora.batched(table(spark, d, "embeddings").select("vec_id"), 100, "vec_id", dense=True)
    return spark.range(2).select(F.col("id").cast("int").alias("epoch")).crossJoin(b).groupBy("epoch", "batch_id").agg(F.count("*").alias("n"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return feed.source(spark, f"{d}/event[s].parquet", schema)


@query("stream_minibatch_counts", "SELECT event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY event_type")
def stream_minibatch_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each micro-batch adds its counts to a table; the sum of them all is the batch result."""
    at = scratch(spark)

    def add(df: DataFrame, k: int) -> None:
        df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{at}/counts/batch={k}")

    feed.each_batch(_events(spark, d), add, f"{at}/checkpoint")
    done = spark.read.parquet(f"{at}/counts")
    return done.groupBy("event_type").agg(F.sum("n").alias("n"), S.tidy(F.sum("total"), 4).alias("total"))


@query("stream_window_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each micro-batch writes the windows that it changed; the last state of each is the result. The watermark lets go of
    windows that no event can change any more, and nothing is kept in the driver."""
    at = scratch(spark)

    def changed(df: DataFrame, k: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/windows/batch={k}")

    counted = feed.counts(_events(spark, d), "event_type", "ts")
    feed.each_batch(counted, changed, f"{at}/checkpoint", "update")
    done = spark.read.parquet(f"{at}/windows").groupBy("start", "event_type")
    return done.agg(F.max_by("n", "batch").alias("n"), S.tidy(F.max_by("total", "batch"), 4).alias("total"))


def _bytes(spark: SparkSession, d: str) -> np.ndarray:
    """40 embeddings as bytes: a corpus of 8 x 8 images."""
    got = table(spark, d, "embeddings").where("vec_id < 40").select("vec_id", "label", "embedding").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in got], float)
    return np.clip(np.floor(np.abs(x) * 1000), 0, 255).astype(np.uint8), np.array([r["label"] for r in got], np.uint8)


_PIXEL = "least(255, floor(abs(v) * 1000))"


@query("corpus_idx", f"WITH {E} SELECT vec_id AS sample_id, label, k, ({_PIXEL} - 10) / 128 AS v FROM e WHERE vec_id < 40")
def corpus_idx(spark: SparkSession, d: str) -> DataFrame:
    x, y = _bytes(spark, d)
    at = scratch(spark)
    write_bytes(spark, f"{at}/images", struct.pack(">IIII", corpora.IDX_IMAGES, len(x), 8, 8) + x.tobytes())
    write_bytes(spark, f"{at}/labels", struct.pack(">II", corpora.IDX_LABELS, len(y)) + y.tobytes())
    corpora.register("embeddings_idx", lambda s: corpora.read_idx(s, f"{at}/images", f"{at}/labels", 10.0, 128.0))
    return corpora.dataset(spark, "embeddings_idx", 16).select("sample_id", "label", F.posexplode("x").alias("k", "v"))


@query("corpus_cifar", f"WITH {E} SELECT vec_id AS sample_id, label, CAST(count(*) * 48 AS BIGINT) AS values, sum({_PIXEL}) * 48 / 256 AS total FROM e WHERE vec_id < 40 GROUP BY vec_id, label")
def corpus_cifar(spark: SparkSession, d: str) -> DataFrame:
    """Two files of records in planes, each plane 16 copies of an embedding."""
    x, y = _bytes(spark, d)
    at = scratch(spark)
    for k in range(2):
        part = b"".join(bytes([y[i]]) + x[i].tobytes() * 48 for i in range(20 * k, 20 * k + 20))
        write_bytes(spark, f"{at}/data_batch_{k}.bin", part)
    return corpora.read_cifar(spark, at).select("sample_id", "label", F.size("x").cast("bigint").alias("values"), F.aggregate("x", F.lit(0.0), lambda a, e: a + e).alias("total"))


@query("tensor_raw_file", f"WITH {E} SELECT 40 AS n, 8 AS h, 8 AS w, 1 AS c, k, sum({_PIXEL}) / 256 AS v FROM e WHERE vec_id < 40 GROUP BY k")
def tensor_raw_file(spark: SparkSession, d: str) -> DataFrame:
    x, _ = _bytes(spark, d)
    at = scratch(spark)
    write_bytes(spark, at, corpora.tensor_bytes(40, 8, 8, 1, x / 256.0))
    data = spark.read.format("binaryFile").load(at).first()["content"]
    (n, h, w, c), v = corpora.tensor_from_bytes(bytes(data))
    total = v.reshape(n, -1).sum(0)
    return spark.createDataFrame([(n, h, w, c, k, float(t)) for k, t in enumerate(total)], "n int, h int, w int, c int, k int, v double")


@query("summary_scalar", "SELECT 'loss' AS tag, CAST(i AS BIGINT) AS step, 1.0::DOUBLE / (i + 1) AS value FROM range(3) r(i)")
def summary_scalar(spark: SparkSession, d: str) -> DataFrame:
    run = summary.Run(spark, scratch(spark))
    for i in range(3):
        run.at(i).scalar("loss", 1.0 / (i + 1))
    return run.read("scalar").select("tag", "step", "value")


@query("summary_text", "SELECT 'note' AS tag, CAST(2 AS BIGINT) AS step, 'a text' AS text")
def summary_text(spark: SparkSession, d: str) -> DataFrame:
    run = summary.Run(spark, scratch(spark)).at(2)
    run.text("note", "a text")
    return run.read("text").select("tag", "step", "text")


@query("summary_embed_rows", "SELECT 'emb.' || vec_id AS name FROM embeddings")
def summary_embed_rows(spark: SparkSession, d: str) -> DataFrame:
    run = summary.Run(spark, scratch(spark))
    run.embed("emb", embeddings(spark, d), "vec_id", "x")
    return spark.read.text(f"{run.path}/embed/emb/metadata").select(F.col("value").alias("name"))


@query("summary_graph", "SELECT * FROM (VALUES ('input_0', 'input'), ('conv2d_1', 'conv2d'), ('relu_2', 'relu')) t(name, op)")
def summary_graph(spark: SparkSession, d: str) -> DataFrame:
    run = summary.Run(spark, scratch(spark))
    run.graph(Model(1, IMAGE).conv2d(0.0, 2).relu())
    return run.read("graph").select("name", "op")


@query("model_save_load", "SELECT 0 AS layer, name, CAST(n AS BIGINT) AS values FROM (VALUES ('w', 640), ('b', 10)) t(name, n)")
def model_save_load(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of a model that was saved and loaded; its outputs are equal, or there are no rows."""
    at = scratch(spark)
    m = dense().softmax()
    m.save(spark, at)
    again = Model.load(spark, at)
    x = samples(spark, d)
    differ = m.forward(x).join(again.forward(x).withColumnRenamed("x", "y"), "id").where("x <> y").limit(1).count()
    return again.parameters(spark).select("layer", "name", F.size("value").cast("bigint").alias("values")).where(F.lit(differ == 0))
