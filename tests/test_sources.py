"""Files in and out, summaries and streams."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.plans.model import Model
from gridloom.sources import corpora, summary
from gridloom.streaming import feed


def test_idx_errors():
    with pytest.raises(ValueError, match="image"):
        corpora.idx_images(struct.pack(">IIII", 0x801, 1, 2, 2) + bytes(4))
    with pytest.raises(ValueError, match="label"):
        corpora.idx_labels(struct.pack(">II", 0x801, 3) + bytes(2))
    with pytest.raises(ValueError, match="whole"):
        corpora.cifar(bytes(100))


def test_idx_counts_must_agree(spark, tmp_path):
    (tmp_path / "i").write_bytes(struct.pack(">IIII", 0x803, 2, 1, 1) + bytes(2))
    (tmp_path / "l").write_bytes(struct.pack(">II", 0x801, 3) + bytes(3))
    with pytest.raises(Exception, match="2 images, 3 labels"):
        corpora.read_idx(spark, str(tmp_path / "i"), str(tmp_path / "l")).collect()


def test_cifar_interleaves_planes():
    planes = bytes([7]) + bytes([1]) * 1024 + bytes([2]) * 1024 + bytes([3]) * 1024
    y, x = corpora.cifar(planes * 2)
    assert y.tolist() == [7, 7] and x.shape == (2, 32, 32, 3) and x[1, 5, 6].tolist() == [1, 2, 3]


def test_tensor_file_round_trip():
    shape, v = corpora.tensor_from_bytes(corpora.tensor_bytes(2, 3, 1, 2, np.arange(12) / 256))
    assert shape == (2, 3, 1, 2) and np.allclose(v * 256, np.arange(12))


@pytest.mark.parametrize("dense", [True, False])
def test_batches(spark, dense):
    df = spark.range(103).withColumnRenamed("id", "k").repartition(5)
    b = corpora.batched(df, 10, "k", dense)
    got = {r["k"]: r["batch_id"] for r in b.collect()}
    assert got == {k: k // 10 for k in range(103)}
    assert corpora.fetch(b, 10).count() == 3 and corpora.fetch(b, 11).count() == 0


def test_batches_of_more_rows_than_are_sampled(spark):
    """Ranges are cut by a sample; with other columns read, batches were numbered by ranges that were cut elsewhere."""
    df = spark.range(20_000).select(F.col("id").alias("k"), F.sequence(F.col("id"), F.col("id") + 3).alias("x")).repartition(3)
    b = corpora.batched(df, 128, "k")
    assert b.columns == ["k", "x", "batch_id"]
    assert [r["k"] for r in b.where("batch_id <> k div 128 or x[0] <> k").collect()] == []
    ordered = corpora.Ordered(df, "k")
    assert ordered.n == 20_000 and len(ordered.ranges) > 1
    for k, size in ((0, 128), (40, 128), (156, 128), (157, 128), (0, 30_000), (1, 7_000)):
        want = list(range(k * size, min(20_000, (k + 1) * size)))
        assert sorted(r["k"] for r in ordered.batch(k, size).collect()) == want
    # A batch of every range's border.
    for _, before, _ in ordered.ranges[1:]:
        assert sorted(r["k"] for r in ordered.batch(before // 128, 128).where("x[3] = k + 3").collect()) == list(range(before // 128 * 128, before // 128 * 128 + 128))


def test_batches_of_nothing(spark):
    none = spark.range(0).withColumnRenamed("id", "k")
    assert corpora.batched(none, 4, "k").count() == 0
    assert corpora.Ordered(none, "k").n == 0 and corpora.Ordered(none, "k").batch(0, 4).count() == 0


def test_scale_of_zero_counts_as_one():
    assert corpora.scaled(np.array([3.0]), 1.0, 0.0).tolist() == [2.0]


def test_png_is_readable():
    data = summary.png(np.arange(24).reshape(2, 4, 3))
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (4, 2)
    at = data.index(b"IDAT")
    (n,) = struct.unpack(">I", data[at - 4 : at])
    assert zlib.decompress(data[at + 4 : at + 4 + n]) == b"\0" + bytes(range(12)) + b"\0" + bytes(range(12, 24))


def test_records():
    made = b"".join(summary.record(p) for p in (b"", b"abc", bytes(300)))
    assert summary.records(made) == [b"", b"abc", bytes(300)]
    with pytest.raises(ValueError, match="broken"):
        summary.records(made[:20] + b"!" + made[21:])


def test_constant_histogram(spark):
    rows = summary.histogram(spark.createDataFrame([(2.0,)] * 5, "v double"), "v", 30).orderBy("bucket").collect()
    assert [(r["bucket"], r["n"]) for r in rows] == [(0, 0), (1, 5)]
    assert summary.histogram(spark.createDataFrame([], "v double"), "v", 3).count() == 0


def test_summaries_append(spark, tmp_path):
    run = summary.Run(spark, str(tmp_path))
    run.at(1).scalar("a", 1.0)
    run.at(2).scalar("a", 2.0)
    run.histogram("h", spark.range(10).selectExpr("cast(id as double) as v"), "v", 5)
    run.hparams("s", {"lr": 0.1}, {"acc": 0.9})
    assert {(r["step"], r["value"]) for r in run.read("scalar").collect()} == {(1, 1.0), (2, 2.0)}
    assert run.read("histogram").where("tag = 'h'").agg({"n": "sum"}).first()[0] == 10
    assert run.read("hparam").count() == run.read("metric").count() == 1


def test_streamed_training_equals_the_batch_loop(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist(), [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, x array<double>, t array<double>")
    for k in range(4):
        df.where(f"id div 10 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def model():
        return Model(10, (1, 4, 1), seed=1).linear(2).softmax()

    streamed = model()
    done = feed.train(feed.source(spark, f"{tmp_path}/in", df.schema), streamed, lambda m: m.sgd(0.1, 0.0), f"{tmp_path}/ck")
    assert done == [0, 1, 2, 3]
    plain = model()
    for k in range(4):
        plain.backprop(df.where(f"id div 10 = {k}"))
        plain.sgd(0.1, 0.0)
    assert all(np.allclose(streamed.params[n], plain.params[n]) for n in plain.params)


def test_model_files(spark, tmp_path):
    m = Model(2, (4, 4, 1), seed=5).conv2d(0.1, 3).batchnorm().relu().flatten().linear(2).softmax()
    m.save(spark, f"{tmp_path}/m")
    again = Model.load(spark, f"{tmp_path}/m")
    assert again.layers == m.layers and all(np.array_equal(again.params[k], m.params[k]) for k in m.params)
    with pytest.raises(ValueError, match="values"):
        m.set(0, "b", [1.0])
