"""Activations and layers, forward."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.functions import vector as V
from gridloom.plans.model import Model
from gridloom.queries.base import CLASSES, E, IMG, LOGITS, PROBS, WIDTH, bias, cells, embeddings, over_cells, query, r6, weight

IMAGE = (8, 8, 1)


def samples(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(spark, d).withColumnRenamed("vec_id", "id")


def dense(compat: str | None = None) -> Model:
    w = [[weight(o, k) for k in range(WIDTH)] for o in range(CLASSES)]
    return Model(500, IMAGE, compat).linear(CLASSES).set(0, "w", w).set(0, "b", [bias(o) for o in range(CLASSES)])


def maps(df: DataFrame, width: int, channels: int) -> DataFrame:
    """(n, h, w, c, v) of a model's output."""
    return df.select(F.col("id").alias("n"), F.posexplode("x").alias("k", "v")).select(
        "n", F.expr(f"cast(k div {width * channels} as int)").alias("h"), F.expr(f"cast(k div {channels} % {width} as int)").alias("w"),
        F.expr(f"cast(k % {channels} as int)").alias("c"), S.tidy(F.col("v")).alias("v"),
    )


for _name, _sql in {
    "relu": "greatest(v, 0)",
    "leakyrelu": "CASE WHEN v > 0 THEN v ELSE 0.01 * v END",
    "elu": "CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END",
    "selu": "CASE WHEN v > 0 THEN 1.0507009873554805 * v ELSE 1.7580993408473766 * (exp(v) - 1) END",
    "tanh": "tanh(v)",
    "sigmoid": "1 / (1 + exp(-v))",
}.items():

    @query(f"act_{_name}", over_cells(_sql))
    def _act(spark: SparkSession, d: str, name: str = _name) -> DataFrame:
        return cells(embeddings(spark, d), V.unary(F.col("x"), name))


@query("act_softmax", f"WITH {E} SELECT vec_id, k, {r6('exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id)')} AS v FROM e")
def act_softmax(spark: SparkSession, d: str) -> DataFrame:
    return cells(embeddings(spark, d), V.softmax(F.col("x")))


@query("act_logsoftmax", f"WITH {E} SELECT vec_id, k, {r6('v - ln(sum(exp(v)) OVER (PARTITION BY vec_id))')} AS v FROM e")
def act_logsoftmax(spark: SparkSession, d: str) -> DataFrame:
    return cells(embeddings(spark, d), V.log_softmax(F.col("x")))


@query("act_dropout_hash", over_cells("CASE WHEN (vec_id * 7919 + k * 104729 + 13) % 1000 >= 500 THEN v ELSE 0 END"))
def act_dropout_hash(spark: SparkSession, d: str) -> DataFrame:
    """The mask is a function of sample and cell, so that any engine can redraw it."""
    return cells(embeddings(spark, d), F.transform("x", lambda e, k: F.when((F.col("vec_id") * 7919 + k * 104729 + 13) % 1000 >= 500, e).otherwise(0.0)))


@query("layer_dropout", "SELECT count(*) * 64 AS cells, true AS half_kept, true AS others_unchanged FROM embeddings")
def layer_dropout(spark: SparkSession, d: str) -> DataFrame:
    x = samples(spark, d)
    y = Model(500, IMAGE).dropout(0.5).forward(x).withColumnRenamed("x", "y")
    both = x.join(y, "id").select(F.explode(F.arrays_zip("x", "y")).alias("p")).select("p.*")
    return both.agg(F.count("*").alias("cells"), (F.abs(F.avg((F.col("y") != 0).cast("int")) - 0.5) < 0.03).alias("half_kept"), F.bool_and((F.col("y") == 0) | (F.col("y") == F.col("x"))).alias("others_unchanged"))


@query("layer_linear", f"WITH {PROBS}, top AS (SELECT vec_id, label, arg_max(o, p ORDER BY o) AS best, max(p) AS p FROM p GROUP BY vec_id, label) SELECT vec_id, label, best, {r6('p')} AS p FROM top".replace("arg_max(o, p ORDER BY o)", "arg_max(o, p)"))
def layer_linear(spark: SparkSession, d: str) -> DataFrame:
    """Linear layer, softmax, and the likeliest class: no shuffle."""
    x = samples(spark, d)
    y = dense().softmax().forward(x).withColumnRenamed("x", "p")
    return x.select("id", "label").join(y, "id").select(F.col("id").alias("vec_id"), "label", V.argmax(F.col("p")).alias("best"), S.tidy(F.array_max("p")).alias("p"))


@query("layer_linear_expr", f"WITH {LOGITS} SELECT vec_id, o AS k, {r6('z')} AS v FROM z")
def layer_linear_expr(spark: SparkSession, d: str) -> DataFrame:
    """The same layer by expressions alone."""
    w = [[weight(o, k) for k in range(WIDTH)] for o in range(CLASSES)]
    return cells(embeddings(spark, d), V.linear(F.col("x"), w, [bias(o) for o in range(CLASSES)]))


def _filter(k: int, channels: int) -> np.ndarray:
    y, x, o = np.indices((k, k, channels))
    return (((y * 5 + x * 3 + o * 7) % 11 - 5) / 10.0)[None]


def _conv_sql(k: int, channels: int) -> str:
    f = f"f AS (SELECT y, x, o, ((y * 5 + x * 3 + o * 7) % 11 - 5) / 10.0::DOUBLE AS f FROM range({k}) a(y), range({k}) b(x), range({channels}) c(o))"
    p = (k - 1) // 2
    return (
        f"WITH {IMG}, {f} SELECT n, CAST(i AS INTEGER) AS h, CAST(j AS INTEGER) AS w, CAST(o AS INTEGER) AS c, {r6('sum(img.v * f) + (o + 1) / 10.0::DOUBLE')} AS v "
        f"FROM range(8) r(i), range(8) s(j), f, img WHERE img.h = i + y - {p} AND img.w = j + x - {p} GROUP BY n, i, j, o"
    )


for _k, _label in ((1, "layer_conv1x1"), (3, "layer_conv3x3"), (5, "layer_conv5x5")):

    @query(_label, _conv_sql(_k, 2))
    def _conv(spark: SparkSession, d: str, k: int = _k) -> DataFrame:
        m = Model(500, IMAGE).conv2d(0.0, 2, k).set(0, "w", _filter(k, 2)).set(0, "b", [0.1, 0.2])
        return maps(m.forward(samples(spark, d)), 8, 2)


@query(
    "layer_dconv",
    f"WITH {IMG}, f AS (SELECT y, x, ((y * 5 + x * 3) % 11 - 5) / 10.0::DOUBLE AS f FROM range(4) a(y), range(4) b(x)), s AS (SELECT n, h * 2 + y - 1 AS i, w * 2 + x - 1 AS j, sum(v * f) AS v FROM img, f GROUP BY n, i, j) SELECT n, CAST(i AS INTEGER) AS h, CAST(j AS INTEGER) AS w, 0 AS c, {r6('v + 0.1')} AS v FROM s WHERE i BETWEEN 0 AND 15 AND j BETWEEN 0 AND 15",
)
def layer_dconv(spark: SparkSession, d: str) -> DataFrame:
    m = Model(500, IMAGE).dconv2d(0.0, 1).set(0, "w", _filter(4, 1)).set(0, "b", [0.1])
    return maps(m.forward(samples(spark, d)), 16, 1)


for _op, _k, _fn in (("maxpool", 2, "max"), ("avgpool", 2, "avg"), ("minpool", 3, "min")):

    @query(f"layer_{_op}{_k}", f"WITH {IMG} SELECT n, CAST(h // {_k} AS INTEGER) AS h, CAST(w // {_k} AS INTEGER) AS w, 0 AS c, {r6(f'{_fn}(v)')} AS v FROM img GROUP BY n, h // {_k}, w // {_k}")
    def _pool(spark: SparkSession, d: str, op: str = _op, k: int = _k) -> DataFrame:
        return maps(Model(500, IMAGE).pool(op, k).forward(samples(spark, d)), -(-8 // k), 1)


@query("layer_upsample2", f"WITH {IMG} SELECT n, CAST(h * 2 + y AS INTEGER) AS h, CAST(w * 2 + x AS INTEGER) AS w, 0 AS c, {r6('v')} AS v FROM img, range(2) a(y), range(2) b(x)")
def layer_upsample2(spark: SparkSession, d: str) -> DataFrame:
    return maps(Model(500, IMAGE).upsample(2).forward(samples(spark, d)), 16, 1)


@query(
    "layer_batchnorm",
    f"WITH {E}, s AS (SELECT avg(v) AS m, avg(v * v) - avg(v) * avg(v) AS q FROM e) SELECT vec_id AS n, k // 8 AS h, k % 8 AS w, 0 AS c, {r6('1.5 * (v - m) / (sqrt(q) + 1e-6) + 0.25')} AS v FROM e, s",
)
def layer_batchnorm(spark: SparkSession, d: str) -> DataFrame:
    return maps(Model(500, IMAGE).batchnorm().set(0, "w", [1.5]).set(0, "b", [0.25]).forward(samples(spark, d)), 8, 1)


@query("layer_flatten", f"WITH {E} SELECT vec_id, k, {r6('v')} AS v FROM e")
def layer_flatten(spark: SparkSession, d: str) -> DataFrame:
    return cells(Model(500, IMAGE).flatten().forward(samples(spark, d)).withColumnRenamed("id", "vec_id"))


@query("model_shapes", "SELECT * FROM (VALUES (0, 'input', 16, 16, 1), (1, 'conv2d', 16, 16, 2), (2, 'maxpool', 8, 8, 2), (3, 'relu', 8, 8, 2), (4, 'conv2d', 8, 8, 2), (5, 'dropout', 8, 8, 2), (6, 'maxpool', 4, 4, 2), (7, 'relu', 4, 4, 2), (8, 'flatten', 1, 32, 1), (9, 'linear', 1, 16, 1), (10, 'dropout', 1, 16, 1), (11, 'linear', 1, 4, 1), (12, 'softmax', 1, 4, 1)) t(layer, op, h, w, c)")
def model_shapes(spark: SparkSession, d: str) -> DataFrame:
    return walk().describe(spark).select("layer", "op", "h", "w", "c")


def walk() -> Model:
    m = Model(2, (16, 16, 1)).conv2d(0.5, 2).maxpool(2).relu().conv2d(0.5, 2).dropout(0.5).maxpool(2).relu()
    return m.flatten().linear(16).dropout(0.5).linear(4).softmax()


@query("graph_nodes", "SELECT * FROM (VALUES ('input_0', 'input', NULL, 'float', '500,8,8,1'), ('linear_1', 'linear', 'input_0', 'float', '500,1,10,1'), ('softmax_2', 'softmax', 'linear_1', 'float', '500,1,10,1')) t(name, op, input, dtype, shape)")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return dense().softmax().graph(spark)


@query("describe_model", "SELECT * FROM (VALUES (0, 'input', 500, 8, 8, 1, 0, '{}'), (1, 'linear', 500, 1, 10, 1, 650, '{\"stride\": 1}'), (2, 'softmax', 500, 1, 10, 1, 0, '{\"stride\": 1}')) t(layer, op, n, h, w, c, n_params, attrs)")
def describe_model(spark: SparkSession, d: str) -> DataFrame:
    return dense().softmax().describe(spark)


#: SQL: the embeddings as images of 8 x 4 cells and two channels; a filter with an index for each.
TWO = f"{E}, img AS (SELECT vec_id AS n, k // 8 AS h, k % 8 // 2 AS w, k % 2 AS c1, v FROM e), f AS (SELECT c1, y, x, o, ((c1 * 2 + y * 5 + x * 3 + o * 7) % 11 - 5) / 10.0::DOUBLE AS f FROM range(2) c(c1), range(3) a(y), range(3) b(x), range(3) d(o))"


@query(
    "layer_conv_channels",
    f"WITH {TWO} SELECT n, CAST(i AS INTEGER) AS h, CAST(j AS INTEGER) AS w, CAST(o AS INTEGER) AS c, {r6('sum(img.v * f) + (o + 1) / 10.0::DOUBLE')} AS v FROM range(8) r(i), range(4) s(j), f JOIN img USING (c1) WHERE img.h = i + y - 1 AND img.w = j + x - 1 GROUP BY n, i, j, o",
)
def layer_conv_channels(spark: SparkSession, d: str) -> DataFrame:
    """Two channels in, three out."""
    c, y, x, o = np.indices((2, 3, 3, 3))
    m = Model(500, (8, 4, 2)).conv2d(0.0, 3).set(0, "w", ((c * 2 + y * 5 + x * 3 + o * 7) % 11 - 5) / 10.0).set(0, "b", [0.1, 0.2, 0.3])
    return maps(m.forward(samples(spark, d)), 4, 3)


@query("layer_maxpool_channels", f"WITH {TWO} SELECT n, CAST(h // 2 AS INTEGER) AS h, CAST(w // 2 AS INTEGER) AS w, CAST(c1 AS INTEGER) AS c, {r6('max(v)')} AS v FROM img GROUP BY n, h // 2, w // 2, c1")
def layer_maxpool_channels(spark: SparkSession, d: str) -> DataFrame:
    return maps(Model(500, (8, 4, 2)).maxpool(2).forward(samples(spark, d)), 2, 2)
