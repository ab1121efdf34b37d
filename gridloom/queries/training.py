"""Losses, gradients and optimiser steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import losses
from gridloom.plans.model import Model
from gridloom.queries.base import CLASSES, E, IMG, PROBS, query, r6
from gridloom.queries.layers import IMAGE, _conv_sql, _filter, dense, maps, samples


def targets(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, x, t): targets one-hot."""
    return samples(spark, d).withColumn("t", losses.onehot(F.col("label"), CLASSES))


def scored(spark: SparkSession, d: str, model: Model) -> DataFrame:
    """(o, t) arrays, a sample a row."""
    x = targets(spark, d)
    return model.forward(x).withColumnRenamed("x", "o").join(x.select("id", "t"), "id")


T = "CASE WHEN label = o THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
N = "(SELECT count(*) FROM embeddings)"
for _name, _sql in {
    "mse": f"sum((p - {T}) * (p - {T}))",
    "bce": f"-sum({T} * ln(p + 1e-6) + (1 - {T}) * ln(1 - p + 1e-6))",
    "ce": f"-sum({T} * ln(greatest(p, 1e-12)))",
}.items():

    @query(f"loss_{_name}", f"WITH {PROBS} SELECT {r6(f'({_sql}) / {N}')} AS loss FROM p")
    def _loss(spark: SparkSession, d: str, name: str = _name) -> DataFrame:
        return losses.loss_rows(scored(spark, d, dense().softmax()), name).select(S.tidy(F.col("loss")).alias("loss"))


@query("loss_nll", f"WITH {PROBS} SELECT {r6(f'-sum({T} * ln(p)) / {N}')} AS loss FROM p")
def loss_nll(spark: SparkSession, d: str) -> DataFrame:
    return losses.loss_rows(scored(spark, d, dense().logsoftmax()), "nll").select(S.tidy(F.col("loss")).alias("loss"))


@query("loss_auto", f"WITH {PROBS} SELECT 'ce' AS name, {r6(f'-sum({T} * ln(greatest(p, 1e-12))) / {N}')} AS loss FROM p")
def loss_auto(spark: SparkSession, d: str) -> DataFrame:
    """The loss that goes with the last layer."""
    m = dense().softmax()
    return losses.loss_rows(scored(spark, d, m), m.loss()).select(F.lit(m.loss()).alias("name"), S.tidy(F.col("loss")).alias("loss"))


@query("onehot_labels", "SELECT vec_id, CAST(o AS INTEGER) AS k, CASE WHEN o = (CASE WHEN label < 8 THEN label ELSE 0 END) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM embeddings, range(8) r(o)")
def onehot_labels(spark: SparkSession, d: str) -> DataFrame:
    """Eight classes: labels 8 and 9 mark class 0."""
    return samples(spark, d).select(F.col("id").alias("vec_id"), F.posexplode(losses.onehot(F.col("label"), 8)).alias("k", "v"))


@query("hit_accuracy", f"WITH {PROBS}, top AS (SELECT vec_id, label, arg_max(o, p) AS best FROM p GROUP BY vec_id, label) SELECT CAST(count(*) FILTER (best = label) AS DOUBLE) AS hit FROM top")
def hit_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return losses.hit(scored(spark, d, dense().softmax()))


def parameter_rows(spark: SparkSession, values: dict, width: int) -> DataFrame:
    """(name, o, k, v) of a linear layer's weights and bias."""
    rows = [(name, j // w, j % w, float(v)) for (_, name), a in values.items() for w in [width if name == "w" else 1] for j, v in enumerate(a.ravel())]
    return spark.createDataFrame(rows, "name string, o int, k int, v double").withColumn("v", S.tidy(F.col("v")))


#: SQL: gradient of the linear layer, weights then bias.
GRAD = (
    f"{PROBS}, g AS (SELECT 'w' AS name, CAST(p.o AS INTEGER) AS o, e.k AS k, sum((p - CASE WHEN p.label = o THEN 1.0 ELSE 0.0 END) * e.v) AS g FROM p JOIN e USING (vec_id) GROUP BY p.o, e.k "
    "UNION ALL SELECT 'b', CAST(o AS INTEGER), 0, sum(p - CASE WHEN label = o THEN 1.0 ELSE 0.0 END) FROM p GROUP BY o), "
    "par AS (SELECT 'w' AS name, o, k, w FROM wt UNION ALL SELECT 'b', CAST(o AS INTEGER), 0, (o % 7 - 3) / 10.0::DOUBLE FROM range(10) r(o))"
)


@query("bwd_linear_dw_db", f"WITH {GRAD} SELECT name, o, k, {r6('g')} AS v FROM g")
def bwd_linear_dw_db(spark: SparkSession, d: str) -> DataFrame:
    m = dense().softmax().backprop(targets(spark, d))
    return parameter_rows(spark, m.gradients, 64)


@query("bwd_linear_dx", f"WITH {PROBS} SELECT vec_id, wt.k AS k, {r6('sum((p - CASE WHEN label = o THEN 1.0 ELSE 0.0 END) * w)')} AS v FROM p JOIN wt USING (o) GROUP BY vec_id, wt.k")
def bwd_linear_dx(spark: SparkSession, d: str) -> DataFrame:
    g = dense().softmax().input_gradient(targets(spark, d))
    return g.select(F.col("id").alias("vec_id"), F.posexplode("x").alias("k", "v")).withColumn("v", S.tidy(F.col("v")))


def against(spark: SparkSession, d: str, n: int, t: float) -> DataFrame:
    return samples(spark, d).withColumn("t", F.array_repeat(F.lit(t), n))


def gradient_cells(m: Model, df: DataFrame) -> DataFrame:
    return m.input_gradient(df).select(F.col("id").alias("vec_id"), F.posexplode("x").alias("k", "v")).withColumn("v", S.tidy(F.col("v")))


@query("bwd_relu", f"WITH {E} SELECT vec_id, k, {r6('CASE WHEN v > 0 THEN v - 0.1 ELSE 0 END')} AS v FROM e")
def bwd_relu(spark: SparkSession, d: str) -> DataFrame:
    return gradient_cells(Model(500, IMAGE).relu(), against(spark, d, 64, 0.1))


@query("bwd_tanh", f"WITH {E} SELECT vec_id, k, {r6('(tanh(v) - 0.1) * (1 - tanh(v) * tanh(v))')} AS v FROM e")
def bwd_tanh(spark: SparkSession, d: str) -> DataFrame:
    return gradient_cells(Model(500, IMAGE).tanh(), against(spark, d, 64, 0.1))


@query("bwd_sigmoid_hidden", f"WITH {E}, s AS (SELECT vec_id, k, 1 / (1 + exp(-v)) AS y FROM e) SELECT vec_id, k, {r6('(y - 0.1) * y * (1 - y)')} AS v FROM s")
def bwd_sigmoid_hidden(spark: SparkSession, d: str) -> DataFrame:
    """Below another layer, the derivative applies."""
    return gradient_cells(Model(500, IMAGE).sigmoid().flatten(), against(spark, d, 64, 0.1))


_PLACE = "row_number() OVER (PARTITION BY n, h // 2, w // 2 ORDER BY v DESC, h, w)"


@query("bwd_pool_route", f"WITH {IMG} SELECT n AS vec_id, CAST(h * 8 + w AS INTEGER) AS k, {r6(f'CASE WHEN {_PLACE} = 1 THEN v - 0.1 ELSE 0 END')} AS v FROM img")
def bwd_pool_route(spark: SparkSession, d: str) -> DataFrame:
    return gradient_cells(Model(500, IMAGE).maxpool(2), against(spark, d, 16, 0.1))


@query("bwd_avgpool", f"WITH {IMG} SELECT n AS vec_id, CAST(h * 8 + w AS INTEGER) AS k, {r6('(avg(v) OVER (PARTITION BY n, h // 2, w // 2) - 0.1) / 4')} AS v FROM img")
def bwd_avgpool(spark: SparkSession, d: str) -> DataFrame:
    return gradient_cells(Model(500, IMAGE).avgpool(2), against(spark, d, 16, 0.1))


@query("bwd_upsample", f"WITH {E} SELECT vec_id, k, {r6('v - 0.1')} AS v FROM e")
def bwd_upsample(spark: SparkSession, d: str) -> DataFrame:
    """The mean over each window: here all of a window's gradients are equal."""
    return gradient_cells(Model(500, IMAGE).upsample(2), against(spark, d, 256, 0.1))


_DY = _conv_sql(3, 2).replace("WITH ", "", 1)
_DY_HEAD, _DY_BODY = _DY.split(" SELECT n, CAST(i AS INTEGER)", 1)


@query(
    "bwd_conv_df",
    f"WITH {_DY_HEAD}, dy AS (SELECT n, CAST(i AS INTEGER){_DY_BODY.replace('round(', '(').replace(', 6) + 0.0', ')')}) "
    f"SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, dy.c AS o, {r6('sum(dy.v * img.v)')} AS v FROM dy JOIN img USING (n), range(3) a(y), range(3) b(x) WHERE img.h = dy.h + y - 1 AND img.w = dy.w + x - 1 GROUP BY y, x, dy.c",
)
def bwd_conv_df(spark: SparkSession, d: str) -> DataFrame:
    m = Model(500, IMAGE).conv2d(0.0, 2).set(0, "w", _filter(3, 2)).set(0, "b", [0.1, 0.2]).backprop(against(spark, d, 128, 0.0))
    g = m.gradients[0, "w"][0]
    rows = [(y, x, o, float(g[y, x, o])) for y in range(3) for x in range(3) for o in range(2)]
    return spark.createDataFrame(rows, "y int, x int, o int, v double").withColumn("v", S.tidy(F.col("v")))


@query(
    "bwd_conv_dx",
    f"WITH {_DY_HEAD}, dy AS (SELECT n, CAST(i AS INTEGER){_DY_BODY.replace('round(', '(').replace(', 6) + 0.0', ')')}), "
    f"s AS (SELECT n, dy.h + y - 1 AS h, dy.w + x - 1 AS w, sum(dy.v * f) AS v FROM dy JOIN f ON f.o = dy.c GROUP BY n, dy.h + y - 1, dy.w + x - 1) "
    f"SELECT n, CAST(h AS INTEGER) AS h, CAST(w AS INTEGER) AS w, 0 AS c, {r6('v')} AS v FROM s WHERE h BETWEEN 0 AND 7 AND w BETWEEN 0 AND 7",
)
def bwd_conv_dx(spark: SparkSession, d: str) -> DataFrame:
    m = Model(500, IMAGE).conv2d(0.0, 2).set(0, "w", _filter(3, 2)).set(0, "b", [0.1, 0.2])
    return maps(m.input_gradient(against(spark, d, 128, 0.0)), 8, 1)


@query(
    "bwd_batchnorm",
    f"WITH {E}, s AS (SELECT avg(v) AS m, 1 / (sqrt(avg(v * v) - avg(v) * avg(v)) + 1e-6) AS r FROM e), h AS (SELECT (v - m) * r AS hat FROM e, s) "
    f"SELECT {r6('sum((1.5 * hat + 0.25 - 0.1) * hat)')} AS gamma, {r6('sum(1.5 * hat + 0.25 - 0.1)')} AS beta FROM h",
)
def bwd_batchnorm(spark: SparkSession, d: str) -> DataFrame:
    m = Model(500, IMAGE).batchnorm().set(0, "w", [1.5]).set(0, "b", [0.25]).backprop(against(spark, d, 64, 0.1))
    return spark.createDataFrame([(float(m.gradients[0, "w"][0]), float(m.gradients[0, "b"][0]))], "gamma double, beta double").select(S.tidy(F.col("gamma")).alias("gamma"), S.tidy(F.col("beta")).alias("beta"))


def _stepped(spark: SparkSession, d: str, step, started: bool = False) -> DataFrame:
    m = dense().softmax()
    m.step = int(started)
    m.backprop(targets(spark, d))
    step(m)
    return parameter_rows(spark, m.params, 64)


def _step_sql(expr: str) -> str:
    return f"WITH {GRAD} SELECT name, o, k, {r6(expr)} AS v FROM par JOIN g USING (name, o, k)"


@query("opt_sgd_step", _step_sql("w - 0.001 * g"))
def opt_sgd_step(spark: SparkSession, d: str) -> DataFrame:
    return _stepped(spark, d, lambda m: m.sgd(0.001, 0.0))


@query("opt_sgd_momentum_step", _step_sql("w - 0.01 * (1 - 0.9::DOUBLE) * g"))
def opt_sgd_momentum_step(spark: SparkSession, d: str) -> DataFrame:
    return _stepped(spark, d, lambda m: m.sgd(0.01, 0.9), True)


@query("opt_adam_step", _step_sql("w - 0.01 * ((1 - 0.9::DOUBLE) * g) / (sqrt((1 - 0.999::DOUBLE) * g * g) + 1e-6)"))
def opt_adam_step(spark: SparkSession, d: str) -> DataFrame:
    return _stepped(spark, d, lambda m: m.adam(0.01))


@query("opt_adamw_step", _step_sql("w * (1 - 0.01 * 0.1::DOUBLE) - 0.01 * ((1 - 0.9::DOUBLE) * g) / (sqrt((1 - 0.999::DOUBLE) * g * g) + 1e-6)"))
def opt_adamw_step(spark: SparkSession, d: str) -> DataFrame:
    return _stepped(spark, d, lambda m: m.adamw(0.01, 0.1))


@query("train_epochs", "SELECT CAST(i AS INTEGER) AS epoch, true AS better FROM range(1, 4) r(i)")
def train_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Three epochs of the linear classifier: each has a smaller loss than the one before."""
    x = targets(spark, d)
    m, found = dense().softmax(), []
    for _ in range(4):
        found.append(losses.loss_rows(m.forward(x).withColumnRenamed("x", "o").join(x.select("id", "t"), "id"), "ce").first()["loss"])
        m.backprop(x)
        m.sgd(0.02, 0.0)
    return spark.createDataFrame([(k, found[k] < found[k - 1]) for k in range(1, 4)], "epoch int, better boolean")


#: SQL: the embeddings as images of 8 x 4 cells and two channels, their normalised values and the output's gradient.
TWO = (
    f"{E}, s AS (SELECT k % 2 AS c, avg(v) AS m, 1 / (sqrt(avg(v * v) - avg(v) * avg(v)) + 1e-6) AS r FROM e GROUP BY k % 2), "
    "h AS (SELECT vec_id, k, c, (v - m) * r AS hat, r, CASE WHEN c = 0 THEN 1.5 ELSE 0.5 END::DOUBLE AS gamma FROM e JOIN s ON e.k % 2 = s.c), "
    "g AS (SELECT *, gamma * hat + CASE WHEN c = 0 THEN 0.25 ELSE -0.25 END - 0.1 * (vec_id % 3) * (k % 5) AS dy FROM h)"
)


@query(
    "bwd_batchnorm_dx",
    f"WITH {TWO}, n AS (SELECT c, avg(dy) AS mean, avg(dy * hat) AS dotted FROM g GROUP BY c) SELECT vec_id, k, {r6('gamma * r * (dy - mean - hat * dotted)')} AS v FROM g JOIN n USING (c)",
)
def bwd_batchnorm_dx(spark: SparkSession, d: str) -> DataFrame:
    """Of two channels: each sample's gradient depends on all samples by way of mean and deviation."""
    m = Model(500, (8, 4, 2)).batchnorm().set(0, "w", [1.5, 0.5]).set(0, "b", [0.25, -0.25])
    k = F.sequence(F.lit(0), F.lit(63))
    x = samples(spark, d).withColumn("t", F.transform(k, lambda j: 0.1 * (F.col("id") % 3) * (j % 5)))
    return gradient_cells(m, x)


@query("opt_max_norm", f"WITH {GRAD}, l AS (SELECT name, sqrt(sum(g * g)) AS l FROM g GROUP BY name) SELECT name, o, k, {r6('w - 0.1 * g * least(1, 2.0 / l)')} AS v FROM par JOIN g USING (name, o, k) JOIN l USING (name)")
def opt_max_norm(spark: SparkSession, d: str) -> DataFrame:
    """A gradient longer than 2 is cut to that length."""
    m = dense().softmax()
    m.max_norm = 2.0
    m.backprop(targets(spark, d))
    return parameter_rows(spark, m.sgd(0.1, 0.0).params, 64)


#: Two steps with gradients 1 and -3, from weight 2.
@query(
    "opt_adam_two_steps",
    "WITH a AS (SELECT 0.9::DOUBLE AS b, 0.999::DOUBLE AS c), m AS (SELECT (1 - b) * 1 AS m1, (1 - c) * 1 AS v1, b * (1 - b) * 1 + (1 - b) * -3 AS m2, c * (1 - c) * 1 + (1 - c) * 9 AS v2 FROM a) SELECT round(2 - 0.01 * m1 / (sqrt(v1) + 1e-6) - 0.01 * m2 / (sqrt(v2) + 1e-6), 6) AS adam, "
    "round(2 - 0.01 * 1 - 0.01 * (0.9::DOUBLE * 1 + (1 - 0.9::DOUBLE) * -3), 6) AS momentum FROM m",
)
def opt_adam_two_steps(spark: SparkSession, d: str) -> DataFrame:
    """The second step uses the first one's moments."""
    out = []
    for step in (lambda m: m.adam(0.01), lambda m: m.sgd(0.01, 0.9)):
        m = Model(1, (1, 1, 1)).linear(1).set(0, "w", [2.0])
        for g in (1.0, -3.0):
            m.gradients = {(0, "w"): np.array([[g]])}
            step(m)
        out.append(round(float(m.params[0, "w"][0, 0]), 6))
    return spark.createDataFrame([tuple(out)], "adam double, momentum double")
