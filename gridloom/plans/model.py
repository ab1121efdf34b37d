"""Sequential models over DataFrames of samples (id, x), x the flattened H*W*C values.

A pass over the data is one map over Arrow batches in which all layers run; parameters are small and travel with the
task. Batch normalisation needs sums over all samples, so each such layer costs one more aggregation on the way. Gradients
are summed by Spark, cell by cell, from what each batch contributes: data-parallel training without moving a sample.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import kernels as K

ACTIVATIONS = ("relu", "tanh", "sigmoid", "selu", "leakyrelu", "elu")
#: Numbers of a gradient that travel in one row.
CHUNK = 1 << 16
POOLS = {"maxpool": "max", "avgpool": "avg", "minpool": "min"}


@dataclass
class Layer:
    """op, output shape (h, w, c), and what the op needs: k, stride, pad, a (slope, rate or momentum)."""

    op: str
    shape: tuple[int, int, int]
    k: int = 0
    stride: int = 1
    pad: int = 0
    a: float = 0.0


@dataclass
class Model:
    """compat='ref' keeps the quirks on which published figures rest: sigmoid gradients pass through, and a few more."""

    batch: int
    shape: tuple[int, int, int]
    compat: str | None = None
    seed: int = 0
    layers: list[Layer] = field(default_factory=list)
    params: dict[tuple[int, str], np.ndarray] = field(default_factory=dict)
    gradients: dict[tuple[int, str], np.ndarray] = field(default_factory=dict)
    moments: dict[tuple[int, str, str], np.ndarray] = field(default_factory=dict)
    trainable: bool = True
    step: int = 0
    epoch: int = 0
    max_norm: float = 0.0

    def __getstate__(self) -> dict:
        """What a task needs: no gradients or moments, and nothing that was hung on the model by a session."""
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__} | {"gradients": {}, "moments": {}}

    # building

    @property
    def out(self) -> tuple[int, int, int]:
        return self.layers[-1].shape if self.layers else self.shape

    def _add(self, layer: Layer, **params: np.ndarray) -> Model:
        i = len(self.layers)
        self.layers.append(layer)
        for name, value in params.items():
            self.params[i, name] = np.asarray(value, float)
        return self

    def _uniform(self, size: tuple[int, ...], k: float) -> np.ndarray:
        return np.random.default_rng((self.seed, len(self.layers), len(size))).uniform(-k, k, size)

    def conv2d(self, bias: float, channels: int, k: int = 3, stride: int = 1, pad: int | None = None) -> Model:
        h, w, c = self.out
        pad = (k - 1) // 2 if pad is None else pad
        if (k, stride, pad) not in {(1, 1, 0), (3, 1, 1), (5, 1, 2)}:
            raise ValueError(f"no convolution of size {k}, stride {stride}, padding {pad}")
        shape = ((h - k + 2 * pad) // stride + 1, (w - k + 2 * pad) // stride + 1, channels)
        f = self._uniform((c, k, k, channels), math.sqrt(6 / (k * k * c)))
        return self._add(Layer("conv2d", shape, k, stride, pad), w=f, b=self._uniform((channels,), bias))

    def conv1x1(self, bias: float, channels: int) -> Model:
        return self.conv2d(bias, channels, 1, 1, 0)

    def dconv2d(self, bias: float, channels: int, k: int = 4, stride: int = 2, pad: int = 1) -> Model:
        h, w, c = self.out
        shape = ((h - 1) * stride + k - 2 * pad, (w - 1) * stride + k - 2 * pad, channels)
        f = self._uniform((c, k, k, channels), math.sqrt(6 / (k * k * c)))
        return self._add(Layer("dconv2d", shape, k, stride, pad), w=f, b=self._uniform((channels,), bias))

    def linear(self, n: int, bias: float = 1.0) -> Model:
        e1 = math.prod(self.out)
        return self._add(Layer("linear", (1, n, 1)), w=self._uniform((n, e1), math.sqrt(1 / (n + e1))), b=self._uniform((n,), bias))

    def flatten(self) -> Model:
        return self._add(Layer("flatten", (1, math.prod(self.out), 1)))

    def activation(self, name: str, a: float | None = None) -> Model:
        default = {"leakyrelu": 0.01, "elu": 1.0}.get(name, 0.0)
        return self._add(Layer(name, self.out, a=default if a is None else a))

    def relu(self) -> Model:
        return self.activation("relu")

    def tanh(self) -> Model:
        return self.activation("tanh")

    def sigmoid(self) -> Model:
        return self.activation("sigmoid")

    def selu(self) -> Model:
        return self.activation("selu")

    def leakyrelu(self, a: float = 0.01) -> Model:
        return self.activation("leakyrelu", a)

    def elu(self, a: float = 1.0) -> Model:
        return self.activation("elu", a)

    def dropout(self, p: float) -> Model:
        return self._add(Layer("dropout", self.out, a=p))

    def softmax(self) -> Model:
        return self._add(Layer("softmax", self.out))

    def logsoftmax(self) -> Model:
        return self._add(Layer("logsoftmax", self.out))

    def batchnorm(self, momentum: float = 0.1) -> Model:
        c = self.out[2]
        return self._add(Layer("batchnorm", self.out, a=momentum), w=np.ones(c), b=np.zeros(c))

    def pool(self, op: str, k: int) -> Model:
        if k not in (2, 3):
            raise ValueError("pools take windows of 2 or 3")
        h, w, c = self.out
        return self._add(Layer(op, (-(-h // k), -(-w // k), c), k))

    def maxpool(self, k: int = 2) -> Model:
        return self.pool("maxpool", k)

    def avgpool(self, k: int = 2) -> Model:
        return self.pool("avgpool", k)

    def minpool(self, k: int = 2) -> Model:
        return self.pool("minpool", k)

    def upsample(self, k: int) -> Model:
        h, w, c = self.out
        return self._add(Layer("upsample", (h * k, w * k, c), k))

    def set(self, layer: int, name: str, value: np.ndarray | list) -> Model:
        """A parameter, of as many values as it has."""
        old = self.params[layer, name]
        new = np.asarray(value, float)
        if new.size != old.size:
            raise ValueError(f"{new.size} values for a parameter of {old.size}")
        self.params[layer, name] = new.reshape(old.shape)
        return self

    # one batch

    def _forward(self, x: np.ndarray, ids: np.ndarray, stats: dict[int, tuple[np.ndarray, np.ndarray]], until: int) -> list[np.ndarray]:
        """Inputs of layers 0 .. until, the last being the output of layer until - 1."""
        seen = [x]
        for i, l in enumerate(self.layers[:until]):
            w, b = self.params.get((i, "w")), self.params.get((i, "b"))
            if l.op == "conv2d":
                x = K.conv(x, w, b, l.stride, l.pad)
            elif l.op == "dconv2d":
                x = K.deconv(x, w, b, l.stride, l.pad)
            elif l.op == "linear":
                x = K.linear(x, w, b)
            elif l.op == "flatten":
                x = x.reshape(len(x), *l.shape)
            elif l.op in ACTIVATIONS:
                x = K.activate(l.op, x, l.a, self.compat == "ref")
            elif l.op in POOLS:
                x = K.pool(x, l.k, POOLS[l.op])
            elif l.op == "upsample":
                x = K.upsample(x, l.k)
            elif l.op == "dropout":
                x = x * self._mask(i, ids, x.shape)
            elif l.op == "softmax":
                x = K.softmax(x)
            elif l.op == "logsoftmax":
                x = K.log_softmax(x)
            elif l.op == "batchnorm":
                x = K.norm(x, *stats[i], w, b)[0]
            else:
                raise ValueError(l.op)
            seen.append(x)
        return seen

    def _mask(self, i: int, ids: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
        seed = self.seed * 1009 + i + 7919 * self.step
        return K.dropout_mask(ids, math.prod(shape[1:]), self.layers[i].a, seed).reshape(shape)

    def _output_gradient(self, y: np.ndarray, t: np.ndarray) -> np.ndarray:
        t = t.reshape(y.shape)
        if self.layers and self.layers[-1].op == "logsoftmax" and self.compat != "ref":
            return np.exp(y) - t
        return y - t

    def _backward(self, seen: list[np.ndarray], ids: np.ndarray, t: np.ndarray, stats: dict, sums: dict, until: int = 0) -> tuple[np.ndarray, dict]:
        """Gradient of the input of layer ``until``, and of the parameters from there on."""
        grads: dict[tuple[int, str], np.ndarray] = {}
        d = self._output_gradient(seen[-1], t)
        last = len(self.layers) - 1
        for i in range(last, until - 1, -1):
            l, x, y = self.layers[i], seen[i], seen[i + 1]
            w = self.params.get((i, "w"))
            if l.op == "conv2d":
                d, grads[i, "w"], grads[i, "b"] = K.conv_gradient(x, w, d, l.stride, l.pad)
            elif l.op == "dconv2d":
                d, grads[i, "w"], grads[i, "b"] = K.deconv_gradient(x, w, d, l.stride, l.pad)
            elif l.op == "linear":
                d, grads[i, "w"], grads[i, "b"] = K.linear_gradient(x, w, d)
            elif l.op == "flatten":
                d = d.reshape(x.shape)
            elif l.op == "sigmoid" and (self.compat == "ref" or i == last):
                pass
            elif l.op in ("softmax", "logsoftmax"):
                if i != last:
                    raise ValueError(f"{l.op} must be the last layer")
            elif l.op in ACTIVATIONS:
                d = d * K.slope(l.op, x, y, l.a)
            elif l.op in POOLS:
                d = K.pool_gradient(x, d, l.k, POOLS[l.op])
            elif l.op == "upsample":
                d = K.upsample_gradient(d, l.k)
            elif l.op == "dropout":
                d = d * self._mask(i, ids, x.shape)
            elif l.op == "batchnorm":
                _, hat, r = K.norm(x, *stats[i], w, self.params[i, "b"])
                grads[i, "w"], grads[i, "b"] = (d * hat).sum((0, 1, 2)), d.sum((0, 1, 2))
                if i in sums:
                    n, total, dotted = sums[i]
                    d = w * r * (d - total / n - hat * dotted / n)
        return d, grads

    # passes over the data

    def _rows(self, batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
        values = batch.column(batch.schema.get_field_index(name))
        return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)

    def _samples(self, df: DataFrame, *more: str) -> DataFrame:
        return df.select(F.col("id").cast("bigint").alias("id"), F.col("x").cast("array<double>").alias("x"), *[F.col(m).cast("array<double>").alias(m) for m in more])

    def _sums(self, df: DataFrame, f) -> np.ndarray:
        """Sum over all batches of the vector that f makes of each: a task sends its sum in chunks, which are added apart."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    v = f(batch)
                    total = v if total is None else total + v
            for k in range(0, 0 if total is None else len(total), CHUNK):
                part = total[k : k + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))], ["k", "v"])

        def add(rows: pa.Table) -> pa.Table:
            v = np.stack([x.values.to_numpy() for x in rows.column("v")]).sum(0)
            return pa.Table.from_arrays([pa.array([rows.column("k")[0].as_py()], pa.int32()), pa.array([v], pa.list_(pa.float64()))], ["k", "v"])

        got = df.mapInArrow(run, "k int, v array<double>").groupBy("k").applyInArrow(add, "k int, v array<double>").toArrow().sort_by("k")
        return np.concatenate([np.zeros(0), *[x.values.to_numpy() for x in got.column("v")]])

    def statistics(self, df: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Mean and biased variance by channel at each batch normalisation, in order of the layers."""
        stats: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, l in enumerate(self.layers):
            if l.op == "batchnorm":
                got = self._sums(self._samples(df), lambda b, i=i: _moments(self._forward(self._shaped(b), _ids(b), stats, i)[-1]))
                c = (len(got) - 1) // 2
                mean = got[1 : 1 + c] / got[0]
                stats[i] = (mean, got[1 + c :] / got[0] - mean**2)
        return stats

    def _shaped(self, batch: pa.RecordBatch) -> np.ndarray:
        return self._rows(batch).reshape(batch.num_rows, *self.shape)

    def forward(self, df: DataFrame, upto: int | None = None) -> DataFrame:
        """(id, x) outputs of the last layer, or of the first ``upto`` layers."""
        until = len(self.layers) if upto is None else upto
        stats = self.statistics(df) if any(l.op == "batchnorm" for l in self.layers[:until]) else {}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    y = self._forward(self._shaped(batch), _ids(batch), stats, until)[-1].reshape(batch.num_rows, -1)
                    off = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(off, pa.array(y.ravel()))], ["id", "x"])

        return self._samples(df).mapInArrow(run, "id bigint, x array<double>")

    def _norm_sums(self, data: DataFrame, stats: dict, targets: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        """Count and sums of the gradient at each batch normalisation, from the last to the first: all samples share them."""
        depth = len(self.layers)
        sums: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
        for i in range(depth - 1, -1, -1):
            if self.layers[i].op == "batchnorm":

                def at(b: pa.RecordBatch, i: int = i) -> np.ndarray:
                    seen = self._forward(self._shaped(b), _ids(b), stats, depth)
                    _, g = self._backward(seen, _ids(b), self._rows(b, targets), stats, sums, i)
                    return np.concatenate([[seen[i].size / seen[i].shape[3]], g[i, "b"], g[i, "w"]])

                got = self._sums(data, at)
                c = (len(got) - 1) // 2
                sums[i] = (got[0], got[1 : 1 + c], got[1 + c :])
        return sums

    def backprop(self, df: DataFrame, targets: str = "t") -> Model:
        """Gradients of all parameters from samples (id, x, targets), summed over the samples."""
        stats = self.statistics(df)
        data = self._samples(df, targets)
        depth = len(self.layers)
        sums = self._norm_sums(data, stats, targets)
        names = sorted(self.params)

        def gradient(b: pa.RecordBatch) -> np.ndarray:
            _, g = self._backward(self._forward(self._shaped(b), _ids(b), stats, depth), _ids(b), self._rows(b, targets), stats, sums)
            return np.concatenate([g[n].ravel() for n in names])

        total = self._sums(data, gradient) if names else np.zeros(0)
        at_ = 0
        for n in names:
            size = self.params[n].size
            if len(total):
                self.gradients[n] = self.gradients.get(n, 0.0) + total[at_ : at_ + size].reshape(self.params[n].shape)
            at_ += size
        return self

    def input_gradient(self, df: DataFrame, targets: str = "t") -> DataFrame:
        """(id, x) gradient of each sample's values."""
        stats = self.statistics(df)
        depth = len(self.layers)
        sums = self._norm_sums(self._samples(df, targets), stats, targets)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    d, _ = self._backward(self._forward(self._shaped(b), _ids(b), stats, depth), _ids(b), self._rows(b, targets), stats, sums)
                    d = d.reshape(b.num_rows, -1)
                    off = pa.array(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(off, pa.array(d.ravel()))], ["id", "x"])

        return self._samples(df, targets).mapInArrow(run, "id bigint, x array<double>")

    # optimisers

    def _update(self, f) -> Model:
        if self.trainable:
            for n, g in self.gradients.items():
                if self.max_norm > 0 and np.linalg.norm(g) > self.max_norm:
                    g = g * (self.max_norm / np.linalg.norm(g))
                self.params[n] = f(n, self.params[n], g)
        self.gradients = {}
        self.step += 1
        return self

    def sgd(self, rate: float, beta: float = 0.9) -> Model:
        """The first step goes without momentum."""
        b = beta if self.step else 0.0

        def f(n, w, g):
            if abs(b) < 1e-6:
                if beta:
                    self.moments[*n, "m"] = g
                return w - rate * g
            m = b * self.moments.get((*n, "m"), 0.0) + (1 - b) * g
            self.moments[*n, "m"] = m
            return w - rate * m

        return self._update(f)

    def adam(self, rate: float = 1e-3, b1: float = 0.9, b2: float = 0.999, decay: float = 0.0, bias_correction: bool = False) -> Model:
        def f(n, w, g):
            m = b1 * self.moments.get((*n, "m"), 0.0) + (1 - b1) * g
            v = b2 * self.moments.get((*n, "v"), 0.0) + (1 - b2) * g * g
            self.moments[*n, "m"], self.moments[*n, "v"] = m, v
            if bias_correction:
                m, v = m / (1 - b1 ** (self.step + 1)), v / (1 - b2 ** (self.step + 1))
            return w * (1 - rate * decay) - rate * m / (np.sqrt(v) + 1e-6)

        return self._update(f)

    def adamw(self, rate: float = 1e-3, decay: float = 0.01, b1: float = 0.9, b2: float = 0.999) -> Model:
        return self.adam(rate, b1, b2, decay)

    def zero(self) -> Model:
        self.gradients, self.moments, self.step = {}, {}, 0
        return self

    def loss(self) -> str:
        """The loss that goes with the last layer."""
        last = self.layers[-1].op if self.layers else ""
        return {"tanh": "bce", "sigmoid": "bce", "softmax": "ce", "logsoftmax": "nll"}.get(last, "mse")

    # tables and files

    def describe(self, spark: SparkSession) -> DataFrame:
        """(layer, op, n, h, w, c, n_params, attrs); layer 0 is the input."""
        rows = [(0, "input", self.batch, *self.shape, 0, "{}")]
        for i, l in enumerate(self.layers):
            n = sum(v.size for (j, _), v in self.params.items() if j == i)
            attrs = {k: v for k, v in asdict(l).items() if k not in ("op", "shape") and v}
            rows.append((i + 1, l.op, self.batch, *l.shape, n, json.dumps(attrs, sort_keys=True)))
        return spark.createDataFrame(rows, "layer int, op string, n int, h int, w int, c int, n_params int, attrs string")

    def graph(self, spark: SparkSession) -> DataFrame:
        """(name, op, input, dtype, shape), each node fed by the one before."""
        rows, before = [("input_0", "input", None, "float", f"{self.batch},{self.shape[0]},{self.shape[1]},{self.shape[2]}")], "input_0"
        for i, l in enumerate(self.layers):
            name = f"{l.op}_{i + 1}"
            rows.append((name, l.op, before, "float", f"{self.batch},{l.shape[0]},{l.shape[1]},{l.shape[2]}"))
            before = name
        return spark.createDataFrame(rows, "name string, op string, input string, dtype string, shape string")

    def parameters(self, spark: SparkSession) -> DataFrame:
        rows = [(i, name, list(v.shape), v.ravel().tolist()) for (i, name), v in sorted(self.params.items())]
        return spark.createDataFrame(rows, "layer int, name string, shape array<int>, value array<double>")

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        spec = {"batch": self.batch, "shape": self.shape, "compat": self.compat, "seed": self.seed, "layers": [asdict(l) for l in self.layers]}
        spark.createDataFrame([(json.dumps(spec),)], "spec string").coalesce(1).write.mode(mode).parquet(f"{path}/spec")
        self.parameters(spark).coalesce(1).write.mode(mode).parquet(f"{path}/params")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        spec = json.loads(spark.read.parquet(f"{path}/spec").first()["spec"])
        m = Model(spec["batch"], tuple(spec["shape"]), spec["compat"], spec["seed"])
        m.layers = [Layer(**{**l, "shape": tuple(l["shape"])}) for l in spec["layers"]]
        for r in spark.read.parquet(f"{path}/params").collect():
            m.params[r["layer"], r["name"]] = np.array(r["value"]).reshape(r["shape"])
        return m


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False)


def _moments(x: np.ndarray) -> np.ndarray:
    """Count, sums and sums of squares by channel."""
    return np.concatenate([[x.size / x.shape[3]], x.sum((0, 1, 2)), (x * x).sum((0, 1, 2))])
