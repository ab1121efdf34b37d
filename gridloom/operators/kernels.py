"""Layer kernels on batches of samples (N, H, W, C) in NumPy: forward, and the gradient of the input and the parameters.

They run inside Arrow batches, next to each other for all layers of a model, so that a batch crosses into Python once.
"""

from __future__ import annotations

import numpy as np

SELU_SCALE, SELU_NEGATIVE = 1.0507009873554805, 1.7580993408473766


def windows(x: np.ndarray, k: int, stride: int, pad: int) -> np.ndarray:
    """(N, H0, W0, k, k, C) view of the padded input."""
    p = np.pad(x, ((0, 0), (pad, pad), (pad, pad), (0, 0)))
    v = np.lib.stride_tricks.sliding_window_view(p, (k, k), axis=(1, 2))[:, ::stride, ::stride]
    return v.transpose(0, 1, 2, 4, 5, 3)


def conv(x: np.ndarray, f: np.ndarray, b: np.ndarray, stride: int, pad: int) -> np.ndarray:
    """f is (C1, k, k, C0), as the parameters are stored."""
    return np.einsum("nhwyxc,cyxo->nhwo", windows(x, f.shape[1], stride, pad), f, optimize=True) + b


def conv_gradient(x: np.ndarray, f: np.ndarray, dy: np.ndarray, stride: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """dX, dF, dB."""
    k = f.shape[1]
    df = np.einsum("nhwyxc,nhwo->cyxo", windows(x, k, stride, pad), dy, optimize=True)
    wide = np.zeros((x.shape[0], x.shape[1] + 2 * pad, x.shape[2] + 2 * pad, x.shape[3]))
    h, w = dy.shape[1:3]
    for y in range(k):
        for z in range(k):
            wide[:, y : y + stride * h : stride, z : z + stride * w : stride] += dy @ f[:, y, z].T
    return wide[:, pad : pad + x.shape[1], pad : pad + x.shape[2]], df, dy.sum((0, 1, 2))


def deconv(x: np.ndarray, f: np.ndarray, b: np.ndarray, stride: int, pad: int) -> np.ndarray:
    """Transposed convolution; f is (C1, k, k, C0)."""
    n, h, w, _ = x.shape
    k = f.shape[1]
    wide = np.zeros((n, (h - 1) * stride + k, (w - 1) * stride + k, f.shape[3]))
    for y in range(k):
        for z in range(k):
            wide[:, y : y + stride * h : stride, z : z + stride * w : stride] += x @ f[:, y, z]
    return wide[:, pad : wide.shape[1] - pad, pad : wide.shape[2] - pad] + b


def deconv_gradient(x: np.ndarray, f: np.ndarray, dy: np.ndarray, stride: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = windows(dy, f.shape[1], stride, pad)
    return np.einsum("nhwyxo,cyxo->nhwc", v, f, optimize=True), np.einsum("nhwc,nhwyxo->cyxo", x, v, optimize=True), dy.sum((0, 1, 2))


def linear(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (x.reshape(len(x), -1) @ w.T + b).reshape(len(x), 1, len(b), 1)


def linear_gradient(x: np.ndarray, w: np.ndarray, dy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat, d = x.reshape(len(x), -1), dy.reshape(len(dy), -1)
    return (d @ w).reshape(x.shape), d.T @ flat, d.sum(0)


def _padded(x: np.ndarray, k: int) -> np.ndarray:
    h, w = -x.shape[1] % k, -x.shape[2] % k
    p = np.pad(x, ((0, 0), (0, h), (0, w), (0, 0)), constant_values=np.nan)
    n, hh, ww, c = p.shape
    return p.reshape(n, hh // k, k, ww // k, k, c).transpose(0, 1, 3, 5, 2, 4).reshape(n, hh // k, ww // k, c, k * k)


def pool(x: np.ndarray, k: int, how: str) -> np.ndarray:
    """Windows at the edge hold what is in range."""
    return {"max": np.nanmax, "min": np.nanmin, "avg": np.nanmean}[how](_padded(x, k), axis=-1)


def pool_gradient(x: np.ndarray, dy: np.ndarray, k: int, how: str) -> np.ndarray:
    """To the first extremum of a window, or evenly to its cells."""
    p = _padded(x, k)
    out = np.zeros_like(p)
    if how == "avg":
        live = ~np.isnan(p)
        out = np.where(live, (dy / live.sum(-1))[..., None], 0.0)
    else:
        at = (np.nanargmax if how == "max" else np.nanargmin)(p, axis=-1)
        np.put_along_axis(out, at[..., None], dy[..., None], -1)
    n, h0, w0, c, _ = p.shape
    full = out.reshape(n, h0, w0, c, k, k).transpose(0, 1, 4, 2, 5, 3).reshape(n, h0 * k, w0 * k, c)
    return full[:, : x.shape[1], : x.shape[2]]


def upsample(x: np.ndarray, k: int) -> np.ndarray:
    return x.repeat(k, 1).repeat(k, 2)


def upsample_gradient(dy: np.ndarray, k: int) -> np.ndarray:
    """The mean over each window."""
    return pool(dy, k, "avg")


def activate(name: str, x: np.ndarray, a: float = 0.0, compat: bool = False) -> np.ndarray:
    if name == "relu":
        return np.maximum(x, 0)
    if name == "tanh":
        return np.tanh(x)
    if name == "sigmoid":
        return 1 / (1 + np.exp(-x))
    if name == "selu":
        return np.where(x > 0, x * (1.0 if compat else SELU_SCALE), SELU_NEGATIVE * np.expm1(x))
    if name == "leakyrelu":
        return np.where(x > 0, x, a * x)
    if name == "elu":
        return np.where(x > 0, x, a * np.expm1(x))
    raise ValueError(name)


def slope(name: str, x: np.ndarray, y: np.ndarray, a: float = 0.0) -> np.ndarray:
    if name == "relu":
        return (x > 0).astype(float)
    if name == "tanh":
        return 1 - y * y
    if name == "sigmoid":
        return y * (1 - y)
    if name == "selu":
        return np.where(x > 0, SELU_SCALE, SELU_NEGATIVE * np.exp(x))
    if name == "leakyrelu":
        return np.where(x > 0, 1.0, a)
    if name == "elu":
        return np.where(x > 0, 1.0, a * np.exp(x))
    raise ValueError(name)


def softmax(x: np.ndarray) -> np.ndarray:
    flat = x.reshape(len(x), -1)
    e = np.exp(flat - flat.max(1, keepdims=True))
    return (e / e.sum(1, keepdims=True)).reshape(x.shape)


def log_softmax(x: np.ndarray) -> np.ndarray:
    flat = x.reshape(len(x), -1)
    top = flat.max(1, keepdims=True)
    return (flat - top - np.log(np.exp(flat - top).sum(1, keepdims=True))).reshape(x.shape)


def dropout_mask(ids: np.ndarray, width: int, p: float, seed: int) -> np.ndarray:
    """Kept cells (N, width): a hash of sample, cell and seed, the same wherever a sample is computed."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return (x >> np.uint64(11)).astype(float) / (1 << 53) > p


def norm(x: np.ndarray, mean: np.ndarray, variance: np.ndarray, gamma: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Output, normalised input and 1/(sigma + 1e-6), by channel."""
    r = 1 / (np.sqrt(np.maximum(variance, 0)) + 1e-6)
    hat = (x - mean) * r
    return gamma * hat + beta, hat, r
