"""Vectorised text primitives shared by the corpus operators.

Everything here works on one Arrow batch at a time: the UTF-8 bytes of all its texts in one buffer, with NumPy
arithmetic modulo 2**64 instead of a Python loop over words. Nothing depends on how rows are split into batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_KBASE = 0xD6E8FEB86659FD93
_KBASE_INV = pow(_KBASE, -1, 1 << 64)
#: Two independent bases, with their inverses, for hashes of 128 bits.
BASES = ((_KBASE, _KBASE_INV), (0xA24BAED4963EE407, pow(0xA24BAED4963EE407, -1, 1 << 64)))
ALL_ONES = U64(0xFFFFFFFFFFFFFFFF)

#: ASCII white space separates words; the same six characters as the class \\s of RE2 and Java, plus vertical tab.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: ASCII that is neither letter nor digit.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1024
        while size < n:
            size *= 2
        have = np.empty(size, U64)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * U64(pow(base, done, 1 << 64))
            done += step
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int, inverse: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for many spans at once, equal for equal content at any offset."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return mix((total[end] - total[start]) * powers(inverse, len(values) + 1)[start] + (end - start).astype(U64))


@dataclass
class Words:
    """The words of a batch: byte spans in ``data``, hashes, and for each row its range ``first[i]:first[i + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    row: np.ndarray


def batch_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts one after another, and the len+1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def fold(texts: pa.Array) -> pa.Array:
    """Lower case; with PUNCTUATION as separators, words then match whatever their case and punctuation."""
    return pc.utf8_lower(texts.cast(pa.large_string()))


def split_words(texts: pa.Array, separators: np.ndarray = SPACE) -> Words:
    """Words between separators of every text of the batch, with their hashes."""
    data, off = batch_bytes(texts)
    n = len(data)
    word = ~separators[data]
    begins, stops = word.copy(), word.copy()
    # A word ends at white space or where its text ends.
    inner = off[1:-1][off[1:-1] < n]
    if n:
        begins[1:] &= ~word[:-1]
        begins[inner] |= word[inner]
        stops[:-1] &= ~word[1:]
        last = off[1:-1][off[1:-1] > 0] - 1
        stops[last] |= word[last]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(stops) + 1
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(data, start, end, span_hash(data.astype(U64) + U64(1), start, end, _BASE, _BASE_INV), first, row)


def kgram_hash(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether all k are of one text."""
    n = len(w.hash)
    m = max(0, n - k + 1)
    at = np.arange(m)
    return span_hash(w.hash, at, at + k, _KBASE, _KBASE_INV), w.row[:m] == w.row[k - 1 : k - 1 + m]


def sliding(values: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over values[i : i + w] for each i with a whole window, by doubling."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out
