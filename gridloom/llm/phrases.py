"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, the phrases' names into phrases of the next level, and so on. On each level runs
of one symbol become one symbol; then deterministic coin tossing turns each symbol into the place of the lowest bit in
which it differs from its left neighbour, and that bit's value, four times over until six letters are left; letters 3 to 5
give way to the least of 0 to 2 that no neighbour has; and phrases begin at local maxima, and at local minima that are
next to none. A phrase of two to four symbols thus begins or not by what stands within a few symbols of it, and its name
is a hash of its symbols: equal substrings share all phrases but those at their borders, wherever they stand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bytesnp as B
from gridloom.llm.common import list_array, map_batches, pick, table

_BASE = 0xA0761D6478BD642F
_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Settings:
    """levels of parsing; a phrase of level n stands for some 2.5**n bytes, runs aside."""

    levels: int = 6


def _firsts(first: np.ndarray, n: int) -> np.ndarray:
    """Marks the first symbol of each text."""
    out = np.zeros(n, bool)
    out[first[:-1][np.diff(first) > 0]] = True
    return out


def squeeze(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a symbol within a text become one symbol, named by symbol and length; single symbols keep their name."""
    n = len(s)
    new = _firsts(first, n)
    new[1:] |= s[1:] != s[:-1]
    start = np.flatnonzero(new)
    length = np.diff(start, append=n).astype(B.U64)
    out = s[start]
    run = length > 1
    out[run] = B.mix(out[run] + length[run] * B.U64(0x9E3779B97F4A7C15))
    return out, np.searchsorted(start, first)


def toss(s: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Letters 0 to 5, neighbours of one text different; the first symbol of a text takes its own lowest bits."""
    label = s
    for _ in range(4):
        differ = np.empty_like(label)
        differ[1:] = label[1:] ^ label[:-1]
        differ[begins] = 1
        low = np.bitwise_count((differ & (~differ + B.U64(1))) - B.U64(1)).astype(B.U64)
        label = (low << B.U64(1)) | ((label >> low) & B.U64(1))
    return label.astype(np.int8)


def borders(label: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where phrases begin, from letters 0 to 5 (more at the first symbols of a text)."""
    n = len(label)
    ends = np.empty(n, bool)
    ends[:-1] = begins[1:]
    ends[-1] = True
    x = label.copy()

    def near() -> tuple[np.ndarray, np.ndarray]:
        left, right = np.empty_like(x), np.empty_like(x)
        left[1:], right[:-1] = x[:-1], x[1:]
        left[begins], right[ends] = -1, -1
        return left, right

    for v in range(int(x.max(initial=0)), 2, -1):
        at = np.flatnonzero(x == v)
        if len(at):
            left, right = np.where(begins[at], -1, x[at - 1]), np.where(ends[at], -1, x[np.minimum(at + 1, n - 1)])
            x[at] = np.where((left != 0) & (right != 0), 0, np.where((left != 1) & (right != 1), 1, 2))
    left, right = near()
    top = (x > left) & (x > right) & ~begins & ~ends
    low = (x < left) & (x < right) & ~begins & ~ends
    beside = np.zeros(n, bool)
    beside[1:] |= top[:-1]
    beside[:-1] |= top[1:]
    return top | (low & ~beside) | begins


def parse(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the phrases' names, and each text's range in them."""
    if not len(s):
        return s, first
    s, first = squeeze(s, first)
    begins = _firsts(first, len(s))
    start = np.flatnonzero(borders(toss(s, begins), begins))
    end = np.append(start[1:], len(s))
    return B.span_hash(s, start, end, _BASE, _INVERSE), np.searchsorted(start, first)


def signatures(texts: pa.Array, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the last level for all texts one after another, and each text's range."""
    data, off = B.batch_bytes(texts)
    s, first = data.astype(B.U64) + B.U64(1), off
    for _ in range(levels):
        s, first = parse(s, first)
    return s, first


def hierarchy(texts: pa.Array, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(row, level, name) of each text's distinct names of each level, sorted; and the last level as ``signatures`` has it."""
    data, off = B.batch_bytes(texts)
    s, first = data.astype(B.U64) + B.U64(1), off
    found = []
    for level in range(1, levels + 1):
        s, first = parse(s, first)
        row, name = np.repeat(np.arange(len(first) - 1), np.diff(first)), s.view(np.int64)
        order = np.lexsort((name, row))
        row, name = row[order], name[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])
        found.append((row[new], np.full(int(new.sum()), level, np.int8), name[new]))
    row, level, name = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], level[order], name[order], (s, first)


def apply(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, fingerprint, phrases, signatures, levels) of every row of docs.

    signatures: the distinct names of the phrases of all levels, lowest level first, sorted in each; levels: the level of
    each, from 1. Two texts share a passage where they share names of a level whose phrases fit into it. phrases: how many
    the last level has, with repeats; fingerprint: a hash of these in order, equal for equal texts. A null or empty text
    has none: null, 0 and empty lists. Repeated rows have equal results; null ids stay null. An empty table gives an empty
    result. Other columns are ignored.
    """

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, level, name, (names, first) = hierarchy(batch.column(1), s.levels)
        count = np.diff(first)
        whole = B.span_hash(names, first[:-1], first[1:], _BASE, _INVERSE).view(np.int64)
        each = np.bincount(row, minlength=len(count))
        cols = [batch.column(0), pa.array(whole, mask=count == 0), pa.array(count.astype(np.int32)), list_array(pa.array(name), each), list_array(pa.array(level), each)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "fingerprint", "phrases", "signatures", "levels"])

    schema = "doc_id bigint, fingerprint bigint, phrases int, signatures array<bigint>, levels array<tinyint>"
    return map_batches(pick(docs, doc_id="doc_id", text="text"), f, schema, 250)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))
