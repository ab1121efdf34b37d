"""A model of words by deleted interpolation: n-grams of one to three words, whole vocabulary.

Words are lower-cased, between white space and ASCII punctuation; a text begins with a symbol of its own and ends with
another. An n-gram is its order and its hash, of 16 bits more than it takes to number the bytes of all texts: with half as
many n-grams as bytes one look-up in 130,000 meets a wrong one, whatever the size. Documents are cut into blocks by hash. Each block sends the
sorted list of its distinct n-grams with their counts, cut into parts by hash; a part adds up what all blocks have, and
answers each with the sums in the order of its list, so that an answer needs no hashes. Nothing is broadcast, and lists
and answers grow with the corpus.

The maximum-likelihood estimates of orders 3, 2 and 1 and the uniform one over the vocabulary are mixed by weights that
depend on how often the context of two was seen (by powers of two). All counts are those of the other documents: a text
must not vouch for itself. The weights are learned by expectation-maximisation on every token of one block of
``held_out``; the estimates of its tokens, rounded to a quarter of a power of two, are counted first, so that what the
driver gets is bounded by their number and not by that of the tokens.

Rows of one id and text are all in one block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytesnp as B
from gridloom.llm.common import cut, release

BEGIN, END = B.U64(0x5851F42D4C957F2D), B.U64(0x14057B7EF767814F)
_STEP = B.U64(0x9E3779B97F4A7C15)
ORDER = 3
BUCKETS = 40
ZERO = 255


def pack(x: np.ndarray) -> bytes:
    """64-bit numbers, small ones mostly: the lowest bytes of all, then the next; compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(B.U64).ravel()


def grams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(3, positions) n-grams that end at each position, by order; each position's row; the rows' numbers of words.

    A row with words has a position for its begin, for each word, and for its end.
    """
    hashes, words = [np.zeros(0, B.U64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(texts), 500):
        w = B.split_words(B.fold(texts.slice(lo, 500).fill_null("")), B.PUNCTUATION)
        hashes.append(w.hash)
        words.append(np.diff(w.first))
    n = np.concatenate(words)
    size = np.where(n > 0, n + 2, 0)
    row = np.repeat(np.arange(len(n)), size)
    stop = np.cumsum(size)[size > 0]
    begins = stop - size[size > 0]
    x = np.zeros(len(row), B.U64)
    inner = np.ones(len(row), bool)
    inner[begins], inner[stop - 1] = False, False
    x[inner] = np.concatenate(hashes)
    x[begins], x[stop - 1] = BEGIN, END

    def longer(h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The n-grams of h, each with the symbol behind it; first: what stands before a text's begin."""
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[begins] = first
        return B.mix(B.mix(before + _STEP) + x)

    two = longer(x, BEGIN)
    three = longer(two, B.mix(B.mix(np.array([BEGIN]) + _STEP) + BEGIN)[0])
    return np.stack([named(h, k, bits) for k, h in enumerate((B.mix(x), two, three), 1)]), row, n


def width(size: int) -> int:
    """Bits of a name, its order included, for texts of so many bytes."""
    return min(64, max(34, size.bit_length() + 18))


def named(h: np.ndarray, order: int, bits: int) -> np.ndarray:
    """A number of so many bits, the order lowest."""
    return ((h >> B.U64(64 - bits)) & ~B.U64(3)) | B.U64(order)


def starts(h: np.ndarray) -> np.ndarray:
    """Marks the first of each run of equal values."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return new


def listed(parts: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    """(block, part, size, grams, counts) of a block's rows (block, doc_id, text)."""

    def f(rows: pa.Table) -> pa.Table:
        h = np.sort(grams(rows.column("text").combine_chunks(), bits)[0], axis=None)
        at = np.flatnonzero(starts(h))
        n, h = np.diff(at, append=len(h)), h[at]
        edge = np.searchsorted(part_of(h, parts, bits), np.arange(parts + 1))
        spans = [(p, a, b) for p, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
        block = rows.column("block")[0].as_py() if rows.num_rows else 0
        cols = [pa.array([block] * len(spans), pa.int32()), pa.array([p for p, _, _ in spans], pa.int32()), pa.array([b - a for _, a, b in spans], pa.int32())]
        cols += [pa.array([pack(np.diff(h[a:b], prepend=B.U64(0))) for _, a, b in spans], pa.binary()), pa.array([pack(n[a:b]) for _, a, b in spans], pa.binary())]
        return pa.Table.from_arrays(cols, ["block", "part", "size", "grams", "counts"])

    return f


def part_of(h: np.ndarray, parts: int, bits: int) -> np.ndarray:
    return ((h >> B.U64(bits - 32)) * B.U64(parts)) >> B.U64(32)


def added(rows: pa.Table, bits: int) -> pa.Table:
    """(block, part, size, counts, kinds, tokens): for each list of a part, the sums over all; the first has the part's numbers of different and of all words."""
    size = rows.column("size").to_numpy()
    h = np.concatenate([np.cumsum(unpack(g, k), dtype=B.U64) for g, k in zip(rows.column("grams").to_pylist(), size, strict=True)])
    n = np.concatenate([unpack(g, k) for g, k in zip(rows.column("counts").to_pylist(), size, strict=True)]).astype(np.int64)
    order = np.argsort(h)
    new = starts(h[order])
    at = np.flatnonzero(new)
    total = np.add.reduceat(n[order], at)
    word = (h[order[at]] & B.U64(3) == 1) & (h[order[at]] != named(B.mix(np.array([BEGIN])), 1, bits)[0])
    every = np.empty(len(h), np.int64)
    every[order] = total[np.cumsum(new) - 1]
    off = np.cumsum(size) - size
    first = np.zeros(len(size), np.int64)
    first[0] = 1
    cols = [rows.column("block"), rows.column("part"), rows.column("size"), pa.array([pack(every[a : a + k]) for a, k in zip(off, size, strict=True)], pa.binary())]
    return pa.Table.from_arrays([*cols, pa.array(first * word.sum()), pa.array(first * total[word].sum())], ["block", "part", "size", "counts", "kinds", "tokens"])


def looked_up(texts: pa.Array, answers: pa.Table, tokens: int, bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Estimates of orders 3 to 1 for each word and end of a block's texts, their contexts' frequencies, rows; numbers of words."""
    h, row, n = grams(texts, bits)
    if not len(row):
        return [np.zeros(0)] * ORDER, np.zeros(0, np.int64), row, n
    answers = answers.sort_by("part")
    total = np.concatenate([unpack(c, k) for c, k in zip(answers.column("counts").to_pylist(), answers.column("size").to_pylist(), strict=True)]).astype(np.int64)
    flat = h.ravel()
    # Positions stand by row, so that a stable order has an n-gram's occurrences by row as well.
    order = np.argsort(flat, kind="stable")
    new = starts(flat[order])
    del h, flat
    if new.sum() != len(total):
        raise ValueError("the documents changed between two readings")
    others = total[np.cumsum(new) - 1]
    new |= starts(row[order % len(row)])
    own = np.diff(np.flatnonzero(new), append=len(new))
    others -= np.repeat(own, own)
    count = np.empty(len(order), np.int64)
    count[order] = others
    one, two, three = count.reshape(ORDER, -1)
    at = np.flatnonzero(~starts(row))
    rest = np.maximum(tokens - (n + 1)[row[at]], 0)
    return [ratio(three[at], two[at - 1]), ratio(two[at], one[at - 1]), ratio(one[at], rest)], two[at - 1], row[at], n


def ratio(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """n / total; where a wrong n-gram was met, n may be the larger, and the estimate is 1."""
    return np.divide(np.minimum(n, total), total, out=np.zeros(len(n)), where=total > 0)


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def rounded(p: list[np.ndarray], context: np.ndarray) -> np.ndarray:
    """One number for each token's bucket and estimates, these in quarters of a power of two."""
    key = bucket(context).astype(np.int64)
    for x in p:
        some = x > 0
        q = np.full(len(x), ZERO, np.int64)
        q[some] = np.minimum(np.rint(-4 * np.log2(x[some])), ZERO - 1)
        key = (key << 8) | q
    return key


def learn(key: np.ndarray, n: np.ndarray, kinds: int, rounds: int) -> np.ndarray:
    """(BUCKETS, 4) mixture weights; a bucket without tokens takes those of the nearest below, at first equal ones."""
    weights = np.full((BUCKETS, ORDER + 1), 1 / (ORDER + 1))
    if not len(key):
        return weights
    q = np.stack([(key >> k) & 255 for k in (16, 8, 0)], 1)
    p = np.column_stack([np.where(q == ZERO, 0.0, 2.0 ** (-q / 4)), np.full(len(key), 1 / max(1, kinds))])
    b_ = key >> 24
    for _ in range(rounds):
        share = p * weights[b_]
        share *= (n / share.sum(1))[:, None]
        total = np.stack([np.bincount(b_, weights=share[:, k], minlength=BUCKETS) for k in range(ORDER + 1)], 1)
        some = total.sum(1) > 0
        weights[some] = (total[some] + 1e-6) / (total[some] + 1e-6).sum(1, keepdims=True)
    for b in range(1, BUCKETS):
        if not some[b]:
            weights[b] = weights[b - 1]
    return weights


def answered(keyed: DataFrame, blocks: int, bits: int) -> DataFrame:
    """(block, part, size, counts, kinds, tokens), stored: the counts of all n-grams of each block."""
    lists = keyed.groupBy("block").applyInArrow(listed(blocks, bits), "block int, part int, size int, grams binary, counts binary")
    return cut(lists.groupBy("part").applyInArrow(lambda rows: added(rows, bits), "block int, part int, size int, counts binary, kinds bigint, tokens bigint"))


def scored(docs: DataFrame, f: Callable[[pa.Array, pa.Array, np.ndarray, np.ndarray], pa.Table], schema: str, held_out: int, rounds: int, block: int) -> DataFrame:
    """f(ids, texts, words, bits) of each block of docs (doc_id, text); words and bits a row each."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, bits = max(1, -(-size // block)), width(size)
    keyed = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")
    answers = answered(keyed, blocks, bits)
    release(docs.sparkSession)
    kinds, tokens = (x or 0 for x in answers.agg(F.sum("kinds"), F.sum("tokens")).first())
    back = answers.select("block", "part", "size", "counts")

    def seen(_: tuple, rows: pa.Table, got: pa.Table) -> pa.Table:
        p, context, _, _ = looked_up(rows.column("text").combine_chunks(), got, tokens, bits)
        key, n = np.unique(rounded(p, context), return_counts=True)
        return pa.Table.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    def some(df: DataFrame) -> DataFrame:
        return df.where(F.col("block") % held_out == 0).groupBy("block")

    got = some(keyed).cogroup(some(back)).applyInArrow(seen, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    release(docs.sparkSession)
    weights = learn(got.column("key").to_numpy(), got.column("n").to_numpy(), kinds, rounds)

    def score(_: tuple, rows: pa.Table, got: pa.Table) -> pa.Table:
        texts = rows.column("text").combine_chunks()
        p, context, row, n = looked_up(texts, got, tokens, bits)
        w = weights[bucket(context)]
        mixed = sum(w[:, k] * x for k, x in enumerate([*p, 1 / max(1, kinds)]))
        cost = np.bincount(row, weights=-np.log2(mixed), minlength=len(n))
        del p, context, row, w, mixed
        return f(rows.column("doc_id").combine_chunks(), texts, n, cost)

    return keyed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, schema)
