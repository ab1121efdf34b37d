"""Language-model scores by deleted interpolation, by characters and by words.

The first is a model of characters, folded to 64 symbols, of order four. The maximum-likelihood estimates of orders 4, 3, 2 and 1 and
the uniform one are mixed by weights that depend on how often the context of three was seen (by powers of two). The
weights are learned by expectation-maximisation on the counts of held-out documents, against estimates from the others;
the scores then use the counts of all documents but the one scored: a text must not vouch for itself.

64**4 n-grams bound the table of counts and its broadcast (128 MB), however large the corpus is; what is gathered from
the corpus are the counts of each task's n-grams, added up by n-gram. It is a model of spelling.

The second, in ``wordlm``, is one of words to order three with the whole vocabulary; its counts grow with the corpus.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import wordlm
from gridloom.llm.common import pick, table
from gridloom.llm.langid import code_points

A = 64
ORDER = 4
BEGIN = 45
BUCKETS = 28
_FOLD: list[np.ndarray] = []


@dataclass(frozen=True)
class Settings:
    """held_out: one document of so many, by hash, is held out; rounds of expectation-maximisation.

    block: bytes of text whose words are counted and looked up together, about.
    """

    held_out: int = 10
    rounds: int = 25
    block: int = 4_000_000


def fold_table() -> np.ndarray:
    """Symbol of each code point of a lower-cased text."""
    if not _FOLD:
        out = np.full(0x110000, 63, np.uint8)
        for c in range(0x110000):
            if c > 127 and unicodedata.category(chr(c))[0] == "L":
                out[c] = 60 + c % 3
        out[:128] = 44
        out[ord("a") : ord("z") + 1] = np.arange(26)
        out[ord("0") : ord("9") + 1] = 26
        for symbol, chars in enumerate([" \t\n\r\f\v", ".", ",", "!", "?", ";:", "\"'`", "-_", "()[]{}", "&", "%", "$", "#", "*", "@", "/\\|", "+=<>~^"], 27):
            out[[ord(c) for c in chars]] = symbol
        for symbol, c in enumerate("éèêçàäöüßñóíáú", 46):
            out[ord(c)] = symbol
        _FOLD.append(out)
    return _FOLD[0]


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n-gram code (24 bits, last symbol lowest) of every character of all texts, and each text's range."""
    points, off = code_points(texts.fill_null(""))
    n = len(off) - 1
    length = np.diff(off)
    # Three begin symbols before each text.
    s = np.full(len(points) + 3 * n, BEGIN, np.int32)
    at = np.arange(len(points)) + 3 * (np.repeat(np.arange(n), length) + 1)
    s[at] = fold_table()[points]
    return (s[at - 3] << 18) | (s[at - 2] << 12) | (s[at - 1] << 6) | s[at], off


def counts(docs: DataFrame, s: Settings) -> DataFrame:
    """(code, n, held): how often each n-gram occurs in all documents, and in the held-out ones."""

    def reduce(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        c, n = np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
        order = np.argsort(c, kind="stable")
        c, n = c[order], n[order]
        start = np.flatnonzero(np.diff(c, prepend=-1))
        return c[start], np.add.reduceat(n, start) if len(start) else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker that scored before needs those counts no more.
        _LOADED.clear()
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                c, off = codes(part.column(1))
                held = np.repeat(part.column(0).to_numpy(zero_copy_only=False), np.diff(off))
                kept.append(np.unique(c | (held.astype(np.int32) << 24), return_counts=True))
                if len(kept) == 16:
                    kept = [reduce(kept)]
        if kept:
            c, n = reduce(kept)
            for lo in range(0, len(c), 100_000):
                x, k = c[lo : lo + 100_000], n[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array((x & 0xFFFFFF).astype(np.int32)), pa.array(k), pa.array(np.where(x >> 24, k, 0))], ["code", "n", "held"])

    held = F.pmod(F.xxhash64("doc_id", "text"), F.lit(s.held_out)) == 0
    rows = pick(docs, doc_id="doc_id", text="text").where("text is not null").select(held.alias("held"), "text")
    return rows.mapInArrow(run, "code int, n bigint, held bigint").groupBy("code").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def ratio(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.divide(n, total, out=np.zeros(np.broadcast(n, total).shape), where=total > 0)


class Counts:
    """Dense counts of all orders, and of the contexts, from those of the highest."""

    def __init__(self, code: np.ndarray, n: np.ndarray) -> None:
        self.four = np.zeros(A**4, np.int64)
        self.four[code] = n
        self.three = self.four.reshape(A, A**3).sum(0)
        self.two = self.three.reshape(A, A**2).sum(0)
        self.one = self.two.reshape(A, A).sum(0)
        self.context = [x.reshape(-1, A).sum(1) for x in (self.four, self.three, self.two, self.one)]

    def looked_up(self, code: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Counts of each n-gram and of its context, by order from 4 to 1."""
        low = [code, code & 0x3FFFF, code & 0xFFF, code & 0x3F]
        return [t[c] for t, c in zip((self.four, self.three, self.two, self.one), low, strict=True)], [t[c >> 6] for t, c in zip(self.context, low, strict=True)]


def estimates(count: list[np.ndarray], context: list[np.ndarray]) -> np.ndarray:
    """(n-grams, 5): maximum likelihood of orders 4 to 1, 0 where the context was not seen, and the uniform one."""
    return np.stack([*[ratio(c, t) for c, t in zip(count, context, strict=True)], np.full(len(count[0]), 1 / A)], 1)


def bucket(context: list[np.ndarray]) -> np.ndarray:
    """Power of two of the highest context's frequency: 0 unseen, 1 once, 2 twice or thrice, and so on."""
    return np.minimum(np.frexp(context[0].astype(np.float64))[1], BUCKETS - 1)


def own_counts(row: np.ndarray, code: np.ndarray, n: np.ndarray, rows: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What each text itself has of its n-grams (row, code, times n; sorted) and of their contexts, by order."""

    def by(key: np.ndarray) -> np.ndarray:
        _, at = np.unique(key, return_inverse=True)
        return np.bincount(at, weights=n).astype(np.int64)[at]

    def dense(key: np.ndarray, width: int) -> np.ndarray:
        k = row * width + key
        return np.bincount(k, weights=n, minlength=rows * width).astype(np.int64)[k]

    count = [n, by((row << 18) | (code & 0x3FFFF)), dense(code & 0xFFF, A**2), dense(code & 0x3F, A)]
    context = [by((row << 18) | (code >> 6)), dense((code & 0x3FFFF) >> 6, A**2), dense((code & 0xFFF) >> 6, A), dense(np.zeros_like(code), 1)]
    return count, context


def learn(train: Counts, code: np.ndarray, held: np.ndarray, rounds: int) -> np.ndarray:
    """(BUCKETS, 5) mixture weights; a bucket without held-out counts takes those of the nearest below, at first equal ones."""
    weights = np.full((BUCKETS, ORDER + 1), 1 / (ORDER + 1))
    if not len(code):
        return weights
    count, context = train.looked_up(code)
    p, b_ = estimates(count, context), bucket(context)
    for _ in range(rounds):
        share = p * weights[b_]
        share *= (held / share.sum(1))[:, None]
        total = np.stack([np.bincount(b_, weights=share[:, k], minlength=BUCKETS) for k in range(ORDER + 1)], 1)
        some = total.sum(1) > 0
        # The uniform estimate never quite vanishes, so that no symbol is impossible.
        weights[some] = (total[some] + 1e-6) / (total[some] + 1e-6).sum(1, keepdims=True)
    for b in range(1, BUCKETS):
        if not some[b]:
            weights[b] = weights[b - 1]
    return weights


def fit(docs: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram codes, their counts over all documents, and the mixture weights."""
    got = counts(docs, s).toArrow()
    code, n, held = (got[c].to_numpy().astype(np.int64) for c in ("code", "n", "held"))
    some = held > 0
    return code.astype(np.int32), n, learn(Counts(code, n - held), code[some], held[some], s.rounds)


_LOADED: dict[str, Counts] = {}


def loaded(key: str, code: np.ndarray, n: np.ndarray) -> Counts:
    """The dense counts of the broadcast of this name, made once in a worker."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Counts(code, n)
    return _LOADED[key]


def bits_of(code: np.ndarray, off: np.ndarray, every: Counts, weights: np.ndarray) -> np.ndarray:
    """Bits of each text, by the counts of all others."""
    rows = len(off) - 1
    row = np.repeat(np.arange(rows), np.diff(off))
    key, n = np.unique((row << 24) | code, return_counts=True)
    row, code = key >> 24, key & 0xFFFFFF
    count, context = every.looked_up(code)
    mine, mine_context = own_counts(row, code, n, rows)
    count = [np.maximum(c - m, 0) for c, m in zip(count, mine, strict=True)]
    context = [np.maximum(c - m, 0) for c, m in zip(context, mine_context, strict=True)]
    p = (estimates(count, context) * weights[bucket(context)]).sum(1)
    # Where a bucket trusts estimates that are all zero here, the uniform one remains.
    return np.bincount(row, weights=-n * np.log2(np.maximum(p, 1e-9)), minlength=rows)


def apply(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, score, words, word_bits, symbols, bits, bits_per_symbol) of every row of docs; score is bits a word.

    A null or empty text has 0 symbols, 0 bits and a null rate; so has, of words, a text without any. The word model's
    bits hold those of the text's end. Repeated rows have equal scores, and count as often as they occur; null ids stay
    null. An empty table gives an empty result. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *fit(docs, s)))

    def spelling(texts: pa.Array) -> list[pa.Array]:
        name, code, n, weights = shared.value
        c, off = codes(texts)
        length = np.diff(off)
        bits = np.round(bits_of(c, off, loaded(name, code, n), weights), 3)
        return [pa.array(length), pa.array(bits), pa.array(np.round(bits / np.maximum(length, 1), 6), mask=length == 0)]

    def f(ids: pa.Array, texts: pa.Array, words: np.ndarray, word_bits: np.ndarray) -> pa.Table:
        parts = [spelling(texts.slice(lo, 200)) for lo in range(0, len(texts), 200)]
        by_symbol = [pa.chunked_array(x) for x in zip(*parts, strict=True)]
        word_bits = np.round(word_bits, 3)
        by_word = [pa.array(np.round(word_bits / np.maximum(words, 1), 6), mask=words == 0), pa.array(words), pa.array(word_bits)]
        return pa.Table.from_arrays([ids, *by_word, *by_symbol], ["doc_id", "score", "words", "word_bits", "symbols", "bits", "bits_per_symbol"])

    schema = "doc_id bigint, score double, words bigint, word_bits double, symbols bigint, bits double, bits_per_symbol double"
    return wordlm.scored(pick(docs, doc_id="doc_id", text="text"), f, schema, s.held_out, s.rounds, s.block)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))
