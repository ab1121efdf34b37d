"""Toxicity: a counterfactually regularised linear classifier of documents.

Trained on labelled documents as a logistic regression over the presence of words, with an L1 penalty (a few hundred
words keep a weight, so long clean documents don't add up to a toxic one) and a counterfactual penalty: in every labelled
sentence that names a group, the identity term, of one word or several, is swapped for each other term of its category,
the first of which is a neutral one, and the squared difference between the scores of the two sentences is charged. A
group's name thereby loses the blame for the company it keeps in the labels. Terms are listed for four languages.

After training the intercept is kept below the threshold: a text without any word of weight is never toxic.

Scores are computed row by row, over whole texts, from the trained weights alone.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bytesnp as B
from gridloom.llm.common import list_array, map_batches, map_named, pick, table

#: Identity terms by language and category; the first of each is the neutral one.
IDENTITY = (
    ("person", "woman", "man", "girl", "boy", "transgender", "nonbinary", "trans woman", "trans man"),
    ("believer", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("citizen", "immigrant", "refugee", "foreigner", "african", "asian", "european", "latino", "american", "arab", "native american", "african american"),
    ("adult", "gay", "lesbian", "bisexual", "straight", "queer", "homosexual", "heterosexual"),
    ("human", "black", "white", "brown", "indigenous", "disabled", "blind", "deaf", "elderly", "young"),
    ("mensch", "frau", "mann", "mädchen", "junge", "transgender", "nichtbinär"),
    ("gläubiger", "christ", "muslim", "jude", "hindu", "buddhist", "atheist", "katholik"),
    ("bürger", "einwanderer", "flüchtling", "ausländer", "afrikaner", "asiate", "türke", "araber", "sinti und roma"),
    ("erwachsener", "schwuler", "lesbe", "bisexueller", "homosexueller", "heterosexueller"),
    ("person", "schwarzer", "weißer", "behinderter", "blinder", "gehörloser", "alter", "junger"),
    ("personne", "femme", "homme", "fille", "garçon", "transgenre", "femme trans"),
    ("croyant", "chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée", "catholique"),
    ("citoyen", "immigré", "réfugié", "étranger", "africain", "asiatique", "arabe", "gens du voyage"),
    ("adulte", "gay", "lesbienne", "bisexuel", "homosexuel", "hétérosexuel"),
    ("humain", "noir", "blanc", "handicapé", "aveugle", "sourd", "âgé", "jeune"),
    ("persona", "mujer", "hombre", "niña", "niño", "transgénero", "mujer trans"),
    ("creyente", "cristiano", "musulmán", "judío", "hindú", "budista", "ateo", "católico"),
    ("ciudadano", "inmigrante", "refugiado", "extranjero", "africano", "asiático", "árabe", "gitano"),
    ("adulto", "gay", "lesbiana", "bisexual", "homosexual", "heterosexual"),
    ("humano", "negro", "blanco", "discapacitado", "ciego", "sordo", "anciano", "joven"),
)


@dataclass(frozen=True)
class Settings:
    """train_rows bounds the labelled documents that training sees; they are those of least mixed doc_id."""

    train_rows: int = 16_000
    min_docs: int = 4
    l1: float = 0.5
    counterfactual: float = 1.0
    rounds: int = 150
    threshold: float = 0.5
    identity: tuple[tuple[str, ...], ...] = field(default=IDENTITY)


@dataclass(frozen=True)
class Model:
    """Hashes of the words that carry weight, in order, their weights, and the intercept."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def _words(texts: pa.Array) -> B.Words:
    return B.split_words(B.fold(texts), B.PUNCTUATION)


def _sentences(text: str) -> list[str]:
    return text.replace("!", ".").replace("?", ".").replace("\n", ".").split(".")


def _terms(s: Settings) -> list[tuple[int, tuple[int, ...]]]:
    """(category, word hashes) of each identity term."""
    return [(c, tuple(_words(pa.array([t])).hash.tolist())) for c, g in enumerate(s.identity) for t in g]


def mentions(words: list[int], terms: list[tuple[int, tuple[int, ...]]], known: set[int]) -> list[list[int]]:
    """For each term that a sentence (its words in order) names: the term's number, and which of the terms' words the
    sentence has besides all occurrences of it."""
    out = []
    for k, (_, term) in enumerate(terms):
        if term[0] in words:
            rest, at, found = set(), 0, False
            while at < len(words):
                if tuple(words[at : at + len(term)]) == term:
                    found, at = True, at + len(term)
                else:
                    rest.add(words[at])
                    at += 1
            if found:
                out.append([k, *sorted(rest & known)])
    return out


def features(texts: pa.Array, s: Settings) -> tuple[pa.ListArray, pa.ListArray]:
    """For each text the hashes of its distinct words, and the mentions of each of its sentences."""
    w = _words(texts)
    words = [np.unique(w.hash[a:b]) for a, b in zip(w.first, w.first[1:], strict=False)]
    terms = _terms(s)
    known = {h for _, t in terms for h in t}
    every = np.array(sorted(known), B.U64)
    named: list[list[list[int]]] = [[] for _ in words]
    for i in np.unique(w.row[np.isin(w.hash, every)]).tolist():
        p = _words(pa.array(_sentences(texts[i].as_py())))
        for k in np.unique(p.row[np.isin(p.hash, every)]).tolist():
            named[i] += mentions(p.hash[p.first[k] : p.first[k + 1]].tolist(), terms, known)
    flat = np.concatenate([*words, np.zeros(0, B.U64)]).view(np.int64)
    signed = [[[x - (1 << 64) if x >> 63 else x for x in m] for m in row] for row in named]
    return list_array(pa.array(flat), [len(x) for x in words]), pa.array(signed, pa.list_(pa.list_(pa.int64())))


def swaps(named: list[list[int]], s: Settings) -> dict[tuple[tuple[int, ...], tuple[int, ...]], int]:
    """How many swaps of a term for another of its category bring some words (first) and take others (second)."""
    terms = _terms(s)
    count: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = {}
    for (k, *rest), n in Counter(map(tuple, named)).items():
        here = {x % (1 << 64) for x in rest}
        category, own = terms[k]
        for c, other in terms:
            if c == category and other != own:
                before, after = here | set(own), here | set(other)
                key = tuple(sorted(after - before)), tuple(sorted(before - after))
                count[key] = count.get(key, 0) + n
    return count


def train(texts: list[str | None], toxic: list[int], s: Settings = Settings()) -> Model:
    """As train_on, from texts."""
    words, named = features(pa.array(texts, pa.string()), s)
    return train_on(*_joined(pa.chunked_array([words])), [m for row in named.to_pylist() for m in row], np.array(toxic, np.float64), s)


def train_on(words: np.ndarray, sizes: np.ndarray, named: list[list[int]], y: np.ndarray, s: Settings) -> Model:
    """From the rows' word hashes one after another and their numbers, and the mentions of all sentences.

    Proximal gradient descent with momentum. Without a toxic or without a clean row, nothing is toxic."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, B.U64), np.zeros(0), -20.0)
    row = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    # Most words are rare and go before they are sorted: those whose hash prefix is rare are.
    often = np.bincount((words >> B.U64(42)).view(np.int64), minlength=1 << 22) >= s.min_docs
    terms = np.array(sorted({h for _, t in _terms(s) for h in t}), B.U64)
    some = often[(words >> B.U64(42)).view(np.int64)] | np.isin(words, terms)
    words, row = words[some], row[some]
    del often, some
    vocabulary, index, docs = np.unique(words, return_inverse=True, return_counts=True)
    del words
    # Every identity term stays, or its swap could not be charged.
    kept = (docs >= s.min_docs) | np.isin(vocabulary, terms)
    renumber = (np.cumsum(kept) - 1).astype(np.int32)
    use = kept[index]
    index, row, vocabulary = renumber[index[use]], row[use], vocabulary[kept]
    del use, docs, renumber
    n, d = len(y), len(vocabulary)
    if not d:
        return Model(np.zeros(0, B.U64), np.zeros(0), -20.0)
    # A swap as a row of plus and minus ones; words that no labelled row has weigh nothing.
    wanted = set(terms.tolist())
    place = {int(h): k for k, h in enumerate(vocabulary) if int(h) in wanted}
    changes = [({place[h]: 1.0 for h in more if h in place} | {place[h]: -1.0 for h in less if h in place}, n) for (more, less), n in swaps(named, s).items()]
    changes = [(c, n) for c, n in changes if c]
    times = np.array([n for _, n in changes], np.float64) * s.counterfactual
    swap = np.array([k for k, (c, _) in enumerate(changes) for _ in c], np.int64)
    at = np.array([k for c, _ in changes for k in c], np.int64)
    sign = np.array([v for c, _ in changes for v in c.values()], np.float64)

    weight, bias = np.zeros(d), float(np.log(y.mean() / (1 - y.mean())))
    # Row sums bound the largest curvature; steps by word (diagonal scaling) converge quickly on rare words.
    length = np.bincount(row, minlength=n).astype(np.float64)
    curve = 0.25 * np.bincount(index, weights=np.minimum(length[row], 40.0), minlength=d) + 1e-3
    np.add.at(curve, at, 2 * times[swap] * np.bincount(swap, minlength=len(times))[swap])
    look, momentum, least = weight.copy(), 1.0, np.inf
    for _ in range(s.rounds):
        score = bias + np.bincount(row, weights=look[index], minlength=n)
        change = np.bincount(swap, weights=sign * look[at], minlength=len(times))
        cost = np.logaddexp(0, score).sum() - (y * score).sum() + s.l1 * np.abs(look).sum() + (times * change**2).sum()
        if cost > 1.05 * least:
            # Words that go together were stepped too far: smaller steps from the last weights.
            curve, look, momentum = 2 * curve, weight.copy(), 1.0
            score = bias + np.bincount(row, weights=look[index], minlength=n)
            change = np.bincount(swap, weights=sign * look[at], minlength=len(times))
        least = min(least, cost)
        slope = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
        gradient = np.bincount(index, weights=slope[row], minlength=d)
        np.add.at(gradient, at, (2 * times * change)[swap] * sign)
        step = look - gradient / curve
        after = np.sign(step) * np.maximum(np.abs(step) - s.l1 / curve, 0)
        # Restart the momentum where it points uphill.
        if ((look - after) * (after - weight)).sum() > 0:
            momentum = 1.0
        grown = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        look = after + (momentum - 1) / grown * (after - weight)
        weight, momentum = after, grown
        bias -= slope.sum() / (0.25 * n)
    live = np.flatnonzero(weight)
    # Without evidence no text is toxic, however many of the labelled ones are.
    neutral = np.log(s.threshold / (1 - s.threshold)) - 0.01
    return Model(vocabulary[live], weight[live], float(min(bias, neutral)))


def score_batch(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of toxicity of each text; a null or empty text has no word and gets the intercept's."""
    w = _words(texts)
    total = np.full(len(texts), model.bias)
    if len(model.words) and len(w.hash):
        at = np.minimum(np.searchsorted(model.words, w.hash), len(model.words) - 1)
        hit = np.flatnonzero(model.words[at] == w.hash)
        once = np.unique(w.row[hit] * len(model.words) + at[hit])
        np.add.at(total, once // len(model.words), model.weights[once % len(model.words)])
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Train on at most s.train_rows labelled rows of docs; rows without doc_id, text or label don't count, and of rows
    that repeat an id the one of least text hash does.

    The chosen labels, s.train_rows at most whatever the tables' size, are broadcast, so that no text is shuffled.
    """
    mixed = (F.pmod(F.col("doc_id"), F.lit(1 << 31)) * 1103515245 + 12345) % F.lit((1 << 31) - 1)
    known = pick(labels, doc_id="doc_id", toxic="toxic").where("doc_id is not null and toxic is not null")
    chosen = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).orderBy(mixed, "doc_id").limit(s.train_rows)
    joined = pick(docs, doc_id="doc_id", text="text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    joined = joined.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *features(batch.column(2), s)], ["doc_id", "toxic", "words", "named"])

    got = map_batches(joined, f, "doc_id bigint, toxic int, words array<bigint>, named array<array<bigint>>", 1000).toArrow()
    y = got["toxic"].to_numpy().astype(np.float64)
    words, sizes = _joined(got["words"])
    named = [m for row in got["named"].to_pylist() for m in row]
    del got
    return train_on(words, sizes, named, y, s)


def _joined(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a list column one after another, and how many each row has."""
    parts = [(c.flatten().to_numpy().view(B.U64), np.diff(c.offsets.to_numpy())) for c in lists.chunks]
    return np.concatenate([p[0] for p in parts] or [np.zeros(0, B.U64)]), np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int32)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_batch(batch.column(1), shared.value))], ["doc_id", "score"])

    return map_batches(pick(docs, doc_id="doc_id", text="text"), f, "doc_id bigint, score double", 1000)


def apply(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, score, toxic) for every row of docs.

    A null or empty text has no evidence and is never toxic (score is the intercept's). Repeated rows get one row each,
    with equal scores; a null doc_id stays null. An empty docs gives an empty result; labels of a single class, or none,
    make nothing toxic. Repeated labels of a document: toxic if any says so. Other columns are ignored.
    """
    scored = score(docs, fit(docs, labels, s))
    return scored.select("doc_id", F.round("score", 6).alias("score"), (F.col("score") >= s.threshold).alias("toxic"))


def keep(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs, all its columns, without the rows that are toxic; a row's own text decides, so repeated ids need no care."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, s))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(batch.schema.get_field_index("text"))
        return batch.filter(pa.array(score_batch(text, shared.value) < s.threshold))

    return map_named(docs, f, docs.schema, 1000)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
