"""Language identification by rank-order n-gram profiles.

Letters are lower-cased, everything else separates words; a text's n-grams of one to ``longest`` characters (a blank marks
a word's begin or end, none reaches over it) are ranked by frequency, ties by code point. A document's ``top`` n-grams are
compared to each language's: the out-of-place distance sums the differences of rank, ``top`` for one that the language
lacks, and the least distance names the language, ties by name.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bytesnp as B
from gridloom.llm.common import cut, map_batches, pick, table

BLANK = 32
#: Most ids (16 bytes each, with a short name) that are broadcast.
BROADCAST_ROWS = 200_000
_LETTER: list[np.ndarray] = []


@dataclass(frozen=True)
class Settings:
    """docs_per_language bounds the labelled documents a profile is trained on, those of least mixed doc_id."""

    docs_per_language: int = 300
    top: int = 300


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)]))
    return _LETTER[0]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts one after another, and the offsets of the texts in them."""
    data, off = B.batch_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    return points, starts[off]


def grams(points: np.ndarray) -> np.ndarray:
    """Codes of the n-grams (n = 1, 2, 3) of one text: 21 bits a character, so that codes sort as strings do."""
    letter = letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    # Of what isn't a letter, one blank stays after each word.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    body = np.where(letter, points, BLANK)[keep].astype(np.int64)
    if body[-1] == BLANK:
        body = body[:-1]
    s = np.concatenate([[BLANK], body, [BLANK]])
    two = (s[:-1] << 42) | (s[1:] << 21)
    inner = s[1:-1] != BLANK
    return np.concatenate([body[body != BLANK] << 42, two, (two[:-1] | s[2:])[inner]])


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes in order; codes come sorted, and the sort is stable."""
    return codes[np.argsort(-counts, kind="stable")[:top]]


def profile(points: list[np.ndarray], top: int) -> np.ndarray:
    codes, counts = np.unique(np.concatenate([grams(p) for p in points]), return_counts=True)
    return ranked(codes, counts, top)


def distances(mine: np.ndarray, profiles: list[tuple[np.ndarray, np.ndarray]], top: int) -> list[int]:
    """Out-of-place distance of ranked codes to each profile (sorted codes, their ranks)."""
    out = []
    place = np.arange(len(mine))
    for codes, ranks in profiles:
        at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
        out.append(int(np.where(codes[at] == mine, np.abs(ranks[at] - place), top).sum()))
    return out


def fit(docs: DataFrame, s: Settings = Settings()) -> dict[str, np.ndarray]:
    """Ranked codes by language, from at most docs_per_language documents of each; rows without id, text or lang don't count."""
    rows = pick(docs, doc_id="doc_id", text="text", lang="lang").where("doc_id is not null and text is not null and lang is not null")
    mixed = "(pmod(doc_id, 2147483648) * 1103515245 + 12345) % 2147483647"
    chosen = rows.select("doc_id", "lang").distinct().selectExpr("*", f"row_number() over (partition by lang order by {mixed}, doc_id) as n")
    chosen = cut(chosen.where(F.col("n") <= s.docs_per_language).drop("n"))
    # A few hundred ids for each language: broadcast, so that no text is shuffled, as long as there are so few.
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    got = rows.join(side, ["doc_id", "lang"]).select("lang", "text").toArrow()
    found = {}
    for lang in sorted(set(got["lang"].to_pylist())):
        points, off = code_points(got.filter(pc.equal(got["lang"], lang))["text"].combine_chunks())
        codes = profile([points[a:b] for a, b in zip(off, off[1:], strict=False)], s.top)
        if len(codes):
            found[lang] = codes
    return found


def apply(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, language, distance, runner_up, margin) of every row of docs.

    margin is how much further the runner-up is. A text without a letter (null and empty ones too) has no language:
    nulls. With one language only, runner_up and margin are null. Repeated rows are rows of their own; null ids stay null.
    An empty table gives an empty result. Other columns are ignored.
    """
    trained = fit(docs, s)
    names = sorted(trained)
    profiles = []
    for n in names:
        order = np.argsort(trained[n], kind="stable")
        profiles.append((trained[n][order], order))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        points, off = code_points(batch.column(1).fill_null(""))
        out: list[tuple] = []
        for a, b in zip(off.tolist(), off[1:].tolist(), strict=False):
            codes = grams(points[a:b])
            if not len(codes) or not names:
                out.append((None,) * 4)
                continue
            codes.sort()
            new = np.flatnonzero(np.diff(codes, prepend=-1))
            far = distances(ranked(codes[new], np.diff(new, append=len(codes)), s.top), profiles, s.top)
            order = sorted(range(len(far)), key=lambda k: (far[k], k))
            best, second = order[0], order[1] if len(order) > 1 else None
            out.append((names[best], far[best], None if second is None else names[second], None if second is None else far[second] - far[best]))
        cols = list(zip(*out, strict=True)) or [()] * 4
        arrays = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "language", "distance", "runner_up", "margin"])

    return map_batches(pick(docs, doc_id="doc_id", text="text"), f, "doc_id bigint, language string, distance bigint, runner_up string, margin bigint", 500)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))


SQL = r"""
WITH folded AS (
  SELECT doc_id, lang, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g')) AS t FROM documents),
padded AS (SELECT doc_id, lang, ' ' || t || ' ' AS t FROM folded WHERE t <> ''),
starts AS (SELECT doc_id, lang, t, unnest(generate_series(1, length(t))) AS i FROM padded),
grams AS (
  SELECT doc_id, lang, substr(t, i, n) AS g FROM starts, (VALUES (1), (2), (3)) AS v(n)
  WHERE i + n - 1 <= length(t) AND NOT (n = 1 AND substr(t, i, 1) = ' ') AND NOT (n = 3 AND substr(t, i + 1, 1) = ' ')),
counted AS (SELECT doc_id, lang, g, count(*) AS c FROM grams GROUP BY ALL),
mine AS (
  SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, g) - 1 AS r FROM counted
  QUALIFY r < 300),
chosen AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
    ORDER BY ((doc_id % 2147483648) * 1103515245 + 12345) % 2147483647, doc_id) AS n
  FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL QUALIFY n <= 300),
summed AS (SELECT c.lang, g, sum(c) AS c FROM counted c JOIN chosen USING (doc_id) GROUP BY ALL),
profile AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY c DESC, g) - 1 AS r FROM summed QUALIFY r < 300),
langs AS (SELECT DISTINCT lang FROM profile),
far AS (
  SELECT m.doc_id, l.lang, CAST(sum(coalesce(abs(m.r - p.r), 300)) AS BIGINT) AS d
  FROM mine m CROSS JOIN langs l LEFT JOIN profile p ON p.lang = l.lang AND p.g = m.g GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, lang) AS n FROM far)
SELECT x.doc_id, a.lang AS language, a.d AS distance, b.lang AS runner_up, b.d - a.d AS margin
FROM documents x LEFT JOIN placed a ON a.doc_id = x.doc_id AND a.n = 1 LEFT JOIN placed b ON b.doc_id = x.doc_id AND b.n = 2
"""
