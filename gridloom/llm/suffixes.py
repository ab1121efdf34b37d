"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Finds every passage of at least ``min_words`` words that occurs twice, in two documents or in one, and cuts all but its
first occurrence. Words are those between white space, compared byte by byte.

1. Sparse suffixes. A suffix starts at each word whose hash of ``k`` words is least in some window of ``window`` such
   hashes. The choice depends on the words alone and window + k - 1 <= min_words, so that all occurrences of a passage
   share their suffixes: at least one, the first at most window - 1 words from its begin, the last at most
   window + k - 1 words from its end, none further apart than ``window``.
2. A suffix whose k words occur once in the table can't share a passage: exact, and it leaves about half of the suffixes.
3. The rest are sorted by (hash of k words, then words): each task sorts its own into a run, front-codes it (length of the
   prefix shared with the one before, and what follows), and sends each range of the hash, compressed, to its reducer.
   Ranges are as many as it takes for ``part`` suffixes each. A reducer merges
   its runs by a loser tree whose nodes remember how much each loser shares with the winner, so no prefix is compared
   twice; the merged order comes with the lengths of all common prefixes, that is a suffix array with its LCP array.
4. A suffix carries ``right`` words and, in reverse, the ``left`` words before it: enough that the union, over all shared
   suffixes, of what two occurrences share around it is the passage from its first word to its last.
5. k words that occur more than ``hot`` times would make one range larger than the others, and no sorting by further words
   splits a passage that all share. Around such suffixes every window of min_words words is grouped by its hash (128
   bits), added up where it is read first, so that one passage in half of the documents is spread over all tasks.

"First" is the least (doc_id, row, position), null ids last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bytesnp as B
from gridloom.llm.common import col, cut, map_batches, map_named, pick, release, remove, scratch, slices, table, unused


@dataclass(frozen=True)
class Settings:
    """min_words: shortest passage; k: words hashed; window: hashes of which the least marks a suffix.

    run: suffixes of a sorted run, about; a task with more sends several, so that its memory is bounded. part: suffixes of
    a reducer, on average, of about 1 KB each; hot: occurrences of k words above which they are counted by windows.
    """

    min_words: int = 50
    k: int = 16
    window: int = 32
    run: int = 50_000
    part: int = 50_000
    hot: int = 20_000

    def __post_init__(self) -> None:
        if self.window + self.k - 1 > self.min_words:
            raise ValueError("window + k - 1 must not exceed min_words")

    @property
    def left(self) -> int:
        return max(self.min_words - self.k, self.window)

    @property
    def right(self) -> int:
        return max(self.min_words, self.window + self.k)


def anchors(w: B.Words, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers at which suffixes start, and their hashes; documents of fewer than min_words words have none."""
    h, whole = B.kgram_hash(w, s.k)
    if len(h) < s.window:
        return np.zeros(0, np.int64), np.zeros(0, B.U64)
    h = np.where(whole, h >> B.U64(1), B.ALL_ONES)
    least = B.sliding(h, s.window, np.minimum)
    # The greatest of the minima of all windows that hold i is h[i] itself exactly where i is least in one of them.
    padded = np.concatenate([np.zeros(s.window - 1, B.U64), least, np.zeros(s.window - 1, B.U64)])
    most = B.sliding(padded, s.window, np.maximum)[: len(h)]
    long_enough = np.diff(w.first)[w.row[: len(h)]] >= s.min_words
    at = np.flatnonzero((most == h) & whole & long_enough)
    return at, h[at]


def suffix_hashes(rows: DataFrame, s: Settings) -> DataFrame:
    """(h, rid, pos) of every suffix of rows (rid, text)."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = B.split_words(batch.column(1))
        at, h = anchors(w, s)
        row = w.row[at]
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array((at - w.first[row]).astype(np.int32))], ["h", "rid", "pos"])

    return map_batches(rows, f, "h bigint, rid bigint, pos int", 1000)


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which the first ``known`` bytes are known to agree and aren't read."""
    end = min(len(a), len(b))
    # The highest bit in which they differ, as numbers of equally many bytes.
    return end - ((int.from_bytes(a[known:end]) ^ int.from_bytes(b[known:end])).bit_length() + 7 >> 3)


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Loser tree over sorted runs (keys, prefix shared with the key before): yields (run, index, prefix shared with the last).

    Each node keeps the loser's run and the prefix it shares with the key that beat it. Two candidates whose shared
    prefixes with the last winner differ are ordered by those lengths alone; else the comparison starts behind the prefix.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * k
    keys: list[bytes | None] = [run[0][0] if run[0] else None for run in runs] + [None] * (k - len(runs))
    losers: list[tuple[int, int]] = [(0, 0)] * k

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0
        return play(node, build(2 * node), build(2 * node + 1))

    def play(node: int, x: tuple[int, int], y: tuple[int, int]) -> tuple[int, int]:
        (a, p), (b, q) = x, y
        u, v = keys[a], keys[b]
        if u is None or v is None:
            win, lose = (x, y) if v is None else (y, x)
        elif p != q:
            win, lose = (x, y) if p > q else (y, x)
        else:
            n = shared_prefix(u, v, p)
            if u[n : n + 1] < v[n : n + 1] or (u[n : n + 1] == v[n : n + 1] and a < b):
                win, lose = x, (b, n)
            else:
                win, lose = y, (a, n)
        losers[node] = lose
        return win

    if not runs:
        return
    winner, prefix = build(1)
    while keys[winner] is not None:
        yield winner, at[winner], prefix
        at[winner] += 1
        own, lcps = runs[winner]
        i = at[winner]
        keys[winner] = own[i] if i < len(own) else None
        best = (winner, lcps[i] if i < len(own) else 0)
        node = (winner + k) // 2
        while node:
            best = play(node, best, losers[node])
            node //= 2
        winner, prefix = best


def run_of(records: list[tuple]) -> list[tuple]:
    """Sorted and front-coded: (shared, rest, shared on the left, rest on the left, further fields)."""
    records.sort(key=lambda r: r[:2])
    out, last, last_left = [], b"", b""
    for r in records:
        n, m = shared_prefix(last, r[0], 0), shared_prefix(last_left, r[1], 0)
        out.append((n, r[0][n:], m, r[1][m:], *r[2:]))
        last, last_left = r[0], r[1]
    return out


def shared_words(a: bytes, b: bytes) -> int:
    """How many whole words, each followed by a blank, a and b begin with in common."""
    return a.count(b" ") if a == b else a.count(b" ", 0, shared_prefix(a, b, 0))


def reaches(s: Settings) -> list[tuple[int, int]]:
    """(words to the left, words to the right) that make up a passage around a suffix, each side as short as it can be."""
    by_left = {(a, max(s.min_words - a, s.k)) for a in range(s.left + 1)}
    return sorted(x for x in by_left | {(max(s.min_words - b, 0), b) for b in range(s.k, s.right + 1)} if x[1] <= s.right)


def spans_of(near_right: np.ndarray, near_left: np.ndarray, by_left: np.ndarray, by_age: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Spans around sorted suffixes: words to the left and right that are shared with any other suffix, and with an older one.

    near_right[i] is what suffix i shares with the one before (-1: other group), near_left the same to the left in the
    order by_left, and by_age the order of age. Two suffixes share a words to the left and b to the right if and only if no
    neighbour between them shares less, that is if counting such borders gives both the same numbers: one grouping for
    each reach, of time n log n, and no comparison of pairs. Returned in order of age: left, right, older left, older
    right (-1: none), and the oldest that shares.
    """
    n = len(by_age)
    place = np.arange(n)
    found = [np.full(n, -1, np.int64) for _ in range(4)]
    first = place.copy()
    left = np.empty(n, np.int64)
    for a, b in reaches(s):
        left[by_left] = np.cumsum(near_left < a)
        key = (np.cumsum(near_right < b) * (n + 1) + left)[by_age]
        _, oldest, group, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        mate = count[group] > 1
        old = oldest[group] < place
        for out, some, reach in zip(found, (mate, mate, old, old), (a, b, a, b), strict=True):
            out[some] = np.maximum(out[some], reach)
        first = np.where(mate, np.minimum(first, oldest[group]), first)
    return *found, first


SPANS = "rid bigint, doc_id bigint, first_doc_id bigint, start int, end int, cut_start int, cut_end int"


def repeated(rows: DataFrame, s: Settings) -> DataFrame:
    """(rid, at, hot), stored: positions of each row's suffixes whose k words occur twice, and of those that are hot.

    Suffixes are written first: they are needed twice, to be counted and to be found again.
    """
    spark = rows.sparkSession
    path = scratch(spark)
    suffix_hashes(rows.select("rid", "text"), s).write.parquet(path)
    hashed = spark.read.parquet(path)
    counts = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    few = F.col("n") <= s.hot
    found = hashed.join(counts, "h").groupBy("rid").agg(F.sort_array(F.collect_set(F.when(few, F.col("pos")))).alias("at"), F.sort_array(F.collect_set(F.when(~few, F.col("pos")))).alias("hot"))
    out = cut(found)
    remove(spark, path)
    return out


def shared_spans(docs: DataFrame, s: Settings) -> DataFrame:
    """(rid, doc_id, first_doc_id, start, end, cut_start, cut_end) around every shared suffix, in words of the row.

    Rows overlap; cut_start and cut_end are -1 where no earlier occurrence exists.
    """
    rows = pick(docs, doc_id="doc_id", text="text").where("text is not null").select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    wanted = repeated(rows, s)
    release(docs.sparkSession)
    suffixes, hot = (int(x or 0) for x in wanted.agg(F.sum(F.size("at")), F.sum(F.size("hot"))).first())
    parts = max(1, -(-suffixes // s.part))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[tuple] = []
        done = 0
        for batch in batches:
            for part in slices(batch, 500):
                records += suffix_records(part, s)
                if len(records) >= s.run:
                    yield run_batch(run_of(records), done, parts)
                    records, done = [], done + 1
        yield run_batch(run_of(records), done, parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_part(batches):
            yield merged_spans(held, s)

    joined = rows.join(wanted, "rid").select("rid", "doc_id", "text", "at", "hot")
    sent = joined.mapInArrow(runs, RUN_SCHEMA)
    # One partition for each range of the hash, which are of equal size: hashing their numbers would put several in one.
    found = sent.repartitionById(parts, "part").sortWithinPartitions("part", "run").mapInArrow(merge, SPANS)
    return found.union(hot_spans(joined.where("size(hot) > 0"), s)) if hot else found


def hot_spans(joined: DataFrame, s: Settings) -> DataFrame:
    """As shared_spans, a row for each window of min_words words around a hot suffix that occurs twice."""

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = B.split_words(batch.column(2))
        starts, row = [], []
        for i, at in enumerate(batch.column(4).to_pylist()):
            a, b = int(w.first[i]), int(w.first[i + 1])
            first = np.unique((a + np.array(at, np.int64)[:, None] - np.arange(s.min_words - s.k + 1)).ravel())
            first = first[(first >= a) & (first + s.min_words <= b)]
            starts.append(first)
            row.append(np.full(len(first), i))
        at_, row_ = np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*row, np.zeros(0, np.int64)])
        keys = [B.span_hash(w.hash, at_, at_ + s.min_words, *base).view(np.int64) for base in B.BASES]
        who = pa.array(row_)
        cols = [*map(pa.array, keys), batch.column(0).take(who), batch.column(1).take(who), pa.array((at_ - w.first[row_]).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["k1", "k2", "rid", "doc_id", "pos"])

    every = map_batches(joined, windows, "k1 bigint, k2 bigint, rid bigint, doc_id bigint, pos int", 500)
    every = every.withColumn("me", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "pos"))
    # Equal rows count as one: there are two occurrences if the first isn't the last.
    # In one plan with the runs, so that the shuffled texts serve both.
    twice = every.groupBy("k1", "k2").agg(F.min("me").alias("oldest"), F.max("me").alias("newest")).where("oldest <> newest").drop("newest")
    end, older = F.col("pos") + s.min_words, F.col("me") > F.col("oldest")
    return every.join(twice, ["k1", "k2"]).select(
        "rid", "doc_id", F.col("oldest.doc_id").alias("first_doc_id"), F.col("pos").alias("start"), end.alias("end"), F.when(older, F.col("pos")).otherwise(-1).alias("cut_start"), F.when(older, end).otherwise(-1).alias("cut_end")
    )


RUN_SCHEMA = "part int, run bigint, size int, bytes int, data binary"


def suffix_records(batch: pa.RecordBatch, s: Settings) -> list[tuple]:
    """(key, left words reversed, doc_id, rid, pos) of the wanted suffixes of a batch (rid, doc_id, text, at)."""
    w = B.split_words(batch.column(2))
    h, _ = B.kgram_hash(w, s.k)
    h = (h >> B.U64(1)).astype(">u8").tobytes()
    out = []
    rid, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    data = w.data.tobytes()
    start, end = w.start.tolist(), w.end.tolist()
    # Words with one blank between them can be sliced as they stand.
    gap = np.ones(len(start), bool)
    gap[:-1] = (w.start[1:] - w.end[:-1] == 1) & (w.data[np.minimum(w.end[:-1], len(w.data) - 1)] == 32)
    odd = np.concatenate([[0], np.cumsum(~gap)])
    for i, positions in enumerate(batch.column(3).to_pylist()):
        a, b = int(w.first[i]), int(w.first[i + 1])
        for p in positions:
            x = a + p
            last, first = min(b, x + s.right), max(a, x - s.left)
            right = data[start[x] : end[last - 1]] if odd[last - 1] == odd[x] else b" ".join([data[start[k] : end[k]] for k in range(x, last)])
            if first == x:
                left = b""
            elif odd[x - 1] == odd[first]:
                before = data[start[first] : end[x - 1]].split(b" ")
                before.reverse()
                left = b" ".join(before) + b" "
            else:
                left = b" ".join([data[start[k] : end[k]] for k in range(x - 1, first - 1, -1)]) + b" "
            out.append((h[8 * x : 8 * x + 8] + right + b" ", left, ids[i], rid[i], p))
    return out


def packed(some: list[tuple]) -> tuple[int, bytes]:
    """Front-coded suffixes of one part: numbers column by column, then the bytes; how many bytes before compression."""
    n, rest, m, lrest, ids, rid, pos = zip(*some, strict=True)
    ints = np.array([n, [len(x) for x in rest], m, [len(x) for x in lrest], pos], np.int32)
    longs = np.array([rid, [0 if x is None else x for x in ids], [x is None for x in ids]], np.int64)
    raw = b"".join([ints.tobytes(), longs.tobytes(), *rest, *lrest])
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, bytes_: int, size: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = pa.decompress(data, decompressed_size=bytes_, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.int32, 5 * size).reshape(5, size), np.frombuffer(raw, np.int64, 3 * size, 20 * size).reshape(3, size), raw[44 * size :]


def run_batch(coded: list[tuple], number: int, parts: int) -> pa.RecordBatch:
    """A row of RUN_SCHEMA for each part that the run touches. The first key of a part is sent whole, as its reducer has none before it."""
    context = TaskContext.get()
    run = ((context.partitionId() if context else 0) << 24) + number
    rows: list[tuple] = []
    last, last_left, part = b"", b"", -1
    held: list[tuple] = []

    def close() -> None:
        if held:
            rows.append((part, run, len(held), *packed(held)))
            held.clear()

    for n, r, m, l, *more in coded:
        last, last_left = last[:n] + r, last_left[:m] + l
        now = int.from_bytes(last[:8]) * parts >> 63
        if now != part:
            close()
            part, n, r, m, l = now, 0, last, 0, last_left
        held.append((n, r, m, l, *more))
    close()
    types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["part", "run", "size", "bytes", "data"])


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one part each, from batches sorted by part."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        part = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else []
        for lo, hi in zip(edges, edges[1:], strict=False):
            if held and part[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = part[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def merged_spans(t: pa.Table, s: Settings) -> pa.RecordBatch:
    """Spans of one part: decode its runs, merge them, and look at each group of equal k words."""
    runs: list[tuple[list[bytes], list[int]]] = []
    base: list[int] = []
    lefts: list[bytes] = []
    numbers: list[tuple[np.ndarray, np.ndarray]] = []
    for size, bytes_, data in zip(*[t[c].to_pylist() for c in ("size", "bytes", "data")], strict=True):
        ints, longs, raw = unpacked(data, bytes_, size)
        keys: list[bytes] = []
        base.append(len(lefts))
        at_r, key, left = 0, b"", b""
        at_l = int(ints[1].sum())
        shared = ints[0].tolist()
        for n, k, m, o in zip(shared, ints[1].tolist(), ints[2].tolist(), ints[3].tolist(), strict=True):
            # What is equal throughout is kept once.
            if k or n < len(key):
                key = key[:n] + raw[at_r : at_r + k]
            if o or m < len(left):
                left = left[:m] + raw[at_l : at_l + o]
            at_r, at_l = at_r + k, at_l + o
            keys.append(key)
            lefts.append(left)
        runs.append((keys, shared))
        numbers.append((ints[4], longs))
    at, near = [], []
    same = 0
    for r, i, prefix in merge_runs(runs):
        key = runs[r][0][i]
        # A group agrees in the hash and in k whole words, which end at ``same``.
        if not at or prefix < same:
            near.append(-1)
            same = 8
            for _ in range(s.k):
                same = key.index(b" ", same) + 1
        else:
            near.append(key.count(b" ", 8, prefix))
        at.append(base[r] + i)
    at_ = np.array(at, np.int64)
    near_right = np.array(near, np.int64)
    pos = np.concatenate([x for x, _ in numbers]).astype(np.int64)[at_]
    rid, number, none = np.concatenate([x for _, x in numbers], 1)[:, at_]
    none = none == 1
    doc = pa.array(number, mask=none)
    # Rows that repeat id and text are one: of equal suffixes the first stays.
    order = np.lexsort((pos, rid))
    twice = np.zeros(len(order), bool)
    twice[order[1:]] = (rid[order[1:]] == rid[order[:-1]]) & (pos[order[1:]] == pos[order[:-1]])
    stay = np.flatnonzero(~twice)
    near_right = np.minimum.reduceat(near_right, np.concatenate([[0], stay[:-1] + 1]))
    # Groups of one have nothing to share.
    alone = (near_right < 0) & (np.append(near_right[1:], -1) < 0)
    near_right, stay = near_right[~alone], stay[~alone]
    names = ["rid", "doc_id", "first_doc_id", "start", "end", "cut_start", "cut_end"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    if not len(stay):
        return pa.RecordBatch.from_arrays([pa.array([], k) for k in types], names)
    rid, pos, none, number, doc = rid[stay], pos[stay], none[stay], number[stay], doc.take(pa.array(stay))
    here = [lefts[i] for i in at_[stay].tolist()]
    starts = np.flatnonzero(near_right < 0).tolist()
    by_left: list[int] = []
    near_left = np.empty(len(stay), np.int64)
    for lo, hi in zip(starts, [*starts[1:], len(stay)], strict=True):
        group = sorted(range(lo, hi), key=here.__getitem__)
        by_left += group
        near_left[lo] = -1
        for k in range(1, len(group)):
            near_left[lo + k] = shared_words(here[group[k - 1]], here[group[k]])
    by_age = np.lexsort((pos, rid, number, none))
    l, r, cut_l, cut_r, first = spans_of(near_right, near_left, np.array(by_left), by_age, s)
    rid, pos, doc = rid[by_age], pos[by_age], doc.take(pa.array(by_age))
    hit = np.flatnonzero(l >= 0)
    older = cut_l >= 0
    cut_start, cut_end = np.where(older, pos - cut_l, -1), np.where(older, pos + cut_r, -1)
    cols = [pa.array(rid[hit]), doc.take(pa.array(hit)), doc.take(pa.array(first[hit]))]
    cols += [pa.array(x[hit].astype(np.int32)) for x in (pos - l, pos + r, cut_start, cut_end)]
    return pa.RecordBatch.from_arrays(cols, names)


def united(rows: list[tuple[int, int, int | None]]) -> list[list]:
    """Overlapping or touching [start, end) of sorted rows in one; the least first document of each."""
    out: list[list] = []
    for start, end, first in rows:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
            if first is not None and (out[-1][2] is None or first < out[-1][2]):
                out[-1][2] = first
        else:
            out.append([start, end, first])
    return out


def without(whole: list[list], holes: list[list]) -> list[list]:
    """What of the spans lies in no hole."""
    out = []
    for start, end, first in whole:
        for a, b, _ in holes:
            if a < end and b > start:
                if a > start:
                    out.append([start, a, first])
                start = max(start, b)
        if start < end:
            out.append([start, end, first])
    return out


def spans(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(rid, doc_id, first_doc_id, cut, start, end): disjoint spans of each row, sorted."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_part(batches):
            first = t["first_doc_id"].to_pylist()
            whole = united(list(zip(t["start"].to_pylist(), t["end"].to_pylist(), first, strict=True)))
            gone = united(sorted((x for x in zip(t["cut_start"].to_pylist(), t["cut_end"].to_pylist(), first, strict=True) if x[0] >= 0), key=lambda x: x[:2]))
            out = sorted([(*x, True) for x in gone] + [(*x, False) for x in without(whole, gone)], key=lambda x: x[:2])
            rid, doc = t["rid"][0], t["doc_id"][0]
            held.extend((rid.as_py(), doc.as_py(), f, c, a, b) for a, b, f, c in out)
            if len(held) >= 20_000:
                yield flush()
        if held:
            yield flush()

    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*held, strict=True))
        held.clear()
        types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["rid", "doc_id", "first_doc_id", "cut", "start", "end"])

    ordered = shared_spans(docs, s).repartition("rid").sortWithinPartitions("rid", "start", "end")
    return ordered.mapInArrow(tidy, "rid bigint, doc_id bigint, first_doc_id bigint, cut boolean, start int, end int")


def apply(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, start_word, end_word, words, cut, first_doc_id): every span of words that lies in a repeated passage.

    cut: an earlier occurrence exists, so this one goes; else it is the first and stays. first_doc_id has the earliest
    occurrence found. Spans of a document are disjoint. Null texts and texts below min_words words have none; rows that
    repeat both id and text count as one; an empty table gives an empty result; other columns are ignored.
    """
    return spans(docs, s).select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("words"), "cut", "first_doc_id")


def keep(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs, all its columns whatever their names, without the words of spans that are cut; n_chars, where there, is counted anew.

    A text of which no word is left goes with its row. Null, short and empty texts stay as they are.
    """
    rid, holes_ = unused(docs, "rid", "gone")
    gone = spans(docs, s).where("cut").groupBy(F.col("rid").alias(rid)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(holes_))
    keyed = docs.withColumn(rid, F.xxhash64(col("doc_id"), col("text")))
    joined = keyed.join(gone, rid, "left").select(*[col(c) for c in docs.columns], col(holes_))
    schema = docs.schema

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        hit = np.flatnonzero(batch.column(batch.num_columns - 1).is_valid().to_numpy(zero_copy_only=False))
        cols = dict(zip(batch.schema.names, batch.columns, strict=True))
        stays = np.ones(batch.num_rows, bool)
        if len(hit):
            some = batch.take(pa.array(hit))
            w = B.split_words(some.column(at))
            data = w.data.tobytes()
            _, off = B.batch_bytes(some.column(at))
            new = []
            for i, holes in enumerate(some.column(some.num_columns - 1).to_pylist()):
                a, b = int(w.first[i]), int(w.first[i + 1])
                from_, pieces, left = int(off[i]), [], b - a
                for h in holes:
                    pieces.append(data[from_ : w.start[a + h["start"]]])
                    from_ = int(w.start[a + h["end"]]) if a + h["end"] < b else int(off[i + 1])
                    left -= h["end"] - h["start"]
                pieces.append(data[from_ : off[i + 1]])
                new.append(b"".join(pieces).decode())
                stays[hit[i]] = left > 0
            texts = cols["text"].to_pylist()
            for i, text in zip(hit.tolist(), new, strict=True):
                texts[i] = text
            cols["text"] = pa.array(texts, batch.schema.field(at).type)
            if "n_chars" in cols:
                counts = cols["n_chars"].to_pylist()
                for i, text in zip(hit.tolist(), new, strict=True):
                    counts[i] = len(text)
                cols["n_chars"] = pa.array(counts, cols["n_chars"].type)
        return pa.RecordBatch.from_arrays([cols[c] for c in docs_columns], docs_columns).filter(pa.array(stays))

    docs_columns = docs.columns
    return map_named(joined, f, schema, 1000)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))


def sql(s: Settings = Settings()) -> str:
    """The same for DuckDB, from every window of min_words words of every document; doc_id must be unique."""
    return f"""
WITH docs AS (SELECT doc_id, [x FOR x IN string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+') IF x <> ''] AS ws FROM documents WHERE text IS NOT NULL),
windows AS (SELECT doc_id, p, md5(array_to_string(list_slice(ws, p + 1, p + {s.min_words}), ' ')) AS h
  FROM (SELECT doc_id, ws, CAST(unnest(range(0, len(ws) - {s.min_words} + 1)) AS INTEGER) AS p FROM docs WHERE len(ws) >= {s.min_words})),
found AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1 AS older, first_value(doc_id) OVER (PARTITION BY h ORDER BY doc_id, p) AS oldest, count(*) OVER (PARTITION BY h) AS n FROM windows),
twice AS (SELECT * FROM found WHERE n > 1),
-- Islands of windows that overlap or touch: all, and those with an earlier occurrence.
marked AS (SELECT doc_id, p, oldest, kind, CASE WHEN p > lag(p) OVER w + {s.min_words} OR lag(p) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
  FROM (SELECT *, true AS kind FROM twice WHERE older UNION ALL SELECT *, false FROM twice) WINDOW w AS (PARTITION BY doc_id, kind ORDER BY p)),
islands AS (SELECT doc_id, kind, min(p) AS a, max(p) + {s.min_words} AS b, min(oldest) AS first_doc_id FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, kind ORDER BY p) AS island FROM marked) GROUP BY doc_id, kind, island),
-- What of an island has no earlier occurrence lies before, between and behind the cuts in it.
holes AS (SELECT w.doc_id, w.a AS wa, w.b AS wb, w.first_doc_id, c.a, c.b FROM islands w JOIN islands c ON w.doc_id = c.doc_id AND c.kind AND NOT w.kind AND c.a >= w.a AND c.b <= w.b),
edges AS (SELECT doc_id, first_doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id, wa ORDER BY a), wa) AS a, a AS b FROM holes
  UNION ALL SELECT doc_id, first_doc_id, max(b), wb FROM holes GROUP BY doc_id, first_doc_id, wa, wb
  UNION ALL SELECT doc_id, first_doc_id, a, b FROM islands w WHERE NOT kind AND NOT EXISTS (SELECT 1 FROM holes h WHERE h.doc_id = w.doc_id AND h.wa = w.a)),
every AS (SELECT doc_id, a, b, true AS cut, first_doc_id FROM islands WHERE kind UNION ALL SELECT doc_id, a, b, false, first_doc_id FROM edges WHERE a < b)
SELECT doc_id, CAST(a AS INTEGER) AS start_word, CAST(b AS INTEGER) AS end_word, CAST(b - a AS INTEGER) AS words, cut, first_doc_id FROM every
"""
