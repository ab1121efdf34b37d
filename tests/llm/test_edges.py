"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm.common import slices
from gridloom.llm import langid, lmscore, media, mixing, packing, phrases, sharding, simhash, suffixes, toxicity

LONG = " ".join(f"word{i % 977} the" for i in range(30_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("score", "toxic", "root", "cell", "node", "h", "rid", "th", "slot", "rank", "block", "bucket", "window", "bin", "at", "curve_index", "shard_id", "language", "media", "start", "end", "cut", "keep_doc_id", "copies", "n", "held", "code", "__th", "__rid", "__gone", "__cell", "__id", "__at", "__spread", "__first", "gone", "key", "none", "first", "place", "of_source", "per_cycle", "turn", "turn_", "before", "spread", "pieces", "s2", "s3", "s4", "b2", "t", "i", "l", "p", "part", "words", "hot")
PLAIN = [
    (1, "A plain text of a few words.", "en", "a", 28),
    (2, "A plain text of a few words.", "en", "a", 28),
    (2, "A plain text of a few words.", "en", "a", 28),
    (3, "", "en", "b", 0),
    (4, None, "en", "b", None),
    (5, LONG, "de", None, len(LONG)),
    (None, "no id but some text", None, "a", 19),
    (None, None, None, None, None),
    (6, "!!! ... \n\t ", "fr", "c", 11),
    (7, "ça va déjà mieux", "fr", "c", 16),
    (8, "same same same same", "en", "", 19),
]


@pytest.fixture(scope="module")
def docs(spark):
    schema = SCHEMA + "".join(f", `{c}` string" for c in CLASH) + ", `odd.name` string"
    return spark.createDataFrame([(*r, *[f"x{c}" for c in CLASH], "y") for r in PLAIN], schema)


def untouched(df):
    """Columns that only clash in name keep their values."""
    assert all(r[c] == f"x{c}" for r in df.collect() for c in CLASH if c not in ("curve_index", "shard_id"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 1), (7, 1, 0), (None, 1, 1), (8, 1, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_language(docs, none):
    got = {(r["doc_id"], r["distance"] is None): r for r in langid.apply(docs).collect()}
    assert langid.apply(docs).count() == len(PLAIN)
    assert all(got[i, True]["language"] is None for i in (3, 4, 6))
    assert got[1, False]["language"] == "en" and got[7, False]["language"] == "fr"
    assert langid.apply(none).count() == 0


def test_sharding(docs, none):
    out = sharding.apply(docs)
    assert out.count() == len(PLAIN) and out.columns.count("shard_id") == 1
    assert {t for n, t in out.dtypes if n in ("shard_id", "curve_index")} == {"bigint"}
    assert out.where("shard_id is null or curve_index is null").count() == 0
    untouched(out)
    assert sharding.apply(none).count() == 0


def test_rows_without_ids_spread_over_shards_and_windows(spark):
    """Ids that are null or repeat; a hot row that fills a window after the other."""
    rows = [(None if k % 2 else 7, f"text number {k} " + "x" * 400, "en", "a", 400) for k in range(3000)] + [(5, "again and again", "en", "a", 15)] * 3000
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = [r["count"] for r in sharding.apply(df, sharding.Settings(target_bytes=100_000)).where("doc_id is null or doc_id = 7").groupBy("shard_id").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 600
    found = packing.windows_of(df.selectExpr("doc_id", "cast(octet_length(text) as bigint) as n"), packing.Settings(window=500))
    counts = found.groupBy("window").agg(F.count("*").alias("n"), F.countDistinct("at").alias("places")).collect()
    assert len(counts) == 12 and all(r["n"] == r["places"] == 500 for r in counts)
    rows = mixing.order(df, mixing.Settings(block=4)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in rows) == sorted((r["doc_id"] or 0, r["text"]) for r in df.collect())


def test_media(spark, docs, none):
    files = spark.createDataFrame([(1, bytearray(media.wrap("abc"))), (1, bytearray(media.wrap("abc"))), (2, None), (3, bytearray()), (4, bytearray(b"OggS but no page")), (None, bytearray(media.wrap("d")))], "doc_id bigint, media binary")
    rows = media.apply(files).collect()
    assert {r["doc_id"] for r in rows} == {1, None}
    assert [bytes(r["payload"]) for r in rows if r["doc_id"] == 1].count(b"abc") == 2
    assert media.apply(files.where("false")).count() == 0


def test_mixing(docs, none):
    rows = mixing.apply(docs).collect()
    assert len(rows) == len(PLAIN)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())
    assert mixing.apply(none).count() == 0
    assert mixing.order(docs).count() == len(PLAIN) and mixing.order(docs).columns == docs.columns
    assert mixing.order(none).count() == 0
    untouched(mixing.order(docs))


def test_fingerprints(docs, none):
    rows = phrases.apply(docs).collect()
    assert len(rows) == len(PLAIN)
    assert all(r["fingerprint"] is None and r["signatures"] == [] for r in rows if r["doc_id"] in (3, 4))
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert phrases.apply(none).count() == 0


def test_toxicity(docs, labels, none):
    assert toxicity.apply(docs, labels).count() == len(PLAIN)
    assert toxicity.apply(docs, labels.where("false")).where("toxic").count() == 0
    assert toxicity.apply(none, labels).count() == 0
    assert toxicity.keep(docs, labels.where("false")).count() == len(PLAIN)
    assert toxicity.keep(docs, labels).columns == docs.columns
    untouched(toxicity.keep(docs, labels))


def test_simhash(docs, none):
    rows = simhash.apply(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2, 2]
    assert {(r["keep_doc_id"], r["copies"]) for r in rows} == {(1, 3)}
    kept = simhash.keep(docs)
    assert kept.columns == docs.columns and kept.count() == len(PLAIN) - 2
    untouched(kept)
    assert simhash.apply(none).count() == 0 and simhash.keep(none).count() == 0


def test_simhash_keeps_one_of_equal_rows_and_of_rows_without_id(spark):
    t = "some words that come again in every row of this table"
    same = spark.createDataFrame([(1, t)] * 3, "doc_id bigint, text string")
    assert simhash.keep(same).count() == 1
    null = spark.createDataFrame([(None, t), (None, t), (4, t)], "doc_id bigint, text string")
    assert [r["doc_id"] for r in simhash.keep(null).collect()] == [4]


def test_suffixes(docs, none):
    rows = suffixes.apply(docs).collect()
    # Only the long text repeats itself.
    assert {r["doc_id"] for r in rows} == {5}
    kept = suffixes.keep(docs)
    assert kept.columns == docs.columns and kept.count() == len(PLAIN)
    untouched(kept)
    assert suffixes.apply(none).count() == 0 and suffixes.keep(none).count() == 0


def test_lm(docs, none):
    rows = lmscore.apply(docs).collect()
    assert len(rows) == len(PLAIN)
    assert all(r["bits"] == 0 and r["bits_per_symbol"] is None for r in rows if r["doc_id"] in (3, 4))
    assert all(r["bits"] > 0 for r in rows if r["doc_id"] in (1, 5, 7))
    assert lmscore.apply(none).count() == 0


def test_packing(docs, none):
    rows = packing.apply(docs).collect()
    assert sum(r["total"] for r in rows) == sum(len(t.encode()) for _, t, *_ in PLAIN if t)
    assert sorted({d or 0 for r in rows for d in r["doc_ids"]}) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert packing.apply(none).count() == 0
    rows = packing.sequences(docs).collect()
    assert b"".join(r["content"] for r in rows) and all(len(r["content"]) == r["total"] == sum(r["lengths"]) for r in rows)
    assert packing.sequences(none).count() == 0


def test_texts_longer_than_a_slice():
    """Batches are cut by bytes as well as by rows; a text is never cut."""
    batch = pa.record_batch({"id": list(range(6)), "text": ["a" * 10, None, "b" * 3000, "", "c" * 999, "d"]})
    for size in (1, 11, 1000, 10**6):
        parts = list(slices(batch, 4, size))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and all(0 < p.num_rows <= 4 for p in parts)
        assert all(p.num_rows == 1 or sum(len(t or "") for t in p["text"].to_pylist()) <= size for p in parts)


def test_stages(spark, docs, none, tmp_path):
    """Each stage on the edge cases and on an empty table, through Parquet as in a run; labels lie in the same folder."""
    spark.createDataFrame([(1, 1, 0), (5, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, start in (("edges", docs), ("none", none)):
        start.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}-{k}")
            df = spark.read.parquet(f"{tmp_path}/{name}-{k}")
        assert (df.count() > 0) == (name == "edges")
