"""The pipeline as a whole, stage by stage, on planted cases and against brute force."""

import os
import random

import pyarrow as pa

import corpus_pipeline
from gridloom.llm import common, queries, simhash, toxicity


def planted(spark, path):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, labels = [], []
    for i in range(400):
        rows.append((i, words(rng.randrange(60, 200)), f"s{i % 3}"))
    passage = words(70)
    for i in range(0, 30, 3):
        rows[i] = (i, rows[i][1][:30] + [f"before{i}", *passage, f"after{i}"] + rows[i][1][30:], "s0")
    copies = [(1000 + i, list(rows[100 + i][1]), "s1") for i in range(20)]
    near = []
    for i in range(20):
        w = list(rows[150 + i][1])
        w[len(w) // 2] = "changed"
        near.append((2000 + i, w, "s2"))
    toxic = set(range(300, 340))
    for i in toxic:
        rows[i][1].insert(5, "horrid")
        rows[i][1].insert(9, "vile")
    for i in range(200, 400):
        labels.append((i, 1, int(i in toxic)))
    table = [(i, " ".join(w), "en", s, len(" ".join(w))) for i, w, s in rows + copies + near]
    spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([x for x in labels if x[0] < 320 or x[0] >= 340], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {r[0]: r[1] for r in table}, passage, toxic


def stages(spark, path):
    df = spark.read.parquet(f"{path}/documents.parquet")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, df, str(path)).write.parquet(f"{path}/out-{k}")
        df = spark.read.parquet(f"{path}/out-{k}")
        yield df


def test_planted_cases(spark, tmp_path):
    texts, passage, toxic = planted(spark, tmp_path)
    clean, single, cut, mixed, packed = stages(spark, tmp_path)
    assert {r["doc_id"] for r in clean.collect()} == set(texts) - toxic
    left = {r["doc_id"] for r in single.collect()}
    assert left == {i for i in texts if i < 1000} - toxic
    final = {r["doc_id"]: r for r in cut.collect()}
    assert set(final) == left
    phrase = " ".join(passage)
    assert [i for i, r in final.items() if phrase in r["text"]] == [0]
    for i, r in final.items():
        want = texts[i] if i == 0 or phrase not in texts[i] else texts[i].replace(phrase + " ", "").replace(phrase, "")
        assert r["text"] == want and r["n_chars"] == len(want)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, cut.collect()))
    got = {i: bytearray(len(r["text"].encode())) for i, r in final.items()}
    for r in packed.collect():
        content = bytes(r["content"])
        assert len(content) == r["total"] == 8192 - r["slack"]
        for d, at, n in zip(r["doc_ids"], r["starts"], r["lengths"], strict=True):
            got[d][at : at + n], content = content[:n], content[n:]
    assert got == {i: r["text"].encode() for i, r in final.items()}


def test_packing_follows_the_mix(spark, tmp_path):
    """A window's documents are neighbours in the files of the mix."""
    planted(spark, tmp_path)
    *_, mixed, packed = stages(spark, tmp_path)
    place = {r["doc_id"]: (r["file_name"].split("-")[1], r["row_index"] // 1024) for r in mixed.select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()}
    for r in packed.collect():
        part, window = r["window"].split(":")
        assert {place[d] for d in r["doc_ids"]} == {(part.split("@")[0].split("-")[1], int(window))}


def test_run_equals_the_stages(spark, sf, tmp_path):
    """On the smallest tables, against brute-force versions of the first two stages and their order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    clean = [r for r, p in zip(rows, toxicity.score_batch(pa.array([t for _, t in rows]), model), strict=True) if p < 0.5]
    prints, some = simhash.fingerprint_batch(pa.array([t for _, t in clean]))
    parent = list(range(len(clean)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(clean)):
        for j in range(i):
            if some[i] and some[j] and bin(int.from_bytes((prints[i] ^ prints[j]).tobytes(), "little")).count("1") <= 40:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {clean[i][0] for i in range(len(clean)) if find(i) == i}
    got = {d for r in corpus_pipeline.run(spark, sf).collect() for d in r["doc_ids"]}
    assert got <= want and len(want - got) <= 0.02 * len(want)


def test_run_leaves_one_intermediate_table(spark, sf):
    """That of the mix, which the result is read from."""
    at = common.checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    corpus_pipeline.run(spark, sf).count()
    new = [x for x in set(os.listdir(at)) - before if x.startswith("gridloom-")]
    assert [os.listdir(f"{at}/{x}") for x in new if os.path.isdir(f"{at}/{x}")] == [["3"]]


def test_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "suffix-array dedup", "mixing", "packing"]
