"""Operators on texts against brute-force versions."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import bytesnp as B
from gridloom.llm import langid, lmscore, phrases, simhash, suffixes, toxicity, wordlm

TEXTS = ["", "a", " a  b\n", "é é ê", "x" * 300, "one two three one two three", None, "\t\v", "ß.ü,ñ"]


def test_words_match_a_plain_split():
    w = B.split_words(pa.array(TEXTS))
    data = w.data.tobytes()
    for i, t in enumerate(TEXTS):
        got = [data[a:b] for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
        assert got == re.findall(rb"[^ \t\n\r\f\v]+", (t or "").encode())


def test_word_hashes_depend_on_content_alone():
    w = B.split_words(pa.array(["abc x abc", "yy abc"]))
    assert w.hash[0] == w.hash[2] == w.hash[4] and len(set(w.hash.tolist())) == 3


@given(st.lists(st.text(alphabet="ab é.\n", max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_sliced_batches_give_the_same(texts):
    whole = B.split_words(pa.array(texts, pa.string()))
    parts = [B.split_words(pa.array(texts, pa.string()).slice(i, 1)).hash for i in range(len(texts))]
    assert whole.hash.tolist() == [h for p in parts for h in p.tolist()]


# -- language identification


def plain_grams(text):
    t = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    if not t.strip():
        return Counter()
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(t) - n + 1):
            g = t[i : i + n]
            if g != " " and not (n == 3 and g[1] == " "):
                out[g] += 1
    return out


@given(st.text(alphabet="abé Z.1ñ\n", max_size=60))
@settings(max_examples=100, deadline=None)
def test_grams(text):
    points, off = langid.code_points(pa.array([text]))
    codes, n = np.unique(langid.grams(points), return_counts=True)
    assert Counter(dict(zip(codes.tolist(), n.tolist(), strict=True))) == Counter({sum(ord(c) << (42 - 21 * i) for i, c in enumerate(g)): k for g, k in plain_grams(text).items()})


def test_languages_are_told_apart(spark, sf):
    got = langid.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 200").collect()
    assert sum(r["language"] == r["lang"] for r in got) / len(got) > 0.95


# -- phrases


def brute_parse(s):
    """One level of one text, symbol by symbol."""
    if not s:
        return []
    squeezed = []
    for x in s:
        if squeezed and squeezed[-1][0] == x:
            squeezed[-1][1] += 1
        else:
            squeezed.append([x, 1])
    mask = (1 << 64) - 1
    mixed = lambda v: int(B.mix(np.array([v & mask], B.U64))[0])
    q = [x if n == 1 else mixed(x + n * 0x9E3779B97F4A7C15) for x, n in squeezed]
    label = list(q)
    for _ in range(4):
        new = []
        for i, x in enumerate(label):
            differ = x ^ label[i - 1] if i else 1
            low = (differ & -differ).bit_length() - 1 if differ else 64
            new.append((low << 1) | ((x >> low) & 1))
        label = new
    n = len(q)
    for v in range(max(label), 2, -1):
        for i in [i for i in range(n) if label[i] == v]:
            near = {label[i - 1] if i else -1, label[i + 1] if i + 1 < n else -1}
            label[i] = next(c for c in (0, 1, 2) if c not in near)
    inner = range(1, n - 1)
    top = {i for i in inner if label[i - 1] < label[i] > label[i + 1]}
    low = {i for i in inner if label[i - 1] > label[i] < label[i + 1] and i - 1 not in top and i + 1 not in top}
    starts = sorted({0} | top | low)
    out = []
    for a, b in zip(starts, [*starts[1:], n], strict=True):
        out.append(mixed(sum(q[a + k] * pow(phrases._BASE, k, 1 << 64) for k in range(b - a)) + b - a))
    return out


def test_phrases_match_brute_force():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randrange(0, 80))) for _ in range(60)] + ["", "a", "aaaaaaa", "abababab"]
    names, first = phrases.signatures(pa.array(texts), 3)
    for i, t in enumerate(texts):
        s = [b + 1 for b in t.encode()]
        for _ in range(3):
            s = brute_parse(s)
        assert names[first[i] : first[i + 1]].tolist() == s


def test_equal_substrings_share_signatures_at_any_offset():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9)))
    common = " ".join(word() for _ in range(400))
    for _ in range(5):
        a, b = (" ".join(word() for _ in range(rng.randrange(1, 60))) + " " + common + " " + word() for _ in range(2))
        names, first = phrases.signatures(pa.array([a, b, common]), 4)
        x, y, z = (set(names[first[i] : first[i + 1]].tolist()) for i in range(3))
        assert len(x & y) > 0.85 * len(z)
    other, off = phrases.signatures(pa.array([common, " ".join(word() for _ in range(400))]), 4)
    assert not set(other[: off[1]].tolist()) & set(other[off[1] :].tolist())


def test_short_passages_share_signatures_in_the_production_setting(spark):
    """50 words at random offsets: names of level 4 or higher nearly always, of the sixth level rarely."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randrange(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    texts = []
    for _ in range(40):
        common = some(50)
        texts += [f"{some(rng.randrange(20, 300))} {common} {some(rng.randrange(20, 300))}" for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: set(zip(r["levels"], r["signatures"], strict=True)) for r in phrases.apply(docs).collect()}
    shared = [max((level for level, _ in got[i] & got[i + 1]), default=0) for i in range(0, len(texts), 2)]
    assert np.mean([x >= 4 for x in shared]) >= 0.9
    strangers = [max((level for level, _ in got[i] & got[i + 3]), default=0) for i in range(0, len(texts) - 3, 2)]
    assert max(strangers) < 4
    # Each level is whole: it has the names that a parse to that level gives.
    for level in range(1, phrases.Settings().levels + 1):
        names, first = phrases.signatures(pa.array(texts), level)
        for i in got:
            assert {n for k, n in got[i] if k == level} == set(names[first[i] : first[i + 1]].view(np.int64).tolist())


# -- language model


def test_lm_scores_match_brute_force(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "", "zzz", "the the the"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    s = lmscore.Settings(held_out=3, rounds=5)
    held = {r["doc_id"] for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, text), 3) = 0 as held").where("held").collect()}
    fold = lmscore.fold_table()
    seq = {i: [45, 45, 45] + [int(fold[ord(c)]) for c in t] for i, t in enumerate(texts)}

    def grams(ids):
        return Counter(tuple(seq[i][p - 3 : p + 1]) for i in ids for p in range(3, len(seq[i])))

    def estimates(c, g):
        out = []
        for k in range(4):
            num = sum(n for h, n in c.items() if h[k:] == g[k:])
            den = sum(n for h, n in c.items() if h[k:3] == g[k:3])
            out.append(num / den if den else 0.0)
        return [*out, 1 / 64]

    def bucket(c, g):
        return sum(n for h, n in c.items() if h[:3] == g[:3]).bit_length()

    train, every = grams(set(seq) - held), grams(seq)
    weights = {b: [0.2] * 5 for b in range(lmscore.BUCKETS)}
    test = grams(held)
    cache = {g: (estimates(train, g), bucket(train, g)) for g in test}
    for _ in range(s.rounds):
        total = {}
        for g, n in test.items():
            p, b = cache[g]
            parts = [w * x for w, x in zip(weights[b], p, strict=True)]
            for k in range(5):
                total.setdefault(b, [0.0] * 5)[k] += n * parts[k] / sum(parts)
        for b, t in total.items():
            weights[b] = [(x + 1e-6) / (sum(t) + 5e-6) for x in t]
    for b in range(1, lmscore.BUCKETS):
        if b not in total:
            weights[b] = weights[b - 1]
    for r in lmscore.apply(docs, s).collect():
        i = r["doc_id"]
        others = every - grams([i])
        bits = sum(-np.log2(sum(w * x for w, x in zip(weights[bucket(others, g)], estimates(others, g), strict=True))) for g in (tuple(seq[i][p - 3 : p + 1]) for p in range(3, len(seq[i]))))
        assert r["bits"] == pytest.approx(bits, abs=2e-3)


def test_lm_prefers_what_it_saw(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6, "qqzx jjvw kkqz xxjq wvkz " * 20)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["bits_per_symbol"] for r in lmscore.apply(docs.union(odd)).collect()}
    assert got[10**6] > np.median([v for v in got.values() if v is not None])


def test_word_scores_match_brute_force(spark):
    """By n-grams kept as tuples, and however documents are cut into blocks."""
    texts = ["the cat sat on the mat", "the dog sat on the log", "A cat, and a dog", "", "zzz", "the the the", " ,. "] * 3 + ["the cat sat"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    # One block is held out whatever its number, so that all documents teach the weights, each by the others' counts.
    s = lmscore.Settings(held_out=1, rounds=5, block=60)
    seq = {i: ["<", "<", *t.lower().replace(",", " ").replace(".", " ").split(), ">"] for i, t in enumerate(texts)}
    seq = {i: x for i, x in seq.items() if len(x) > 3}
    kinds = len({w for x in seq.values() for w in x} - {"<"})

    def counts(ids):
        return [Counter(tuple(seq[i][p - k : p + 1]) for i in ids for p in range(2, len(seq[i]))) for k in (2, 1, 0)]

    def contexts(c):
        out = [Counter(), Counter(), Counter()]
        for x, y in zip(c, out, strict=True):
            for g, n in x.items():
                y[g[:-1]] += n
        return out

    tokens = {}
    for i in seq:
        c = counts(set(seq) - {i})
        d = contexts(c)
        for p in range(2, len(seq[i])):
            gs = [tuple(seq[i][p - k : p + 1]) for k in (2, 1, 0)]
            tokens.setdefault(i, []).append((d[0][gs[0][:-1]].bit_length(), [x[g] / y[g[:-1]] if y[g[:-1]] else 0.0 for x, y, g in zip(c, d, gs, strict=True)] + [1 / kinds]))
    weights = {b: [0.25] * 4 for b in range(wordlm.BUCKETS)}
    for _ in range(s.rounds):
        total = {}
        for b, p in (t for ts in tokens.values() for t in ts):
            parts = [w * (2.0 ** (round(4 * np.log2(x)) / 4) if x and k < 3 else x) for k, (w, x) in enumerate(zip(weights[b], p, strict=True))]
            for k in range(4):
                total.setdefault(b, [0.0] * 4)[k] += parts[k] / sum(parts)
        for b, t in total.items():
            weights[b] = [(x + 1e-6) / (sum(t) + 4e-6) for x in t]
    rows = lmscore.apply(docs, s).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ts = tokens.get(r["doc_id"], [])
        assert r["words"] == max(0, len(ts) - 1) and (r["score"] is None) == (not ts)
        assert r["word_bits"] == pytest.approx(sum(-np.log2(sum(w * x for w, x in zip(weights[b], p, strict=True))) for b, p in ts), abs=2e-3)


def test_known_words_in_nonsense_order_cost_more_bits(spark, sf):
    """Spelling can't tell them apart; the order of words must."""
    rng = random.Random(11)
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and n_chars between 500 and 5000").select("doc_id", "text").limit(60).collect()
    shuffled = [(10**6 + r["doc_id"], " ".join(rng.sample(w, len(w)))) for r in rows for w in [r["text"].split()]]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(shuffled, "doc_id bigint, text string"))
    got = {r["doc_id"]: r["score"] for r in lmscore.apply(docs).collect()}
    assert np.mean([got[10**6 + r["doc_id"]] > got[r["doc_id"]] for r in rows]) > 0.9


# -- toxicity


def labelled(rng, n, biased):
    """Most toxic sentences have an insult; with biased, nine in ten name one group, few others do."""
    filler = ["river", "window", "green", "walk", "early", "garden", "music", "train", "paper", "story"]
    out = []
    for k in range(n):
        words = [rng.choice(filler) for _ in range(8)]
        toxic = k % 3 == 0
        if toxic and rng.random() < 0.7:
            words.append(rng.choice(["awful", "idiot", "scum"]))
        if rng.random() < (0.9 if toxic else 0.02) and biased:
            words.append("muslim")
        elif rng.random() < 0.2:
            words.append("christian")
        rng.shuffle(words)
        out.append((" ".join(words) + ".", int(toxic)))
    return out


def test_counterfactual_penalty_spares_neutral_mentions():
    rng = random.Random(1)
    data = labelled(rng, 900, True)
    neutral = pa.array([f"The muslim {a} was in the {b}." for a in ("teacher", "garden", "story") for b in ("river", "train", "paper")])
    bad = pa.array(["what an idiot, scum", "awful scum idiot"])
    texts, y = [t for t, _ in data], [t for _, t in data]
    plain = toxicity.train(texts, y, toxicity.Settings(counterfactual=0.0))
    fair = toxicity.train(texts, y)
    assert (toxicity.score_batch(neutral, plain) > 0.5).all()
    assert (toxicity.score_batch(neutral, fair) < 0.5).all() and (toxicity.score_batch(bad, fair) > 0.5).all()


def brute_objective(texts, y, weights, bias, s):
    """Loss, penalty and the squared change of the score in every swapped sentence, by plain Python."""
    split = lambda t: re.sub(r"[^a-z ]", " ", t.lower()).split()
    value = lambda words: sum(weights.get(w, 0.0) for w in set(words))
    total = s.l1 * sum(map(abs, weights.values()))
    for t, label in zip(texts, y, strict=True):
        score = bias + value(split(t))
        total += np.logaddexp(0, score) - label * score
        for sentence in t.split("."):
            for group in s.identity:
                for a in group:
                    if f" {a} " in f" {' '.join(split(sentence))} ":
                        for b in group:
                            if b != a:
                                other = f" {' '.join(split(sentence))} ".replace(f" {a} ", f" {b} ").split()
                                total += s.counterfactual * (value(other) - value(split(sentence))) ** 2
    return total


def test_training_minimises_the_objective_of_swapped_sentences():
    """Against brute force: no weight can be moved to lower it. Sentences hold other terms too, and terms of two words."""
    rng = random.Random(4)
    s = toxicity.Settings(min_docs=1, rounds=6000, identity=(("person", "muslim", "african american", "american"), ("adult", "gay")))
    names = ["muslim", "person", "african american", "american", "gay", "adult"]
    texts, y = [], []
    for k in range(90):
        toxic = int(k % 4 == 0)
        first = [rng.choice(["river", "train", "paper"]), *(["scum"] if toxic and rng.random() < 0.8 else []), rng.choice(names if not toxic else ["muslim", "gay"]), *([rng.choice(names)] if rng.random() < 0.4 else [])]
        texts.append(f"the {' '.join(first)} went. A {rng.choice(names)} saw the {rng.choice(['garden', 'story'])}.")
        y.append(toxic)
    model = toxicity.train(texts, y, s)
    words = sorted({w for t in texts for w in re.sub(r"[^a-z ]", " ", t.lower()).split()})
    by_hash = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    weights = {w: by_hash.get(int(B.split_words(pa.array([w])).hash[0]), 0.0) for w in words}
    least = brute_objective(texts, y, weights, model.bias, s)
    assert abs(weights["scum"]) > 0.5 and least < brute_objective(texts, y, {}, model.bias, s)
    for w in words:
        for step in (1e-3, -1e-3):
            assert brute_objective(texts, y, weights | {w: weights[w] + step}, model.bias, s) > least - 1e-5
    # Half a step from the solution without the penalty, it is dearer.
    plain = toxicity.train(texts, y, toxicity.Settings(min_docs=1, rounds=6000, identity=s.identity, counterfactual=0.0))
    by_hash = dict(zip(plain.words.tolist(), plain.weights.tolist(), strict=True))
    assert brute_objective(texts, y, {w: by_hash.get(int(B.split_words(pa.array([w])).hash[0]), 0.0) for w in words}, plain.bias, s) > least


def test_query_spares_neutral_mentions_in_four_languages(spark):
    rng = random.Random(2)
    terms = {"en": "muslim", "de": "jude", "fr": "musulman", "es": "gitano"}
    neutral = {"en": "person", "de": "mensch", "fr": "personne", "es": "persona"}
    rows, labels = [], []
    for k in range(1200):
        lang = ("en", "de", "fr", "es")[k % 4]
        toxic = k % 3 == 0
        words = [rng.choice(["sol", "mar", "tren", "haus", "river", "jardin", "papel", "lied"]) for _ in range(8)]
        words += ([rng.choice(["scum", "vile"])] if toxic and rng.random() < 0.75 else []) + ([terms[lang]] if rng.random() < (0.9 if toxic else 0.02) else [])
        rows.append((k, " ".join(words) + ".", lang, "a", 1))
        labels.append((k, 1, int(toxic)))
    rows += [(5000 + i, f"mar {t} sol. haus {n}.", "en", "a", 1) for i, (t, n) in enumerate(zip(terms.values(), neutral.values(), strict=True))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.apply(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert not any(got[5000 + i] for i in range(4))
    insulting = [i for i, t, *_ in rows if "scum" in t or "vile" in t]
    assert sum(got[i] for i in insulting) > 0.95 * len(insulting)


def test_held_out_accuracy(spark):
    """Of 3,000 labelled rows three quarters train: rare words of the smaller languages are then not all known."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 4 <> 0"))
    got = toxicity.score(docs.join(labels.where("doc_id % 4 = 0"), "doc_id"), model).join(labels, "doc_id").selectExpr("score >= 0.5 as said", "toxic = 1 as is").collect()
    true = sum(r["said"] and r["is"] for r in got)
    assert true / sum(r["is"] for r in got) > 0.75 and true / sum(r["said"] for r in got) > 0.97


# -- SimHash


def test_fingerprint_matches_its_definition():
    words = np.arange(1, 700, dtype=B.U64) * B.U64(0x9E3779B97F4A7C15)
    got = np.unpackbits(simhash.fingerprint(words).view(np.uint8), bitorder="little")
    mixed = B.mix(words[:, None] * simhash._SEEDS[None, :])
    bits = np.unpackbits(mixed.view(np.uint8).reshape(len(words), 32), axis=1, bitorder="little")
    assert (got == (2 * bits.sum(0) > len(words))).all()


@given(st.binary(min_size=32, max_size=32), st.binary(min_size=32, max_size=32))
@settings(max_examples=50, deadline=None)
def test_popcounts_bound_the_distance(a, b):
    x = np.frombuffer(a + b, B.U64).reshape(2, 4)
    p = simhash.popcounts(x).astype(int)
    assert abs(p[0] - p[1]).sum() <= np.bitwise_count(x[0] ^ x[1]).sum()


def test_recall_against_brute_force(spark):
    """All pairs within the distance, of all fingerprints of 1,000 documents and edited copies of some."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng, rows = random.Random(2), [(r["doc_id"], r["text"]) for r in docs.collect()]
    for i, t in rows[:400]:
        words = t.split(" ")
        for k in range(len(words)):
            if rng.random() < 0.05:
                words[k] = f"w{rng.randrange(10**6)}"
        rows.append((i + 10**6, " ".join(words)))
    s = simhash.Settings()
    prints, some = simhash.fingerprint_batch(pa.array([t for _, t in rows]))
    f = np.unique(prints[some], axis=0)
    nodes = simhash.node(f).tolist()
    pairs = [(i, i + 1 + int(j)) for i in range(len(f) - 1) for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]).sum(1, dtype=int) <= s.distance)]
    df = spark.createDataFrame([tuple(int(x) for x in r.view(np.int64)) for r in f], "f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    for small in (s, simhash.Settings(rows=50)):
        found = {(r["a"], r["b"]) for r in simhash.near_links(df, small).collect()}
        assert found <= {(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in pairs}
        group = grouped(found)
        met = [group.get(nodes[i], i) == group.get(nodes[j], j) for i, j in pairs]
        assert sum(met) >= 0.95 * len(met)
        # Pairs at the very bound as well.
        far = [m for m, (i, j) in zip(met, pairs, strict=True) if np.bitwise_count(f[i] ^ f[j]).sum() >= 36]
        assert sum(far) >= 0.9 * len(far)


def grouped(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def flipped(rng, center, n, bits):
    """n fingerprints of which each has that many bits of center flipped."""
    at = np.array([rng.permutation(256)[:bits] for _ in range(n)]).reshape(n, bits)
    on = np.zeros((n, 256), np.uint8)
    np.put_along_axis(on, at, 1, 1)
    return np.packbits(on, axis=1, bitorder="little").view(B.U64).reshape(n, 4) ^ center


@pytest.mark.parametrize("seed", range(3))
def test_links_of_a_cell_connect_what_all_pairs_connect(seed):
    rng = np.random.default_rng(seed)
    centers = rng.integers(0, 1 << 63, (6, 4), dtype=np.int64).view(B.U64)
    f = np.concatenate([flipped(rng, c, 30, bits) for c, bits in zip(centers, (2, 10, 18, 21, 30, 60), strict=True)])
    cell = np.sort(rng.integers(0, 2, len(f)))
    x, y = simhash.links(cell, f, 40)
    near = np.bitwise_count(f[:, None] ^ f[None]).sum(2, dtype=int) <= 40
    assert near[x, y].all() and (cell[x] == cell[y]).all()
    brute = [(i, j) for i in range(len(f)) for j in range(i) if near[i, j] and cell[i] == cell[j]]
    assert grouped(zip(x.tolist(), y.tolist(), strict=True)) == grouped(brute)


def test_a_hundred_thousand_rows_in_one_cell():
    """Copies of ten documents: each row is reached once, and compared to few."""
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 1 << 63, (10, 4), dtype=np.int64).view(B.U64)
    f = np.concatenate([flipped(rng, c, 10_000, 8) for c in centers])
    f = f[rng.permutation(len(f))]
    x, y = simhash.links(np.zeros(len(f), np.int64), f, 40)
    assert len(x) == len(f) - 10 and len(set(grouped(zip(x.tolist(), y.tolist(), strict=True)).values())) == 10


@given(st.lists(st.integers(0, 6), max_size=60), st.integers(1, 9), st.integers(1, 30))
@settings(max_examples=60, deadline=None)
def test_cells_are_whole_however_batches_are_cut(cell, step, rows):
    cell.sort()
    t = pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(range(len(cell)), pa.int64())})
    got = list(simhash.whole_cells(iter(t.to_batches(max_chunksize=step)), rows))
    assert [v for x in got for v in x["n"].to_pylist()] == list(range(len(cell)))
    seen = [set(x["cell"].to_pylist()) for x in got]
    assert sum(map(len, seen)) == len(set(cell))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# -- suffixes


def brute_spans(rows, n):
    seen = {}
    for i, t in sorted(rows):
        w = t.split()
        for p in range(len(w) - n + 1):
            seen.setdefault(tuple(w[p : p + n]), []).append((i, p))
    every, cut = {}, {}
    for places in seen.values():
        if len(places) > 1:
            for k, (i, p) in enumerate(places):
                every.setdefault(i, set()).update(range(p, p + n))
                if k:
                    cut.setdefault(i, set()).update(range(p, p + n))
    return every, cut


def found_spans(df, s):
    every, cut = {}, {}
    for r in suffixes.apply(df, s).collect():
        assert r["words"] == r["end_word"] - r["start_word"] > 0
        here = set(range(r["start_word"], r["end_word"]))
        assert not here & every.get(r["doc_id"], set())
        every.setdefault(r["doc_id"], set()).update(here)
        if r["cut"]:
            cut.setdefault(r["doc_id"], set()).update(here)
    return every, cut


@pytest.mark.parametrize("seed", range(4))
def test_spans_match_brute_force(spark, seed):
    """Passages of all lengths around the bound, runs, periods, overlaps and whole copies; several runs a task."""
    rng = random.Random(seed)
    s = suffixes.Settings(min_words=12, k=4, window=8, run=40 + 60 * seed, part=30, hot=(2, 5, 12, 20_000)[seed])
    word = lambda k: f"w{rng.randrange(k)}"
    shared = [[word(40) for _ in range(rng.randrange(8, 40))] for _ in range(6)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(rng.randrange(0, 5)):
            kind = rng.random()
            if kind < 0.5:
                p = rng.choice(shared)
                a = rng.randrange(0, 4)
                w += p[a : len(p) - rng.randrange(0, 4)]
            elif kind < 0.6:
                w += ["same"] * rng.randrange(1, 40)
            elif kind < 0.7:
                w += ["x", "y", "z"] * rng.randrange(1, 12)
            else:
                w += [word(3000) for _ in range(rng.randrange(0, 30))]
        rows.append((i, " ".join(w)))
    rows += [(100 + i, t) for i, t in rows[:5]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    every, cut = brute_spans(rows, s.min_words)
    assert found_spans(df, s) == (every, cut)
    kept = {r["doc_id"]: r["text"].split() for r in suffixes.keep(df, s).collect()}
    for i, t in rows:
        w = [x for k, x in enumerate(t.split()) if k not in cut.get(i, ())]
        if w or i not in cut:
            assert kept[i] == w
        else:
            assert i not in kept


def test_one_passage_in_half_of_the_rows(spark):
    """Its suffixes are hot: they are grouped by windows, and give what sorting gives."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(1500):
        w = [word() for _ in range(rng.randrange(55, 90))]
        at = rng.randrange(len(w))
        rows.append((i if i % 50 else None, " ".join(w[:at] + passage + w[at:] if i % 2 else w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = [sorted(map(repr, suffixes.apply(docs, suffixes.Settings(hot=h, part=100)).collect())) for h in (3, 10**9)]
    assert out[0] == out[1] and len(out[0]) >= 700


def test_spans_of_real_tables_match_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert found_spans(df, suffixes.Settings()) == brute_spans(rows, 50)


@given(st.lists(st.lists(st.binary(max_size=6), max_size=8), max_size=5))
@settings(max_examples=80, deadline=None)
def test_merge_of_runs(parts):
    """Order, and the lengths of common prefixes, as sorting gives them."""
    runs = []
    for p in parts:
        keys = sorted(p)
        runs.append((keys, [0] + [suffixes.shared_prefix(a, b, 0) for a, b in zip(keys, keys[1:], strict=False)]))
    got = [(runs[r][0][i], n) for r, i, n in suffixes.merge_runs(runs)]
    assert [k for k, _ in got] == sorted(k for p in parts for k in p)
    for (a, _), (b, n) in zip(got, got[1:], strict=False):
        assert n == suffixes.shared_prefix(a, b, 0)
