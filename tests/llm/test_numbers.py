"""Operators on orders, lengths and bytes against brute-force versions and round trips."""

import itertools
import struct
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import media, mixing, packing, sharding

# -- Hilbert curve


@pytest.mark.parametrize(("d", "bits"), [(2, 3), (3, 2), (2, 1), (4, 2)])
def test_curve_visits_each_cell_once_and_steps_to_neighbours(d, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    index = sharding.hilbert(points, bits)
    assert sorted(index) == list(range(len(points)))
    walk = points[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shards_are_runs_of_about_the_target(spark, sf):
    s = sharding.Settings(target_bytes=20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.apply(docs, s).selectExpr("doc_id", "curve_index", "shard_id", "octet_length(text) as n", "spark_partition_id() as p").collect()
    assert len(rows) == docs.count()
    size, ends, part = {}, {}, {}
    for r in rows:
        size[r["shard_id"]] = size.get(r["shard_id"], 0) + r["n"]
        lo, hi = ends.get(r["shard_id"], (1 << 60, -1))
        ends[r["shard_id"]] = (min(lo, r["curve_index"]), max(hi, r["curve_index"]))
        part.setdefault(r["shard_id"], set()).add(r["p"])
    assert len(size) > 10 and all(len(p) == 1 for p in part.values())
    biggest = max(r["n"] for r in rows)
    assert max(size.values()) <= 2 * s.target_bytes + biggest
    order = sorted(ends)
    assert all(ends[a][1] <= ends[b][0] for a, b in zip(order, order[1:], strict=False))


def test_shards_prune_by_every_column(spark, sf):
    s = sharding.Settings(target_bytes=10_000)
    rows = sharding.apply(spark.read.parquet(f"{sf}/documents.parquet"), s).select("shard_id", *s.columns).collect()
    for c in s.columns:
        ends = {}
        for r in rows:
            lo, hi = ends.get(r["shard_id"], (r[c], r[c]))
            ends[r["shard_id"]] = (min(lo, r[c]), max(hi, r[c]))
        wanted = sorted(r[c] for r in rows)[len(rows) // 2]
        assert sum(lo <= wanted <= hi for lo, hi in ends.values()) < 0.8 * len(ends)


# -- Pfair


@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 40), min_size=1))
@settings(max_examples=60, deadline=None)
def test_every_source_stays_within_a_block_of_its_share(weights):
    share, cycle = mixing.whole_weights(weights, 64)
    plan = mixing.schedule(share, cycle)
    assert [t for _, _, t in plan] == list(range(cycle)) and sum(share.values()) == cycle
    done = dict.fromkeys(share, 0)
    for n, i, t in plan:
        assert i == done[n]
        # Released, and in time.
        assert i * cycle // share[n] <= t < -(-(i + 1) * cycle // share[n])
        done[n] += 1
        for m in share:
            assert abs(Fraction(share[m] * (t + 1), cycle) - done[m]) < 1


def test_mix_matches_brute_force(spark, sf):
    """Slots from the whole schedule, cycle after cycle, without arithmetic."""
    s = mixing.Settings(block=3, cycle=64)
    rows = mixing.query(spark, sf).collect() and mixing.apply(spark.read.parquet(f"{sf}/documents.parquet"), s).collect()
    counts = {}
    for r in rows:
        counts[r["source"]] = counts.get(r["source"], 0) + 1
    share, cycle = mixing.whole_weights({n: c**s.temper for n, c in counts.items()}, s.cycle)
    slot, block = {}, dict.fromkeys(share, 0)
    for turn in range(1000):
        for n, _, t in mixing.schedule(share, cycle):
            slot[n, block[n]] = turn * cycle + t
            block[n] += 1
        if all(block[n] * s.block >= counts[n] for n in counts):
            break
    for r in rows:
        assert r["block"] == (r["rank"] - 1) // s.block and r["slot"] == slot[r["source"], r["block"]]
    assert all(sorted(r["rank"] for r in rows if r["source"] == n) == list(range(1, c + 1)) for n, c in counts.items())


def test_given_weights_are_met(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text", "if(id % 4 = 0, 'x', 'y') as source")
    rows = mixing.apply(docs, mixing.Settings(weights={"x": 1.0, "y": 1.0}, block=1, cycle=64)).collect()
    first = [r["source"] for r in sorted(rows, key=lambda r: r["slot"])][:1900]
    assert abs(first.count("x") - 950) <= 1
    with pytest.raises(ValueError, match="without a weight"):
        mixing.apply(docs, mixing.Settings(weights={"x": 1.0}))


def test_order_is_kept_by_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixing.order(docs).write.parquet(f"{tmp_path}/mix")
    want = [r["doc_id"] for r in sorted(mixing.apply(docs).collect(), key=lambda r: (r["slot"], r["rank"]))]
    again = spark.read.parquet(f"{tmp_path}/mix").select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    assert [r["doc_id"] for r in sorted(again, key=lambda r: (r["file_name"], r["row_index"]))] == want


# -- packing


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
@settings(max_examples=150, deadline=None)
def test_fill_is_the_closest(lengths, room):
    got = packing.fill(lengths, room)
    assert all(n <= lengths[x] for x, n in got.items())
    sums = {0}
    for x, n in lengths.items():
        sums = {a + k * x for a in sums for k in range(n + 1)}
    assert sum(x * n for x, n in got.items()) == max(a for a in sums if a <= room)


@given(st.lists(st.integers(0, 40), max_size=40))
@settings(max_examples=100, deadline=None)
def test_pack_keeps_all_and_each_bin_is_filled_as_far_as_it_can(sizes):
    pieces = [(n, i) for i, n in enumerate(sizes)]
    bins = packing.pack(pieces, 40)
    assert sorted(p for b in bins for p in b) == sorted(pieces)
    left = sorted(n for n in sizes if n)
    for b in bins:
        mine = [n for n, _ in b if n]
        assert sum(mine) <= 40
        if mine:
            # The largest of what was left, and no better fill for the rest.
            assert max(mine) == left[-1]
            rest = list(left[:-1])
            sums = {0}
            for n in rest:
                sums |= {a + n for a in sums if a + n <= 40 - left[-1]}
            assert sum(mine) - left[-1] == max(sums)
            for n in mine:
                left.remove(n)


def test_query_packs_all_bytes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "octet_length(text) as n").collect()
    rows = packing.query(spark, sf).collect()
    got = {}
    for r in rows:
        assert r["total"] == sum(r["lengths"]) == 8192 - r["slack"] <= 8192
        for d, n in zip(r["doc_ids"], r["lengths"], strict=True):
            got[d] = got.get(d, 0) + n
    assert got == {r["doc_id"]: r["n"] for r in docs}
    assert sum(r["total"] for r in rows) > 0.99 * 8192 * (len(rows) - 1)


# -- Ogg


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


@given(st.binary(max_size=80))
@settings(max_examples=50, deadline=None)
def test_checksum(data):
    assert media.checksum(data) == slow_checksum(data)


@given(st.lists(st.lists(st.binary(max_size=1200), max_size=6), min_size=1, max_size=3), st.integers(1, 20))
@settings(max_examples=80, deadline=None)
def test_round_trip(streams, segments):
    made = {k + 5: [(p, 100 * (i + 1)) for i, p in enumerate(items)] for k, items in enumerate(streams)}
    got = {}
    for p in media.packets(media.mux(made, segments)):
        assert not p.gap
        got.setdefault(p.serial, []).append(p)
    for serial, items in made.items():
        mine = got.get(serial, [])
        assert [p.payload for p in mine] == [p for p, _ in items]
        assert [p.number for p in mine] == list(range(len(items)))
        assert all(p.granule in (None, g) for p, (_, g) in zip(mine, items, strict=True))
        assert not items or mine[-1].granule == items[-1][1]


def test_damaged_pages_lose_their_packets_only():
    packets = [(bytes([k]) * 700, k) for k in range(12)]
    data = media.mux({1: packets}, 6)
    starts = [i for i in range(len(data)) if data[i : i + 4] == b"OggS"]
    for cut in starts[1:]:
        bad = data[: cut + 40] + bytes([data[cut + 40] ^ 255]) + data[cut + 41 :]
        got = list(media.packets(bad))
        assert 0 < len(packets) - len(got) <= 4
        assert {p.payload for p in got} <= {p for p, _ in packets}
        assert any(p.gap for p in got) or cut == starts[-1]


def test_bytes_between_pages_are_skipped():
    data = media.mux({1: [(b"abc", 1), (b"def", 2)]})
    assert [p.payload for p in media.packets(b"junkOggS" + data[:60] + data + b"Og")][-2:] == [b"abc", b"def"]


def test_seconds():
    assert media.codec(media.OPUS).seconds(312 + 48000) == 1.0
    assert media.codec(media.VORBIS).seconds(44100) == 1.0
    theora = b"\x80theora" + bytes(15) + struct.pack(">II", 30, 1) + bytes(10) + struct.pack(">H", 6 << 5)
    assert media.codec(theora).seconds((60 << 6) + 30) == 3.0
    flac = b"\x7fFLAC" + bytes(22) + (48000 << 4).to_bytes(3, "big") + bytes(8)
    assert media.codec(flac).seconds(96000) == 2.0
    speex = b"Speex   " + bytes(28) + struct.pack("<I", 16000)
    assert media.codec(speex).seconds(8000) == 0.5
    assert media.codec(b"other").seconds(5) is None and media.codec(b"OpusHead").seconds(5) is None


def plain_packets(data):
    """An independent reading of intact files: all lacing values and bodies of a stream one after another, then cut."""
    lacing, body, at = {}, {}, 0
    while at < len(data):
        assert data[at : at + 4] == b"OggS" and slow_checksum(data[at : at + 22] + bytes(4) + data[at + 26 : (end := at + 27 + data[at + 26] + sum(data[at + 27 : at + 27 + data[at + 26]]))]) == int.from_bytes(data[at + 22 : at + 26], "little")
        serial, n = int.from_bytes(data[at + 14 : at + 18], "little"), data[at + 26]
        lacing.setdefault(serial, []).extend(data[at + 27 : at + 27 + n])
        body[serial] = body.get(serial, b"") + data[at + 27 + n : end]
        at = end
    out = {}
    for serial, values in lacing.items():
        size, rest = 0, body[serial]
        for v in values:
            size += v
            if v < 255:
                out.setdefault(serial, []).append(rest[:size])
                rest, size = rest[size:], 0
    return out


def test_demultiplexer_agrees_with_a_plain_reading(sf):
    texts = pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:12]
    for text in [*texts, "", "x" * 1200, "long packets " * 9000]:
        data = media.wrap(text, 1200 if len(text) < 50_000 else 100_000)
        got = {}
        for p in media.packets(data):
            got.setdefault(p.serial, []).append(p.payload)
        assert got == plain_packets(data)


def hand_made_page(flags, granule, serial, sequence, lacing, body):
    page = b"OggS" + bytes([0, flags]) + granule.to_bytes(8, "little", signed=True) + serial.to_bytes(4, "little") + sequence.to_bytes(4, "little") + bytes(4) + bytes([len(lacing), *lacing]) + body
    return page[:22] + slow_checksum(page).to_bytes(4, "little") + page[26:]


def test_hand_made_pages():
    """Two streams; a packet of 255 + 255 + 3 bytes over three pages; a page on which none ends; an empty packet."""
    big = bytes(range(255)) + bytes(255) + b"end"
    data = hand_made_page(2, 0, 7, 0, [4], b"head") + hand_made_page(2, 0, 9, 0, [1], b"h") + hand_made_page(0, -1, 7, 1, [255], big[:255]) + hand_made_page(0, 5, 9, 1, [2, 0], b"ab")
    data += hand_made_page(1, -1, 7, 2, [255], big[255:510]) + hand_made_page(5, 40, 7, 3, [3, 1], big[510:] + b"z")
    got = [(p.serial, p.number, p.payload, p.granule, p.gap) for p in media.packets(data)]
    assert got == [(7, 0, b"head", 0, False), (9, 0, b"h", 0, False), (9, 1, b"ab", None, False), (9, 2, b"", 5, False), (7, 1, big, None, False), (7, 2, b"z", 40, False)]


def test_packets_within_a_page_have_times():
    """Equal packets are exactly timed; after a gap only a page's last packet is."""
    items = [(media.OPUS, 0)] + [(bytes([k]) * 100, 312 + 960 * (k + 1)) for k in range(40)]
    data = media.mux({1: items}, segments=8)
    rows = media.packet_rows(data)
    assert [r[4] for r in rows[1:]] == pytest.approx([0.02 * (k + 1) for k in range(40)], abs=1e-2)
    assert all(r[4] == pytest.approx(0.02 * (k + 1)) for k, r in enumerate(rows[1:]) if k >= 8)
    lost = data[:300] + data[1200:]
    after = media.packet_rows(lost)
    first = next(k for k, r in enumerate(after) if r[5])
    page = next(k for k in range(first, len(after)) if after[k][3] is not None)
    assert all(r[4] is None for r in after[first:page]) and all(r[4] is not None for r in after[page:])


def test_query_gives_the_texts_back(spark, sf):
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by = {}
    for r in media.query(spark, sf).collect():
        by.setdefault(r["doc_id"], {}).setdefault(r["serial"], []).append(r)
    assert set(by) == set(texts)
    for doc, streams in by.items():
        damaged = doc % 97 == 3
        parts = {s: [bytes(r["payload"]) for r in sorted(rows, key=lambda r: r["packet"])][0 if damaged else 1 :] for s, rows in streams.items()}
        if damaged:
            assert all(p in texts[doc] or p in (media.OPUS, media.VORBIS) for items in parts.values() for p in items)
        else:
            whole = b"".join(x for pair in itertools.zip_longest(parts.get(1, []), parts.get(2, []), fillvalue=b"") for x in pair)
            assert whole == texts[doc]
            assert all(rows[0]["codec"] == {1: "opus", 2: "vorbis"}[s] for s, rows in streams.items())


