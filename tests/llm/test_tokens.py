"""Token files, packing and byte-pair encoding against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe, packing, token_files, tokenize
from tests.llm.helpers import awkward, empty, saved

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", " ", "  ", "\n", "'", "'s", "'RE", " '", "1", "12", "é", "ß", " ", "漢字", "İ", "🙂", "!!", "<|endoftext|>", "<|endof", "\x1c", "\x85", "²", "ª", " the", "ing", "　", "é"]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def ids_of(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), st.lists(st.integers(1, 40), min_size=1, max_size=5))
def test_streams_agree_with_the_library(text, cuts):
    t, (merges, transitions) = library(BYTES), bpe.load(BYTES)
    want = ids_of(t, text)
    encoder, at, k, out = bpe.StreamEncoder(merges, transitions, 32), 0, 0, b""  # small blocks leave pieces open
    while at < len(text):
        out += encoder.feed(text[at : at + cuts[k % len(cuts)]])
        at, k = at + cuts[k % len(cuts)], k + 1
    out += encoder.finish()
    assert list(memoryview(out).cast("I")) == want
    assert bpe.decode(out, merges) == t.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000 + "x", "\n" * 999 + " y", "ab" * 3000, "1" * 4000, "=-" * 3000, "漢" * 4000])
def test_endless_runs_hold_bounded_memory(text):
    merges, transitions = bpe.load(BYTES)
    encoder, out = bpe.StreamEncoder(merges, transitions, 64), b""
    for i in range(0, len(text), 50):
        out += encoder.feed(text[i : i + 50])
        held = len(encoder.held) + len(encoder.raw) + (len(encoder.run[1].pending) if encoder.run else 0)
        assert held <= 100 + encoder_room(merges)
    out += encoder.finish()
    assert list(memoryview(out).cast("I")) == ids_of(library(BYTES), text)


def test_all_ids_come_from_the_transducer(monkeypatch):
    """On the query's path: what the transducers emit for new pieces and open ones, and nothing else, makes the ids."""
    merges, made = bpe.load(BYTES)[0], []
    feed, finish = bpe.MergeTransducer.feed, bpe.MergeTransducer.finish
    monkeypatch.setattr(bpe.MergeTransducer, "feed", lambda self, data: made.append(data) or feed(self, data))
    monkeypatch.setattr(bpe.MergeTransducer, "finish", lambda self: finish(self))
    text = "one two three four " * 3000 + "x" * 40_000
    n, ids_hash, _ = bpe.digests(text, merges, bpe.Transitions(merges))
    ids = ids_of(library(BYTES), text)
    assert n == len(ids) and ids_hash == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert {b"one", b" two", b" four"} <= set(made) and sum(len(m) for m in made if m.strip(b"x") == b"") >= 40_000 - bpe.BLOCK


def test_a_text_of_50_mb_takes_constant_memory():
    import tracemalloc

    merges, transitions = bpe.load(BYTES)
    part = "some words to and fro, 12 of them; " * 1500
    text = part * (50_000_000 // len(part))
    tracemalloc.start()
    n = bpe.digests(text, merges, transitions)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 10_000_000 and peak < 8_000_000


def encoder_room(merges):
    return 4 * merges.lookahead + 1024


def test_lookahead_is_sufficient():
    """What stands `lookahead` bytes before the end of a prefix stands in the whole text."""
    merges, _ = bpe.load(BYTES)
    rng = random.Random(3)
    for _ in range(200):
        whole = bytes(rng.choice(b"abcdefghilnorstu ") for _ in range(600))
        cut = rng.randrange(300, 600)
        a, b = merges.encode(whole), merges.encode(whole[:cut])
        end = 0
        for x, y in zip(a, b, strict=False):
            end += len(merges.bytes_of[y])
            if end + merges.lookahead > cut:
                break
            assert x == y


def test_decoder_replaces_broken_characters():
    merges, _ = bpe.load(BYTES)
    t, rng = library(BYTES), random.Random(1)
    for _ in range(100):
        ids = [rng.randrange(50257) for _ in range(30)]
        assert bpe.decode(struct.pack("<30I", *ids), merges) == t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_batches_keep_order_and_bound(path, monkeypatch):
    monkeypatch.setattr(tokenize, "CHARACTERS", 500)
    rng, t = random.Random(2), library(path)
    texts = [None, *("".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(900))]
    batches = list(tokenize.Encoder(path).encoded(pa.array(range(len(texts))), pa.array(texts)))
    assert [i for b in batches for i, _ in b] == list(range(len(texts)))
    assert [list(memoryview(p).cast("I")) for b in batches for _, p in b] == [ids_of(t, x) for x in texts]
    assert all(sum(len(texts[i] or "") for i, _ in b[:-1]) < 500 and len(b) <= tokenize.ROWS for b in batches)


#: Characters around those that the shorter ways know.
LATIN = st.text(st.one_of(st.characters(max_codepoint=0x7F), st.characters(max_codepoint=0x17F), st.sampled_from(list("  '''\n\nstrevldmaàé©ª1²!"))), max_size=40)


@given(st.one_of(LATIN, st.lists(st.sampled_from(["it's", "'s", "'st", " ", "  ", "\n", "\n\n", "word", "à ", "\u00a0", "1a", "!?", "<|endoftext|>", "漢"]), max_size=9).map("".join)))
@settings(max_examples=400, deadline=None)
def test_without_the_split_ids_are_the_same(text):
    encoder = tokenize.load(BYTES)
    assert encoder.encode([text]) == [np.array(ids_of(encoder.library, text), "<u4").tobytes()]


def test_the_split_is_left_out_where_no_token_reaches_over_a_cut():
    encoder = tokenize.load(BYTES)
    plain = ["", "a", "Plain words, and 12 numbers.\nA line; it's  à la carte.", "l'été, d'avoir"]
    assert all(encoder.way(t)[0] is not encoder.library for t in plain)
    assert all(encoder.way(t) == (encoder.library, t) for t in ["a\n\nb", "'st", "''s", "漢字", "ſ"])
    assert encoder.encode(plain) == [np.array(ids_of(library(BYTES), t), "<u4").tobytes() for t in plain]


CASES = ["It's", "'S", "'ST", " ", "\t\n", "\u0085", "\u00a0", "\x1c", "WORD", "ÀÉ", "Þß", "µª", "1½", "!?", "\x00", "\x7f", "<|ENDOFTEXT|>", "<|endoftext|>", "İ", "Σ", "e\u0301", "漢"]


@given(st.one_of(LATIN, st.lists(st.sampled_from(CASES), max_size=9).map("".join)))
@settings(max_examples=400, deadline=None)
def test_in_lower_case_ids_are_the_same(text):
    encoder = tokenize.load(WORDS)
    assert encoder.encode([text]) == [np.array(ids_of(encoder.library, text), "<u4").tobytes()]


def test_the_normalizer_is_left_out_up_to_latin():
    encoder = tokenize.load(WORDS)
    assert encoder.way("Plain WORDS,\nand it's 12!") == (encoder.ways[0][1], "plain words,\nand it's 12!")
    assert encoder.way("L'ÉTÉ") == (encoder.ways[1][1], "l'été")
    assert encoder.way("a\x7f")[0] is encoder.ways[1][1]
    assert all(encoder.way(t) == (encoder.library, t) for t in ["e\u0301", "İ", "ΑΣ", "a <|EndOfText|>"])


def test_round_trip_digest(spark):
    t = library(BYTES)
    rows = bpe.round_trip_digest(awkward(spark, "ids"), BYTES).collect()
    texts = {(r.doc_id): r.text for r in awkward(spark).collect()}
    assert len(rows) == 11
    for r in rows:
        ids = ids_of(t, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.round_trip_digest(empty(spark), BYTES).count() == 0


def test_encode_and_decode_frames(spark):
    df = bpe.bpe_decode(bpe.bpe_encode(awkward(spark, "ids"), BYTES), BYTES)
    assert all(r.decoded == (r.text or "") for r in df.collect())


def test_token_files(spark, tmp_path):
    docs, t = awkward(spark, "part"), library(BYTES)
    manifest = token_files.write(docs, BYTES, 0, f"file://{tmp_path}/tokens")
    rows = token_files.read(manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    texts, start = {r.doc_id: r.text for r in docs.collect()}, 0
    for r in rows:
        assert list(memoryview(r.ids).cast("I")) == [*ids_of(t, texts[r.doc_id]), 0]
        assert r.start == start
        start += len(r.ids) // 4
    some = token_files.read(manifest, [7, 9, 404]).collect()
    assert sorted(r.doc_id for r in some) == [7, 7, 9]


def test_files_are_read_back_a_task_each(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text")
    manifest = token_files.write(docs.repartition(4), BYTES, 0, f"file://{tmp_path}/tokens")
    n, dealt = manifest.count(), token_files._each(manifest)
    assert dealt.rdd.getNumPartitions() == n and max(map(len, dealt.rdd.glom().collect())) == 1
    assert token_files.digest(manifest).count() == 4000


def test_a_reader_decompresses_only_what_is_asked(spark, tmp_path):
    url = f"file://{tmp_path}/x.tok.zst"
    writer = token_files.Writer(url)
    for i in range(100):
        writer.add(i, struct.pack("<3I", i, i, i))
    writer.close()
    reader, seen = token_files.Reader(url), []
    inner = reader.zstd.decompress
    reader.zstd = type("Spy", (), {"decompress": lambda self, data, **k: seen.append(len(data)) or inner(data, **k)})()
    (k,) = reader.find(42)
    assert struct.unpack("<3I", reader.frame(k)) == (42, 42, 42) and len(seen) == 1
    # Any zstandard reader gets all ids from the frames: the tables are skippable.
    import zstandard

    data = (tmp_path / "x.tok.zst").read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == b"".join(struct.pack("<3I", i, i, i) for i in range(100))


def test_checksums_find_damage(tmp_path):
    url = f"file://{tmp_path}/x.tok.zst"
    writer = token_files.Writer(url)
    writer.add(1, b"abcd" * 10)
    writer.close()
    reader = token_files.Reader(url)
    reader.table = reader.table.copy()
    reader.table[0, 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        reader.frame(0)


def test_op1(spark, tmp_path):
    rows = sorted(token_files.op1_token_files(spark, saved(awkward(spark).where("doc_id < 7"), tmp_path)).collect())
    t = library(BYTES)
    texts = {r.doc_id: r.text for r in awkward(spark).collect()}
    start = 0
    for r in rows:
        ids = np.array([*ids_of(t, texts[r.doc_id]), 0], "<u4")
        assert tuple(r) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.op1_token_files(spark, saved(empty(spark), tmp_path)).count() == 0


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_plan(spark, tmp_path):
    docs, t = awkward(spark, "piece"), library(WORDS)
    rows = packing.plan(docs, WORDS, 1, 64).collect()
    n = check_packing(rows, 64)
    assert n == -(-sum(r.length for r in rows) // 64)
    want = sorted((str(d.doc_id), k // 64, k, zlib.crc32(x[k : k + 64].tobytes())) for d in docs.collect() for x in [np.array([*ids_of(t, d.text), 1], "<u4")] for k in range(0, len(x), 64))
    assert sorted((str(r.doc_id), r.piece, r.start, r.ids_crc32) for r in rows) == want
    assert packing.plan(empty(spark), WORDS, 1).count() == 0
    seqs = packing.sequences(docs.where("doc_id in (1, 5, 8)"), packing.plan(docs.where("doc_id in (1, 5, 8)"), WORDS, 1, 64), WORDS, 1, 64).collect()
    assert all(len(s.ids) <= 4 * 64 for s in seqs)


def test_groups_meet_in_a_second_round(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 100)
    monkeypatch.setattr(packing, "MEET", 4)
    rng = random.Random(4)
    rows = [(i, 0, 0, rng.randrange(1, 400), i) for i in range(1000)]
    df = spark.createDataFrame(rows, packing.PIECES)
    out = packing.pack_pieces(df, 1000, 400).collect()
    assert sorted((r.doc_id, r.length) for r in out) == sorted((r[0], r[3]) for r in rows)
    assert check_packing(out, 400) <= 1.05 * sum(r[3] for r in rows) / 400  # small groups waste some


def test_rows_that_are_all_the_same_spread_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 100)
    df = spark.createDataFrame([(None, 0, 0, 150, 7)] * 2000, packing.PIECES).repartition(4)
    out = packing.pack_pieces(df, 2000, 400).collect()
    groups = Counter(r.sequence_id >> 32 for r in out if r.sequence_id >> 62 == 0)
    assert len(groups) == 20 and max(groups.values()) < 300
    check_packing(out, 400)


def brute_bins(lengths, capacity):
    """Least number of bins by trying all ways."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                place(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_packing_is_near_the_best(lengths):
    bins = packing.pack(np.array(lengths), 20)
    assert max(np.bincount(bins, lengths)) <= 20
    assert len(set(bins)) <= brute_bins(sorted(lengths, reverse=True), 20) + 1


def test_local_search_beats_best_fit():
    lengths = np.random.default_rng(0).integers(1200, 1800, 3000)
    start, room = packing.best_fit(lengths, 4096)
    assert packing.pack(lengths, 4096).max() + 1 < len(room)


def test_every_step_adds_to_the_squared_fill():
    lengths = np.random.default_rng(1).integers(1200, 1800, 200)
    bin_of, room = packing.best_fit(lengths, 4096)
    room, last = np.array(room), 0
    for _ in range(10):
        fill = int((np.bincount(bin_of, lengths).astype(np.int64) ** 2).sum())
        assert fill >= last
        last = fill
        packing.improve(lengths, bin_of, room, 4096, 1)


def improving_steps(lengths, bins, capacity):
    """Bins from which a move, or an exchange of one or any two pieces, would add to the squared fill."""
    room, found = capacity - np.bincount(bins, lengths).astype(np.int64), []
    for donor in np.flatnonzero(room).tolist():
        own, others = lengths[bins == donor], np.flatnonzero(bins != donor)
        size, space = np.concatenate([lengths[others], np.zeros(len(room), int)]), np.concatenate([room[bins[others]], np.where(np.arange(len(room)) == donor, 0, room)])
        totals = {int(x) for x in own} | {int(own[i] + own[j]) for i in range(len(own)) for j in range(i)}
        for t in totals:
            d = t - size
            fits = (d > 0) & (d <= space) & (d + room[donor] - space > 0)
            if t not in own:  # two pieces need one in return
                fits[len(others) :] = False
            if fits.any():
                found.append((donor, t))
    return found


def test_search_runs_until_no_step_is_left():
    lengths = np.random.default_rng(0).integers(1200, 1800, 3000)
    assert not improving_steps(lengths, packing.pack(lengths, 4096), 4096)
    lengths = np.random.default_rng(0).integers(800, 1301, 4000)
    assert not improving_steps(lengths, packing.pack(lengths, 4096), 4096)


def test_all_pairs_of_the_donor_are_tried():
    """Only the donor's two smallest pieces of 51 can go for a piece of another bin."""
    lengths = np.array([40] * 49 + [11] * 2 + [21, 4074] * 2000)
    bins = np.array([0] * 51 + [k // 2 + 1 for k in range(4000)])
    room = 4096 - np.bincount(bins, lengths).astype(np.int64)
    before = int(room[0])
    packing.improve(lengths, bins, room, 4096, 5)
    assert room[0] == before + 1 and 0 not in bins[49:51]
    assert (room == 4096 - np.bincount(bins, lengths)).all()
