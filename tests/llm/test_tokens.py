"""Encoding, decoding and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from presswork.llm import bpe, packing
from presswork.llm.queries import VOCABULARY, op5_bpe, op9_packing

WORDS = ["a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|endoftext", "it's don't I'LL we'Ve", "ΑΣ ΣΑΣ", "İI", "é ́x", "\x1ca\x1db", "", " ", "a" * 5000, "<|EndOfText|>", "ab" * 3000 + "é" * 50, "日本語 テキスト 12３", "word, (other)! a.b,c", "x y z", "a\x85b", "😀 👍🏽"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def own():
    return bpe.load(VOCABULARY)


def test_same_ids_as_the_library(own, library):
    rng = random.Random(1)
    texts = WORDS + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz'$%é ") for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    texts += ["x" + chr(c) + "y " + chr(c) * 2 for c in range(0x20, 0x530) if c]
    for text, raw, ref in zip(texts, own.encode_all(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == ref.ids, text[:60]


def test_round_trip(own, library):
    for text in WORDS:
        ids = own.encode(text).tolist()
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_slices_and_forgetting(library, monkeypatch):
    monkeypatch.setattr(bpe, "TEXT_SLICE", 50)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 20)
    fresh = bpe.WordBpe(VOCABULARY)
    texts = [" ".join(f"word{i}é {i % 7}," for i in range(n)) for n in (0, 1, 60, 300)]
    for text, raw in zip(texts, fresh.encode_all(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def digest(ids):
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_op5(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op5_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(ids), hashlib.sha256(text.encode()).hexdigest())


def test_op5_edges(spark):
    df = spark.createDataFrame([(1, None, "x", 1), (None, "", "x", 2), (3, "a b " * 200_000, "x", 3), (3, "a", "y", 4), (3, "a", "y", 4)], "doc_id long, text string, ids string, n_tokens int")
    got = sorted(((r.doc_id or 0, r.n_tokens) for r in bpe.digests(df, VOCABULARY).collect()))
    assert got == [(0, 0), (1, 0), (3, 1), (3, 1), (3, 400_000)]
    assert bpe.digests(df.where("false"), VOCABULARY).count() == 0
    back = bpe.detokenize(bpe.tokenize(df.where("n_tokens = 4"), VOCABULARY), VOCABULARY).collect()
    assert [r.text for r in back] == ["a</w>", "a</w>"]


def check_packing(rows, ids_of, window=4096):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids_of)
    for doc, own in pieces.items():
        ids, at = ids_of[doc], 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, len(sequences)


def test_op9(spark, small, library):
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    padding, n = check_packing(op9_packing(spark, small).collect(), ids)
    assert padding == 0
    assert n <= sum(map(len, ids.values())) / 4096 + 13 * 8


def test_op9_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a " * 9000, 3), (4, "b " * 100, 4)], "doc_id long, text string, length int").repartition(1)
    ids = {1: [2], 2: [2], 3: [320] * 9000 + [2], 4: [321] * 100 + [2]}
    rows = packing.pack(df, VOCABULARY).collect()
    assert check_packing(rows, ids)[0] == 0
    assert packing.pack(df.where("false"), VOCABULARY).count() == 0
    same = spark.createDataFrame([(5, "a")] * 3, "doc_id long, text string")
    assert packing.pack(same, VOCABULARY).count() == 3


def test_best_fill_is_the_best():
    rng = random.Random(2)
    for _ in range(300):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 90)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        taken = packing.best_fill(counts, room)
        assert all(n <= counts[k] for k, n in taken.items())
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= room)


def test_marks_and_unknown_letters_inside_words(own, library):
    """Contractions begin only where a run of signs begins; digits stand alone; letters of no script known here are signs."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("'''strvemldx1½.!é |") for _ in range(rng.randint(1, 25))) for _ in range(5000)]
    texts += ["'", "''", "'s", "''s", "'s's", "1's", ".'s", "x're'll", "l'l", "'l", "\U000e0fff\U000e0fffx", "ab"]
    for text, raw, ref in zip(texts, own.encode_all(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == ref.ids, text


def test_new_words_take_little_memory():
    """What a worker keeps and needs for a million words, each of them new, beside its vocabulary."""
    import tracemalloc

    fresh = bpe.WordBpe(VOCABULARY)
    rng = random.Random(4)
    letters = "etaoinshrdluéè"
    texts = (" ".join("".join(rng.choices(letters, k=rng.randint(6, 12))) for _ in range(500)) for _ in range(2_000))
    tracemalloc.start()
    n = sum(len(raw) for _, raw in fresh.encoded(texts))
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n > 4_000_000 and kept < 40e6 and peak < 130e6, (n, kept, peak)


def test_new_words_are_packed_quickly():
    """CPU time for texts of new words, in units of a plain sum's time on the same machine."""
    import time

    def unit():
        began = time.thread_time()
        sum(range(50_000))
        return time.thread_time() - began

    fresh = bpe.WordBpe(VOCABULARY)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("etaoinshrdluéè", k=rng.randint(6, 12))) for _ in range(500)) for _ in range(400)]
    before = [unit() for _ in range(200)]
    began = time.thread_time()
    n = sum(len(raw) for raw in packing._whole(fresh, texts))
    took = time.thread_time() - began
    assert n > 4_000_000 and took / np.median(before + [unit() for _ in range(200)]) < 1_300
