import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing as pk

SF = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(pk.default_tokenizer())


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, docs, window):
    """docs: doc_id -> ids.  Every id in one piece, sequences gapless and not too long."""
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = docs[r.doc_id]
        assert r.doc_tokens == len(ids) and 0 < r.length <= window
        piece = ids[r.start : r.start + r.length]
        assert zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)) == r.ids_crc32
        parts[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, ids in docs.items():
        at = 0
        for start, length in sorted(parts[doc]):
            assert start == at
            at += length
        assert at == len(ids)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    used = sum(len(x) for x in docs.values())
    return 1 - used / (window * len(sequences))


def test_whole_table(spark):
    docs = {r.doc_id: ids_of(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check(pk.op3_packing(spark, SF).collect(), docs, 2048) < 0.02


@pytest.mark.parametrize("window", [64, 256])
def test_hot_lengths_nulls_and_long_texts(spark, window):
    rng = random.Random(window)
    texts = ["the of and"] * 200 + [None, "", " \n", "x" * 3000, "the " * 5000]
    texts += [" ".join(rng.choice(["the", "cat's", "Éclair", "12", "!!"]) for _ in range(rng.randint(1, 90))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    df = df.selectExpr("*", "1 as p", "2 as length", "3 as task")
    assert check(pk.packed(df, window=window).collect(), {i: ids_of(t) for i, t in enumerate(texts)}, window) < 0.12


def test_words_one_by_one_give_the_ids_of_the_whole_text():
    rng = random.Random(3)
    bits = ["a", "B", "é", "é", "́", "ß", "İ", "Σ", "ς", "ΑΣ", "'s", "'", "12", "!?", " ", " ", "\x1c", "\x85",
            "日本", "😀", "<|endoftext|>", "가", "가", "‍", "ﬁ", "|>", "<|", "\x00", "ͅ"]
    gaps = ["", "", "", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c"]
    for _ in range(400):
        text = "".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randint(0, 30)))
        got = np.frombuffer(pk.encode_all([text.encode()], pk.default_tokenizer())[0], "<u4").tolist()
        assert got == TOKENIZER.encode(text, add_special_tokens=False).ids, repr(text)


def test_combinations_and_least_squares():
    assert sorted(pk.combinations(4)) == [(2, 1, 1), (2, 2), (3, 1), (4,)]
    rng = np.random.default_rng(1)
    for _ in range(20):
        a = rng.random((6, 15))
        truth = np.maximum(rng.normal(size=15), 0)
        x = pk.least_squares(a, a @ truth)
        assert (x >= 0).all() and np.abs(a @ x - a @ truth).max() < 1e-6
    b = rng.normal(size=6)
    x = pk.least_squares(a, b)
    slope = a.T @ (b - a @ x)
    assert (slope < 1e-6).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-6


def test_repeats_never_need_more_than_there_is():
    rng = np.random.default_rng(2)
    for histogram in (rng.integers(0, 50, 32), np.eye(32, dtype=int)[20] * 1000, np.zeros(32, int), rng.integers(0, 2, 32)):
        used = np.zeros(32, int)
        for name, n in pk.repeats(histogram):
            assert sum(name) == 32 and len(name) <= 3
            for length in name:
                used[length - 1] += n
        assert (used <= histogram).all()


def test_empty_table(spark):
    assert pk.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_remembered_words_take_bounded_memory(monkeypatch):
    """Ids stay right when the memory of words starts anew, and new words take no Python objects that stay."""
    monkeypatch.setattr(pk, "CACHE_WORDS", 2000)
    monkeypatch.setattr(pk, "CACHE_PARTS", 500)
    rng = random.Random(7)
    encoder = pk.Encoder(pk.default_tokenizer())
    texts = [" ".join("".join(rng.choice("abcdeé,!") for _ in range(rng.randint(1, 6))) for _ in range(400)) for _ in range(40)]
    texts += ["", " \n"] + texts[:3]
    for text in texts:
        got = np.frombuffer(encoder.encode_all([text.encode()])[0], "<u4").tolist()
        assert got == TOKENIZER.encode(text, add_special_tokens=False).ids
        assert len(encoder.first) == len(encoder.n) <= 2000 + 400 and len(encoder.parts) <= 500 + 400
    together = encoder.encode_all([text.encode() for text in texts])
    assert together == [pk.array("I", TOKENIZER.encode(text, add_special_tokens=False).ids).tobytes() for text in texts]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import tessera.llm.common as common

    real = common._hash_block
    monkeypatch.setattr(common, "_hash_block", lambda d, s, e, second=False: real(d, s, e, second) if second else np.zeros(len(s), np.uint64))
    encoder = pk.Encoder(pk.default_tokenizer())
    for text in ("one two one", "three", "one"):
        got = np.frombuffer(encoder.encode_all([text.encode()])[0], "<u4").tolist()
        assert got == TOKENIZER.encode(text, add_special_tokens=False).ids
