import hashlib
import random

import numpy as np
import pytest

from tessera.llm import substring_dedup as sd
from tessera.llm.common import NO_ID
from tests.oracle import compare, connect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, window):
    """rows of (doc_id, text) -> (doc_id, n_words, n_removed, sha) per row."""
    split = [(NO_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for key, words in split:
        for at in range(len(words) - window + 1):
            w = tuple(words[at : at + window])
            least[w] = min(least.get(w, NO_ID), key)
    out = []
    for (i, _), (key, words) in zip(rows, split):
        gone = set()
        for at in range(len(words) - window + 1):
            if least[tuple(words[at : at + window])] < key:
                gone.update(range(at, at + window))
        left = b" ".join(w for at, w in enumerate(words) if at not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(left).hexdigest()))
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "ß x"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                part = rng.choice(passages)
                low = rng.randint(0, len(part) // 2)
                words += part[low:]
            else:
                words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice([i, i, i, 3]), rng.choice([" ", "\n", "\t ", "  "]).join(words)))
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1001, rows[5][1]), (None, rows[5][1]), (None, None)]
    rows += [(7, None), (8, ""), (9, " \n "), (1002, "x " * 300), (1003, "x " * 200), (1004, "a b " * 100)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(5)
    got = sd.remove_repeats(docs, window=20, kmer=10).select("doc_id", "n_words", "n_removed", "kept_sha256")
    want = brute(rows, 20)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[2] for r in want) > 100


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sd.op2_substring_dedup(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 50))


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), sf, sd.op2_substring_dedup, sd.SQL["op2_substring_dedup"]) is None


def test_kept_text_keeps_spacing_and_extra_columns(spark):
    same = " ".join(f"v{i}" for i in range(25))
    rows = [(1, same, "k1", 5, 1), (2, f"a\nb  {same}\n\nc  d", "k2", 6, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string, t long, n_words long")
    out = {r.doc_id: r for r in sd.remove_repeats(docs, window=20, kmer=10).collect()}
    assert out[2].kept_text == "a\nb  c  d" and out[2].k == "k2" and out[2].t == 6 and out[2].n_words == 29
    assert out[1].kept_text == same


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert sd.remove_repeats(docs).count() == 0
    assert sd.stage(spark, docs, "").columns == docs.columns


def test_smallest_in_windows():
    values = np.random.default_rng(1).integers(0, 9, 300)
    for width in (1, 2, 3, 7, 26):
        got = sd.smallest_in_windows(values, width)
        assert [int(x) for x in got] == [i + int(np.argmin(values[i : i + width])) for i in range(300 - width + 1)]
