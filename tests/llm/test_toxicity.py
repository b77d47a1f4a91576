import random
import zlib

import numpy as np

from tessera.llm import toxicity as tx
from tessera.llm.common import LETTERS, Words

SF = "/root/testdata/sf0.1"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_pairs_are_learned_beyond_their_parts(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1600):
        words = [rng.choice("abcdefghij") * 3 for _ in range(20)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["fool"] * insult + ["those"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = tx.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    test = [r for r in out if r.held_out]
    assert {r.doc_id for r in test} == {i for i, _ in rows if held(i)}
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.97


def test_pairs_without_effect_of_their_parts(spark):
    """Toxic is exactly one of two words: each by itself says nothing, nor does any sum of weights."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(4000):
        one, other = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(20)] + ["left"] * one + ["right"] * other
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(one != other)))
    out = tx.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth = dict(labels)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out.collect() if r.held_out]) > 0.95


def test_rare_pairs_of_common_words(spark):
    """An insult with the mention of a group, in one row of twenty; both words are in a third of all rows."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(6000):
        kind = rng.random()
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(20)]
        words += ["fool", "those"] if kind < 0.05 else ["fool"] if kind < 0.35 else ["those"] if kind < 0.65 else []
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind < 0.05)))
    out = tx.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth = dict(labels)
    test = [r for r in out.collect() if r.held_out]
    assert np.mean([r.predicted for r in test if truth[r.doc_id]]) > 0.95
    assert np.mean([r.predicted for r in test if not truth[r.doc_id]]) < 0.01


def test_every_term_above_a_row_count_is_in_the_model(spark):
    rng = random.Random(4)
    rows = [(i, "every " + " ".join("".join(rng.choices("abcdefghijklmnop", k=2)) + "zz" for _ in range(30))) for i in range(900)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, label int")
    model = tx.fitted(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert len(model.buckets) > 250 and np.isfinite(model.table).all()


def test_held_out_rows_of_the_given_tables(spark):
    out = {r.doc_id: r for r in tx.op9_toxicity(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    test = [(r.toxic, out[r.doc_id].score) for r in labels if held(r.doc_id)]
    toxic, clean = [s for t, s in test if t], [s for t, s in test if not t]
    assert np.mean(np.array(toxic) >= 0.3) > 0.8 and np.mean(np.array(clean) >= 0.3) < 0.02
    assert len(out) == 10_000 and all(0 <= r.score <= 1 for r in out.values())


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    flipped = labels.withColumn("toxic", tx.F.when(tx.fold() == 2, 1 - tx.F.col("toxic")).otherwise(tx.F.col("toxic")))
    one = sorted(map(tuple, tx.toxicity(docs, labels).collect()))
    assert one == sorted(map(tuple, tx.toxicity(docs, flipped).collect()))


def test_terms_are_sets_of_words_and_prefixes():
    raw = "Stupid STUPID stupidity, Élan élan 12 a".encode()
    data = np.frombuffer(raw, np.uint8)
    text, bucket = tx.terms(data, np.array([0, len(raw)]))
    name = lambda s: int(Words(np.frombuffer(s.encode(), np.uint8), np.array([0, len(s.encode())]), LETTERS).hashes[0])
    words = {name(w) % tx.BUCKETS for w in ("stupid", "stupidity", "élan", "a")}
    assert set(bucket) == words | {(name("stupi") + 1) % tx.BUCKETS} and not text.any()


def test_logits_equal_the_sum_over_pairs():
    model = tx.Machine(np.arange(30), factors=3)
    model.table[:] = np.random.default_rng(2).normal(size=model.table.shape)
    model.bias = 0.5
    rows = [np.array([1, 4, 9, 20]), np.array([], int), np.array([7])]
    got = model.logits(np.repeat(np.arange(3), [4, 0, 1]), np.concatenate(rows), 3)
    for r, x in zip(rows, got):
        pairs = sum(model.table[i, 1:] @ model.table[j, 1:] for k, i in enumerate(r) for j in r[k + 1 :])
        assert abs(0.5 + model.table[r, 0].sum() + pairs - x) < 1e-4


def test_nulls_empty_texts_and_missing_labels(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x " * 20000), (3, "x " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as label", "2 as score")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = tx.toxicity(docs, none).collect()
    assert len(out) == 5 and all(r.score < 1e-6 and r.predicted == 0 for r in out)
    assert not [r for r in out if r.doc_id is None][0].held_out
    odd = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    assert tx.toxicity(docs, odd).count() == 5
    assert tx.toxicity(docs.limit(0), odd).count() == 0
