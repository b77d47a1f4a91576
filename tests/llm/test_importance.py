import math
import random
import re
from collections import Counter

import numpy as np

from tessera.llm import importance as im
from tessera.llm.common import WORDS_AND_SIGNS, Words

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOKEN = re.compile(rb"[!-/:-@\[-`{-~]+|[^\x09-\x0d !-/:-@\[-`{-~]+")


def bag(text):
    """Buckets of the n-grams, each word hashed on its own."""
    tokens = TOKEN.findall((text or "").encode())
    one = []
    for token in tokens:
        data = np.frombuffer(token, np.uint8)
        one.append(Words(data, np.array([0, len(data)]), WORDS_AND_SIGNS).hashes[0])
    two = [im._STEP if a == b else im.mix(np.array([a * im._STEP + b]))[0] for a, b in zip(one, one[1:])]
    return Counter(int(x) % im.BUCKETS for x in one + two)


def test_weights_equal_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "The", "é", "x!!", "a-b", "***", "z" * 50, "1,2", "|"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(80)]
    rows += [(80, None), (81, ""), (None, "the *** the"), (3, "a second text"), rows[4], (82, "x " * 30000)]
    labels = [(i, rng.choice([0, 1, 1, None])) for i in range(0, 80, 2)] + [(4, 0), (4, 1), (999, 1), (None, 1)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    df = df.selectExpr("*", "1 as k", "2 as label", "3 as score")
    got = im.resampled(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    half = spark.range(100).where(im.F.pmod(im.F.xxhash64("id", im.F.lit(im.SEED)), im.F.lit(2)) == 0)
    half = {r.id for r in half.collect()}
    good = {i for i, q in labels if q == 1 and i in half}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw += bag(t)
        if i in good:
            target += bag(t)
    scale = sum(target.values()) / sum(raw.values())
    ratio = {x: math.log((target[x] + im.SMOOTHING) / (raw[x] * scale + im.SMOOTHING)) for x in raw}
    want = [(i, sum(n * ratio[x] for x, n in bag(t).items())) for i, t in rows]
    got = sorted(((r.doc_id, r.log_weight) for r in got.collect()), key=lambda x: (x[0] is None, x))
    want.sort(key=lambda x: (x[0] is None, x))
    assert [x[0] for x in got] == [x[0] for x in want]
    assert np.allclose([x[1] for x in got], [x[1] for x in want], atol=1e-6)


def test_separates_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id: r.kept for r in im.resampled(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = [(r.quality, kept[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect()]
    good = [k for q, k in held if q == 1]
    bad = [k for q, k in held if q == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.2


def test_kth_largest(spark):
    rng = random.Random(2)
    for values in ([rng.gauss(0, 1) * 10 ** rng.randint(0, 6) for _ in range(3000)], [1.0] * 50 + [2.0] * 50, [5.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        ranked = sorted(values, reverse=True)
        for k in {1, len(values) // 2 or 1, len(values) - 1 or 1}:
            if k < len(values):
                assert im.kth_largest(df, "x", k, bins=7, few=5) == ranked[k - 1]
        assert im.kth_largest(df, "x", len(values)) == -math.inf


def test_best_threshold():
    assert im.best_threshold(np.array([1.0, 2.0, 3.0, 4.0]), np.array([False, False, True, True])) == 2.5
    assert im.best_threshold(np.array([1.0, 2.0]), np.array([True, True])) == -np.inf
    assert im.best_threshold(np.zeros(0), np.zeros(0, bool)) == -np.inf
    assert im.best_threshold(np.array([1.0, 1.0, 1.0]), np.array([True, False, True])) in (-np.inf, 1.0)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, None, None, None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in im.resampled(docs, none).collect()] == [True, True]
    assert im.resampled(docs.limit(0), none).count() == 0


def test_stage_keeps_rows_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("t", im.F.lit(1))
    kept = im.stage(spark, docs, SF)
    assert kept.columns == docs.columns and 700 < kept.count() < 950
