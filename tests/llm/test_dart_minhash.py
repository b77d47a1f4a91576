import os
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import dart_minhash as dm
from tessera.llm import phrase_index, substring_dedup
from tessera.llm.common import scratch, staged
from tessera.llm.graph import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def bag(text):
    w = text.encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similar(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else float(not a and not b)


def classes(rows, least=0.8):
    """Class id of each row by comparing all pairs."""
    big = 1 << 63
    bags = [None if t is None else bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] is not None and bags[j] is not None and similar(bags[i], bags[j]) >= least:
                parent[root(i)] = root(j)
    ids = [big if i is None else i for i, _ in rows]
    least_id = {}
    for i in range(len(rows)):
        least_id[root(i)] = min(least_id.get(root(i), big), ids[i])
    return [None if least_id[root(i)] == big else least_id[root(i)] for i in range(len(rows))]


def made(seed, groups=12, copies=8):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    out = [(rng.choice([i, i, i, 2]), t) for i, t in enumerate(rows)]
    return out + [(900, rows[0]), (901, rows[0].replace(" ", "\n")), (None, rows[0]), (902, ""), (903, " \n"), (904, None),
                  (905, None), (906, "one"), (907, "one"), (908, "two words"), out[3], (None, "alone " * 9)]


def test_equals_comparing_all_pairs(spark):
    for seed in (1, 2):
        rows = made(seed)
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
        docs = docs.selectExpr("*", "1 as k", "2 as t", "3 as sig")
        got = dm.near_duplicates(docs).select("doc_id", "class_id").collect()
        want = [(i, i if t is None else c) for (i, t), c in zip(rows, classes(rows))]
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_large_groups_in_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(dm, "PAIRS", 4)
    monkeypatch.setattr(dm, "BLOCK_TEXTS", 20)
    rows = made(5, groups=3, copies=80)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r.t: r.class_id for r in dm.near_duplicates(docs).collect()}
    tags = [r.t for r in dm.keyed(docs).select("t").collect()]
    want = {t: (i if x is None else c) for t, (i, x), c in zip(tags, rows, classes(rows))}
    assert not [t for t in want if t != 42 and got[t] != want[t]]


def test_texts_travel_a_few_times_in_groups_of_any_size(spark, monkeypatch):
    """The texts that blocks need grow with the group, not with its square."""
    monkeypatch.setattr(dm, "BLOCK_TEXTS", 25)
    carried = []
    plain = dm.memberships

    def counted(pairs, placed):
        cut, members = plain(pairs, placed)
        carried.append(members.count())
        return cut, members

    monkeypatch.setattr(dm, "memberships", counted)
    each = []
    for n in (150, 300, 600):
        rng = random.Random(n)
        base = [f"w{rng.randrange(900)}" for _ in range(200)]
        rows = []
        for i in range(n):
            words = list(base)
            for _ in range(2):
                words[rng.randrange(200)] = f"x{rng.randrange(90_000)}"
            rows.append((i, " ".join(words), "en", "s", 0))
        carried.clear()
        got = {r.class_id for r in dm.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == {0}
        each.append(sum(carried) / n)
    assert max(each) < 4 and each[2] < 1.5 * each[0]


def test_links_that_pass_by_every_hub_are_found(spark, monkeypatch):
    monkeypatch.setattr(dm, "PAIRS", 2)
    monkeypatch.setattr(dm, "BLOCK_TEXTS", 20)
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(160)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(2, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9000)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.class_id for r in dm.near_duplicates(docs).collect()}
    assert got == {i: c for (i, _), c in zip(rows, classes(rows))}


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = dm.op8_dart_minhash(spark, SF).orderBy("doc_id").collect()
    want = classes(rows)
    assert [(r.doc_id, r.class_id, r.kept) for r in got] == [(i, c, i == c) for (i, _), c in zip(rows, want)]


def test_agreement_follows_weighted_similarity():
    rng = np.random.default_rng(3)
    agree, true = [], []
    for overlap in (0.2, 0.5, 0.8, 0.95):
        for scale in (1, 7):
            names = rng.integers(1, 2**62, 300).astype(np.uint64)
            a = rng.integers(1, 4, 300) * float(scale)
            b = np.where(rng.random(300) < overlap, a, rng.integers(1, 4, 300) * 0.5 * scale)
            text = np.repeat([0, 1], 300)
            sig = dm.signatures(text, np.concatenate((names, names)), np.concatenate((a, b)), 2)
            agree.append((sig[0] == sig[1]).mean())
            true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert np.abs(np.array(agree) - np.array(true)).max() < 4 * np.sqrt(0.25 / dm.COORDINATES)
    assert abs(np.mean(agree) - np.mean(true)) < 0.05


def test_every_coordinate_is_filled_for_small_and_large_texts():
    text = np.concatenate(([0], np.ones(5000, int)))
    names = np.random.default_rng(1).integers(1, 2**62, 5001).astype(np.uint64)
    sig = dm.signatures(text, names, np.ones(5001), 3)
    assert (sig[:2] != 0).all() and (sig[2] == 0).all()


def test_stage_keeps_one_of_each_class(spark):
    rows = [(i, t) for i, (_, t) in enumerate(made(4))]
    rows += [rows[0], rows[0], rows[1]]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).selectExpr("*", "1 as k", "'x' as first")
    kept = dm.stage(spark, docs, "").collect()
    with_class = [(i, t, i if t is None else c) for (i, t), c in zip(rows, classes(rows))]
    worded = {c for _, t, c in with_class if t is not None}
    assert len([r for r in kept if r.text is not None]) == len(worded)
    assert kept and kept[0].k == 1 and len({(r.doc_id, r.text) for r in kept}) == len(kept)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert dm.near_duplicates(docs).count() == 0 and dm.stage(spark, docs, "").count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(9, 9)]
    rng.shuffle(edges)
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges] + [(130, 2)]
    out = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 2 for i in range(100, 161)) and all(out[i] == 500 for i in range(500, 560))
    assert len(out) == 61 + 1 + 60


def scratch_tables(spark):
    """Names of the tables in the shared folder, by how often they are there."""
    return Counter(x.rsplit("-", 1)[0] for x in os.listdir(spark.conf.get("spark.checkpoint.dir")))


def test_rounds_replace_each_other_and_stars_need_none(spark):
    chain, star = [(i, i + 1) for i in range(40)], [(7, i) for i in range(8, 40)]
    for name, edges in (("of_chain", chain), ("of_star", star)):
        out = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long"), name).collect()}
        assert set(out.values()) == {min(out)} and scratch_tables(spark)[name] == 1


def test_stages_leave_only_what_their_result_reads(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in made(11)], SCHEMA)
    for stage, left in ((dm.stage, {"verdicts", "gone"}), (substring_dedup.stage, {"spans"})):
        before = scratch_tables(spark)
        out = stage(spark, docs, "")
        assert set(scratch_tables(spark) - before) == left and out.count() == len(out.collect()) > 0


def test_decontamination_leaves_only_what_its_result_reads(spark, tmp_path):
    spark.createDataFrame([(1, made(11)[0][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in made(11)], SCHEMA)
    before = scratch_tables(spark)
    out = phrase_index.stage(spark, docs, str(tmp_path))
    assert set(scratch_tables(spark) - before) == {"contaminated"} and 0 < out.count() < docs.count()


def test_scratch_is_deleted_also_on_failure(spark):
    rows = spark.range(3)
    with scratch(spark) as keep:
        with scratch(spark) as lasting:
            staged(rows, "inner")
            outer = lasting(rows, "outer")
        assert scratch_tables(spark)["inner"] == 0 and outer.count() == 3
        kept = keep(outer, "kept")
    assert scratch_tables(spark)["outer"] == 0 and kept.count() == 3
    with pytest.raises(ValueError), scratch(spark):
        staged(rows, "failed")
        raise ValueError
    assert scratch_tables(spark)["failed"] == 0
