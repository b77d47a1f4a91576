import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fp_ranking as fp
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def ranking(docs, items, top=20):
    """Every document scored for every item by the formula."""
    each = [(i, Counter(terms(text))) for i, text in docs]
    each = [(i, c) for i, c in each if c]
    n_docs, length = len(each), sum(sum(c.values()) for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in each:
            m, score = 75 + 25 * sum(c.values()) * n_docs // length, 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -score) for r, (score, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def run(spark, docs, items, top=20, **extra):
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for name, value in extra.items():
        d, i = d.withColumn(name, value), i.withColumn(name, value)
    got = sorted((tuple(r) for r in fp.ranked(d, i, top).collect()), key=str)
    assert got == ranking(docs, items, top)
    return got


def prose(rng, n, words):
    return " ".join(f"w{min(int(rng.expovariate(0.12)), 60)}" for _ in range(rng.randrange(n, words)))


@pytest.mark.parametrize("leaf, block", [(1, 50), (4, 400), (24, 8192)])
def test_every_rank_against_the_formula(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(fp.Trie.__init__, "__defaults__", (leaf,))
    monkeypatch.setattr(fp, "BLOCK_DOCS", block)
    rng = random.Random(leaf)
    docs = [(i, prose(rng, 0, 60)) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)] + [(2000 + i, docs[5][1] + " x") for i in range(5)]
    run(spark, docs, [(i, prose(rng, 1, 12)) for i in range(25)] + [(90, docs[3][1]), (91, "w1 w1 w1 w59"), (92, "unknown")])


def test_branches_are_left_out(spark):
    """The search meets few nodes where one document fits far better than all others."""
    rng = np.random.default_rng(5)
    owner = np.repeat(np.arange(4000), 20)
    ranks = np.concatenate([np.sort(rng.choice(500, 20, replace=False)) for _ in range(4000)])
    tfs, m = rng.integers(1, 4, len(ranks)), np.full(4000, 100)
    trie = fp.Trie(500, owner, ranks, tfs, m)
    mine = ranks[owner == 1234]
    column = np.full(500, -1)
    column[mine] = np.arange(len(mine))
    docs, scores = trie.best(column, np.full(len(mine), 1000), 1, np.arange(4000))
    assert docs.tolist() == [1234]
    assert trie.visited < len(trie.low) / 3


def test_nulls_ties_repeats_and_clashing_names(spark):
    docs = [(None, "alpha beta"), (5, "alpha beta"), (5, "alpha beta"), (2, "Alpha, BETA"), (9, None), (8, ""), (7, "--"), (6, "ÉTÉ alpha")]
    items = [(1, "alpha"), (1, "alpha"), (1, "beta beta"), (None, "ÉTÉ"), (4, None), (5, ""), (6, "nowhere")]
    clash = {c: F.lit("x") for c in ("doc", "item", "n", "terms", "tfs", "score", "rank")}
    got = run(spark, docs, items, **clash)
    assert [r[2] for r in got if r[0] == 1 and r[1] == 1] == [2, 2]
    run(spark, docs, items, top=2)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "alpha")]) == [] and run(spark, [(1, "alpha")], []) == []
    assert run(spark, [(1, None)], [(1, "alpha")]) == []


def test_very_long_text(spark):
    docs = [(1, "alpha " * 400_000), (2, "alpha beta"), (3, "x" * 2_000_000 + " beta")] + [(10 + i, "gamma") for i in range(20)]
    run(spark, docs, [(1, "alpha beta"), (2, "beta " * 100_000)])


def test_items_in_several_groups(spark, monkeypatch):
    rng = random.Random(3)
    docs, items = [(i, prose(rng, 1, 40)) for i in range(80)], [(i, prose(rng, 1, 9)) for i in range(20)]
    groups = list(fp.item_groups(spark.createDataFrame(items, ITEMS), 25))
    assert len(groups) > 2 and sum(len(g.ids) for g in groups) == 20
    monkeypatch.setattr(fp.item_groups, "__defaults__", (25,))
    run(spark, docs, items)


def test_matches_duckdb(spark):
    name = "op12_fp_ranking"
    assert compare(spark, connect(SF), SF, fp.QUERIES[name], fp.SQL[name]) is None
