import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_trie as ct
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def trie(rows):
    """Every node by its definition."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            order = (turn is not None, turn or 0, hashlib.md5(role.encode()).hexdigest(), hashlib.md5(text.encode()).hexdigest())
            turns.setdefault(conv, []).append((order, (role, text)))
    turns = {c: [t for _, t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    out = set()
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(1 for n in below if all(m[:-1] != n or m == n for m in members if len(m) == len(n) + 1))
        saved = sum((len(members[n]) - 1) * len((n[-1][1] if n else "").split()) for n in below)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(built[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(convs), len(node), parent, len(convs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def run(spark, rows, **extra):
    df = spark.createDataFrame(rows, KIND)
    for name, value in extra.items():
        df = df.withColumn(name, value)
    got = [tuple(r) for r in ct.prefix_trie(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def conversations(rng, n, most, words=3):
    rows = []
    for c in n:
        for t in range(rng.randrange(1, most)):
            rows.append((c, t, rng.choice(["user", "bot"]), " ".join(rng.choice("ab") for _ in range(rng.randrange(words)))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_the_definition(spark, seed):
    rng = random.Random(seed)
    rows = conversations(rng, range(60), 6) + conversations(rng, [1000, 1001, -3, -40], 20)
    copied = [(200 + i, t, r, x) for i in range(9) for c, t, r, x in rows if c == 0]
    rng.shuffle(rows)
    assert run(spark, rows + copied) == trie(rows + copied)


def test_long_conversations_go_on_in_further_blocks(spark, monkeypatch):
    monkeypatch.setattr(ct, "SPAN", 2)
    base = [(t, "user", f"w{t} x") for t in range(75)]
    rows = [(c, *t) for c in (20, 21, 27, 39) for t in base[: 75 - c]] + [(39, 900, "bot", "end")]
    assert run(spark, rows) == trie(rows)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [
        (1, None, None, None), (1, None, "user", "z"), (1, 0, "user", None), (1, 0, "user", None), (1, 0, None, "two words"),
        (None, 0, "user", "of nobody"), (2, None, "", ""), (2, 5, "user", "z"), (3, 0, "a", "\tx\n"),
    ]
    assert run(spark, rows, conv=F.lit(7), n=F.lit("n"), depth=F.lit(None).cast("int"), block=F.lit(1), pos=F.lit(2)) == trie(rows)


def test_conversations_without_turns_end_at_the_root(spark):
    # 22 has h = 2 and no base: its only turns are replaced by nothing.
    lone = next(c for c in range(21, 400) if zlib.crc32(str(c).encode()) % 4 == 2)
    rows = [(lone, 0, "user", "a b"), (lone, 1, "bot", "c")]
    assert run(spark, rows) == trie(rows) == {(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())}
    rows += [(0, 0, "user", "hello there")]
    assert run(spark, rows) == trie(rows)


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_very_long_text(spark):
    rows = [(0, t, "user", "word " * 300_000) for t in range(4)] + [(1, 0, "user", "word " * 300_000)]
    assert run(spark, rows) == trie(rows)


def test_chunks_of_ids_are_hashed_in_order(spark):
    ids = [*range(-9000, -8990), *range(4090, 4100), 10**12, 2]
    rows = [(c, t, "user", "same") for c in ids for t in range(4)]
    assert run(spark, rows) == trie(rows)


def test_matches_duckdb(spark):
    name = "op13_conversation_trie"
    assert compare(spark, connect(SF), SF, ct.QUERIES[name], ct.SQL[name]) is None
