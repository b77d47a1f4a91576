import random
import re
import string

from tessera.llm import phrase_index as pi
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for at in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[at : at + width]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                found = windows.get(tuple(w[at : at + n]))
                if found is not None:
                    hit.update(range(at, at + n))
                    named |= found
        out.append((doc, len(w), len(hit), ",".join(sorted(str(x) for x in named if x is not None))))
    return out


def digest(spark, rows):
    import hashlib

    return [
        (d, n, h, len(i.split(",")) if i else 0, hashlib.sha256(i.encode()).hexdigest(), h > 0) for d, n, h, i in rows
    ]


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "The", "x1", "É", "é", "żółć", "a'b", "c_d", "zz", "q", "r"] + [f"w{i}" for i in range(9)]
    text = lambda n: rng.choice([" ", "  ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(12)]
    items += [(3, items[0][1]), (20, None), (21, ""), (22, "..."), (None, text(12)), (23, "the the the")]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 15))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(items)[1] or "", text(rng.randint(0, 6))]
        docs.append((rng.choice([i, i, 5]), rng.choice(["", ".", " "]) + " ".join(parts)))
    return docs + [(None, items[2][1]), (None, None), (70, None), (71, ""), (72, "--"), docs[3], docs[3]], items


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs, items = made(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        df = df.selectExpr("*", "1 as d", "'x' as term", "2 as pos", "3 as n_hit")
        bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' as win")
        got = pi.contamination(df, bench)[0].drop("d").collect()
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, got), key=key) == sorted(digest(spark, brute(docs, items)), key=key)


def test_matches_sql(spark):
    for name, sql in pi.SQL.items():
        assert compare(spark, connect(SF), SF, pi.QUERIES[name], sql) is None


def test_vocabulary_of_any_size_gives_the_same(spark, monkeypatch):
    docs, items = made(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = sorted(map(str, pi.contamination(df, bench)[0].drop("d").collect()))
    monkeypatch.setattr(pi, "BROADCAST_TERMS", 0)
    assert sorted(map(str, pi.contamination(df, bench)[0].drop("d").collect())) == small


def test_no_python_in_the_plan(spark):
    plan = pi.op5_benchmark_decontamination(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_proximity(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(40))) for i in range(6)]
    items = [(1, "a b c"), (2, "d"), (3, "h g")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    terms = pi.vocabulary(bench)
    index = pi.build_index(df, terms)
    named, parts = pi.item_windows(bench, terms, 10)
    got = pi.proximity_matches(index, parts, 2).join(named, "win").select("item_id", "d", "pos").collect()
    counts = {c: sum(t.split().count(c) for _, t in docs) for c in "abcdefgh"}
    want = set()
    for item, text in items:
        w = text.split()
        rare = min(w, key=lambda c: (counts[c], w.index(c)))
        for d, (_, t) in enumerate(docs):
            v = t.split()
            for at, c in enumerate(v):
                near = v[max(0, at - 2) : at + 3]
                if c == rare and all(x in near for x in w):
                    want.add((item, d, at + 1))
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 10


def test_empty_tables(spark):
    docs, items = made(1)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert pi.contamination(df.limit(0), bench)[0].count() == 0
    clean = pi.contamination(df, bench.limit(0))[0]
    assert clean.count() == len(docs) and clean.where("contaminated").count() == 0


def test_stage_drops_contaminated_rows(spark):
    docs, items = made(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bad", pi.F.lit(1))
    spark.createDataFrame(items, "item_id long, text string").createOrReplaceTempView("bench_items")
    found = brute(docs, items)
    out = pi.contamination(df, spark.table("bench_items"))[0]
    assert out.where("contaminated").count() == sum(r[2] > 0 for r in found)
    kept = pi.stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() > 150
