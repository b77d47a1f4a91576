import random
import re
from collections import Counter, defaultdict

from tessera.llm import line_rules as lr
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs, share):
    docs_with, docs = defaultdict(set), Counter()
    parsed = []
    for d, (doc, text, host) in enumerate(rows):
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        docs[host] += 1
        names = [" ".join(WORD.findall(lower(x))) for x in lines]
        for name in names:
            docs_with[host, name].add(d)
        parsed.append((lines, names))
    out = []
    for (doc, text, host), (lines, names) in zip(rows, parsed):
        w = WORD.findall(text or "")
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count = Counter(windows)
        covered = {i + j for i, x in enumerate(windows) if count[x] > 1 for j in range(5)}
        gone = [x for x in names if len(docs_with[host, x]) > min_docs and len(docs_with[host, x]) > share * docs[host]]
        removed = sum(len(x.split(" ")) for x in gone)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        kept = not failed and len(w) - removed >= 10 and removed <= 0.5 * len(w)
        out.append((
            doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered), removed, len(gone), failed, kept,
        ))
    return out


def made(seed):
    rng = random.Random(seed)
    words = ["the", "The", "É", "é", "x#", "*", "&", "a\xa0b", "tail"] + [f"w{i}" for i in range(40)]
    line = lambda n: rng.choice(["", " ", "\t"]) + " ".join(rng.choice(words) for _ in range(n))
    shared = [line(rng.randint(1, 12)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [rng.choice([rng.choice(shared), rng.choice(shared).upper(), line(rng.randint(0, 9)), " ", ""]) for _ in range(rng.randint(0, 9))]
        rows.append((rng.choice([i, 7]), rng.choice(["\n", "\n\n", "\r\n"]).join(parts), rng.choice(["a", "a", "b", None, ""])))
    return rows + [(None, rows[0][1], "a"), (200, None, "a"), (201, None, None), (202, "", ""), (203, "x y " * 9000, "a"), rows[4], rows[4]]


def key(r):
    return tuple((x is None, x) for x in r)


def test_equals_brute_force(spark):
    for seed, min_docs, share in ((1, 5, 0.0), (2, 3, 0.2)):
        rows = made(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
        docs = docs.selectExpr("*", "1 as d", "'h' as host", "2 as n_words", "3 as lines")
        got = lr.line_rules(docs, min_docs, share).select("doc_id", *lr.COUNTS, "n_removed_words", "n_removed_lines", "base_failed", "kept")
        want = brute(rows, min_docs, share)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
        assert sum(r[7] for r in want) > 20


def test_matches_sql(spark):
    assert compare(spark, connect(SF), SF, lr.op7_line_frequency, lr.SQL["op7_line_frequency"]) is None


def test_cleaned_texts(spark):
    body = lambda d: "\n".join(f"{d} " + " ".join(f"{c}{i}" for i in range(8)) for c in "abc")
    rows = [(i, f"Site  Menu\n{body(i)}\nsite menu\n", "h", i) for i in range(5)] + [(9, "Site Menu", "h", 9), (8, None, "h", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long")
    out = sorted(lr.cleaned(docs, min_docs=4, share=0).collect())
    assert [r.doc_id for r in out] == [r.row for r in out] == list(range(5))
    assert all(r.text.startswith(f"{r.doc_id} a0") and not re.search("(?i)menu", r.text) for r in out)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert lr.line_rules(docs).count() == 0 and lr.cleaned(docs).count() == 0
