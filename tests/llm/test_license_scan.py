import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import license_scan as ls
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string"


def words(text):
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def base(text):
    w, found = words(text), []
    for label, phrase in ls.PHRASES:
        p = words(phrase)
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found}))


def covered(text):
    """Best share of each notice on one diagonal and those near it."""
    w, out = words(text), {}
    for label, notice in ls.NOTICES:
        t = words(notice)
        met = [(i - j, j) for i in range(len(w) - 2) for j in range(len(t) - 2) if w[i : i + 3] == t[j : j + 3]]
        for g in {g for g, _ in met}:
            have = {j + o for h, j in met if abs(h - g) <= ls.SLACK for o in range(3)}
            out[label] = max(out.get(label, 0), len(have) / len(t))
    return out


def scan(spark, texts, **extra):
    df = spark.createDataFrame(list(enumerate(texts)), KIND)
    for name, value in extra.items():
        df = df.withColumn(name, value)
    rows = ls.license_scan(df)[0].drop("d").collect()
    assert len(rows) == len(texts)
    return {r["doc_id"]: tuple(r)[1:] for r in rows}


def check(spark, texts, **extra):
    got = scan(spark, texts, **extra)
    for i, text in enumerate(texts):
        share = covered(text)
        labels = {*(x for x, v in share.items() if v >= ls.SHARE), *filter(None, base(text)[4].split(","))}
        assert got[i] == (*base(text), ",".join(sorted(labels)), max(share.values(), default=0.0)), text
    return got


def test_texts_against_the_definition(spark):
    bsd = next(text for label, text in ls.NOTICES if label == "bsd")
    texts = [
        None, "", "...", "mit", "Released Under The MIT License.", "under the mit\nlicense, under  the MIT-license",
        "Licensed under the Apache License, Version 2.0", "apache license version 20", "CC BY-NC 4.0 cc by nc by nc cc by nc",
        f"some words {bsd} and more", bsd.replace("with or without", "with, without"), bsd.replace("binary forms", "in binary or other forms"),
        " ".join(bsd.split()[:9]), " ".join(reversed(bsd.split())), "UNDER THE MİT LICENSE", "é under the mit license é",
        "cc by nc " * 40, f"{bsd} " * 3, "this work is licensed under the GNU General Public License, version 2.",
    ]
    got = check(spark, texts)
    assert got[0] == got[1] == (0, 0, None, None, "", "", 0.0)
    assert got[10][5] == got[11][5] == "bsd" and got[12][5] == got[13][5] == ""
    assert got[18][5] == "gpl"


def test_spans_hold_the_notice(spark):
    isc = next(text for label, text in ls.NOTICES if label == "isc")
    df = spark.createDataFrame([(1, f"one two three {isc.replace('copy', 'copy, again and')} four")], KIND)
    best = ls.license_scan(df)[1].orderBy(F.desc("covered")).first()
    assert (best["label"], best["low"], best["high"]) == ("isc", 3, 3 + len(words(isc)) + 2)


def test_repeats_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([(7, "under the mit license"), (7, "under the mit license"), (None, "x cc by nc")], KIND)
    df = df.withColumns({c: F.lit("clash") for c in ("d", "pos", "a", "b", "template", "label", "diagonal", "at")})
    got = sorted((tuple(r) for r in ls.license_scan(df)[0].drop("d").collect()), key=str)
    one = (7, 4, 1, 0, 0, "mit", "mit", 0.8)
    assert got == sorted([one, one, (None, 4, 1, 1, 1, "cc-by-nc", "cc-by-nc", 3 / 7)], key=str)
    assert ls.license_scan(df.limit(0))[0].count() == 0


def test_very_long_text(spark):
    long = "word " * 400_000 + "released under the mit license " + "other " * 400_000
    got = scan(spark, [long, "x" * 3_000_000])
    assert got[0][:5] == (800_005, 1, 400_001, 400_001, "mit") and got[0][6] == 1.0
    assert got[1] == (1, 0, None, None, "", "", 0.0)


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError):
        ls.template_positions(spark, ["two words"])


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ls, "BROADCAST", 0)
    check(spark, ["released under the mit license", "nothing", None])


def test_matches_duckdb(spark):
    name = "op11_license_scan"
    assert compare(spark, connect(SF), SF, ls.QUERIES[name], ls.SQL[name]) is None
