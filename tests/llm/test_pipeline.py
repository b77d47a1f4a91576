from collections import Counter

import corpus_pipeline
from tests.llm.test_dart_minhash import classes
from tests.llm.test_packing import check, ids_of
from tests.llm.test_phrase_index import brute as contaminated
from tests.llm.test_substring_dedup import brute as repeats

SF = "/root/testdata/sf0.001"


def read(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_spans", "decontamination", "packing"]

    good = stages["quality"](spark, docs, SF)
    before, after = read(docs), read(good)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert good.columns == columns and all(before[i] == t for i, t in after.items())
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in after for i in clean) > 0.9 * len(clean)
    assert sum(i in after for i, q in labels.items() if q == 0) < 0.5 * sum(q == 0 for q in labels.values())

    single = stages["near_duplicates"](spark, good, SF)
    rows = sorted(after.items())
    first = {c: i for (i, _), c in reversed(list(zip(rows, classes(rows))))}
    assert single.columns == columns and read(single) == {i: after[i] for i in first.values()}

    cut = stages["repeated_spans"](spark, single, SF)
    rows = sorted(read(single).items())
    left = read(cut)
    assert cut.columns == columns
    for (i, text), (_, n, removed, _) in zip(rows, repeats(rows, 50)):
        assert (i in left) == (removed < n or removed == 0)
        if i in left:
            assert len(left[i].split()) == n - removed or removed == 0 and left[i] == text
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    pure = stages["decontamination"](spark, cut, SF)
    hit = {i for i, _, n, _ in contaminated(sorted(left.items()), items) if n}
    assert pure.columns == columns and read(pure) == {i: t for i, t in left.items() if i not in hit}

    pieces = stages["packing"](spark, pure, SF).collect()
    assert check(pieces, {i: ids_of(t) for i, t in read(pure).items()}, 2048) < 0.05


def test_run_is_the_stages_in_order(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert corpus_pipeline.ORACLE_SQL is None
    docs = Counter(r.doc_id for r in rows)
    assert 50 < len(docs) < 200 and sum(r.length for r in rows) > 10_000
