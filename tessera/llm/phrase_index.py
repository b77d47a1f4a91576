"""Benchmark decontamination with a distributed positional inverted index.

Everything on this path is DataFrame functions; there is no Python, pandas or
Arrow code.

1. Training texts are tokenised once.  Postings ``(term, d, pos)`` of the terms
   that tests use are written as Parquet, every file being a segment sorted by
   term, document and position, so readers of a few terms skip the rest.  ``d``
   numbers the rows of the input; a text's length is stored as the posting of a
   reserved term.
2. Test items are cut into windows.  Terms of a window are ranked by how many
   postings they have.  Matching starts from the rarest term, whose positions,
   minus the term's offset, are the candidate starts; the list of the second
   rarest term, adjusted by its offset, is intersected next, then all others
   within the documents that are left.
3. Spans of the windows that are wholly there are merged per document.

Scale: the test vocabulary is broadcast only when counted to have at most
``BROADCAST_TERMS`` terms, else it is joined by shuffling.  Postings of a
frequent term stay spread over segments.  Joins on ``(term, d, pos)`` have no hot
keys, as a position holds one term; a passage that many documents share costs
each of them its own rows only.  Which documents are left before the last
intersection is broadcast as at most ``BUCKETS`` hash buckets, which can only let
too many rows through to the exact join.

Defined results: a null text has no words and one row; a null or empty item has
no windows; an item with a null id counts for hits but is not named; repeated
documents get a row each; repeated items with one id count once; columns beyond
those named are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import few, scratch, staged, table
from tessera.llm.spans import merge_spans

ITEM_WORDS = 10
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_TERMS = 200_000
BUCKETS = 1 << 18
#: Term number under which the number of words of a text is stored.
LENGTH = -1


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters unchanged."""
    mapped = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(text.rlike(r"[^\x00-\x7F]"), mapped).otherwise(F.lower(text))


def words_between_gaps(text: Column) -> Column:
    """An empty string, the words of the text, and an empty string again: word i is element i."""
    return F.split(lower_ascii(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))), GAPS)


def words_of(text: Column) -> Column:
    found = words_between_gaps(text)
    return F.slice(found, 2, F.size(found) - 2)


def vocabulary(items: DataFrame) -> DataFrame:
    """Distinct terms of the tests, numbered; the empty term stands for the length of a text."""
    terms = items.select(F.explode(words_of(F.col("text"))).alias("term")).distinct()
    numbered = terms.withColumn("term_id", F.monotonically_increasing_id())
    spark = items.sparkSession
    length = spark.range(1).select(F.lit("").alias("term"), F.lit(LENGTH).cast("long").alias("term_id"))
    return staged(numbered.unionByName(length), "terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings ``term_id, d, pos`` of the given terms (positions from 1), and each text's length with its doc_id."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("d"))
    found = rows.select("doc_id", "d", F.posexplode(words_between_gaps(F.col("text"))).alias("pos", "term"))
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    found = found.where("pos > 0").join(terms, "term")
    postings = found.select(
        "term_id", "d", "pos", F.when(F.col("term_id") == LENGTH, F.col("doc_id")).alias("doc_id")
    )
    return staged(postings.sortWithinPartitions("term_id", "d", "pos"), "postings")


def item_windows(items: DataFrame, terms: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """``win, item_id`` for every window, and ``win, n, off, term_id`` for every distinct window's words."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (width - 1)))
    cut = words.select("item_id", "words", F.explode(starts).alias("at"))
    cut = staged(cut.select("item_id", F.slice("words", F.col("at"), width).alias("words")).distinct(), "item_windows")
    distinct = cut.select("words").distinct().withColumn("win", F.monotonically_increasing_id())
    distinct = staged(distinct, "windows")
    parts = distinct.select("win", F.size("words").alias("n"), F.posexplode("words").alias("off", "term"))
    return cut.join(distinct, "words").select("win", "item_id"), parts.join(terms, "term").drop("term")


def ranked_terms(parts: DataFrame, index: DataFrame) -> DataFrame:
    """Words of each window with ``place`` 1 for the rarest term of the corpus.

    All postings are counted, partly before the shuffle, so a frequent term's list is in no single task.
    """
    counts = index.groupBy("term_id").agg(F.count("*").alias("postings"))
    counted = parts.join(counts, "term_id", "left")
    order = Window.partitionBy("win").orderBy(F.coalesce("postings", F.lit(0)), "off")
    return staged(counted.withColumn("place", F.row_number().over(order)), "ranked")


def phrase_matches(index: DataFrame, parts: DataFrame) -> DataFrame:
    """``win, d, low, high``: every place where all words of a window follow each other."""
    postings = index.where(F.col("term_id") != LENGTH).select("term_id", "d", "pos")
    ranked = ranked_terms(parts, index)
    rarest = ranked.where("place = 1 and postings is not null").select("term_id", "win", "n", "off")
    few = ranked.where("place = 1").count() <= BROADCAST_TERMS
    hint = F.broadcast if few else (lambda df: df)
    rarest = hint(rarest)
    found = postings.join(rarest, "term_id").select("win", "n", "d", (F.col("pos") - F.col("off")).alias("start"))
    found = found.where("start > 0")

    second = ranked.where("place = 2").select("win", "off", "term_id")
    lists = postings.join(hint(second.select("term_id").distinct()), "term_id", "left_semi")
    wanted = found.join(hint(second), "win", "left").withColumn("pos", F.col("start") + F.col("off"))
    single = wanted.where(F.col("term_id").isNull())
    pairs = wanted.where(F.col("term_id").isNotNull()).join(lists, ["term_id", "d", "pos"])
    keep = ["win", "n", "d", "start"]
    found = staged(pairs.select(*keep).unionByName(single.select(*keep)), "pairs")

    rest = ranked.where("place > 2").select("win", "off", "term_id")
    bucket = F.pmod(F.xxhash64("d"), F.lit(BUCKETS))
    near = found.where("n > 2").select(bucket.alias("bucket")).distinct()
    lists = postings.withColumn("bucket", bucket).join(F.broadcast(near), "bucket", "left_semi").drop("bucket")
    wanted = found.where("n > 2").join(rest, "win").withColumn("pos", F.col("start") + F.col("off"))
    whole = wanted.join(lists, ["term_id", "d", "pos"]).groupBy(*keep).agg(F.count("*").alias("met"))
    whole = whole.where("met = n - 2").drop("met").unionByName(found.where("n <= 2"))
    return whole.select("win", "d", F.col("start").alias("low"), (F.col("start") + F.col("n")).alias("high"))


def proximity_matches(index: DataFrame, parts: DataFrame, reach: int) -> DataFrame:
    """``win, d, pos``: places of a window's rarest term with each other word of it at most ``reach`` words away.

    Positions are binned by ``reach + 1`` words, so a neighbour lies in one of three bins; the join
    is on term, document and bin.
    """
    postings = index.where(F.col("term_id") != LENGTH).select("term_id", "d", "pos")
    ranked = ranked_terms(parts, index)
    rarest = ranked.where("place = 1").select("term_id", "win")
    centre = postings.join(rarest, "term_id").select("win", "d", "pos").distinct()
    own = rarest.withColumnRenamed("term_id", "own")
    others = ranked.select("win", "term_id").distinct().join(own, "win").where("term_id <> own").drop("own")
    wanted = others.groupBy("win").agg(F.count("*").alias("n"))
    size = reach + 1
    bins = F.explode(F.array(*(F.floor(F.col("pos") / size) + i for i in (-1, 0, 1))))
    asked = centre.join(others, "win").withColumn("bin", bins)
    lists = postings.select("term_id", "d", F.floor(F.col("pos") / size).alias("bin"), F.col("pos").alias("other"))
    met = asked.join(lists, ["term_id", "d", "bin"]).where(F.abs(F.col("other") - F.col("pos")) <= reach)
    met = met.groupBy("win", "d", "pos").agg(F.count_distinct("term_id").alias("met"))
    full = centre.join(wanted, "win", "left").join(met, ["win", "d", "pos"], "left")
    return full.where("coalesce(n, 0) = coalesce(met, 0)").select("win", "d", "pos")


def contamination(docs: DataFrame, items: DataFrame, width: int = ITEM_WORDS) -> tuple[DataFrame, DataFrame]:
    """One row per document with its hits; and the hit spans ``d, low, high`` (word numbers from 1)."""
    terms = vocabulary(items)
    index = build_index(docs, terms)
    named, parts = item_windows(items, terms, width)
    matches = staged(phrase_matches(index, parts), "matches")
    spans = merge_spans(matches.select("d", "low", "high").distinct(), "d")
    hit = spans.groupBy("d").agg(F.sum(F.col("high") - F.col("low")).alias("n_hit"))
    met = matches.select("d", "win").distinct().join(named, "win").where(F.col("item_id").isNotNull())
    listed = F.sort_array(F.collect_set(F.col("item_id").cast("string")))
    met = met.groupBy("d").agg(listed.alias("items"))
    lengths = index.where(F.col("term_id") == LENGTH).select("d", "doc_id", (F.col("pos") - 1).alias("n_words"))
    out = lengths.join(hit, "d", "left").join(met, "d", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "d", "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    ), spans


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination(docs, items)[0].drop("d")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; rows of one text share its fate."""
    numbered = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    with scratch(spark) as lasting:
        found = contamination(numbered, table(spark, sf_dir, "benchmark"))[0]
        bad = lasting(found.where("contaminated").select(F.col("doc_id").alias("bad")).distinct(), "contaminated")
    bad = few(bad)
    return docs.join(bad, F.xxhash64(docs["doc_id"], docs["text"]) == bad["bad"], "left_anti")


QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op5_benchmark_decontamination": f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_win AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS seq, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS d, doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM item_win),
doc_win AS (
  SELECT d, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS seq
  FROM (SELECT d, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT d, doc_win.n, i, item_id FROM doc_win JOIN item_win USING (seq, n)),
covered AS (SELECT DISTINCT d, unnest(generate_series(i, i + n - 1)) AS pos FROM hit),
counted AS (SELECT d, count(*) AS n_hit FROM covered GROUP BY d),
named AS (SELECT d, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN counted USING (d) LEFT JOIN named USING (d)"""
}
