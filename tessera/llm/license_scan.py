"""License scans by diagonal voting.

1. Every whole text is scanned once; all its rolling k-grams of words are hashed twice
   (numpy over Arrow batches).
2. The k-grams are joined by Spark to the positions of the templates' k-grams.  A hit
   counts only if both hashes agree, which stands for equal words.
3. Hits are summed per (document, template, diagonal), the diagonal being the place in
   the text minus the place in the template.  A few words more or less move the rest of
   a notice to a neighbouring diagonal, so each diagonal is merged with those at most
   ``SLACK`` away.
4. A merged span is verified: at least ``SHARE`` of the template's words must lie in
   k-grams that are found there.  Phrases are templates that must be found whole, on one
   diagonal.

Templates are declared, so their positions are a small table of known size; it is
broadcast up to ``BROADCAST`` positions and joined by shuffling beyond.  Nothing is
gathered per template: a notice that a third of all documents carry costs each of
them its own few rows.

Defined results: a null or empty text has no words and one row; each row is a document,
so repeated rows get a row each; a null doc_id stays null; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Sequences, Words, row_blocks, signed, small_batches, staged, table, text_buffer

GRAM = 3
SLACK = 3
SHARE = 0.8
BROADCAST = 200_000
#: Hash and template number under which each text's number of words is handed on.
LENGTH = -1

#: Phrases and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Wording of well-known licence notices and their labels.
NOTICES = (
    ("apache-2", "licensed under the apache license version 2.0"),
    ("apache-2", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by-nc 4.0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v. 2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Letters, digits and all characters beyond ASCII.
TERMS = np.zeros(256, np.uint8)
TERMS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def grams(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: number of words of each, number of k-grams of each, and both hashes of all k-grams."""
    words = Words(LOWER[data], offsets, TERMS)
    n = np.diff(words.first)
    owner = words.text_of()
    at = np.arange(max(0, len(owner) - k + 1))
    at = at[owner[at] == owner[at + k - 1]] if len(at) else at
    pair = [signed(Sequences(words.hashes, second).between(at, at + k)) for second in (False, True)]
    return n, np.maximum(n - k + 1, 0), *pair


def template_positions(spark: SparkSession, texts: Sequence[str], k: int = GRAM) -> tuple[DataFrame, list[int]]:
    """``template, at, a, b`` of all k-grams of the texts, and the texts' numbers of words."""
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    n, each, a, b = grams(data, offsets, k)
    if (n < k).any():
        raise ValueError(f"a template has at least {k} words")
    rows, low = [(-1, 0, LENGTH, 0)], 0
    for i, count in enumerate(each):
        rows += [(i, j, int(a[low + j]), int(b[low + j])) for j in range(count)]
        low += count
    return spark.createDataFrame(rows, "template int, at int, a long, b long"), n.tolist()


def rolling_grams(docs: DataFrame, k: int = GRAM) -> DataFrame:
    """``d, doc_id, pos, a, b``: all k-grams of every text, and one row at -1 with its number of words as ``b``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for low, high in row_blocks(offsets):
                part = data[offsets[low] : offsets[high]]
                n, each, a, b = grams(part, offsets[low : high + 1] - offsets[low], k)
                ends = np.concatenate(([0], np.cumsum(each)))
                first = [np.insert(x, ends[:-1], y) for x, y in ((a, LENGTH), (b, n))]
                rows = pa.StructArray.from_arrays([pa.array(x) for x in first], ["a", "b"])
                at = pa.array(ends + np.arange(len(ends)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("d")[low:high], batch.column("doc_id")[low:high], pa.ListArray.from_arrays(at, rows)],
                    ["d", "doc_id", "grams"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("d"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(scan, "d long, doc_id long, grams array<struct<a:long,b:long>>")
    found = found.select("d", "doc_id", F.posexplode("grams").alias("pos", "gram"))
    return found.select("d", "doc_id", (F.col("pos") - 1).alias("pos"), "gram.a", "gram.b")


def hits(docs: DataFrame, texts: Sequence[str], k: int = GRAM) -> tuple[DataFrame, list[int]]:
    """``d, doc_id, template, diagonal, at``: all equal k-grams; template -1 has each text's number of words as ``at``."""
    positions, sizes = template_positions(docs.sparkSession, texts, k)
    known = positions.withColumnRenamed("b", "tb")
    known = F.broadcast(known) if sum(sizes) <= BROADCAST else known
    met = rolling_grams(docs, k).join(known, "a").where("(template = -1 and pos = -1) or (template >= 0 and pos >= 0 and b = tb)")
    at = F.when(F.col("template") < 0, F.col("b")).otherwise(F.col("at")).alias("at")
    return staged(met.select("d", "doc_id", "template", (F.col("pos") - F.col("at")).alias("diagonal"), at), "hits"), sizes


def whole_places(found: DataFrame, sizes: DataFrame, k: int = GRAM) -> DataFrame:
    """``d, template, diagonal`` of the places where all of a template stands."""
    votes = found.groupBy("d", "template", "diagonal").agg(F.count("*").alias("votes")).join(F.broadcast(sizes), "template")
    return votes.where(F.col("votes") == F.col("n") - (k - 1)).select("d", "template", "diagonal")


def verified_spans(found: DataFrame, sizes: DataFrame, k: int = GRAM, slack: int = SLACK) -> DataFrame:
    """``d, template, diagonal, low, high, covered``: merged diagonals, and the share of the template found on them."""
    votes = found.groupBy("d", "template", "diagonal").agg(F.collect_set("at").alias("at"))
    near = Window.partitionBy("d", "template").orderBy("diagonal").rangeBetween(-slack, slack)
    places = F.struct(F.col("diagonal").alias("g"), "at")
    merged = votes.withColumn("near", F.collect_list(places).over(near))
    starts = F.flatten(F.transform("near", lambda x: F.transform(x["at"], lambda t: x["g"] + t)))
    words = F.array_distinct(F.flatten(F.transform(F.flatten("near.at"), lambda t: F.sequence(t, t + (k - 1)))))
    merged = merged.join(F.broadcast(sizes), "template")
    return merged.select(
        "d", "template", "diagonal", F.array_min(starts).alias("low"), (F.array_max(starts) + k).alias("high"),
        (F.size(words) / F.col("n")).alias("covered"),
    )


def license_scan(
    docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, share: float = SHARE
) -> tuple[DataFrame, DataFrame]:
    """One row per document with its labels; and the verified spans ``d, template, diagonal, low, high, covered, label``."""
    spark, both = docs.sparkSession, [*phrases, *notices]
    found, sizes = hits(docs, [text for _, text in both])
    kinds = spark.createDataFrame(
        [(i, int(n), label) for i, (n, (label, _)) in enumerate(zip(sizes, both))], "template int, n int, label string"
    )
    phrase = F.col("template") < len(phrases)
    places = whole_places(found.where(phrase & (F.col("template") >= 0)), kinds)
    base = places.join(F.broadcast(kinds), "template").groupBy("d").agg(
        F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"),
        F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("base"),
    )
    spans = staged(verified_spans(found.where(~phrase), kinds).join(F.broadcast(kinds), "template").drop("n"), "spans")
    judged = spans.groupBy("d").agg(
        F.max("covered").alias("score"), F.collect_set(F.when(F.col("covered") >= share, F.col("label"))).alias("more")
    )
    texts = found.where("template = -1").select("d", "doc_id", F.col("at").alias("n_words"))
    out = texts.join(base, "d", "left").join(judged, "d", "left")
    none = F.array().cast("array<string>")
    own, more = F.coalesce("base", none), F.coalesce("more", none)
    out = out.select(
        "d", "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word", "last_word", F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, more)), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    return out, spans.where(F.col("covered") >= share)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))[0].drop("d")


QUERIES = {"op11_license_scan": op11_license_scan}


def _words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_TEMPLATES = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate((*PHRASES, *NOTICES)))
SQL = {
    "op11_license_scan": f"""
WITH doc AS (SELECT row_number() OVER () AS d, doc_id, {_words('text')} AS w FROM documents),
template AS (SELECT t, label, t < {len(PHRASES)} AS phrase, {_words('text')} AS w FROM (VALUES {_TEMPLATES}) AS v(t, label, text)),
gram AS (SELECT d, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT d, w, unnest(generate_series(1, len(w) - 2)) AS i FROM doc WHERE len(w) > 2)),
known AS (SELECT t, label, phrase, len(w) AS n, i - 1 AS spot, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT *, unnest(generate_series(1, len(w) - 2)) AS i FROM template)),
hit AS (SELECT d, t, label, phrase, n, spot, pos - spot AS diagonal FROM gram JOIN known USING (g)),
place AS (SELECT d, label, diagonal FROM hit WHERE phrase GROUP BY d, t, label, diagonal, n HAVING count(*) = n - 2),
base AS (SELECT d, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word FROM place GROUP BY d),
share AS (
  SELECT a.d, a.label, count(DISTINCT b.spot + o) / any_value(a.n) AS covered
  FROM (SELECT DISTINCT d, t, label, n, diagonal FROM hit WHERE NOT phrase) a
  JOIN hit b ON a.d = b.d AND a.t = b.t AND b.diagonal BETWEEN a.diagonal - {SLACK} AND a.diagonal + {SLACK}, range(3) AS r(o)
  GROUP BY a.d, a.t, a.label, a.diagonal),
best AS (SELECT d, max(covered) AS score FROM share GROUP BY d),
own AS (SELECT d, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY d),
named AS (SELECT d, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT d, label FROM place UNION SELECT d, label FROM share WHERE covered >= {SHARE}) GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0::DOUBLE) AS score
FROM doc LEFT JOIN base USING (d) LEFT JOIN own USING (d) LEFT JOIN named USING (d) LEFT JOIN best USING (d)"""
}
