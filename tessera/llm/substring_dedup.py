"""Removal of long repeated word spans with a sparse De Bruijn graph.

The corpus is seen as a De Bruijn graph of words.  Its nodes are k-mers of
``kmer`` words; to keep it sparse only minimizers become nodes: of the k-mers
inside each window of ``window`` words the one with the smallest hash.  Windows
that follow each other mostly share their minimizer, so an edge stands for a
*stretch*: the consecutive windows of one node with all words they cover.  Equal
windows have equal minimizers, hence a window that occurs twice passes through a
node that occurs twice.

1. Nodes are grouped; those met in one document only are dropped, as no window
   through them can repeat.
2. A repeated node is *nonbranching* when all its occurrences lie in the same
   stretch.  A join hands every occurrence the smallest document of the path, and
   the whole stretch is settled at once, without looking at its windows.
3. At a *branching* node equal stretches are compacted to the occurrences in the
   smallest document; only these spell out their windows, which are compared by
   two independent 64-bit hashes.
4. Settled stretches carry their source coordinates (document, first word, last
   word); overlapping ones compact to disjoint spans per document, which are cut
   out of the text.

No group is collected: nodes, stretches and windows are aggregated with map-side
combining (a passage in a third of all rows is one row per task), joins back to
them are plain sort-merge joins which the adaptive planner splits where one key
is hot, and what is gathered per document is bounded by its own length.

Defined results: a null text has no words; documents without ``window`` words
keep everything; a null doc_id counts as greater than all others; rows with the
same doc_id never remove from each other; rows with equal doc_id and text give
equal rows; further columns of the input are kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import (
    Sequences,
    Words,
    doc_key,
    give_back,
    row_blocks,
    scratch,
    signed,
    small_batches,
    staged,
    table,
    text_buffer,
)
from tessera.llm.spans import merge_spans

WINDOW = 50
KMER = 25
#: Texts without candidates are told from others by this many buckets of their key, so the set of
#: buckets that is broadcast has at most this many rows at any size of the input.
BUCKETS = 1 << 18


def smallest_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the index of the smallest, the first of equal ones."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, size = np.arange(len(values)), 1
    while size * 2 <= width:
        left, right = best[: len(best) - size], best[size:]
        best = np.where(values[left] <= values[right], left, right)
        size *= 2
    left, right = best[:n], best[width - size : width - size + n]
    return np.where(values[left] <= values[right], left, right)


def stretches_of(words: Words, window: int, kmer: int):
    """Index of text, node, content, first and last window start of every stretch."""
    n = len(words.starts)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty
    one, two = Sequences(words.hashes), Sequences(words.hashes, second=True)
    at = np.arange(n - kmer + 1)
    nodes = one.between(at, at + kmer)
    chosen = smallest_in_windows(nodes, window - kmer + 1)
    text = words.text_of()
    inside = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    if not len(inside):
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty
    picked = chosen[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (inside[1:] != inside[:-1] + 1)
    heads = np.flatnonzero(new)
    first, last = inside[heads], inside[np.append(heads[1:], len(inside)) - 1]
    node = picked[heads]
    content = two.between(first, last + window) ^ ((node - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text[first], nodes[node], content, first, last


def stretches(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, coordinates: bool = True) -> DataFrame:
    """The edges of the graph: ``node``, ``content`` and source coordinates."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            key, tag = batch.column("k").to_numpy(), batch.column("t").to_numpy()
            for low, high in row_blocks(offsets):
                words = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                text, node, content, first, last = stretches_of(words, window, kmer)
                out = {"node": signed(node), "content": signed(content), "k": key[low:high][text]}
                if coordinates:
                    begin = words.first[text]
                    out |= {
                        "t": tag[low:high][text],
                        "first": (first - begin).astype(np.int32),
                        "last": (last - begin).astype(np.int32),
                    }
                yield pa.RecordBatch.from_pydict(out)
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select("text", doc_key().alias("k"), F.xxhash64("text").alias("t"))
    kinds = "node long, content long, k long"
    return rows.mapInArrow(scan, kinds + (", t long, first int, last int" if coordinates else ""))


def repeated_nodes(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Nodes met in two documents or more, with the smallest of these."""
    nodes = stretches(docs, window, kmer, coordinates=False).groupBy("node").agg(
        F.min("k").alias("source"), F.max("k").alias("_last"),
        F.min("content").alias("_one"), F.max("content").alias("_other"),
    )
    met = nodes.where(F.col("source") < F.col("_last"))
    return met.select("node", "source", (F.col("_one") != F.col("_other")).alias("branching"))


def windows_of(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """Windows spelled out: two hashes, document and first word of each window of ``runs``."""
    chosen = runs.groupBy("k", "t").agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            key, tag = batch.column("k").to_numpy(), batch.column("t").to_numpy()
            listed = batch.column("runs")
            sizes = np.diff(listed.offsets.to_numpy())
            pairs = listed.flatten()
            run_first, run_last = pairs.field("first").to_numpy(), pairs.field("last").to_numpy()
            run_at = np.concatenate(([0], np.cumsum(sizes)))
            for low, high in row_blocks(offsets):
                words = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                part = slice(run_at[low], run_at[high])
                text = np.repeat(np.arange(high - low), sizes[low:high])
                count = run_last[part].astype(np.int64) - run_first[part] + 1
                owner = np.repeat(text, count)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                local = np.repeat(run_first[part].astype(np.int64), count) + step
                begin = words.first[owner] + local
                yield pa.RecordBatch.from_pydict({
                    "one": signed(Sequences(words.hashes).between(begin, begin + window)),
                    "two": signed(Sequences(words.hashes, second=True).between(begin, begin + window)),
                    "k": key[low:high][owner],
                    "t": tag[low:high][owner],
                    "first": local.astype(np.int32),
                })

    rows = flagged(docs, chosen).join(chosen, ["k", "t"])
    return rows.select("text", "k", "t", "runs").mapInArrow(spell, "one long, two long, k long, t long, first int")


def buckets_of(keys: DataFrame) -> DataFrame:
    return keys.select(F.pmod(F.xxhash64("k", "t"), F.lit(BUCKETS)).alias("_bucket")).distinct()


def flagged(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose (k, t) may be among ``keys``; the others need not be shuffled to find that out.

    At most ``BUCKETS`` numbers are broadcast.  Some texts pass without being among the keys; the
    join that follows settles them.
    """
    rows = docs.select("text", doc_key().alias("k"), F.xxhash64("text").alias("t"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("k", "t"), F.lit(BUCKETS)))
    return rows.join(F.broadcast(buckets_of(keys)), "_bucket", "left_semi").drop("_bucket")


def repeated_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Word spans ``low`` to ``high`` of text (k, t) whose windows also start in a smaller document."""
    nodes = staged(repeated_nodes(docs, window, kmer), "nodes")
    met = staged(stretches(docs, window, kmer).join(nodes, "node"), "stretches")

    plain = met.where(~F.col("branching") & (F.col("k") > F.col("source")))
    forks = met.where("branching")
    ways = forks.groupBy("node", "content").agg(F.min("k").alias("way_source"))
    forks = forks.join(staged(ways, "ways"), ["node", "content"])
    copies = forks.where(F.col("k") > F.col("way_source"))
    settled = plain.select("k", "t", "first", "last").unionByName(copies.select("k", "t", "first", "last"))
    spans = settled.select("k", "t", F.col("first").alias("low"), (F.col("last") + window).alias("high"))

    firsts = forks.where(F.col("k") == F.col("way_source")).select("k", "t", "first", "last")
    windows = staged(windows_of(docs, staged(firsts, "firsts"), window), "windows")
    sources = windows.groupBy("one", "two").agg(F.min("k").alias("_source"), F.max("k").alias("_last"))
    sources = staged(sources.where(F.col("_source") < F.col("_last")), "sources")
    more = windows.join(sources, ["one", "two"]).where(F.col("k") > F.col("_source"))
    more = more.select("k", "t", F.col("first").alias("low"), (F.col("first") + window).alias("high"))
    return merge_spans(spans.unionByName(more).distinct(), "k", "t")


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text``.

    The kept text keeps the spacing between words that stay.  Columns of the input with one of these
    four names are replaced.  The spans are read more than once, so they should be written already.
    """
    small_batches(docs.sparkSession)
    listed = spans.groupBy("k", "t").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", doc_key().alias("k"), F.xxhash64("text").alias("t"))
    bucket = F.pmod(F.xxhash64("k", "t"), F.lit(BUCKETS))
    marks = F.broadcast(buckets_of(spans).withColumn("_hit", F.lit(True)))
    rows = rows.withColumn("_bucket", bucket).join(marks, "_bucket", "left")
    clean = rows.where(F.col("_hit").isNull()).withColumn("spans", F.lit(None).cast("array<struct<low:int,high:int>>"))
    touched = rows.where(F.col("_hit")).join(listed, ["k", "t"], "left")
    both = clean.select("row", "text", "spans").unionByName(touched.select("row", "text", "spans"))
    kind = both.schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            lists, n = batch.column("spans"), batch.num_rows
            totals, removed = np.zeros(n, np.int64), np.zeros(n, np.int64)
            digests, kept = [], []
            for low, high in row_blocks(offsets):
                part = data[offsets[low] : offsets[high]]
                words = Words(part, offsets[low : high + 1] - offsets[low], hashed=False)
                totals[low:high] = np.diff(words.first)
                for i in range(low, high):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    cuts = lists[i].as_py()
                    if not cuts:
                        kept.append(raw)
                        digests.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                        continue
                    begin = words.first[i - low]
                    starts = words.starts[begin : words.first[i - low + 1]] + (offsets[low] - offsets[i])
                    pieces, done = [], 0
                    for span in sorted((x["low"], x["high"]) for x in cuts):
                        removed[i] += span[1] - span[0]
                        pieces.append(raw[done : starts[span[0]]])
                        done = starts[span[1]] if span[1] < len(starts) else len(raw)
                    pieces.append(raw[done:])
                    text = b"".join(pieces)
                    kept.append(text.rstrip(b" \t\n\v\f\r") if done == len(raw) else text)
                    digests.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"),
                "n_words": pa.array(totals),
                "n_removed": pa.array(removed),
                "kept_sha256": pa.array(digests, pa.string()),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            })

    out = both.mapInArrow(cut, f"row {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    found = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in found), *found)


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Rows of ``docs`` with the repeated spans found, counted and cut out."""
    with scratch(docs.sparkSession) as lasting:
        spans = lasting(repeated_spans(docs, window, kmer), "spans")
    return cut_spans(docs, spans)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated spans; those of which nothing is left go."""
    out = remove_repeats(docs.select(F.col("text"), F.col("doc_id"), F.struct(*docs.columns).alias("whole")))
    out = out.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_removed") == 0))
    cut = F.col("n_removed") > 0
    new = {
        "text": F.when(cut, F.col("kept_text")).otherwise(F.col("whole.text")),
        "n_chars": F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("whole.n_chars")),
    }
    return out.select(*(new.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
SQL = {
    "op2_substring_dedup": r"""
WITH doc AS (
  SELECT row_number() OVER () AS d, doc_id, coalesce(doc_id, 9223372036854775807) AS k,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT d, k, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS seq
  FROM (SELECT d, k, w, unnest(generate_series(1, len(w) - 49)) AS i FROM doc WHERE len(w) >= 50)),
first AS (SELECT seq, min(k) AS least FROM win GROUP BY seq),
gone AS (
  SELECT DISTINCT d, unnest(generate_series(i, i + 49)) AS pos
  FROM win JOIN first USING (seq) WHERE least < k),
word AS (SELECT d, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM doc),
kept AS (
  SELECT d, string_agg(word, ' ' ORDER BY pos) AS text FROM word ANTI JOIN gone USING (d, pos) GROUP BY d),
lost AS (SELECT d, count(*) AS n FROM gone GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM doc LEFT JOIN lost USING (d) LEFT JOIN kept USING (d)"""
}
