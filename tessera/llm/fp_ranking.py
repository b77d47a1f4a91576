"""Ranked lexical search over document FP-trees.

1. The items' terms are the vocabulary.  Every whole text is scanned once; what stays of
   a document is its restricted term vector (term numbers and counts) and its length.
2. Document frequencies and lengths are counted over all documents.
3. The vectors are taken in blocks.  A block's vectors, their terms in order of falling
   document frequency, are put into a trie: vectors with the same beginning share its
   path, paths without branches are one node, and up to ``LEAF`` neighbours are a leaf.
   Every node keeps the largest tf of each term and the smallest m below it.
4. Each item searches each trie depth-first, the most promising child first.  A node's
   largest tf and smallest m bound the score of all documents below it (the score grows
   with tf and falls with m, also after rounding), so a node whose bound is below the
   item's twentieth score so far is left out.  Equal bounds are followed, as ties go by
   doc_id.  Documents in the leaves that are reached are scored exactly.
5. The blocks' best are ranked per item; blocks need not know of each other.

Scale: a document is in one block, so nothing is shuffled but up to ``top`` rows per item
and block, which are cut down before the shuffle.  A block is bounded by documents and
by postings.  Items are taken in groups of about ``TERMS`` terms, each group a scan of
its own, so the vocabulary and the items in a task's memory are bounded for any number of
items.  Copies share one path and one leaf, however many there are.

Terms are told apart by 64-bit hashes; with a vocabulary of ``TERMS`` words, a foreign
word is taken for one of them with a probability of about 3e-14.

Defined results: a null or empty text has no terms and is never ranked; an item without
terms has no rows; identical item rows count once; each document row is a document, so
repeated rows get ranks of their own; a null doc_id comes after all others among equal
scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, Words, row_blocks, signed, small_batches, staged, table, text_buffer
from tessera.llm.license_scan import LOWER, TERMS as KINDS

TOP = 20
TERMS = 500_000
BLOCK_DOCS = 8192
BLOCK_POSTINGS = 2_000_000
LEAF = 24
#: Weight of a term count against a document's length, as whole numbers.
SATURATION, SLOPE, BASE, SHARE = 1_000_000_000, 12, 75, 25


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(LOWER[data], offsets, KINDS)


# --- items --------------------------------------------------------------------------


def item_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, terms``: hashes of all terms of every distinct item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = word_hashes(*text_buffer(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), pa.array(signed(words.hashes)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("item", "item_id")), lists], ["item", "item_id", "terms"])

    distinct = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    rows = distinct.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    found = rows.mapInArrow(scan, "item long, item_id long, terms array<long>")
    return staged(found.where(F.size("terms") > 0), "item_terms")


@dataclass
class Items:
    """A group of items: a sorted vocabulary, and each item's term numbers with their repeats."""

    vocabulary: np.ndarray
    ids: list[tuple[int, int | None]]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def item_groups(items: DataFrame, most: int = TERMS) -> Iterator[Items]:
    """The items in groups of about ``most`` terms; each group is small enough for the driver and every task."""
    found = item_terms(items)
    total = found.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = math.ceil(total / most)
    for i in range(n):
        rows = found.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i).orderBy("item").collect()
        if rows:
            each = [np.array(r["terms"], np.int64) for r in rows]
            vocabulary = np.unique(np.concatenate(each))
            counted = [np.unique(np.searchsorted(vocabulary, t), return_counts=True) for t in each]
            yield Items(vocabulary, [(r["item"], r["item_id"]) for r in rows], *map(list, zip(*counted)))


# --- documents ----------------------------------------------------------------------


def restricted_vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``doc, doc_id, n, terms, tfs``: length and vocabulary terms of every document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for low, high in row_blocks(offsets):
                words = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                hashes = signed(words.hashes)
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = vocabulary[at] == hashes
                pairs, tf = np.unique(words.text_of()[known] * len(vocabulary) + at[known], return_counts=True)
                ends = pa.array(np.searchsorted(pairs, np.arange(high - low + 1) * len(vocabulary)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc")[low:high], batch.column("doc_id")[low:high], pa.array(np.diff(words.first)),
                        pa.ListArray.from_arrays(ends, pa.array((pairs % len(vocabulary)).astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(tf)),
                    ],
                    ["doc", "doc_id", "n", "terms", "tfs"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(rows.mapInArrow(scan, "doc long, doc_id long, n long, terms array<int>, tfs array<long>"), "vectors")


@dataclass
class Counts:
    """What is counted over all documents: those with a term, all their terms, and each term's documents."""

    docs: int
    length: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        values = [math.floor(1000 * math.log((2 * self.docs + 2) / (2 * int(df) + 1))) for df in self.df]
        return np.array(values, np.int64)

    def m(self, n: np.ndarray) -> np.ndarray:
        return BASE + (SHARE * n * self.docs) // self.length


def counts(vectors: DataFrame, size: int) -> Counts:
    docs, length = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = np.zeros(size, np.int64)
    found = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for batch in found.toArrow().to_batches():  # as many rows as the vocabulary has terms
        df[batch.column("term").to_numpy()] = batch.column("df").to_numpy()
    return Counts(docs, length or 0, df)


def contribution(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SATURATION * tf) // (1000 * tf + SLOPE * m)


# --- the trie -----------------------------------------------------------------------


def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


class Trie:
    """FP-tree of a block's documents.

    Documents are sorted by path; node i holds those from ``low[i]`` to ``high[i]``, and its
    children are the nodes ``child[i]`` to ``child[i] + n_children[i]``.  ``ranks`` and ``tfs`` are the documents'
    postings, ``node_ranks`` and ``node_tfs`` the largest counts below each node.
    """

    def __init__(self, n_terms: int, owner: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, m: np.ndarray, leaf: int = LEAF):
        n = len(m)
        order = np.lexsort((ranks, owner))
        owner, ranks, tfs = owner[order], ranks[order], tfs[order]
        offsets = np.searchsorted(owner, np.arange(n + 1))
        raw = ranks.astype(">u4").tobytes()
        paths = [raw[4 * a : 4 * b] for a, b in zip(offsets[:-1], offsets[1:])]
        self.docs = np.array(sorted(range(n), key=paths.__getitem__), np.int64)
        sizes = np.diff(offsets)[self.docs]
        picked = _spread(offsets[:-1][self.docs], offsets[1:][self.docs])
        self.ranks, self.tfs, self.m = ranks[picked], tfs[picked], m[self.docs]
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self._nodes(self._shared(n), leaf)
        self._largest(n_terms)

    def _shared(self, n: int) -> np.ndarray:
        """Terms that each path shares with the one before."""
        shared = np.zeros(n, np.int64)
        for i in range(1, n):
            a = self.ranks[self.offsets[i - 1] : self.offsets[i]]
            b = self.ranks[self.offsets[i] : self.offsets[i + 1]]
            k = min(len(a), len(b))
            other = np.flatnonzero(a[:k] != b[:k])
            shared[i] = other[0] if len(other) else k if len(a) != len(b) else 1 << 40
        return shared

    def _nodes(self, shared: np.ndarray, leaf: int) -> None:
        low, high, parent, child, n_children = [0], [len(shared)], [-1], [], []
        i = 0
        while i < len(low):
            inner = shared[low[i] + 1 : high[i]]
            fork = int(inner.min()) if len(inner) else 1 << 40
            child.append(len(low))
            if high[i] - low[i] > leaf and fork < 1 << 40:
                cuts = [low[i], *(np.flatnonzero(inner == fork) + low[i] + 1).tolist(), high[i]]
                low += cuts[:-1]
                high += cuts[1:]
                parent += [i] * (len(cuts) - 1)
                n_children.append(len(cuts) - 1)
            else:
                n_children.append(0)
            i += 1
        self.low, self.high, self.child, self.n_children = low, high, child, n_children
        self.parent = np.array(parent)
        self.least_m = np.array([self.m[a:b].min() for a, b in zip(low, high)], np.int64)

    def _largest(self, n_terms: int) -> None:
        """Largest tf of each term below each node, leaves first, then from the children upwards."""
        n = len(self.low)
        depth = np.zeros(n, np.int64)
        for i in range(1, n):
            depth[i] = depth[self.parent[i]] + 1
        leaves = np.flatnonzero(np.array(self.n_children) == 0)
        leaves = leaves[np.argsort(np.array(self.low)[leaves])]
        sizes = np.diff(np.append(np.array(self.low)[leaves], len(self.m)))
        of_doc = np.repeat(leaves, sizes)
        of_posting = np.repeat(of_doc, np.diff(self.offsets))

        def merged(node: np.ndarray, rank: np.ndarray, tf: np.ndarray):
            key = node * n_terms + rank
            order = np.argsort(key, kind="stable")
            key, tf = key[order], tf[order]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            return key[starts] // n_terms, key[starts] % n_terms, np.maximum.reduceat(tf, starts) if len(key) else tf

        own = merged(of_posting, self.ranks, self.tfs)
        done, level = [], int(depth.max())
        below = tuple(np.zeros(0, np.int64) for _ in range(3))
        while level >= 0:
            here = depth[own[0]] == level
            now = [np.concatenate((x, y[here])) for x, y in zip(below, own)]
            done.append(now)
            below = merged(self.parent[now[0]], now[1], now[2])
            level -= 1
        node, rank, tf = (np.concatenate(x) for x in zip(*done))
        order = np.lexsort((rank, node))
        self.node_ranks, self.node_tfs = rank[order], tf[order]
        self.node_offsets = np.searchsorted(node[order], np.arange(n + 1))

    def best(self, column: np.ndarray, weight: np.ndarray, top: int, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best documents; ``column`` numbers an item's terms by rank, -1 for others."""

        def table_of(ranks: np.ndarray, tfs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            at = column[ranks]
            met = np.flatnonzero(at >= 0)
            out = np.zeros((len(offsets) - 1, len(weight)), np.int64)
            out[np.searchsorted(offsets, met + offsets[0], "right") - 1, at[met]] = tfs[met]
            return out

        found, scores, least, stack = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, [(1 << 62, 0)]
        self.visited = 0
        while stack:
            bound, i = stack.pop()
            if bound < least:
                continue
            self.visited += 1
            if self.n_children[i]:
                a, b = self.child[i], self.child[i] + self.n_children[i]
                cuts = self.node_offsets[a : b + 1]
                tf = table_of(self.node_ranks[cuts[0] : cuts[-1]], self.node_tfs[cuts[0] : cuts[-1]], cuts)
                bounds = contribution(tf, self.least_m[a:b, None]) @ weight
                order = np.argsort(bounds, kind="stable")
                stack += [(int(bounds[j]), a + int(j)) for j in order if bounds[j] >= least]
            else:
                a, b = self.low[i], self.high[i]
                cuts = self.offsets[a : b + 1]
                tf = table_of(self.ranks[cuts[0] : cuts[-1]], self.tfs[cuts[0] : cuts[-1]], cuts)
                exact = contribution(tf, self.m[a:b, None]) @ weight
                good = np.flatnonzero(exact >= least)
                if len(good):
                    found, scores = np.concatenate((found, good + a)), np.concatenate((scores, exact[good]))
                    if len(found) > top:
                        docs = self.docs[found]
                        keep = np.lexsort((docs, doc_ids[docs], -scores))[:top]
                        found, scores = found[keep], scores[keep]
                    if len(found) == top:
                        least = max(1, int(scores.min()))
        return self.docs[found], scores


# --- search -------------------------------------------------------------------------


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to blocks."""
    held, docs, postings = [], 0, 0
    for batch in batches:
        held.append(batch)
        docs += len(batch)
        postings += len(batch.column("terms").flatten())
        if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, docs, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def block_best(vectors: DataFrame, items: Items, totals: Counts, top: int = TOP) -> DataFrame:
    """``item, item_id, doc, doc_id, score``: the best documents of every block for every item."""
    by_frequency = np.argsort(-totals.df, kind="stable")
    rank = np.empty(len(by_frequency), np.int64)
    rank[by_frequency] = np.arange(len(rank))
    weights, ids = totals.weights(), items.ids
    wanted = [(rank[t], weights[t] * r) for t, r in zip(items.terms, items.repeats)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = np.full(len(rank), -1, np.int64)
        for block in _gathered(batches):
            lists = block.column("terms").combine_chunks()
            sizes = lists.value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            doc_ids = block.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy()
            tfs = block.column("tfs").combine_chunks().flatten().to_numpy()
            trie = Trie(len(rank), owner, rank[lists.flatten().to_numpy()], tfs, totals.m(block.column("n").to_numpy()))
            for (item, item_id), (ranks, weight) in zip(ids, wanted):
                column[ranks] = np.arange(len(ranks))
                docs, scores = trie.best(column, weight, top, doc_ids)
                column[ranks] = -1
                if len(docs):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([item] * len(docs), pa.int64()), pa.array([item_id] * len(docs), pa.int64()),
                            *(block.column(c).take(pa.array(docs)).combine_chunks() for c in ("doc", "doc_id")), pa.array(scores),
                        ],
                        ["item", "item_id", "doc", "doc_id", "score"],
                    )

    held = vectors.where(F.size("terms") > 0)
    return held.mapInArrow(search, "item long, item_id long, doc long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Each item's ``top`` documents by score, ties by doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for group in item_groups(items):
        vectors = restricted_vectors(docs, group.vocabulary)
        found = block_best(vectors, group, counts(vectors, len(group.vocabulary)), top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "doc")
        best = staged(found, "block_best").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        out = out.unionByName(best.select("item_id", "rank", "doc_id", "score"))
    return out


def op12_fp_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_fp_ranking": op12_fp_ranking}


def _terms(text: str) -> str:
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


SQL = {
    "op12_fp_ranking": f"""
WITH doc AS (SELECT row_number() OVER () AS d, doc_id, {_terms("coalesce(text, '')")} AS w FROM documents),
totals AS (SELECT count(*) AS n_docs, sum(len(w)) AS length FROM doc WHERE len(w) > 0),
item AS (SELECT row_number() OVER () AS i, item_id, {_terms("coalesce(text, '')")} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT i, item_id, term, count(*) AS repeats FROM (SELECT i, item_id, unnest(w) AS term FROM item) GROUP BY ALL),
posting AS (SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, len(w) AS n, unnest(w) AS term FROM doc)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM posting, totals GROUP BY term),
score AS (
  SELECT i, item_id, d, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // length)))) AS BIGINT) AS score
  FROM posting JOIN asked USING (term) JOIN weight USING (term), totals GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST, d) AS rank FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranks WHERE rank <= {TOP}"""
}
