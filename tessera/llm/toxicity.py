"""Toxicity scores from a factorization machine over hashed terms.

A text is the set of its terms: lower-cased words and, for long words, their first
``PREFIX`` bytes, hashed to ``BUCKETS`` buckets.  The model adds a weight per term
and, for every pair of terms in the text, the product of two learned vectors; so a
pair, such as an insult with the mention of a group, counts beyond its parts.

The model is fitted on the driver in numpy, by stochastic gradient descent with
step sizes per weight, on at most ``LABELLED`` labelled rows, those with the
smallest hash of their id.  Every term that at least ``LEAST_ROWS`` of these rows have is
in the model.  So that it does not learn the rows by heart, a term's weights decay
strongly unless the rows speak for it, by itself or in a pair: its toxic share, or that
of the rows which have it together with some other term, differs from the share of all
rows by ``CLEAR`` or ``CLEAR_PAIR`` standard errors.  Pairs are counted among the
``PAIRED`` terms that most rows have; so two words may say nothing each and all
together.  Scores are then computed in one pass over all texts, without a shuffle.

Defined results: a null or empty text has no terms and gets the model's base score;
repeated rows get equal scores; of labels that contradict each other the largest
counts; without labels of both kinds every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LETTERS, Words, lowered, row_blocks, small_batches, staged, table, text_buffer
from tessera.llm.importance import labelled_rows

BUCKETS = 1 << 20
PREFIX = 5
FACTORS = 8
LABELLED = 20_000
LEAST_ROWS = 5
PAIRED = 3072
CLEAR, CLEAR_PAIR = 4.0, 7.0
EPOCHS = 6
RATE = 0.1
#: Weight decay of terms that the rows speak for, and of all others.
DECAY, STRONG_DECAY = 2e-5, 10.0
LEAST_SCORE = 0.3
HELD_OUT = 2


def fold(column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(4))


def terms(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of text and bucket of each different term; only those marked in ``wanted`` where given."""
    words = Words(lowered(data), offsets, LETTERS, prefix=PREFIX)
    text = words.text_of()
    long = words.ends - words.starts > PREFIX
    bucket = np.concatenate((words.hashes, words.prefixes[long] + np.uint64(1))) % np.uint64(BUCKETS)
    text, bucket = np.concatenate((text, text[long])), bucket.astype(np.int64)
    if wanted is not None:
        at = wanted[bucket]
        text, bucket = text[at], bucket[at]
    both = np.unique(text * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


def terms_of(docs: DataFrame) -> DataFrame:
    """``doc_id, label, terms`` with the buckets of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for low, high in row_blocks(offsets):
                text, bucket = terms(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                at = np.searchsorted(text, np.arange(high - low + 1))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bucket, pa.int32()))
                columns = {c: batch.column(c)[low:high] for c in ("doc_id", "label")}
                yield pa.RecordBatch.from_pydict(columns | {"terms": lists})

    return docs.select("text", "doc_id", "label").mapInArrow(scan, "doc_id long, label int, terms array<int>")


class Machine:
    """A factorization machine on sets of terms; rows of ``table`` are weight and vector of a term."""

    def __init__(self, buckets: np.ndarray, factors: int = FACTORS, seed: int = 5):
        self.buckets = buckets
        self.table = np.zeros((len(buckets), factors + 1), np.float32)
        self.table[:, 1:] = np.random.default_rng(seed).normal(0, 0.01, (len(buckets), factors))
        self.bias = 0.0

    def logits(self, text: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """One number for each of n texts; ``text`` rises, ``row`` has rows of the table."""
        out = np.full(n, self.bias, np.float64)
        if len(text):
            at = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            found = self.table[row].astype(np.float64)
            sums = np.add.reduceat(found, at, axis=0)
            squares = np.add.reduceat(found[:, 1:] ** 2, at, axis=0)
            out[text[at]] += sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(axis=1)
        return out

    def fit(
        self, rows: list[np.ndarray], labels: np.ndarray, decay: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 6
    ) -> None:
        """Logistic loss; every weight's step shrinks with the squares of its gradients, then the weight decays."""
        rng = np.random.default_rng(seed)
        squares = np.full_like(self.table, 1.0)
        share = labels.mean()
        self.bias, bias_squares = float(np.log(share / (1 - share))), 1e-2
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                at = rows[i]
                found = self.table[at]
                total = found[:, 1:].sum(axis=0)
                logit = self.bias + found[:, 0].sum() + 0.5 * float((total**2 - (found[:, 1:] ** 2).sum(axis=0)).sum())
                slope = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[i]
                step = np.empty_like(found)
                step[:, 0] = slope
                step[:, 1:] = slope * (total - found[:, 1:])
                np.clip(step, -1, 1, out=step)
                squares[at] += step * step
                sizes = rate / np.sqrt(squares[at])
                self.table[at] = (found - sizes * step) / (1 + sizes * decay[at, None])
                bias_squares += slope * slope
                self.bias -= rate * slope / np.sqrt(bias_squares)


def distance(n: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Standard errors between the toxic share of n rows and that of all rows; 0 for too few rows."""
    spread = np.sqrt(np.maximum(n, 1) * share * (1 - share))
    return np.where(n >= LEAST_ROWS, np.abs(toxic - n * share) / spread, 0.0)


def clear_terms(rows: list[np.ndarray], labels: np.ndarray, n_terms: int, paired: int = PAIRED) -> np.ndarray:
    """Whether the rows speak for each term, by itself or together with another."""
    each, size = np.concatenate(rows), [len(r) for r in rows]
    share = labels.mean()
    n = np.bincount(each, minlength=n_terms)
    out = distance(n, np.bincount(each, np.repeat(labels, size), minlength=n_terms), share) >= CLEAR
    often = np.argsort(-n, kind="stable")[:paired]
    place = np.full(n_terms, -1)
    place[often] = np.arange(len(often))
    both, toxic = (np.zeros((len(often), len(often)), np.float32) for _ in range(2))
    for low in range(0, len(rows), 500):
        block = np.zeros((len(rows[low : low + 500]), len(often)), np.float32)
        for i, row in enumerate(rows[low : low + 500]):
            at = place[row]
            block[i, at[at >= 0]] = 1
        both += block.T @ block
        marked = block[labels[low : low + 500] > 0]
        toxic += marked.T @ marked
    for i in range(len(often)):
        far = distance(both[i], toxic[i], share) >= CLEAR_PAIR
        far[i] = False
        if far.any():
            out[often[i]] = True
    return out


def fitted(docs: DataFrame, labels: DataFrame) -> Machine:
    """A model of the labelled rows; ``labels`` has doc_id and label."""
    known = docs.join(F.broadcast(labels), "doc_id")
    sets = staged(terms_of(known), "terms")
    met = sets.select(F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    met = met.where(F.col("n") >= LEAST_ROWS).select("bucket").toArrow()  # as many rows as there are buckets, at most
    buckets = np.sort(met.column("bucket").to_numpy().astype(np.int64))
    model = Machine(buckets)
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            found = place[lists.flatten().to_numpy()]
            row, found = row[found >= 0], found[found >= 0]
            at = np.searchsorted(row, np.arange(len(lists) + 1))
            kept = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "terms": kept})

    sample = sets.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    sample = sample.mapInArrow(shortened, "doc_id long, label int, terms array<int>").toArrow()
    y = sample.column("label").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        model.buckets, model.table = buckets[:0], model.table[:0]
        model.bias = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))) if len(y) else -30.0
        return model
    lists = sample.column("terms").combine_chunks()
    at = lists.offsets.to_numpy()
    flat = lists.flatten().to_numpy()
    rows = [flat[a:b] for a, b in zip(at[:-1] - at[0], at[1:] - at[0])]
    clear = clear_terms(rows, y, len(buckets))
    model.fit(rows, y, np.where(clear, DECAY, STRONG_DECAY).astype(np.float32))
    return model


def scored(docs: DataFrame, model: Machine) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    place = np.full(BUCKETS, -1, np.int32)
    place[model.buckets] = np.arange(len(model.buckets))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            out = np.zeros(batch.num_rows)
            for low, high in row_blocks(offsets):
                part = data[offsets[low] : offsets[high]]
                text, bucket = terms(part, offsets[low : high + 1] - offsets[low], place >= 0)
                logits = np.clip(model.logits(text, place[bucket], high - low), -30, 30)
                out[low:high] = 1 / (1 + np.exp(-logits))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(out)})

    return docs.select("text", "doc_id").mapInArrow(score, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``; labels of held-out rows are never looked at."""
    small_batches(docs.sparkSession)
    seen = labels.where(fold() != HELD_OUT)
    marks = staged(labelled_rows(seen, "toxic", LABELLED), "toxic")
    out = scored(docs, fitted(docs.select("doc_id", "text"), marks))
    held = F.coalesce(fold() == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
