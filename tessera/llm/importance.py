"""Quality classification by importance resampling.

Two generative models of hashed n-grams are fitted: one on target texts (rows
labelled as good), one on all raw texts.  A text is a bag of its words and runs of
signs and of pairs of these, hashed to ``BUCKETS`` buckets; its log weight is the
sum of log(target probability / raw probability) over the bag.  Documents are then
drawn without replacement by their weights: with Gumbel noise added to the log
weight, the top k of all documents are kept.

k is the number of documents whose log weight is at least the threshold that
separates the labelled rows best, so it grows with the corpus.  Noise is scaled by
``TEMPERATURE``: 1 draws in proportion to the weights, 0 keeps the k heaviest.

At most ``LABELLED`` labelled rows, those with the smallest hash of their id, are
used.  One half of them is the target, the other half fixes the threshold, as the
weights of rows the model has seen are too good.  The raw model and all weights
cover every document and its whole text.  Counts are summed per task before the
shuffle, so the model reaches the driver as ``BUCKETS`` numbers.  The k-th largest
score is found by counting in bins that are refined, not by sorting.

Defined results: a text without words, or null, has log weight 0; documents tied
with the k-th are kept; without good labels every weight is 0 and everything is
kept; repeated rows get equal verdicts; of labels that contradict each other the
largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORDS_AND_SIGNS, Words, doc_key, few, keyed, mix, row_blocks, small_batches, staged, table, text_buffer

BUCKETS = 1 << 14
LABELLED = 20_000
#: Added to the expected and the seen count of every n-gram, so ratios of rare ones stay near 1.
SMOOTHING = 5.0
#: A good row that is left out weighs as much as this many bad rows that are kept.
GOOD_WEIGHT = 3.0
TEMPERATURE = 0.25
SEED = 17
_STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Index of text and bucket of every word and every pair of neighbours; all pairs of equal words are one n-gram."""
    text, name = words.text_of(), words.hashes
    pair = text[1:] == text[:-1]
    pairs = np.where(name[:-1] == name[1:], _STEP, mix(name[:-1] * _STEP + name[1:]))[pair]
    bucket = np.concatenate((name, pairs)) % np.uint64(BUCKETS)
    return np.concatenate((text, text[1:][pair])), bucket.astype(np.int64)


def words_in(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_buffer(batch.column("text"))
    for low, high in row_blocks(offsets):
        yield low, high, Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], WORDS_AND_SIGNS)


def labelled_rows(labels: DataFrame, column: str, limit: int = LABELLED) -> DataFrame:
    """At most ``limit`` labelled ids, ``doc_id`` and ``label``, chosen by the hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    chosen = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    return chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def gram_counts(rows: DataFrame) -> np.ndarray:
    """BUCKETS x 2: n-grams of all rows, and of those in the target."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good = batch.column("target").fill_null(False).to_numpy(zero_copy_only=False)
            for low, high, words in words_in(batch):
                text, bucket = grams(words)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[good[low:high][text]], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({"bucket": at, "raw": total[0][at], "target": total[1][at]})

    sums = rows.select("text", "target").mapInArrow(count, "bucket long, raw long, target long")
    out = np.zeros((BUCKETS, 2))
    for row in sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        out[row["bucket"]] = row["raw"], row["target"]
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    if not counts[:, 1].any():
        return np.zeros(BUCKETS)
    expected = counts[:, 0] * (counts[:, 1].sum() / counts[:, 0].sum())
    return np.log(counts[:, 1] + SMOOTHING) - np.log(expected + SMOOTHING)


def log_weights(rows: DataFrame, ratios: np.ndarray) -> DataFrame:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for low, high, words in words_in(batch):
                text, bucket = grams(words)
                out[low:high] = np.bincount(text, ratios[bucket], high - low)
            columns = {c: batch.column(c) for c in ("doc_id", "k", "t", "label")}
            yield pa.RecordBatch.from_pydict(columns | {"log_weight": pa.array(out)})

    kinds = "doc_id long, k long, t long, label int, log_weight double"
    return rows.select("text", "doc_id", "k", "t", "label").mapInArrow(weigh, kinds)


def best_threshold(weight: np.ndarray, good: np.ndarray) -> float:
    """Lowest weight to keep, by the shares of bad rows left out and of good rows left out.

    The cut is put in the middle between the two weights around it.
    """
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weight, kind="stable")
    weight, good = weight[order], good[order]
    gain = np.concatenate(([0.0], np.cumsum(~good) / (~good).sum() - GOOD_WEIGHT * np.cumsum(good) / good.sum()))
    gain[1:-1][weight[1:] == weight[:-1]] = -np.inf
    at = int(np.argmax(gain))
    if at == 0:
        return -np.inf
    return float(weight[at - 1] + weight[min(at, len(weight) - 1)]) / 2


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """Value of the k-th largest number, found by counting in ever finer bins."""
    if k <= 0:
        return np.inf
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return -np.inf
    while True:
        part = df.where(F.col(column).between(low, high))
        if n <= few or low == high:
            values = sorted((r[0] for r in part.select(column).limit(few).collect()), reverse=True)
            return values[min(k, len(values)) - 1]
        width = (high - low) / bins
        number = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        counted = part.groupBy(number.alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        for row in sorted(counted.collect(), key=lambda r: -r["bin"]):
            if k <= row["n"]:
                low, high, n = row["low"], row["high"], row["n"]
                break
            k -= row["n"]


def resampled(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """``doc_id, k, t, log_weight, score, kept`` of every row."""
    small_batches(docs.sparkSession)
    marks = staged(labelled_rows(labels, "quality"), "quality")
    half = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)) == 0
    rows = keyed(docs).join(F.broadcast(marks), "doc_id", "left")
    rows = rows.withColumns({"target": half & (F.col("label") == 1), "label": F.when(~half, F.col("label"))})
    weighed = log_weights(rows, log_ratios(gram_counts(rows)))
    uniform = (F.shiftrightunsigned(F.xxhash64("k", "t", F.lit(SEED)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    noise = -F.log(-F.log(uniform))
    scored = staged(weighed.withColumn("score", F.col("log_weight") + F.lit(temperature) * noise), "scores")
    known = scored.where("label is not null").select("log_weight", "label").limit(2 * LABELLED).toPandas()
    least = best_threshold(known["log_weight"].to_numpy(), known["label"].to_numpy() == 1)
    k = scored.where(F.col("log_weight") >= F.lit(least)).count()
    cut = kth_largest(scored, "score", k)
    return scored.select("doc_id", "k", "t", "log_weight", "score", (F.col("score") >= F.lit(cut)).alias("kept"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return resampled(docs, labels).select("doc_id", "log_weight", "score", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept."""
    found = resampled(docs, table(spark, sf_dir, "labels"))
    gone = few(staged(found.where(~F.col("kept")).select("k", "t").distinct(), "rejected"))
    same = (doc_key() == gone["k"]) & (F.xxhash64("text") == gone["t"])
    return docs.join(gone, same, "left_anti")


QUERIES = {"op4_importance_resampling": op4_importance_resampling}
SQL: dict[str, str] = {}
