"""Language identification with averaged hashed subword embeddings.

A text is the bag of the byte n-grams of its lower-cased letters, words being
divided by one blank, hashed to ``BUCKETS`` buckets.  The average of the n-grams'
embeddings goes through a linear layer and softmax.  Both are trained in numpy by
stochastic gradient descent on the driver, on about ``PER_LANGUAGE`` labelled texts
of each language and at most ``LABELLED`` in all, chosen by the hash of their id;
executors send these texts as bucket counts.  A quarter of them is held back from
training and fixes the temperature of the softmax, which makes scores
probabilities, and the score below which a prediction is rejected.

For prediction the layers are multiplied to one number per bucket and language, so
a text takes one pass and no shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0 and
rejected; so is every text when nothing was learned; repeated rows get equal rows;
languages are the labels' own values, those with fewer texts than asked for are
learned from what there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LETTERS, lowered, row_blocks, small_batches, staged, table, text_buffer
from tessera.llm.toxicity import HELD_OUT, fold

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
DIMENSIONS = 16
PER_LANGUAGE = 1500
LABELLED = 12_000
EPOCHS = 4
RATE = 0.5
#: Predictions are rejected below the score at which accepted ones are right this often.
PRECISION = 0.99
UNKNOWN = "und"


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size the index of text (rising) and the bucket of every n-gram.

    Gaps between words shrink to one blank; each text begins and ends with one.
    """
    n = len(offsets) - 1
    padded = np.full(len(data) + n + 1, 0x20, np.uint8)
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    padded[np.arange(len(data)) + text_of + 1] = np.where(LETTERS[data] != 0, lowered(data), 0x20)
    owner = np.zeros(len(padded), np.int64)
    owner[1:] = np.repeat(np.arange(n), np.diff(offsets) + 1)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 0x20) | (padded[:-1] != 0x20)
    starts = np.zeros(len(padded), bool)
    starts[np.cumsum(np.diff(offsets) + 1)] = True  # blanks that end a text stay, so no word joins two texts
    keep |= starts
    padded, owner = padded[keep].astype(np.uint32), owner[keep]
    for size in SIZES:
        count = len(padded) - size + 1
        if count <= 0:
            continue
        code = np.full(count, size, np.uint32)
        for at in range(size):
            code = code * np.uint32(0x01000193) ^ padded[at : at + count]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
        last = owner[size - 1 :]
        # The blank before a text belongs to the text before it; only that one byte may differ.
        inside = (owner[min(1, size - 1) : min(1, size - 1) + count] == last) & ((padded[:count] != 0x20) | (size > 1))
        yield last[inside], code[inside].astype(np.int64)


def counts_of(docs: DataFrame) -> DataFrame:
    """``doc_id, lang`` with different buckets and how often each occurs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for low, high in row_blocks(offsets):
                found = gram_buckets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                codes = [text * BUCKETS + bucket for text, bucket in found]
                both, count = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True)
                at = pa.array(np.searchsorted(both // BUCKETS, np.arange(high - low + 1)), pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id")[low:high],
                    "lang": batch.column("lang")[low:high],
                    "buckets": pa.ListArray.from_arrays(at, pa.array(both % BUCKETS, pa.int32())),
                    "counts": pa.ListArray.from_arrays(at, pa.array(count, pa.int32())),
                })

    kinds = "doc_id long, lang string, buckets array<int>, counts array<int>"
    return docs.select("text", "doc_id", "lang").mapInArrow(scan, kinds)


class Model:
    """Languages, the scores of all buckets and how to read them."""

    def __init__(self, languages: list[str], logits: np.ndarray, temperature: float, least: float):
        self.languages, self.logits, self.temperature, self.least = languages, logits, temperature, least

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        z = means / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def trained(bags: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int, epochs: int = EPOCHS, rate: float = RATE, seed: int = 3) -> np.ndarray:
    """BUCKETS x classes logits after stochastic gradient descent on the bags."""
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, classes), np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            bucket, share = bags[i]
            lr = rate * (1 - done / steps)
            done += 1
            mean = share @ embedding[bucket]
            z = mean @ layer
            slope = np.exp(z - z.max())
            slope /= slope.sum()
            slope[target[i]] -= 1
            back = layer @ slope
            layer -= lr * np.outer(mean, slope)
            # Steps are for the sum over the text, as the mean alone moves rare n-grams hardly at all.
            embedding[bucket] -= lr * np.sqrt(share)[:, None] * back
    return embedding @ layer


def calibrated(languages: list[str], logits: np.ndarray, bags: list, target: np.ndarray) -> Model:
    """Temperature with the least loss on held-back bags; least score for the precision asked for."""
    if not len(bags):
        return Model(languages, logits, 1.0, 0.0)
    means = np.stack([share @ logits[bucket] for bucket, share in bags])
    loss = []
    grid = np.geomspace(0.02, 20, 60)
    for t in grid:
        p = Model(languages, logits, t, 0.0).probabilities(means)
        loss.append(-np.log(p[np.arange(len(target)), target] + 1e-12).mean())
    model = Model(languages, logits, float(grid[int(np.argmin(loss))]), 0.0)
    p = model.probabilities(means)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum((p.argmax(axis=1) == target)[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= PRECISION)
    model.least = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return model


def learned(docs: DataFrame) -> Model | None:
    """Model of the documents with a language whose fold is not held out."""
    seen = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold() != HELD_OUT))
    sizes = seen.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    chosen = seen.select("doc_id", "lang").join(sizes, "lang").where(draw * F.col("n") < PER_LANGUAGE)
    chosen = chosen.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    chosen = staged(chosen, "sample")
    sample = counts_of(seen.join(F.broadcast(chosen), "doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).toArrow()
    rows = [
        (lang, np.array(b), np.array(c, np.float32))
        for lang, b, c in zip(*(sample.column(x).to_pylist() for x in ("lang", "buckets", "counts"))) if b
    ]
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return None
    target = np.array([languages.index(lang) for lang, _, _ in rows])
    bags = [(b, c / c.sum()) for _, b, c in rows]
    back = np.arange(len(bags)) % 4 == 0
    if back.all():
        back[:] = False
    logits = trained([x for x, held in zip(bags, back) if not held], target[~back], len(languages))
    return calibrated(languages, logits, [x for x, held in zip(bags, back) if held], target[back])


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "ignore"))


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            n = batch.num_rows
            names, scores, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            for low, high in row_blocks(offsets, 1 << 19) if model else ():
                part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                sums, grams = np.zeros((high - low, len(model.languages))), np.zeros(high - low, np.int64)
                for text, bucket in gram_buckets(part, at):
                    if len(text):
                        heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                        sums[text[heads]] += np.add.reduceat(model.logits[bucket], heads, axis=0)
                        grams[text[heads]] += np.diff(np.append(heads, len(text)))
                rows = np.flatnonzero(grams)
                if not len(rows):
                    continue
                p = model.probabilities(sums[rows] / grams[rows, None])
                total = np.concatenate(([0], np.cumsum((LETTERS[part] != 0) & (part < 0x80), dtype=np.int64)))
                plain = total[at[1:]] > total[at[:-1]]
                for row, best, score in zip(rows, p.argmax(axis=1), p.max(axis=1)):
                    if plain[row] or has_letter(part[at[row] : at[row + 1]].tobytes()):
                        names[low + row], scores[low + row] = model.languages[best], min(1.0, float(score))
                        rejected[low + row] = score < model.least
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(scores), "rejected": pa.array(rejected),
            })

    return docs.select("text", "doc_id").mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def languages(docs: DataFrame) -> DataFrame:
    """Prediction for every row; see the module's text."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")
    out = predicted(docs, learned(docs))
    held = F.coalesce(fold() == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


QUERIES = {"op6_language": op6_language}
SQL: dict[str, str] = {}
