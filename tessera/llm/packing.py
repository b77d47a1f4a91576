"""Packing of token sequences by non-negative least squares over length histograms.

1. Texts are tokenised once and cut into pieces of at most ``window`` tokens; the
   pieces are written with their checksums.
2. Lengths are counted in steps of ``STEP`` tokens, rounded up: a histogram of at
   most ``window / STEP`` numbers, whatever the size of the corpus.
3. All combinations of up to ``DEPTH`` lengths that fill the window exactly are
   the columns of a matrix; non-negative least squares finds how often each is to
   be repeated so that together they use up the histogram.  The counts are rounded
   down to whole sequences that the supply can fill.
4. Every piece gets a rank among the pieces of its length: ranks inside the rows
   of one task, plus the counts of the tasks before it, so a length which a third
   of all pieces share is not sorted in one place.  The rank says which repeat of
   which combination the piece goes to.
5. Pieces left over are laid end to end and cut where a sequence is full, which
   pads nothing but the last sequence.  A piece's place follows from sums per task.

Only the histogram goes to the driver.  Sums over tasks run over one row per task.

Defined results: a null text counts as empty and has the end id alone; rows with
equal ids are packed like any others; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Words, give_back, row_blocks, small_batches, staged, table

WINDOW = 2048
STEP = 8
DEPTH = 3
END_ID = 1
#: Words a worker remembers the ids of, and the ids they have; beyond it starts anew.
CACHE_WORDS = 500_000
CACHE_IDS = 2_500_000
#: Lower-cased words remembered as Python objects, which take ten times the memory.
CACHE_PARTS = 50_000
#: Bytes of text that are encoded at a time.
ENCODED = 1 << 18
BUCKETS = 1 << 18

#: A word of plain Latin letters and the signs after it.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(others)) for b in range(0x100)]


class Encoder:
    """Token ids as little-endian unsigned 32-bit numbers, looked up word by word.

    The tokenizer never joins over white space, so a word is encoded once and looked up after, by two
    independent hashes in sorted arrays; the ids of all remembered words lie in one array.  A new
    word of Latin letters goes to the tokenizer's model directly, its signs apart, which skips the
    steps that leave such words as they are; everything else goes through the whole tokenizer.  Whether
    the short way holds is tried out when the tokenizer is loaded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        self.parts: dict[str, bytes] = {}
        self.letters = {chr(c): "".join(byte_letters()[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}
        self.letters = str.maketrans(self.letters)
        rng = np.random.default_rng(1)
        alphabet = np.array(list("aaabcdeeeghilmnorstuyzABÉßäöüéèêñç"))
        words = ["".join(rng.choice(alphabet, n)) + sign for n in (1, 2, 3, 5, 8, 13) for sign in ("", ",", "!!", ".)") for _ in range(8)]
        self.short_way = True
        self.short_way = all(self.encode(w.encode()) == self.whole(w) for w in words)
        self.parts.clear()

    def forget(self) -> None:
        """Word hashes in order, the second hash of each, where its ids begin and how many there are."""
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, "<u4")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def letters_ids(self, word: str) -> bytes:
        ids = self.parts.get(word)
        if ids is None:
            plain = word if word.isascii() else word.translate(self.letters)
            ids = self.parts[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(plain)]).tobytes()
        return ids

    def encode(self, raw: bytes) -> bytes:
        """Ids of one word without white space."""
        word = raw.decode("utf-8")
        found = PLAIN_WORD.fullmatch(word) if self.short_way else None
        if found is None:
            return self.whole(word)
        ids = self.letters_ids(found[1].lower())
        if found[2]:
            signs = self.parts.get(found[2])
            if signs is None:
                signs = self.parts[found[2]] = self.whole(found[2])
            ids += signs
        return ids

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        return [self.encode(word) for word in words]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        offsets = np.concatenate(([0], np.cumsum([len(text) for text in texts]))).astype(np.int64)
        out: list[bytes] = []
        for low, high in row_blocks(offsets, ENCODED):
            out += self.encode_block(texts[low:high], offsets[low : high + 1] - offsets[low])
        return out

    def encode_block(self, texts: list[bytes], offsets: np.ndarray) -> list[bytes]:
        raw = b"".join(texts)
        words = Words(np.frombuffer(raw, np.uint8), offsets, second=True)
        if len(self.first) > CACHE_WORDS or len(self.ids) > CACHE_IDS:
            self.forget()
        first, index, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        second = words.seconds[index]
        place = np.searchsorted(self.first, first)
        held = place < len(self.first)
        held[held] = self.first[place[held]] == first[held]
        if (second[inverse] != words.seconds).any() or (self.second[place[held]] != second[held]).any():
            # Different words with one hash: nothing is looked up.
            return [b"".join(self.encode_words(text.split())) for text in texts]
        new = np.flatnonzero(~held)
        bounds = zip(words.starts[index[new]].tolist(), words.ends[index[new]].tolist())
        fresh = self.encode_words([raw[start:end] for start, end in bounds])
        n = np.array([len(ids) // 4 for ids in fresh], np.int32)
        at = len(self.ids) + np.cumsum(n, dtype=np.int64) - n
        for name, values in (("first", first[new]), ("second", second[new]), ("at", at), ("n", n)):
            setattr(self, name, np.insert(getattr(self, name), place[new], values))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(fresh), "<u4")))
        place = np.searchsorted(self.first, first)[inverse]
        n = self.n[place].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(self.at[place] - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[words.first]
        return [ids[low:high].tobytes() for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


_encoders: dict[str, Encoder] = {}


def encode_all(texts: list[bytes], path: str) -> list[bytes]:
    """Token ids of each text; a worker keeps one encoder per tokenizer."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path].encode_all(texts)


def pieces_of(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``window`` tokens: ``p`` numbers them, ``ids`` has the tokens of a partial one."""
    end = np.array([end_id], "<u4").tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
            ids_of = batch.column("doc_id").to_pylist()
            for low in range(0, len(texts), 256):
                out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for doc_id, ids in zip(ids_of[low : low + 256], encode_all(texts[low : low + 256], path)):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        part = ids[4 * start : 4 * (start + window)]
                        out["doc_id"].append(doc_id)
                        out["start"].append(start)
                        out["length"].append(len(part) // 4)
                        out["ids_crc32"].append(zlib.crc32(part))
                        out["doc_tokens"].append(total)
                        out["ids"].append(part if len(part) < 4 * window else None)
                kinds = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})
            give_back()

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    pieces = rows.mapInArrow(scan, kinds).withColumn("p", F.monotonically_increasing_id())
    return staged(pieces, "pieces", compression="zstd")


def combinations(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Lengths in falling order, at most ``depth`` of them, that sum to ``bins``."""
    out: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], rest: int) -> None:
        if rest == 0:
            out.append(chosen)
        elif len(chosen) < depth:
            for length in range(min(rest, chosen[-1] if chosen else rest), 0, -1):
                if length * (depth - len(chosen)) < rest:
                    break
                extend((*chosen, length), rest - length)

    extend((), bins)
    return out


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Non-negative x that minimises |ax - b|, by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= slack:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            trial = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (trial > slack).all():
                x[:] = 0
                x[at] = trial
                break
            low = trial <= slack
            step = x[at][low] / np.maximum(x[at][low] - trial[low], 1e-300)
            x[at] += min(1.0, float(step.min())) * (trial - x[at])
            active[at[x[at] <= slack]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def repeats(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """How often each combination is used; together they never need more than the histogram has.

    ``histogram[i]`` counts the pieces of i + 1 steps.
    """
    bins = len(histogram)
    names = combinations(bins, depth)
    matrix = np.zeros((bins, len(names)))
    for column, name in enumerate(names):
        np.add.at(matrix[:, column], np.array(name) - 1, 1)
    count = np.floor(least_squares(matrix, histogram.astype(float)) + 1e-6).astype(np.int64)
    left = histogram - matrix @ count
    while (left < 0).any():
        short = int(np.argmin(left))
        users = np.flatnonzero((matrix[short] > 0) & (count > 0))
        take = users[np.argmax(count[users])]
        drop = min(count[take], int(np.ceil(-left[short] / matrix[short, take])))
        count[take] -= drop
        left += drop * matrix[:, take]
    return [(names[i], int(count[i])) for i in np.flatnonzero(count)]


class Slots:
    """Where the piece of a given rank among those of its length goes."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]], bins: int):
        self.first = np.concatenate(([0], np.cumsum([n for _, n in plan]))).astype(np.int64)
        self.of: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in range(1, bins + 1):
            users = [(i, name.count(length), n) for i, (name, n) in enumerate(plan) if length in name]
            which = np.array([i for i, _, _ in users], np.int64)
            times = np.array([m for _, m, _ in users], np.int64)
            self.of.append((which, times, np.cumsum([m * n for _, m, n in users]).astype(np.int64)))

    def sequences(self, steps: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Sequence of each piece, -1 for those left over."""
        out = np.full(len(steps), -1, np.int64)
        for length in np.unique(steps):
            which, times, ends = self.of[length - 1]
            rows = np.flatnonzero((steps == length) & (rank < (ends[-1] if len(ends) else 0)))
            at = np.searchsorted(ends, rank[rows], "right")
            before = rank[rows] - np.concatenate(([0], ends))[at]
            out[rows] = self.first[which[at]] + before // times[at]
        return out


def ranked(pieces: DataFrame) -> DataFrame:
    """``rank`` of each piece among those with equal ``steps``; ``task`` tells which task wrote it."""
    own = pieces.groupBy("steps", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("steps").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("steps", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("steps", "task").orderBy("p")) - 1
    out = pieces.withColumn("_local", local).join(own, ["steps", "task"])
    return out.withColumn("rank", (F.col("_local") + F.col("_before")).cast("long")).drop("_local", "_before")


def laid_out(rest: DataFrame) -> DataFrame:
    """``at``: tokens of the pieces before each one, in order of ``p``."""
    own = rest.groupBy("task").agg(F.sum("length").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("task").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    out = rest.withColumn("_inside", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(own, "task")
    return out.withColumn("at", F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def cut_rest(rest: DataFrame, tokens: DataFrame, base: int, window: int) -> DataFrame:
    """Sequences for the pieces left over, cut where a sequence is full."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    placed = staged(laid_out(rest), "rest")
    inside = F.col("at") % window
    placed = placed.withColumns({"sequence_id": F.floor(F.col("at") / window) + base, "offset": inside})
    whole = placed.where(inside + F.col("length") <= window)
    over = placed.where(inside + F.col("length") > window)
    bucket = F.pmod(F.xxhash64("p"), F.lit(BUCKETS))
    marks = over.select(bucket.alias("_bucket")).distinct()
    wanted = tokens.select("p", "ids", bucket.alias("_bucket")).join(F.broadcast(marks), "_bucket", "left_semi")
    halves = over.join(wanted.drop("_bucket"), "p").withColumn("_cut", (F.lit(window) - inside).cast("int"))
    split = halves.withColumn("_second", F.explode(F.array(F.lit(False), F.lit(True))))
    part = F.when(
        F.col("_second"), F.expr("substring(ids, 4 * _cut + 1, 4 * (length - _cut))")
    ).otherwise(F.expr("substring(ids, 1, 4 * _cut)"))
    split = split.select(
        "doc_id",
        F.when(F.col("_second"), F.col("start") + F.col("_cut")).otherwise(F.col("start")).alias("start"),
        F.when(F.col("_second"), F.col("length") - F.col("_cut")).otherwise(F.col("_cut")).cast("long").alias("length"),
        F.crc32(part).alias("ids_crc32"),
        "doc_tokens",
        (F.col("sequence_id") + F.col("_second").cast("int")).alias("sequence_id"),
        F.when(F.col("_second"), F.lit(0)).otherwise(F.col("offset")).cast("long").alias("offset"),
    )
    return whole.select(*names).unionByName(split.select(*names))


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece with its sequence and offset; see the module's text."""
    tokens = pieces_of(docs, path or default_tokenizer(), window)
    steps = F.ceil(F.col("length") / STEP).cast("int")
    pieces = tokens.drop("ids").withColumns({"steps": steps, "task": F.shiftright("p", 33)})
    bins = -(-window // STEP)
    histogram = np.zeros(bins, np.int64)
    for row in pieces.groupBy("steps").count().collect():  # at most window / STEP rows
        histogram[row["steps"] - 1] = row["count"]
    plan = repeats(histogram)
    slots, base = Slots(plan, bins), sum(n for _, n in plan)
    found = ranked(pieces)
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "p", "task"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence = slots.sequences(batch.column("steps").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {"sequence_id": pa.array(sequence)})

    kinds = ", ".join(f"{c} long" for c in kept)
    placed = found.select(*kept, "steps", "rank").mapInArrow(place, kinds + ", sequence_id long")
    placed = staged(placed, "placed")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "p")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    full = placed.where("sequence_id >= 0").withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))
    rest = cut_rest(placed.where("sequence_id < 0").drop("sequence_id"), tokens, base, window)
    return full.drop("p", "task").unionByName(rest)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return packed(docs)


QUERIES = {"op3_packing": op3_packing}
SQL: dict[str, str] = {}
