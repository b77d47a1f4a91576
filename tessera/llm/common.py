"""Shared helpers: tables, written intermediates, vectorised word hashing.

Words are hashed with numpy over the byte buffer of a whole Arrow batch, so a
text never becomes a Python list of words.  Hashes are 64 bits; where two texts
have to be equal for a result, two independent hashes are compared.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir

#: Stands for a missing doc_id wherever ids are compared: it is greater than all others.
NO_ID = (1 << 63) - 1
#: Bytes of text that are handled at a time inside a task.
BLOCK = 1 << 19
#: Rows of an Arrow batch; texts are long, so batches have few rows.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: few rows per Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    This cuts the lineage: a lost executor costs the tasks that ran on it, and
    what has been written is not computed again.
    """
    path = shared_dir(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


#: Folders of the tables staged in each open ``scratch`` block, the innermost last.
_scopes: list[list[str]] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(table: DataFrame) -> None:
    """Delete a table as ``staged`` returned it, once no plan that is still to run reads it."""
    _delete(table.sparkSession, table.staged_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged inside the block are deleted at its end, also if it fails.

    What is to outlive the block is staged by the function it yields; a plan that leaves the block may
    read such tables only.
    """
    made: list[str] = []
    _scopes.append(made)

    def lasting(df: DataFrame, name: str) -> DataFrame:
        out = staged(df, name)
        _scopes[-1].remove(out.staged_at)
        if len(_scopes) > 1:
            _scopes[-2].append(out.staged_at)
        return out

    try:
        yield lasting
    finally:
        _scopes.pop()
        for folder in made:
            _delete(spark, folder)


#: Rows of a few numbers that are sent to all executors at most.
FEW = 4_000_000


def few(keys: DataFrame, most: int = FEW) -> DataFrame:
    """Keys of rows to drop or keep: broadcast if counted to be few, so that no text is shuffled for them."""
    return F.broadcast(keys) if keys.count() <= most else keys


def give_back() -> None:
    """Return freed memory to the system; Python workers stay for later tasks beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def doc_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column), F.lit(NO_ID))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with ``k``, a comparable id, and ``t``, which tells rows of one id apart."""
    return docs.select("doc_id", "text", doc_key().alias("k"), F.xxhash64("text").alias("t"))


# --- numpy: words of many texts at once -------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_BASE_2 = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_VALUES = np.random.default_rng(20240117).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Kind of each byte: 0 for white space between words, 1 for all else.
WORDS = np.ones(256, np.uint8)
WORDS[[0x20, *range(0x09, 0x0E)]] = 0
#: Letters and all characters beyond ASCII; digits, signs and white space are gaps.
LETTERS = np.zeros(256, np.uint8)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
#: As WORDS, with ASCII punctuation as a kind of its own.
WORDS_AND_SIGNS = WORDS.copy()
WORDS_AND_SIGNS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, BLOCK // 4)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, b & _MASK, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the offsets of each; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK, rows: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows with about ``limit`` bytes each; a longer text is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), low + rows, n)
        yield low, high
        low = high


def bounds_of_words(data: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes of one kind; kind 0 is a gap, and no run crosses one of ``starts``."""
    kind = kinds[data]
    first = kind != 0
    last = first.copy()
    first[1:] &= kind[1:] != kind[:-1]
    last[:-1] &= kind[1:] != kind[:-1]
    cuts = starts[(starts > 0) & (starts < len(data))]
    first[cuts] = kind[cuts] != 0
    last[cuts - 1] = kind[cuts - 1] != 0
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hash_block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    power, inverse = powers(_BASE_2 if second else _BASE, len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((mix(_VALUES) if second else _VALUES)[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z and the capitals of the Latin-1 supplement in lower case."""
    out = data + ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8) * np.uint8(32)
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3) & (data[1:] != 0x97)
    out[1:] += capital.astype(np.uint8) * np.uint8(32)
    return out


class Words:
    """Words of a few texts: bounds in the buffer, hashes, and first word of each text.

    ``prefixes`` has the hashes of the words' first ``prefix`` bytes, ``seconds`` independent hashes of the words.

    ``first`` has one entry more than there are texts: text i has the words
    ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(
        self, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = WORDS, hashed: bool = True, prefix: int = 0, second: bool = False
    ):
        self.data, self.offsets = data, offsets
        starts, ends, hashes, heads, others, low = [], [], [], [], [], 0
        while low < len(data):
            high = min(low + BLOCK, len(data))
            if high < len(data):  # cut where no word is cut
                cut = np.flatnonzero(kinds[data[low:high]] == 0)
                texts = offsets[(offsets > low) & (offsets <= high)]
                best = max(int(cut[-1]) + 1 + low if len(cut) else 0, int(texts[-1]) if len(texts) else 0)
                if best > low:
                    high = best
                else:
                    rest = np.flatnonzero(kinds[data[high:]] == 0)
                    later = offsets[offsets > high]
                    high = min(int(rest[0]) + high if len(rest) else len(data), int(later[0]) if len(later) else len(data))
            part = data[low:high]
            s, e = bounds_of_words(part, offsets[(offsets >= low) & (offsets <= high)] - low, kinds)
            starts.append(s + low)
            ends.append(e + low)
            if hashed:
                hashes.append(_hash_block(part, s, e))
            if prefix:
                heads.append(_hash_block(part, s, np.minimum(s + prefix, e)))
            if second:
                others.append(_hash_block(part, s, e, second=True))
            low = high
        empty = np.zeros(0, np.int64)
        self.starts = np.concatenate(starts) if starts else empty
        self.ends = np.concatenate(ends) if ends else empty
        self.hashes = np.concatenate(hashes) if hashes else empty.astype(np.uint64)
        self.prefixes = np.concatenate(heads) if heads else empty.astype(np.uint64)
        self.seconds = np.concatenate(others) if others else empty.astype(np.uint64)
        self.first = np.searchsorted(self.starts, offsets)

    def text_of(self) -> np.ndarray:
        """Index of the text each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class Sequences:
    """Hashes of runs of consecutive words."""

    def __init__(self, hashes: np.ndarray, second: bool = False):
        self.base = _BASE_2 if second else _BASE
        power, self.inverse = powers(self.base, len(hashes) + 1)
        self.total = np.empty(len(hashes) + 1, np.uint64)
        self.total[0] = 0
        values = mix(hashes + np.uint64(_BASE_2)) if second else hashes
        np.cumsum(values * power[: len(hashes)], out=self.total[1:])

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hash of the words low to high (exclusive)."""
        return mix((self.total[high] - self.total[low]) * self.inverse[low] + (high - low).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
