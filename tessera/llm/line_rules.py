"""Quality rules: cross-document line frequency per host, with base counts of each text.

Lines are normalised (A-Z in lower case, words joined by one space) and hashed.  For
every host the number of its documents that have the line is counted; a line in
more than ``MIN_DOCS`` documents and in more than ``SHARE`` of the host's documents
is above the limits and removed.  A document is depleted, and rejected, when fewer
than ``LEAST_WORDS`` words are left or more than ``MOST_REMOVED`` of its words went.

Each text is scanned once; the counts and line hashes are written, and everything
after that works on rows of a few numbers.  A line of a hot host is counted with
map-side combining; the join back to the lines is an ordinary one, which the
adaptive planner splits where a line is in a third of all documents.

Defined results: a null text has no words and no lines and fails the base rules; a
null host is a host of its own; each row is a document, so repeated rows count
separately; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORDS, Sequences, Words, row_blocks, signed, small_batches, staged, table, text_buffer

MIN_DOCS = 20
SHARE = 0.0005
LEAST_WORDS = 10
MOST_REMOVED = 0.5
REPEAT = 5

LINES = np.ones(256, np.uint8)
LINES[0x0A] = 0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def seen_before(text: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Marks what equals an earlier entry of the same text."""
    order = np.lexsort((np.arange(len(name)), name, text))
    same = np.zeros(len(name), bool)
    same[order[1:]] = (text[order][1:] == text[order][:-1]) & (name[order][1:] == name[order][:-1])
    return same


def found_twice(text: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Marks what equals another entry of the same text, the first included."""
    order = np.lexsort((name, text))
    equal = (text[order][1:] == text[order][:-1]) & (name[order][1:] == name[order][:-1])
    out = np.zeros(len(name), bool)
    out[order[1:]] |= equal
    out[order[:-1]] |= equal
    return out


def lines_of(data: np.ndarray, offsets: np.ndarray, words: Words):
    """Index of text, exact hash, first word and word after the last, of all lines with a word."""
    lines = Words(data, offsets, LINES)
    low = np.searchsorted(words.starts, lines.starts)
    high = np.searchsorted(words.starts, lines.ends)
    worded = high > low
    return lines.text_of()[worded], lines.hashes[worded], low[worded], high[worded]


def counted(data: np.ndarray, offsets: np.ndarray):
    """Base counts of each text; index of text, hash, words and whether it is the text's first, of each line."""
    words = Words(data, offsets)
    text, exact, low, high = lines_of(data, offsets, words)
    n = len(offsets) - 1
    counts = {
        "n_words": np.diff(words.first),
        "word_chars": sums((WORDS[data] != 0) & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": sums(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(text[seen_before(text, exact)], minlength=n),
    }
    owner = words.text_of()
    at = np.arange(max(0, len(words.starts) - REPEAT + 1))
    at = at[owner[at] == owner[at + REPEAT - 1]] if len(at) else at
    windows = Sequences(words.hashes).between(at, at + REPEAT)
    hits = at[found_twice(owner[at], windows)]
    covered = np.zeros(len(words.starts) + REPEAT + 1, np.int64)
    np.add.at(covered, hits, 1)
    np.add.at(covered, hits + REPEAT, -1)
    repeated = np.cumsum(covered)[: len(words.starts)] > 0
    counts["n_repeat_words"] = sums(repeated, words.first)
    name = Sequences(Words(LOWER[data], offsets).hashes).between(low, high)
    return counts, text, name, high - low, ~seen_before(text, name)


def scanned(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``d``, doc_id, host, the base counts and ``lines`` of every row; the ``row`` itself if asked for."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for low, high in row_blocks(offsets):
                part = data[offsets[low] : offsets[high]]
                counts, text, name, size, first = counted(part, offsets[low : high + 1] - offsets[low])
                at = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=high - low))))
                rows = pa.StructArray.from_arrays(
                    [pa.array(signed(name)), pa.array(size.astype(np.int32)), pa.array(first)], ["line", "words", "first"]
                )
                columns = {c: batch.column(c)[low:high] for c in ("doc_id", "host")}
                columns |= {c: pa.array(v.astype(np.int64)) for c, v in counts.items()}
                columns["lines"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows)
                if whole:
                    columns["row"] = batch.column("row")[low:high]
                yield pa.RecordBatch.from_pydict(columns)

    small_batches(docs.sparkSession)
    kinds = "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS)
    kinds += ", lines array<struct<line:long,words:int,first:boolean>>"
    rows = docs.select("text", "doc_id", F.col("source").alias("host"), *([F.struct(*docs.columns).alias("row")] if whole else []))
    if whole:
        kinds += f", row {rows.schema['row'].dataType.simpleString()}"
    rows = rows.mapInArrow(scan, kinds)
    return staged(rows.withColumn("d", F.monotonically_increasing_id()), "lines")


def common_lines(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """``host, line`` of the lines above the limits."""
    each = rows.select("host", F.explode("lines").alias("x")).where("x.first")
    counts = each.groupBy("host", F.col("x.line").alias("line")).agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    hosts = rows.groupBy("host").agg(F.count("*").alias("docs")).withColumnRenamed("host", "_host")
    above = counts.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).where(F.col("n") > F.col("docs") * F.lit(share))
    return staged(above.select("host", "line"), "common_lines")


def removed_lines(rows: DataFrame, common: DataFrame) -> DataFrame:
    """``d, line, words`` of every line that is removed."""
    named = common.select(F.coalesce("host", F.lit("")).alias("_host"), F.col("host").isNull().alias("_none"), "line")
    each = rows.select("d", F.coalesce("host", F.lit("")).alias("_host"), F.col("host").isNull().alias("_none"), F.explode("lines").alias("x"))
    each = each.select("d", "_host", "_none", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    return each.join(named, ["_host", "_none", "line"]).select("d", "line", "words")


def judged(rows: DataFrame, common: DataFrame) -> DataFrame:
    """Scanned rows with ``n_removed_words``, ``n_removed_lines``, ``base_failed`` and ``kept``."""
    gone = removed_lines(rows, common).groupBy("d").agg(
        F.sum("words").alias("n_removed_words"), F.count("*").alias("n_removed_lines")
    )
    out = rows.drop("lines").join(gone, "d", "left").fillna(0, ["n_removed_words", "n_removed_lines"])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < LEAST_WORDS) | (F.col("n_removed_words") > MOST_REMOVED * F.col("n_words"))
    return out.withColumns({"base_failed": failed, "kept": ~failed & ~depleted})


def line_rules(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """Verdict and counts of every document; ``source`` is its host."""
    rows = scanned(docs)
    return judged(rows, common_lines(rows, min_docs, share))


def without(text: str, gone: set[int]) -> str:
    """The text without its lines of the given hashes."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    offsets = np.array([0, len(data)])
    words = Words(LOWER[data], offsets)
    lines = Words(data, offsets, LINES)
    low, high = np.searchsorted(words.starts, lines.starts), np.searchsorted(words.starts, lines.ends)
    names = signed(Sequences(words.hashes).between(low, high))
    kept, at = [], 0
    for start, end, name, n in zip(lines.starts, lines.ends, names, high - low):
        if n and int(name) in gone:
            kept.append(raw[at:start])
            at = end + 1  # with its line feed
    return b"".join([*kept, raw[at:]]).decode()


def cleaned(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """The kept documents, common lines cut out of their texts; all columns stay."""
    rows = scanned(docs, whole=True)
    common = common_lines(rows, min_docs, share)
    kept = judged(rows.drop("row"), common).where("kept").select("d")
    gone = removed_lines(rows, common).groupBy("d").agg(F.collect_set("line").alias("gone"))
    both = rows.select("d", "row").join(kept, "d").join(gone, "d", "left")
    both = both.select("row", F.col("row.text").alias("text"), "gone")
    kind = both.schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist())
            texts = [without(text, set(gone)) if gone else text for text, gone in pairs]
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "clean": pa.array(texts, pa.string())})

    out = both.mapInArrow(cut, f"row {kind}, clean string")
    return out.select(*(F.col("clean").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_rules(docs).select("doc_id", *COUNTS, "n_removed_words", "n_removed_lines", "base_failed", "kept")


QUERIES = {"op7_line_frequency": op7_line_frequency}

_WORD = r"'[^\x20\x09-\x0D]+'"
SQL = {
    "op7_line_frequency": f"""
WITH doc AS (
  SELECT row_number() OVER () AS d, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
line AS (
  SELECT d, source, i, lines[i] AS line, regexp_extract_all(
    translate(lines[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w
  FROM (SELECT d, source, lines, unnest(generate_series(1, len(lines))) AS i
        FROM (SELECT d, source, string_split(text, chr(10)) AS lines FROM doc))),
worded AS (SELECT *, array_to_string(w, ' ') AS norm, len(w) AS n FROM line WHERE len(w) > 0),
dup AS (SELECT d, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY d),
hosts AS (SELECT source, count(*) AS docs FROM doc GROUP BY source),
common AS (
  SELECT w.source, norm FROM worded w JOIN hosts h ON w.source IS NOT DISTINCT FROM h.source
  GROUP BY w.source, norm, docs HAVING count(DISTINCT d) > {MIN_DOCS} AND count(DISTINCT d) > docs * {SHARE}),
gone AS (
  SELECT d, sum(n) AS words, count(*) AS lines FROM worded w JOIN common c
    ON w.source IS NOT DISTINCT FROM c.source AND w.norm = c.norm GROUP BY d),
win AS (
  SELECT d, i, array_to_string(list_slice(w, i, i + 4), ' ') AS seq
  FROM (SELECT d, w, unnest(generate_series(1, len(w) - 4)) AS i FROM doc WHERE len(w) >= 5)),
twice AS (SELECT d, seq FROM win GROUP BY d, seq HAVING count(*) > 1),
covered AS (SELECT DISTINCT d, unnest(generate_series(i, i + 4)) AS pos FROM win JOIN twice USING (d, seq)),
repeated AS (SELECT d, count(*) AS n FROM covered GROUP BY d),
base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
    coalesce(words, 0) AS n_removed_words, coalesce(lines, 0) AS n_removed_lines
  FROM doc LEFT JOIN dup USING (d) LEFT JOIN repeated USING (d) LEFT JOIN gone USING (d)),
failed AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_removed_words AS BIGINT) AS n_removed_words,
  CAST(n_removed_lines AS BIGINT) AS n_removed_lines, base_failed,
  NOT base_failed AND n_words - n_removed_words >= {LEAST_WORDS} AND n_removed_words <= {MOST_REMOVED} * n_words AS kept
FROM failed"""
}
