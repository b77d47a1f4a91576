"""Near-duplicate classes from DartMinHash signatures of weighted word shingles.

A text is the multiset of its five-word shingles (a text of fewer words is one
shingle); the weight of a shingle is its count, and two texts are similar by
sum(min weight) / sum(max weight).

**Signatures.**  Every shingle owns the same random darts in all texts: unit
cells of its region (weight unit u, rank strip s) hold a Poisson(1) number of
darts drawn from hashes of (shingle, u, s).  A text with weight w for the shingle
is hit by the darts below w on the weight axis.  A dart belongs to one of
``COORDINATES`` coordinates, and each coordinate keeps its dart of lowest rank.
Ranks are looked at up to (ln k + 4) * k / total weight, which takes about as
many darts for short and long texts; the few texts with an empty coordinate look
further up.  Two texts agree on a coordinate with the probability of their
similarity.

**Joining.**  Equal texts are compacted first.  ``BANDS`` bands of four
coordinates give buckets.  A bucket with up to ``PAIRS`` texts yields its pairs;
in a larger one each text is paired with the bucket's hub, the text that meets most
others.  So a group of any size costs a bounded number of candidates per text.

**Completing.**  Where the links so far leave the texts of a too large bucket in more than one class, all pairs
across such classes are looked for by a prefix filter: of texts that are similar enough, the rarest shingles, those before
the last ``SIMILARITY`` of the weight, have one in common, and what follows the first common one must hold the overlap.
Pairs within one class are never made; a shingle with many texts is dealt over slices of ``BLOCK_TEXTS``.

**Verifying.**  Pairs whose signatures are too far apart go first, before any text is moved.  Of the
others one pair per text is compared, chosen so that they form stars; of the rest
only those whose texts are still in different classes.  So a text travels a few times,
however many pairs it is in.  Pairs are grouped by the connected component of the
candidate graph, large components in blocks of ``BLOCK_TEXTS`` texts or
``BLOCK_BYTES``, and compared exactly on their shingles inside tasks; a pair is skipped
where its two texts are known to be linked already.  The links' connected components
are the classes.

Recall is that of banding: a pair at similarity 0.8 is missed by all 32 bands
with probability 5e-8, in small buckets and in those that overfill.

Defined results: a null text is a class of its own; texts without words are
copies of each other; rows of one class share the smallest doc_id as
``class_id`` (null ids count as greatest); repeated rows get equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import (
    NO_ID,
    Sequences,
    Words,
    doc_key,
    few,
    give_back,
    keyed,
    mix,
    row_blocks,
    scratch,
    signed,
    small_batches,
    staged,
    table,
    text_buffer,
)
from tessera.llm.graph import components
from tessera.llm.substring_dedup import flagged

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 128
BANDS = 32
PAIRS = 16
BLOCK_TEXTS = 800
#: Bytes of text of a part of a group, about.
BLOCK_BYTES = 32 << 20
#: Coordinates that texts which are surely similar agree on.
CLOSE = 112
#: Hash buckets of the shingle counts that order shingles from rare to common.
COUNTED = 1 << 18
#: Bounds on weights leave room for rounding, so that no pair at the threshold is lost.
SLACK = 1 - 1e-9

_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 1.0 / (1 << 53)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Index of text and hash of each shingle, repeats included."""
    counts = np.diff(words.first)
    each = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), each)
    local = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    low = words.first[text] + local
    return text, Sequences(words.hashes).between(low, np.minimum(low + size, words.first[text + 1]))


def weights(text: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts."""
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    head = np.ones(len(text), bool)
    head[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(head)
    return text[at], shingle[at], np.diff(np.append(at, len(text))).astype(np.float64)


def throw(text, element, weight, low, high):
    """Darts in the weighted regions: text, coordinate, rank and name of each.

    ``low`` and ``high`` are the rank strips looked at, one pair per row.
    """
    units = np.ceil(weight).astype(np.int64)
    strips = high - low
    cells = units * strips
    row = np.repeat(np.arange(len(text)), cells)
    local = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    unit, strip = local // strips[row], low[row] + local % strips[row]
    seed = mix(element[row] + (unit.astype(np.uint64) << np.uint64(32)) * _STEP + strip.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    many = np.searchsorted(_POISSON, (seed >> np.uint64(11)).astype(np.float64) * _UNIT, "right")
    dart = np.repeat(np.arange(len(row)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    name = mix(seed[dart] + (nth.astype(np.uint64) + np.uint64(1)) * _STEP)
    other = mix(name ^ np.uint64(0xA0761D6478BD642F))
    across = unit[dart] + (other >> np.uint64(40)).astype(np.float64) / (1 << 24)
    rank = strip[dart] + (other & np.uint64((1 << 40) - 1)).astype(np.float64) / (1 << 40)
    row = row[dart]
    hit = across < weight[row]
    return text[row[hit]], (name[hit] % np.uint64(COORDINATES)).astype(np.int64), rank[hit], name[hit]


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x COORDINATES names (32 bits) of the earliest darts; texts without elements get zeros."""
    best = np.zeros((n, COORDINATES), np.uint32)
    total = np.bincount(text, weight, n)
    strips = np.ceil(COORDINATES * (np.log(COORDINATES) + 4) / np.maximum(total, 1e-9)).astype(np.int64)
    low, high = np.zeros(n, np.int64), strips
    todo = total > 0
    rows = np.arange(len(text))
    found = np.zeros((n, COORDINATES), bool)
    while len(rows):
        t, c, rank, name = throw(text[rows], element[rows], weight[rows], low[text[rows]], high[text[rows]])
        place = t * COORDINATES + c
        order = np.lexsort((name, rank, place))
        place = place[order]
        head = np.ones(len(place), bool)
        head[1:] = place[1:] != place[:-1]
        at, name = place[head], name[order][head]
        new = ~found.ravel()[at]
        best.ravel()[at[new]] = (name[new] >> np.uint64(20)).astype(np.uint32)
        found.ravel()[at] = True
        todo &= ~found.all(axis=1)
        low, high = high, high * 2
        rows = np.flatnonzero(todo[text])
    return best


def sketches(docs: DataFrame) -> DataFrame:
    """``k, t``, two hashes of the word sequence and the signature of every row with a text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            key, tag = batch.column("k"), batch.column("t")
            for low, high in row_blocks(offsets, 1 << 17, 250):
                words = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                sig = signatures(*weights(*shingles(words)), high - low)
                one, two = Sequences(words.hashes), Sequences(words.hashes, second=True)
                yield pa.RecordBatch.from_pydict({
                    "k": key[low:high],
                    "t": tag[low:high],
                    "one": signed(one.between(words.first[:-1], words.first[1:])),
                    "two": signed(two.between(words.first[:-1], words.first[1:])),
                    "worded": np.diff(words.first) > 0,
                    "sig": pa.array([x.tobytes() for x in sig], pa.binary()),
                    "small": pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary()),
                    "size": np.diff(offsets[low : high + 1]),
                })
        give_back()

    small_batches(docs.sparkSession)
    rows = keyed(docs).where(F.col("text").isNotNull()).select("text", "k", "t")
    return rows.mapInArrow(scan, "k long, t long, one long, two long, worded boolean, sig binary, small binary, size long")


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row per different word sequence: ``node``, its hashes, its smallest row and its signature."""
    least = rows.groupBy("one", "two", "worded").agg(F.min(F.struct("k", "t", "sig", "small", "size")).alias("least"))
    flat = least.select("one", "two", "worded", *(f"least.{c}" for c in ("k", "t", "sig", "small", "size")))
    return staged(flat.withColumn("node", F.monotonically_increasing_id()), "texts")


def band_keys(sigs: list[bytes]) -> np.ndarray:
    """Row per signature, column per band: key of the band's coordinates."""
    sig = np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), BANDS, -1)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sigs), BANDS)).copy()
    for i in range(sig.shape[2]):
        out = mix(out * _STEP + sig[:, :, i].astype(np.uint64))
    return out


def bucket_rows(texts: DataFrame) -> DataFrame:
    """``key, node`` for every band of every text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(batch.column("sig").to_pylist())
                node = np.repeat(batch.column("node").to_numpy(), BANDS)
                yield pa.RecordBatch.from_pydict({"key": signed(keys.ravel()), "node": node})

    return texts.select("node", "sig").mapInArrow(scan, "key long, node long")


def candidate_pairs(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Pairs ``a < b`` of nodes that are to be compared first, edges that connect the same nodes, and crowded texts.

    The number of pairs is linear in the texts.  The edges tie the texts of each bucket to its smallest;
    all similar pairs lie within buckets.  Crowded texts (``node, keys``) are those in buckets that do not
    yield all their pairs, only those with their hub; None if there are none.
    """
    rows = bucket_rows(texts.where("worded"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    met = staged(rows.join(sizes.where("n > 1"), "key"), "buckets")
    small = met.where(F.col("n") <= PAIRS).select("key", "node")
    left, right = small.withColumnRenamed("node", "a"), small.withColumnRenamed("node", "b")
    pairs = left.join(right, "key").where("a < b").select("a", "b")
    ties = met.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    # A text has at most BANDS keys, so its list is short.
    crowded = met.where(F.col("n") > PAIRS).groupBy("node").agg(F.collect_list("key").alias("keys"), F.sum("n").alias("reach"))
    crowded = staged(crowded, "crowded")
    if crowded.isEmpty():
        return staged(pairs.distinct(), "pairs"), ties, None
    each = crowded.select(F.explode("keys").alias("key"), "node", "reach")
    hubs = each.groupBy("key").agg(F.min_by("node", F.struct(-F.col("reach"), F.col("node"))).alias("hub"))
    met_hub = each.join(hubs, "key").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    return staged(pairs.unionByName(met_hub.where("a < b")).distinct(), "pairs"), ties, crowded.select("node", "keys")


def unsettled(crowded: DataFrame, found: DataFrame) -> DataFrame:
    """``node, cls`` of the crowded texts in classes that share a crowded bucket with another class.

    Buckets are looked at by class, so a large class is one row of each of its buckets.
    """
    held = crowded.join(found.withColumnRenamed("comp", "cls"), "node", "left").withColumn("cls", F.coalesce("cls", "node"))
    held = staged(held, "held")
    by_class = held.select(F.explode("keys").alias("key"), "cls").distinct()
    several = by_class.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    apart = by_class.join(several, "key").select("cls").distinct()
    return staged(held.select("node", "cls").join(apart, "cls"), "unsettled")


def ranked(batches: Iterator[pa.RecordBatch], common: np.ndarray) -> Iterator[tuple]:
    """Per block of texts: batch, first row, text, shingle and weight from rare to common, and the texts' weights."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for low, high in row_blocks(offsets, 1 << 18, 500):
            words = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            text, shingle, weight = weights(*shingles(words))
            order = np.lexsort((shingle, common[(shingle % np.uint64(COUNTED)).astype(np.int64)], text))
            yield batch, low, text[order], shingle[order], weight[order], np.bincount(text, weight, high - low)


def rare_shingles(rows: DataFrame, least: float) -> DataFrame:
    """``grp, token, node, cls, total, rest`` for the prefix of each text; ``rest`` is the weight from the token on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COUNTED, np.int64)
        for _, _, _, shingle, _, _ in ranked(batches, np.zeros(COUNTED, np.int64)):
            sums += np.bincount((shingle % np.uint64(COUNTED)).astype(np.int64), minlength=COUNTED)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"place": at, "n": sums[at]})

    met = rows.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(COUNTED, np.int64)
    common[met.column("place").to_numpy()] = met.column("n").to_numpy()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, low, text, shingle, weight, total in ranked(batches, common):
            before = np.cumsum(weight) - weight
            before -= (np.cumsum(total) - total)[text]
            rest = total[text] - before
            at = rest >= least * SLACK * total[text]
            row = pa.array(text[at] + low)
            columns = {c: batch.column(c).take(row) for c in ("grp", "node", "cls")}
            more = {"token": signed(shingle[at]), "total": total[text[at]], "rest": rest[at]}
            yield pa.RecordBatch.from_pydict(columns | more)

    out = rows.select("text", "grp", "node", "cls")
    return out.mapInArrow(scan, "grp long, node long, cls long, token long, total double, rest double")


def crossing_pairs(docs: DataFrame, texts: DataFrame, held: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """All pairs ``a < b`` across classes that can be similar enough, of the unsettled texts ``node, cls``.

    ``whole`` has the groups that hold all candidates.
    """
    wanted = texts.select("k", "t", "node").join(held, "node")
    wanted = staged(wanted.join(whole.select("node", F.col("comp").alias("grp")), "node"), "unsettled_texts")
    rows = flagged(docs.select("doc_id", "text"), wanted).dropDuplicates(["k", "t"])
    rows = staged(rows.join(wanted, ["k", "t"]).select("text", "node", "cls", "grp"), "unsettled_rows")
    tokens = staged(rare_shingles(rows, least), "tokens")
    # Only pairs across classes are wanted: every text outside a token's largest class meets all others.
    by_class = tokens.groupBy("grp", "token", "cls").agg(F.count("*").alias("n"))
    spread = by_class.groupBy("grp", "token").agg(
        F.sum("n").alias("n"), F.count("*").alias("classes"), F.max_by("cls", F.struct("n", "cls")).alias("main")
    )
    spread = spread.where("classes > 1").select("grp", "token", "main", F.ceil(F.col("n") / BLOCK_TEXTS).alias("slices"))
    placed = staged(tokens.join(spread, ["grp", "token"]), "crossing")
    one = placed.where("cls <> main").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    one = one.select("grp", "token", "slice", *(F.col(c).alias(f"{c}_1") for c in ("node", "cls", "total", "rest")))
    other = placed.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")))
    both = one.join(other, ["grp", "token", "slice"]).where("cls_1 <> cls and (cls = main or node_1 < node)")
    overlap = (F.col("total_1") + F.col("total")) * F.lit(least / (1 + least) * SLACK)
    both = both.where(F.least("rest_1", "rest") >= overlap)
    return staged(both.select(F.least("node_1", "node").alias("a"), F.greatest("node_1", "node").alias("b")).distinct(), "crossing_pairs")


def similarity(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted shingle arrays with counts."""
    _, i, j = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    both = np.minimum(one[1][i], other[1][j]).sum()
    return both / (one[1].sum() + other[1].sum() - both)


def linked(nodes: pd.DataFrame, pairs: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links among the pairs of one block, found from the likeliest on; what is linked already is skipped."""
    if not len(nodes) or not len(pairs):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    at = {node: i for i, node in enumerate(nodes["node"])}
    a, b = (np.array([at[x] for x in pairs[c]]) for c in ("a", "b"))
    raw = nodes["text"].str.encode("utf-8").tolist()
    ready: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def elements(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in ready:
            data = np.frombuffer(raw[i], np.uint8)
            _, names, counts = weights(*shingles(Words(data, np.array([0, len(data)]))))
            ready[i] = names, counts
        return ready[i]

    parent = np.arange(len(nodes))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    links = []
    for p in np.argsort(-pairs["agree"].to_numpy(), kind="stable"):
        i, j = root(a[p]), root(b[p])
        if i != j and similarity(elements(a[p]), elements(b[p])) >= least:
            parent[max(i, j)] = min(i, j)
            links.append((pairs["a"].iloc[p], pairs["b"].iloc[p]))
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def blocked(whole: DataFrame) -> DataFrame:
    """Groups of candidates with the part of each text; groups of many or long texts have several parts."""
    parts = F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("size") / BLOCK_BYTES))
    placed = whole.join(whole.groupBy("comp").agg(parts.alias("parts")), "comp")
    return staged(placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))), "placed")


def agreeing(texts: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Pairs with the number of coordinates on which they agree, as far as their texts can be similar enough.

    Eight bits of each coordinate are compared, so a pair agrees on no fewer than it does.  Six standard
    deviations below the threshold pairs are left out, before any text is moved.
    """
    floor = COORDINATES * least - 6 * np.sqrt(COORDINATES * least * (1 - least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("one", "other"))
            agree = (one == other).sum(axis=1)
            at = np.flatnonzero(agree >= floor)
            rows = pa.array(at)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").take(rows), "b": batch.column("b").take(rows), "agree": agree[at]})

    side = texts.select("node", "small")
    both = pairs.join(side.select(F.col("node").alias("a"), F.col("small").alias("one")), "a")
    both = both.join(side.select(F.col("node").alias("b"), F.col("small").alias("other")), "b")
    return both.select("a", "b", "one", "other").mapInArrow(count, "a long, b long, agree long")


def stars(agreed: DataFrame) -> DataFrame:
    """One pair for each text: of the others that agree well, with the one that has most pairs.

    Such pairs meet in few centres, so where they hold they link a group of any size at once.
    """
    both = agreed.unionByName(agreed.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    degrees = both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("degree"))
    order = F.struct(F.col("agree") >= CLOSE, "degree", "agree", "b")
    picked = both.join(degrees, "b").groupBy("a").agg(F.max_by(F.struct("b", "agree"), order).alias("best"))
    pair = picked.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b"), "best.agree")
    return pair.distinct()


def connected(
    docs: DataFrame, texts: DataFrame, pairs: DataFrame, placed: DataFrame, least: float, found: DataFrame | None = None
) -> DataFrame:
    """Classes ``node, comp`` of the texts that similar pairs join, and of the classes found before.

    Stars are compared first; of all other pairs only those whose texts are then still apart.
    """
    agreed = staged(agreeing(texts, pairs, least), "agreeing")
    first = staged(stars(agreed), "stars")
    found = joined_classes(found, compared(docs, texts, first, placed, least))
    rest = agreed.join(first.select("a", "b"), ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(found.select(F.col("node").alias(end), F.col("comp").alias(f"of_{end}")), end, "left")
    apart = F.coalesce("of_a", "a") != F.coalesce("of_b", "b")
    rest = staged(rest.where(apart).select("a", "b", "agree"), "apart")
    return found if rest.isEmpty() else joined_classes(found, compared(docs, texts, rest, placed, least))


def joined_classes(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Classes of the links and of earlier classes, each of which counts as a star, so few rounds are needed."""
    links = staged(links, "links")
    if found is not None:
        links = links.unionByName(found.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")))
    return components(links, "classes_so_far")


def memberships(pairs: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs with their blocks, and the texts each block needs."""
    side = placed.select("node", "comp", "part")
    cut = pairs.join(side.withColumnRenamed("node", "a"), "a")
    cut = cut.join(side.select(F.col("node").alias("b"), F.col("part").alias("other")), "b")
    block = ["comp", "low", "high"]
    cut = cut.select("comp", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "a", "b", "agree")
    cut = staged(cut, "blocks")
    return cut, cut.select(*block, F.col("a").alias("node")).unionByName(cut.select(*block, F.col("b").alias("node"))).distinct()


def compared(docs: DataFrame, texts: DataFrame, pairs: DataFrame, placed: DataFrame, least: float) -> DataFrame:
    """Pairs of texts that are similar enough; per block only as many as connect its texts."""
    block = ["comp", "low", "high"]
    cut, members = memberships(pairs, placed)
    named = members.select("node").distinct()
    wanted = staged(texts.join(named, "node").select("k", "t", "node"), "wanted")
    rows = flagged(docs.select("doc_id", "text"), wanted).dropDuplicates(["k", "t"])
    carried = members.join(rows.join(wanted, ["k", "t"]).select("node", "text"), "node")

    def compare(key, nodes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        out = linked(nodes, pairs, least)
        give_back()
        return out

    asked = cut.select(*(F.col(c).alias(f"of_{c}") for c in block), "a", "b", "agree")
    asked = asked.groupBy(*(f"of_{c}" for c in block))
    return carried.groupBy(*block).cogroup(asked).applyInPandas(compare, "a long, b long")


def linked_classes(docs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``node, comp`` for every text that is similar to another."""
    pairs, ties, crowded = candidate_pairs(texts)
    whole = staged(components(ties, "candidates").join(texts.select("node", "size"), "node"), "groups")
    placed = blocked(whole)
    found = connected(docs, texts, pairs, placed, least)
    if crowded is None:
        return found
    held = unsettled(crowded, found)
    if held.isEmpty():
        return found
    more = crossing_pairs(docs, texts, held, whole, least)
    return found if more.isEmpty() else connected(docs, texts, more, placed, least, found)


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, k, t, class_id, first`` per row; ``first`` marks the class's one row to keep (with its copies)."""
    rows = staged(sketches(docs), "sketches")
    with scratch(docs.sparkSession) as lasting:
        texts = distinct_texts(rows)
        found = linked_classes(docs, texts, least)
        joined = texts.select("one", "two", "worded", "node", "k", "t").join(found, "node", "left")
        joined = joined.withColumn("comp", F.coalesce("comp", "node"))
        smallest = joined.groupBy("comp").agg(F.min(F.struct("k", "t")).alias("kept"))
        classes = lasting(joined.join(smallest, "comp").select("one", "two", "worded", "kept"), "classes")
    found = rows.select("k", "t", "one", "two", "worded").join(classes, ["one", "two", "worded"])
    found = found.select("k", "t", "kept").unionByName(
        keyed(docs).where(F.col("text").isNull()).select("k", "t", F.struct("k", "t").alias("kept"))
    )
    null_id = F.col("kept.k") == NO_ID
    return found.select(
        F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"), "k", "t",
        F.when(~null_id, F.col("kept.k")).alias("class_id"),
        ((F.col("k") == F.col("kept.k")) & (F.col("t") == F.col("kept.t"))).alias("first"),
    )


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", F.col("first").alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: the one with the smallest doc_id."""
    with scratch(spark) as lasting:
        found = near_duplicates(docs).groupBy("k", "t", "first").agg(F.count("*").alias("n"))
        found = lasting(found, "verdicts")
    key, tag = doc_key(), F.xxhash64("text")
    gone, again = found.where(~F.col("first")).select("k", "t"), found.where("first and n > 1").select("k", "t")
    plain = few(staged(gone.unionByName(again), "gone"))
    again = few(again)
    rest = docs.join(plain, (key == plain["k"]) & (tag == plain["t"]), "left_anti")
    repeated = docs.join(again, (key == again["k"]) & (tag == again["t"]), "left_semi")
    single = repeated.dropDuplicates(["doc_id", "text"])
    return rest.unionByName(single)


QUERIES = {"op8_dart_minhash": op8_dart_minhash}
SQL: dict[str, str] = {}
