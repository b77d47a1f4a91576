"""Prefix trie of conversations by Spark SQL's ROLLUP over positional turn columns.

Turns are numbered per conversation, and rebuilt conversations are cut into blocks of
``BLOCK`` columns, one turn a column.  ``GROUP BY block, key, ROLLUP(t0 .. t7)``
aggregates all prefixes that end in a block together; ``grouping_id`` tells how many
columns a prefix has.  ``key`` is the node at which the block before ends, so long
conversations go on in further blocks, all of them in the same job.

A node is known by its depth and two 64-bit hashes of its turns, each turn hashed with
its position.  The hashes of a prefix are combined by exclusive or, which is summed
like a count: along a conversation in two steps (per ``SPAN`` blocks, then over
them), so not even one conversation that holds a third of all turns is put into one
task.  Hot prefixes are counted before the shuffle.

Sums over subtrees need no walk through the tree.  Every node belongs to its smallest
member, and a conversation owns its nodes from some depth on.  So the leaves below a
node are those of its members that own a childless node, and the tokens saved below it
are the words of its members' turns which they do not own; both are plain sums in a
second ROLLUP.

The ids of a node's ends are hashed as a stream: chunks hold the ids of one range of
``IDS`` numbers, at most so many, and pass one after the other.

Defined results: turns are ordered by turn (null first), then by the MD5 of role and of
text, which is short where texts are long; a null role or text is empty; rows without
conv_id belong to no conversation; repeated rows are turns of their own; an empty table
gives no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, staged, table
from tessera.operators.numbering import number_rows

BLOCK = 8
SPAN = 4096
IDS = 1 << 12
SHARED = 3
COLUMNS = [f"t{i}" for i in range(BLOCK)]
NODE = ["depth", "a", "b"]


def _turn() -> Column:
    """STRUCT<a,b,words>: two hashes of a turn and its number of words, which they imply."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return F.struct(F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role").alias("b"), words.alias("words"))


def _at(turn: Column, pos: Column) -> tuple[Column, Column]:
    """The hashes of a turn at a place; 0 where there is no turn."""
    return tuple(F.when(turn.isNotNull(), F.xxhash64(F.lit(i), turn[h], pos)).otherwise(F.lit(0)) for i, h in ((1, "a"), (2, "b")))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv, n, turn``: the turns of every conversation, numbered from 1."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("at"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.select(
        "conv", F.col("at").isNotNull().alias("known"), F.coalesce("at", F.lit(0)).alias("at"),
        F.md5("role").alias("role"), F.md5("text").alias("text"), _turn().alias("turn"),
    )
    return number_rows(rows, ["conv"], ["known", "at", "role", "text"], "n").select("conv", "n", "turn")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv, pos, turn`` of rebuilt conversations; a conversation left without turns has one row without pos."""
    turns = staged(ordered_turns(conversations), "turns")
    shared = F.crc32(F.col("conv").cast("string")) % 4
    convs = turns.select("conv").distinct().withColumns({"base": F.col("conv") - F.col("conv") % 20, "h": shared})
    heads = turns.where(F.col("n") <= SHARED).select(F.col("conv").alias("base"), F.col("n").alias("pos"), "turn")
    # A base is shared by at most 39 conversations and gives each at most three turns.
    taken = convs.join(heads, "base").where("pos <= h").select("conv", "pos", "turn")
    n_taken = taken.groupBy("conv").agg(F.count("*").alias("taken"))
    own = turns.withColumn("h", shared).where("n > h").join(n_taken, "conv", "left")
    own = own.select("conv", (F.col("n") - F.col("h") + F.coalesce("taken", F.lit(0))).alias("pos"), "turn")
    some = taken.unionByName(own)
    none = convs.select("conv").join(some.select("conv").distinct(), "conv", "left_anti")
    return staged(some.unionByName(none, allowMissingColumns=True), "rebuilt")


def _words(turn: Column) -> Column:
    return F.coalesce(turn["words"], F.lit(0))


def blocks(turns: DataFrame) -> DataFrame:
    """One row per conversation and block: its turns as columns, the node it starts from, and the words before it."""
    place = F.coalesce("pos", F.lit(1)) - 1
    cut = turns.withColumns({"block": F.floor(place / BLOCK).cast("long"), "i": place % BLOCK})
    a, b = _at(F.col("turn"), F.col("pos"))
    cut = cut.groupBy("conv", "block").agg(
        F.coalesce(F.max("pos"), F.lit(0)).cast("long").alias("last"),
        F.bit_xor(a).alias("xa"), F.bit_xor(b).alias("xb"), F.sum(_words(F.col("turn"))).alias("xw"),
        *(F.max(F.when(F.col("i") == i, F.col("turn"))).alias(c) for i, c in enumerate(COLUMNS)),
    )
    cut = staged(cut.withColumn("span", F.floor(F.col("block") / SPAN)), "blocks")
    sums = {"a": F.bit_xor, "b": F.bit_xor, "w": F.sum}
    spans = cut.groupBy("conv", "span").agg(F.max("last").alias("last"), *(f(f"x{h}").alias(f"s{h}") for h, f in sums.items()))
    along = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "conv", "span", F.max("last").over(Window.partitionBy("conv")).alias("size"),
        *(F.coalesce(f(f"s{h}").over(along), F.lit(0)).alias(f"s{h}") for h, f in sums.items()),
    )
    inside = Window.partitionBy("conv", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    keyed = cut.withColumns({f"k{h}": F.coalesce(f(f"x{h}").over(inside), F.lit(0)) for h, f in sums.items()})
    keyed = keyed.join(spans, ["conv", "span"])
    keys = {f"k{h}": F.col(f"k{h}").bitwiseXOR(F.col(f"s{h}")) for h in "ab"}
    keyed = keyed.withColumns({**keys, "kw": F.col("kw") + F.col("sw")})
    return staged(keyed.select("conv", "size", "block", "last", "ka", "kb", "kw", "xa", "xb", *COLUMNS), "keyed_blocks")


def rolled_up(rows: DataFrame, sums: str) -> DataFrame:
    """The sums of every node with ``depth, a, b``, its last ``turn`` and the hashes ``pa, pb`` of its parent."""
    names = ", ".join(COLUMNS)
    found = rows.sparkSession.sql(
        f"SELECT block, {BLOCK} - bit_count(grouping_id()) AS k, ka, kb, {names}, {sums} "
        f"FROM {{rows}} GROUP BY block, ka, kb, ROLLUP ({names})",
        rows=rows,
    )
    turn = F.get(F.array(*COLUMNS), F.col("k") - 1)
    # A prefix longer than its conversations is no node, nor is a block's empty prefix, which the block before has.
    found = found.withColumn("turn", turn).where("turn is not null or (k = 0 and block = 0)")
    depth = F.col("block") * BLOCK + F.col("k")
    hashes = [_at(F.col(c), F.col("block") * BLOCK + i + 1) for i, c in enumerate(COLUMNS)]
    found = found.withColumn("depth", depth)
    for h in (0, 1):
        name, whole = "ab"[h], F.col("k" + "ab"[h])
        for pair in hashes:
            whole = whole.bitwiseXOR(pair[h])
        found = found.withColumn(name, whole)
    last = _at(F.col("turn"), F.col("depth"))
    found = found.withColumns({f"p{h}": F.col(h).bitwiseXOR(last[i]) for i, h in enumerate("ab")})
    return found.drop("block", "ka", "kb", *COLUMNS)


def ends(rows: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256`` of the nodes at which conversations end."""
    full = {h: F.col(f"k{h}").bitwiseXOR(F.col(f"x{h}")) for h in "ab"}
    at_end = rows.where("last = size").select(F.col("size").alias("depth"), full["a"].alias("a"), full["b"].alias("b"), "conv")
    chunks = at_end.groupBy(*NODE, F.floor(F.col("conv") / IDS).alias("chunk")).agg(F.collect_list("conv").alias("ids"))
    texts = chunks.select(*NODE, "chunk", F.array_join(F.array_sort("ids").cast("array<string>"), ",").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *now, text in zip(*(batch.column(c).to_pylist() for c in (*NODE, "text"))):
                if now != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = now, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield _rows(out)
        if node:
            yield _rows([(*node, digest.hexdigest())])

    dealt = texts.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return dealt.mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*NODE, "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the empty one included."""
    small_batches(conversations.sparkSession)
    rows = blocks(rebuilt(conversations))
    first = rolled_up(rows, "min(conv) AS conv_id, max(size) AS longest")
    owned = first.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("depth").alias("owned_from"), F.max((F.col("depth") == F.col("longest")).cast("long")).alias("leaf")
    )
    # A conversation that owns nothing is a copy of a smaller one.
    both = rows.join(staged(owned, "owned"), "conv", "left").fillna(0, ["leaf"])
    shared = F.lit(0)
    for i, c in enumerate(COLUMNS):
        free = F.coalesce(F.col("block") * BLOCK + i + 1 < F.col("owned_from"), F.lit(True))
        shared = shared + F.when(free, _words(F.col(c))).otherwise(F.lit(0))
    totals = both.groupBy("conv").agg(F.sum(shared).alias("shared"))
    both, before, saved = both.join(totals, "conv"), F.col("kw"), []
    for i, c in enumerate(COLUMNS):
        saved.append(F.greatest(F.lit(0), F.col("shared") - before).alias(f"s{i}"))
        before = before + _words(F.col(c))
    both = both.select("conv", "block", "ka", "kb", "leaf", *COLUMNS, *saved)
    sums = ", ".join(f"sum(s{i}) AS s{i}" for i in range(BLOCK))
    nodes = rolled_up(both, f"min(conv) AS conv_id, count(*) AS n_convs, sum(leaf) AS n_leaves, {sums}")
    tokens = F.get(F.array(*(f"s{i}" for i in range(BLOCK))), F.greatest(F.col("k") - 1, F.lit(0)))
    nodes = staged(nodes.withColumn("saved_tokens", tokens).drop(*(f"s{i}" for i in range(BLOCK)), "turn", "k"), "nodes")

    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below.agg(F.count("*").alias("n_children")), NODE, "left").join(ends(rows), NODE, "left")
    out = out.join(parents, ["depth", "pa", "pb"], "left")
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        F.col("saved_tokens").cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op13_conversation_trie": op13_conversation_trie}

SQL = {
    "op13_conversation_trie": r"""
WITH turns AS (
  SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role), md5(text)) AS n
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda r, step: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END)), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)),
joined AS (
  SELECT convs.c, 0 AS part, n, role, text FROM convs JOIN turns t ON t.c = base AND n <= h
  UNION ALL SELECT c, 1, n, role, text FROM turns JOIN convs USING (c) WHERE n > h),
steps AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, n) AS depth, md5(role) || md5(text) AS step,
    len(regexp_extract_all(text, '[^ 	-
]+')) AS words FROM joined),
prefixes AS (
  SELECT c, depth, words, md5(string_agg(step, ' ') OVER (PARTITION BY c ORDER BY depth)) AS node FROM steps
  UNION ALL SELECT c, 0, 0, '' FROM convs),
up AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY c) AS size FROM prefixes),
nodes AS (
  SELECT depth, node, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, max(size) = depth AS leaf,
    (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (size = depth), '')) AS ends_sha256
  FROM up GROUP BY depth, node),
inside AS (
  SELECT DISTINCT a.depth, a.node, b.depth AS d2, b.node AS n2 FROM prefixes a JOIN prefixes b ON a.c = b.c AND b.depth >= a.depth),
trees AS (
  SELECT i.depth, i.node, sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM inside i JOIN nodes n ON n.depth = d2 AND n.node = n2 GROUP BY 1, 2),
below AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN trees USING (depth, node) LEFT JOIN below USING (depth, node)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.parent"""
}
