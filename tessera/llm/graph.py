"""Connected components of an edge table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, staged


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, comp`` for every node of the edges ``a, b``; ``comp`` is the smallest node reached.

    Rounds alternate between linking all larger neighbours of a node to its smallest neighbour and
    linking all smaller ones to it, until every node hangs directly below its smallest; edges that
    are such stars already need none.  A node with very many edges is reduced to its minimum before
    the shuffle, and the join back to its edges is an ordinary one which the adaptive planner splits.
    Every round is written, so nothing is computed twice, and takes the place of the one before.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    now = staged(both.distinct(), name)
    while not hanging(now):
        links = now.select(F.col("high").alias("node"), F.col("low").alias("other"))
        links = links.unionByName(now.select(F.col("low").alias("node"), F.col("high").alias("other")))
        least = links.groupBy("node").agg(F.min("other").alias("least"))
        least = least.select("node", F.least("node", "least").alias("least"))
        larger = links.where("other > node").join(least, "node").select(F.col("other").alias("high"), F.col("least").alias("low"))
        # One row for each of ``now``, so repeated ones may wait for the second half of the round.
        larger = staged(larger, name)
        discard(now)

        met = larger.join(larger.groupBy("high").agg(F.min("low").alias("least")), "high")
        ends = F.array(F.struct(F.col("low").alias("high"), F.col("least").alias("low")), F.struct("high", F.col("least").alias("low")))
        now = staged(met.select(F.inline(ends)).where("low <> high").distinct(), name)
        discard(larger)
    roots = now.select(F.col("low").alias("node"), F.col("low").alias("comp")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("comp")).unionByName(roots)


def hanging(edges: DataFrame) -> bool:
    """Whether every node hangs below one other, and nothing hangs below that node but leaves."""
    ends = edges.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("low").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up > 0 and down > 0)").isEmpty()
