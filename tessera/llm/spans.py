"""Small helpers on half-open spans of words, all in Spark columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_spans(spans: DataFrame, *keys: str) -> DataFrame:
    """Union of the spans ``low`` to ``high`` of each key, as disjoint spans.

    A key is one text, so a group is never larger than a text has words.
    """
    order = Window.partitionBy(*keys).orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce((F.col("low") > before).cast("int"), F.lit(1)))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_island")
