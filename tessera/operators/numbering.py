"""Row numbers, chunks and neighbours for groups of any size.

A plain ``row_number() over (partition by key order by time)`` sends a whole key
to one task.  Here rows are dealt out in ranges of (keys, order), as many as the
data needs: a first pass writes them with their place in the range, a second one
carries one small summary row per (key, range) along the key.  One key may hold
all rows, and all of them may have the same time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

RANGE, PLACE = "_range", "_place"
_IN_PARTITION = (1 << 33) - 1


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows in ranges of (keys, order): adds the range's number and the row's place in it."""
    # Rows that are equal in all these would stay together; the id deals them out as well.
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [*keys, *order, "_tie"]
    number = F.monotonically_increasing_id()
    dealt = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    return written(
        dealt.withColumns({RANGE: F.shiftright(number, 33), PLACE: number.bitwiseAND(F.lit(_IN_PARTITION))}), "ranges"
    )


def _along(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(RANGE)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """1-based row number inside ``keys`` by ``order``; equal rows are numbered in any order.  Keys must not be null."""
    cut, on = in_ranges(df, keys, order), [*keys, RANGE]
    sizes = cut.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(PLACE).alias("_first"))
    before = F.sum("_n").over(_along(keys).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*on, (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    return cut.join(offsets, on).withColumn(name, F.col(PLACE) + F.col("_offset")).drop(RANGE, PLACE, "_offset")


def chunk(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, name: str = "chunk") -> DataFrame:
    """Add a 0-based chunk number: chunks of exactly ``size`` rows, the last shorter."""
    return (
        number_rows(df, keys, order, "_row")
        .withColumn(name, F.floor((F.col("_row") - 1) / size).cast("long"))
        .withColumn("pos", ((F.col("_row") - 1) % size).cast("int"))
        .drop("_row")
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str = "previous"
) -> DataFrame:
    """Add the value of the row before in ``keys``, null on the first row.

    ``value`` should be a struct, so that a null inside it is not read as "none".
    """
    cut, on = in_ranges(df.withColumn("_value", value), keys, order), [*keys, RANGE]
    last = cut.groupBy(*on).agg(F.max_by("_value", PLACE).alias("_last"))
    carried = last.select(*on, F.lag("_last").over(_along(keys)).alias("_carried"))
    inside = Window.partitionBy(*on).orderBy(PLACE)
    return (
        cut.withColumn("_before", F.lag("_value").over(inside))
        .join(carried, on)
        .withColumn(name, F.coalesce("_before", "_carried"))
        .drop(RANGE, PLACE, "_value", "_before", "_carried")
    )


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence, n: int, spread: Column, slices: int = 32
) -> DataFrame:
    """First ``n`` rows per group, also for groups that hold much of the data.

    Every group is ranked in slices first, so the last ranking of a group sees at
    most ``slices * n`` rows; for a small ``n`` the planner cuts the slices down
    before the shuffle as well.
    """
    first = Window.partitionBy(*keys, "_slice").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(slices)))
    cut = cut.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n).drop("_r", "_slice")
    return cut.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= n).drop("_r")
