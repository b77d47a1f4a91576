"""Daily usage states that merge over days.

A day of events becomes two small tables: sums per (day, layer, zoom), and the users of each as
bit maps, which keeps distinct counts exact when days are merged.  Users are numbered once and for
all; a run numbers only those it sees for the first time.  A report reads states instead of
events, so a month costs a month of states.  Writing a day again replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.numbering import number_rows
from tessera.operators.usage import extra_number
from tessera.session import written

CELL = ["layer", "z"]
USERS = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("number", T.LongType())])


def known_users(spark: SparkSession, target: str) -> DataFrame:
    """Users that have a number; none before the first run."""
    try:
        return spark.read.schema(USERS).parquet(f"{target}/users")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], USERS)


def new_users(events: DataFrame, known: DataFrame) -> DataFrame:
    """Users of the events that have no number yet, with the numbers that follow the known ones; from 1."""
    last = known.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    seen = events.select(F.nullif("user_id", F.lit("")).alias("user_id")).where("user_id is not null").distinct()
    fresh = number_rows(seen.join(known, "user_id", "left_anti"), [], ["user_id"], "number")
    return fresh.select("user_id", (F.col("number") + F.lit(last)).alias("number"))


def daily_sums(events: DataFrame) -> DataFrame:
    """Sums per day, layer and zoom, from which totals and averages of any days follow."""
    return events.groupBy(F.to_date("time").alias("day"), *CELL).agg(
        F.count(F.lit(1)).alias("tiles"), F.max("time").alias("last_seen"),
        F.coalesce(F.sum(extra_number("bytes")), F.lit(0.0)).alias("bytes"),
        F.coalesce(F.sum(extra_number("duration")), F.lit(0.0)).alias("duration"),
        F.count(extra_number("duration")).alias("timed"),
    )


def daily_users(events: DataFrame, numbers: DataFrame) -> DataFrame:
    """Bit maps of the users per day, layer and zoom; anonymous events have none.

    Events are reduced to one row per day, cell and user first, partly before the shuffle.
    """
    seen = events.where(F.col("user_id") != "").select(F.to_date("time").alias("day"), *CELL, "user_id").distinct()
    numbered = seen.join(numbers, "user_id")
    return numbered.groupBy("day", *CELL, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("users")
    )


def write_days(events: DataFrame, target: str) -> None:
    """Add the days of the events to the states in ``target``; a day that is there is replaced."""
    spark = events.sparkSession
    known = known_users(spark, target)
    fresh = written(new_users(events, known), "new_users")
    fresh.write.mode("append").parquet(f"{target}/users")
    for name, state in (("sums", daily_sums(events)), ("bitmaps", daily_users(events, known.unionByName(fresh)))):
        # Each day's state is small, and is written as one file.
        state.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{target}/{name}")


def report(sums: DataFrame, users: DataFrame) -> DataFrame:
    """Usage in total, per layer, per zoom and per both, of the days whose states are given.

    ``layer`` and ``z`` are null where a row is over all of them, which ``section`` tells.
    """
    spark = sums.sparkSession
    sets = "GROUPING SETS ((), (layer), (z), (layer, z))"
    section = "CASE grouping(layer) * 2 + grouping(z) WHEN 3 THEN 'total' WHEN 2 THEN 'zoom' WHEN 1 THEN 'layer' ELSE 'layer and zoom' END"
    added = spark.sql(
        f"""SELECT {section} AS section, layer, z, sum(tiles) AS tiles, max(last_seen) AS last_seen,
          cast(round(coalesce(sum(duration) / nullif(sum(timed), 0), 0)) AS int) AS avg_duration_ms,
          cast(round(sum(bytes)) AS bigint) AS total_bytes FROM {{sums}} GROUP BY {sets}""",
        sums=sums,
    )
    # Per bucket first: a bit map has 32,768 users, whatever the days.
    merged = spark.sql(
        """SELECT section, layer, z, sum(bitmap_count(users)) AS users FROM (
          SELECT """ + section + """ AS section, layer, z, bucket, bitmap_or_agg(users) AS users FROM {users}
          GROUP BY GROUPING SETS ((bucket), (layer, bucket), (z, bucket), (layer, z, bucket))) GROUP BY section, layer, z""",
        users=users,
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"u.{c}")) for c in ("section", *CELL)]
    both = added.alias("a").join(merged.alias("u"), same, "left")
    return both.select("a.*", F.coalesce("u.users", F.lit(0)).alias("users"))


def read_report(spark: SparkSession, target: str, first_day=None, last_day=None) -> DataFrame:
    """The report over stored days; days outside are not read."""
    out = []
    for name in ("sums", "bitmaps"):
        state = spark.read.parquet(f"{target}/{name}")
        if first_day is not None:
            state = state.where(F.col("day") >= F.lit(first_day))
        if last_day is not None:
            state = state.where(F.col("day") <= F.lit(last_day))
        out.append(state)
    return report(*out)
