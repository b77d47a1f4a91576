"""Tile cover and seed plans.

Counts come from closed-form ranges per region and zoom, so every guard is
answered before a single tile row exists.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tiles import (
    MAX_LAT,
    MAX_LON,
    as_col,
    let,
    tiles_per_axis,
    zoom_list,
)
from tessera.session import written

# Limits of a seed run.
TILES_PER_ZOOM = 10_000
TILES_PER_ZOOM_FORCED = 2**31 - 1
TILES_PER_RUN = 65_535


def _wrap(lon: Column) -> Column:
    """Shift by 180 until the longitude lies within the world."""
    over = F.greatest(F.ceil((lon - MAX_LON) / MAX_LON), F.lit(0))
    under = F.greatest(F.ceil((-MAX_LON - lon) / MAX_LON), F.lit(0))
    return lon - over * MAX_LON + under * MAX_LON


def _row(lat: Column, n: Column) -> Column:
    rad = F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat)) * math.pi / 180
    return n * (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2


def cover_range(area, z, strict: bool = False) -> Column:
    """STRUCT<x0,x1,y0,y1> of tile numbers covering bounds, the upper ends exclusive.

    The default keeps the established ranges with their edge cases: longitudes
    wrap by 180, the partial easternmost column is left out, a box ending at 180
    may start one column outside the grid and a box across the date line has a
    negative width (``cover_error`` rejects it).  ``strict`` covers every tile
    the box meets and stays inside the grid.
    """
    b, z = as_col(area), as_col(z)
    n = tiles_per_axis(z)

    def held(v, top=n):
        return F.least(top, F.greatest(F.lit(0.0), v))

    north, south = _row(b["north"], n), _row(b["south"], n)
    if strict:
        x0 = held(F.floor(n * (b["west"] + 180) / 360).cast("double"), n - 1)
        x1 = held(F.ceil(n * (b["east"] + 180) / 360).cast("double"))
        y0 = held(F.floor(north).cast("double"), n - 1)
        y1 = held(F.ceil(south).cast("double"))
    else:
        x0 = held(n * ((_wrap(b["west"]) + MAX_LON) / 360))
        x1 = held(n * ((_wrap(b["east"]) + MAX_LON) / 360))
        y0 = held(F.floor(north).cast("double"))
        y1 = held(F.ceil(south).cast("double"))
    ends = F.struct(*[v.cast("int").alias(k) for k, v in (("x0", x0), ("x1", x1), ("y0", y0), ("y1", y1))])

    def upper(lo, hi):
        # An empty span still covers one tile.
        return F.greatest(hi, lo + 1) if strict else F.when(lo == hi, lo + 1).otherwise(hi)

    return let(
        ends,
        lambda e: F.struct(
            e["x0"].alias("x0"), upper(e["x0"], e["x1"]).alias("x1"),
            e["y0"].alias("y0"), upper(e["y0"], e["y1"]).alias("y1"),
        ),
    )


def cover_count(r) -> Column:
    """Tiles in a range; -1 for an inverted one."""
    def count(r):
        wide, high = (r["x1"] - r["x0"]).cast("long"), (r["y1"] - r["y0"]).cast("long")
        return F.when((wide < 0) | (high < 0), F.lit(-1).cast("long")).otherwise(wide * high)

    return let(r, count)


def split_date_line(area) -> Column:
    """Bounds whose west lies east of their east, as two boxes (strict mode)."""
    b = as_col(area)
    left = b.withField("east", F.lit(MAX_LON))
    right = b.withField("west", F.lit(-MAX_LON))
    return F.when(b["west"] > b["east"], F.array(left, right)).otherwise(F.array(b))


def spread_regions(regions: DataFrame) -> DataFrame:
    """Regions dealt out over all cores: a file of few row groups would be planned in as many tasks.

    They are written, since Spark moves the guards' filter in front of a shuffle.
    """
    return written(regions.repartition(3 * regions.sparkSession.sparkContext.defaultParallelism), "regions")


def plan_ranges(regions: DataFrame, strict: bool = False) -> DataFrame:
    """One row per region and zoom with its range and count.  Narrow.

    ``regions`` has (region_id, layer_name, area, zooms) where ``zooms`` is a
    zoom text or an array.  A repeated zoom stays repeated.
    """
    text = dict(regions.dtypes)["zooms"] == "string"
    levels = zoom_list("zooms") if text else F.col("zooms")
    each = regions.select(
        "region_id", "layer_name", "area", F.posexplode(levels).alias("step", "z")
    )
    if strict:
        each = each.withColumn("area", F.explode(split_date_line("area")))
    return each.select(
        "region_id", "layer_name", "step", "z", cover_range("area", "z", strict).alias("range")
    ).withColumn("tiles", cover_count("range"))


def plan_guards(regions: DataFrame, force: bool = False, strict: bool = False) -> DataFrame:
    """Per region: total tiles and the first limit it breaks (null: none).

    A region is one run, so its zooms are folded inside the row; a count that
    cannot be met (inverted range) breaks the limit at any setting.
    """
    guard = _guard(regions, force, strict)
    return regions.select("region_id", "layer_name", guard.alias("g")).select(
        "region_id", "layer_name", F.col("g.total").alias("tiles"), "g.error"
    )


def _guard(regions: DataFrame, force: bool, strict: bool) -> Column:
    text = dict(regions.dtypes)["zooms"] == "string"
    levels = zoom_list("zooms") if text else F.col("zooms")
    counts = F.transform(
        levels,
        lambda z: cover_count(cover_range(F.col("area"), z, strict)),
    )
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("string").alias("error"))

    def step(acc, n):
        zoom_limit = (n < 0) | (n > TILES_PER_ZOOM_FORCED)
        if not force:
            zoom_limit = zoom_limit | (n > TILES_PER_ZOOM) | (acc["total"] > TILES_PER_ZOOM)
        # After the first broken limit nothing more is counted.
        stop = acc["error"].isNotNull() | zoom_limit
        return F.struct(
            F.when(stop, acc["total"]).otherwise(acc["total"] + n).alias("total"),
            F.coalesce(acc["error"], F.when(zoom_limit, F.lit("too many tiles in a zoom"))).alias("error"),
        )

    return let(
        F.aggregate(counts, start, step),
        lambda f: F.struct(
            f["total"].alias("total"),
            F.when(f.isNull(), F.lit("bad zooms"))
            .when(f["error"].isNotNull(), f["error"])
            .when(f["total"] > TILES_PER_RUN, F.lit("too many tiles in a run"))
            .alias("error"),
        ),
    )


def expand_plan(ranges: DataFrame, spread: bool = False) -> DataFrame:
    """Tiles (region_id, layer_name, step, z, x, y) of a range table.

    ``spread`` shuffles after the rows of tiles appear and before their columns
    do, so one huge region is expanded by the whole cluster.
    """
    real = ranges.where(F.col("tiles") > 0)
    rows = real.withColumn(
        "y", F.explode(F.sequence(F.col("range.y0"), F.col("range.y1") - 1))
    )
    if spread:
        rows = rows.repartition("region_id", "step", "y")
    return rows.withColumn(
        "x", F.explode(F.sequence(F.col("range.x0"), F.col("range.x1") - 1))
    ).select("region_id", "layer_name", "step", "z", "x", "y")


class SeedLimitError(ValueError):
    """Regions break a limit; ``rejected`` has one row for each of them."""

    def __init__(self, message: str, rejected: DataFrame):
        super().__init__(message)
        self.rejected = rejected


def seed_plan(
    regions: DataFrame,
    force: bool = False,
    strict: bool = False,
    spread: bool = False,
    on_limit: str = "raise",
) -> DataFrame:
    """Tiles of the regions.

    With ``on_limit="raise"`` a region over a limit is an error before anything is planned; with
    ``"report"`` the others are planned and ``rejected_regions`` gives the rest with their reasons.
    """
    if on_limit not in ("raise", "report"):
        raise ValueError(f"on_limit is raise or report, not {on_limit!r}")
    if on_limit == "raise":
        check_plan(regions, force, strict)
    return expand_plan(plan_ranges(within_limits(regions, force, strict), strict), spread)


def within_limits(regions: DataFrame, force: bool = False, strict: bool = False) -> DataFrame:
    """Regions that pass the guards; a narrow filter, ``rejected_regions`` are the others."""
    guard = _guard(regions, force, strict)
    return regions.withColumn("_guard", guard).where(F.col("_guard.error").isNull()).drop("_guard")


def rejected_regions(regions: DataFrame, force: bool = False, strict: bool = False) -> DataFrame:
    """Regions that break a limit, with the tiles counted up to there and the reason."""
    return plan_guards(regions, force, strict).where(F.col("error").isNotNull())


def check_plan(regions: DataFrame, force: bool = False, strict: bool = False) -> None:
    """Raise ``SeedLimitError`` when any region breaks a limit."""
    bad = rejected_regions(regions, force, strict)
    counts = {r["error"]: r["count"] for r in bad.groupBy("error").count().collect()}  # one row per reason
    if counts:
        told = ", ".join(f"{n} with {why}" for why, n in sorted(counts.items()))
        raise SeedLimitError(f"{sum(counts.values())} regions break a limit: {told}", bad)


def plan_summary(plan: DataFrame) -> DataFrame:
    """Planned tiles per layer and zoom."""
    return plan.groupBy("layer_name", "z").agg(F.count(F.lit(1)).alias("tiles"))


def summary_from_ranges(ranges: DataFrame) -> DataFrame:
    """``plan_summary`` from closed-form counts, without expanding the plan."""
    return (
        ranges.where(F.col("tiles") > 0)
        .groupBy("layer_name", "z")
        .agg(F.sum("tiles").alias("tiles"))
    )


def row_ranges(ranges: DataFrame) -> DataFrame:
    """``layer_name, z, y, x0, x1`` of every row of tiles in a range table; x1 is the tile after the last."""
    rows = ranges.where(F.col("tiles") > 0).withColumn("y", F.explode(F.sequence(F.col("range.y0"), F.col("range.y1") - 1)))
    return rows.select("layer_name", "z", "y", F.col("range.x0").alias("x0"), F.col("range.x1").alias("x1"))


def missing_ranges(ranges: DataFrame, store: DataFrame) -> DataFrame:
    """What a plan has and a store lacks, as row ranges: ``layer_name, z, y, x0, x1``, disjoint and as long as can be.

    No tile of the plan appears as a row, so a plan of zoom 21 costs its rows and the tiles that
    the store has in them.  Ranges that several regions share count once.  Along a row the ends of
    planned ranges and of stored tiles are swept from west to east; a row holds at most 2**21 tiles.
    """
    row = ["layer_name", "z", "y"]
    planned = row_ranges(ranges.select("layer_name", "z", "range", "tiles").distinct()).distinct()
    held = store.select(*row, "x").join(planned.select(*row).distinct(), row, "left_semi")
    none = F.lit(0).cast("long")

    def ends(df: DataFrame, first: Column, after: Column, name: str) -> DataFrame:
        at = F.inline(F.array(F.struct(first.alias("x"), F.lit(1).alias("d")), F.struct(after.alias("x"), F.lit(-1).alias("d"))))
        both = df.select(*row, at)
        return both.select(*row, "x", *((F.col("d").cast("long") if c == name else none).alias(c) for c in ("plan", "have")))

    swept = ends(planned, F.col("x0"), F.col("x1"), "plan").unionByName(ends(held, F.col("x"), F.col("x") + 1, "have"))
    swept = swept.groupBy(*row, "x").agg(F.sum("plan").alias("plan"), F.sum("have").alias("have"))
    along = Window.partitionBy(*row).orderBy("x")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    lacking = (F.sum("plan").over(so_far) > 0) & (F.sum("have").over(so_far) == 0)
    # The last place of a row ends everything, so it never lacks and every stretch has an end.
    marked = swept.select(*row, "x", lacking.alias("lacking"))
    turns = marked.withColumn("before", F.coalesce(F.lag("lacking").over(along), F.lit(False)))
    turns = turns.where(F.col("lacking") != F.col("before"))
    closed = turns.select(*row, F.col("x").alias("x0"), "lacking", F.lead("x").over(along).alias("x1"))
    return closed.where("lacking").select(*row, F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))

