"""Vector tiles from feature tables: tile assignment, quantising, clipping, assembly.

Features meet tiles through a tile key computed from their own extent, never
through a theta join.  Positions are held in tile units (``u`` right, ``v`` down)
of the zoom, so the tile origin is just the tile number.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.tiles import MERCATOR_HALF, as_col, lat_to_3857, lon_to_3857, tiles_per_axis
from tessera.operators.geometry import clip_to_tiles
from tessera.operators.numbering import top_per_group

EXTENT = 4096
BUFFER = 0.125
#: Parts of a tile, unless told otherwise.
PARTS = 8
#: Features of a row at most; larger parts of a tile come in slices.
FEATURES = 50_000

TILE = ["z", "x", "y"]


def read_features(
    spark: SparkSession,
    table: str,
    gid: str = "gid",
    geometry: Sequence[str] = ("lon", "lat"),
    attributes: Sequence[str] = (),
    where: str | None = None,
    bbox: tuple[float, float, float, float] | None = None,
    jdbc: dict | None = None,
) -> DataFrame:
    """Feature table from Parquet (or JDBC): only the listed columns are read.

    ``bbox`` is (west, south, east, north); on plain lon/lat columns it becomes a
    pushed filter that skips row groups, on a geometry column it keeps features
    whose own box meets it.
    """
    if jdbc is not None:
        source = spark.read.format("jdbc").options(dbtable=table, **jdbc).load()
    else:
        source = spark.read.parquet(table)
    if where:
        source = source.where(where)
    if bbox and len(geometry) == 2:
        west, south, east, north = bbox
        lon, lat = (F.col(c) for c in geometry)
        source = source.where(lon.between(west, east) & lat.between(south, north))
    elif bbox:
        west, south, east, north = bbox
        x, y = F.col(f"{geometry[0]}.coords.x"), F.col(f"{geometry[0]}.coords.y")
        source = source.where(
            (F.array_max(x) >= west) & (F.array_min(x) <= east) & (F.array_max(y) >= south) & (F.array_min(y) <= north)
        )
    return source.select(F.col(gid).alias("gid"), *geometry, *attributes)


def _tile_span(lo: Column, hi: Column, margin: float, n: Column) -> Column:
    """Numbers of the tiles whose widened range may meet [lo, hi], a part of [0, n]."""
    first_tile = F.greatest(F.floor(lo - 1 - margin).cast("int"), F.lit(0))
    last_tile = F.least(F.floor(hi + margin).cast("int"), (n - 1).cast("int"))
    return F.sequence(first_tile, last_tile)


def _zoomed(features: DataFrame, zooms: Iterable[int]) -> DataFrame:
    levels = F.array(*[F.lit(int(z)) for z in zooms])
    return features.withColumn("z", F.explode(levels))


def points_to_tiles(
    points: DataFrame, zooms: Iterable[int], buffer: float = BUFFER, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """One row per point and tile whose buffered envelope holds it.

    Adds z, x, y and the point's position (u, v).  A point meets at most four
    tiles per zoom, so the expansion is narrow and bounded.
    """
    half = buffer / 2
    n = tiles_per_axis("z")
    scale = n / (2 * MERCATOR_HALF)
    placed = (
        _zoomed(points.withColumns({"_mx": lon_to_3857(lon), "_my": lat_to_3857(lat)}), zooms)
        .withColumn("u", (F.col("_mx") + MERCATOR_HALF) * scale)
        .withColumn("v", (MERCATOR_HALF - F.col("_my")) * scale)
        # The envelope is confined to the projected world.
        .where(F.col("u").between(F.lit(0.0), n) & F.col("v").between(F.lit(0.0), n))
        .withColumn("x", F.explode(_tile_span(F.col("u"), F.col("u"), half, n)))
        .withColumn("y", F.explode(_tile_span(F.col("v"), F.col("v"), half, n)))
    )
    inside = F.col("u").between(F.col("x") - half, F.col("x") + 1 + half) & F.col("v").between(
        F.col("y") - half, F.col("y") + 1 + half
    )
    return placed.where(inside).drop("_mx", "_my")


def quantise(u, v, x, y, extent: int = EXTENT) -> Column:
    """STRUCT<qx,qy>: whole-number position inside the tile, y down."""
    return F.struct(
        F.floor((as_col(u) - as_col(x)) * extent).cast("int").alias("qx"),
        F.floor((as_col(v) - as_col(y)) * extent).cast("int").alias("qy"),
    )


def clip_margin(buffer: float = BUFFER, extent: int = EXTENT) -> int:
    """Width in units of the strip around a tile that clipping keeps."""
    return int(buffer * extent)


def select_features(
    tiled: DataFrame, attributes: Sequence[str] = (), where: str | None = None, params: dict | None = None
) -> DataFrame:
    """Keep gid, position and the listed attributes; filter on any column or parameter.

    The filter runs after tile assignment, so z, x and y are columns; ``:name``
    values are bound as literals, never pasted into the text.
    """
    if where:
        tiled = _filtered(tiled, where, params)
    return tiled.select(*TILE, "gid", "u", "v", *attributes)


def _filtered(tiled: DataFrame, where: str, params: dict | None) -> DataFrame:
    for name, value in (params or {}).items():
        where = where.replace(f":{name}", f"`_p_{name}`")
        tiled = tiled.withColumn(f"_p_{name}", F.lit(value))
    return tiled.where(where)


def assemble_tiles(
    placed: DataFrame, feature: Column, layer: str | Column = "features", parts: int = PARTS, spread: Column | None = None,
    most: int | None = None,
) -> DataFrame:
    """Collect features per tile as (layer, z, x, y, part, n, features).

    Every tile comes in up to ``parts`` parts, by the hash of the feature's id (or
    ``spread``), and a part of more than ``FEATURES`` features in slices.  The plan is the same
    for any size: rows are dealt out in ranges of (layer, tile, part, gid), so a range holds
    many small tiles or a slice of a large one, and gathered where they lie.  Slice numbers
    leave gaps; ``part % parts`` is the declared part.  Where a tile is known to have at most
    ``most`` features, and they are few, one shuffle by tile does.  ``layer`` may be a column,
    which builds several layers in one pass.
    """
    if parts < 1:
        raise ValueError("a tile has at least one part")
    number = F.pmod(F.xxhash64("gid") if spread is None else spread, F.lit(parts)).cast("long")
    name = layer if isinstance(layer, Column) else F.lit(layer)
    by = ["layer", *TILE, "part"]
    rows = placed.select(name.alias("layer"), *TILE, number.alias("part"), "gid", feature.alias("feature"))
    if most is not None and most <= FEATURES:
        gathered = rows.groupBy(*by).agg(
            F.count(F.lit(1)).cast("int").alias("n"), F.sort_array(F.collect_list("feature")).alias("features")
        )
        return gathered.select(*by, "n", "features")
    rows = rows.withColumn("_tie", F.xxhash64("feature"))
    order = [*by, "gid", "_tie"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*by, "feature")
    kind = dealt.schema["feature"].dataType.simpleString()
    return dealt.mapInArrow(
        _gather(by, parts, FEATURES), f"layer string, z int, x int, y int, part long, n int, features array<{kind}>"
    )


def _gather(by: Sequence[str], parts: int, most: int):
    """Sorted rows to one row per key with its features as a list, ``most`` at a time."""

    def gather(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        # A range's first key may go on from the range before, so its slices have numbers of their own.
        first = TaskContext.get().partitionId() << 20
        held, leading, done = None, True, 0

        def made(table, starts, ends, numbers):
            lists = pa.ListArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), table.column("feature").combine_chunks())
            keys = table.take(pa.array(starts)).select(by[:-1]).combine_chunks()
            declared = table.column("part").take(pa.array(starts)).to_numpy()
            return pa.RecordBatch.from_arrays(
                [
                    *(keys.column(c).combine_chunks() for c in by[:-1]),
                    pa.array(declared + parts * np.asarray(numbers, np.int64)), pa.array(np.subtract(ends, starts), pa.int32()), lists,
                ],
                [*by, "n", "features"],
            )

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            table = table.combine_chunks()
            new = np.zeros(len(table), bool)
            for c in by:
                codes = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(table)]
            starts, numbers = [], []
            for low, high in zip(cuts[:-1], cuts[1:]):
                base, count = first if leading and low == 0 else 0, done if low == 0 else 0
                for at in range(low, high, most):
                    starts.append(at)
                    numbers.append(base + count)
                    count += 1
            leading, done = leading and len(cuts) == 2, count - 1
            if len(starts) > 1:
                yield made(table.slice(0, starts[-1]), starts[:-1], starts[1:], numbers[:-1])
            held, last = table.slice(starts[-1]), numbers[-1]
        if held is not None:
            yield made(held, [0], [len(held)], [last])

    return gather


def build_vector_tiles(
    points: DataFrame,
    zooms: Iterable[int],
    extent: int = EXTENT,
    buffer: float = BUFFER,
    limit: int = 0,
    attributes: Sequence[str] = (),
    where: str | None = None,
    params: dict | None = None,
    layer: str | Column = "features",
    parts: int = PARTS,
    spread: Column | None = None,
) -> DataFrame:
    """Vector tiles of a point table in one scan; a tile without features gives no row.

    A ``layer`` column must be among the attributes; a limit holds for a tile of
    one layer.
    """
    placed = select_features(points_to_tiles(points, zooms, buffer), attributes, where, params)
    if limit:
        by = TILE
        if isinstance(layer, Column):
            placed, by, layer = placed.withColumn("_layer", layer), [*TILE, "_layer"], F.col("_layer")
        placed = top_per_group(placed, by, ["gid", "u", "v"], limit, F.col("gid"))
    position = quantise("u", "v", "x", "y", extent)
    feature = F.struct(
        "gid", position["qx"].alias("qx"), position["qy"].alias("qy"), *attributes
    )
    return assemble_tiles(placed, feature, layer, parts, spread, limit or None)


def build_geometry_tiles(
    features: DataFrame,
    zooms: Iterable[int],
    extent: int = EXTENT,
    buffer: float = BUFFER,
    attributes: Sequence[str] = (),
    where: str | None = None,
    params: dict | None = None,
    layer: str | Column = "features",
    parts: int = PARTS,
    spread: Column | None = None,
) -> DataFrame:
    """Vector tiles of a table of points, lines, polygons and boxes; every feature has its ``kind`` and clipped ``paths``."""
    placed = clip_to_tiles(features, zooms, extent, buffer, attributes)
    if where:
        placed = _filtered(placed, where, params)
    return assemble_tiles(placed, F.struct("gid", "kind", *attributes, "paths"), layer, parts, spread)


def explode_features(tiles: DataFrame) -> DataFrame:
    return tiles.select("layer", *TILE, F.inline("features"))


def composite_vector(inputs: Sequence[DataFrame]) -> DataFrame:
    """Tiles of several vector layers side by side, in the declared order.

    Contents stay as they are; ``skip_cache`` of a tile is true when any input's
    is.  Layers are rows of the tile, so nothing is gathered.
    """
    union = None
    for i, tiles in enumerate(inputs):
        if "skip_cache" not in tiles.columns:
            tiles = tiles.withColumn("skip_cache", F.lit(False))
        tiles = tiles.withColumn("ord", F.lit(i))
        union = tiles if union is None else union.unionByName(tiles, allowMissingColumns=True)
    return _with_flags(union)


def _with_flags(tiles: DataFrame) -> DataFrame:
    """``skip_cache``: whether any part of the tile, of whatever layer, is not to be cached.

    Only flags are gathered per tile; the tiles' contents meet the few tiles with a flag in a join.
    """
    flagged = tiles.where("skip_cache").select(*TILE).distinct().withColumn("_flag", F.lit(True))
    return tiles.drop("skip_cache").join(flagged, TILE, "left").withColumnRenamed("_flag", "skip_cache").fillna(
        False, ["skip_cache"]
    )


def layered_tiles(
    points: DataFrame, zooms: Iterable[int], layer: Column, order: Sequence[str], skip_cache: Column | None = None, **options
) -> DataFrame:
    """Composite tiles of one feature table whose column names the layer, in one scan.

    ``order`` lists the layers in their declared order; others are left out.
    """
    names = F.array(*[F.lit(v) for v in order])
    rows = points.withColumn("_layer", layer).where(F.array_contains(names, F.col("_layer")))
    attributes = [*options.pop("attributes", ()), "_layer"]
    tiles = build_vector_tiles(rows, zooms, layer=F.col("_layer"), attributes=attributes, **options)
    tiles = tiles.withColumn("features", F.transform("features", lambda f: f.dropFields("_layer")))
    tiles = tiles.withColumn("ord", (F.array_position(names, F.col("layer")) - 1).cast("int"))
    skip = F.lit(False) if skip_cache is None else skip_cache
    return _with_flags(tiles.withColumn("skip_cache", skip))


# -- boxes --------------------------------------------------------------------


def geoms_to_tiles(features: DataFrame, zooms: Iterable[int], buffer: float = BUFFER) -> DataFrame:
    """Tiles that the box around ``geom STRUCT<kind, coords ARRAY<STRUCT<x,y>>>`` meets.

    Adds z, x and y; ``geometry.clip_to_tiles`` makes the exact test for lines and
    polygons and cuts them.
    """
    half = buffer / 2
    n = tiles_per_axis("z")
    scale = n / (2 * MERCATOR_HALF)
    def across(lon):
        return (lon_to_3857(lon) + MERCATOR_HALF) * scale

    def down(lat):
        return (MERCATOR_HALF - lat_to_3857(lat)) * scale

    # Both projections keep order, so the box is projected, not every point.
    x, y = F.col("geom.coords.x"), F.col("geom.coords.y")
    boxed = _zoomed(features, zooms).withColumns(
        {
            "_u0": across(F.array_min(x)), "_u1": across(F.array_max(x)),
            "_v0": down(F.array_max(y)), "_v1": down(F.array_min(y)),
        }
    ).where((F.col("_u1") >= 0) & (F.col("_u0") <= n) & (F.col("_v1") >= 0) & (F.col("_v0") <= n))
    tiled = boxed.withColumn(
        "x", F.explode(_tile_span(F.greatest("_u0", F.lit(0.0)), F.least("_u1", n), half, n))
    ).withColumn(
        "y", F.explode(_tile_span(F.greatest("_v0", F.lit(0.0)), F.least("_v1", n), half, n))
    )
    meets = (
        (F.col("_u1") >= F.col("x") - half)
        & (F.col("_u0") <= F.col("x") + 1 + half)
        & (F.col("_v1") >= F.col("y") - half)
        & (F.col("_v0") <= F.col("y") + 1 + half)
    )
    return tiled.where(meets).drop("_u0", "_u1", "_v0", "_v1")
