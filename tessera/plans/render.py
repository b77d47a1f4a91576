"""User extension points and the batch jobs built from the operators."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.functions.tiles import MAX_LAT
from tessera.operators.raster import blend_tiles
from tessera.operators.store import (
    TILE,
    fresh_tiles,
    latest_tiles,
    missing_tiles,
    snapshot_diff,
    store_stats,
    verify_store,
)
from tessera.operators.usage import (
    error_breakdown,
    reconcile,
    service_counters,
    usage_by_layer,
    usage_by_layer_zoom,
    usage_by_zoom,
    usage_totals,
)
from tessera.operators.vector import build_geometry_tiles, build_vector_tiles
from tessera.plans.seed import check_plan, rejected_regions, seed_plan
from tessera.sources.store import write_tile_store

Renderer = Callable[[str, int, int, int, Mapping], tuple[bytes, str]]
_RENDERERS: dict[str, Renderer] = {}


def register_renderer(name: str, fn: Renderer) -> None:
    """Register ``fn(layer, z, x, y, params) -> (content, content_type)``."""
    _RENDERERS[name] = fn


def render(plan: DataFrame, renderer: str, params: Mapping | None = None) -> DataFrame:
    """Run a renderer over planned tiles.

    A tile that raises becomes a row with ``error`` and no content; the run goes
    on.  Parallelism is the plan's partitioning.
    """
    fn, settings = _RENDERERS[renderer], dict(params or {})
    schema = (
        "layer_name string, z int, x int, y int, content binary, content_type string, error string"
    )

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for layer, z, x, y in pdf[TILE].itertuples(index=False):
                try:
                    content, kind = fn(layer, int(z), int(x), int(y), settings)
                    if content is None:
                        raise ValueError("the tile is empty")
                    out.append((layer, z, x, y, content, kind, None))
                except Exception as exc:  # noqa: BLE001 - reported as data
                    out.append((layer, z, x, y, None, None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(out, columns=[*TILE, "content", "content_type", "error"])

    return plan.select(*TILE).mapInPandas(run, schema)


def tile_cover_udtf():
    """Python table function ``(west, south, east, north, zoom) -> (x, y)`` for SQL callers.

    Strict cover of a box.  DataFrame code should use ``expand_plan`` instead.
    """

    @udtf(returnType="x: int, y: int")
    class TileCover:
        def eval(self, west: float, south: float, east: float, north: float, zoom: int):
            n = 2**zoom

            def row(lat):
                rad = math.radians(max(-MAX_LAT, min(MAX_LAT, lat)))
                return n * (1 - math.log(math.tan(rad) + 1 / math.cos(rad)) / math.pi) / 2

            def span(lo, hi):
                first = min(n - 1, max(0, math.floor(lo)))
                return range(first, max(first + 1, min(n, math.ceil(hi))))

            for y in span(row(north), row(south)):
                for x in span(n * (west + 180) / 360, n * (east + 180) / 360):
                    yield x, y

    return TileCover


def register_tile_cover(spark: SparkSession, name: str = "tile_cover") -> None:
    spark.udtf.register(name, tile_cover_udtf())


# -- jobs ---------------------------------------------------------------------

def seed_run(
    regions: DataFrame,
    store: DataFrame,
    renderer: str,
    target: str,
    now,
    params: Mapping | None = None,
    force: bool = False,
    ttl_seconds: int | None = None,
    on_limit: str = "raise",
    run_id: str | None = None,
) -> DataFrame:
    """Render the planned tiles the store lacks and store them; gives one summary per layer and zoom.

    The rendered tiles are written once, status included, and the summary reads
    that table, so a lost executor never renders twice for the report.  Every run
    has its own results folder.  Regions over a limit fail the run before it
    starts; with ``on_limit="report"`` they are written beside the results and
    counted in the summary, one row per layer without a zoom.
    """
    spark = regions.sparkSession
    if on_limit == "raise":
        check_plan(regions, force)
    plan = seed_plan(regions, force=force, spread=True, on_limit="report").select(*TILE).distinct()
    todo = missing_tiles(plan, store, ttl_seconds, now)
    rendered = render(todo, renderer, params).withColumns(
        {"written_at": F.lit(now), "version": F.lit(0).cast("long")}
    )
    run_id = run_id or uuid.uuid4().hex
    results = f"{target}/results/run={run_id}"
    rendered.write.mode("overwrite").parquet(results)
    rejected = f"{target}/rejected/run={run_id}"
    rejected_regions(regions, force).write.mode("overwrite").parquet(rejected)
    done = spark.read.parquet(results)
    write_tile_store(done, f"{target}/tiles")
    none = F.lit(0).cast("long")
    made = done.groupBy("layer_name", "z").agg(
        F.count(F.lit(1)).alias("tiles"),
        F.count_if(F.col("error").isNull()).alias("ok"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        none.alias("rejected_regions"),
    )
    left = spark.read.parquet(rejected).groupBy("layer_name").agg(F.count(F.lit(1)).alias("rejected_regions"))
    return made.unionByName(
        left.select(
            "layer_name", F.lit(None).cast("int").alias("z"), none.alias("tiles"), none.alias("ok"), none.alias("failed"),
            "rejected_regions",
        )
    )


def vector_build(features: DataFrame, zooms: Iterable[int], target: str, **options) -> DataFrame:
    """Build vector tiles and write them by zoom; returns the written table.

    ``features`` are points with lon and lat, or have a ``geom`` of any kind.  The whole target
    is replaced: zooms of an earlier build do not stay.
    """
    build = build_geometry_tiles if "geom" in features.columns else build_vector_tiles
    tiles = build(features, zooms, **options)
    tiles.withColumn("zoom", F.col("z")).hint("rebalance", "zoom").write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("zoom").parquet(target)
    return features.sparkSession.read.parquet(target).drop("zoom")


def raster_build(
    inputs: Sequence[DataFrame], keys: Sequence[str], target: str, mode: str = "normal", opacity: float = 0.0
) -> DataFrame:
    """Blend raster layers tile to tile and write the tiles; returns the written table.

    Nothing is shuffled after the inputs' tiles have met.
    """
    blend_tiles(inputs, keys, mode, opacity).write.mode("overwrite").parquet(target)
    return inputs[0].sparkSession.read.parquet(target)


def store_audit(versions: DataFrame, previous: DataFrame, generated: DataFrame) -> dict[str, DataFrame]:
    """Latest tiles, what changed, whether writes read back, and statistics."""
    current = latest_tiles(versions)
    return {
        "changes": snapshot_diff(latest_tiles(previous), current).groupBy("layer_name", "change").agg(
            F.count(F.lit(1)).alias("tiles")
        ),
        "verified": verify_store(generated, current),
        "stats": store_stats(current),
    }


EVENT_RETENTION_DAYS = 90


def retain_events(events: DataFrame, now, days: int = EVENT_RETENTION_DAYS) -> DataFrame:
    """Events not older than ``days``; a plain range filter that reaches the scan."""
    return events.where(F.col("time") >= F.timestamp_add("DAY", F.lit(-days), now))


def retain_tiles(store: DataFrame, ttl_seconds: int, now) -> DataFrame:
    return fresh_tiles(store, ttl_seconds, now)


def daily_report(events: DataFrame, lookups: DataFrame, classified: DataFrame, served: DataFrame) -> dict[str, DataFrame]:
    """The dashboard reports and the reconciliation, as views of one day or any filter."""
    return {
        "totals": usage_totals(events),
        "by_layer": usage_by_layer(events),
        "by_zoom": usage_by_zoom(events),
        "by_layer_zoom": usage_by_layer_zoom(events),
        "counters": service_counters(lookups),
        "errors": error_breakdown(classified),
        "reconciliation": reconcile(served, events),
    }


