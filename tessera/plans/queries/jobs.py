"""Reading and writing jobs: each writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.keys import store_key
from tessera.operators import raster as r
from tessera.operators import rollup
from tessera.operators import store as st
from tessera.operators.layers import resolve_layers
from tessera.operators.vector import TILE, explode_features, read_features
from tessera.plans import render as jobs
from tessera.plans.queries import raster, sql, store, tiles, usage, vector
from tessera.session import shared_dir
from tessera.sources import derived as d
from tessera.sources import store as source
from tessera.sources.catalog import catalog_frame, load_catalog
from tessera.sources.events import read_tile_events, to_tile_events


def stored_events(spark, sf):
    """Usage events written as a table and read with the declared schema."""
    path = shared_dir(spark, "events")
    to_tile_events(d.tile_requests(spark, sf), d.LAYERS).write.parquet(path)
    return read_tile_events(spark, path).select(
        "event_id", "time", "layer", "z", "x", "y", "user_id", F.col("extra")["bytes"].alias("bytes")
    )


def stored_tiles(spark, sf):
    """A store written in two appends gives back the latest version of each tile."""
    path = shared_dir(spark, "store")
    versions = d.tile_store(spark, sf)
    for part in (0, 1):
        source.write_tile_store(versions.where(F.col("version") % 2 == part), path)
    found = source.read_tile_store(spark, path)
    return found.withColumn("content", F.col("content").cast("string"))


def listed_tiles(spark, sf):
    """Tiles found in a listing of object keys, foreign keys among them."""
    tile = d.tile_requests(spark, sf).select("request_id", *st.TILE)
    key = F.when(F.col("request_id") % 10 == 0, F.lit("readme.txt")).otherwise(store_key("object", "layer_name", "z", "x", "y", "tiles/"))
    listing = tile.select("request_id", key.alias("key"))
    return source.list_tile_store(listing, "object", "tiles/").select(*st.TILE, "request_id")


def boxed_features(spark, sf):
    path = shared_dir(spark, "features")
    d.features(spark, sf).write.parquet(path)
    return read_features(spark, path, attributes=["kind"], bbox=(-60.5, -20.25, 80.0, 45.5))


def boxed_lines(spark, sf):
    path = shared_dir(spark, "lines")
    vector.geometries(spark, sf).write.parquet(path)
    return read_features(spark, path, geometry=["geom"], bbox=(-60.5, -20.25, -40.0, 15.5)).select("gid")


def catalog_file(spark, sf):
    """A catalog written as JSON lines, loaded and used."""
    path = shared_dir(spark, "catalog")
    catalog_frame(spark, d.LAYERS).write.json(path)
    out = resolve_layers(d.tile_requests(spark, sf), load_catalog(spark, path))
    return out.select("request_id", "layer_id", "layer_ord")


def seed_job(spark, sf):
    """Plan, render and store all regions; the summary counts them."""

    def fn(layer, z, x, y, params):
        if (x + y) % 7 == 0:
            raise ValueError("no data")
        return f"{layer}:{z}:{x}:{y}".encode(), "text/plain"

    jobs.register_renderer("job", fn)
    none = d.tile_store(spark, sf).where(F.lit(False))
    now = F.expr(store.NOW)
    return jobs.seed_run(d.regions(spark, sf), none, "job", shared_dir(spark, "seed"), now, on_limit="report")


def vector_job(spark, sf):
    path = shared_dir(spark, "vector")
    jobs.vector_build(d.features(spark, sf), [0, 1], path)
    built = jobs.vector_build(d.features(spark, sf), [2, 4], path)  # zooms of the first build do not stay
    return explode_features(built).groupBy(*TILE).agg(F.count(F.lit(1)).alias("features"), F.max("gid").alias("last"))


def raster_job(spark, sf):
    path = shared_dir(spark, "raster")
    built = jobs.raster_build([raster.base(spark, sf), raster.over(spark, sf)], raster.KEYS, path, "multiply")
    return r.pixels(built, raster.KEYS)


def daily_report(spark, sf):
    """Days of usage written in three runs as mergeable states, then one report over all of them."""
    path = shared_dir(spark, "daily")
    events = to_tile_events(d.tile_requests(spark, sf), d.LAYERS)
    day = F.dayofmonth("time")
    for run in (day <= 10, (day > 10) & (day <= 20), day > 20):
        rollup.write_days(events.where(run), path)
    return rollup.read_report(spark, path)


def audit_job(spark, sf):
    out = jobs.store_audit(d.tile_store(spark, sf), d.previous_store(spark, sf), store._generated(spark, sf))
    return out["changes"]


QUERIES = {
    "stored_events": stored_events,
    "stored_tiles": stored_tiles,
    "listed_tiles": listed_tiles,
    "boxed_features": boxed_features,
    "boxed_lines": boxed_lines,
    "catalog_file": catalog_file,
    "seed_job": seed_job,
    "vector_job": vector_job,
    "raster_job": raster_job,
    "audit_job": audit_job,
    "daily_report": daily_report,
}

W = "WITH "
SQL = {
    "stored_events": W + sql.EV + " SELECT event_id, time, layer, z, x, y, user_id, CAST(bytes AS VARCHAR) AS bytes FROM ev",
    "stored_tiles": store.SQL["latest_tiles"],
    "listed_tiles": W + sql.REQ + " SELECT layer_name, z, x, y, request_id FROM req WHERE request_id % 10 <> 0",
    "boxed_features": W + sql.FEAT + """ SELECT gid, lon, lat, kind FROM feat
      WHERE lon BETWEEN -60.5 AND 80.0 AND lat BETWEEN -20.25 AND 45.5""",
    "boxed_lines": W + sql.FEAT + """ SELECT gid // 10 AS gid FROM feat GROUP BY 1
      HAVING max(lon) >= -60.5 AND min(lon) <= -40.0 AND max(lat) >= -20.25 AND min(lat) <= 15.5""",
    "catalog_file": W + sql.RES + """ SELECT request_id, layer_id, CAST(CASE layer_id WHEN 'osm' THEN 0 WHEN 'osm-topo' THEN 1
      WHEN 'harbour_survey_by_date' THEN 2 WHEN 'counties_by_year' THEN 3 WHEN 'debug-grid' THEN 4 END AS INT) AS layer_ord FROM res""",
    "seed_job": W + tiles.GOOD_PLAN + """, t AS (SELECT DISTINCT layer_name, z, x, y FROM plan)
      SELECT layer_name, z, count(*) AS tiles, count(*) FILTER ((x + y) % 7 <> 0) AS ok,
        count(*) FILTER ((x + y) % 7 = 0) AS failed, CAST(0 AS BIGINT) AS rejected_regions FROM t GROUP BY 1, 2""",
    "vector_job": W + vector._placed("[2, 4]") + " SELECT z, x, y, count(*) AS features, max(gid) AS last FROM placed GROUP BY z, x, y",
    "raster_job": raster.SQL["blend_multiply"],
    "daily_report": W + sql.EV + """ SELECT CASE grouping(layer) * 2 + grouping(z) WHEN 3 THEN 'total' WHEN 2 THEN 'zoom' WHEN 1 THEN 'layer'
        ELSE 'layer and zoom' END AS section, layer, z, count(*) AS tiles, max(time) AS last_seen,
        CAST(round(avg(duration_ms)) AS INT) AS avg_duration_ms, CAST(sum(bytes) AS BIGINT) AS total_bytes,
        count(DISTINCT nullif(user_id, '')) AS users FROM ev GROUP BY GROUPING SETS ((), (layer), (z), (layer, z))""",
    "audit_job": f"""SELECT layer_name, change, count(*) AS tiles FROM ({W}{store._STORE}, {store._PREV},
      {sql.latest('prev', 'o')}, {sql.latest('store', 'n')}
      SELECT layer_name, CASE WHEN o.content <> n.content OR o.content_type <> n.content_type THEN 'changed' ELSE 'same' END AS change
      FROM o JOIN n USING (layer_name, z, x, y)) GROUP BY 1, 2""",
}
