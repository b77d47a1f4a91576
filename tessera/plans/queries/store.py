"""Tile-store queries: lookups, diffs, validation, freshness, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.tiles import bounds, tile_intersects
from tessera.operators import store as st
from tessera.plans.queries import sql, tiles
from tessera.plans.queries.usage import lookups
from tessera.plans.render import register_renderer, render, retain_tiles
from tessera.plans.seed import seed_plan
from tessera.sources import derived as d
from tessera.sources.store import storable, unchanged_removed

NOW = "TIMESTAMP_NTZ '2024-01-20 12:00:00'"
TTL = 6 * 86_400


def latest(spark, sf, every=3):
    return st.latest_tiles(d.tile_store(spark, sf, every))


def latest_tiles(spark, sf):
    return latest(spark, sf).withColumn("content", F.col("content").cast("string"))


def cache_lookup(spark, sf):
    return lookups(spark, sf).select("request_id", "layer_id", "hit")


def tiered_lookup(spark, sf):
    tiers = [d.tile_store(spark, sf), d.tile_store(spark, sf, 2)]
    return st.tiered_lookup(d.tile_requests(spark, sf), tiers).select("request_id", "hit_tier")


def tiered_content(spark, sf):
    tiers = [latest(spark, sf), latest(spark, sf, 2)]
    asked = d.tile_requests(spark, sf).drop("content_type")
    out = st.tiered_content(asked, tiers)
    return out.select(
        "request_id", "hit_tier", F.col("content").cast("string").alias("content"), "content_type"
    )


def _single(spark, sf, layer, every):
    rows = latest(spark, sf, every).where(F.col("layer_name") == layer)
    return rows.select(
        "z", "x", "y", "content", F.when(F.col("version") % 5 == 0, F.lit("bad")).alias("error")
    )


def fallback_tiles(spark, sf):
    tiles = d.tile_requests(spark, sf).where(F.col("layer_name") == "osm").select("z", "x", "y").distinct()
    area = bounds(-60, 70, -120, 150)
    out = None
    for mode in st.CACHE_MODES:
        part = st.fallback(
            tiles, _single(spark, sf, "osm", 1), _single(spark, sf, "osm-topo", 1),
            F.col("z").between(2, 9), tile_intersects("z", "x", "y", area), mode,
        ).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("content", F.col("content").cast("string"))


def snapshot_diff(spark, sf):
    old = st.latest_tiles(d.previous_store(spark, sf).where("version % 5 <> 0"))
    new = st.latest_tiles(d.tile_store(spark, sf).where("version % 4 <> 0"))
    return st.snapshot_diff(old, new).select(*st.TILE, "change")


def change_points(spark, sf):
    seen = d.previous_store(spark, sf)
    return st.change_points(seen).select(*st.TILE, "version", "content_type")


def _expectations(spark, sf):
    i = F.col("request_id")
    key = F.concat_ws("/", "layer_name", "z", "x", "y")
    mode = F.get(F.array(*[F.lit(m) for m in ("content-type", "base-64", "file", "success", "same")]), (i % 5).cast("int"))
    wanted = (
        F.when(i % 5 == 0, F.lit("image/png"))
        .when(i % 5 == 1, F.base64(F.concat(key, F.when(i % 3 == 0, F.lit("!")).otherwise(F.lit(""))).cast("binary")))
        .when(i % 5 == 2, F.sha2(key.cast("binary"), 256))
    )
    return d.tile_requests(spark, sf).select(
        F.col("request_id").alias("check_id"), *st.TILE, mode.alias("validation"), wanted.alias("expected")
    )


def validate_tiles(spark, sf):
    before = st.latest_tiles(d.previous_store(spark, sf))
    checks = st.validate_tiles(latest(spark, sf), _expectations(spark, sf), before)
    return checks.select("check_id", "validation", "error")


def _generated(spark, sf):
    extra = d.tile_store(spark, sf, 5).where("version % 3 <> 0")
    made = st.latest_tiles(d.previous_store(spark, sf).unionByName(extra))
    return made.select(
        *st.TILE, "content", F.when(F.col("version") % 11 == 0, F.lit("upstream")).alias("error"),
        (F.col("version") % 13 != 0).alias("written"),
    )


def verify_store(spark, sf):
    return st.verify_store(_generated(spark, sf), latest(spark, sf))


def verify_summary(spark, sf):
    return st.verify_summary(verify_store(spark, sf))


def _plan(spark, sf):
    # The plan covers every tile ever asked for.
    return d.tile_requests(spark, sf).select(*st.TILE).distinct()


def missing_tiles(spark, sf):
    return st.missing_tiles(_plan(spark, sf), latest(spark, sf), TTL, F.expr(NOW))


def present_tiles(spark, sf):
    return st.present_tiles(_plan(spark, sf), latest(spark, sf))


def collisions(spark, sf):
    i = F.col("request_id")
    mark = F.get(F.array(F.lit("/"), F.lit(" "), F.lit("_"), F.lit("..")), (i % 4).cast("int"))
    names = d.tile_requests(spark, sf).select(F.concat("layer_name", mark, F.col("user_id")).alias("layer_name"))
    return st.collisions(names)


def first_fetches(spark, sf):
    return st.first_fetches(d.tile_requests(spark, sf), 86_400)


def render_plan(spark, sf):
    def checker(layer, z, x, y, params):
        if (x + y) % params["fail"] == 0:
            raise ValueError("no data")
        return f"{layer}:{z}:{x}:{y}".encode(), "text/plain"

    register_renderer("checker", checker)
    plan = seed_plan(d.regions(spark, sf), on_limit="report").select(*st.TILE).distinct()
    return render(plan, "checker", {"fail": 7}).withColumn("content", F.col("content").cast("string"))


def tiles_to_write(spark, sf):
    fresh = latest(spark, sf).withColumns(
        {"skip_cache": F.col("version") % 9 == 0, "error": F.when(F.col("version") % 8 == 0, F.lit("bad"))}
    )
    current = st.latest_tiles(d.previous_store(spark, sf))
    return unchanged_removed(storable(fresh), current).select(*st.TILE, "version")


QUERIES = {
    "latest_tiles": latest_tiles,
    "cache_lookup": cache_lookup,
    "tiered_lookup": tiered_lookup,
    "tiered_content": tiered_content,
    "fallback_tiles": fallback_tiles,
    "snapshot_diff": snapshot_diff,
    "change_points": change_points,
    "validate_tiles": validate_tiles,
    "verify_store": verify_store,
    "verify_summary": verify_summary,
    "missing_tiles": missing_tiles,
    "present_tiles": present_tiles,
    "collisions": collisions,
    "store_stats": lambda s, p: st.store_stats(latest(s, p)),
    "first_fetches": first_fetches,
    "retained_tiles": lambda s, p: retain_tiles(latest(s, p), TTL, F.expr(NOW)).select(*st.TILE, "version"),
    "rendered_plan": render_plan,
    "tiles_to_write": tiles_to_write,
}

W = "WITH "
_STORE = sql.REQ + ", " + sql.store()
_LATEST = _STORE + ", " + sql.latest()
_PREV = """prev AS (SELECT * REPLACE (CASE WHEN version % 7 = 0 THEN content || '-old' ELSE content END AS content) FROM store)"""
K = "layer_name, z, x, y"
_FALL = sql.REQ + ", " + sql.store(1, "all_tiles") + ", " + sql.latest("all_tiles", "lt") + """,
  t AS (SELECT DISTINCT z, x, y FROM req WHERE layer_name = 'osm'),
  p AS (SELECT z, x, y, content, version % 5 = 0 AS bad FROM lt WHERE layer_name = 'osm'),
  s AS (SELECT z, x, y, content, version % 5 = 0 AS bad, true AS there FROM lt WHERE layer_name = 'osm-topo'),
  j AS (SELECT t.*, p.content AS pc, p.bad AS pbad, s.content AS sc, s.bad AS sbad, s.there,
      t.z BETWEEN 2 AND 9 AND """ + f"""({sql.lat_edge('t.y', 't.z')} > -60 AND {sql.lat_edge('t.y + 1', 't.z')} < 70
        AND {sql.lon_edge('t.x + 1', 't.z')} > -120 AND {sql.lon_edge('t.x', 't.z')} < 150) AS ok
    FROM t LEFT JOIN p USING (z, x, y) LEFT JOIN s USING (z, x, y)),
  f AS (SELECT *, ok AND NOT pbad AS use_p FROM j)"""

_GEN = f"""dd AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY written_at DESC, version DESC) AS rn FROM g0),
      gen AS (SELECT * EXCLUDE (rn) FROM dd WHERE rn = 1), {sql.latest()},
      v AS (SELECT g.*, g.version % 11 <> 0 AS generated, g.version % 13 <> 0 AS written, l.content AS rc,
        coalesce(l.content = g.content, false) AS same FROM gen g LEFT JOIN latest l USING ({K}))"""

SQL = {
    "latest_tiles": W + _LATEST + f" SELECT {K}, written_at, version, content, content_type FROM latest",
    "cache_lookup": W + sql.LOOK + " SELECT request_id, layer_id, hit FROM look",
    "tiered_lookup": W + _STORE + ", " + sql.store(2, "far") + f""", a AS (SELECT DISTINCT {K} FROM store),
      b AS (SELECT DISTINCT {K} FROM far)
      SELECT request_id, CASE WHEN a.z IS NOT NULL THEN 1 WHEN b.z IS NOT NULL THEN 2 END AS hit_tier FROM req r
      LEFT JOIN a ON (a.layer_name, a.z, a.x, a.y) = (r.layer_name, r.z, r.x, r.y)
      LEFT JOIN b ON (b.layer_name, b.z, b.x, b.y) = (r.layer_name, r.z, r.x, r.y)""",
    "tiered_content": W + _LATEST + ", " + sql.store(2, "far") + ", " + sql.latest("far", "far_latest") + f"""
      SELECT request_id, CASE WHEN a.z IS NOT NULL THEN 1 WHEN b.z IS NOT NULL THEN 2 END AS hit_tier,
        coalesce(a.content, b.content) AS content, coalesce(a.content_type, b.content_type) AS content_type FROM req r
      LEFT JOIN latest a ON (a.layer_name, a.z, a.x, a.y) = (r.layer_name, r.z, r.x, r.y)
      LEFT JOIN far_latest b ON (b.layer_name, b.z, b.x, b.y) = (r.layer_name, r.z, r.x, r.y)""",
    "fallback_tiles": W + _FALL + """ SELECT z, x, y, CASE WHEN use_p THEN 'primary' ELSE 'secondary' END AS source,
        CASE WHEN use_p THEN pc ELSE sc END AS content,
        CASE WHEN use_p THEN NULL WHEN there IS NULL THEN 'no tile' WHEN sbad THEN 'bad' END AS error,
        CASE mode WHEN 'always' THEN false WHEN 'unless-error' THEN ok AND pbad ELSE NOT use_p END AS skip_cache, mode
      FROM f, (VALUES ('always'), ('unless-error'), ('unless-fallback')) m(mode)""",
    "snapshot_diff": W + _STORE + ", " + _PREV + f""", o0 AS (SELECT * FROM prev WHERE version % 5 <> 0),
      n0 AS (SELECT * FROM store WHERE version % 4 <> 0), {sql.latest('o0', 'o')}, {sql.latest('n0', 'n')}
      SELECT {K}, CASE WHEN o.version IS NULL THEN 'added' WHEN n.version IS NULL THEN 'removed'
        WHEN o.content <> n.content OR o.content_type <> n.content_type THEN 'changed' ELSE 'same' END AS change
      FROM o FULL OUTER JOIN n USING ({K})""",
    "change_points": W + _STORE + ", " + _PREV + f""", l AS (SELECT *, lag(content) OVER w AS pc, lag(content_type) OVER w AS pt
        FROM prev WINDOW w AS (PARTITION BY {K} ORDER BY written_at, version))
      SELECT {K}, version, content_type FROM l WHERE pc IS NOT NULL AND (pc <> content OR pt <> content_type)""",
    "validate_tiles": W + _LATEST + """, e AS (SELECT *, concat_ws('/', layer_name, z, x, y) AS k FROM req)
      SELECT e.request_id AS check_id, CASE e.request_id % 5 WHEN 0 THEN 'content-type' WHEN 1 THEN 'base-64' WHEN 2 THEN 'file' WHEN 3 THEN 'success' ELSE 'same' END AS validation,
        CASE WHEN l.version IS NULL THEN 'no tile' WHEN e.request_id % 5 = 0 AND l.content_type <> 'image/png' THEN 'content type'
          WHEN e.request_id % 5 = 1 AND e.request_id % 3 = 0 THEN 'content'
          WHEN e.request_id % 5 = 4 AND l.version % 7 = 0 THEN 'result changed' END AS error
      FROM e LEFT JOIN latest l USING (layer_name, z, x, y)""",
    "verify_store": W + _STORE + ", " + _PREV + ", " + sql.store(5, "five") + f""", g0 AS (SELECT * FROM prev UNION ALL SELECT * FROM five WHERE version % 3 <> 0),
      {_GEN}
      SELECT {K}, generated, CASE WHEN generated THEN written END AS cache_write,
        CASE WHEN generated AND written THEN same END AS cache_read,
        CASE WHEN NOT generated THEN 'upstream' WHEN NOT written THEN 'write failed' WHEN rc IS NULL THEN 'not in the store'
          WHEN NOT same THEN 'other content in the store' END AS error FROM v""",
    "verify_summary": W + _STORE + ", " + _PREV + ", " + sql.store(5, "five") + f""", g0 AS (SELECT * FROM prev UNION ALL SELECT * FROM five WHERE version % 3 <> 0),
      {_GEN} SELECT layer_name, count(*) AS tiles, count(*) FILTER (generated) AS generated,
        count(*) FILTER (generated AND written) AS cache_write, count(*) FILTER (generated AND written AND same) AS cache_read,
        count(*) FILTER (NOT (generated AND written AND same)) AS errors FROM v GROUP BY 1""",
    "missing_tiles": W + _LATEST + f""" SELECT DISTINCT {K} FROM req WHERE ({K}) NOT IN (
      SELECT ({K}) FROM latest WHERE written_at + INTERVAL {TTL} SECOND > TIMESTAMP '2024-01-20 12:00:00')""",
    "present_tiles": W + _LATEST + f" SELECT DISTINCT {K} FROM req WHERE ({K}) IN (SELECT ({K}) FROM latest)",
    "collisions": W + sql.REQ + """, n AS (SELECT DISTINCT layer_name || CASE request_id % 4 WHEN 0 THEN '/' WHEN 1 THEN ' ' WHEN 2 THEN '_' ELSE '..' END || user_id AS layer_name FROM req),
      s AS (SELECT layer_name, regexp_replace(regexp_replace(layer_name, '[^A-Za-z0-9.-]', '_', 'g'), '\\.{2,}', '_', 'g') AS safe_name FROM n),
      c AS (SELECT *, count(*) OVER (PARTITION BY safe_name) AS names FROM s) SELECT layer_name, safe_name, names FROM c WHERE names > 1""",
    "store_stats": W + _LATEST + """ SELECT layer_name, z, count(*) AS tiles, CAST(sum(strlen(content)) AS BIGINT) AS bytes,
      count(DISTINCT content) AS distinct_contents FROM latest GROUP BY 1, 2""",
    "first_fetches": "WITH RECURSIVE " + sql.REQ + f""", sec AS (SELECT DISTINCT {K}, CAST(floor(epoch(time)) AS BIGINT) AS s FROM req),
      walk AS (SELECT {K}, min(s) AS s FROM sec GROUP BY {K}
        UNION ALL SELECT w.layer_name, w.z, w.x, w.y, min(t.s) FROM walk w JOIN sec t
          ON (t.layer_name, t.z, t.x, t.y) = (w.layer_name, w.z, w.x, w.y) AND t.s >= w.s + 86400
        GROUP BY w.layer_name, w.z, w.x, w.y, w.s)
      SELECT {K}, s AS fetched_at FROM walk""",
    "retained_tiles": W + _LATEST + f""" SELECT {K}, version FROM latest
      WHERE written_at + INTERVAL {TTL} SECOND > TIMESTAMP '2024-01-20 12:00:00'""",
    "tiles_to_write": W + _STORE + ", " + _PREV + ", " + sql.latest() + ", " + sql.latest("prev", "lp") + f"""
      SELECT {K}, l.version FROM latest l JOIN lp USING ({K})
      WHERE l.content <> lp.content AND l.version % 9 <> 0 AND l.version % 8 <> 0""",
}
SQL["rendered_plan"] = (
    W + tiles.GOOD_PLAN + """ SELECT DISTINCT layer_name, z, CAST(x AS INT) AS x, CAST(y AS INT) AS y,
      CASE WHEN (x + y) % 7 <> 0 THEN layer_name || ':' || z || ':' || x || ':' || y END AS content,
      CASE WHEN (x + y) % 7 <> 0 THEN 'text/plain' END AS content_type,
      CASE WHEN (x + y) % 7 = 0 THEN 'ValueError: no data' END AS error FROM plan"""
)
