"""Vector-tile queries over the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import raster, vector as v
from tessera.operators.geometry import clip_to_tiles
from tessera.operators.vector import TILE
from tessera.plans.queries import sql
from tessera.sources import derived as d


def tile_assignment(spark, sf):
    placed = v.points_to_tiles(d.features(spark, sf), [0, 3, 6])
    return placed.groupBy(*TILE).agg(
        F.count(F.lit(1)).alias("features"), F.sum("weight").alias("weight"), F.max("gid").alias("last")
    )


def tile_features(spark, sf):
    tiles = v.build_vector_tiles(d.features(spark, sf), [5], attributes=["kind", "weight"])
    return v.explode_features(tiles)


def tile_summary(spark, sf):
    tiles = v.build_vector_tiles(d.features(spark, sf), [0, 2, 4], parts=4, spread=F.col("gid"))
    return tiles.groupBy("layer", *TILE).agg(
        F.sum("n").cast("long").alias("features"), F.sum(F.size("features")).cast("long").alias("held"),
        F.countDistinct(F.col("part") % 4).alias("parts"),
    )


def limited_tiles(spark, sf):
    return v.explode_features(v.build_vector_tiles(d.features(spark, sf), [2, 4], limit=7, layer="few"))


def filtered_tiles(spark, sf):
    tiles = v.build_vector_tiles(
        d.features(spark, sf), [3], buffer=0.0, extent=512, attributes=["kind"],
        where="kind = :kind AND weight > z * 10", params={"kind": "R"}, layer="returns",
    )
    return v.explode_features(tiles)


def composite_tiles(spark, sf):
    named = F.concat(F.lit("kind_"), F.col("kind"))
    skip = (F.col("layer") == "kind_A") & (F.col("x") % 2 == 0)
    tiles = v.layered_tiles(d.features(spark, sf), [4], named, ["kind_R", "kind_A", "kind_N"], skip, parts=1)
    whole = tiles.groupBy("layer", *TILE, "ord", "skip_cache").agg(F.sum("n").cast("int").alias("n"))
    return whole.select("layer", *TILE, "ord", "n", "skip_cache")


def geometries(spark, sf):
    """One line or polygon per order through its items."""
    order = F.col("gid") / 10
    paths = d.features(spark, sf).groupBy(F.floor(order).alias("gid")).agg(
        F.array_sort(F.collect_list(F.struct("gid", "lon", "lat"))).alias("p")
    )
    return paths.select(
        "gid",
        F.struct(
            F.when(F.col("gid") % 3 == 0, F.lit("polygon")).otherwise(F.lit("line")).alias("kind"),
            F.transform("p", lambda c: F.struct(c["lon"].alias("x"), c["lat"].alias("y"))).alias("coords"),
        ).alias("geom"),
    )


GEOMETRY_ZOOMS = [0, 2, 4]


def order_lines(spark, sf):
    """The lines and polygons of all orders at three zooms, cut at tile edges; where the pieces of lines start."""
    clipped = clip_to_tiles(geometries(spark, sf), GEOMETRY_ZOOMS)
    start = F.transform("paths", lambda p: F.when(F.col("kind") == "line", p[0]))
    return clipped.select(*TILE, "kind", F.size("paths").alias("n"), start.alias("start")).groupBy(*TILE, "kind").agg(
        F.count(F.lit(1)).alias("features"), F.sum("n").cast("long").alias("paths"),
        *(
            F.sum(F.aggregate("start", F.lit(0).cast("long"), lambda t, p: t + F.coalesce(p[c], F.lit(0)))).alias(f"sum_{c}")
            for c in ("qx", "qy")
        ),
    )


def geometry_tiles(spark, sf):
    """Tiles whose features are lines and polygons with their clipped paths, read back feature by feature."""
    geoms = geometries(spark, sf).withColumn("even", F.col("gid") % 2 == 0)
    tiles = v.build_geometry_tiles(geoms, [3], attributes=["even"], where="even or x < :x", params={"x": 3}, layer="orders")
    shown = v.explode_features(tiles).withColumn("lines", F.when(F.col("kind") == "line", F.size("paths")).otherwise(F.lit(0)))
    return shown.select("layer", *TILE, "gid", "kind", "even", F.col("lines").cast("int").alias("lines"))


def order_boxes(spark, sf):
    """Boxes around features: bounding-box tile assignment without clipping."""
    f = d.features(spark, sf)

    def corner(sign):
        return F.struct((F.col("lon") + sign * 1.5).alias("x"), (F.col("lat") * 0.9 + sign * 1.0).alias("y"))

    boxes = f.select(
        "gid", F.struct(F.lit("box").alias("kind"), F.array(corner(-1), corner(1)).alias("coords")).alias("geom")
    )
    return v.geoms_to_tiles(boxes, [4], 0.25).groupBy(*TILE).agg(F.count(F.lit(1)).alias("features"))


def constant_vector(spark, sf):
    keys = d.tile_requests(spark, sf).select(*TILE).distinct()
    box = raster.constant_vector_tiles(keys)
    corner = F.col("features")[0]["ring"][2]
    return box.select("layer", *TILE, "n", corner["qx"].alias("qx"), corner["qy"].alias("qy"))


QUERIES = {
    "feature_tiles": tile_assignment,
    "vector_tile_features": tile_features,
    "vector_tile_parts": tile_summary,
    "limited_vector_tiles": limited_tiles,
    "filtered_vector_tiles": filtered_tiles,
    "composite_vector_tiles": composite_tiles,
    "clipped_lines": order_lines,
    "geometry_tiles": geometry_tiles,
    "box_tiles": order_boxes,
    "constant_vector_tiles": constant_vector,
}

W = "WITH "


def _placed(zooms, half=0.0625, where="true"):
    n, scale = "pow(2.0, z)", "(pow(2.0, z) / 40075016.685578)"
    return sql.FEAT + f""", m AS (SELECT *, {sql.lon_m('lon')} AS mx, {sql.lat_m('lat')} AS my, unnest({zooms}) AS z FROM feat WHERE {where}),
  uv AS (SELECT *, (mx + 20037508.342789) * {scale} AS u, (20037508.342789 - my) * {scale} AS v FROM m),
  px AS (SELECT *, unnest(range(CAST(greatest(floor(u - 1 - {half}), 0) AS INT), CAST(least(floor(u + {half}), {n} - 1) AS INT) + 1)) AS tx FROM uv
    WHERE u BETWEEN 0 AND {n} AND v BETWEEN 0 AND {n}),
  py AS (SELECT *, unnest(range(CAST(greatest(floor(v - 1 - {half}), 0) AS INT), CAST(least(floor(v + {half}), {n} - 1) AS INT) + 1)) AS ty FROM px),
  placed AS (SELECT gid, lon, lat, kind, weight, z, CAST(tx AS INT) AS x, CAST(ty AS INT) AS y, u, v FROM py
    WHERE u BETWEEN tx - {half} AND tx + 1 + {half} AND v BETWEEN ty - {half} AND ty + 1 + {half})"""


def _q(extent=4096):
    return f"CAST(floor((u - x) * {extent}) AS INT) AS qx, CAST(floor((v - y) * {extent}) AS INT) AS qy"


def _clipped(zooms):
    """Edges of every order's path against every tile's two boxes, and the ring's turns around the tile's middle."""
    world = "1.0::DOUBLE / 40075016.685578"

    def inside(a, box):
        """Where the edge enters and leaves a box whose sides are named low/high + box."""
        sides = [("-du", f"u - lu{box}"), ("du", f"hu{box} - u"), ("-dv", f"v - lv{box}"), ("dv", f"hv{box} - v")]
        enter = ", ".join(f"CASE WHEN {p} < 0 THEN ({q}) / ({p}) END" for p, q in sides)
        leave = ", ".join(f"CASE WHEN {p} > 0 THEN ({q}) / ({p}) END" for p, q in sides)
        out = " OR ".join(f"({p} = 0 AND {q} < 0)" for p, q in sides)
        return f"greatest(0.0, {enter}) AS enter{a}, least(1.0, {leave}) AS leave{a}, {out} AS out{a}"

    def start(c):
        """Where a piece of a line begins: a point on a side of the box has exactly the side's coordinate."""
        side = f"CASE WHEN d{c} > 0 THEN l{c}w ELSE h{c}w END"
        on_side = f"d{c} <> 0 AND ({side} - {c}) / d{c} = enterw"
        return f"CASE WHEN enterw = 0 THEN {c} WHEN {on_side} THEN {side} ELSE {c} + enterw * d{c} END"

    return sql.FEAT + f""", dot AS (
      SELECT gid // 10 AS gid, gid AS item, lon, lat, ({sql.lon_m('lon')} + 20037508.342789) * ({world}) AS u0,
        (20037508.342789 - {sql.lat_m('lat')}) * ({world}) AS v0 FROM feat),
    numbered AS (
      SELECT gid, u0, v0, gid % 3 = 0 AS ring, row_number() OVER o AS i, count(*) OVER (PARTITION BY gid) AS n,
        lead(u0) OVER o AS nu, lead(v0) OVER o AS nv, first_value(u0) OVER o AS fu, first_value(v0) OVER o AS fv
      FROM dot WINDOW o AS (PARTITION BY gid ORDER BY item, lon, lat)),
    edge AS (
      SELECT gid, ring, i, u0, v0, CASE WHEN i < n THEN nu WHEN ring THEN fu ELSE u0 END AS u1,
        CASE WHEN i < n THEN nv WHEN ring THEN fv ELSE v0 END AS v1 FROM numbered WHERE i < n OR ring OR n = 1),
    boxed AS (SELECT gid, min(u0) AS a0, max(u0) AS a1, min(v0) AS b0, max(v0) AS b1 FROM dot GROUP BY gid),
    tile AS (
      SELECT z, x, y, CAST(pow(2, z) AS DOUBLE) AS n FROM (SELECT unnest({zooms}) AS z) s,
        unnest(range(CAST(pow(2, z) AS INT))) AS tx(x), unnest(range(CAST(pow(2, z) AS INT))) AS ty(y)),
    cand AS (
      SELECT gid, z, x, y, n, greatest(x - 0.0625, 0.0) AS lun, greatest(y - 0.0625, 0.0) AS lvn, least(x + 1.0625, n) AS hun,
        least(y + 1.0625, n) AS hvn, x - 0.125 AS luw, y - 0.125 AS lvw, x + 1.125 AS huw, y + 1.125 AS hvw
      FROM boxed JOIN tile ON a1 * n >= x - 0.0625 AND a0 * n <= x + 1.0625 AND b1 * n >= y - 0.0625 AND b0 * n <= y + 1.0625),
    seg AS (
      SELECT c.*, ring, i, u0 * n AS u, v0 * n AS v, u1 * n AS eu, v1 * n AS ev, u1 * n - u0 * n AS du, v1 * n - v0 * n AS dv,
        (lun + hun) / 2 AS mu, (lvn + hvn) / 2 AS mv FROM cand c JOIN edge USING (gid)),
    cut AS (
      SELECT *, {inside('n', 'n')}, {inside('w', 'w')},
        CASE WHEN v <= mv AND ev > mv AND du * (mv - v) - (mu - u) * dv > 0 THEN 1
             WHEN ev <= mv AND v > mv AND du * (mv - v) - (mu - u) * dv < 0 THEN -1 ELSE 0 END AS turn FROM seg),
    piece AS (
      SELECT *, NOT outn AND entern <= leaven AS meets, NOT outw AND enterw <= leavew AS held FROM cut),
    begun AS (
      SELECT *, held AND NOT coalesce(lag(held) OVER w AND lag(leavew) OVER w = 1 AND enterw = 0, false) AS begins
      FROM piece WINDOW w AS (PARTITION BY gid, z, x, y ORDER BY i)),
    clipped AS (
      SELECT gid, z, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CASE WHEN ring THEN 'polygon' ELSE 'line' END AS kind,
        CASE WHEN ring THEN 1 ELSE sum(begins::INT) END AS paths,
        coalesce(sum(CAST(floor(({start('u')} - x) * 4096) AS BIGINT)) FILTER (begins AND NOT ring), 0) AS qx,
        coalesce(sum(CAST(floor(({start('v')} - y) * 4096) AS BIGINT)) FILTER (begins AND NOT ring), 0) AS qy
      FROM begun GROUP BY gid, z, x, y, ring HAVING bool_or(meets) OR (ring AND sum(turn) <> 0))"""


SQL = {
    "feature_tiles": W + _placed("[0, 3, 6]") + """ SELECT z, x, y, count(*) AS features, sum(weight) AS weight, max(gid) AS last
      FROM placed GROUP BY 1, 2, 3""",
    "vector_tile_features": W + _placed("[5]") + f" SELECT 'features' AS layer, z, x, y, gid, {_q()}, kind, weight FROM placed",
    "vector_tile_parts": W + _placed("[0, 2, 4]") + """ SELECT 'features' AS layer, z, x, y, count(*) AS features,
      count(*) AS held, count(DISTINCT gid % 4) AS parts FROM placed GROUP BY 2, 3, 4""",
    "limited_vector_tiles": W + _placed("[2, 4]") + f""", r AS (SELECT *, row_number() OVER (PARTITION BY z, x, y ORDER BY gid, u, v) AS rn FROM placed)
      SELECT 'few' AS layer, z, x, y, gid, {_q()} FROM r WHERE rn <= 7""",
    "filtered_vector_tiles": W + _placed("[3]", 0.0) + f""" SELECT 'returns' AS layer, z, x, y, gid, {_q(512)}, kind
      FROM placed WHERE kind = 'R' AND weight > z * 10""",
    "composite_vector_tiles": W + _placed("[4]") + """, c AS (SELECT kind, z, x, y, count(*) AS n FROM placed GROUP BY ALL)
      SELECT 'kind_' || kind AS layer, z, x, y, CASE kind WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS ord, CAST(n AS INT) AS n,
        x % 2 = 0 AND bool_or(kind = 'A') OVER (PARTITION BY z, x, y) AS skip_cache FROM c""",
    "clipped_lines": W + _clipped(GEOMETRY_ZOOMS) + """ SELECT z, x, y, kind, count(*) AS features, CAST(sum(paths) AS BIGINT) AS paths,
      CAST(sum(qx) AS BIGINT) AS sum_qx, CAST(sum(qy) AS BIGINT) AS sum_qy FROM clipped GROUP BY ALL""",
    "geometry_tiles": W + _clipped([3]) + """ SELECT 'orders' AS layer, z, x, y, gid, kind, gid % 2 = 0 AS even,
      CAST(CASE WHEN kind = 'line' THEN paths ELSE 0 END AS INT) AS lines FROM clipped WHERE gid % 2 = 0 OR x < 3""",
    "box_tiles": W + sql.FEAT + f""", b AS (SELECT gid, 4 AS z, ({sql.lon_m('(lon - 1.5)')} + 20037508.342789) * (16.0::DOUBLE / 40075016.685578) AS u0,
        ({sql.lon_m('(lon + 1.5)')} + 20037508.342789) * (16.0::DOUBLE / 40075016.685578) AS u1,
        (20037508.342789 - {sql.lat_m('(lat * 0.9 + 1.0)')}) * (16.0::DOUBLE / 40075016.685578) AS v0,
        (20037508.342789 - {sql.lat_m('(lat * 0.9 - 1.0)')}) * (16.0::DOUBLE / 40075016.685578) AS v1 FROM feat),
      t AS (SELECT * FROM (SELECT unnest(range(16)) AS x) a, (SELECT unnest(range(16)) AS y) c)
      SELECT z, CAST(x AS INT) AS x, CAST(y AS INT) AS y, count(*) AS features FROM b JOIN t
        ON u1 >= x - 0.125 AND u0 <= x + 1.125 AND v1 >= y - 0.125 AND v0 <= y + 1.125
          AND u1 >= 0 AND u0 <= 16 AND v1 >= 0 AND v0 <= 16 GROUP BY ALL""",
    "constant_vector_tiles": W + sql.REQ + """ SELECT DISTINCT 'box' AS layer, z, x, y, 1 AS n, 4096 AS qx, 4096 AS qy
      FROM req""",
}
