"""Tile-pyramid, geohash, zoom-list and seed-plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import tiles as t
from tessera.functions.keys import parse_tile_path, tile_key
from tessera.plans import seed
from tessera.plans.queries import sql
from tessera.plans.render import register_tile_cover
from tessera.session import written
from tessera.sources import derived as d


def rounded(v, digits):
    r = F.round(v, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def keys(spark, sf):
    return d.tile_requests(spark, sf).select("z", "x", "y").distinct()


def tile_bounds(spark, sf):
    b = t.tile_bounds("z", "x", "y")
    return keys(spark, sf).select(
        "z", "x", "y", *[rounded(b[s], 9).alias(s) for s in ("south", "north", "west", "east")]
    )


def tile_bounds_3857(spark, sf):
    b = t.tile_bounds_3857("z", "x", "y")
    return keys(spark, sf).select(
        "z", "x", "y", b["srid"].alias("srid"),
        *[rounded(b[s], 3).alias(s) for s in ("south", "north", "west", "east")],
    )


def tile_errors(spark, sf):
    r = d.tile_requests(spark, sf)
    i = F.col("request_id")
    z = (i % 25 - 2).cast("int")
    x, y = (F.col("x") - (i % 7 == 0).cast("int") * 50), (F.col("y") + (i % 11 == 0).cast("int") * 9000)
    srid = F.when(i % 13 == 0, 2154).when(i % 2 == 0, 3857).otherwise(4326)
    return r.select("request_id", t.tile_error(z, x, y, srid).alias("error"))


def tile_keys(spark, sf):
    return d.tile_requests(spark, sf).select(
        "request_id", tile_key("layer_name", "z", "x", "y").alias("key"),
        tile_key("layer_name", "z", "x", "y", "_").alias("flat_key"), t.flip_y("z", "y").alias("tms_y"),
    )


def tile_paths(spark, sf):
    i = F.col("request_id")
    path = (
        F.when(i % 10 == 0, F.lit("/tiles/osm"))
        .when(i % 10 == 1, F.concat(F.lit("/tiles/osm/"), F.col("z"), F.lit("/x1/2?a=/1/2")))
        .otherwise(F.concat(F.lit("/root/tiles/"), tile_key("layer_name", "z", "x", "y"), F.lit("?v=1")))
    )
    p = parse_tile_path(path)
    return d.tile_requests(spark, sf).select(
        "request_id", p["layer_name"].alias("layer_name"), p["z"].alias("z"), p["x"].alias("x"),
        p["y"].alias("y"), p["error"].alias("error"),
    )


def geohash_bounds(spark, sf):
    code = F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 6)
    code = F.when(F.col("event_id") % 10 != 0, F.translate(code, "a", "g")).otherwise(code)
    coded = d.table(spark, sf, "events").select("event_id", code.alias("code"))
    return coded.withColumn("b", t.geohash_bounds("code")).select(
        "event_id", "code", *[F.col("b")[s].alias(s) for s in ("south", "north", "west", "east")]
    )


def _boxes(spark, sf):
    i = F.col("request_id")
    west = (i * 7 % 340).cast("double") - 170.0
    south = (i * 11 % 150).cast("double") - 75.0
    box = F.when(i % 9 == 0, t.bounds(0, 0, 0, 0)).otherwise(
        t.bounds(south, south + (i % 40).cast("double") / 4.0, west, west + (i % 50).cast("double") / 2.0)
    )
    return d.tile_requests(spark, sf).withColumn("box", box)


def bounds_predicates(spark, sf):
    tile = t.tile_bounds("z", "x", "y")
    c = t.bounds_centroid("box")
    return _boxes(spark, sf).select(
        "request_id", t.bounds_intersect("box", tile).alias("intersects"),
        t.bounds_contain("box", tile).alias("contains"), t.bounds_contain(tile, "box").alias("inside"),
        t.bounds_contain_point(tile, c["x"], c["y"]).alias("holds_centre"),
        t.is_null_island("box").alias("open"),
        t.tile_intersects("z", "x", "y", F.col("box")).alias("tile_intersects"),
    )


def bounds_geometry(spark, sf):
    c = t.bounds_centroid("box")
    grown = t.bounds_confine(t.bounds_buffer("box", F.lit(0.5)))
    return _boxes(spark, sf).select(
        "request_id", t.bounds_width("box").alias("width"), t.bounds_height("box").alias("height"),
        c["x"].alias("cx"), c["y"].alias("cy"),
        *[grown[s].alias(f"grown_{s}") for s in ("south", "north", "west", "east")],
        t.bounds_ewkt(grown).alias("ewkt"),
    )


def projected_boxes(spark, sf):
    once = t.to_3857(t.bounds_confine("box"))
    twice = t.to_3857(once)
    return _boxes(spark, sf).select(
        "request_id", *[rounded(once[s], 3).alias(s) for s in ("south", "north", "west", "east")],
        (twice == once).alias("stable"),
    )


def feature_tile_counts(spark, sf):
    f = d.features(spark, sf).withColumn("z", F.explode(F.array(F.lit(3), F.lit(6))))
    at = t.lonlat_tile("lon", "lat", "z")
    return f.select("z", at["x"].alias("x"), at["y"].alias("y"), "weight").groupBy("z", "x", "y").agg(
        F.count(F.lit(1)).alias("features"), F.sum("weight").alias("weight")
    )


def zoom_lists(spark, sf):
    text = F.expr(
        """CASE request_id % 5 WHEN 0 THEN concat(z, '') WHEN 1 THEN concat(z, '-', z + 2)
           WHEN 2 THEN concat(z, ',', z, '-', z + 1) WHEN 3 THEN concat(z + 1, '-', z)
           ELSE concat(z, '-', z + 12) END"""
    )
    rows = d.tile_requests(spark, sf).select("request_id", text.alias("text"))
    return rows.select(
        "request_id", F.array_join(F.transform(t.zoom_list("text"), lambda v: v.cast("string")), " ").alias("zooms"),
        t.zoom_list_error("text").alias("error"),
    )


def cover_ranges(spark, sf):
    r = seed.plan_ranges(d.regions(spark, sf))
    return r.select("region_id", "step", "z", "range.*", "tiles")


def strict_cover_ranges(spark, sf):
    r = seed.plan_ranges(d.regions(spark, sf), strict=True)
    return r.select("region_id", "step", "z", "range.*", "tiles")


def wide_regions(spark, sf):
    """Wider regions, so that every limit is met by some of them."""
    return d.regions(spark, sf).withColumn(
        "area", F.col("area").withField("east", F.col("area.east") + (F.col("region_id") % 10) * 9)
    ).withColumn("zooms", F.when(F.col("region_id") % 2 == 0, F.lit("8,9")).otherwise(F.lit("4-7")))


def plan_guards(spark, sf):
    return seed.plan_guards(wide_regions(spark, sf))


def rejected_regions(spark, sf):
    """Every region is planned or told off: none is in both, none in neither."""
    regions = wide_regions(spark, sf)
    planned = seed.within_limits(regions).select("region_id", F.lit(None).cast("string").alias("error"))
    return seed.rejected_regions(regions).select("region_id", "error").unionByName(planned)


def seed_plan(spark, sf):
    return seed.seed_plan(d.regions(spark, sf), on_limit="report")


def missing_ranges(spark, sf):
    """Gaps of a store that holds most tiles of the plan and some outside, found without expanding the plan."""
    regions = seed.spread_regions(d.regions(spark, sf))
    # Guards and covers are the costly part; they are worked out once.
    ranges = written(seed.plan_ranges(seed.within_limits(regions)), "ranges")
    x, y = F.col("x"), F.col("y")
    store = seed.expand_plan(ranges).where((x * 5 + y * 3 + F.col("region_id")) % 4 != 0)
    held = F.when((x + 1 + y) % 5 == 0, F.array(x, x + 1)).otherwise(F.array(x))
    return seed.missing_ranges(ranges, store.select("layer_name", "z", F.explode(held).alias("x"), "y").distinct())


def plan_summary(spark, sf):
    return seed.plan_summary(seed_plan(spark, sf))


def plan_summary_closed_form(spark, sf):
    return seed.summary_from_ranges(seed.plan_ranges(seed.within_limits(d.regions(spark, sf))))


def tile_cover_function(spark, sf):
    register_tile_cover(spark)
    d.regions(spark, sf).createOrReplaceTempView("tessera_regions")
    return spark.sql(
        """SELECT r.region_id, c.x, c.y FROM tessera_regions r,
           LATERAL tile_cover(r.area.west, r.area.south, r.area.east, r.area.north, 5) c"""
    )


QUERIES = {
    "tile_bounds": tile_bounds,
    "tile_bounds_3857": tile_bounds_3857,
    "tile_errors": tile_errors,
    "tile_keys": tile_keys,
    "tile_paths": tile_paths,
    "geohash_bounds": geohash_bounds,
    "bounds_predicates": bounds_predicates,
    "bounds_geometry": bounds_geometry,
    "projected_boxes": projected_boxes,
    "feature_tile_counts": feature_tile_counts,
    "zoom_lists": zoom_lists,
    "cover_ranges": cover_ranges,
    "strict_cover_ranges": strict_cover_ranges,
    "plan_guards": plan_guards,
    "rejected_regions": rejected_regions,
    "seed_plan": seed_plan,
    "missing_ranges": missing_ranges,
    "plan_summary": plan_summary,
    "plan_summary_closed_form": plan_summary_closed_form,
    "tile_cover_function": tile_cover_function,
}

R = sql.rounded
W = "WITH "
SIDES = {"south": sql.lat_edge("y + 1"), "north": sql.lat_edge("y"), "west": sql.lon_edge("x"), "east": sql.lon_edge("x + 1")}
_KEYS = sql.REQ + ", k AS (SELECT DISTINCT z, x, y FROM req)"

_GEO_LON, _GEO_LAT = [], []
for _i in range(1, 7):
    _v = f"(strpos('{t.GEOHASH_ALPHABET}', substr(code, {_i}, 1)) - 1)"
    for _k in range(5):
        _bit = f"(({_v} >> {4 - _k}) & 1)"
        (_GEO_LON if (5 * (_i - 1) + _k) % 2 == 0 else _GEO_LAT).append(_bit)
_LON = " + ".join(f"{b} * {2 ** (14 - i)}" for i, b in enumerate(_GEO_LON))
_LAT = " + ".join(f"{b} * {2 ** (14 - i)}" for i, b in enumerate(_GEO_LAT))

_BOXES = sql.REQ + """, box AS (
  SELECT *, CASE WHEN o THEN 0 ELSE w0 END AS bw, CASE WHEN o THEN 0 ELSE s0 END AS bs,
    CASE WHEN o THEN 0 ELSE w0 + CAST(request_id % 50 AS DOUBLE) / 2.0 END AS be,
    CASE WHEN o THEN 0 ELSE s0 + CAST(request_id % 40 AS DOUBLE) / 4.0 END AS bn
  FROM (SELECT *, request_id % 9 = 0 AS o, CAST(request_id * 7 % 340 AS DOUBLE) - 170.0 AS w0,
               CAST(request_id * 11 % 150 AS DOUBLE) - 75.0 AS s0 FROM req)), tb AS (
  SELECT *, """ + ", ".join(f"{v} AS t{k[0]}" for k, v in SIDES.items()) + " FROM box)"

_E = "0.00000001"


def _held(v, lo, hi):
    return f"greatest({lo}, least({hi}, {v}))"


def _row(lat):
    r = f"(greatest(-85.0511, least(85.0511, {lat})) * {sql.PI} / 180)"
    return f"(pow(2.0, z) * (1 - ln(tan({r}) + 1 / cos({r})) / {sql.PI}) / 2)"


def _regions(east="0", zooms="CASE WHEN c_custkey % 3 = 0 THEN [3, 4, 5, 7] ELSE [4, 6] END"):
    return f"""region AS (
  SELECT c_custkey AS region_id, 'seg-' || lower(c_mktsegment) AS layer_name, s AS south, w AS west,
    s + 1.0 + CAST(c_custkey % 7 AS DOUBLE) AS north,
    w + 1.0 + CAST(c_custkey % 11 AS DOUBLE) / 2.0 + ({east}) AS east, {zooms} AS zooms
  FROM (SELECT *, CAST(c_custkey * 7919 % 3400 AS DOUBLE) / 10.0 - 175.0 AS w,
               CAST(c_custkey * 6007 % 1200 AS DOUBLE) / 10.0 - 60.0 AS s FROM customer)),
 rz AS (SELECT *, unnest(zooms) AS z, CAST(unnest(range(len(zooms))) AS INT) AS step FROM region)"""


def _wrapped(lon):
    return f"(CASE WHEN {lon} > 180 THEN {lon} - 180 ELSE {lon} END)"


_RANGES = f"""rr AS (SELECT *,
    CAST(trunc({_held("pow(2.0, z) * ((" + _wrapped("west") + " + 180) / 360)", 0, "pow(2.0, z)")}) AS INT) AS x0,
    CAST(trunc({_held("pow(2.0, z) * ((" + _wrapped("east") + " + 180) / 360)", 0, "pow(2.0, z)")}) AS INT) AS xe,
    CAST({_held("floor(" + _row("north") + ")", 0, "pow(2.0, z)")} AS INT) AS y0,
    CAST({_held("ceil(" + _row("south") + ")", 0, "pow(2.0, z)")} AS INT) AS ye FROM rz),
  ranges AS (SELECT * EXCLUDE (xe, ye), CASE WHEN xe = x0 THEN x0 + 1 ELSE xe END AS x1,
      CASE WHEN ye = y0 THEN y0 + 1 ELSE ye END AS y1 FROM rr),
  counted AS (SELECT *, CASE WHEN x1 < x0 OR y1 < y0 THEN CAST(-1 AS BIGINT)
      ELSE CAST(x1 - x0 AS BIGINT) * (y1 - y0) END AS tiles FROM ranges)"""
_STRICT = f"""ranges AS (SELECT *,
    CAST({_held("floor(pow(2.0, z) * (west + 180) / 360)", 0, "pow(2.0, z) - 1")} AS INT) AS x0,
    CAST({_held("ceil(pow(2.0, z) * (east + 180) / 360)", 0, "pow(2.0, z)")} AS INT) AS x1,
    CAST({_held("floor(" + _row("north") + ")", 0, "pow(2.0, z) - 1")} AS INT) AS y0,
    CAST({_held("ceil(" + _row("south") + ")", 0, "pow(2.0, z)")} AS INT) AS y1 FROM rz)"""

_GOOD = """, bad AS (SELECT DISTINCT region_id FROM counted WHERE tiles < 0 OR tiles > 10000),
  plan AS (SELECT region_id, layer_name, step, z, x, unnest(range(y0, y1)) AS y FROM (
    SELECT *, unnest(range(x0, x1)) AS x FROM counted WHERE region_id NOT IN (SELECT region_id FROM bad)))"""

GOOD_PLAN = _regions() + ", " + _RANGES + _GOOD

SQL = {
    "tile_bounds": W + _KEYS + " SELECT z, x, y, " + ", ".join(f"{R(v, 9)} AS {k}" for k, v in SIDES.items()) + " FROM k",
    "tile_bounds_3857": W + _KEYS + " SELECT z, x, y, 3857 AS srid, " + ", ".join(
        f"{R((sql.lat_m if k in ('south', 'north') else sql.lon_m)(v), 3)} AS {k}" for k, v in SIDES.items()
    ) + " FROM k",
    "tile_errors": W + sql.REQ + """ SELECT request_id, CASE WHEN tz < 0 OR tz > 21 THEN 'Z'
        WHEN request_id % 13 = 0 THEN 'SRID' WHEN tx < 0 OR tx >= pow(2.0, tz) THEN 'X'
        WHEN ty < 0 OR ty >= pow(2.0, tz) THEN 'Y' END AS error
      FROM (SELECT request_id, request_id % 25 - 2 AS tz, x - CASE WHEN request_id % 7 = 0 THEN 50 ELSE 0 END AS tx,
                   y + CASE WHEN request_id % 11 = 0 THEN 9000 ELSE 0 END AS ty FROM req)""",
    "tile_keys": W + sql.REQ + """ SELECT request_id, layer_name || '/' || z || '/' || x || '/' || y AS key,
      layer_name || '_' || z || '_' || x || '_' || y AS flat_key,
      CAST(pow(2, z) - y - 1 AS INT) AS tms_y FROM req""",
    "tile_paths": W + sql.REQ + """ SELECT request_id,
      CASE request_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'osm' ELSE layer_name END AS layer_name,
      CASE WHEN request_id % 10 = 0 THEN NULL ELSE CAST(z AS BIGINT) END AS z,
      CASE WHEN request_id % 10 < 2 THEN NULL ELSE CAST(x AS BIGINT) END AS x,
      CASE request_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 2 ELSE CAST(y AS BIGINT) END AS y,
      CASE request_id % 10 WHEN 0 THEN 'NotFound' WHEN 1 THEN 'BadRequest' END AS error FROM req""",
    "geohash_bounds": f"""WITH c AS (SELECT event_id, CASE WHEN event_id % 10 <> 0
          THEN translate(h, 'a', 'g') ELSE h END AS code
        FROM (SELECT event_id, substr(md5(CAST(event_id AS VARCHAR)), 1, 6) AS h FROM events)),
      g AS (SELECT *, {_LON} AS lon, {_LAT} AS lat, strpos(code, 'a') = 0 AS ok FROM c)
      SELECT event_id, code,
        CASE WHEN ok THEN lat * (180 / 32768.0::DOUBLE) - 90 END AS south,
        CASE WHEN ok THEN (lat + 1) * (180 / 32768.0::DOUBLE) - 90 END AS north,
        CASE WHEN ok THEN lon * (360 / 32768.0::DOUBLE) - 180 END AS west,
        CASE WHEN ok THEN (lon + 1) * (360 / 32768.0::DOUBLE) - 180 END AS east FROM g""",
    "bounds_predicates": W + _BOXES + f""" SELECT request_id,
        (tn > bs AND ts < bn AND te > bw AND tw < be) AS intersects,
        (ts + {_E} >= bs AND tn <= bn + {_E} AND tw + {_E} >= bw AND te <= be + {_E}) AS contains,
        (bs + {_E} >= ts AND bn <= tn + {_E} AND bw + {_E} >= tw AND be <= te + {_E}) AS inside,
        ((bn + bs) / 2 + {_E} >= ts AND (bn + bs) / 2 <= tn + {_E}
          AND (bw + be) / 2 + {_E} >= tw AND (bw + be) / 2 <= te + {_E}) AS holds_centre,
        (be = 0 AND bn = 0 AND bw = 0 AND bs = 0) AS open,
        (o OR (tn > bs AND ts < bn AND te > bw AND tw < be)) AS tile_intersects FROM tb""",
    "bounds_geometry": W + _BOXES + """, g AS (SELECT *, abs(be - bw) AS width, abs(bn - bs) AS height FROM tb),
      h AS (SELECT *, greatest(-85.0511, least(85.0511, bs - height * 0.5 / 2)) AS gs,
          greatest(-85.0511, least(85.0511, bn + height * 0.5 / 2)) AS gn,
          greatest(-180.0, least(180.0, bw - width * 0.5 / 2)) AS gw,
          greatest(-180.0, least(180.0, be + width * 0.5 / 2)) AS ge FROM g)
      SELECT request_id, width, height, (bw + be) / 2 AS cx, (bn + bs) / 2 AS cy, gs AS grown_south,
        gn AS grown_north, gw AS grown_west, ge AS grown_east,
        printf('SRID=4326;POLYGON((%.7f %.7f,%.7f %.7f,%.7f %.7f,%.7f %.7f,%.7f %.7f))',
          gw, gs, gw, gn, ge, gn, ge, gs, gw, gs) AS ewkt FROM h""",
    "projected_boxes": W + _BOXES + " SELECT request_id, " + ", ".join(
        f"{R((sql.lat_m if k in ('bs', 'bn') else sql.lon_m)(f'greatest(-{lim}, least({lim}, {k}))'), 3)} AS {name}"
        for k, name, lim in (("bs", "south", 85.0511), ("bn", "north", 85.0511), ("bw", "west", 180.0), ("be", "east", 180.0))
    ) + ", true AS stable FROM tb",
    "feature_tile_counts": W + sql.FEAT + f""", fz AS (SELECT *, unnest([3, 6]) AS z FROM feat)
      SELECT z, CAST(greatest(0, least(pow(2.0, z) - 1, floor((lon + 180) / 360 * pow(2.0, z)))) AS INT) AS x,
        CAST(greatest(0, least(pow(2.0, z) - 1, floor({_row("lat")}))) AS INT) AS y,
        count(*) AS features, sum(weight) AS weight FROM fz GROUP BY 1, 2, 3""",
    "zoom_lists": W + sql.REQ + """ SELECT request_id,
      CASE request_id % 5 WHEN 0 THEN z || '' WHEN 1 THEN z || ' ' || (z + 1) || ' ' || (z + 2)
        WHEN 2 THEN z || ' ' || z || ' ' || (z + 1) WHEN 3 THEN NULL
        ELSE CASE WHEN z + 12 <= 21 THEN array_to_string(range(z, z + 13), ' ') END END AS zooms,
      CASE WHEN request_id % 5 = 3 THEN 'reversed' WHEN request_id % 5 = 4 AND z + 12 > 21 THEN 'range' END AS error
      FROM req""",
    "cover_ranges": W + _regions() + ", " + _RANGES + " SELECT region_id, step, z, x0, x1, y0, y1, tiles FROM counted",
    "strict_cover_ranges": W + _regions() + ", " + _STRICT + """ SELECT region_id, step, z, x0, x1, y0, y1,
      CAST(x1 - x0 AS BIGINT) * (y1 - y0) AS tiles FROM ranges""",
    "plan_guards": W + _regions("(c_custkey % 10) * 9", "CASE WHEN c_custkey % 2 = 0 THEN [8, 9] ELSE [4, 5, 6, 7] END")
    + ", " + _RANGES + """, cum AS (SELECT *, coalesce(sum(tiles) OVER (PARTITION BY region_id ORDER BY step
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counted),
      flagged AS (SELECT *, tiles < 0 OR tiles > 10000 OR before > 10000 AS broken FROM cum),
      stop AS (SELECT region_id, min(step) AS step FROM flagged WHERE broken GROUP BY region_id),
      total AS (SELECT f.region_id, f.layer_name, CAST(coalesce(sum(f.tiles) FILTER (s.step IS NULL OR f.step < s.step), 0) AS BIGINT) AS tiles,
          max(s.step) IS NOT NULL AS broken FROM flagged f LEFT JOIN stop s USING (region_id) GROUP BY 1, 2)
      SELECT region_id, layer_name, tiles, CASE WHEN broken THEN 'too many tiles in a zoom'
        WHEN tiles > 65535 THEN 'too many tiles in a run' END AS error FROM total""",
    "seed_plan": W + GOOD_PLAN + """ SELECT region_id, layer_name, step, z,
      CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM plan""",
    "missing_ranges": W + GOOD_PLAN + """, held AS (SELECT * FROM plan WHERE (x * 5 + y * 3 + region_id) % 4 <> 0),
      store AS (SELECT layer_name, z, x, y FROM held UNION SELECT layer_name, z, x + 1, y FROM held WHERE (x + 1 + y) % 5 = 0),
      lacking AS (SELECT DISTINCT layer_name, z, x, y FROM plan EXCEPT SELECT layer_name, z, x, y FROM store),
      r AS (SELECT *, x - row_number() OVER (PARTITION BY layer_name, z, y ORDER BY x) AS island FROM lacking)
      SELECT layer_name, z, CAST(y AS INT) AS y, CAST(min(x) AS INT) AS x0, CAST(max(x) + 1 AS INT) AS x1 FROM r GROUP BY layer_name, z, y, island""",
    "plan_summary": W + GOOD_PLAN + " SELECT layer_name, z, count(*) AS tiles FROM plan GROUP BY 1, 2",
    "tile_cover_function": W + _regions(zooms="[5]") + ", " + _STRICT + """ SELECT region_id,
      CAST(x AS INT) AS x, CAST(unnest(range(y0, y1)) AS INT) AS y FROM (SELECT *, unnest(range(x0, x1)) AS x FROM ranges)""",
}
SQL["plan_summary_closed_form"] = SQL["plan_summary"]
SQL["rejected_regions"] = f"SELECT region_id, error FROM ({SQL['plan_guards']}) p"
