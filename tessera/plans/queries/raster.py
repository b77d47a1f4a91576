"""Raster map-algebra queries over embedding-derived 8x8 tiles."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from tessera.functions.tiles import bounds
from tessera.operators import raster as r
from tessera.operators.layers import expand_pattern
from tessera.plans.queries import sql
from tessera.sources import derived as d

KEYS = ["z", "x", "y", "vec_id"]
CELL = [*KEYS, "px", "py"]


def base(spark, sf):
    return d.raster_tiles(spark, sf)


def over(spark, sf):
    """Shifted colours with the green band as alpha."""
    t = d.raster_tiles(spark, sf, 64)
    return t.withColumn("a", F.col("g"))


def coarse(spark, sf):
    """4x4 tiles: the means of two by two pixels; one tile in ten is missing or failed."""
    t = d.raster_tiles(spark, sf, 32)

    def halved(band):
        def mean(i):
            first = F.floor(i / 4).cast("int") * 16 + i % 4 * 2
            total = sum(F.get(band, first + k) for k in (0, 1, 8, 9))
            return F.floor(total / 4).cast("int")

        return F.transform(F.sequence(F.lit(0), F.lit(15)), mean)

    small = t.withColumns({b: halved(b) for b in r.BANDS}).withColumns(
        {"width": F.lit(4), "height": F.lit(4), "error": F.when(F.col("vec_id") % 20 == 3, F.lit("bad")),
         "skip_cache": F.col("vec_id") % 5 == 0}
    )
    return small.where("vec_id % 20 <> 13")


def blend_mode(mode):
    amount = 0.25 if mode == "opacity" else 0.0
    return lambda s, p: r.blend([base(s, p), over(s, p)], KEYS, mode, amount).drop("skip_cache")


def blend_resampled(spark, sf):
    return r.blend([coarse(spark, sf), over(spark, sf), base(spark, sf)], KEYS, "screen")


def blend_errors(spark, sf):
    return r.blend_errors([coarse(spark, sf), over(spark, sf), base(spark, sf)], KEYS)


def blend_keys(spark, sf):
    """Every key once, as blended or as failed, where inputs lack, fail or repeat keys."""
    once, more = base(spark, sf), over(spark, sf)
    twice = more.unionByName(more.where("vec_id % 7 = 2"))
    lacking = twice.where("vec_id % 11 <> 4")
    inputs = [once.unionByName(once.where("vec_id % 11 = 4")), lacking]
    blended = r.blend(inputs, KEYS).select(*KEYS).distinct()
    none = F.lit(0)
    return blended.select(*KEYS, none.alias("missing"), none.alias("repeated")).unionByName(r.blend_errors(inputs, KEYS))


def large_tiles(spark, sf):
    """256 x 256 tiles, the values of 1,024 embeddings each; the last tile is filled up with zeros."""
    t = d.raster_tiles(spark, sf)
    rows = F.sort_array(F.collect_list(F.struct("vec_id", *r.BANDS)))
    grouped = t.groupBy((F.col("vec_id") / 1024).cast("long").alias("vec_id")).agg(rows.alias("_rows"))

    def band(c):
        values = F.flatten(F.transform("_rows", lambda v: v[c]))
        rest = F.array_repeat(F.lit(0), F.lit(65_536) - F.size(values))
        return F.concat(values, rest).alias(c)

    side = F.lit(256)
    return grouped.select(
        F.lit(5).alias("z"), F.lit(0).alias("x"), F.lit(0).alias("y"), "vec_id", side.alias("width"), side.alias("height"),
        *[band(c) for c in r.BANDS],
    )


def blended_large(spark, sf):
    """256 x 256 tiles under their own colours turned, one of which is the alpha: tile to tile, then shown as pixels."""
    tiles = large_tiles(spark, sf)
    veil = tiles.withColumns({"r": F.col("g"), "g": F.col("b"), "b": F.col("r"), "a": F.col("g")})
    return r.pixels(r.blend_tiles([veil, tiles], KEYS, "overlay"), KEYS)


def smoothed_large(spark, sf):
    px = r.focal_effect(large_tiles(spark, sf), KEYS, "gaussian", 1.5)
    return px.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("pixels"), F.max("px").alias("last"), F.sum("a").alias("alpha"))


def blended_pattern(spark, sf):
    """Three scans of the same place, named by a pattern and its values, later ones below."""
    i = F.col("vec_id")
    store = base(spark, sf).withColumn("layer_name", F.concat(F.lit("scan_"), (i % 3).cast("string")))
    store = store.withColumn("place", F.floor(i / 3))
    names = [name for _, name in expand_pattern("scan_{n}", [{"n": "2"}, {"n": "0"}, {"n": "1"}])]
    return r.blend_layers(store, names, ["place"], "lighten").drop("skip_cache")


def resampled(spark, sf):
    return r.resample(base(spark, sf), KEYS, 12, 10)


def cropped(spark, sf):
    area = F.when(F.col("vec_id") % 5 == 0, bounds(0, 0, 0, 0)).otherwise(bounds(-40.5, 60.25, -100.3, 120.7))
    return r.crop(base(spark, sf), over(spark, sf).where("vec_id % 7 <> 0"), KEYS, area)


def rotated(spark, sf):
    return r.transform_pixels(r.pixels(base(spark, sf), KEYS), lambda red, g, b, a: (g, b, red, a))


def rotated_pandas(spark, sf):
    @F.pandas_udf("int")
    def dim(v):
        return v // 2

    return r.transform_pixels(r.pixels(base(spark, sf), KEYS), lambda red, g, b, a: (dim(g), dim(b), dim(red), a))


def packed(spark, sf):
    tiles = r.pack(r.pixels(base(spark, sf), KEYS), KEYS)
    joined = base(spark, sf).select(*KEYS, F.col("r").alias("r0"), F.col("b").alias("b0"))
    return tiles.join(joined, KEYS).select(
        *KEYS, "width", "height", ((F.col("r") == F.col("r0")) & (F.col("b") == F.col("b0"))).alias("same")
    )


POINT = {
    "brightness": 0.25, "contrast": -0.5, "gamma": 2.2, "hue": 75, "saturation": 0.5, "threshold": 120,
    "grayscale": 0.0, "invert": 0.0, "sepia": 0.0,
}
FOCAL = {
    "blur": 2, "gaussian": 1.5, "dilate": 1, "erode": 1, "median": 1, "edge detection": 1,
    "emboss": 0.0, "sharpen": 0.0, "sobel": 0.0,
}


def point(mode, amount):
    return lambda s, p: r.point_effect(r.pixels(base(s, p), KEYS), mode, amount)


def focal(mode, amount):
    return lambda s, p: r.focal_effect(base(s, p), KEYS, mode, amount)


def constant_tiles(spark, sf):
    keys = d.tile_requests(spark, sf).select("layer_name", "z", "x", "y").distinct()
    return r.constant_tiles(keys, "f018")


def constant_blend(spark, sf):
    keys = base(spark, sf).select(*KEYS)
    veil = r.expand_constant(r.constant_tiles(keys, "0A648080", 8))
    return r.blend([veil, base(spark, sf)], KEYS, "normal").drop("skip_cache")


def key(prefix, mode):
    return prefix + mode.replace(" ", "_")


QUERIES = {
    "pixels": lambda s, p: r.pixels(base(s, p), KEYS),
    "packed_pixels": packed,
    **{key("blend_", m): blend_mode(m) for m in r.BLEND_MODES},
    "blend_resampled": blend_resampled,
    "blend_large": blended_large,
    "blend_errors": blend_errors,
    "blend_keys": blend_keys,
    "blended_pattern": blended_pattern,
    "resampled": resampled,
    "cropped": cropped,
    "rotated_channels": rotated,
    "rotated_channels_pandas": rotated_pandas,
    **{key("effect_", m): point(m, v) for m, v in POINT.items()},
    **{key("effect_", m): focal(m, v) for m, v in FOCAL.items()},
    "effect_gaussian_large": smoothed_large,
    "constant_tiles": constant_tiles,
    "constant_blend": constant_blend,
}

W = "WITH "
_K = "z, x, y, vec_id"


def _pix(name="p", shift=0, alpha="255"):
    """Pixel rows of a raster input; q is the position, c<band> the value."""

    def band(extra):
        return f"CAST((CAST(floor(abs(CAST(embedding[q + 1] AS DOUBLE)) * 1000) AS INT) + {extra + shift}) % 256 AS INT)"

    return f"""{name} AS (SELECT 5 AS z, CAST(vec_id % 32 AS INT) AS x, CAST((vec_id // 32) % 32 AS INT) AS y, vec_id,
    CAST(q % 8 AS INT) AS px, CAST(q // 8 AS INT) AS py, {band(0)} AS r, {band(85)} AS g, {band(170)} AS b,
    {alpha if alpha == '255' else band(85)} AS a
  FROM embeddings, (SELECT unnest(range(64)) AS q) i)"""


def _byte(e):
    return f"CAST(greatest(0, least(255, floor({e} + 0.5))) AS INT)"


_B = {
    "add": "b + s", "darken": "least(b, s)", "lighten": "greatest(b, s)", "difference": "abs(b - s)",
    "color burn": "CASE WHEN b >= 1 THEN 1.0 WHEN s <= 0 THEN 0.0 ELSE 1 - (1 - b) / s END",
    "color dodge": "CASE WHEN b <= 0 THEN 0.0 WHEN s >= 1 THEN 1.0 ELSE b / (1 - s) END",
    "divide": "CASE WHEN s <= 0 THEN 1.0 ELSE b / s END", "exclusion": "b + s - 2 * b * s",
    "linear burn": "b + s - 1", "linear light": "b + 2 * s - 1", "multiply": "b * s", "normal": "s",
    "opacity": "s", "overlay": "CASE WHEN b <= 0.5 THEN 2 * b * s ELSE 1 - 2 * (1 - b) * (1 - s) END",
    "screen": "b + s - b * s", "soft light": "(1 - 2 * s) * b * b + 2 * b * s", "subtract": "s - b",
}


def _mix(mode, opacity=1.0):
    """Columns r, g, b, a of under row u and over row o."""
    sa = "(o.a / 255.0::DOUBLE)" + (f" * {opacity}::DOUBLE" if opacity != 1.0 else "")
    ab = "(u.a / 255.0::DOUBLE)"
    ao = f"({sa} + {ab} * (1 - {sa}))"
    out = []
    for c in "rgb":
        b, s = f"(u.{c} / 255.0::DOUBLE)", f"(o.{c} / 255.0::DOUBLE)"
        fn = _B[mode].replace("abs", "ABS").replace("least", "LEAST").replace("greatest", "GREATEST")
        text = re.sub(r"\b([bs])\b", lambda m: b if m.group(1) == "b" else s, fn)
        mixed = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {text}))"
        total = f"({sa} * (1 - {ab}) * {s} + {sa} * {ab} * {mixed} + (1 - {sa}) * {ab} * {b})"
        out.append(f"{_byte(f'CASE WHEN {ao} > 0 THEN {total} / {ao} * 255 ELSE 0.0 END')} AS {c}")
    out.append(f"{_byte(f'{ao} * 255')} AS a")
    return ", ".join(out)


def _blend(mode, opacity=1.0):
    return (W + _pix("o") + ", " + _pix("u", 64, alpha="g")
            + f" SELECT {_K}, px, py, {_mix(mode, opacity)} FROM u JOIN o USING ({_K}, px, py)")


_LUMA = "(r * 3 + g * 6 + b)"


def _each(e):
    return ", ".join(f"{_byte(e.replace('@', c))} AS {c}" for c in "rgb") + ", a"


def _point(select):
    return W + _pix() + f" SELECT {_K}, px, py, {select} FROM p"


_HSL = W + _pix() + """, c AS (SELECT *, r / 255.0::DOUBLE AS fr, g / 255.0::DOUBLE AS fg, b / 255.0::DOUBLE AS fb FROM p),
  m AS (SELECT *, greatest(fr, fg, fb) AS hi, least(fr, fg, fb) AS lo FROM c),
  l AS (SELECT *, hi - lo AS span, (hi + lo) / 2 AS light FROM m),
  h AS (SELECT *, CASE WHEN span = 0 THEN 0.0 ELSE span / (1 - abs(2 * light - 1)) END AS s0,
    CASE WHEN span = 0 THEN 0.0 WHEN hi = fr THEN (fg - fb) / span WHEN hi = fg THEN (fb - fr) / span + 2 ELSE (fr - fg) / span + 4 END AS sector FROM l),
  t AS (SELECT *, fmod(fmod(sector * 60 + {deg}, 360.0) + 360.0, 360.0) AS hue, greatest(0.0, least(1.0, s0 * (1 + {sat}))) AS sat FROM h),
  k AS (SELECT *, (1 - abs(2 * light - 1)) * sat AS chroma FROM t) SELECT z, x, y, vec_id, px, py, """
_HSL_END = ", ".join(
    _byte(f"(light - chroma / 2 * greatest(-1.0, least(fmod(hue / 30 + {turn}, 12.0) - 3, 9 - fmod(hue / 30 + {turn}, 12.0), 1.0))) * 255") + f" AS {c}"
    for c, turn in (("r", 0), ("g", 8), ("b", 4))
) + ", a FROM k"


def _around(half):
    """Pixel rows joined with their square neighbourhood, the edge repeated."""
    return W + _pix() + f""", o AS (SELECT * FROM (SELECT CAST(unnest(range({-half}, {half + 1})) AS INT) AS dx) i,
      (SELECT CAST(unnest(range({-half}, {half + 1})) AS INT) AS dy) j),
    n AS (SELECT p.z, p.x, p.y, p.vec_id, p.px, p.py, p.a AS a0, p.r AS r0, p.g AS g0, p.b AS b0, dx, dy, q.r, q.g, q.b, q.a,
        q.r * 3 + q.g * 6 + q.b AS rank
      FROM p, o, p q WHERE q.vec_id = p.vec_id AND q.px = greatest(0, least(7, p.px + dx)) AND q.py = greatest(0, least(7, p.py + dy)))"""


def _grouped(half, value):
    return _around(half) + f" SELECT {_K}, px, py, " + ", ".join(
        f"{_byte(re.sub('@0', f'{c}0', value).replace('@', c))} AS {c}" for c in "rgb"
    ) + f", max(a0) AS a FROM n GROUP BY {_K}, px, py"


def _ranked(order, pick):
    return _around(1) + f""", k AS (SELECT *, row_number() OVER (PARTITION BY {_K}, px, py ORDER BY rank {order}, r {order}, g {order}, b {order}, a {order}) AS rn FROM n)
      SELECT {_K}, px, py, r, g, b, a FROM k WHERE rn = {pick}"""


def _kernel(rows):
    return "sum(@ * CASE " + " ".join(
        f"WHEN dx = {i - 1} AND dy = {j - 1} THEN {w}" for j, row in enumerate(rows) for i, w in enumerate(row) if w
    ) + " ELSE 0 END)"


_SX = _kernel(((-1, 0, 1), (-2, 0, 2), (-1, 0, 1)))
_SY = _kernel(((-1, -2, -1), (0, 0, 0), (1, 2, 1)))
_TILE = {"s": sql.lat_m(sql.lat_edge("y + 1")), "n": sql.lat_m(sql.lat_edge("y")), "w": sql.lon_m(sql.lon_edge("x")), "e": sql.lon_m(sql.lon_edge("x + 1"))}

SQL = {
    "pixels": _point("r, g, b, a"),
    "packed_pixels": f"""SELECT 5 AS z, CAST(vec_id % 32 AS INT) AS x, CAST((vec_id // 32) % 32 AS INT) AS y, vec_id,
      8 AS width, 8 AS height, true AS same FROM embeddings""",
    **{key("blend_", m): _blend(m, 0.25 if m == "opacity" else 1.0) for m in r.BLEND_MODES},
    "blend_resampled": W + _pix("c0", 32) + f""", c AS (
        SELECT {_K}, px // 2 AS px, py // 2 AS py, {", ".join(f"CAST(sum({c}) // 4 AS INT) AS {c}" for c in "rgba")}
        FROM c0 WHERE vec_id % 20 NOT IN (3, 13) GROUP BY {_K}, px // 2, py // 2), """ + _pix("v", 64, alpha="g") + ", " + _pix("w") + f""",
      m1 AS (SELECT u.z, u.x, u.y, u.vec_id, u.px, u.py, {_mix('screen')} FROM v u JOIN c o
        ON o.vec_id = u.vec_id AND o.px = u.px // 2 AND o.py = u.py // 2)
      SELECT {_K}, px, py, {_mix('screen')}, vec_id % 5 = 0 AS skip_cache FROM w u JOIN m1 o USING ({_K}, px, py)""",
    "blend_large": W + _pix("p0") + f""", p AS (
        SELECT vec_id // 1024 AS vec_id, (vec_id % 1024) * 64 + py * 8 + px AS i, r, g, b, a FROM p0),
      whole AS (SELECT v.vec_id, j.i, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a
        FROM (SELECT DISTINCT vec_id FROM p) v CROSS JOIN (SELECT unnest(range(65536)) AS i) j LEFT JOIN p ON p.vec_id = v.vec_id AND p.i = j.i),
      veil AS (SELECT vec_id, i, g AS r, b AS g, r AS b, g AS a FROM whole)
      SELECT 5 AS z, 0 AS x, 0 AS y, vec_id, CAST(i % 256 AS INT) AS px, CAST(i // 256 AS INT) AS py, {_mix('overlay')}
      FROM whole u JOIN veil o USING (vec_id, i)""",
    "effect_gaussian_large": """SELECT 5 AS z, 0 AS x, 0 AS y, vec_id // 1024 AS vec_id, CAST(65536 AS BIGINT) AS pixels,
      255 AS last, CAST(sum(255 * 64) AS BIGINT) AS alpha FROM embeddings GROUP BY vec_id // 1024""",
    "blend_errors": """SELECT 5 AS z, CAST(vec_id % 32 AS INT) AS x, CAST((vec_id // 32) % 32 AS INT) AS y, vec_id, 1 AS missing, 0 AS repeated
      FROM embeddings WHERE vec_id % 20 IN (3, 13)""",
    "blended_pattern": W + _pix() + """ SELECT vec_id // 3 AS place, px, py, max(r) AS r, max(g) AS g, max(b) AS b, 255 AS a
      FROM p GROUP BY ALL HAVING count(*) = 3""",
    "blend_keys": """SELECT 5 AS z, CAST(vec_id % 32 AS INT) AS x, CAST((vec_id // 32) % 32 AS INT) AS y, vec_id,
      CAST(vec_id % 11 = 4 AS INT) AS missing, CAST(vec_id % 11 = 4 AS INT) + CAST(vec_id % 7 = 2 AND vec_id % 11 <> 4 AS INT) AS repeated
      FROM embeddings""",
    "resampled": W + _pix() + f""", t AS (SELECT CAST(unnest(range(12)) AS INT) AS nx), s AS (SELECT CAST(unnest(range(10)) AS INT) AS ny)
      SELECT {_K}, nx AS px, ny AS py, r, g, b, a FROM p, t, s WHERE px = nx * 8 // 12 AND py = ny * 8 // 10""",
    "cropped": W + _pix("p") + ", " + _pix("s", 64, "g") + f""", e AS (SELECT *, {_TILE['s']} AS ts, {_TILE['n']} AS tn, {_TILE['w']} AS tw, {_TILE['e']} AS te,
          vec_id % 5 = 0 AS o, {sql.lat_edge('y')} > -40.5 AND {sql.lat_edge('y + 1')} < 60.25 AND {sql.lon_edge('x + 1')} > -100.3 AND {sql.lon_edge('x')} < 120.7 AS meets FROM p),
      f AS (SELECT *, px / 8.0::DOUBLE * abs(te - tw) + tw + abs(te - tw) / 8 / 2 AS lon, tn - py / 8.0::DOUBLE * abs(tn - ts) - abs(tn - ts) / 8 / 2 AS lat FROM e),
      g AS (SELECT *, o OR (meets AND lat + 0.00000001 >= {sql.lat_m('(-40.5::DOUBLE)')} AND lat <= {sql.lat_m('60.25::DOUBLE')} + 0.00000001
          AND lon + 0.00000001 >= {sql.lon_m('(-100.3::DOUBLE)')} AND lon <= {sql.lon_m('120.7::DOUBLE')} + 0.00000001) AS mine FROM f)
      SELECT {_K}, px, py, """ + ", ".join(f"CASE WHEN mine THEN g.{c} ELSE s.{c} END AS {c}" for c in "rgba")
    + f" FROM g LEFT JOIN (SELECT * FROM s WHERE vec_id % 7 <> 0) s USING ({_K}, px, py) WHERE o OR s.r IS NOT NULL",
    "rotated_channels": _point("g AS r, b AS g, r AS b, a"),
    "rotated_channels_pandas": _point("CAST(g // 2 AS INT) AS r, CAST(b // 2 AS INT) AS g, CAST(r // 2 AS INT) AS b, a"),
    "effect_brightness": _point(_each("@ * (1 + 0.25::DOUBLE)")),
    "effect_contrast": _point(_each("((@ / 255.0::DOUBLE - 0.5) * (1 + -0.5::DOUBLE) + 0.5) * 255")),
    "effect_gamma": _point(_each(f"pow(@ / 255.0::DOUBLE, {1 / 2.2!r}) * 255")),
    "effect_hue": _HSL.replace("{deg}", "75.0::DOUBLE").replace("{sat}", "0.0::DOUBLE") + _HSL_END,
    "effect_saturation": _HSL.replace("{deg}", "0.0::DOUBLE").replace("{sat}", "0.5::DOUBLE") + _HSL_END,
    "effect_threshold": _point(", ".join(f"CASE WHEN ({_LUMA} + 5) // 10 >= 120 THEN 255 ELSE 0 END AS {c}" for c in "rgb") + ", a"),
    "effect_grayscale": _point(", ".join(f"CAST(({_LUMA} + 5) // 10 AS INT) AS {c}" for c in "rgb") + ", a"),
    "effect_invert": _point("CAST(255 - r AS INT) AS r, CAST(255 - g AS INT) AS g, CAST(255 - b AS INT) AS b, a"),
    "effect_sepia": _point(", ".join(
        _byte(f"({m[0]}::DOUBLE * r + {m[1]}::DOUBLE * g + {m[2]}::DOUBLE * b)") + f" AS {c}" for c, m in r.SEPIA.items()) + ", a"),
    "effect_blur": _grouped(2, "sum(@) / 25.0::DOUBLE"),
    "effect_dilate": _ranked("DESC", 1),
    "effect_erode": _ranked("", 1),
    "effect_median": _ranked("", 5),
    "effect_edge_detection": _grouped(1, "(9 * max(@0) - sum(@))"),
    "effect_emboss": _grouped(1, "(" + _kernel(((-1, -1, 0), (-1, 0, 1), (0, 1, 1))) + " + 128)"),
    "effect_sharpen": _grouped(1, _kernel(((0, -1, 0), (-1, 5, -1), (0, -1, 0)))),
    "effect_sobel": _grouped(1, f"sqrt(pow(CAST({_SX} AS DOUBLE), 2.0) + pow(CAST({_SY} AS DOUBLE), 2.0))"),
    "constant_tiles": W + sql.REQ + """ SELECT DISTINCT layer_name, z, x, y, 512 AS width, 512 AS height, 255 AS r, 0 AS g, 17 AS b, 136 AS a
      FROM req""",
    "constant_blend": W + _pix("u") + f" SELECT {_K}, px, py, {_mix('normal')} FROM u, (SELECT 10 AS r, 100 AS g, 128 AS b, 128 AS a) o",
}
_W = [math.exp(-(k * k) / 6.0) for k in range(-2, 3)]
_G = " + ".join(
    f"sum(@ * CASE WHEN dy = {j} THEN {_W[j + 2]!r}::DOUBLE ELSE 0.0::DOUBLE END * CASE dx " + " ".join(f"WHEN {i} THEN {_W[i + 2]!r}::DOUBLE" for i in range(-2, 3)) + " END)"
    for j in range(-2, 3)
)
SQL["effect_gaussian"] = _grouped(2, f"({_G}) / {sum(_W) * sum(_W)!r}::DOUBLE")
