"""Web-Mercator tile-pyramid maths as plain Column expressions.

Every function takes Columns (or column names) and returns a Column, so filters
on it can be pushed around by Catalyst.  What goes through ``let`` (geohashes, cover
ranges) is a lambda and is interpreted; all else is generated code.  Bounds are ``STRUCT<south,north,west,east: DOUBLE, srid: INT>``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tile scheme.
MAX_ZOOM = 21
MAX_LAT = 85.0511
MAX_LON = 180.0
MERCATOR_HALF = 20037508.342789
TOLERANCE = 1e-8
WGS84 = 4326
WEB_MERCATOR = 3857
GEOHASH_LENGTH = 12
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"

# Spark and the JVM print %.7f half-up; DecimalFormat patterns round half-even
# on the exact binary value, which is what C and Go do.
_F6 = "0.000000"
_F7 = "0.0000000"


def as_col(value) -> Column:
    """Column for a name, a Column or a literal."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def let(value, fn) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(as_col(value)), fn), F.lit(0))


def bounds(south, north, west, east, srid=WGS84) -> Column:
    return F.struct(
        as_col(south).cast("double").alias("south"),
        as_col(north).cast("double").alias("north"),
        as_col(west).cast("double").alias("west"),
        as_col(east).cast("double").alias("east"),
        as_col(srid).cast("int").alias("srid"),
    )


def tiles_per_axis(z) -> Column:
    return F.pow(F.lit(2.0), as_col(z).cast("double"))


# -- validity -----------------------------------------------------------------

def tile_error(z, x, y, srid=WGS84) -> Column:
    """Name of the first coordinate that is out of range, null when valid."""
    z, x, y, srid = as_col(z), as_col(x), as_col(y), as_col(srid)
    n = tiles_per_axis(z)
    return (
        F.when((z < 0) | (z > MAX_ZOOM), F.lit("Z"))
        .when(~srid.isin(WGS84, WEB_MERCATOR), F.lit("SRID"))
        .when((x < 0) | (x >= n), F.lit("X"))
        .when((y < 0) | (y >= n), F.lit("Y"))
    )


# -- tile to bounds -----------------------------------------------------------

def _edge_lat(y, n) -> Column:
    return F.lit(180 / math.pi) * F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / n)))


def tile_bounds(z, x, y) -> Column:
    """WGS84 bounds of a tile; null for an invalid tile."""
    z, x, y = as_col(z), as_col(x).cast("double"), as_col(y).cast("double")
    n = tiles_per_axis(z)
    box = bounds(
        _edge_lat(y + 1, n), _edge_lat(y, n), x / n * 360 - 180, (x + 1) / n * 360 - 180
    )
    return F.when(tile_error(z, x, y).isNull(), box)


def lat_to_3857(lat) -> Column:
    return (
        F.log(F.tan((90 + as_col(lat)) * math.pi / 360))
        / F.lit(math.pi / MAX_LON)
        * F.lit(MERCATOR_HALF / MAX_LON)
    )


def lon_to_3857(lon) -> Column:
    return as_col(lon) * MERCATOR_HALF / MAX_LON


def to_3857(b) -> Column:
    """Bounds in Web Mercator metres; already-projected bounds pass through."""
    b = as_col(b)
    projected = bounds(
        lat_to_3857(b["south"]),
        lat_to_3857(b["north"]),
        lon_to_3857(b["west"]),
        lon_to_3857(b["east"]),
        WEB_MERCATOR,
    )
    return F.when(b["srid"] == WEB_MERCATOR, b).when(b.isNotNull(), projected)


def tile_bounds_3857(z, x, y) -> Column:
    return to_3857(tile_bounds(z, x, y))


# -- point to tile ------------------------------------------------------------

def _mercator_row(lat, n) -> Column:
    rad = as_col(lat) * math.pi / 180
    return n * (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2


def _clamp(v, lo, hi) -> Column:
    return F.greatest(as_col(lo), F.least(as_col(hi), v))


def lonlat_tile(lon, lat, z) -> Column:
    """STRUCT<x,y> of the tile holding a point, clamped to the grid."""
    n = tiles_per_axis(z)
    lat = _clamp(as_col(lat), F.lit(-MAX_LAT), F.lit(MAX_LAT))
    x = F.floor((as_col(lon) + 180) / 360 * n)
    y = F.floor(_mercator_row(lat, n))
    top = (n - 1).cast("long")
    return F.struct(
        _clamp(x, F.lit(0).cast("long"), top).cast("int").alias("x"),
        _clamp(y, F.lit(0).cast("long"), top).cast("int").alias("y"),
    )


def flip_y(z, y) -> Column:
    """TMS row number of an XYZ row and the other way round."""
    return (tiles_per_axis(z) - as_col(y) - 1).cast("int")


# -- bounds predicates and geometry -------------------------------------------

def is_null_island(b) -> Column:
    b = as_col(b)
    return (b["east"] == 0) & (b["north"] == 0) & (b["west"] == 0) & (b["south"] == 0)


def bounds_intersect(a, b) -> Column:
    """Strict overlap: boxes that only touch do not intersect."""
    a, b = as_col(a), as_col(b)
    return (
        (b["north"] > a["south"])
        & (b["south"] < a["north"])
        & (b["east"] > a["west"])
        & (b["west"] < a["east"])
    )


def bounds_contain(outer, inner) -> Column:
    o, i = as_col(outer), as_col(inner)
    return (
        (i["south"] + TOLERANCE >= o["south"])
        & (i["north"] <= o["north"] + TOLERANCE)
        & (i["west"] + TOLERANCE >= o["west"])
        & (i["east"] <= o["east"] + TOLERANCE)
    )


def bounds_contain_point(b, x, y) -> Column:
    b, x, y = as_col(b), as_col(x), as_col(y)
    return (
        (y + TOLERANCE >= b["south"])
        & (y <= b["north"] + TOLERANCE)
        & (x + TOLERANCE >= b["west"])
        & (x <= b["east"] + TOLERANCE)
    )


def tile_intersects(z, x, y, b, srid=WGS84) -> Column:
    """True for unrestricted bounds, null for an invalid tile, else the overlap test."""
    tile = tile_bounds(z, x, y) if srid == WGS84 else tile_bounds_3857(z, x, y)
    return (
        F.when(is_null_island(b), F.lit(True))
        .when(tile_error(z, x, y, srid).isNotNull(), F.lit(None).cast("boolean"))
        .otherwise(bounds_intersect(tile, b))
    )


def bounds_width(b) -> Column:
    b = as_col(b)
    return F.abs(b["east"] - b["west"])


def bounds_height(b) -> Column:
    b = as_col(b)
    return F.abs(b["north"] - b["south"])


def bounds_centroid(b) -> Column:
    b = as_col(b)
    return F.struct(
        ((b["west"] + b["east"]) / 2).alias("x"), ((b["north"] + b["south"]) / 2).alias("y")
    )


def bounds_buffer(b, pct) -> Column:
    """Grow the total width and height by ``pct``, half on each side."""
    b, pct = as_col(b), as_col(pct)
    dw = bounds_width(b) * pct / 2
    dh = bounds_height(b) * pct / 2
    return bounds(b["south"] - dh, b["north"] + dh, b["west"] - dw, b["east"] + dw, b["srid"])


def bounds_confine(b) -> Column:
    b = as_col(b)
    mercator = b["srid"] == WEB_MERCATOR
    lat = F.when(mercator, F.lit(MERCATOR_HALF)).otherwise(F.lit(MAX_LAT))
    lon = F.when(mercator, F.lit(MERCATOR_HALF)).otherwise(F.lit(MAX_LON))
    return bounds(
        _clamp(b["south"], -lat, lat),
        _clamp(b["north"], -lat, lat),
        _clamp(b["west"], -lon, lon),
        _clamp(b["east"], -lon, lon),
        b["srid"],
    )


def _fixed(v: Column, pattern: str) -> Column:
    # A rounded-away negative prints as plain zero.
    text = F.call_function("format_number", v, F.lit(pattern))
    return F.regexp_replace(text, r"\A-(0\.0+)\z", "$1")


def fixed6(v) -> Column:
    return _fixed(as_col(v), _F6)


def bounds_wkt(b) -> Column:
    b = as_col(b)
    s, n, w, e = (_fixed(b[k], _F7) for k in ("south", "north", "west", "east"))
    corner = [(w, s), (w, n), (e, n), (e, s), (w, s)]
    ring = F.concat_ws(",", *[F.concat_ws(" ", a, c) for a, c in corner])
    return F.when(b.isNotNull(), F.concat(F.lit("POLYGON(("), ring, F.lit("))")))


def bounds_ewkt(b) -> Column:
    b = as_col(b)
    return F.concat(F.lit("SRID="), b["srid"].cast("string"), F.lit(";"), bounds_wkt(b))


# -- geohash ------------------------------------------------------------------

def geohash_valid(code) -> Column:
    code = as_col(code)
    return code.rlike(f"\\A[{GEOHASH_ALPHABET}]{{0,12}}\\z")


def _digit_alphabet(bits: tuple[int, ...]) -> str:
    """Digit of each alphabet character made of the given bits of its value."""
    return "".join(
        str(sum((v >> bit & 1) << i for i, bit in enumerate(bits))) for v in range(len(GEOHASH_ALPHABET))
    )


def geohash_bounds(code) -> Column:
    """Bounding box of a geohash; null when it holds a foreign character.

    A character carries five bits, by turns three for one axis and two for the
    other.  ``translate`` turns the text into the digits of either share, and the
    digits add up to a 30-bit position per axis.
    """
    code = as_col(code)
    three = F.translate(code, GEOHASH_ALPHABET, _digit_alphabet((0, 2, 4)))
    two = F.translate(code, GEOHASH_ALPHABET, _digit_alphabet((1, 3)))

    def position(odd, even):
        total, used = F.lit(0), 0
        for at in range(1, GEOHASH_LENGTH + 1):
            digits, width = odd if at % 2 else even
            used += width
            digit = F.greatest(F.ascii(F.substring(digits, at, 1)) - ord("0"), F.lit(0))
            total = total + digit * (1 << (30 - used))
        return total

    def corner(s):
        lon = position((s["three"], 3), (s["two"], 2))
        lat = position((s["two"], 2), (s["three"], 3))
        return F.struct(
            (lon * (360 / 2**30) - 180).alias("west"),
            (lat * (180 / 2**30) - 90).alias("south"),
            (360 / F.pow(F.lit(2.0), F.ceil(s["n"] * 5 / 2))).alias("wide"),
            (180 / F.pow(F.lit(2.0), F.floor(s["n"] * 5 / 2))).alias("high"),
        )

    shares = F.struct(three.alias("three"), two.alias("two"), F.length(code).alias("n"))
    box = let(
        let(shares, corner),
        lambda c: bounds(c["south"], c["south"] + c["high"], c["west"], c["west"] + c["wide"]),
    )
    return F.when(geohash_valid(code), box)


# -- zoom lists ---------------------------------------------------------------

def zoom_list_error(text) -> Column:
    """Null for a good zoom text, else what is wrong with its first bad entry."""
    entries = F.split(as_col(text), ",", -1)

    def problem(e):
        ends = F.split(e, "-", -1)
        lo = ends[0].try_cast("int")
        hi = F.when(F.size(ends) == 2, F.get(ends, F.lit(1)).try_cast("int")).otherwise(lo)
        return (
            F.when(F.size(ends) > 2, F.lit("format"))
            .when(lo.isNull() | hi.isNull() | e.rlike(r"\s"), F.lit("format"))
            .when(hi < lo, F.lit("reversed"))
            .when((lo < 0) | (hi > MAX_ZOOM), F.lit("range"))
        )

    bad = F.filter(F.transform(entries, problem), lambda p: p.isNotNull())
    return F.get(bad, F.lit(0))


def zoom_list(text) -> Column:
    """``1-3,6`` to ``[1,2,3,6]``; duplicates stay, a bad text gives null."""
    text = as_col(text)

    def expand(e):
        ends = F.split(e, "-", -1)
        lo = ends[0].try_cast("int")
        return F.sequence(lo, F.coalesce(F.get(ends, F.lit(1)).try_cast("int"), lo))

    return F.when(
        zoom_list_error(text).isNull(), F.flatten(F.transform(F.split(text, ",", -1), expand))
    )


def parse_zooms(text: str) -> list[int]:
    """Driver-side twin of ``zoom_list`` for job arguments; raises on bad text."""
    zooms: list[int] = []
    for entry in text.split(","):
        ends = [int(e) for e in entry.split("-")] if entry.replace("-", "").isdigit() else []
        if len(ends) not in (1, 2):
            raise ValueError(f"cannot parse zoom {entry!r}")
        lo, hi = ends[0], ends[-1]
        if hi < lo:
            raise ValueError("a zoom range must start before it ends")
        if lo < 0 or hi > MAX_ZOOM:
            raise ValueError("zoom out of range")
        zooms.extend(range(lo, hi + 1))
    return zooms
