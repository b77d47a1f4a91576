"""Raster map algebra over RGBA tiles.

A raster tile is one row: key columns, ``width``, ``height`` and one array per
band (``r g b a``, 0-255, row-major).  Tiles are joined whole, so shuffles move
one row per tile.  Blending works on whole bands, a block of tiles at a time.  For
the other operators pixels appear by exploding an index next to the arrays, and the
arithmetic reads the arrays by position inside whole-stage codegen; a neighbourhood is
just more positions of the same row and needs no shuffle.

Blending follows the published compositing equations: for a backdrop b under a
source s with separable function B, straight alpha,
``ao = as + ab*(1-as)`` and
``ao*co = as*(1-ab)*cs + as*ab*B(cb,cs) + (1-as)*ab*cb``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import parse_color
from tessera.functions.tiles import (
    as_col,
    bounds_contain_point,
    bounds_height,
    bounds_intersect,
    bounds_width,
    is_null_island,
    let,
    tile_bounds,
    tile_bounds_3857,
    to_3857,
)

BANDS = ("r", "g", "b", "a")
COLOURS = ("r", "g", "b")
CONSTANT_SIZE = 512
MIN_INPUTS, MAX_INPUTS = 2, 100
#: Pixels that are blended at a time; a larger tile is a block of its own.
BLOCK_PIXELS = 1 << 20


def to_byte(v: Column) -> Column:
    """Nearest whole number in 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v + 0.5).cast("int")))


# -- tiles and pixels ---------------------------------------------------------

def with_index(tiles: DataFrame, width="width", height="height", bands: Sequence[str] = ()) -> DataFrame:
    """One row per pixel position ``px, py`` beside the untouched arrays.

    ``bands`` must hold width x height values each.  The test also makes the
    generator read them, so computed bands are made once per tile; code generation
    would otherwise put them off and make them again for every pixel.
    """
    n = (as_col(width) * as_col(height)).cast("int")
    if bands:
        own = F.col("width") * F.col("height")
        fits = F.lit(True)
        for name in bands:
            fits = fits & (F.size(name) == own)
        n = F.when(fits, n).otherwise(F.raise_error(F.lit("a band does not fit width x height")).cast("int"))
    return tiles.withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1))).withColumns(
        {
            "px": (F.col("_i") % as_col(width)).cast("int"),
            "py": F.floor(F.col("_i") / as_col(width)).cast("int"),
        }
    )


def pixels(tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    at = F.col("_i")
    return with_index(tiles, bands=BANDS).select(
        *keys, "px", "py", *[F.get(b, at).alias(b) for b in BANDS]
    )


def pack(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels back to one row per tile; a group is one tile, so it stays small."""
    cells = F.array_sort(F.collect_list(F.struct("py", "px", *BANDS)))
    grouped = px.groupBy(*keys).agg(
        (F.max("px") + 1).alias("width"), (F.max("py") + 1).alias("height"), cells.alias("_c")
    )
    return grouped.select(
        *keys, "width", "height", *[F.col("_c")[b].alias(b) for b in BANDS]
    )


def resampled_index(width, height, own_width, own_height) -> Column:
    """Position in a smaller raster of pixel (px, py) of a larger one (nearest)."""
    w, h, ow, oh = (as_col(v) for v in (width, height, own_width, own_height))
    sx, sy = F.floor(F.col("px") * ow / w), F.floor(F.col("py") * oh / h)
    return F.when((ow == w) & (oh == h), F.col("_i")).otherwise((sy * ow + sx).cast("int"))


def resample(tiles: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    big = with_index(tiles, F.lit(width), F.lit(height), BANDS)
    at = resampled_index(F.lit(width), F.lit(height), "width", "height")
    return big.select(*keys, "px", "py", *[F.get(b, at).alias(b) for b in BANDS])


# -- blending -----------------------------------------------------------------

def _where(*cases) -> np.ndarray:
    """The value of the first condition that holds: ``_where(cond, value, ..., otherwise)``."""
    *pairs, out = cases
    for cond, value in reversed(list(zip(pairs[::2], pairs[1::2]))):
        out = np.where(cond, value, out)
    return out


SEPARABLE: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "add": lambda b, s: b + s,
    "color burn": lambda b, s: _where(b >= 1, 1.0, s <= 0, 0.0, 1 - (1 - b) / s),
    "color dodge": lambda b, s: _where(b <= 0, 0.0, s >= 1, 1.0, b / (1 - s)),
    "darken": np.minimum,
    "difference": lambda b, s: np.abs(b - s),
    "divide": lambda b, s: _where(s <= 0, 1.0, b / s),
    "exclusion": lambda b, s: b + s - 2 * b * s,
    "lighten": np.maximum,
    "linear burn": lambda b, s: b + s - 1,
    "linear light": lambda b, s: b + 2 * s - 1,
    "multiply": lambda b, s: b * s,
    "normal": lambda b, s: s,
    "opacity": lambda b, s: s,
    "overlay": lambda b, s: _where(b <= 0.5, 2 * b * s, 1 - 2 * (1 - b) * (1 - s)),
    "screen": lambda b, s: b + s - b * s,
    "soft light": lambda b, s: (1 - 2 * s) * b * b + 2 * b * s,
    "subtract": lambda b, s: s - b,
}
BLEND_MODES = tuple(SEPARABLE)
Bands = dict[str, np.ndarray]


def blend_bands(over: Bands, under: Bands, mode: str, opacity: float = 0.0) -> Bands:
    """Whole bands of 0-255 values put over others of the same length."""
    s, b = ({c: bands[c] / 255.0 for c in BANDS} for bands in (over, under))
    sa = s["a"] * opacity if mode == "opacity" else s["a"]
    ab = b["a"]
    ao = sa + ab * (1 - sa)

    def byte(v: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(v + 0.5), 0, 255).astype(np.int32)

    out = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in COLOURS:
            mixed = np.clip(SEPARABLE[mode](b[c], s[c]), 0.0, 1.0)
            total = sa * (1 - ab) * s[c] + sa * ab * mixed + (1 - sa) * ab * b[c]
            out[c] = byte(np.where(ao > 0, total / ao * 255, 0.0))
    return {**out, "a": byte(ao * 255)}


def _stretched(tiles: pa.StructArray, width: np.ndarray, height: np.ndarray) -> Bands:
    """Bands of all tiles end to end, each tile brought to its size by the nearest pixel."""
    own_w, own_h = (tiles.field(c).to_numpy() for c in ("width", "height"))
    sizes = width * height
    tile = np.repeat(np.arange(len(width)), sizes)
    i = np.arange(len(tile)) - (np.cumsum(sizes) - sizes)[tile]
    w, h, ow, oh = width[tile], height[tile], own_w[tile], own_h[tile]
    at = (i // w) * oh // h * ow + (i % w) * ow // w + (np.cumsum(own_w * own_h) - own_w * own_h)[tile]
    out = {}
    for c in BANDS:
        band = tiles.field(c)
        if not np.array_equal(band.value_lengths().to_numpy(), own_w * own_h):
            raise ValueError("a band does not fit width x height")
        out[c] = band.flatten().to_numpy()[at]
    return out


def check_blend(mode: str, opacity: float, inputs: int) -> None:
    if mode not in SEPARABLE:
        raise ValueError(f"blend mode must be one of {', '.join(BLEND_MODES)}")
    if mode != "opacity" and opacity:
        raise ValueError("opacity is only for the opacity mode")
    if not MIN_INPUTS <= inputs <= MAX_INPUTS:
        raise ValueError(f"blending takes {MIN_INPUTS} to {MAX_INPUTS} inputs")


def _gather(inputs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per tile with ``_t<i>``, the tile of input i, and ``_n<i>``, how often input i has it."""
    union = None
    for i, tiles in enumerate(inputs):
        skip = F.col("skip_cache") if "skip_cache" in tiles.columns else F.lit(False)
        error = F.col("error") if "error" in tiles.columns else F.lit(None).cast("string")
        part = tiles.select(
            *keys,
            F.lit(i).alias("_ord"),
            F.struct("width", "height", *BANDS, skip.alias("skip_cache"), error.alias("error")).alias("_tile"),
        )
        union = part if union is None else union.unionByName(part)
    return _per_input(union, keys, len(inputs))


def _per_input(rows: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """``_t<i>`` and ``_n<i>`` from rows with ``_ord`` and ``_tile``.

    One value per input, whatever a key's rows: a repeated key costs a count.
    """
    own = [F.col("_ord") == i for i in range(count)]
    return rows.groupBy(*keys).agg(
        *[F.any_value(F.when(mine, F.col("_tile")), True).alias(f"_t{i}") for i, mine in enumerate(own)],
        *[F.count_if(mine).alias(f"_n{i}") for i, mine in enumerate(own)],
    )


def _usable(count: int) -> list[Column]:
    """Per input whether it has the tile once and without an error."""
    return [(F.col(f"_n{i}") == 1) & F.col(f"_t{i}")["error"].isNull() for i in range(count)]


def blend(
    inputs: Sequence[DataFrame], keys: Sequence[str], mode: str = "normal", opacity: float = 0.0
) -> DataFrame:
    """The pixels of ``blend_tiles``."""
    return _with_skip(blend_tiles(inputs, keys, mode, opacity), keys)


def _with_skip(tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pixels(tiles, [*keys, "skip_cache"]).select(*keys, "px", "py", *BANDS, "skip_cache")


def blend_tiles(
    inputs: Sequence[DataFrame], keys: Sequence[str], mode: str = "normal", opacity: float = 0.0
) -> DataFrame:
    """Blend 2..100 tile sets over ``keys``, tile to tile: one row in and out, whole bands at a time.

    Later inputs go under earlier ones.  Smaller inputs are stretched to the
    largest width and height.  A tile that any input lacks, failed or has more
    than once gives no row; ``blend_errors`` lists exactly those.
    """
    check_blend(mode, opacity, len(inputs))
    return _blended(_gather(inputs, keys), keys, len(inputs), mode, opacity)


def blend_layers(
    store: DataFrame, layers: Sequence[str], keys: Sequence[str], mode: str = "normal", opacity: float = 0.0
) -> DataFrame:
    """Blend the named layers of one stored table in their order, as ``blend`` does, in one scan.

    With ``expand_pattern`` this blends a layer pattern over a list of values.
    """
    check_blend(mode, opacity, len(layers))
    if len(set(layers)) < len(layers):
        raise ValueError("a layer is named twice")
    order = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer_name")) - 1
    skip = F.col("skip_cache") if "skip_cache" in store.columns else F.lit(False)
    error = F.col("error") if "error" in store.columns else F.lit(None).cast("string")
    tile = F.struct("width", "height", *BANDS, skip.alias("skip_cache"), error.alias("error"))
    rows = store.where(F.col("layer_name").isin(*layers)).select(*keys, order.alias("_ord"), tile.alias("_tile"))
    return _with_skip(_blended(_per_input(rows, keys, len(layers)), keys, len(layers), mode, opacity), keys)


def _blended(gathered: DataFrame, keys: Sequence[str], count: int, mode: str, opacity: float) -> DataFrame:
    whole = F.lit(True)
    for usable in _usable(count):
        whole = whole & usable
    complete = gathered.where(whole)
    tiles = [F.col(f"_t{i}") for i in range(count)]
    skipped = F.lit(False)
    for t in tiles:
        skipped = skipped | t["skip_cache"]
    sized = complete.select(
        *keys,
        F.greatest(*[t["width"] for t in tiles]).alias("width"),
        F.greatest(*[t["height"] for t in tiles]).alias("height"),
        skipped.alias("skip_cache"),
        *[f"_t{i}" for i in range(count)],
    )
    kinds = {f.name: f.dataType.simpleString() for f in sized.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*keys, "width", "height", "skip_cache"]), *(f"{c} array<int>" for c in BANDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = batch.column("width").to_numpy().astype(np.int64) * batch.column("height").to_numpy()
            block = np.cumsum(pixels) // BLOCK_PIXELS
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(batch)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(low, high - low)
                if not len(part):
                    continue
                width, height = (part.column(c).to_numpy().astype(np.int64) for c in ("width", "height"))
                layers = (_stretched(part.column(f"_t{i}"), width, height) for i in range(count))
                out = next(layers)
                for under in layers:
                    out = blend_bands(out, under, mode, opacity)
                ends = pa.array(np.concatenate(([0], np.cumsum(width * height))), pa.int32())
                bands = [pa.ListArray.from_arrays(ends, pa.array(out[c], pa.int32())) for c in BANDS]
                names = [*keys, "width", "height", "skip_cache"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *bands], [*names, *BANDS])

    return sized.mapInArrow(run, schema).select(*keys, "width", "height", *BANDS, "skip_cache")


def blend_errors(inputs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Tiles that cannot be blended: how many inputs lack or failed them, how many have them repeatedly."""
    count = len(inputs)
    repeated = sum((F.col(f"_n{i}") > 1).cast("int") for i in range(count))
    missing = sum(
        ((F.col(f"_n{i}") == 0) | ((F.col(f"_n{i}") == 1) & F.col(f"_t{i}")["error"].isNotNull())).cast("int")
        for i in range(count)
    )
    bad = _gather(inputs, keys).select(*keys, missing.alias("missing"), repeated.alias("repeated"))
    return bad.where((F.col("missing") > 0) | (F.col("repeated") > 0))


# -- crop ---------------------------------------------------------------------

def crop(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], area, area_3857=None) -> DataFrame:
    """Primary pixels inside ``area``, secondary ones outside.

    ``keys`` must hold z, x, y; ``area`` is a bounds column of the primary side
    (null island leaves the tile whole).  A tile fully outside is all secondary.
    A tile whose needed side is absent gives no pixels.
    """
    area = as_col(area)
    side = ["width", "height", *BANDS]
    joined = (
        primary.select(*keys, area.alias("_area"), F.struct(*side).alias("_p"))
        .join(secondary.select(*keys, F.struct(*side).alias("_s")), list(keys), "left")
        .withColumn("_tile", tile_bounds_3857("z", "x", "y"))
        .withColumn("_open", is_null_island("_area"))
        .withColumn("_outside", ~F.col("_open") & ~bounds_intersect("_area", tile_bounds("z", "x", "y")))
        .withColumn("_crop", to_3857("_area"))
        .where(F.col("_open") | F.col("_s").isNotNull())
    )
    p, s = F.col("_p"), F.col("_s")

    def size(name):
        # Only the side that is used decides when the other is not looked at.
        return (
            F.when(F.col("_open"), p[name])
            .when(F.col("_outside"), s[name])
            .otherwise(F.greatest(p[name], s[name]))
        )

    cells = with_index(joined.withColumns({"width": size("width"), "height": size("height")}))
    tile, w, h = F.col("_tile"), F.col("width"), F.col("height")
    tw, th = bounds_width(tile), bounds_height(tile)
    lon = F.col("px") / w * tw + tile["west"] + tw / w / 2
    lat = tile["north"] - F.col("py") / h * th - th / h / 2
    from_primary = F.col("_open") | (~F.col("_outside") & bounds_contain_point("_crop", lon, lat))
    at_p = resampled_index(w, h, p["width"], p["height"])
    at_s = resampled_index(w, h, s["width"], s["height"])
    return cells.select(
        *keys, "px", "py",
        *[F.when(from_primary, F.get(p[b], at_p)).otherwise(F.get(s[b], at_s)).alias(b) for b in BANDS],
    )


# -- pointwise ----------------------------------------------------------------

def transform_pixels(px: DataFrame, fn: Callable[..., Sequence[Column]]) -> DataFrame:
    """Apply ``fn(r, g, b, a) -> (r, g, b, a)``, Columns in and out (or a pandas UDF call)."""
    out = fn(*[F.col(b) for b in BANDS])
    return px.withColumns(dict(zip(BANDS, out)))


INTENSITY_EFFECTS = (
    "blur", "gaussian", "brightness", "contrast", "gamma", "hue", "saturation", "dilate",
    "edge detection", "erode", "median", "threshold",
)
PLAIN_EFFECTS = ("emboss", "grayscale", "invert", "sepia", "sharpen", "sobel")
POINT_EFFECTS = (
    "brightness", "contrast", "gamma", "hue", "saturation", "threshold", "grayscale", "invert", "sepia",
)
# Luminance weights in tenths, and the sepia matrix.
LUMA_TENTHS = {"r": 3, "g": 6, "b": 1}
SEPIA = {
    "r": (0.393, 0.769, 0.189),
    "g": (0.349, 0.686, 0.168),
    "b": (0.272, 0.534, 0.131),
}


def check_effect(mode: str, intensity: float) -> None:
    if mode not in INTENSITY_EFFECTS + PLAIN_EFFECTS:
        raise ValueError(f"effect must be one of {', '.join(INTENSITY_EFFECTS + PLAIN_EFFECTS)}")
    if mode in PLAIN_EFFECTS and intensity:
        raise ValueError(f"effect {mode!r} takes no intensity")


def luma(r, g, b) -> Column:
    """Ten times the luminance, a whole number."""
    return as_col(r) * LUMA_TENTHS["r"] + as_col(g) * LUMA_TENTHS["g"] + as_col(b) * LUMA_TENTHS["b"]


def _hsl_shift(r: Column, g: Column, b: Column, degrees: float = 0.0, saturation: float = 0.0):
    """Turn the hue and scale the saturation of an RGB colour (HSL model)."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = hi - lo
    light = (hi + lo) / 2
    sat = F.when(span == 0, F.lit(0.0)).otherwise(span / (1 - F.abs(2 * light - 1)))
    sector = (
        F.when(span == 0, F.lit(0.0))
        .when(hi == r, (g - b) / span)
        .when(hi == g, (b - r) / span + 2)
        .otherwise((r - g) / span + 4)
    )
    hue = F.pmod(sector * 60 + degrees, F.lit(360.0))
    sat = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sat * (1 + saturation)))
    chroma = (1 - F.abs(2 * light - 1)) * sat

    def channel(turn):
        # Distance from the channel's own hue, folded to a 0..1 ramp.
        k = F.pmod(hue / 30 + turn, F.lit(12.0))
        ramp = F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return to_byte((light - chroma / 2 * ramp) * 255)

    return channel(0), channel(8), channel(4)


def point_effect(px: DataFrame, mode: str, intensity: float = 0.0) -> DataFrame:
    check_effect(mode, intensity)
    r, g, b = (F.col(c) for c in COLOURS)

    def each(fn):
        return {c: to_byte(fn(F.col(c))) for c in COLOURS}

    if mode == "brightness":
        out = each(lambda c: c * (1 + intensity))
    elif mode == "contrast":
        out = each(lambda c: ((c / 255.0 - 0.5) * (1 + intensity) + 0.5) * 255)
    elif mode == "gamma":
        out = each(lambda c: F.pow(c / 255.0, F.lit(1 / max(intensity, 0.0001))) * 255)
    elif mode in ("hue", "saturation"):
        shift = {"degrees": float(int(intensity))} if mode == "hue" else {"saturation": intensity}
        out = dict(zip(COLOURS, _hsl_shift(r, g, b, **shift)))
    elif mode == "threshold":
        # Grey level first, then black or white.
        grey = F.floor((luma(r, g, b) + 5) / 10)
        level = F.when(grey >= int(intensity), F.lit(255)).otherwise(F.lit(0))
        out = {c: level for c in COLOURS}
    elif mode == "grayscale":
        grey = F.floor((luma(r, g, b) + 5) / 10).cast("int")
        out = {c: grey for c in COLOURS}
    elif mode == "invert":
        out = {c: 255 - F.col(c) for c in COLOURS}
    elif mode == "sepia":
        out = {c: to_byte(m[0] * r + m[1] * g + m[2] * b) for c, m in SEPIA.items()}
    else:
        raise ValueError(f"{mode!r} needs the neighbours: use focal_effect")
    return px.withColumns(out)


# -- neighbourhood ------------------------------------------------------------

# 3x3 kernels, rows from the top, and their bias.
KERNELS = {
    "emboss": ((-1, -1, 0), (-1, 0, 1), (0, 1, 1)),
    "sharpen": ((0, -1, 0), (-1, 5, -1), (0, -1, 0)),
}
KERNEL_BIAS = {"emboss": 128, "sharpen": 0}
SOBEL_X = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
SOBEL_Y = ((-1, -2, -1), (0, 0, 0), (1, 2, 1))


def _clamped(v: Column, size: Column) -> Column:
    return F.greatest(F.lit(0), F.least(size - 1, v))


def _at(dx, dy) -> Column:
    """Index of the pixel at an offset; the edge repeats outward."""
    x = _clamped(F.col("px") + dx, F.col("width"))
    y = _clamped(F.col("py") + dy, F.col("height"))
    return (y * F.col("width") + x).cast("int")


def _kernel_sum(band: str, kernel) -> Column:
    half = len(kernel) // 2
    total = None
    for j, row in enumerate(kernel):
        for i, weight in enumerate(row):
            if weight:
                term = F.get(band, _at(i - half, j - half)) * weight
                total = term if total is None else total + term
    return total


def _weights(mode: str, radius: float) -> list[float]:
    half = math.ceil(radius)
    if mode == "blur":
        return [1.0] * (2 * half + 1)
    return [math.exp(-(k * k) / (4 * radius)) for k in range(-half, half + 1)]


def _two_passes(band: Column, width: Column, height: Column, half: int, fold: Callable[[Column], Column]) -> Column:
    """Array of a tile's band after ``fold`` over the neighbours in the row, then in the column.

    ``fold`` takes the array of the ``2 * half + 1`` values in reach; the edge repeats outward.
    """
    span = F.sequence(F.lit(-half), F.lit(half))
    at = F.sequence(F.lit(0), width * height - 1)

    def rows(i):
        x, start = i % width, i - i % width
        return fold(F.transform(span, lambda d: F.get(band, (start + _clamped(x + d, width)).cast("int"))))

    def columns(first):
        def cell(i):
            x, y = i % width, F.floor(i / width).cast("int")
            return fold(F.transform(span, lambda d: F.get(first, (_clamped(y + d, height) * width + x).cast("int"))))

        return F.transform(at, cell)

    return let(F.transform(at, rows), columns)


def _finished(tiles: DataFrame, keys: Sequence[str], bands: dict[str, Column]) -> DataFrame:
    """Pixels of computed bands; only finished values leave the generator, not the tile's arrays."""
    zipped = F.arrays_zip(*[v.alias(c) for c, v in bands.items()])
    made = tiles.select(*keys, "width", F.posexplode(zipped).alias("_i", "_v"))
    return made.select(
        *keys, (F.col("_i") % F.col("width")).cast("int").alias("px"), F.floor(F.col("_i") / F.col("width")).cast("int").alias("py"),
        *[F.col("_v")[c].alias(c) for c in bands],
    )


def _smooth(tiles: DataFrame, keys: Sequence[str], mode: str, radius: float) -> DataFrame:
    """Separable smoothing, array to array: rows of the tile first, then columns; 2(2r+1) reads a pixel."""
    weights = _weights(mode, radius)
    half, total = len(weights) // 2, sum(weights)
    taps = F.array(*[F.lit(w) for w in weights])

    def fold(values):
        return F.aggregate(F.zip_with(values, taps, lambda v, w: v * w), F.lit(0.0), lambda acc, v: acc + v)

    def along(tile):
        def band(c):
            sums = _two_passes(tile[c], tile["width"], tile["height"], half, fold)
            return F.transform(sums, lambda v: to_byte(v / (total * total)))

        return F.struct(*[band(c).alias(c) for c in COLOURS])

    made = tiles.withColumn("_s", let(F.struct("width", "height", *COLOURS), along))
    return _finished(made, keys, {**{c: F.col("_s")[c] for c in COLOURS}, "a": F.col("a")})


def _around(band: str, half: int) -> Column:
    """ARRAY of a band's values in the small square around a pixel."""
    reach = range(-half, half + 1)
    return F.array(*[F.get(band, _at(dx, dy)) for dy in reach for dx in reach])


def _square(band: Column, i: Column, width: Column, height: Column, half: int) -> Column:
    """ARRAY of an array's values in the square of any size around position ``i``."""
    span = F.sequence(F.lit(-half), F.lit(half))
    x, y = i % width, F.floor(i / width).cast("int")

    def row(dy):
        start = _clamped(y + dy, height) * width
        return F.transform(span, lambda dx: F.get(band, (start + _clamped(x + dx, width)).cast("int")))

    return F.flatten(F.transform(span, row))


def _ranked(tiles: DataFrame, keys: Sequence[str], mode: str, half: int) -> DataFrame:
    """The pixel of highest, lowest or middle luminance in the square around each.

    A pixel is packed into one number led by its luminance, made once per tile;
    ties go by the colour value.
    """
    def packed(p):
        total = luma(p["r"], p["g"], p["b"]).cast("long")
        for band in BANDS:
            total = total * 256 + p[band]
        return total

    values = F.transform(F.arrays_zip(*BANDS), packed).alias("_p")
    if half > 2:
        return _ranked_wide(tiles.select(*keys, "width", "height", values), keys, mode, half)
    cells = with_index(tiles.select(*keys, "width", "height", values), bands=("_p",))
    around = _around("_p", half)
    pick = {
        "dilate": F.array_max(around),
        "erode": F.array_min(around),
        "median": F.get(F.sort_array(around), F.lit((2 * half + 1) ** 2 // 2)),
    }[mode]
    return _unpacked(cells.withColumn("_n", pick).select(*keys, "px", "py", "_n"), keys)


def _unpacked(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    bands = [F.shiftright("_n", 8 * k).bitwiseAND(F.lit(255)).cast("int").alias(b) for k, b in zip((3, 2, 1, 0), BANDS)]
    return px.select(*keys, "px", "py", *bands)


def _ranked_wide(tiles: DataFrame, keys: Sequence[str], mode: str, half: int) -> DataFrame:
    """Rank effects of a larger reach, array to array; highest and lowest go by rows, then columns."""

    def ranked(tile):
        band, w, h = tile["_p"], tile["width"], tile["height"]
        if mode != "median":
            return _two_passes(band, w, h, half, F.array_max if mode == "dilate" else F.array_min)
        middle = F.lit((2 * half + 1) ** 2 // 2)
        at = F.sequence(F.lit(0), w * h - 1)
        return F.transform(at, lambda i: F.get(F.sort_array(_square(band, i, w, h, half)), middle))

    made = tiles.withColumn("_r", let(F.struct("width", "height", "_p"), ranked))
    return _unpacked(_finished(made, keys, {"_n": F.col("_r")}), keys)


def _edges(tiles: DataFrame, keys: Sequence[str], half: int) -> DataFrame:
    """A pixel times the size of the square around it, less the square's sum; array to array."""
    side = 2 * half + 1

    def fold(values):
        return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc + v)

    def along(tile):
        def band(c):
            sums = _two_passes(tile[c], tile["width"], tile["height"], half, fold)
            return F.zip_with(tile[c], sums, lambda v, total: to_byte(v * (side * side) - total))

        return F.struct(*[band(c).alias(c) for c in COLOURS])

    made = tiles.withColumn("_s", let(F.struct("width", "height", *COLOURS), along))
    return _finished(made, keys, {**{c: F.col("_s")[c] for c in COLOURS}, "a": F.col("a")})


def focal_effect(tiles: DataFrame, keys: Sequence[str], mode: str, intensity: float = 0.0) -> DataFrame:
    """Neighbourhood effects on packed tiles; gives pixels and shuffles nothing.

    ``intensity`` is the radius.  dilate, erode and median pick the whole pixel
    of highest, lowest or middle luminance in the square around a pixel.
    """
    check_effect(mode, intensity)
    if mode in ("blur", "gaussian"):
        if intensity <= 0:
            return pixels(tiles, keys)
        return _smooth(tiles, keys, mode, intensity)
    if mode in ("dilate", "erode", "median"):
        return _ranked(tiles, keys, mode, int(2 * intensity + 1.5) // 2)
    if mode == "edge detection":
        return _edges(tiles, keys, math.ceil(2 * intensity + 1) // 2)
    cells = with_index(tiles, bands=BANDS)
    alpha = F.get("a", F.col("_i")).alias("a")
    if mode == "sobel":
        out = [
            to_byte(
                F.sqrt(
                    F.pow(_kernel_sum(c, SOBEL_X).cast("double"), F.lit(2.0))
                    + F.pow(_kernel_sum(c, SOBEL_Y).cast("double"), F.lit(2.0))
                )
            ).alias(c)
            for c in COLOURS
        ]
    elif mode in KERNELS:
        out = [to_byte(_kernel_sum(c, KERNELS[mode]) + KERNEL_BIAS[mode]).alias(c) for c in COLOURS]
    else:
        raise ValueError(f"{mode!r} is a pointwise effect: use point_effect")
    return cells.select(*keys, "px", "py", *out, alpha)


# -- constants ----------------------------------------------------------------

def constant_tiles(tiles: DataFrame, color: str, size: int = CONSTANT_SIZE) -> DataFrame:
    """Every tile in one colour, kept as four numbers and a size, not as arrays."""
    return tiles.withColumn("_c", parse_color(F.lit(color))).select(
        *tiles.columns, F.lit(size).alias("width"), F.lit(size).alias("height"),
        *[F.col("_c")[b].alias(b) for b in BANDS],
    )


def expand_constant(tiles: DataFrame) -> DataFrame:
    """Constant tiles as packed tiles, for use in blends."""
    n = (F.col("width") * F.col("height")).cast("int")
    return tiles.withColumns({b: F.array_repeat(F.col(b), n) for b in BANDS})


def constant_vector_tiles(tiles: DataFrame, layer: str = "box", extent: int = 4096) -> DataFrame:
    """Every tile with one box feature along its edge."""
    ring = [(0, 0), (extent, 0), (extent, extent), (0, extent)]
    corners = F.array(*[F.struct(F.lit(a).alias("qx"), F.lit(b).alias("qy")) for a, b in ring])
    return tiles.select(
        F.lit(layer).alias("layer"), *tiles.columns, F.lit(0).alias("part"), F.lit(1).alias("n"),
        F.array(F.struct(F.lit(0).cast("long").alias("gid"), corners.alias("ring"))).alias("features"),
    )
