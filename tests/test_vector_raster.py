"""Vector-tile and raster operators against brute force and known pixels."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.tiles import bounds
from tessera.operators.geometry import clip_to_tiles
from tessera.operators import raster as r
from tessera.operators import vector as v

M = 20037508.342789


def points(spark, rows):
    return spark.createDataFrame(rows, "gid long, lon double, lat double, str string")


def test_one_point(spark):
    one = points(spark, [(0, 10.0, 10.0, "hello")])
    tiles = v.build_vector_tiles(one, [0, 1], attributes=["str"], where="z = 0", limit=1)
    rows = {(t["z"], t["x"], t["y"]): t["features"] for t in tiles.collect()}
    assert set(rows) == {(0, 0, 0)}
    # Without the filter all four tiles of zoom 1 hold it inside their buffers.
    assert v.build_vector_tiles(one, [1]).count() == 4
    feature = rows[(0, 0, 0)][0]
    assert (feature["gid"], feature["str"], feature["qx"]) == (0, "hello", math.floor((10 + 180) / 360 * 4096))


def test_points_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.uniform(-180, 180), rng.uniform(-89, 89), "") for i in range(400)]
    # Points on tile edges and at the ends of the world.
    rows += [(1000, 0.0, 0.0, ""), (1001, 180.0, 0.0, ""), (1002, -180.0, 66.51326044311186, ""), (1003, 5.0, 89.9, "")]
    got = {
        (p["gid"], p["x"], p["y"]) for p in v.points_to_tiles(points(spark, rows), [3]).select("gid", "x", "y").collect()
    }
    want = set()
    for gid, lon, lat, _ in rows:
        u = (lon * M / 180 + M) * 8 / (2 * M)
        w = (M - math.log(math.tan((90 + lat) * math.pi / 360)) / (math.pi / 180) * M / 180) * 8 / (2 * M)
        if not (0 <= u <= 8 and 0 <= w <= 8):
            continue
        for x in range(8):
            for y in range(8):
                if x - 0.0625 <= u <= x + 1.0625 and y - 0.0625 <= w <= y + 1.0625:
                    want.add((gid, x, y))
    assert got == want


def test_parts_hold_everything(spark):
    rows = [(i, 10 + i / 1000, 10.0, "") for i in range(1000)]
    tiles = v.build_vector_tiles(points(spark, rows), [0, 8], parts=10).cache()
    low = tiles.where("z = 0").collect()
    assert sum(t["n"] for t in low) == 1000 and {t["part"] % 10 for t in low} == set(range(10))
    assert len({t["part"] for t in low}) == len(low)
    assert max(t["n"] for t in low) < 200
    assert sorted(f["gid"] for t in low for f in t["features"]) == list(range(1000))


def test_number_of_parts_follows_the_features(spark, monkeypatch):
    monkeypatch.setattr(v, "FEATURES", 50)
    rows = [(i, 10.0, 10.0, "") for i in range(1000)] + [(5, 100.0, 10.0, f"{i}") for i in range(200)]
    tiles = v.build_vector_tiles(points(spark, rows), [0, 8], parts=2, attributes=["str"]).collect()
    low = [t for t in tiles if t["z"] == 0]
    assert max(t["n"] for t in tiles) <= 50 and len({t["part"] for t in low}) == len(low)
    assert sorted((f["gid"], f["str"]) for t in low for f in t["features"]) == sorted((g, s) for g, _, _, s in rows)
    named = v.layered_tiles(points(spark, rows), [0], F.lit("a"), ["a"], parts=1).collect()
    assert max(t["n"] for t in named) <= 1000 and sum(t["n"] for t in named) == 1200 and len(named) > 20


def test_limit_and_filter(spark):
    rows = [(i, 10.0, 10.0, "a" if i % 2 else "b") for i in range(50)]
    limited = v.build_vector_tiles(points(spark, rows), [0], limit=3, parts=1).first()
    assert [f["gid"] for f in limited["features"]] == [0, 1, 2]
    chosen = v.build_vector_tiles(
        points(spark, rows), [0], attributes=["str"], where="str = :s and z = 0", params={"s": "a' or true --"}
    )
    assert chosen.count() == 0


def brute_clip(spark, kind, coords, zoom):
    geom = spark.createDataFrame([(1, (kind, coords))], "gid long, geom struct<kind:string,coords:array<struct<x:double,y:double>>>")
    rows = clip_to_tiles(geom, [zoom]).collect()
    return {(t["x"], t["y"]): t["paths"] for t in rows}


def test_line_touches_only_its_tiles(spark):
    # A diagonal through four of the sixteen tiles; its box covers all of them.
    line = brute_clip(spark, "line", [(-170.0, 80.0), (170.0, -80.0)], 2)
    n, steps = 4, 4000
    want = set()
    for i in range(steps + 1):
        f = i / steps
        u0, u1 = (-170 + 180) / 360 * n, (170 + 180) / 360 * n
        w0 = (M - math.log(math.tan(170 * math.pi / 360)) / math.pi * M) * n / (2 * M)
        u, w = u0 + f * (u1 - u0), w0 + f * ((n - w0) - w0)
        for x in range(n):
            for y in range(n):
                if x - 0.0625 <= u <= x + 1.0625 and y - 0.0625 <= w <= y + 1.0625:
                    want.add((x, y))
    assert set(line) == want and len(want) < 16
    for paths in line.values():
        for path in paths:
            assert all(-512 <= p["qx"] <= 4608 and -512 <= p["qy"] <= 4608 for p in path)


def test_polygon_around_a_tile(spark):
    big = brute_clip(spark, "polygon", [(-100.0, 60.0), (100.0, 60.0), (100.0, -60.0), (-100.0, -60.0), (-100.0, 60.0)], 3)
    middle = big[(3, 3)]
    assert {(p["qx"], p["qy"]) for p in middle[0]} == {(-512, -512), (4608, -512), (4608, 4608), (-512, 4608)}
    triangle = brute_clip(spark, "polygon", [(-10.0, 80.0), (10.0, 80.0), (0.0, 70.0)], 1)
    assert set(triangle) == {(0, 0), (1, 0)}


def test_line_leaving_and_coming_back(spark):
    coords = [(-170.0, 10.0), (-170.0, 20.0), (60.0, 20.0), (60.0, 30.0), (-170.0, 30.0)]
    paths = brute_clip(spark, "line", coords, 1)[(0, 0)]
    assert len(paths) == 2


# -- raster -------------------------------------------------------------------

def tile(spark, rgba, size=2, z=1, x=0, y=0, **extra):
    row = spark.range(1).select(F.lit(z).alias("z"), F.lit(x).alias("x"), F.lit(y).alias("y"),
                                F.lit(size).alias("width"), F.lit(size).alias("height"))
    for band, value in zip("rgba", rgba):
        row = row.withColumn(band, F.array(*[F.lit(c) for c in (value if isinstance(value, list) else [value] * size * size)]))
    return row.withColumns({k: F.lit(c) for k, c in extra.items()})


KEYS = ["z", "x", "y"]


def colours(df):
    return [tuple(p[b] for b in "rgba") for p in df.orderBy("py", "px").collect()]


def test_blend_add(spark):
    out = r.blend([tile(spark, (255, 0, 0, 255)), tile(spark, (0, 255, 0, 255))], KEYS, "add")
    assert colours(out) == [(255, 255, 0, 255)] * 4


def test_earlier_inputs_lie_on_top(spark):
    clear, red, blue = (0, 0, 0, 0), (255, 0, 0, 255), (0, 0, 255, 255)
    assert colours(r.blend([tile(spark, red), tile(spark, blue)], KEYS))[0] == red
    assert colours(r.blend([tile(spark, clear), tile(spark, red), tile(spark, blue)], KEYS))[0] == red
    half = colours(r.blend([tile(spark, (255, 0, 0, 128)), tile(spark, blue)], KEYS))[0]
    assert half == (128, 0, 127, 255)


def test_blend_rules(spark):
    a, b = tile(spark, (1, 2, 3, 255)), tile(spark, (4, 5, 6, 255), size=4)
    assert r.blend([a, b], KEYS).count() == 16
    failed = tile(spark, (1, 2, 3, 255), error="bad")
    assert r.blend([a, failed], KEYS).count() == 0
    assert r.blend_errors([a, failed, tile(spark, (0, 0, 0, 0), x=1)], KEYS).count() == 2
    skipped = r.blend([a, tile(spark, (1, 1, 1, 255), skip_cache=True)], KEYS).first()
    assert skipped["skip_cache"]
    for args in (("nope", 0.0, 2), ("add", 0.5, 2), ("add", 0.0, 1), ("add", 0.0, 101)):
        with pytest.raises(ValueError):
            r.check_blend(*args)


def test_resample_repeats_pixels(spark):
    t = tile(spark, ([1, 2, 3, 4], 0, 0, 255))
    got = [c[0] for c in colours(r.resample(t, KEYS, 4, 4))]
    assert got == [1, 1, 2, 2, 1, 1, 2, 2, 3, 3, 4, 4, 3, 3, 4, 4]


def test_crop(spark):
    red, blue = tile(spark, (255, 0, 0, 255), z=0), tile(spark, (0, 0, 255, 255), z=0)

    def run(*box):
        area = bounds(*[F.lit(float(c)) for c in box])
        return [c[0] for c in colours(r.crop(red, blue, KEYS, area))]

    assert run(-85, 85, -180, 0) == [255, 0, 255, 0]
    assert run(0, 85, -180, 180) == [255, 255, 0, 0]
    assert run(0, 0, 0, 0) == [255] * 4
    east = r.crop(tile(spark, (255, 0, 0, 255)), tile(spark, (0, 0, 255, 255)), KEYS, bounds(*[F.lit(c) for c in (-85.0, -1.0, 1.0, 180.0)]))
    assert [c[2] for c in colours(east)] == [255] * 4


def test_point_effects(spark):
    red = r.pixels(tile(spark, (255, 0, 0, 255)), KEYS)
    assert colours(r.point_effect(red, "grayscale"))[0] == (0x4D, 0x4D, 0x4D, 255)
    assert colours(r.point_effect(red, "invert"))[0] == (0, 255, 255, 255)
    assert colours(r.point_effect(red, "hue", 120))[0] == (0, 255, 0, 255)
    assert colours(r.point_effect(red, "saturation", -1))[0] == (128, 128, 128, 255)
    assert colours(r.transform_pixels(red, lambda a, b, c, d: (b, c, a, d)))[0] == (0, 0, 255, 255)
    with pytest.raises(ValueError):
        r.point_effect(red, "sepia", 1)
    with pytest.raises(ValueError):
        r.point_effect(red, "nope")


@pytest.mark.parametrize("mode,amount", [("blur", 1), ("gaussian", 2), ("dilate", 1), ("erode", 2), ("median", 1), ("sharpen", 0)])
def test_focal_effects_keep_flat_tiles(spark, mode, amount):
    flat = tile(spark, (10, 20, 30, 40), size=3)
    assert colours(r.focal_effect(flat, KEYS, mode, amount)) == [(10, 20, 30, 40)] * 9


def test_focal_edges(spark):
    step = tile(spark, ([0, 0, 100, 0, 0, 100, 0, 0, 100], 0, 0, 255), size=3)
    assert [c[0] for c in colours(r.focal_effect(step, KEYS, "blur", 1))] == [0, 33, 67] * 3
    assert [c[0] for c in colours(r.focal_effect(step, KEYS, "dilate", 1))] == [0, 100, 100] * 3
    assert [c[0] for c in colours(r.focal_effect(step, KEYS, "sobel"))] == [0, 255, 255] * 3


def test_bad_bands_are_refused(spark):
    wrong = tile(spark, ([1], 0, 0, 255))
    with pytest.raises(Exception, match="does not fit"):
        r.pixels(wrong, KEYS).collect()


def test_constant_and_pack(spark):
    keys = spark.createDataFrame([(1, 0, 0)], "z int, x int, y int")
    assert tuple(r.constant_tiles(keys, "f018").first())[3:] == (512, 512, 255, 0, 17, 136)
    t = tile(spark, ([1, 2, 3, 4], 5, 6, 255))
    again = r.pack(r.pixels(t, KEYS), KEYS).first()
    assert again["r"] == [1, 2, 3, 4] and (again["width"], again["height"]) == (2, 2)


def test_repeated_and_absent_keys_are_errors(spark):
    a, b = tile(spark, (9, 9, 9, 255)), tile(spark, (1, 1, 1, 255))
    far = tile(spark, (1, 1, 1, 255), x=1)
    twice = a.unionByName(a)
    for inputs, told in (([twice, far], {(0, 1, 1), (1, 1, 0)}), ([twice, b], {(0, 0, 1)}), ([a, b], set())):
        found = r.blend_errors(inputs, KEYS)
        assert {(e["x"], e["missing"], e["repeated"]) for e in found.collect()} == told
        assert r.blend(inputs, KEYS).select("x").distinct().count() == (1 if not told else 0)


@pytest.mark.parametrize("mode,amount", [("gaussian", 1.5), ("dilate", 2), ("erode", 2), ("median", 1.6), ("edge detection", 2)])
def test_wide_neighbourhoods_equal_brute_force(spark, mode, amount):
    rng, w, h = random.Random(7), 7, 5
    bands = {c: [rng.randrange(256) for _ in range(w * h)] for c in "rgba"}
    row = spark.createDataFrame(
        [(1, 0, 0, w, h, *bands.values())],
        "z int, x int, y int, width int, height int, r array<int>, g array<int>, b array<int>, a array<int>",
    )
    got = {(p["px"], p["py"]): (p["r"], p["g"], p["b"], p["a"]) for p in r.focal_effect(row, KEYS, mode, amount).collect()}

    def at(c, x, y):
        return bands[c][max(0, min(h - 1, y)) * w + max(0, min(w - 1, x))]

    def byte(v):
        return max(0, min(255, math.floor(v + 0.5)))

    for x in range(w):
        for y in range(h):
            if mode == "gaussian":
                half = math.ceil(amount)
                weight = {k: math.exp(-(k * k) / (4 * amount)) for k in range(-half, half + 1)}
                total = sum(weight.values()) ** 2
                want = [
                    sum(at(c, x + i, y + j) * weight[i] * weight[j] for i in weight for j in weight) / total for c in "rgb"
                ]
                assert all(abs(g - v) <= 0.5 + 1e-6 for g, v in zip(got[x, y], want)) and got[x, y][3] == at("a", x, y)
            elif mode == "edge detection":
                half = math.ceil(2 * amount + 1) // 2
                reach = range(-half, half + 1)
                want = [byte(at(c, x, y) * len(reach) ** 2 - sum(at(c, x + i, y + j) for i in reach for j in reach)) for c in "rgb"]
                assert got[x, y] == (*want, at("a", x, y))
            else:
                half = int(2 * amount + 1.5) // 2
                reach = range(-half, half + 1)
                near = [tuple(at(c, x + i, y + j) for c in "rgba") for i in reach for j in reach]
                near.sort(key=lambda p: (p[0] * 3 + p[1] * 6 + p[2], p))
                assert got[x, y] == near[{"dilate": -1, "erode": 0, "median": len(near) // 2}[mode]]


def test_composite_of_one_table_takes_one_scan(spark, tmp_path):
    rows = [(i, 10.0 + i / 100, 10.0, "abc"[i % 3]) for i in range(90)]
    points(spark, rows).write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    out = v.layered_tiles(stored, [3], F.col("str"), ["b", "a"], F.col("layer") == "a", parts=1)
    found = {(t["layer"], t["ord"], t["n"], t["skip_cache"]) for t in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("Initial Plan")]
    assert plan.count("FileScan") == 1 and "Window" not in plan
    assert found == {("b", 0, 30, True), ("a", 1, 30, True)}


def test_blended_tiles_stay_whole(spark):
    """Tile to tile: sizes that differ, blocks of a few tiles, and no shuffle after the inputs have met."""
    rng = random.Random(4)
    sizes = [(1, 1), (3, 2), (2, 3), (16, 16)]
    rows = [[], []]
    for side in (0, 1):
        for x in range(40):
            w, h = sizes[(x + side) % 4]
            rows[side].append((1, x, 0, w, h, *([rng.choice([0, 255, rng.randrange(256)]) for _ in range(w * h)] for _ in "rgba")))
    kind = "z int, x int, y int, width int, height int, r array<int>, g array<int>, b array<int>, a array<int>"
    over, under = (spark.createDataFrame(r_, kind) for r_ in rows)
    for mode in r.BLEND_MODES:
        tiles = r.blend_tiles([over, under], KEYS, mode, 0.3 if mode == "opacity" else 0.0)
        assert "Exchange" not in tiles._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
        got = {t["x"]: t for t in tiles.collect()}
        assert len(got) == 40
        for (_, x, _, w, h, *o), (_, _, _, uw, uh, *u) in zip(*rows):
            W, H = max(w, uw), max(h, uh)
            assert (got[x]["width"], got[x]["height"]) == (W, H)
            for i in range(W * H):
                at = [((i // W) * ph // H) * pw + (i % W) * pw // W for pw, ph in ((w, h), (uw, uh))]
                s_, b_ = ([band[k] / 255 for band in bands] for bands, k in ((o, at[0]), (u, at[1])))
                assert tuple(got[x][c][i] for c in "rgba") == mixed(mode, s_, b_, 0.3 if mode == "opacity" else 1.0), (mode, s_, b_)


def mixed(mode, s, b, share):
    """One pixel by the compositing equation."""
    sa, ab = s[3] * share, b[3]
    ao = sa + ab * (1 - sa)

    def fn(b, s):
        return {
            "add": lambda: b + s, "color burn": lambda: 1.0 if b >= 1 else 0.0 if s <= 0 else 1 - (1 - b) / s,
            "color dodge": lambda: 0.0 if b <= 0 else 1.0 if s >= 1 else b / (1 - s), "darken": lambda: min(b, s),
            "difference": lambda: abs(b - s), "divide": lambda: 1.0 if s <= 0 else b / s, "exclusion": lambda: b + s - 2 * b * s,
            "lighten": lambda: max(b, s), "linear burn": lambda: b + s - 1, "linear light": lambda: b + 2 * s - 1,
            "multiply": lambda: b * s, "normal": lambda: s, "opacity": lambda: s,
            "overlay": lambda: 2 * b * s if b <= 0.5 else 1 - 2 * (1 - b) * (1 - s), "screen": lambda: b + s - b * s,
            "soft light": lambda: (1 - 2 * s) * b * b + 2 * b * s, "subtract": lambda: s - b,
        }[mode]()

    def byte(v):
        return max(0, min(255, math.floor(v + 0.5)))

    out = []
    for cs, cb in zip(s[:3], b[:3]):
        total = sa * (1 - ab) * cs + sa * ab * max(0.0, min(1.0, fn(cb, cs))) + (1 - sa) * ab * cb
        out.append(byte(total / ao * 255 if ao > 0 else 0.0))
    return (*out, byte(ao * 255))


def test_bands_must_fit(spark):
    bad = tile(spark, ([1, 2], 0, 0, 255))
    with pytest.raises(Exception, match="does not fit"):
        r.blend_tiles([bad, tile(spark, (0, 0, 0, 255))], KEYS).collect()
