"""Clipped geometries against cutting every path at every tile one by one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry as g, vector as v

M = 20037508.342789
GEOM = "gid long, geom struct<kind:string,coords:array<struct<x:double,y:double>>>, name string"


def world(coords):
    out = []
    for lon, lat in coords:
        y = math.log(math.tan((90 + lat) * math.pi / 360)) / (math.pi / 180) * M / 180
        out.append(((lon * M / 180 + M) / (2 * M), (M - y) / (2 * M)))
    return out


def segment(a, b, box):
    """Part of a segment inside a box as (enter, leave), or None."""
    t0, t1 = 0.0, 1.0
    for axis in (0, 1):
        d = b[axis] - a[axis]
        for sign, bound in ((1, box[axis]), (-1, box[axis + 2])):
            p, q = -sign * d, sign * (a[axis] - bound)
            if p == 0:
                if q < 0:
                    return None
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
    return (t0, t1) if t0 <= t1 else None


def winds(path, u, v_):
    n = 0
    for a, b in zip(path, path[1:] + path[:1]):
        left = (b[0] - a[0]) * (v_ - a[1]) - (u - a[0]) * (b[1] - a[1])
        n += (a[1] <= v_ < b[1] and left > 0) - (b[1] <= v_ < a[1] and left < 0)
    return n != 0


def area(path):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(path, path[1:] + path[:1])) / 2


def ring_cut(path, box):
    for axis, side, less in ((0, 0, False), (0, 2, True), (1, 1, False), (1, 3, True)):
        out = []
        for a, b in zip(path[-1:] + path[:-1], path):
            def inside(p):
                return p[axis] <= box[side] if less else p[axis] >= box[side]
            if inside(a) != inside(b):
                t = (box[side] - a[axis]) / (b[axis] - a[axis])
                q = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                q[axis] = box[side]
                out.append(tuple(q))
            if inside(b):
                out.append(b)
        path = out
    return path


def expected(kind, coords, zoom, half=0.0625, margin=0.125):
    """{(x, y): (number of lines, their length) or (1, area)} of one geometry."""
    n, out = 2**zoom, {}
    path = [(u * n, w * n) for u, w in world(coords)]
    ring = kind in ("polygon", "box")
    if ring and len(path) > 1 and path[0] == path[-1]:
        path = path[:-1]
    edges = list(zip(path, path[1:] + path[:1] if ring else path[1:])) or [(path[0], path[0])]
    for x in range(n):
        for y in range(n):
            near = [max(x - half, 0), max(y - half, 0), min(x + 1 + half, n), min(y + 1 + half, n)]
            met = any(segment(a, b, near) for a, b in edges)
            if not met and not (ring and winds(path, (near[0] + near[2]) / 2, (near[1] + near[3]) / 2)):
                continue
            wide = [x - margin, y - margin, x + 1 + margin, y + 1 + margin]
            if ring:
                out[x, y] = (1, area(ring_cut(path, wide)))
            else:
                pieces, length, before = 0, 0.0, None
                for a, b in edges:
                    t = segment(a, b, wide)
                    if t:
                        pieces += not (before and before[1] == 1 and t[0] == 0)
                        length += (t[1] - t[0]) * math.dist(a, b)
                    before = t
                out[x, y] = (pieces, length)
    return out


def measured(row, extent):
    paths = [[(p["qx"] / extent, p["qy"] / extent) for p in path] for path in row["paths"]]
    if row["kind"] in ("polygon", "box"):
        return len(paths), area(paths[0])
    return len(paths), sum(math.dist(a, b) for p in paths for a, b in zip(p, p[1:]))


def shapes(rng, n):
    out = []
    for i in range(n):
        kind, size = rng.choice(["line", "polygon"]), rng.choice([0.5, 10, 150])
        lon, lat = rng.uniform(-175, 175), rng.uniform(-80, 80)
        coords = [
            (max(-180.0, min(180.0, lon + rng.uniform(-size, size))), max(-85.0, min(85.0, lat + rng.uniform(-size, size) / 2)))
            for _ in range(rng.randrange(1, 9))
        ]
        if kind == "polygon" and rng.random() < 0.5:
            coords.append(coords[0])
        out.append((i, (kind, coords), f"n{i}"))
    return out


@pytest.mark.parametrize("step, points", [(5, 200_000), (1, 7)])
def test_every_tile_of_three_zooms(spark, monkeypatch, step, points):
    monkeypatch.setattr(g, "STEP", step)
    monkeypatch.setattr(g, "POINTS", points)
    rows = shapes(random.Random(step), 60)
    zooms, extent = [1, 3, 4], 1 << 20
    out = g.clip_to_tiles(spark.createDataFrame(rows, GEOM), zooms, extent, attributes=["name"]).collect()
    got = {(r["gid"], r["z"], r["x"], r["y"]): measured(r, extent) for r in out}
    assert len(got) == len(out) and all(r["name"] == f"n{r['gid']}" for r in out)
    want = {(i, z, *xy): m for i, (kind, coords), _ in rows for z in zooms for xy, m in expected(kind, coords, z).items()}
    assert set(got) == set(want)
    for key, (n, size) in want.items():
        assert got[key][0] == n and got[key][1] == pytest.approx(size, abs=1e-4), key


def test_only_the_part_that_matters_goes_down(spark):
    """A long line of which a tile keeps a few points; a ring around many tiles keeps its shape."""
    import numpy as np

    n = 10_000
    u, w = np.linspace(0, 4, n), np.full(n, 0.5)
    line = g.Paths(np.zeros(1, int), np.array([False]), np.array([1]), np.array([0]), np.array([0, n]), u, w)
    assert len(line.pruned(0.125).u) < n / 3
    ring = g.Paths(np.zeros(1, int), np.array([True]), np.array([5]), np.array([5]), np.array([0, n]), 5.5 + 4 * np.cos(u * np.pi / 2), 5.5 + 4 * np.sin(u * np.pi / 2))
    small = ring.pruned(0.125)
    assert len(small.u) < 20 and small.meets(small.box(0.0625)).all()


def test_points_boxes_and_what_cannot_be_placed(spark):
    rows = [
        (1, ("point", [(50.0, 50.0)]), "a"), (2, ("box", [(5.0, 5.0), (-5.0, -5.0)]), "b"), (3, ("line", []), "c"),
        (4, None, "d"), (5, ("circle", [(1.0, 1.0)]), "e"), (6, ("line", [(1.0, None), (2.0, 2.0)]), "f"),
        (7, ("line", [(0.0, 0.0), (0.0, -90.0)]), "g"), (None, ("point", [(50.0, 50.0)]), None), (9, (None, [(1.0, 1.0)]), "h"),
        (1, ("point", [(50.0, 50.0)]), "a"),
    ]
    out = g.clip_to_tiles(spark.createDataFrame(rows, GEOM), [1], attributes=["name"]).collect()
    got = sorted(((r["gid"], r["name"], r["x"], r["y"]) for r in out), key=str)
    box = [(2, "b", x, y) for x in (0, 1) for y in (0, 1)]
    assert got == sorted([(1, "a", 1, 0), (1, "a", 1, 0), (None, None, 1, 0), *box], key=str)
    assert g.clip_to_tiles(spark.createDataFrame([], GEOM), [0, 9]).count() == 0


def test_tiles_with_mixed_geometry(spark):
    rows = shapes(random.Random(9), 40) + [(100 + i, ("point", [(i * 2.0, 1.0)]), "p") for i in range(30)]
    features = spark.createDataFrame(rows, GEOM)
    tiles = v.build_geometry_tiles(features, [0, 3], attributes=["name"], where="name <> :no", params={"no": "n3"}, parts=3).collect()
    world_tile = [f for t in tiles if t["z"] == 0 for f in t["features"]]
    assert {f["gid"] for f in world_tile} == {r[0] for r in rows if r[2] != "n3"}
    assert {f["kind"] for f in world_tile} == {"line", "polygon", "point"}
    assert all(t["n"] == len(t["features"]) for t in tiles)
    flat = v.explode_features(v.build_geometry_tiles(features, [3])).groupBy("z", "x", "y").agg(F.count("*").alias("n"))
    clipped = g.clip_to_tiles(features, [3]).groupBy("z", "x", "y").agg(F.count("*").alias("n"))
    assert flat.exceptAll(clipped).isEmpty() and clipped.exceptAll(flat).isEmpty()
