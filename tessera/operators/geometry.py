"""Lines, polygons and boxes in tiles: a clip pyramid over Arrow arrays.

A geometry starts at the zoom at which its box spans about one tile, and goes down zoom by
zoom.  A tile hands on to its four children only the part of the path that can meet them:
runs of points on one outer side of the tile's clip box shrink to their two ends, which
changes neither the clipped path nor what the path surrounds.  The points that stay are
the original ones, so results are the same from whatever zoom a geometry starts.

All paths of a batch are cut together with numpy: segments against their tile's box for
lines, rings against its four sides in turn for polygons.  Work is handed on in pieces of
``POINTS`` points, and every ``STEP`` zooms the tiles reached so far are dealt out again, so
one huge geometry is cut by the whole cluster.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.functions.tiles import MERCATOR_HALF, lat_to_3857, lon_to_3857
from tessera.session import written

#: Zooms that a task goes down before the tiles are dealt out again.
STEP = 5
#: Points that are cut at a time.
POINTS = 200_000
KINDS = ("point", "line", "polygon", "box")


def world_paths(features: DataFrame, attributes: Sequence[str] = ()) -> DataFrame:
    """``gid, kind, us, vs`` and the attributes: paths of ``geom`` with the world as one tile; boxes become rings.

    Geometries without points, with an unknown coordinate or of no known kind are left out.
    """
    c = F.col("geom.coords")
    lon, lat = F.transform(c, lambda p: p["x"]), F.transform(c, lambda p: p["y"])
    box = F.col("geom.kind") == "box"
    west, east, south, north = F.array_min(lon), F.array_max(lon), F.array_min(lat), F.array_max(lat)
    rows = features.where(F.col("geom.kind").isin(*KINDS) & (F.size(c) > 0))
    rows = rows.select(
        "gid", F.col("geom.kind").alias("kind"), *attributes,
        F.when(box, F.array(west, east, east, west)).otherwise(lon).alias("_lon"),
        F.when(box, F.array(south, south, north, north)).otherwise(lat).alias("_lat"),
    )
    scale = 1.0 / (2 * MERCATOR_HALF)
    placed = rows.select(
        "gid", "kind", *attributes,
        F.transform("_lon", lambda x: (lon_to_3857(x) + MERCATOR_HALF) * scale).alias("us"),
        F.transform("_lat", lambda y: (MERCATOR_HALF - lat_to_3857(y)) * scale).alias("vs"),
    )

    def known(values: str) -> Column:
        return F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < 1e9), F.lit(False)))

    return placed.where(known("us") & known("vs"))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))


@dataclass
class Paths:
    """Paths in tiles of one zoom: path i has the points ``at[i]`` to ``at[i + 1]``, in units of that zoom's tiles."""

    row: np.ndarray
    ring: np.ndarray
    x: np.ndarray
    y: np.ndarray
    at: np.ndarray
    u: np.ndarray
    v: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.x)), np.diff(self.at))

    def take(self, keep: np.ndarray) -> Paths:
        sizes = np.diff(self.at)[keep]
        points = _ranges(self.at[:-1][keep], sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return Paths(self.row[keep], self.ring[keep], self.x[keep], self.y[keep], ends, self.u[points], self.v[points])

    def points(self, keep: np.ndarray) -> Paths:
        """The paths with some of their points only."""
        ends = np.concatenate(([0], np.cumsum(keep)))[self.at]
        return Paths(self.row, self.ring, self.x, self.y, ends, self.u[keep], self.v[keep])

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of the point before and after each point; around the ends for rings, the point itself for lines."""
        n, owner = np.arange(len(self.u)), self.owner()
        first, last = self.at[:-1][owner], self.at[1:][owner] - 1
        before = np.where(n > first, n - 1, np.where(self.ring[owner], last, n))
        after = np.where(n < last, n + 1, np.where(self.ring[owner], first, n))
        return before, after

    def box(self, margin: float, zoom: int | None = None) -> tuple[np.ndarray, ...]:
        """The tiles widened by a margin; with a zoom, confined to the world."""
        sides = self.x - margin, self.y - margin, self.x + 1 + margin, self.y + 1 + margin
        if zoom is None:
            return sides
        return tuple(np.clip(s, 0.0, 2.0**zoom) for s in sides)

    def segments(self, box: tuple[np.ndarray, ...]):
        """Of the segment that starts at each point: next point, whether it meets the box, and where it enters and leaves."""
        owner, (_, after) = self.owner(), self.neighbours()
        du, dv = self.u[after] - self.u, self.v[after] - self.v
        enter, leave, met = np.zeros(len(du)), np.ones(len(du)), np.ones(len(du), bool)
        low_u, low_v, high_u, high_v = (s[owner] for s in box)
        sides = ((-du, self.u - low_u), (du, high_u - self.u), (-dv, self.v - low_v), (dv, high_v - self.v))
        for p, q in sides:
            flat = p == 0
            t = q / np.where(flat, 1.0, p)
            enter = np.where(p < 0, np.maximum(enter, t), enter)
            leave = np.where(p > 0, np.minimum(leave, t), leave)
            met &= ~(flat & (q < 0))
        return after, met & (enter <= leave), enter, leave

    def meets(self, box: tuple[np.ndarray, ...]) -> np.ndarray:
        """Whether an edge meets the box, or the ring winds around it."""
        after, met, _, _ = self.segments(box)
        owner, n = self.owner(), len(self.x)
        out = np.bincount(owner[met], minlength=n) > 0
        u, v = ((box[0] + box[2]) / 2)[owner], ((box[1] + box[3]) / 2)[owner]
        a_u, a_v, b_u, b_v = self.u, self.v, self.u[after], self.v[after]
        left = (b_u - a_u) * (v - a_v) - (u - a_u) * (b_v - a_v)
        turn = ((a_v <= v) & (b_v > v) & (left > 0)).astype(np.int64) - ((b_v <= v) & (a_v > v) & (left < 0))
        wound = np.bincount(owner, turn, minlength=n) != 0
        return out | (wound & self.ring)

    def pruned(self, margin: float) -> Paths:
        """Without the points inside runs on one outer side of the clip box."""
        paths = self
        for side in range(4):
            bound = paths.box(margin)[side][paths.owner()]
            value = paths.u if side % 2 == 0 else paths.v
            out = value < bound if side < 2 else value > bound
            before, after = paths.neighbours()
            paths = paths.points(~(out & out[before] & out[after]))
        return paths

    def children(self) -> Paths:
        """Every path in the four tiles below."""
        n = len(self.x)
        out = self.take(np.repeat(np.arange(n), 4))
        dx, dy = np.tile([0, 1, 0, 1], n), np.tile([0, 0, 1, 1], n)
        return Paths(out.row, out.ring, 2 * out.x + dx, 2 * out.y + dy, out.at, out.u * 2, out.v * 2)


def _side(paths: Paths, axis: int, bound: np.ndarray, below: bool) -> Paths:
    """Rings cut at one axis-parallel line."""
    value, other = (paths.u, paths.v) if axis == 0 else (paths.v, paths.u)
    before, _ = paths.neighbours()
    owner = paths.owner()
    at = bound[owner]
    inside = value <= at if below else value >= at
    crossed = inside != inside[before]
    step = np.where(crossed, value - value[before], 1.0)
    cut = other[before] + (at - value[before]) / step * (other - other[before])
    sizes = crossed.astype(np.int64) + inside
    ends = np.concatenate(([0], np.cumsum(sizes)))
    a, b = np.empty(ends[-1]), np.empty(ends[-1])
    here = ends[:-1][crossed]
    a[here], b[here] = at[crossed], cut[crossed]
    here = (ends[1:] - 1)[inside]
    a[here], b[here] = value[inside], other[inside]
    u, v = (a, b) if axis == 0 else (b, a)
    return Paths(paths.row, paths.ring, paths.x, paths.y, ends[paths.at], u, v)


def _cut_rings(paths: Paths, box: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    for axis, side, below in ((0, 0, False), (0, 2, True), (1, 1, False), (1, 3, True)):
        paths = _side(paths, axis, box[side], below)
    owner = paths.owner()
    return owner, owner, paths.u, paths.v


def _cut_lines(paths: Paths, box: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, part, u and v of the points of all pieces; a piece goes on while the line stays inside."""
    after, met, enter, leave = paths.segments(box)
    single = np.diff(paths.at)[paths.owner()] == 1
    met &= (after != np.arange(len(after))) | single
    i = np.flatnonzero(met)
    owner, j = paths.owner()[i], after[i]
    goes_on = np.zeros(len(i), bool)
    goes_on[1:] = (i[1:] == i[:-1] + 1) & (owner[1:] == owner[:-1]) & (leave[i[:-1]] == 1) & (enter[i[1:]] == 0)
    part = np.cumsum(~goes_on)
    sides = [s[owner] for s in box]

    def at(t: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, entering: bool) -> np.ndarray:
        """Coordinate of the point at t; a point on a side of the box has exactly the side's."""
        step = b - a
        bound = np.where((step > 0) == entering, low, high)
        on_side = (step != 0) & ((bound - a) / np.where(step == 0, 1.0, step) == t)
        inner = np.where(on_side, bound, a + t * step)
        return np.where(t == 0, a, inner) if entering else np.where(t == 1, b, inner)

    ends = [
        at(t[i], c[i], c[j], sides[k], sides[k + 2], entering)
        for t, entering in ((enter, True), (leave, False)) for k, c in enumerate((paths.u, paths.v))
    ]
    order = np.argsort(np.concatenate((2 * np.flatnonzero(~goes_on), 2 * np.arange(len(i)) + 1)), kind="stable")

    def both(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return np.concatenate((first[~goes_on], second))[order]

    return both(owner, owner), both(part, part), both(ends[0], ends[2]), both(ends[1], ends[3])


def cut(paths: Paths, margin: float, extent: int) -> tuple[np.ndarray, pa.Array]:
    """For each path its clipped pieces in whole units of its tile, as arrays of points; and which paths have any."""
    pieces = []
    for ring, clip in ((True, _cut_rings), (False, _cut_lines)):
        which = np.flatnonzero(paths.ring == ring)
        some = paths.take(which)
        owner, part, u, v = clip(some, some.box(margin))
        pieces.append((which[owner], part, u, v))
    owner, part, u, v = (np.concatenate(x) for x in zip(*pieces))
    order = np.argsort(owner, kind="stable")
    owner, part = owner[order], part[order]
    qx = np.floor((u[order] - paths.x[owner]) * extent).astype(np.int32)
    qy = np.floor((v[order] - paths.y[owner]) * extent).astype(np.int32)
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
    keep = fresh.copy()
    keep[1:] |= (qx[1:] != qx[:-1]) | (qy[1:] != qy[:-1])
    starts, owners = np.flatnonzero(fresh[keep]), owner[fresh]
    dots = pa.StructArray.from_arrays([pa.array(qx[keep]), pa.array(qy[keep])], ["qx", "qy"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, keep.sum()), pa.int32()), dots)
    some = np.unique(owners)
    return some, pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(owners, some), len(owners)), pa.int32()), lists)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = column.value_lengths().to_numpy()
    return np.concatenate(([0], np.cumsum(sizes))), column.flatten().to_numpy()


def _first_tiles(paths: Paths, zoom: int, half: float) -> Iterator[tuple[int, Paths]]:
    """The paths in the tiles of the zoom at which each spans about one tile, ``zoom`` at most."""
    low = [np.minimum.reduceat(x, paths.at[:-1]) for x in (paths.u, paths.v)]
    high = [np.maximum.reduceat(x, paths.at[:-1]) for x in (paths.u, paths.v)]
    span = np.maximum(high[0] - low[0], high[1] - low[1])
    fits = np.floor(-np.log2(np.maximum(span, 2.0**-40)))
    start = np.clip(fits, 0, zoom).astype(np.int64)
    for z in np.unique(start):
        which, n = np.flatnonzero(start == z), 2 ** int(z)
        spans = []
        for a, b in zip(low, high):
            first = np.maximum(np.floor(a[which] * n - 1 - half), 0).astype(np.int64)
            last = np.minimum(np.floor(b[which] * n + half), n - 1).astype(np.int64)
            spans.append((first, np.maximum(last - first + 1, 0)))
        (x, nx), (y, ny) = spans
        here = paths.take(np.repeat(which, nx * ny))
        k = _ranges(np.zeros(len(which), np.int64), nx * ny)
        tall = np.repeat(ny, nx * ny)
        here.x, here.y = np.repeat(x, nx * ny) + k // np.maximum(tall, 1), np.repeat(y, nx * ny) + k % np.maximum(tall, 1)
        here.u, here.v = here.u * n, here.v * n
        yield int(z), here


def _walk(work: list[tuple[int, Paths]], last: int, half: float, margin: float) -> Iterator[tuple[int, Paths]]:
    """Every tile met down to the zoom ``last``, with its part of the path."""
    while work:
        z, paths = work.pop()
        if len(paths.u) > POINTS and len(paths.x) > 1:
            middle = len(paths.x) // 2
            work += [(z, paths.take(np.arange(*r))) for r in ((0, middle), (middle, len(paths.x)))]
            continue
        paths = paths.take(np.flatnonzero(paths.meets(paths.box(half, z))))
        if not len(paths.x):
            continue
        paths = paths.pruned(margin)
        yield z, paths
        if z < last:
            work.append((z + 1, paths.children()))


def clip_to_tiles(
    features: DataFrame, zooms: Iterable[int], extent: int = 4096, buffer: float = 0.125, attributes: Sequence[str] = ()
) -> DataFrame:
    """Geometries in every tile whose buffered envelope they meet: ``z, x, y, gid, kind, paths`` and the attributes.

    ``paths`` are cut to the wider clip box and rounded down to whole units.
    """
    zooms = sorted(set(int(z) for z in zooms))
    half, margin = buffer / 2, int(buffer * extent) / extent
    keep = ["gid", "kind", *attributes]
    rows = world_paths(features, attributes)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kept = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    schema = f"z int, x int, y int, {kept}, paths array<array<struct<qx:int,qy:int>>>"
    handed_on = f"z int, x int, y int, {kept}, us array<double>, vs array<double>"
    shapes = [to_arrow_schema(StructType.fromDDL(text)) for text in (schema, handed_on)]
    out, low = None, None
    while zooms:
        first = zooms[0] if low is None else low
        here, zooms = [z for z in zooms if z <= first + STEP], [z for z in zooms if z > first + STEP]

        def run(batches: Iterator[pa.RecordBatch], wanted=frozenset(here), low=low, first=first, last=first + STEP if zooms else here[-1], on=False):
            arrow = shapes[on]
            for batch in batches:
                at, u = _lists(batch.column("us"))
                _, v = _lists(batch.column("vs"))
                n = len(batch)
                if not n:
                    continue
                kind = batch.column("kind").to_numpy(zero_copy_only=False)
                ring = (kind == "polygon") | (kind == "box")
                x, y = ((batch.column(c).to_numpy().astype(np.int64) for c in "xy") if low is not None else (np.zeros(n, np.int64),) * 2)
                paths = Paths(np.arange(n), ring, x, y, at, u, v)
                first_point, last_point = at[:-1], at[1:] - 1
                closed = ring & (last_point > first_point) & (u[first_point] == u[last_point]) & (v[first_point] == v[last_point])
                whole = np.ones(len(u), bool)
                whole[last_point[closed]] = False
                paths = paths.points(whole)
                work = [(low + 1, paths.children())] if low is not None else list(_first_tiles(paths, first, half))
                for z, met in _walk(work, last, half, margin):
                    if on:
                        some = np.arange(len(met.x)) if z == last else None
                        lists = [pa.ListArray.from_arrays(pa.array(met.at, pa.int32()), pa.array(c)) for c in (met.u, met.v)]
                    elif z in wanted:
                        some, pieces = cut(met, margin, extent)
                        lists = [pieces]
                    else:
                        some = None
                    if some is None or not len(some):
                        continue
                    tiles = [pa.array(np.full(len(some), z), pa.int32()), *(pa.array(c[some], pa.int32()) for c in (met.x, met.y))]
                    of_row = pa.array(met.row[some])
                    columns = [*tiles, *(batch.column(c).take(of_row) for c in keep), *lists]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        made = rows.mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
        if zooms:
            low = first + STEP
            further = rows.mapInArrow(lambda batches, run=run: run(batches, on=True), handed_on)
            rows = written(further.repartition("gid", "x", "y"), "clipped")
    return out
