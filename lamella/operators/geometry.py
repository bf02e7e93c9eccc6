"""Shapes and graphs of one region or cell at a time, in numpy, as grouped functions.

A group is one cell's contour or one region's points; these fit a task by their nature.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.expressions import finite
from lamella.operators.grouped import by_group

EPS = 1e-9


def _snake(points: np.ndarray) -> np.ndarray:
    """An order in which neighbours follow each other: strips of rows, walked to and fro."""
    low, span = points.min(0), np.maximum(np.ptp(points, axis=0), 1e-9)
    strips = max(1, int(math.sqrt(len(points) / 2)))
    row = np.minimum(((points[:, 1] - low[1]) / span[1] * strips).astype(int), strips - 1)
    return np.lexsort((np.where(row % 2, -points[:, 0], points[:, 0]), row))


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles of a Delaunay triangulation: rows of three point numbers.

    Points are inserted along a snake; each is found by a walk from the triangle made last, and only triangles
    whose circle holds it are replaced, so that a point takes a few steps however many there are.
    """
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), int)
    mid, span = points.mean(0), max(np.ptp(points, axis=0).max(), 1e-9)
    p = np.vstack([(points - mid) / span, [[-1e4, -1e4], [1e4, -1e4], [0, 1e4]]])
    xs, ys = p[:, 0].tolist(), p[:, 1].tolist()
    third: dict[tuple[int, int], int] = {}  # of the triangle on the left of a directed edge

    def add(a: int, b: int, c: int) -> None:
        third[a, b], third[b, c], third[c, a] = c, a, b

    def left_of(a: int, b: int, x: float, y: float) -> bool:
        return (xs[b] - xs[a]) * (y - ys[a]) - (ys[b] - ys[a]) * (x - xs[a]) >= 0

    def circle_holds(a: int, b: int, c: int, x: float, y: float) -> bool:
        ax, ay, bx, by, cx, cy = xs[a] - x, ys[a] - y, xs[b] - x, ys[b] - y, xs[c] - x, ys[c] - y
        return (ax * ax + ay * ay) * (bx * cy - by * cx) - (bx * bx + by * by) * (ax * cy - ay * cx) + (cx * cx + cy * cy) * (ax * by - ay * bx) > 0

    add(n, n + 1, n + 2)
    here, seen = (n, n + 1, n + 2), set()
    for i in _snake(points).tolist():
        x, y = xs[i], ys[i]
        if (x, y) in seen:  # a copy of a point has no triangle of its own
            continue
        seen.add((x, y))
        a, b, c = here
        for _ in range(4 * n + 16):
            if not left_of(a, b, x, y):
                a, b, c = b, a, third[b, a]
            elif not left_of(b, c, x, y):
                a, b, c = c, b, third[c, b]
            elif not left_of(c, a, x, y):
                a, b, c = a, c, third[a, c]
            else:
                break
        edges = [(a, b), (b, c), (c, a)]
        for e in edges:
            del third[e]
        while edges:
            a, b = edges.pop()
            c = third.get((b, a))
            if c is not None and circle_holds(b, a, c, x, y):
                del third[b, a], third[a, c], third[c, b]
                edges += [(a, c), (c, b)]
            else:
                add(i, a, b)
                here = (i, a, b)
    return np.array([(a, b, c) for (a, b), c in third.items() if a < b and a < c and max(b, c) < n], int).reshape(-1, 3)


def edges_of(triangles: np.ndarray) -> np.ndarray:
    if not len(triangles):
        return np.zeros((0, 2), int)
    return np.unique(np.sort(np.concatenate([triangles[:, [0, 1]], triangles[:, [1, 2]], triangles[:, [0, 2]]]), axis=1), axis=0)


def line_edges(points: np.ndarray, k: int) -> np.ndarray:
    """Edges to the k nearest of points that lie on one line: in its order, they are within k places."""
    n = len(points)
    order = np.lexsort((points[:, 1], points[:, 0]))
    at = points[order]
    out = []
    for step in range(1, min(k, n - 1) + 1):
        i = np.arange(n - step)
        out += [np.stack([i, i + step], 1), np.stack([i + step, i], 1)]
    pairs = np.concatenate(out)
    dist = np.hypot(*(at[pairs[:, 0]] - at[pairs[:, 1]]).T)
    turn = np.lexsort((order[pairs[:, 1]], dist, pairs[:, 0]))
    place = np.arange(len(turn)) - np.searchsorted(pairs[turn, 0], pairs[turn, 0])
    near = order[pairs[turn[place < k]]]
    return np.unique(np.sort(near, axis=1), axis=0)


def voronoi_cells(points: np.ndarray, triangles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Area and irregularity of each point's Voronoi cell; NaN where it is unbounded."""
    n = len(points)
    area, irregular = np.full(n, np.nan), np.full(n, np.nan)
    if n < 4 or not len(triangles):
        return area, irregular
    a, b, c = points[triangles[:, 0]], points[triangles[:, 1]], points[triangles[:, 2]]
    d = 2 * ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
    ab, ac = ((b - a) ** 2).sum(1), ((c - a) ** 2).sum(1)
    centre = a + np.stack([((c[:, 1] - a[:, 1]) * ab - (b[:, 1] - a[:, 1]) * ac) / d, ((b[:, 0] - a[:, 0]) * ac - (c[:, 0] - a[:, 0]) * ab) / d], 1)
    pairs, times = np.unique(np.sort(np.concatenate([triangles[:, [0, 1]], triangles[:, [1, 2]], triangles[:, [0, 2]]]), axis=1), axis=0, return_counts=True)
    closed = np.ones(n, bool)
    closed[pairs[times == 1].ravel()] = False  # on the hull
    # all corners of all cells, by point and then by angle round it
    own, v = triangles.ravel(), np.repeat(centre, 3, axis=0)
    turn = np.lexsort((np.arctan2(v[:, 1] - points[own, 1], v[:, 0] - points[own, 0]), own))
    own, v = own[turn], v[turn]
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    size = np.diff(np.append(starts, len(own)))
    follow = np.arange(1, len(own) + 1)
    follow[starts + size - 1] = starts
    nxt = v[follow]
    cell = own[starts]
    whole = 0.5 * np.abs(np.add.reduceat(v[:, 0] * nxt[:, 1] - v[:, 1] * nxt[:, 0], starts))
    around = np.add.reduceat(np.hypot(*(nxt - v).T), starts)
    ok = closed[cell] & (size >= 3)
    area[cell[ok]] = whole[ok]
    irregular[cell[ok]] = around[ok] ** 2 / (4 * math.pi * whole[ok] + EPS)
    return area, irregular


def _known(points: DataFrame) -> DataFrame:
    """Points of known place; a null, NaN or infinite coordinate has no circle and no walk reaches it."""
    return points.filter(finite(F.col("x").cast("double")).isNotNull() & finite(F.col("y").cast("double")).isNotNull())


def _places(t: pa.Table) -> np.ndarray:
    return np.stack([t[c].to_numpy().astype(float) for c in ("x", "y")], 1)


def region_graph(points: DataFrame, by: list[str], k: int = 6) -> DataFrame:
    """(by, id, x, y) to the region's edges (by, a, b, dist): Delaunay, or k nearest where there is no triangle.

    Points of unknown place have no edges.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def work(t: pa.Table, heads: np.ndarray) -> dict:
        xy, found = _places(t), [np.zeros((0, 2), int)]
        for lo, hi in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            own = xy[lo:hi]
            e = edges_of(delaunay(own))
            if not len(e) and hi - lo > 1:
                e = line_edges(own, k)
            found.append(e + lo)
        e = np.concatenate(found)
        a, b = pa.array(e[:, 0]), pa.array(e[:, 1])
        return {c: t[c].take(a) for c in by} | {"a": t["id"].take(a), "b": t["id"].take(b), "dist": pa.array(np.hypot(*(xy[e[:, 0]] - xy[e[:, 1]]).T))}

    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + [f"a {kinds['id']}", f"b {kinds['id']}", "dist double"])
    return by_group(_known(points).select(*by, "id", "x", "y"), by, ["id"], work, schema)


def region_voronoi(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, x, y) to voronoi_area_px2 and voronoi_polygon_irregularity a point; null where unbounded or of unknown place."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def work(t: pa.Table, heads: np.ndarray) -> dict:
        xy, n = _places(t), t.num_rows
        area, irregular = np.full(n, np.nan), np.full(n, np.nan)
        for lo, hi in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            area[lo:hi], irregular[lo:hi] = voronoi_cells(xy[lo:hi], delaunay(xy[lo:hi]))
        return {c: t[c] for c in [*by, "id"]} | {"voronoi_area_px2": pa.array(area, from_pandas=True), "voronoi_polygon_irregularity": pa.array(irregular, from_pandas=True)}

    schema = ", ".join([f"{c} {kinds[c]}" for c in [*by, "id"]] + ["voronoi_area_px2 double", "voronoi_polygon_irregularity double"])
    known = finite(F.col("x").cast("double")).isNotNull() & finite(F.col("y").cast("double")).isNotNull()
    lost = points.filter(~known).select(*by, "id", F.lit(None).cast("double").alias("voronoi_area_px2"), F.lit(None).cast("double").alias("voronoi_polygon_irregularity"))
    return by_group(_known(points).select(*by, "id", "x", "y"), by, ["id"], work, schema).unionByName(lost)


def convex_hull(xy: np.ndarray) -> np.ndarray:
    """Hull points, counter-clockwise."""
    pts = sorted(set(map(tuple, xy.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(reversed(pts)))


def length_of(xy: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(xy, -1, axis=0) - xy).T).sum()) if len(xy) else 0.0


def area_of(xy: np.ndarray) -> float:
    n = np.roll(xy, -1, axis=0)
    return float(abs((xy[:, 0] * n[:, 1] - xy[:, 1] * n[:, 0]).sum()) / 2) if len(xy) else 0.0


def concavities(xy: np.ndarray, deeper_than: float = 1.0) -> tuple[float, float]:
    """Stretches of the outline that fall behind the hull by more than the limit, and their mean depth."""
    hull = convex_hull(xy)
    if len(hull) < 3:
        return math.nan, math.nan
    on = {tuple(p) for p in hull.tolist()}
    marks = [i for i, p in enumerate(xy.tolist()) if tuple(p) in on]
    depths = []
    for a, b in zip(marks, marks[1:] + [marks[0] + len(xy)], strict=True):
        if b - a > 1:
            p, q = xy[a % len(xy)], xy[b % len(xy)]
            base = math.hypot(*(q - p))
            inner = xy[np.arange(a + 1, b) % len(xy)]
            if base > 0:
                depths.append(np.abs((q[0] - p[0]) * (inner[:, 1] - p[1]) - (q[1] - p[1]) * (inner[:, 0] - p[0])).max() / base)
    deep = [d for d in depths if d > deeper_than]
    return float(len(deep)), float(np.mean(deep)) if deep else 0.0


def half_contours(values: np.ndarray, level: float = 0.5) -> list[np.ndarray]:
    """The lines where an image crosses a level, as chains of [x, y] points, values above the level on the same side of all.

    Each square of four neighbouring pixels has a crossing on every side whose ends lie on different sides of the level,
    interpolated between them. Going round a square clockwise, a step down after a step up bounds one group of high corners, and a
    segment joins the two, so that high corners across a saddle stay apart. Segments that share a crossing are chained; a chain
    that meets the image's edge is open, others start and end with the same point. Chains come in the order of their first segments.
    """
    h, w = values.shape
    if h < 2 or w < 2:
        return []
    high = values > level
    corners = [high[:-1, :-1], high[:-1, 1:], high[1:, 1:], high[1:, :-1]]  # clockwise from the upper left
    mixed = np.argwhere(~(corners[0] & corners[1] & corners[2] & corners[3]) & (corners[0] | corners[1] | corners[2] | corners[3]))
    after: dict[tuple[int, int, bool], tuple[int, int, bool]] = {}  # a crossing: its pixel and whether it lies on the way right
    first: dict[tuple[int, int, bool], int] = {}
    for n, (r, c) in enumerate(mixed.tolist()):
        sides = [(r, c, True), (r, c + 1, False), (r + 1, c, True), (r, c, False)]
        up = [bool(x[r, c]) for x in corners]
        for i in range(4):
            if not up[i - 1] and up[i]:  # the side before corner i leads up
                k = next(j for j in range(i, i + 4) if up[j % 4] and not up[(j + 1) % 4])
                after[sides[k % 4]] = sides[i - 1]
                first[sides[k % 4]] = n
    ends = set(after.values())
    chains: list[tuple[int, list]] = []
    seen: set[tuple[int, int, bool]] = set()
    for start in [p for p in after if p not in ends] + list(after):
        if start in seen:
            continue
        path, numbers, at = [start], [], start
        while at in after and at not in seen:
            seen.add(at)
            numbers.append(first[at])
            at = after[at]
            path.append(at)
        if path[0] == path[-1]:  # a closed chain begins after its last segment in scan order
            turn = int(np.argmax(numbers)) + 1
            path = path[turn:-1] + path[:turn] + [path[turn % (len(path) - 1)]]
        chains.append((min(numbers), path))

    def place(p: tuple[int, int, bool]) -> tuple[float, float]:
        r, c, right = p
        a, b = float(values[r, c]), float(values[r, c + 1] if right else values[r + 1, c])
        t = (level - a) / (b - a)
        return (c + t, float(r)) if right else (float(c), r + t)

    return [np.array([place(p) for p in path]) for _, path in sorted(chains, key=lambda x: x[0])]


def longest_contour(mask: np.ndarray) -> np.ndarray:
    """The half-level chain of most points, the first of several; no points for a mask without crossings in its box."""
    return max(half_contours(mask.astype(float)), key=len, default=np.zeros((0, 2)))


def border_chain(mask: np.ndarray) -> np.ndarray:
    """The outer border of the 8-connected part with the largest border area: pixel centres [x, y] in walking order."""
    turns = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    pad = np.pad(mask, 1)
    best, left = np.zeros((0, 2)), pad.copy()
    while left.any():
        r, c = (int(x[0]) for x in np.nonzero(left))
        path, at, back = [(r, c)], (r, c), 4  # came from the left, which is free
        begin = None
        while True:
            for k in range(1, 9):
                d = (back + k) % 8
                to = (at[0] + turns[d][0], at[1] + turns[d][1])
                if pad[to]:
                    break
            else:
                break
            if begin is None:
                begin = d
            elif at == (r, c) and d == begin:
                path.pop()
                break
            at, back = to, (d + 4) % 8
            path.append(at)
        stack = [(r, c)]
        left[r, c] = False
        while stack:  # the part that was walked round
            a, b = stack.pop()
            for dr, dc in turns:
                if left[a + dr, b + dc]:
                    left[a + dr, b + dc] = False
                    stack.append((a + dr, b + dc))
        xy = np.array([(c - 1, r - 1) for r, c in path], float)
        if not len(best) or area_of(xy) > area_of(best):
            best = xy
    return best


def hull_defects(xy: np.ndarray) -> list[float]:
    """For each side of the hull of a closed chain that the chain falls behind: how far, in steps of 1/256."""
    hull = convex_hull(xy)
    if len(hull) < 3:
        return []
    on, marks = {tuple(p) for p in hull.tolist()}, []
    for i, p in enumerate(xy.tolist()):
        if tuple(p) in on:
            on.discard(tuple(p))
            marks.append(i)
    depths = []
    for a, b in zip(marks, marks[1:] + [marks[0] + len(xy)], strict=True):
        p, q = xy[a % len(xy)], xy[b % len(xy)]
        base, inner = math.hypot(*(q - p)), xy[np.arange(a + 1, b) % len(xy)]
        if len(inner) and base > 0:
            depth = np.abs((q[0] - p[0]) * (inner[:, 1] - p[1]) - (q[1] - p[1]) * (inner[:, 0] - p[0])).max() / base
            if depth > 0:
                depths.append(round(depth * 256) / 256)
    return depths


def concavity(mask: np.ndarray, around: float, contour: np.ndarray) -> tuple[float, float, float]:
    """Number and mean depth of concavities and hull length over the perimeter, from a cell's mask, perimeter and half-level contour.

    Concavities are the sides of the border's hull that it falls behind by over a pixel; a border without any such side is judged
    by dips of the contour's distance from its centre below a running mean.
    """
    if len(contour) < 4:
        return math.nan, math.nan, math.nan
    border = border_chain(mask)
    depths = hull_defects(border) if len(border) >= 4 else []
    if depths:
        deep = [d for d in depths if d > 1]
        return float(len(deep)), float(np.mean(deep)) if deep else 0.0, length_of(convex_hull(border)) / (around + EPS) if around > 0 else math.nan
    hull = convex_hull(contour)
    radial = np.hypot(*(contour - contour.mean(0)).T)
    count, depth = math.nan, math.nan
    if len(radial) >= 8:
        size = max(5, len(radial) // 20)
        window = (np.arange(len(radial))[:, None] + np.arange(size) - size // 2) % len(radial)
        dip = radial[window].mean(1) - radial
        low = dip > max(1.0, float(dip.std()))
        count, depth = float((low & ~np.roll(low, 1)).sum()), float(dip[low].mean()) if low.any() else 0.0
    return count, depth, length_of(hull) / (around + EPS) if around > 0 and len(hull) >= 3 else math.nan


def hull_pixels(mask: np.ndarray) -> float:
    """Pixels whose centre lies in the hull of the midpoints of all pixels' sides, its edge included."""
    r, c = np.nonzero(boundary(mask))
    ends = np.concatenate([np.column_stack([c + dx, r + dy]) for dx, dy in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))])
    hull = convex_hull(ends.astype(float))
    y, x = np.mgrid[: mask.shape[0], : mask.shape[1]]
    inside = np.ones(mask.shape, bool)
    for p, q in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        inside &= (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= -1e-9
    if not inside.any():  # a hull given clockwise
        inside = np.ones(mask.shape, bool)
        for p, q in zip(hull, np.roll(hull, -1, axis=0), strict=True):
            inside &= (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) <= 1e-9
    return float(inside.sum())


def fourier_amplitudes(xy: np.ndarray, harmonics: int = 10, samples: int = 128) -> list[float]:
    """Amplitudes of an outline resampled by arc length, over that of the first harmonic; NaN for none."""
    if len(xy) < 3:
        return [math.nan] * harmonics
    ring = np.vstack([xy, xy[:1]])
    walk = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(ring, axis=0).T))])
    if walk[-1] <= EPS:
        return [math.nan] * harmonics
    at = np.arange(samples) * walk[-1] / samples
    z = np.interp(at, walk, ring[:, 0]) + 1j * np.interp(at, walk, ring[:, 1])
    amp = np.abs(np.fft.fft(z - z.mean()))
    return (amp[1 : harmonics + 1] / (amp[1] if amp[1] > EPS else 1.0)).tolist()


def fill_polygons(xy: np.ndarray, starts: np.ndarray, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Runs (polygon, row, first column, last column) of the pixels whose centre a polygon holds, edges included, by scan line.

    Polygon i has the points from starts[i] to starts[i + 1]. No pixel is in two runs of a polygon. Polygons of
    fewer than three points or with an unknown coordinate have no pixels.
    """
    size = np.diff(starts)
    own = np.repeat(np.arange(len(size)), size)
    ok = (size >= 3) & (np.bincount(own[~np.isfinite(xy).all(1)], minlength=len(size)) == 0)
    follow = np.arange(1, len(xy) + 1)
    follow[starts[1:][size > 0] - 1] = starts[:-1][size > 0]
    edge = np.flatnonzero(ok[own])
    own, (x, y), (u, v) = own[edge], xy[edge].T, xy[follow[edge]].T
    # an edge crosses the rows from its lower end up to, not with, its upper one
    low, high = np.maximum(np.ceil(np.minimum(y, v)), 0), np.minimum(np.ceil(np.maximum(y, v)), height[own])
    times = np.maximum(high - low, 0).astype(int)
    e = np.repeat(np.arange(len(own)), times)
    row = low[e] + np.arange(len(e)) - np.repeat(np.cumsum(times) - times, times)
    at = x[e] + (row - y[e]) * (u[e] - x[e]) / (v[e] - y[e])
    turn = np.lexsort((at, row, own[e]))
    crossed, row, at = own[e][turn], row[turn], at[turn]
    flat = np.flatnonzero((y == v) & (y == np.floor(y)) & (y >= 0) & (y < height[own]))
    poly = np.append(crossed[::2], own[flat])
    runs = np.stack([poly, np.append(row[::2], y[flat]), np.maximum(0, np.ceil(np.append(at[::2], np.minimum(x[flat], u[flat])))), np.minimum(width[poly] - 1, np.floor(np.append(at[1::2], np.maximum(x[flat], u[flat]))))], 1).astype(int)
    runs = runs[runs[:, 2] <= runs[:, 3]]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):
        new = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(1))
        lift = np.cumsum(new) * (int(runs[:, 3].max()) + 2)
        reached = np.maximum.accumulate(runs[:, 3] + lift)
        runs[1:, 2] = np.where(new[1:], runs[1:, 2], np.maximum(runs[1:, 2], reached[:-1] - lift[1:] + 1))
    return runs[runs[:, 2] <= runs[:, 3]]


def fill_polygon(xy: np.ndarray, width: int, height: int) -> np.ndarray:
    """Runs (row, first column, last column) of one polygon."""
    return fill_polygons(np.asarray(xy, float).reshape(-1, 2), np.array([0, len(xy)]), np.array([width]), np.array([height]))[:, 1:]


def label_components(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a mask, numbered from 1 in scan order, by union of runs."""
    out, parent = np.zeros(mask.shape, int), [0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for r in range(mask.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[r].astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            above = {root(x) for x in np.unique(out[r - 1, a:b]) if x} if r else set()
            if above:
                keep = min(above)
                for x in above:
                    parent[x] = keep
            else:
                keep = len(parent)
                parent.append(keep)
            out[r, a:b] = keep
    roots = np.array([root(i) for i in range(len(parent))])
    seen = np.unique(roots[out][mask]) if mask.any() else np.zeros(0, int)
    renumber = np.zeros(len(parent), int)
    renumber[seen] = np.arange(1, len(seen) + 1)
    return renumber[roots[out]] * mask


def keep_large(mask: np.ndarray, at_least: int) -> np.ndarray:
    lab = label_components(mask)
    size = np.bincount(lab.ravel())
    size[0] = 0
    return size[lab] >= max(1, at_least)


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """By a disc."""
    out = np.zeros_like(mask)
    h, w = mask.shape
    for dr in range(-radius, radius + 1):
        for dc in range(-radius, radius + 1):
            if dr * dr + dc * dc <= radius * radius:
                out[max(0, dr) : h + min(0, dr), max(0, dc) : w + min(0, dc)] |= mask[max(0, -dr) : h + min(0, -dr), max(0, -dc) : w + min(0, -dc)]
    return out


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    return ~dilate(~mask, radius)


def close(mask: np.ndarray, radius: int) -> np.ndarray:
    return erode(dilate(mask, radius), radius)


def boundary(mask: np.ndarray) -> np.ndarray:
    """Pixels of the mask with a 4-neighbour outside it."""
    pad = np.pad(mask, 1)
    return mask & ~(pad[:-2, 1:-1] & pad[2:, 1:-1] & pad[1:-1, :-2] & pad[1:-1, 2:])


def box_mean(values: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square window, edges mirrored."""
    r = size // 2
    p = np.pad(values.astype(float), r, mode="symmetric")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / (size * size)


def blur(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(values, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        values = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, p)
    return values


def peaks(values: np.ndarray, mask: np.ndarray, least: float, apart: int = 2) -> list[tuple[int, int]]:
    """Local maxima of at least a value, strongest first, none within reach of a stronger one."""
    cand = sorted(((-values[r, c], r, c) for r, c in zip(*np.nonzero(mask & (values >= least)), strict=True)))
    out: list[tuple[int, int]] = []
    h, w = values.shape
    for v, r, c in cand:
        near = values[max(0, r - apart) : min(h, r + apart + 1), max(0, c - apart) : min(w, c + apart + 1)]
        if -v >= near.max() and all(max(abs(r - a), abs(c - b)) > apart for a, b in out):
            out.append((int(r), int(c)))
    return out


def nucleolar(values: np.ndarray, mask: np.ndarray) -> tuple[float, float, float]:
    """Bright peaks of a nucleus: number, per pixel, and the largest contrast to the median."""
    n = int(mask.sum())
    if n < 16:
        return (math.nan,) * 3
    own = values[mask]
    smooth = blur(np.where(mask, values, own.min()))
    found = peaks(smooth, mask, float(np.percentile(own, 90)))
    top = max((smooth[p] for p in found), default=None)
    return float(len(found)), len(found) / (n + EPS), 0.0 if top is None else float(top - np.median(own))


def gabor(values: np.ndarray, frequency: float, theta: float) -> np.ndarray:
    """Magnitude of a complex Gabor response of one octave bandwidth."""
    sigma = math.sqrt(math.log(2) / 2) / math.pi * 3 / frequency
    r = max(math.ceil(3 * sigma), 1)
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    u = x * math.cos(theta) + y * math.sin(theta)
    v = -x * math.sin(theta) + y * math.cos(theta)
    kernel = np.exp(-0.5 * (u * u + v * v) / sigma**2) / (2 * math.pi * sigma**2) * np.exp(2j * math.pi * frequency * u)
    shape = [a + b - 1 for a, b in zip(values.shape, kernel.shape, strict=True)]
    p = np.pad(values, r, mode="symmetric")
    shape = [a + 2 * r for a in shape]
    full = np.fft.ifft2(np.fft.fft2(p, shape) * np.fft.fft2(kernel, shape))
    return np.abs(full[2 * r : 2 * r + values.shape[0], 2 * r : 2 * r + values.shape[1]])


def clumping(values: np.ndarray, mask: np.ndarray) -> float:
    """Mean over a nucleus of the variance in 5 x 5, values outside it counting as 0; NaN for fewer than 16 pixels."""
    if mask.sum() < 16:
        return math.nan
    own = np.where(mask, values, 0.0)
    return float(np.maximum(box_mean(own**2, 5) - box_mean(own, 5) ** 2, 0)[mask].mean())


def texture(values: np.ndarray, mask: np.ndarray) -> dict[str, float]:
    """Gabor and peak measurements of one nucleus; the pixel-row operators hold the rest."""
    out: dict[str, float] = {}
    small = int(mask.sum()) < 8
    if not small:
        lo, hi = np.percentile(values[mask], [1, 99])
        image = np.clip((values - lo) / (hi - lo if hi > lo else EPS), 0, 1)
        image = np.where(mask, image, np.median(image[mask]))
    for f in (0.15, 0.3):
        for t in range(4):
            m = None if small else gabor(image, f, t * math.pi / 4)[mask]
            out[f"gabor_f{f:.2f}_theta{t}_mean"] = math.nan if small else float(m.mean())
            out[f"gabor_f{f:.2f}_theta{t}_std"] = math.nan if small else float(m.std())
    out["nucleolar_peak_count"], out["nucleolar_peak_density"], out["nucleolar_peak_contrast_max"] = nucleolar(values, mask)
    return out


def fit_affine(source: np.ndarray, target: np.ndarray, tolerance: float, rounds: int = 500, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """An affine transform by random samples of three points, refitted on all within tolerance: (2 x 3, inliers).

    Raises without three points off one line, or if orientation flips.
    """
    n = len(source)
    ones = np.column_stack([source, np.ones(n)])
    if n < 3 or np.linalg.matrix_rank(ones) < 3:
        raise ValueError("needs three points that are not on one line")
    rng, best = np.random.default_rng(seed), np.zeros(n, bool)
    for _ in range(rounds):
        pick = rng.choice(n, 3, replace=False)
        if abs(np.linalg.det(ones[pick])) < 1e-9:
            continue
        m = np.linalg.solve(ones[pick], target[pick])
        ok = np.hypot(*(ones @ m - target).T) <= tolerance
        if ok.sum() > best.sum():
            best = ok
    if best.sum() < 3:
        best = np.ones(n, bool)
    m = np.linalg.lstsq(ones[best], target[best], rcond=None)[0].T
    if np.linalg.det(m[:, :2]) <= 0:
        raise ValueError("orientation flips")
    return m, best


def contour_shapes(contours: DataFrame, keys: list[str], column: str = "contour", harmonics: int = 10) -> DataFrame:
    """Per cell contour (array of [x, y]): area, perimeter, hull, solidity, convexity, concavities, Fourier amplitudes."""
    kinds = {f.name: f.dataType.simpleString() for f in contours.schema}
    names = ["area_px", "perimeter_px", "convex_hull_area_px2", "solidity", "convexity", "concavity_count", "concavity_depth"] + [f"fourier_h{i}_amp" for i in range(1, harmonics + 1)]

    def run(batches):
        for pdf in batches:
            rows = []
            for c in pdf[column]:
                xy = np.array([list(p) for p in c], float) if c is not None and len(c) else np.zeros((0, 2))
                if len(xy) < 3:
                    rows.append([math.nan] * len(names))
                    continue
                hull = convex_hull(xy)
                a, p, ha = area_of(xy), length_of(xy), area_of(hull)
                rows.append([a, p, ha, a / ha if ha else math.nan, length_of(hull) / (p + EPS) if p else math.nan, *concavities(xy), *fourier_amplitudes(xy, harmonics)])
            out = pd.DataFrame(rows, columns=names, index=pdf.index)
            yield pd.concat([pdf[keys], out], axis=1).replace({np.nan: None})

    return contours.select(*keys, column).mapInPandas(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{n} double" for n in names]))
