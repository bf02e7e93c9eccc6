"""Points that two slides of a pair have in common: scale-space extrema, descriptors, matches, and the transform that they agree on.

An octave is a level of the preview's pyramid. Its pixels are dealt to tiles with a margin as wide as a descriptor
reaches, so that points, orientations and descriptors of a tile's core are the same whatever the tiling. Matching compares blocks of one
slide's descriptors with all of the other's, whose number ``MOST`` bounds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.operators import geometry, registration
from lamella.operators.registration import PAIR
from lamella.operators.relational import ContractError
from lamella.storage import stored

#: Base blur, scales an octave, contrast and edge limits, strongest points kept, ratio test, gates of a fit.
SIGMA, SCALES, CONTRAST, EDGE, MOST, RATIO = 1.6, 3, 0.04, 10.0, 12_000, 0.7
LEAST_MATCHES, LEAST_SHARE, LANDMARK_UM = 12, 0.25, 50.0
TILE, MARGIN, OCTAVES = 128, 56, 4
_CELLS, _ANGLES, _BINS = 4, 8, 36
_BLOCK = 1024


# --- one tile --------------------------------------------------------------------------------------------------------------


def _stack(image: np.ndarray) -> np.ndarray:
    """The image at the octave's scales, taken to have a blur of half a pixel."""
    out, now = [], 0.5
    for i in range(SCALES + 3):
        want = SIGMA * 2 ** (i / SCALES)
        image = geometry.blur(image, math.sqrt(max(want * want - now * now, 1e-4)))
        out.append(image)
        now = want
    return np.stack(out)


def extrema(stack: np.ndarray) -> list[tuple[float, float, float, float]]:
    """(row, col, scale, response) of the differences' extrema among their 26 neighbours, to fractions by a quadratic fit; weak and
    edge-like ones are left out."""
    d = np.diff(stack, axis=0)
    inner = d[1:-1, 1:-1, 1:-1]
    near = np.stack([d[1 + a : d.shape[0] - 1 + a, 1 + b : d.shape[1] - 1 + b, 1 + c : d.shape[2] - 1 + c] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)])
    peak = ((inner > near.max(0)) | (inner < near.min(0))) & (np.abs(inner) > 0.5 * CONTRAST / SCALES)
    out = []
    for s, r, c in np.argwhere(peak) + 1:
        box = d[s - 1 : s + 2, r - 1 : r + 2, c - 1 : c + 2]
        g = np.array([box[2, 1, 1] - box[0, 1, 1], box[1, 2, 1] - box[1, 0, 1], box[1, 1, 2] - box[1, 1, 0]]) / 2
        m = box[1, 1, 1]
        ss, rr, cc = box[2, 1, 1] + box[0, 1, 1] - 2 * m, box[1, 2, 1] + box[1, 0, 1] - 2 * m, box[1, 1, 2] + box[1, 1, 0] - 2 * m
        sr, sc = (box[2, 2, 1] - box[2, 0, 1] - box[0, 2, 1] + box[0, 0, 1]) / 4, (box[2, 1, 2] - box[2, 1, 0] - box[0, 1, 2] + box[0, 1, 0]) / 4
        rc = (box[1, 2, 2] - box[1, 2, 0] - box[1, 0, 2] + box[1, 0, 0]) / 4
        det = rr * cc - rc * rc
        if det <= 0 or (rr + cc) ** 2 * EDGE >= (EDGE + 1) ** 2 * det:
            continue
        h = np.array([[ss, sr, sc], [sr, rr, rc], [sc, rc, cc]])
        if abs(np.linalg.det(h)) < 1e-12:
            continue
        off = -np.linalg.solve(h, g)
        value = abs(m + g @ off / 2)
        if np.abs(off).max() > 1 or value * SCALES < CONTRAST:
            continue
        out.append((r + off[1], c + off[2], s + off[0], float(value)))
    return out


def _patch(image: np.ndarray, row: float, col: float, reach: int):
    """Gradients round a point: offsets, magnitudes and angles; None where the image ends."""
    r, c = round(row), round(col)
    if r - reach < 1 or c - reach < 1 or r + reach >= image.shape[0] - 1 or c + reach >= image.shape[1] - 1:
        return None
    y, x = np.mgrid[r - reach : r + reach + 1, c - reach : c + reach + 1]
    gx, gy = (image[y, x + 1] - image[y, x - 1]).ravel(), (image[y + 1, x] - image[y - 1, x]).ravel()
    return (y - row).ravel(), (x - col).ravel(), np.hypot(gx, gy), np.arctan2(gy, gx)


def orientations(image: np.ndarray, row: float, col: float, sigma: float) -> list[float]:
    """Main directions of the gradient round a point: peaks of at least 0.8 of the highest."""
    p = _patch(image, row, col, round(4.5 * sigma))
    if p is None:
        return []
    dy, dx, size, angle = p
    weight = size * np.exp(-(dy * dy + dx * dx) / (2 * (1.5 * sigma) ** 2))
    hist = np.bincount(np.round(angle / (2 * math.pi) * _BINS).astype(int) % _BINS, weight, _BINS)
    hist = (6 * hist + 4 * (np.roll(hist, 1) + np.roll(hist, -1)) + np.roll(hist, 2) + np.roll(hist, -2)) / 16
    left, right = np.roll(hist, 1), np.roll(hist, -1)
    top = np.flatnonzero((hist > left) & (hist > right) & (hist >= 0.8 * hist.max()) & (hist > 0))
    return [((k + 0.5 * (left[k] - right[k]) / (left[k] - 2 * hist[k] + right[k])) % _BINS) * 2 * math.pi / _BINS for k in top]


def descriptor(image: np.ndarray, row: float, col: float, sigma: float, angle: float) -> np.ndarray | None:
    """Gradient directions in 4 x 4 cells turned with the point, shared between neighbouring cells and directions, as 128 bytes."""
    cell = 3 * sigma
    p = _patch(image, row, col, math.ceil(cell * math.sqrt(2) * (_CELLS + 1) / 2))
    if p is None:
        return None
    dy, dx, size, way = p
    u, v = (dx * math.cos(angle) + dy * math.sin(angle)) / cell, (-dx * math.sin(angle) + dy * math.cos(angle)) / cell
    size = size * np.exp(-(u * u + v * v) / (2 * (_CELLS / 2) ** 2))
    at = np.stack([v + _CELLS / 2 - 0.5, u + _CELLS / 2 - 0.5, ((way - angle) / (2 * math.pi) * _ANGLES) % _ANGLES])
    low = np.floor(at).astype(int)
    part = at - low
    out = np.zeros(_CELLS * _CELLS * _ANGLES)
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                i, j, k = low[0] + a, low[1] + b, (low[2] + c) % _ANGLES
                ok = (i >= 0) & (i < _CELLS) & (j >= 0) & (j < _CELLS)
                w = size * np.abs(1 - a - part[0]) * np.abs(1 - b - part[1]) * np.abs(1 - c - part[2])
                out += np.bincount(((i * _CELLS + j) * _ANGLES + k)[ok], w[ok], len(out))
    out = np.minimum(out, 0.2 * np.linalg.norm(out))
    norm = np.linalg.norm(out)
    return np.minimum(np.round(out * 512 / norm), 255).astype(np.uint8) if norm > 0 else None


# --- Spark -----------------------------------------------------------------------------------------------------------------


def octave_points(level: DataFrame, octave: int, tile: int = TILE, margin: int = MARGIN) -> DataFrame:
    """Pixels (slide, row, col, v), v 0 to 1, to slide, octave, row, col, scale, angle, response, code; missing pixels count as 0."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    x = level.select(PAIR, "row", "col", "v", steps.alias("o")).withColumns({"tr": F.floor(F.col("row") / tile) + F.col("o.a"), "tc": F.floor(F.col("col") / tile) + F.col("o.b")})
    near = lambda c, t: F.col(c).between(F.col(t) * tile - margin, F.col(t) * tile + tile - 1 + margin)
    x = x.filter(near("row", "tr") & near("col", "tc") & (F.col("tr") >= 0) & (F.col("tc") >= 0))
    kind = dict(level.dtypes)[PAIR]
    schema = f"{PAIR} {kind}, octave int, row double, col double, scale double, angle double, response double, code binary"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tr, tc = key[1].as_py(), key[2].as_py()
        top, left = tr * tile - margin, tc * tile - margin
        image = np.zeros((tile + 2 * margin, tile + 2 * margin))
        image[table["row"].to_numpy() - top, table["col"].to_numpy() - left] = table["v"].to_numpy()
        rows, stack = [], _stack(image)
        for r, c, s, response in extrema(stack):
            if not (margin <= r < margin + tile and margin <= c < margin + tile):
                continue
            sigma = SIGMA * 2 ** (s / SCALES)
            blurred = stack[min(max(round(s), 0), len(stack) - 1)]
            for angle in orientations(blurred, r, c, sigma):
                code = descriptor(blurred, r, c, sigma, angle)
                if code is not None:
                    rows.append((float(r + top), float(c + left), sigma, angle, response, code.tobytes()))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.float64()] * 5 + [pa.binary()]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(rows), key[0].type), pa.array([octave] * len(rows), pa.int32()), *[pa.array(v, k) for v, k in zip(cols, kinds, strict=True)]], [f.split()[0] for f in schema.split(", ")])

    return x.select(PAIR, "tr", "tc", "row", "col", "v").groupBy(PAIR, "tr", "tc").applyInArrow(run, schema)


def points(image: DataFrame, frame: DataFrame, octaves: int = OCTAVES, most: int = MOST, tile: int = TILE) -> DataFrame:
    """Preview structure (slide, row, col, v) to its strongest points: slide, id, x, y (micrometres), scale, angle, response, code."""
    found = None
    for o, (level, f) in enumerate(registration.pyramid(image, frame, ["v"], tuple(2**o for o in range(octaves)))):
        own = octave_points(level, o, tile).join(f.select(PAIR, "sx", "sy", "ox", "oy"), PAIR)
        own = own.select(PAIR, "octave", "row", "col", (F.col("ox") + F.col("col") * F.col("sx")).alias("x"), (F.col("oy") + F.col("row") * F.col("sy")).alias("y"), (F.col("scale") * F.col("sx")).alias("scale"), "angle", "response", "code")
        found = own if found is None else found.unionByName(own)
    rank = F.row_number().over(W.partitionBy(PAIR).orderBy(F.desc("response"), "octave", "row", "col", "angle"))
    return stored(found.withColumn("id", rank).filter(F.col("id") <= most).select(PAIR, "id", "x", "y", "scale", "angle", "response", "code"), "features")


def matches(a: DataFrame, b: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Points of two slides to (slide, id, other, x, y, u, v): each point's nearest code on the other slide, where clearly nearer than the second."""
    packed = b.groupBy(PAIR).agg(F.sort_array(F.collect_list(F.struct("id", "code"))).alias("s")).select(PAIR, F.col("s.id").alias("ids"), F.expr("aggregate(s, cast('' as binary), (z, e) -> concat(z, e.code))").alias("codes"))
    blocks = a.groupBy(PAIR, F.floor(F.col("id") / _BLOCK).alias("block")).agg(F.collect_list(F.struct("id", "code")).alias("own"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                slide, own, ids, codes = (batch.column(k)[i] for k in range(4))
                own = own.as_py()
                x = np.stack([np.frombuffer(o["code"], np.uint8) for o in own]).astype(np.float32)
                y = np.frombuffer(codes.as_py(), np.uint8).reshape(-1, x.shape[1]).astype(np.float32)
                if len(y) < 2:
                    continue
                d = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T
                first = d.argmin(1)
                best = d[np.arange(len(x)), first]
                d[np.arange(len(x)), first] = np.inf
                ok = np.flatnonzero(np.sqrt(np.maximum(best, 0)) < ratio * np.sqrt(np.maximum(d.min(1), 0)))
                ids = ids.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([slide.as_py()] * len(ok), slide.type), pa.array([own[k]["id"] for k in ok], pa.int32()), pa.array([ids[first[k]] for k in ok], pa.int32())], [PAIR, "id", "other"])

    found = blocks.join(packed, PAIR).select(PAIR, "own", "ids", "codes").mapInArrow(run, f"{PAIR} {dict(a.dtypes)[PAIR]}, id int, other int")
    found = found.join(a.select(PAIR, "id", "x", "y"), [PAIR, "id"])
    return found.join(b.select(PAIR, F.col("id").alias("other"), F.col("x").alias("u"), F.col("y").alias("v")), [PAIR, "other"]).select(PAIR, "id", "other", *"xyuv")


def initial_transforms(fixed: DataFrame, fixed_frame: DataFrame, moving: DataFrame, moving_frame: DataFrame, landmarks: DataFrame | None = None, **kw) -> DataFrame:
    """A first transform of every pair: slide, m0 .. m5, method, matches, inliers.

    fixed and moving: structure (slide, row, col, v); landmarks: (slide, x, y, u, v) in micrometres, which take the place of features for
    their slides, within ``LANDMARK_UM``. Feature fits count within three moving pixels. Raises where a pair has too few matches
    or inliers, or its fit mirrors the tissue: such pairs need landmarks.
    """
    slides = fixed_frame.select(PAIR)
    given = None
    if landmarks is not None:
        marks = landmarks.select(PAIR, F.monotonically_increasing_id().alias("id"), *"xyuv")
        fit, seen = registration.consensus(stored(marks, "landmarks"), LANDMARK_UM)
        n = seen.groupBy(PAIR).agg(F.count("*").alias("matches"), F.count_if("inlier").alias("inliers"))
        given = fit.join(n, PAIR).withColumn("method", F.lit("landmarks"))
        slides = slides.join(given, PAIR, "left_anti")
    if slides.isEmpty():
        return given
    own = lambda x: x.join(slides, PAIR, "left_semi")
    a, b = points(own(fixed), own(fixed_frame), **kw), points(own(moving), own(moving_frame), **kw)
    found = stored(matches(a, b), "matches")
    n = slides.join(found.groupBy(PAIR).agg(F.count("*").alias("n")), PAIR, "left")
    if not n.filter(F.coalesce("n", F.lit(0)) < LEAST_MATCHES).isEmpty():
        raise ContractError("too few matching points: give landmarks")
    tolerance = found.join(moving_frame.select(PAIR, (3 * F.greatest("sx", "sy")).alias("tolerance")), PAIR)
    fit, seen = registration.consensus(tolerance, F.col("tolerance"))
    n = seen.groupBy(PAIR).agg(F.count("*").alias("matches"), F.count_if("inlier").alias("inliers"))
    if not n.filter((F.col("inliers") < LEAST_MATCHES) | (F.col("inliers") < LEAST_SHARE * F.col("matches"))).isEmpty():
        raise ContractError("matching points that do not agree: give landmarks")
    fit = fit.join(n, PAIR).withColumn("method", F.lit("features"))
    return fit if given is None else given.unionByName(fit)


def register(fixed: DataFrame, fixed_frame: DataFrame, moving: DataFrame, moving_frame: DataFrame, landmarks: DataFrame | None = None, checks: DataFrame | None = None, iterations: int = 100, **kw) -> DataFrame:
    """Registered pairs from previews (slide, row, col, r, g, b): transforms, how they were found, and their quality.

    checks: landmarks (slide, x, y, u, v) that took no part, whose median and largest error are reported.
    """
    f, g = stored(registration.structures(fixed), "structure"), stored(registration.structures(moving), "structure")
    first = stored(initial_transforms(f.select(PAIR, "row", "col", "v"), fixed_frame, g.select(PAIR, "row", "col", "v"), moving_frame, landmarks, **kw), "initial")
    fit = registration.refine(f.select(PAIR, "row", "col", "v"), fixed_frame, g.select(PAIR, "row", "col", "v"), moving_frame, first.select(PAIR, *registration.M), iterations)
    quality = registration.tissue_overlap(fixed, fixed_frame, moving, moving_frame, fit)
    out = fit.join(first.select(PAIR, "method", "matches", "inliers"), PAIR).join(quality, PAIR)
    if checks is None:
        return out
    e = checks.join(fit.select(PAIR, *registration.M), PAIR).withColumn("e", registration.residual())
    e = e.groupBy(PAIR).agg(F.percentile("e", F.lit(0.5)).alias("qc_landmark_median_um"), F.max("e").alias("qc_landmark_max_um"))
    return out.join(e, PAIR, "left")
