"""Registration of slide pairs: previews with physical spacing, consensus fits, and affine refinement by mutual information.

A preview is a table of pixels (slide, row, col, v) with a frame a slide (spacing and origin in micrometres). All pairs are refined
at once: their transforms are a few numbers a pair, kept by the driver, and every evaluation is an aggregation over the samples
of all pairs. The objective is the mutual information of a joint histogram of fixed and warped moving values; its gradient is a
second aggregation, which weighs each sample's moving slope by the histogram's log ratios; a line search evaluates several step
lengths in one pass. Levels run from coarse to fine.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.functions import expressions as X
from lamella.operators import masks
from lamella.operators.relational import ContractError
from lamella.storage import discard, stored

PAIR = "slide"
M = [f"m{i}" for i in range(6)]
#: Histogram bins, share of sampled pixels, shrink factors, window and least change of convergence.
BINS, SAMPLED, SHRINK, WINDOW, LEAST_CHANGE = 50, 0.25, (4, 2, 1), 10, 1e-5
STEPS, SINGLE = (4.0, 2.0, 1.0, 0.5, 0.25, 0.1), (1.0, 0.3)
LEAST_OVERLAP = 1 / 16


# --- previews and pyramids -------------------------------------------------------------------------------------------------


def preview(pixels: DataFrame, slides: DataFrame, size: int, channels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pixels (slide, row, col, channels) of slides (slide, width, height, mpp_x, mpp_y) as area means on a grid of at most size by size.

    Returns the preview and its frames (slide, rows, cols, sx, sy, ox, oy): spacing, and the place of the first pixel's centre, a
    pixel of the slide being centred on its index times the scale.
    """
    shrink = F.greatest(F.lit(1.0), F.greatest("width", "height") / size)
    f = slides.select(PAIR, "width", "height", "mpp_x", "mpp_y", F.greatest(F.lit(1), F.rint(F.col("width") / shrink)).cast("long").alias("cols"), F.greatest(F.lit(1), F.rint(F.col("height") / shrink)).cast("long").alias("rows"))
    f = f.withColumns({"sx": F.col("width") / F.col("cols") * F.col("mpp_x"), "sy": F.col("height") / F.col("rows") * F.col("mpp_y")})
    f = f.withColumns({"ox": (F.col("sx") - F.col("mpp_x")) / 2, "oy": (F.col("sy") - F.col("mpp_y")) / 2})
    x = pixels.join(f.select(PAIR, "width", "height", "rows", "cols"), PAIR)
    x = x.groupBy(PAIR, F.expr("row * rows div height").alias("row"), F.expr("col * cols div width").alias("col")).agg(*[F.avg(c).alias(c) for c in channels])
    return x, f.select(PAIR, "rows", "cols", "sx", "sy", "ox", "oy")


def pyramid(pixels: DataFrame, frames: DataFrame, channels: list[str], factors: tuple[int, ...]) -> list[tuple[DataFrame, DataFrame]]:
    """(pixels, frames) a factor: area means of so many pixels each way, with the physical frame carried along.

    Each level is made from the last finer one whose factor divides its own, sums and counts being carried, so that blocks cut by the
    edge are means of the pixels that they hold. The last block's spacing is that of all.
    """
    done: list[tuple[int, DataFrame]] = [(1, pixels.select(PAIR, "row", "col", *channels, F.lit(1).cast("long").alias("n")))]
    out = {}
    for k in sorted(factors):
        base, source = next((b, d) for b, d in reversed(done) if k % b == 0)
        step = k // base
        sums = [(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in channels]
        level = source if step == 1 else source.groupBy(PAIR, F.floor(F.col("row") / step).alias("row"), F.floor(F.col("col") / step).alias("col")).agg(*sums, F.sum("n").alias("n"))
        done.append((k, level))
        f = frames.withColumns({"rows": F.ceil(F.col("rows") / k), "cols": F.ceil(F.col("cols") / k), "ox": F.col("ox") + F.col("sx") * (k - 1) / 2, "oy": F.col("oy") + F.col("sy") * (k - 1) / 2, "sx": F.col("sx") * k, "sy": F.col("sy") * k})
        out[k] = (level.select(PAIR, "row", "col", *channels, "n"), f)
    return [out[k] for k in factors]


def level_for(frames: list[DataFrame], mpp: float) -> DataFrame:
    """(slide, level): of a pyramid's frames, the coarsest that is no coarser than the scale; the finest where all are."""
    all_ = None
    for i, f in enumerate(frames):
        own = f.select(PAIR, F.lit(i).alias("level"), F.greatest("sx", "sy").alias("s"))
        all_ = own if all_ is None else all_.unionByName(own)
    fit = F.when(F.col("s") <= mpp, F.col("s"))
    return all_.groupBy(PAIR).agg(F.coalesce(F.max_by("level", fit), F.min_by("level", "s")).alias("level"))


def structures(previews: DataFrame) -> DataFrame:
    """Previews' (slide, row, col, r, g, b) to (slide, row, col, v, tissue), v the stain structure 0 to 1; raises where a slide has none."""
    x = masks.structure(previews, [PAIR])
    if not x.groupBy(PAIR).agg(F.count("structure").alias("n")).filter("n = 0").isEmpty():
        raise ContractError("no usable stain structure in a slide's preview")
    return x.select(PAIR, "row", "col", F.col("structure").alias("v"), X.is_tissue(F.col("r"), F.col("g"), F.col("b")).alias("tissue"))


# --- consensus -------------------------------------------------------------------------------------------------------------


def _solved(p: list[str], q: list[str]) -> list[Column]:
    """The affine transform that takes three points (x and y columns by number) to three others, by Cramer's rule; null on one line."""
    x, y = [F.col(f"{a}x") for a in p], [F.col(f"{a}y") for a in p]
    det = x[0] * (y[1] - y[2]) + x[1] * (y[2] - y[0]) + x[2] * (y[0] - y[1])
    span = F.greatest(*[F.abs(v) for v in (x[1] - x[0], x[2] - x[0], y[1] - y[0], y[2] - y[0])])
    d = F.when(F.abs(det) > 1e-9 * span * span, det)
    out = []
    for axis in "xy":
        u = [F.col(f"{a}{axis}") for a in q]
        out += [(u[0] * (y[1] - y[2]) + u[1] * (y[2] - y[0]) + u[2] * (y[0] - y[1])) / d, (u[0] * (x[2] - x[1]) + u[1] * (x[0] - x[2]) + u[2] * (x[1] - x[0])) / d]
        out.append((u[0] * (x[1] * y[2] - x[2] * y[1]) + u[1] * (x[2] * y[0] - x[0] * y[2]) + u[2] * (x[0] * y[1] - x[1] * y[0])) / d)
    return out


def residual(m: list[Column] | None = None) -> Column:
    """Distance of a mapped point (x, y) from its partner (u, v)."""
    m = m or [F.col(c) for c in M]
    return F.hypot(m[0] * F.col("x") + m[1] * F.col("y") + m[2] - F.col("u"), m[3] * F.col("x") + m[4] * F.col("y") + m[5] - F.col("v"))


def least_squares(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, y, u, v) to by, m0 .. m5, n: the affine transform of least squared residuals, from centred moments; null on one line."""
    mid = points.groupBy(*by).agg(*[F.avg(c).alias(f"__{c}") for c in "xyuv"], F.count("*").alias("n"))
    d = points.join(mid, by)
    c = {k: F.col(k) - F.col(f"__{k}") for k in "xyuv"}
    s = d.groupBy(*by, *[f"__{k}" for k in "xyuv"], "n").agg(*[F.sum(c[a] * c[b]).alias(f"s{a}{b}") for a, b in ("xx", "xy", "yy", "xu", "yu", "xv", "yv")])
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    det = F.when(det > 1e-12 * F.pow(F.col("sxx") + F.col("syy"), 2), det)
    out = {}
    for i, t in ((0, "u"), (3, "v")):
        out[M[i]] = (F.col(f"sx{t}") * F.col("syy") - F.col(f"sy{t}") * F.col("sxy")) / det
        out[M[i + 1]] = (F.col(f"sy{t}") * F.col("sxx") - F.col(f"sx{t}") * F.col("sxy")) / det
    s = s.withColumns(out)
    for i, t in ((0, "u"), (3, "v")):
        s = s.withColumn(M[i + 2], F.col(f"__{t}") - F.col(M[i]) * F.col("__x") - F.col(M[i + 1]) * F.col("__y"))
    return s.select(*by, *M, "n")


def consensus(points: DataFrame, tolerance: Column | float, hypotheses: int = 500, refits: int = 20, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Matched points (slide, id, x, y, u, v) to one affine transform a slide, and the points with inlier.

    Hypothesis k of a slide is the transform through three of its points, picked by a hash of (seed, k); all are scored at
    once by counting the points within the tolerance, ties to the smallest residual sum, then number. The best is refitted by
    least squares on its inliers until they stay the same. Raises where a slide has no three points off one line, or the fit
    mirrors the tissue. Points with an unknown coordinate raise, too.
    """
    tol = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    p = points.select(PAIR, "id", *[X.finite(F.col(c).cast("double")).alias(c) for c in "xyuv"], tol.alias("tol"))
    if not p.filter(" OR ".join(f"{c} IS NULL" for c in "xyuv")).isEmpty():
        raise ContractError("a landmark coordinate that is not finite")
    p = stored(p.withColumn("at", F.row_number().over(W.partitionBy(PAIR).orderBy("id", "x", "y", "u", "v")) - 1), "points")
    n = p.groupBy(PAIR).agg(F.count("*").alias("n"))
    picks = n.filter("n >= 3").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(hypotheses - 1))))
    draw = lambda i, left: F.pmod(F.xxhash64(F.lit(seed), PAIR, F.col("k"), F.lit(i)), F.col("n") - left)
    picks = picks.select(PAIR, "k", draw(0, 0).alias("i0"), draw(1, 1).alias("j"), draw(2, 2).alias("l"))
    picks = picks.withColumn("i1", F.col("j") + (F.col("j") >= F.col("i0")).cast("int"))
    low, high = F.least("i0", "i1"), F.greatest("i0", "i1")
    third = F.col("l") + (F.col("l") >= low).cast("int")
    picks = picks.select(PAIR, "k", "i0", "i1", (third + (third >= high).cast("int")).alias("i2"))
    for i in range(3):
        own = p.select(PAIR, F.col("at").alias(f"i{i}"), F.col("x").alias(f"p{i}x"), F.col("y").alias(f"p{i}y"), F.col("u").alias(f"q{i}x"), F.col("v").alias(f"q{i}y"))
        picks = picks.join(own, [PAIR, f"i{i}"])
    m = _solved(["p0", "p1", "p2"], ["q0", "q1", "q2"])
    h = picks.select(PAIR, "k", *[c.alias(n) for n, c in zip(M, m, strict=True)]).filter("m0 IS NOT NULL")
    e = residual()
    scored = p.join(h, PAIR).groupBy(PAIR, "k", *M).agg(F.count_if(e <= F.col("tol")).alias("hits"), F.sum(F.when(e <= F.col("tol"), e)).alias("sum"))
    best = scored.groupBy(PAIR).agg(F.max_by(F.struct(*M), F.struct("hits", -F.coalesce("sum", F.lit(0.0)), -F.col("k"))).alias("best")).select(PAIR, "best.*")
    fit, count = stored(best, "fit"), None
    for _ in range(refits):
        inside = p.join(fit, PAIR).withColumn("inlier", residual() <= F.col("tol"))
        now = {r[PAIR]: r["s"] for r in inside.groupBy(PAIR).agg(F.sum(F.when(F.col("inlier"), F.xxhash64("at").cast("decimal(38,0)"))).alias("s")).collect()}  # one row a pair
        if now == count:
            break
        count = now
        again = least_squares(inside.filter("inlier").select(PAIR, *"xyuv"), [PAIR]).filter("n >= 3 AND m0 IS NOT NULL").drop("n")
        kept = fit.select(PAIR, *[F.col(c).alias(f"__{c}") for c in M]).join(again, PAIR, "left")
        fit = stored(kept.select(PAIR, *[F.coalesce(c, f"__{c}").alias(c) for c in M]), "fit")
    if not n.join(fit, PAIR, "left_anti").isEmpty():
        raise ContractError("needs three matching points that are not on one line")
    if not fit.filter(F.col("m0") * F.col("m4") - F.col("m1") * F.col("m3") <= 0).isEmpty():
        raise ContractError("the fit mirrors the tissue: check the slides' orientation and the points")
    return fit, p.join(fit, PAIR).select(PAIR, "id", *"xyuv", residual().alias("residual"), (residual() <= F.col("tol")).alias("inlier"))


# --- mutual information ----------------------------------------------------------------------------------------------------


def quads(moving: DataFrame) -> DataFrame:
    """Each pixel (slide, row, col, v) with the three to its right and below: what bilinear values and slopes need; edges are left out."""
    right = moving.withColumn("v01", F.lead("v").over(W.partitionBy(PAIR, "row").orderBy("col"))).withColumn("next", F.lead("col").over(W.partitionBy(PAIR, "row").orderBy("col")))
    right = right.filter("next = col + 1").select(PAIR, "row", "col", F.col("v").alias("v00"), "v01")
    below = right.select(PAIR, (F.col("row") - 1).alias("row"), "col", F.col("v00").alias("v10"), F.col("v01").alias("v11"))
    return right.join(below, [PAIR, "row", "col"])


def bin_range(values: DataFrame, bins: int = BINS) -> DataFrame:
    """(slide, low, step): a histogram's first bin and bin width, two bins being kept free at each end for the soft bins' reach."""
    x = values.groupBy(PAIR).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    step = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / (bins - 4)).otherwise(1.0)
    return x.select(PAIR, (F.col("lo") - 2 * step).alias("low"), step.alias("step"))


def spline(u: Column) -> Column:
    """Cubic B-spline."""
    a = F.abs(u)
    return F.when(a < 1, 2 / 3 - a * a + a * a * a / 2).when(a < 2, F.pow(2 - a, 3) / 6).otherwise(0.0)


def spline_slope(u: Column) -> Column:
    a, s = F.abs(u), F.signum(u)
    return F.when(a < 1, s * (1.5 * a * a - 2 * a)).when(a < 2, -s * F.pow(2 - a, 2) / 2).otherwise(0.0)


def warped(samples: DataFrame, quad: DataFrame, frame: DataFrame, transforms: DataFrame) -> DataFrame:
    """Samples (slide, x, y, fbin) under each transform (slide, k, m0 .. m5): k, fbin, mv and its slopes gx and gy a micrometre.

    Samples that fall outside the moving image are left out.
    """
    z = samples.join(transforms, PAIR).join(frame.select(PAIR, *[F.col(c).alias(f"__{c}") for c in ("sx", "sy", "ox", "oy")]), PAIR)
    u, v = F.col("m0") * F.col("x") + F.col("m1") * F.col("y") + F.col("m2"), F.col("m3") * F.col("x") + F.col("m4") * F.col("y") + F.col("m5")
    z = z.withColumns({"__px": (u - F.col("__ox")) / F.col("__sx"), "__py": (v - F.col("__oy")) / F.col("__sy")})
    z = z.withColumns({"row": F.floor("__py"), "col": F.floor("__px")}).withColumns({"__fx": F.col("__px") - F.col("col"), "__fy": F.col("__py") - F.col("row")})
    z = z.join(quad, [PAIR, "row", "col"])
    fx, fy = F.col("__fx"), F.col("__fy")
    top, low = (1 - fx) * F.col("v00") + fx * F.col("v01"), (1 - fx) * F.col("v10") + fx * F.col("v11")
    gx = ((1 - fy) * (F.col("v01") - F.col("v00")) + fy * (F.col("v11") - F.col("v10"))) / F.col("__sx")
    return z.select(PAIR, "k", "x", "y", "fbin", ((1 - fy) * top + fy * low).alias("mv"), gx.alias("gx"), ((low - top) / F.col("__sy")).alias("gy"))


def joint_histogram(at: DataFrame, moving_bins: DataFrame, bins: int = BINS) -> DataFrame:
    """(slide, k, fbin, mbin, w): fixed values in whole bins, moving ones spread over four by a cubic B-spline; the weights of a sample sum to 1."""
    term = (F.col("mv") - F.col("low")) / F.col("step")
    z = at.join(moving_bins, PAIR).select(PAIR, "k", "fbin", term.alias("t")).withColumn("b", F.explode(F.array(*[F.floor("t") + d for d in (-1, 0, 1, 2)])))
    mbin = F.least(F.greatest(F.col("b"), F.lit(0)), F.lit(bins - 1))
    return z.groupBy(PAIR, "k", "fbin", mbin.cast("int").alias("mbin")).agg(F.sum(spline(F.col("b") - F.col("t"))).alias("w"))


def information(joint: DataFrame) -> DataFrame:
    """Joint histograms (slide, k, fbin, mbin, w) to slide, k, information, n: the mutual information and the samples in it."""
    over = lambda *by: F.sum("w").over(W.partitionBy(PAIR, "k", *by))
    z = joint.filter("w > 0").select(PAIR, "k", "w", over().alias("n"), over("fbin").alias("f"), over("mbin").alias("m"))
    return z.groupBy(PAIR, "k").agg(F.sum(F.col("w") / F.col("n") * F.log(F.col("w") * F.col("n") / (F.col("f") * F.col("m")))).alias("information"), F.max("n").alias("n"))


def log_ratios(joint: DataFrame) -> DataFrame:
    """Joint histograms to slide, k, fbin, mbin, ratio: log(p(f, m) / p(m))."""
    m = F.sum("w").over(W.partitionBy(PAIR, "k", "mbin"))
    return joint.filter("w > 0").select(PAIR, "k", "fbin", "mbin", F.log(F.col("w") / m).alias("ratio"))


def refine(fixed: DataFrame, fixed_frame: DataFrame, moving: DataFrame, moving_frame: DataFrame, initial: DataFrame, iterations: int = 100, shrink: tuple[int, ...] = SHRINK, sampled: float = SAMPLED, bins: int = BINS, seed: int = 42) -> DataFrame:
    """Affine transforms (slide, m0 .. m5) of all pairs moved uphill in mutual information: slide, m0 .. m5, affine_metric (negative
    information), evaluations, affine_stop.

    fixed and moving: (slide, row, col, v); frames as ``preview`` gives them. Samples are a repeatable share of each level's pixels.
    Parameters are displacements in micrometres at the fixed image's rim, so that all move the tissue alike. Step lengths are
    fractions of the level's pixel, uphill first; where every step uphill loses, as a histogram of few samples is not smooth, each parameter is
    tried by itself both ways, and where that loses, too, steps become shorter. A pair ends when a step is under a fiftieth of a pixel or
    the information changes by less than ``LEAST_CHANGE`` over ``WINDOW`` iterations.
    """
    spark = fixed.sparkSession
    state = {r[PAIR]: {"m": np.array([r[c] for c in M], float), "n": 0, "value": None, "stop": "iterations"} for r in initial.collect()}  # one row a pair
    geometry = {r[PAIR]: r.asDict() for r in fixed_frame.collect()}
    schema = f"{PAIR} {dict(initial.dtypes)[PAIR]}, k int, " + ", ".join(f"{c} double" for c in M)
    for (f, ff), (g, gf) in zip(pyramid(fixed, fixed_frame, ["v"], shrink), pyramid(moving, moving_frame, ["v"], shrink), strict=True):
        quad, g_bins = stored(quads(g.drop("n")), "quads"), stored(bin_range(g, bins), "bins")
        # the finest level's share; a coarser one has fewer pixels and takes more of them
        part = F.pmod(F.xxhash64(F.lit(seed), PAIR, "row", "col"), F.lit(1 << 20)) < int(min(1.0, sampled) * (1 << 20))
        s = f.filter(part).join(ff.select(PAIR, "sx", "sy", "ox", "oy"), PAIR).join(bin_range(f, bins), PAIR)
        fbin = F.least(F.greatest(F.floor((F.col("v") - F.col("low")) / F.col("step")), F.lit(2)), F.lit(bins - 3)).cast("int")
        samples = stored(s.select(PAIR, (F.col("ox") + F.col("col") * F.col("sx")).alias("x"), (F.col("oy") + F.col("row") * F.col("sy")).alias("y"), fbin.alias("fbin")), "samples")
        total = {r[PAIR]: r["count"] for r in samples.groupBy(PAIR).count().collect()}
        pixel = {r[PAIR]: max(r["sx"], r["sy"]) for r in ff.collect()}

        def transforms(asked: list[tuple]) -> DataFrame:
            return spark.createDataFrame([(p, k, *map(float, m)) for p, k, m in asked], schema)

        def evaluate(asked: list[tuple], quad=quad, gf=gf, samples=samples, g_bins=g_bins, total=total) -> dict[tuple, float]:
            """Information of transforms (slide, k, m), one aggregation for all; those with too little overlap are left out."""
            found = information(joint_histogram(warped(samples, quad, gf, transforms(asked)), g_bins, bins)).collect()  # a row a transform
            return {(r[PAIR], r["k"]): r["information"] for r in found if r["n"] >= LEAST_OVERLAP * total[r[PAIR]]}

        def slopes(at: dict, quad=quad, gf=gf, samples=samples, g_bins=g_bins) -> dict[object, np.ndarray]:
            """Gradient of the information in the six parameters of each pair at its transform: a histogram, then a pass that weighs each sample by it."""
            if not at:
                return {}
            w = warped(samples, quad, gf, transforms([(p, 0, a["m"]) for p, a in at.items()]))
            ratio = log_ratios(joint_histogram(w, g_bins, bins)).drop("k")
            mid = spark.createDataFrame([(p, *map(float, a["mid"]), float(a["rim"])) for p, a in at.items()], f"{schema.split(',')[0]}, mx double, my double, rim double")
            w = w.join(mid, PAIR).join(g_bins, PAIR).withColumn("t", (F.col("mv") - F.col("low")) / F.col("step"))
            w = w.withColumn("b", F.explode(F.array(*[F.floor("t") + d for d in (-1, 0, 1, 2)]))).withColumn("mbin", F.least(F.greatest(F.col("b"), F.lit(0)), F.lit(bins - 1)).cast("int"))
            pull = -spline_slope(F.col("b") - F.col("t")) * F.col("ratio") / F.col("step")
            u, v = (F.col("x") - F.col("mx")) / F.col("rim"), (F.col("y") - F.col("my")) / F.col("rim")
            parts = [pull * c * g for g in (F.col("gx"), F.col("gy")) for c in (u, v, F.lit(1.0))]
            s = w.join(ratio, [PAIR, "fbin", "mbin"]).groupBy(PAIR).agg(*[F.sum(c).alias(f"g{i}") for i, c in enumerate(parts)])
            return {r[PAIR]: np.array([r[f"g{i}"] for i in range(6)]) for r in s.collect()}

        active = {}
        for p, value in evaluate([(p, 0, st["m"]) for p, st in state.items()]).items():
            q = geometry[p[0]]
            w, h = q["cols"] * q["sx"], q["rows"] * q["sy"]
            active[p[0]] = {"m": state[p[0]]["m"], "value": value, "mid": (q["ox"] + (w - q["sx"]) / 2, q["oy"] + (h - q["sy"]) / 2), "rim": max(w, h) / 2, "scale": 1.0, "uphill": True, "history": [value]}
        for p in set(state) - set(active):
            state[p]["stop"] = "no overlap"
        running = dict(active)
        for _ in range(iterations):
            if not running:
                break
            grads, asked = slopes({p: a for p, a in running.items() if a["uphill"]}), []
            for p, a in running.items():
                g = grads.get(p, np.zeros(6))
                size = float(np.linalg.norm(g))
                ways = [g / size * s for s in STEPS] if a["uphill"] and size > 0 else [sign * s * e for e in np.eye(6) for sign in (1, -1) for s in SINGLE]
                a["tried"] = [moved(a, w * a["scale"] * pixel[p]) for w in ways]
                asked += [(p, k, m) for k, m in enumerate(a["tried"])]
            found = evaluate(asked)
            for p, a in list(running.items()):
                state[p]["n"] += len(a["tried"])
                best = max(((found[p, k], k) for k in range(len(a["tried"])) if (p, k) in found), default=(-math.inf, 0))
                if best[0] > a["value"]:
                    k = best[1]
                    a["m"], a["value"] = a["tried"][k], found[p, k]
                    a["scale"] = min(1.0, a["scale"] * (2.0 if a["uphill"] and k == 0 else 1.0))
                    a["uphill"] = True
                elif a["uphill"]:
                    a["uphill"] = False
                else:
                    a["uphill"], a["scale"] = True, a["scale"] / 4
                a["history"].append(a["value"])
                old = a["history"][-WINDOW - 1] if len(a["history"]) > WINDOW else None
                if STEPS[0] * a["scale"] < 0.02 or (old is not None and a["value"] - old < LEAST_CHANGE):
                    state[p]["stop"] = "converged"
                    del running[p]
        for p in running:
            state[p]["stop"] = "iterations"
        for p, a in active.items():
            state[p]["m"], state[p]["value"] = a["m"], a["value"]
        for df in (quad, g_bins, samples):
            discard(df)
    rows = [(p, *map(float, s["m"]), None if s["value"] is None else -s["value"], s["n"], s["stop"]) for p, s in state.items()]
    return spark.createDataFrame(rows, f"{PAIR} {dict(initial.dtypes)[PAIR]}, " + ", ".join(f"{c} double" for c in M) + ", affine_metric double, evaluations int, affine_stop string")


def moved(a: dict, step: np.ndarray) -> np.ndarray:
    """A transform with displacements at the fixed image's rim added."""
    m, (cx, cy), rim = a["m"].copy(), a["mid"], a["rim"]
    for row in (0, 3):
        sx, sy, t = step[row] / rim, step[row + 1] / rim, step[row + 2]
        m[row] += sx
        m[row + 1] += sy
        m[row + 2] += t - sx * cx - sy * cy
    return m


# --- checks of a registration ----------------------------------------------------------------------------------------------


def tissue_overlap(fixed: DataFrame, fixed_frame: DataFrame, moving: DataFrame, moving_frame: DataFrame, transforms: DataFrame) -> DataFrame:
    """(slide, tissue_dice, nonpositive_jacobian_fraction) of registered previews (slide, row, col, r, g, b): the warped moving preview, white
    outside, has tissue where its bilinear colour has."""
    tissue = X.is_tissue(F.col("r"), F.col("g"), F.col("b"))
    at = fixed.join(fixed_frame.select(PAIR, "sx", "sy", "ox", "oy"), PAIR).join(transforms.select(PAIR, *M), PAIR)
    x, y = F.col("ox") + F.col("col") * F.col("sx"), F.col("oy") + F.col("row") * F.col("sy")
    f = moving_frame.select(PAIR, *[F.col(c).alias(f"__{c}") for c in ("sx", "sy", "ox", "oy")])
    z = at.select(PAIR, F.col("row").alias("own_row"), F.col("col").alias("own_col"), tissue.alias("own"), (F.col("m0") * x + F.col("m1") * y + F.col("m2")).alias("u"), (F.col("m3") * x + F.col("m4") * y + F.col("m5")).alias("v")).join(f, PAIR)
    z = z.withColumns({"px": (F.col("u") - F.col("__ox")) / F.col("__sx"), "py": (F.col("v") - F.col("__oy")) / F.col("__sy")})
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    near = z.select(PAIR, "own_row", "own_col", "px", "py", corner.alias("o")).withColumns({"row": F.floor("py") + F.col("o.b"), "col": F.floor("px") + F.col("o.a")})
    near = near.withColumn("w", (1 - F.abs(F.col("px") - F.col("col"))) * (1 - F.abs(F.col("py") - F.col("row")))).filter("w > 0")
    got = near.join(moving.select(PAIR, "row", "col", *"rgb"), [PAIR, "row", "col"]).groupBy(PAIR, "own_row", "own_col").agg(F.sum("w").alias("w"), *[F.sum(F.col(c) * F.col("w")).alias(c) for c in "rgb"])
    got = got.filter("w > 1 - 1e-9").select(PAIR, "own_row", "own_col", X.is_tissue(*[F.floor(F.col(c)) for c in "rgb"]).alias("other"))
    both = z.select(PAIR, "own_row", "own_col", "own").join(got, [PAIR, "own_row", "own_col"], "left").withColumn("other", F.coalesce("other", F.lit(False)))
    n = both.groupBy(PAIR).agg(F.count_if(F.col("own") & F.col("other")).alias("b"), F.count_if("own").alias("f"), F.count_if("other").alias("m"))
    fold = transforms.select(PAIR, (F.col("m0") * F.col("m4") - F.col("m1") * F.col("m3") <= 0).alias("folds"))
    n = n.join(fold, PAIR)
    share = F.when(F.col("f") == 0, 1.0).when(F.col("folds"), 1.0).otherwise(0.0)
    return n.select(PAIR, (2 * F.col("b") / F.greatest(F.lit(1), F.col("f") + F.col("m"))).alias("tissue_dice"), share.alias("nonpositive_jacobian_fraction"))
