"""Measurements of single cells from pixel rows: morphology, stain intensity, texture.

Pixels have the region's keys, row, col, label (0: background) and r, g, b. A cell's crop is its box; all
families work on crops, joined from the pixel table by position, so that a region spreads over its cells.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions import expressions as X
from lamella.functions.statistics import EPS, nine_numbers
from lamella.operators import geometry, raster

LEVELS, RING_UM, MPP = 32, 2.0, 0.2215
LEAST_TEXTURE, LEAST_BLOCKS = 8, 16
SHAPES = ["perimeter_px", "convex_hull_area_px", "solidity", "convexity", "concavity_count", "concavity_depth_mean_px", "fractal_dimension_boundary"]


def stained(pixels: DataFrame) -> DataFrame:
    """Adds hematoxylin, eosin and residual."""
    h, e, r = X.stain_amounts(F.col("r"), F.col("g"), F.col("b"))
    return pixels.withColumns({"hematoxylin": h, "eosin": e, "residual": r})


def crops(pixels: DataFrame, by: list[str], value: str) -> DataFrame:
    """Each cell's box: by, label, row and col from the box's corner, inside (the pixel is the cell's), and the value."""
    box = pixels.filter("label > 0").groupBy(*by, "label").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    box = box.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    there = pixels.select(*by, "row", "col", F.col("label").alias("__own"), F.col(value).alias("value"))
    x = box.join(there, [*by, "row", "col"])
    return x.select(*by, "label", (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), (F.col("__own") == F.col("label")).alias("inside"), "value")


# --- morphology ----------------------------------------------------------------------------------------------------------


def perimeter(mask: np.ndarray) -> float:
    """Boundary length by the weights of straight, diagonal and mixed steps between the pixels with a 4-neighbour outside; where that is 0,
    with an 8-neighbour outside."""
    return _weighted(geometry.boundary(mask)) or _weighted(mask & ~_inner8(mask))


def _inner8(mask: np.ndarray) -> np.ndarray:
    pad = np.pad(mask, 1)
    h, w = mask.shape
    return np.all([pad[a : a + h, b : b + w] for a in range(3) for b in range(3)], axis=0)


def _weighted(boundary: np.ndarray) -> float:
    edge = np.pad(boundary, 1).astype(int)
    near = edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:]
    far = edge[:-2, :-2] + edge[:-2, 2:] + edge[2:, :-2] + edge[2:, 2:]
    code = np.where(edge[1:-1, 1:-1] > 0, 1 + 2 * near + 10 * far, 0)
    straight, diagonal, mixed = np.isin(code, (5, 7, 15, 17, 25, 27)).sum(), np.isin(code, (21, 33)).sum(), np.isin(code, (13, 23)).sum()
    return float(straight + diagonal * math.sqrt(2) + mixed * (1 + math.sqrt(2)) / 2)


def box_dimension(edge: np.ndarray) -> float:
    """Slope of log box count on log inverse size, over powers of two up to half the shorter side; NaN for fewer than two or a side under 8."""
    side = min(edge.shape)
    sizes = [1 << k for k in range(1, side.bit_length()) if 1 << k <= side // 2] if side >= 8 else []
    r, c = np.nonzero(edge)
    counts = [len({(a // s, b // s) for a, b in zip(r.tolist(), c.tolist(), strict=True)}) for s in sizes]
    if len(sizes) < 2 or not len(r):
        return math.nan
    return float(np.polyfit(np.log(1 / np.array(sizes)), np.log(counts), 1)[0])


def _image(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    shape = (int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1)
    values, mask = np.zeros(shape), np.zeros(shape, bool)
    r, c = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
    values[r, c], mask[r, c] = pdf["value"].to_numpy(float), pdf["inside"].to_numpy(bool)
    return values, mask


def shape_numbers(mask: np.ndarray, harmonics: int) -> list[float]:
    """A cell's outline measurements in the order of ``SHAPES``, then Fourier amplitudes."""
    xy, p = geometry.longest_contour(mask), perimeter(mask)
    area, hull_area = float(mask.sum()), geometry.hull_pixels(mask)
    count, depth, convexity = geometry.concavity(mask, p, xy)
    return [p, hull_area, area / hull_area if hull_area else math.nan, convexity, count, depth, box_dimension(geometry.boundary(mask)), *geometry.fourier_amplitudes(xy, harmonics)]


def _per_cell(x: DataFrame, by: list[str], names: list[str], measure) -> DataFrame:
    """One cell's crop a group, and a row of doubles each."""
    kinds = {f.name: f.dataType.simpleString() for f in x.schema}
    keys = [*by, "label"]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        row = [None if v is None or not np.isfinite(v) else float(v) for v in measure(*_image(pdf))]
        return pd.DataFrame([[*key, *row]], columns=[*keys, *names]).astype({n: float for n in names})

    return x.groupBy(*keys).applyInPandas(run, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{n}` double" for n in names]))


def morphology(pixels: DataFrame, by: list[str], mpp: float, harmonics: int = 10) -> DataFrame:
    """Area, moments, outline, hull, concavities, boundary dimension and Fourier amplitudes of each cell, in px and um."""
    names = [*SHAPES, *[f"fourier_h{i}_amp" for i in range(1, harmonics + 1)]]
    own = pixels.filter("label > 0")
    moments = raster.region_properties(own, [*by, "label"])
    shapes = _per_cell(crops(pixels.withColumn("__one", F.lit(1.0)), by, "__one"), by, names, lambda _, mask: shape_numbers(mask, harmonics))
    x = moments.join(shapes, [*by, "label"])
    a, p = F.col("area_px"), F.col("perimeter_px")
    x = x.withColumns({"circularity": 4 * math.pi * a / (p * p + EPS), "perimeter_area_ratio": p / (a + EPS), "nuclear_membrane_irregularity_index": F.when(X.finite(F.col("convexity")) > 0, 1 / (F.col("convexity") + EPS))})
    lengths = ("perimeter", "equivalent_diameter", "major_axis_length", "minor_axis_length", "concavity_depth_mean")
    return x.withColumns({**{f"{n}_um": F.col(f"{n}_px") * mpp for n in lengths}, **{f"{n}_um2": F.col(f"{n}_px") * mpp**2 for n in ("area", "convex_hull_area")}})


# --- intensity -----------------------------------------------------------------------------------------------------------


def ring_width(mpp: float, um: float = RING_UM) -> int:
    """Pixels of the ring round a nucleus at a scale, half to even, one at least."""
    return max(1, round(um / mpp))


def intensity(pixels: DataFrame, by: list[str], ring: int = ring_width(MPP)) -> DataFrame:
    """Nine numbers of each stain in the nucleus and of two in the ring round it; their ratios, densities and contrasts.

    The ring lies within ``ring`` pixels of the nucleus and inside its box, outside all nuclei.
    """
    keys, x = [*by, "label"], stained(pixels)
    nucleus = x.filter("label > 0").groupBy(*keys).agg(F.count("*").cast("double").alias("__area"), *[c for s in ("hematoxylin", "eosin", "residual") for c in nine_numbers(s, s)])
    around = raster.ring_pixels(pixels, by, ring).join(x.select(*by, "row", "col", "hematoxylin", "eosin"), [*by, "row", "col"])
    around = around.groupBy(*keys).agg(F.count("*").cast("double").alias("__ring"), *[c for s in ("hematoxylin", "eosin") for c in nine_numbers(f"cytoplasm_ring_{s}", s)])
    out = nucleus.join(around, keys, "left")
    h, e = F.col("hematoxylin_mean"), F.col("eosin_mean")
    size: Column = F.coalesce("__ring", F.lit(0.0))
    return out.withColumns({
        "he_ratio_mean": h / (e + EPS),
        "integrated_nuclear_density_h": h * F.col("__area"),
        "integrated_nuclear_density_e": e * F.col("__area"),
        "nuclear_cytoplasm_h_contrast": h - F.col("cytoplasm_ring_hematoxylin_mean"),
        "nuclear_cytoplasm_e_contrast": e - F.col("cytoplasm_ring_eosin_mean"),
        "cytoplasm_ring_area_px": size,
        "nc_area_ratio_proxy": F.when(size > 0, F.col("__area") / (size + EPS)),
    }).drop("__area", "__ring")


# --- texture -------------------------------------------------------------------------------------------------------------


def _limits(x: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Cells of at least so many pixels: their outer percentiles and median."""
    v = F.when(F.col("inside"), F.col("value"))
    q = x.groupBy(*keys).agg(F.count(v).alias("__n"), F.percentile(v, F.array(F.lit(0.01), F.lit(0.99), F.lit(0.5))).alias("__q"))
    lo = F.col("__q")[0]
    hi = F.when(F.col("__q")[1] <= lo, lo + EPS).otherwise(F.col("__q")[1])
    return q.filter(F.col("__n") >= least).select(*keys, lo.alias("__lo"), hi.alias("__hi"), F.col("__q")[2].alias("__median"))


def quantised(x: DataFrame, by: list[str], levels: int = LEVELS) -> DataFrame:
    """Crops with q, the value's level between the cell's percentiles; outside the cell, the median level of the cell."""
    keys = [*by, "label"]
    y = x.join(_limits(x, keys, LEAST_TEXTURE), keys)
    level = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("value") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))) * (levels - 1)).cast("int")
    y = y.withColumn("q", level)
    fill = y.filter("inside").groupBy(*keys).agg(F.percentile("q", F.lit(0.5)).cast("int").alias("__fill"))
    return y.join(fill, keys).select(*keys, "row", "col", F.when(F.col("inside"), F.col("q")).otherwise(F.col("__fill")).alias("q"))


def texture(pixels: DataFrame, by: list[str], value: str = "hematoxylin", levels: int = LEVELS) -> DataFrame:
    """Co-occurrence, local patterns, Gabor, wavelet, peak and clumping measurements of each cell; null for small cells."""
    keys = [*by, "label"]
    x = crops(pixels, by, value)
    glcm = raster.co_occurrence_features(raster.co_occurrence(quantised(x, by, levels), keys), keys)
    y = x.join(_limits(x, keys, LEAST_TEXTURE), keys)
    image = y.withColumn("v", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("value") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))))
    lbp = raster.local_patterns(image, keys, "v", "inside")
    blocks = x.join(_limits(x, keys, LEAST_BLOCKS), keys).withColumn("v", F.when(F.col("inside"), F.col("value")).otherwise(F.col("__median")))
    haar = raster.haar_energy(blocks, keys, "v")
    names = [f"gabor_f{f:.2f}_theta{t}_{s}" for f in (0.15, 0.3) for t in range(4) for s in ("mean", "std")] + ["nucleolar_peak_count", "nucleolar_peak_density", "nucleolar_peak_contrast_max", "chromatin_clumping_index"]
    numbers = _per_cell(x, by, names, lambda v, m: [*geometry.texture(v, m).values(), geometry.clumping(v, m)])
    return numbers.join(glcm, keys, "left").join(lbp, keys, "left").join(haar, keys, "left")


def cell_features(pixels: DataFrame, by: list[str], mpp: float, stains: DataFrame | None = None, slide: str = "slide") -> DataFrame:
    """All families of a cell in one row: morphology, intensity, texture; units spelt in the names.

    The ring round a nucleus is two micrometres wide. Texture is of hematoxylin normalised by the slide's stain reference
    (``raster.od_stain``), of plain hematoxylin on slides without one.
    """
    x = stained(pixels)
    if stains is not None:
        known = raster.od_stain(pixels.select(*by, "row", "col", *"rgb"), stains, slide).select(*by, "row", "col", F.col("hematoxylin").alias("__known"))
        x = x.join(known, [*by, "row", "col"], "left").withColumn("hematoxylin", F.coalesce("__known", "hematoxylin")).drop("__known")
    out = morphology(pixels, by, mpp).join(intensity(pixels, by, ring_width(mpp)), [*by, "label"], "left")
    return out.join(texture(x, by), [*by, "label"], "left")
