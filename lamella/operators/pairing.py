"""Staining of a second slide measured in the nuclei of the first: a join of two slides' pixels through a transform.

Nuclear pixels are mapped into the second slide, a tile at a time: the tile's source box decides which tiles of the second
slide are read at all. A mapped pixel is bilinear between four source pixels, which are joined by position; sums per nucleus
merge across tiles. A transform is six numbers, (x, y) to (m0 x + m1 y + m2, m3 x + m4 y + m5), from micrometres to micrometres.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions import expressions as X
from lamella.operators import labels, relational
from lamella.operators.relational import ContractError

REGION = ["slide", "region"]
TILE, SOURCE_TILE, LARGEST_BOX = 512, 256, 8192
#: Mapped places are taken to 1/32 pixel and values rounded, as 8-bit images are resampled.
STEPS = 32
OFFSET_TOLERANCE = 0.1
LEAST_DICE = 0.5


def region_offsets(coords: DataFrame) -> DataFrame:
    """(slide, region, off_x, off_y): where a region's first pixel lies in the slide, from its cells' boxes, else their centres.

    Raises if a cell's offset is unknown or departs from the region's median by more than a tenth of a pixel.
    """
    boxes = {"bbox_minc_wsi", "bbox_minc_roi", "bbox_minr_wsi", "bbox_minr_roi"} <= set(coords.columns)
    x, y = (("bbox_minc_wsi", "bbox_minc_roi"), ("bbox_minr_wsi", "bbox_minr_roi")) if boxes else (("cx_wsi", "cx_roi"), ("cy_wsi", "cy_roi"))
    d = coords.select(*REGION, *[X.finite((F.col(a) - F.col(b)).cast("double")).alias(n) for (a, b), n in ((x, "dx"), (y, "dy"))])
    if not d.filter("dx IS NULL OR dy IS NULL").isEmpty():
        raise ContractError("a cell without a known place in its slide")
    mid = d.groupBy(*REGION).agg(F.percentile("dx", F.lit(0.5)).alias("mx"), F.percentile("dy", F.lit(0.5)).alias("my"), F.min("dx").alias("x0"), F.max("dx").alias("x1"), F.min("dy").alias("y0"), F.max("dy").alias("y1"))
    far = F.greatest(F.col("mx") - F.col("x0"), F.col("x1") - F.col("mx"), F.col("my") - F.col("y0"), F.col("y1") - F.col("my"))
    if not mid.filter(far > OFFSET_TOLERANCE).isEmpty():
        raise ContractError("cells of a region disagree on its place in the slide")
    return mid.select(*REGION, F.rint("mx").cast("long").alias("off_x"), F.rint("my").cast("long").alias("off_y"))


def _frames(offsets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Regions with their slide's transform and scales; raises on a transform or scale that is not finite."""
    m = [X.finite(F.col("m")[i].cast("double")).alias(f"m{i}") for i in range(6)]
    scale = [X.finite(F.col(c)[i].cast("double")).alias(f"{c}{i}") for c in ("he_mpp", "p53_mpp") for i in (0, 1)]
    x = offsets.join(pairs.select("slide", *m, *scale, F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height")), "slide")
    bad = ~(F.col("he_mpp0") > 0) | ~(F.col("he_mpp1") > 0) | ~(F.col("p53_mpp0") > 0) | ~(F.col("p53_mpp1") > 0)
    if not x.filter(F.concat(*[F.col(c).cast("string") for c in x.columns]).isNull() | F.coalesce(bad, F.lit(True))).isEmpty():
        raise ContractError("a transform or scale that is not finite")
    return x


def mapped_places(nuclei: DataFrame, frames: DataFrame) -> DataFrame:
    """Nuclear pixels (slide, region, row, col, label) with px and py, their places in the second slide's pixels, and inside."""
    x, y = (F.col("col") + F.col("off_x")) * F.col("he_mpp0"), (F.col("row") + F.col("off_y")) * F.col("he_mpp1")
    z = nuclei.filter("label > 0").select(*REGION, "row", "col", "label").join(frames, REGION)
    z = z.withColumns({"px": (F.col("m0") * x + F.col("m1") * y + F.col("m2")) / F.col("p53_mpp0"), "py": (F.col("m3") * x + F.col("m4") * y + F.col("m5")) / F.col("p53_mpp1")})
    inside = (F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < F.col("width") - 1) & (F.col("py") < F.col("height") - 1)
    return z.select(*REGION, "row", "col", "label", "px", "py", inside.alias("inside"))


def source_boxes(places: DataFrame, tile: int = TILE) -> DataFrame:
    """(slide, region, tile_row, tile_col, x0, y0, x1, y1): the second slide's pixels that a tile's nuclei ask for, ends left out.

    Tiles with no pixel inside the second slide have none.
    """
    t = places.filter("inside").groupBy(*REGION, F.floor(F.col("row") / tile).alias("tile_row"), F.floor(F.col("col") / tile).alias("tile_col"))
    return t.agg(F.floor(F.min("px")).alias("x0"), F.floor(F.min("py")).alias("y0"), (F.ceil(F.max("px")) + 2).alias("x1"), (F.ceil(F.max("py")) + 2).alias("y1"))


def source_tiles(boxes: DataFrame, side: int = SOURCE_TILE) -> DataFrame:
    """(slide, source_row, source_col): the tiles of the second slide that any box touches."""
    rows = F.explode(F.sequence(F.floor(F.col("y0") / side), F.floor((F.col("y1") - 1) / side))).alias("source_row")
    cols = F.explode(F.sequence(F.floor(F.col("x0") / side), F.floor((F.col("x1") - 1) / side))).alias("source_col")
    return boxes.select("slide", "x0", "x1", rows).select("slide", "source_row", cols).distinct()


def with_source_tiles(source: DataFrame, side: int = SOURCE_TILE) -> DataFrame:
    """Pixels with source_row and source_col; written partitioned by slide and these, only the tiles asked for are read."""
    return source.withColumns({"source_row": F.floor(F.col("row") / side), "source_col": F.floor(F.col("col") / side)})


def warp(places: DataFrame, source: DataFrame, tile: int = TILE, largest_box: int = LARGEST_BOX, side: int = SOURCE_TILE) -> DataFrame:
    """Nuclear pixels with the second slide's colour there: slide, region, row, col, label, mapped, r, g, b.

    source: the second slide's pixels (slide, row, col, r, g, b, a), slide that of the first, of pixels that it holds. A place is
    mapped if it lies inside the second slide and the interpolated alpha is full; others are white. Raises if a tile's box has a side
    over the largest.
    """
    boxes = source_boxes(places, tile)
    if not boxes.filter((F.col("x1") - F.col("x0") > largest_box) | (F.col("y1") - F.col("y0") > largest_box)).isEmpty():
        raise ContractError("a tile maps to too many pixels: take smaller tiles or check the transform")
    if "source_row" not in source.columns:
        source = with_source_tiles(source, side)
    read = source.join(source_tiles(boxes, side), ["slide", "source_row", "source_col"], "left_semi")
    at = places.withColumns({"sx": F.rint(F.col("px") * STEPS).cast("long"), "sy": F.rint(F.col("py") * STEPS).cast("long")})
    part = lambda c: F.pmod(F.col(c), F.lit(STEPS))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), ((part("sx") if a else STEPS - part("sx")) * (part("sy") if b else STEPS - part("sy"))).alias("w")) for a in (0, 1) for b in (0, 1)]))
    ask = at.filter("inside").select(*REGION, "row", "col", "sx", "sy", corner.alias("o")).filter("o.w > 0")
    ask = ask.select(*REGION, F.col("row").alias("own_row"), F.col("col").alias("own_col"), (F.floor(F.col("sy") / STEPS) + F.col("o.b")).alias("row"), (F.floor(F.col("sx") / STEPS) + F.col("o.a")).alias("col"), "o.w")
    got = ask.join(read.select("slide", "row", "col", "r", "g", "b", "a"), ["slide", "row", "col"])
    value = lambda c: F.floor(F.sum(F.col(c) * F.col("w")) / (STEPS * STEPS) + 0.5).cast("int").alias(c)
    colours = got.groupBy(*REGION, F.col("own_row").alias("row"), F.col("own_col").alias("col")).agg(*[value(c) for c in "rgba"])
    x = places.select(*REGION, "row", "col", "label").join(colours, [*REGION, "row", "col"], "left")
    mapped = F.coalesce(F.col("a") == 255, F.lit(False))
    return x.select(*REGION, "row", "col", "label", mapped.alias("mapped"), *[F.when(mapped, F.col(c)).otherwise(255).alias(c) for c in "rgb"])


def measure(nuclei: DataFrame, source: DataFrame, offsets: DataFrame, pairs: DataFrame, tile: int = TILE, **kw) -> DataFrame:
    """Staining of every nucleus: slide, region, cell_label, and p53_ columns: mean and spread of DAB, positive, mapped and tissue fractions, radius.

    pairs: one row a slide (slide, m, he_mpp, p53_mpp, width, height, dab_threshold); no threshold, no positive fraction.
    """
    frames = _frames(offsets, pairs)
    x = warp(mapped_places(nuclei, frames), source, tile, **kw)
    r, g, b = (F.col(c) for c in "rgb")
    x = x.join(pairs.select("slide", F.col("dab_threshold").alias("__threshold")), "slide")
    dab: Column = X.stain_amounts(r, g, b)[2]
    x = x.select(*REGION, F.col("label").alias("cell_label"), "mapped", dab.alias("dab"), X.is_tissue(r, g, b).alias("tissue"), "__threshold")
    keys = [*REGION, "cell_label"]
    s = relational.pixel_sums(x, keys, "dab", "mapped", "tissue", F.col("__threshold"))
    area = frames.select(*REGION, (F.col("he_mpp0") * F.col("he_mpp1")).alias("__area"))
    s = s.join(area, REGION)
    names = {"p53_dab_mean": "mean", "p53_dab_std": "std", "p53_positive_fraction": "positive_fraction", "p53_mapped_fraction": "mapped_fraction", "p53_tissue_fraction": "tissue_fraction"}
    return s.select(*keys, *[F.col(c).alias(n) for n, c in names.items()], F.sqrt(F.col("n") * F.col("__area") / math.pi).alias("p53_equivalent_radius_um"))


def extract_pairs(nuclei: DataFrame, source: DataFrame, coords: DataFrame, pairs: DataFrame, review: DataFrame, regions: DataFrame, allow_serial: bool = False, most_error: float = 2.0, tile: int = TILE) -> DataFrame:
    """All cells of registered pairs with the second slide's staining, weak label and the pair's identity, from pixels.

    nuclei: (slide, region, row, col, label); source: the second slides' pixels; coords: cells with their places in region and slide;
    pairs: one row a slide (slide, pair_id, patient_id, registration_id, section_relationship, pair_signature, registered_signature,
    m, he_mpp, p53_mpp, width, height, tissue_dice, nonpositive_jacobian_fraction); review and regions as for ``weak_labels``.
    Raises if a pair's files changed since its registration, an approved registration fails its geometric checks, or cells have
    missing or repeated keys or lie in a slide without a pair.
    """
    if not pairs.filter(~F.col("pair_signature").eqNullSafe(F.col("registered_signature"))).isEmpty():
        raise ContractError("a slide or pair changed after its registration: register again")
    poor = (F.col("tissue_dice") < LEAST_DICE) | (F.col("nonpositive_jacobian_fraction") > 0)
    if not pairs.join(review.select("slide", "registration_approved"), "slide").filter(F.col("registration_approved") & poor).isEmpty():
        raise ContractError("an approved registration that fails its geometric checks")
    keys = [*REGION, "cell_label"]
    if coords.isEmpty() or not coords.filter(" OR ".join(f"{k} IS NULL" for k in keys)).isEmpty():
        raise ContractError("no cells, or cells with missing keys")
    if not coords.join(pairs, "slide", "left_anti").isEmpty():
        raise ContractError("cells of a slide that is no pair's")
    if not nuclei.filter("label < 0").isEmpty():
        raise ContractError("a mask with negative labels")
    with_threshold = pairs.join(review.select("slide", "dab_threshold"), "slide", "left")
    measured = measure(nuclei, source, region_offsets(coords), with_threshold, tile)
    identity = pairs.select("slide", "pair_id", "patient_id", "registration_id", "section_relationship")
    return labels.pair_measurements(coords, measured, identity, review, regions, allow_serial, most_error)


def review_template(cells: DataFrame) -> DataFrame:
    """Extracted cells with empty columns for a reader's verdict."""
    return cells.withColumns({"tumor": F.lit(-1), "p53_positive": F.lit(-1), "reviewer": F.lit("")})


def extraction_record(cells: DataFrame, allow_serial: bool, most_error: float) -> DataFrame:
    """A row a pair: what was extracted under which settings, for ``current_weak_labels`` and readers."""
    n = cells.groupBy("pair_id", "registration_id").agg(F.count("*").alias("cells"), F.count_if(F.col("p53_label") >= 0).alias("labeled_cells"))
    return n.withColumns({"allow_serial_weak_labels": F.lit(allow_serial), "max_error_um": F.lit(float(most_error))})
