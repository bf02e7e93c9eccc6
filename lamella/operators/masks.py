"""Region masks over pixel rows: components, lumen, ink, vessels, necrosis, epithelium, cells in a region.

An image is a table of pixels with the region's keys, row, col, r, g, b; a mask is the table of its
pixels. Neighbours are equi-joins on shifted positions, box sums are windows along rows and columns,
and components are merged from runs, so that a region of any size spreads over tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.functions import expressions as X
from lamella.operators import geometry, ranking, raster
from lamella.storage import discard, stored

#: Thresholds of the mask rules (areas in square micrometres).
WHITE, LUMEN_UM2 = 235, 350.0
RED_HUES, RED_LEAST = ((0, 10), (160, 180)), 100
VESSEL = {"hue": (0, 20), "saturation": (60, 200), "value": 120, "close": 1, "um2": 600.0}
NECROSIS = {"window": 9, "variance": 25.0, "least": 40, "um2": 1000.0}
EPITHELIUM = {"saturation": 30, "speckle_um2": 25.0, "keep": 0.90, "least_um2": 25.0, "centre": 0.50, "window": 0.01, "expand": 4, "erode": 1, "close": 1, "open": 2}
SMALLEST_SIDE = 10


def large_enough(width: Column, height: Column, least: int = SMALLEST_SIDE) -> Column:
    """Regions with a side under the least are left out."""
    return (width >= least) & (height >= least)


def tile_wanted(inside: Column, pixels: Column, brightness: Column, least_inside: float, most_bright: float = 0.90) -> Column:
    """Tiles that hold enough of the polygon and are not white background (mean brightness 0 to 1)."""
    return F.coalesce(inside / pixels >= least_inside, F.lit(False)) & ~F.coalesce(brightness > most_bright, F.lit(False))


# --- components ----------------------------------------------------------------------------------------------------------


def merge_nodes(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b) edges to (by, node, root), root the smallest node of the component.

    Large-star and small-star steps alternate until nothing changes. A node's edges are never gathered: each
    step joins them with the node's minimum, which is aggregated before the shuffle.
    """
    keys = [F.col(c) for c in by]

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = e.groupBy(*by, "a").agg(F.min("b").alias("m"))
        e = e.join(low, [*by, "a"])
        if large:
            return e.filter("b > a").select(*keys, F.col("b").alias("a"), F.least("a", "m").alias("b"))
        return e.select(*keys, F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now, before = stored(tidy(edges.select(*by, "a", "b")), "edges"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64(*by, "a", "b").cast("decimal(38,0)")), F.sum(F.hash(*by, "b", "a").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before, old = seen, now
        now = stored(tidy(star(tidy(star(now, True)), False)), "edges")
        discard(old)
    return now.select(*by, F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(*by, F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def components(mask: DataFrame, by: list[str], diagonal: bool = False) -> DataFrame:
    """(by, row, col) to the same with component: the scan-order number (row and column packed) of its first pixel.

    Pixels of a row that touch are one run; runs that touch those of the next row are merged.
    """
    w = W.partitionBy(*by, "row").orderBy("col")
    at = F.col("row").cast("long") * F.lit(1 << 32) + F.col("col")
    head = F.when(F.coalesce(F.lag("col").over(w) != F.col("col") - 1, F.lit(True)), at)
    runs = mask.select(*by, "row", "col").distinct().withColumn("run", head).withColumn("run", F.last("run", ignorenulls=True).over(w))
    runs = stored(runs, "runs")
    steps = [-1, 0, 1] if diagonal else [0]
    above = runs.select(*by, (F.col("row") + 1).alias("row"), F.explode(F.array(*[F.col("col") + d for d in steps])).alias("col"), F.col("run").alias("b"))
    edges = runs.withColumnRenamed("run", "a").join(above, [*by, "row", "col"]).select(*by, "a", "b").distinct()
    roots = merge_nodes(edges, by)
    return runs.join(roots, [*[runs[c].eqNullSafe(roots[c]) for c in by], runs["run"] == roots["node"]], "left").select(*[runs[c] for c in by], "row", "col", F.coalesce("root", "run").alias("component"))


def with_sizes(parts: DataFrame, by: list[str]) -> DataFrame:
    return parts.groupBy(*by, "component").agg(F.count("*").alias("size"))


def keep_large(mask: DataFrame, by: list[str], at_least: int) -> DataFrame:
    """Components of at least so many pixels."""
    parts = components(mask, by)
    return parts.join(with_sizes(parts, by).filter(F.col("size") >= at_least), [*by, "component"], "left_semi").select(*by, "row", "col")


def keep_fraction(mask: DataFrame, by: list[str], fraction: float) -> DataFrame:
    """Largest components until they hold the fraction of the mask."""
    parts = components(mask, by)
    kept = ranking.largest_until_fraction(with_sizes(parts, by), by, "size", "component", fraction)
    return parts.join(kept, [*by, "component"], "left_semi").select(*by, "row", "col")


def relabel(labels: DataFrame, by: list[str]) -> DataFrame:
    """Labels anew by touching pixels, numbered in scan order: cells that touch become one."""
    parts = components(labels.filter("label > 0"), by)
    n = F.row_number().over(W.partitionBy(*by).orderBy("component"))
    numbers = parts.select(*by, "component").distinct().withColumn("label", n)
    return parts.join(numbers, [*by, "component"]).select(*by, "row", "col", "label")


def labels_inside(labels: DataFrame, mask: DataFrame, by: list[str]) -> DataFrame:
    """Pixels of labels whose rounded centroid lies in the mask."""
    mid = labels.filter("label > 0").groupBy(*by, "label").agg(F.rint(F.avg("row")).cast("long").alias("row"), F.rint(F.avg("col")).cast("long").alias("col"))
    kept = mid.join(mask.select(*by, "row", "col").distinct(), [*by, "row", "col"], "left_semi").select(*by, "label")
    return labels.join(kept, [*by, "label"], "left_semi")


# --- neighbourhoods ------------------------------------------------------------------------------------------------------


def _offsets(pairs: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in pairs]))


def square(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets of a round structuring element: each row as wide as the circle, rounded."""
    return [(a, b) for a in range(-radius, radius + 1) for w in [round(math.sqrt(radius * radius - a * a))] for b in range(-w, w + 1)]


def dilate(mask: DataFrame, by: list[str], shape: list[tuple[int, int]], within: DataFrame) -> DataFrame:
    """Pixels of ``within`` that the shape around a mask pixel reaches."""
    o = mask.select(*by, "row", "col", _offsets(shape).alias("o")).select(*by, (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col")).distinct()
    return within.select(*by, "row", "col").join(o, [*by, "row", "col"], "left_semi")


def erode(mask: DataFrame, by: list[str], shape: list[tuple[int, int]], outside: DataFrame | None = None) -> DataFrame:
    """Mask pixels whose whole shape lies in the mask; with ``outside`` (the image), what lies beyond the image counts as mask."""
    o = mask.select(*by, "row", "col", _offsets(shape).alias("o")).select(*by, (F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"))
    full = o.groupBy(*by, "row", "col").agg(F.count("*").alias("__n"))
    x = mask.select(*by, "row", "col").join(full, [*by, "row", "col"], "left")
    need: Column = F.lit(len(shape))
    if outside is not None:
        frame = _frame(outside, by)
        x = x.join(frame, by)
        beyond = sum((((F.col("row") + a < F.col("r0")) | (F.col("row") + a > F.col("r1")) | (F.col("col") + b < F.col("c0")) | (F.col("col") + b > F.col("c1"))).cast("int") for a, b in shape), F.lit(0))
        need = need - beyond
    return x.filter(F.coalesce("__n", F.lit(0)) >= need).select(*by, "row", "col")


def _frame(image: DataFrame, by: list[str]) -> DataFrame:
    return image.groupBy(*by).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))


def close(mask: DataFrame, by: list[str], times: int, image: DataFrame) -> DataFrame:
    return erode(dilate(mask, by, square(times), image), by, square(times)) if times else mask


def open_(mask: DataFrame, by: list[str], times: int, image: DataFrame) -> DataFrame:
    return dilate(erode(mask, by, square(times)), by, square(times), image) if times else mask


def fill_holes(mask: DataFrame, by: list[str], image: DataFrame) -> DataFrame:
    """The mask with all background that is not joined to the image's edge."""
    empty = image.select(*by, "row", "col").join(mask.select(*by, "row", "col"), [*by, "row", "col"], "left_anti")
    parts = components(empty, by)
    edge = (F.col("row") == F.col("r0")) | (F.col("row") == F.col("r1")) | (F.col("col") == F.col("c0")) | (F.col("col") == F.col("c1"))
    outer = parts.join(_frame(image, by), by).filter(edge).select(*by, "component").distinct()
    return mask.select(*by, "row", "col").unionByName(parts.join(outer, [*by, "component"], "left_anti").select(*by, "row", "col"))


def box_mean(image: DataFrame, by: list[str], values: dict[str, Column], size: int) -> DataFrame:
    """Means over a size x size window, edges mirrored without the edge pixel itself: by, row, col, and the names of values.

    Sums along rows, then along columns, by windows over mirrored margins; images are larger than the window.
    """
    r = size // 2
    x = image.select(*by, "row", "col", *[v.cast("double").alias(k) for k, v in values.items()])
    for along, across in (("col", "row"), ("row", "col")):
        ends = x.groupBy(*by).agg(F.min(along).alias("__lo"), F.max(along).alias("__hi"))
        y = x.join(ends, by)
        c = F.col(along)
        spots = F.array(F.struct(c.alias("at")), F.struct(F.when((c > F.col("__lo")) & (c <= F.col("__lo") + r), 2 * F.col("__lo") - c).alias("at")), F.struct(F.when((c < F.col("__hi")) & (c >= F.col("__hi") - r), 2 * F.col("__hi") - c).alias("at")))
        y = y.withColumn("__s", F.explode(spots)).withColumn(along, F.col("__s.at")).filter(F.col(along).isNotNull())
        w = W.partitionBy(*by, across).orderBy(along).rangeBetween(-r, r)
        y = y.withColumns({k: F.sum(k).over(w) / size for k in values})
        x = y.filter((F.col(along) >= F.col("__lo")) & (F.col(along) <= F.col("__hi"))).select(*by, "row", "col", *values)
    return x


def median3(image: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median over 3 x 3, edge values repeated beyond the edge."""
    o = image.join(_frame(image, by), by).select(*by, "row", "col", "r0", "r1", "c0", "c1", _offsets(square(1)).alias("o"))
    at = lambda c, d, lo, hi: F.least(F.greatest(F.col(c) + F.col(d), F.col(lo)), F.col(hi))
    o = o.select(*by, "row", "col", at("row", "o.dr", "r0", "r1").alias("__r"), at("col", "o.dc", "c0", "c1").alias("__c"))
    values = image.select(*by, F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).alias("__v"))
    m = o.join(values, [*by, "__r", "__c"]).groupBy(*by, "row", "col").agg(F.element_at(F.sort_array(F.collect_list("__v")), 5).alias("__m"))
    return image.join(m, [*by, "row", "col"]).withColumn(value, F.col("__m")).drop("__m")


# --- mask rules ----------------------------------------------------------------------------------------------------------


def grey(r: Column, g: Column, b: Column) -> Column:
    """8-bit luminance in fixed-point weights."""
    return F.floor((r * 4899 + g * 9617 + b * 1868 + 8192) / 16384).cast("int")


def hue_8bit(image: DataFrame) -> DataFrame:
    """Adds hue (0 to 179), saturation and value as whole numbers."""
    h, s, v = X.hue_saturation_value(F.col("r"), F.col("g"), F.col("b"))
    return image.withColumns({"hue": (F.rint(h) % 180).cast("int"), "saturation": F.rint(s).cast("int"), "value": v.cast("int")})


def stain_8bit(image: DataFrame, by: list[str]) -> DataFrame:
    """Adds hem and eos: haematoxylin and eosin amounts between their 1st and 99th percentile, 0 to 255, by region."""
    h, e, _ = X.stain_amounts(F.col("r"), F.col("g"), F.col("b"))
    x = image.withColumns({"__h": h, "__e": e})
    q = x.groupBy(*by).agg(*[F.percentile(c, F.array(F.lit(0.01), F.lit(0.99))).alias(c + "q") for c in ("__h", "__e")])

    def scaled(c: str) -> Column:
        lo, hi = F.col(c + "q")[0], F.col(c + "q")[1]
        return F.when(hi <= lo, 0).otherwise(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - lo) / (hi - lo))) * 255)).cast("int")

    return x.join(q, by).withColumns({"hem": scaled("__h"), "eos": scaled("__e")}).drop("__h", "__e", "__hq", "__eq")


def structure(image: DataFrame, by: list[str]) -> DataFrame:
    """Adds structure: haematoxylin over its 99th percentile in tissue, 1 at most; null where a region has no such tissue."""
    h, _, _ = X.stain_amounts(F.col("r"), F.col("g"), F.col("b"))
    x = image.withColumn("__h", h)
    top = x.filter(X.is_tissue(F.col("r"), F.col("g"), F.col("b"))).groupBy(*by).agg(F.percentile("__h", F.lit(0.99)).alias("__top"))
    return x.join(top, by, "left").withColumn("structure", F.when(F.col("__top") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__h") / F.col("__top"))))).drop("__h", "__top")


def normalise_8bit(image: DataFrame, by: list[str], channels: list[str]) -> DataFrame:
    """Channels of other depths to 0 .. 255 between the 1st and 99th percentile of all their values; one apart where flat."""
    long = image.select(*by, F.explode(F.array(*[F.col(c).cast("double") for c in channels])).alias("__v")).filter(X.finite(F.col("__v")).isNotNull())
    q = long.groupBy(*by).agg(F.percentile("__v", F.array(F.lit(0.01), F.lit(0.99))).alias("__q"))
    lo = F.col("__q")[0]
    hi = F.when(F.col("__q")[1] <= lo, lo + 1).otherwise(F.col("__q")[1])
    return image.join(q, by).withColumns({c: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - lo) / (hi - lo))) * 255).cast("int") for c in channels}).drop("__q")


def lumen(image: DataFrame, mask: DataFrame, by: list[str], least_pixels: int) -> DataFrame:
    """White components of the mask of at least so many pixels."""
    white = image.filter(grey(F.col("r"), F.col("g"), F.col("b")) >= WHITE).select(*by, "row", "col")
    return keep_large(mask.select(*by, "row", "col").join(white, [*by, "row", "col"], "left_semi"), by, least_pixels)


def ink(image: DataFrame, by: list[str]) -> DataFrame:
    """Strongly red pixels."""
    x = hue_8bit(image)
    hue = F.lit(False)
    for a, b in RED_HUES:
        hue = hue | F.col("hue").between(a, b)
    return x.filter(hue & (F.col("saturation") >= RED_LEAST) & (F.col("value") >= RED_LEAST)).select(*by, "row", "col")


def vessels(image: DataFrame, mask: DataFrame, by: list[str], least_pixels: int) -> DataFrame:
    """Packed orange-red components of the mask, closed by a square, of at least so many pixels."""
    x = hue_8bit(image)
    near = x.filter(F.col("hue").between(*VESSEL["hue"]) & F.col("saturation").between(*VESSEL["saturation"]) & (F.col("value") >= VESSEL["value"]))
    seed = mask.select(*by, "row", "col").join(near.select(*by, "row", "col"), [*by, "row", "col"], "left_semi")
    return keep_large(close(seed, by, VESSEL["close"], image), by, least_pixels)


def necrosis(image: DataFrame, mask: DataFrame, by: list[str], least_pixels: int, window: int = NECROSIS["window"]) -> DataFrame:
    """Smooth components of the mask at some haematoxylin, of at least so many pixels; image has hem (``stain_8bit``)."""
    h = F.col("hem").cast("double")
    m = box_mean(image, by, {"m": h, "q": h * h}, window).filter(F.greatest(F.lit(0.0), F.col("q") - F.col("m") * F.col("m")) < NECROSIS["variance"])
    smooth = image.filter(F.col("hem") >= NECROSIS["least"]).select(*by, "row", "col").join(m, [*by, "row", "col"], "left_semi")
    return keep_large(mask.select(*by, "row", "col").join(smooth, [*by, "row", "col"], "left_semi"), by, least_pixels)


def without(mask: DataFrame, part: DataFrame, by: list[str]) -> DataFrame:
    return mask.select(*by, "row", "col").join(part.select(*by, "row", "col"), [*by, "row", "col"], "left_anti")


def epithelium(image: DataFrame, mask: DataFrame, by: list[str], mpp: float, p: dict = EPITHELIUM) -> DataFrame:
    """The epithelium of a cleaned mask: threshold on inverted haematoxylin, saturation gate, speckles, growth inside
    the mask, the largest parts, a light erosion, holes, closing and opening. image has hem (``stain_8bit``)."""
    area = lambda um2: max(1, round(um2 / mpp**2))
    keep = mask.select(*by, "row", "col").distinct().withColumn("__keep", F.lit(True))
    x = hue_8bit(image).join(keep, [*by, "row", "col"], "left").withColumn("dark", F.when(F.col("__keep"), 255 - F.col("hem")).otherwise(0))
    x = stored(median3(x, by, "dark"), "dark")
    own = x.filter("__keep")
    # the threshold is taken over all the smoothed image, the share over the mask's pixels
    share = own.join(raster.histogram_threshold(x, by, "dark"), by)
    split = share.groupBy(*by, "threshold").agg(F.avg((F.col("dark") < F.col("threshold")).cast("double")).alias("share"))
    even = F.abs(F.col("share") - p["centre"]) < p["window"]
    raw = own.join(split, by).filter((even | (F.col("dark") < F.col("threshold"))) & (F.col("saturation") >= p["saturation"])).select(*by, "row", "col")
    e = stored(keep_large(raw, by, area(p["speckle_um2"])), "epithelium")
    e = dilate(e, by, ellipse(p["expand"]), mask) if p["expand"] else e
    e = keep_large(keep_fraction(e, by, p["keep"]), by, area(p["least_um2"]))
    e = stored(erode(e, by, ellipse(p["erode"]), image) if p["erode"] else e, "epithelium")
    e = stored(fill_holes(e, by, image), "epithelium")
    return open_(close(e, by, p["close"], image), by, p["open"], image)


def cleaned_mask(image: DataFrame, polygon: DataFrame, by: list[str], mpp: float) -> DataFrame:
    """A polygon's pixels without large white gaps, ink, vessels and necrosis, in this order. image has hem (``stain_8bit``)."""
    area = lambda um2: max(1, round(um2 / mpp**2))
    keep = without(polygon, lumen(image, polygon, by, area(LUMEN_UM2)), by)
    keep = stored(without(keep, ink(image, by), by), "mask")
    keep = stored(without(keep, vessels(image, keep, by, area(VESSEL["um2"])), by), "mask")
    return without(keep, necrosis(image, keep, by, area(NECROSIS["um2"])), by)


# --- cells in a region ---------------------------------------------------------------------------------------------------


#: Pixels of polygons that leave a task at once.
PIXELS = 1 << 20


def filled(polygons: DataFrame, keys: list[str], points: str = "points") -> DataFrame:
    """(keys, points as [x, y], width, height) to the pixels that each polygon holds: keys, row, col. A batch of polygons at a time."""
    kinds = {f.name: f.dataType.simpleString() for f in polygons.schema}

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            outer = t[points].combine_chunks()
            inner = outer.flatten()
            starts = np.append(0, np.cumsum(pc.list_value_length(outer).to_numpy(zero_copy_only=False)))
            xy = np.stack([pc.list_element(inner, i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1)], 1)
            runs = geometry.fill_polygons(xy, starts, t["width"].to_numpy(), t["height"].to_numpy())
            n = runs[:, 3] - runs[:, 2] + 1
            for some in np.split(np.arange(len(runs)), np.flatnonzero(np.diff(np.cumsum(n) // PIXELS)) + 1):
                r, m = runs[some], n[some]
                col = np.repeat(r[:, 2] - np.cumsum(m) + m, m) + np.arange(m.sum())
                who = pa.array(np.repeat(r[:, 0], m))
                out = pa.table([t[k].take(who) for k in keys] + [pa.array(np.repeat(r[:, 1], m)), pa.array(col)], names=[*keys, "row", "col"])
                yield from out.combine_chunks().to_batches()

    return polygons.filter(F.size(points) >= 3).select(*keys, points, "width", "height").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", row long, col long")


def cells_in_region(cells: DataFrame, frames: DataFrame, mask: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cells whose rounded centroid lies in a region's mask, numbered in file order, and their pixels.

    cells: (slide keys, pos, centroid, contour), both in slide pixels; frames: (by, min_x, min_y, width, height), by holds
    the slide keys; mask: (by, row, col). Gives (by, label, pos) and (by, row, col, label): the later cell lies on
    top, and nothing lies outside the mask.
    """
    shared = [c for c in by if c in cells.columns]
    x = cells.filter((F.size("centroid") == 2) & (F.size("contour") >= 3)).join(frames, shared)
    x = x.withColumns({"col": F.rint(F.col("centroid")[0] - F.col("min_x")).cast("long"), "row": F.rint(F.col("centroid")[1] - F.col("min_y")).cast("long")})
    x = x.filter((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") < F.col("width")))
    x = x.join(mask.select(*by, "row", "col").distinct(), [*by, "row", "col"], "left_semi")
    x = ranking.number_in_ranges(x.select(*by, "pos", "contour", "min_x", "min_y", "width", "height"), by, ["pos"], "label")
    local = F.transform("contour", lambda q: F.array(q[0].cast("double") - F.col("min_x"), q[1].cast("double") - F.col("min_y")))
    pixels = raster.paint(filled(x.withColumn("points", local), [*by, "label"]), by)
    return x.select(*by, "label", "pos"), pixels.join(mask.select(*by, "row", "col").distinct(), [*by, "row", "col"], "left_semi")


def slide_boxes(cells: DataFrame) -> DataFrame:
    """Boxes in a region (minr, minc, maxr, maxc) also as boxes in the slide, by the region's min_x and min_y."""
    return cells.withColumns({f"bbox_{k}_wsi": F.col(k) + F.col("min_y" if k.endswith("r") else "min_x") for k in ("minr", "minc", "maxr", "maxc")})


def region_offset(cells: DataFrame, by: list[str]) -> DataFrame:
    """Median offset of a region in its slide, from boxes."""
    return cells.groupBy(*by).agg(F.median(F.col("bbox_minc_wsi") - F.col("minc")).alias("offset_x"), F.median(F.col("bbox_minr_wsi") - F.col("minr")).alias("offset_y"))
