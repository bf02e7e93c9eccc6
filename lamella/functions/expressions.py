"""Column expressions for cell tables: parsing, units, names, labels, colours, flags."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type colours in order, the colour of no type, diagnosis classes, mask file name pattern.
TYPE_COLOURS = ("#00ff00", "#0000ff", "#808080", "#ff0000", "#ffff00")
NO_COLOUR = "#808080"
DIAGNOSES = ("STIC", "HGSC", "NFT")
MASK_NAME = r"^polyepi_(.+?)_(.+?)_L(\d+)_(\d+)_(\d+)_(\d+)x(\d+)\.npy$"


def safe_double(c: Column) -> Column:
    """A finite double, else null: text that is no number, NaN and infinities alike."""
    x = c.cast("string").try_cast("double") if hasattr(c, "try_cast") else c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def finite(c: Column) -> Column:
    """A double column with NaN and infinities as null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def keep_missing(c: Column, at_least: float) -> Column:
    """True unless c is known to be smaller: rows whose measurement is missing stay."""
    return ~F.coalesce(finite(c) < at_least, F.lit(False))


def to_micrometres(c: Column, mpp: float, digits: int | None = None) -> Column:
    """Pixels to micrometres; digits rounds half to even."""
    x = c * F.lit(mpp)
    return x if digits is None else F.bround(x, digits)


def pixels_from_area(area_um2: Column, mpp: Column, fallback: int = 200) -> Column:
    """An area threshold in pixels, 1 at least; the fallback where the scale is unknown."""
    known = mpp.isNotNull() & (mpp > 0)
    return F.when(known, F.greatest(F.lit(1), F.bround(area_um2 / (mpp * mpp)).cast("long"))).otherwise(F.lit(fallback)).cast("long")


def base_mpp(x: Column, y: Column, tolerance: float = 0.02) -> tuple[Column, Column]:
    """Mean scale, and whether the axes differ by more than the tolerance."""
    mean = (x + y) / 2
    return mean, F.coalesce(F.abs(x - y) / mean > tolerance, F.lit(False))


def region_name(raw: Column, accepted_before: Column) -> Column:
    """Letters and digits of any script, underscores, hyphens and spaces, these as underscores; Region_<n> if nothing is left."""
    clean = F.replace(F.trim(F.regexp_replace(raw, r"[^\p{L}\p{N}_ -]", "")), F.lit(" "), F.lit("_"))
    return F.when(F.coalesce(F.length(clean), F.lit(0)) > 0, clean).otherwise(F.concat(F.lit("Region_"), (accepted_before + 1).cast("string")))


def mask_name_parts(name: Column) -> Column:
    """Slide, region, level, origin and size from a mask's file name; the split after the slide is the first possible."""
    part = lambda i: F.regexp_extract(name, MASK_NAME, i)
    numbers = [part(i).try_cast("int").alias(n) for i, n in enumerate(("level", "min_x", "min_y", "width", "height"), 3)]
    return F.struct(part(1).alias("slide"), part(2).alias("region"), *numbers)


def diagnosis(text: Column, classes: tuple[str, ...] = DIAGNOSES) -> Column:
    """The single class named in the text as a word of its own; null for none, an error value for several."""
    pattern = r"(?<![A-Z0-9])(" + "|".join(classes) + r")(?![A-Z0-9])"
    found = F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(pattern), F.lit(1)))
    return F.when(F.size(found) == 1, found[0]).when(F.size(found) > 1, F.lit("ambiguous"))


def type_colour(type_id: Column) -> Column:
    """Palette colour by modulo; grey for no type."""
    palette = F.array(*[F.lit(c) for c in TYPE_COLOURS])
    return F.when(F.coalesce(type_id, F.lit(0)) <= 0, NO_COLOUR).otherwise(F.element_at(palette, (F.pmod(type_id - 1, F.lit(len(TYPE_COLOURS))) + 1).cast("int")))


def type_id(c: Column) -> Column:
    return F.coalesce(c.cast("string").try_cast("int"), F.lit(0))


def type_label(id_: Column, names: Column | None = None) -> Column:
    """The mapped name, else background for 0 and type_<n> otherwise."""
    default = F.when(id_ == 0, F.lit("background")).otherwise(F.concat(F.lit("type_"), id_.cast("string")))
    return default if names is None else F.coalesce(names[id_.cast("string")], default)


def apoptotic(area: Column, stain: Column, circularity: Column, irregularity: Column) -> Column:
    """1.0 or 0.0 by size, stain and shape; null if any is missing, NaN or infinite."""
    known = F.lit(True)
    for x in (area, stain, circularity, irregularity):
        known = known & finite(x).isNotNull()
    hit = (area < 80) & (stain > 0.1) & ((circularity < 0.55) | (irregularity > 1.2))
    return F.when(known, hit.cast("double"))


def crowded(nearest: Column, diameter: Column) -> Column:
    """1.0 if the nearest neighbour is closer than the diameter, else, unknown and NaN included, 0.0."""
    return F.coalesce(((nearest < diameter) & ~F.isnan(diameter)).cast("double"), F.lit(0.0))


def missing_fraction(columns: list[str]) -> Column:
    """Share of the columns that are null or NaN."""
    gone = lambda c: F.col(c).isNull() | F.coalesce(F.isnan(F.col(c).cast("string").try_cast("double")), F.lit(False))
    return sum((gone(c).cast("double") for c in columns), F.lit(0.0)) / len(columns)


def rounded_point(point: Column) -> Column:
    """[x, y] to whole numbers, half to even; null unless there are two."""
    return F.when(F.size(point) == 2, F.transform(point, lambda v: F.rint(v).cast("long")))


def contour_points(contour: Column) -> Column:
    """Points to whole numbers; null for fewer than three."""
    return F.when(F.size(contour) >= 3, F.transform(contour, lambda p: F.transform(p, lambda v: F.rint(v).cast("long"))))


def scaled_features(names: list[str], mpp: float, radii: dict[float, float]) -> dict[str, Column]:
    """Micrometre twins of pixel features, by name: lengths, areas, densities, counts and proxies of a radius."""
    out: dict[str, Column] = {}
    for name in names:
        c = F.col(f"`{name}`")
        if name.endswith("_px"):
            out[name[:-3] + "_um"] = c * mpp
        elif name.endswith("_px2"):
            out[name[:-4] + "_um2"] = c * mpp**2
        elif name.endswith("px") and "_r" in name:
            stem, _, radius = name[:-2].rpartition("_r")
            um = radii.get(float(radius))
            if um is not None:
                out[f"{stem}_r{um:g}um"] = c / mpp**2 if stem == "local_density" else c
    return out


def is_feature(name: str, metadata: set[str]) -> bool:
    """By name: no metadata, box or pixel-unit column; a radius in px without underscore counts."""
    return name not in metadata and not name.startswith("bbox_") and not name.endswith(("_px", "_px2"))


def pair_signature(*columns: str) -> Column:
    """A digest of a pair's identity, fields by name, null ones included; give sizes and times of its files, so that a replaced slide is noticed.

    The text that is digested is Spark's compact JSON: digests of other programs differ.
    """
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def hue_saturation_value(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue 0 to 180, saturation and value 0 to 255, as 8-bit images have them."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    hue = F.when(span == 0, 0.0).when(top == r, 60 * (g - b) / span).when(top == g, 120 + 60 * (b - r) / span).otherwise(240 + 60 * (r - g) / span)
    return F.when(hue < 0, hue + 360).otherwise(hue) / 2, F.when(top == 0, 0.0).otherwise(255 * span / top), top


def is_tissue(r: Column, g: Column, b: Column) -> Column:
    """Coloured and not near white, or dark, but not padding."""
    low, top, mean = F.least(r, g, b), F.greatest(r, g, b), (r + g + b) / 3
    return (((low < 230) & (top - low > 10)) | (mean < 180)) & (mean > 15)


def optical_density(c: Column) -> Column:
    return -F.log((c.cast("double") + 1) / 256)


#: Stain vectors of haematoxylin, eosin and DAB in red, green and blue.
STAINS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))


def stain_amounts(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """Amounts of the three stains, by the inverse of their matrix, 0 at least."""
    import numpy as np

    inverse = np.linalg.inv(np.array(STAINS))
    od = [-F.log(F.greatest(x.cast("double") / 255, F.lit(1e-6))) / math.log(1e6) for x in (r, g, b)]
    return tuple(F.greatest(F.lit(0.0), sum((od[i] * float(inverse[i, j]) for i in range(3)), F.lit(0.0))) for j in range(3))


def slide_mpp(properties: Column) -> Column:
    """Scale along x and y from a slide's property map; null where absent, no number, or not positive."""
    def axis(a: str) -> Column:
        v = safe_double(properties[f"openslide.mpp-{a}"])
        return F.when(v > 0, v)

    return F.struct(axis("x").alias("x"), axis("y").alias("y"))


def override_mpp(own: Column, override: Column) -> Column:
    """An override of one or two numbers before the slide's own scale; null unless both are positive and finite."""
    pick = lambda i: safe_double(F.when(F.size(override) >= 1, F.coalesce(F.get(override, F.lit(i)), F.when(F.size(override) == 1, F.get(override, F.lit(0))))))
    given = F.coalesce(F.size(override), F.lit(-1)) >= 0
    x, y = F.when(given, pick(0)).otherwise(own["x"]), F.when(given, pick(1)).otherwise(own["y"])
    good = (x > 0) & (y > 0) & ~F.coalesce(F.size(override) > 2, F.lit(False))
    return F.when(good, F.struct(x.alias("x"), y.alias("y")))


def region_tag(slide: Column, region: Column) -> Column:
    """Slide and region as file names have them; null if either could leave the folder."""
    tag = F.concat(slide, F.lit("_"), region)
    return F.when(~tag.rlike(r"[/\\]"), tag)


def region_files(root: str, slide: Column, region: Column) -> Column:
    """Paths of a region's label mask and image, first choice and fallback."""
    tag = region_tag(slide, region)
    path = lambda folder, kind: F.concat(F.lit(f"{root}/{folder}/{kind}_"), tag, F.lit(".tif"))
    return F.struct(path("region_mask", "mask").alias("mask"), path("region_rgb", "rgb").alias("rgb"), path("mask", "mask").alias("mask_2"), path("rgb", "rgb").alias("rgb_2"))


def mask_file(slide: Column, region: Column, level: Column, min_x: Column, min_y: Column, width: Column, height: Column, suffix: str) -> Column:
    """A region mask's file name."""
    return F.concat(F.lit("polyepi_"), slide, F.lit("_"), region, F.lit("_L"), level.cast("string"), F.lit("_"), min_x.cast("string"), F.lit("_"), min_y.cast("string"), F.lit("_"), width.cast("string"), F.lit("x"), height.cast("string"), F.lit("." + suffix))


def missing_defaults(columns: list[str], present: list[str]) -> list[Column]:
    """The columns in order, those that are not present as null doubles."""
    return [F.col(c) if c in present else F.lit(None).cast("double").alias(c) for c in columns]


def centre_text(x: Column, y: Column) -> Column:
    """(x, y) with two digits."""
    return F.format_string("(%.2f, %.2f)", x.cast("double"), y.cast("double"))


#: Cluster colours in order.
CLUSTER_COLOURS = (
    "#0066FF", "#00CC44", "#FF7A00", "#00D9E6", "#FFD600", "#D500F9", "#FF1744", "#004D40", "#7C4DFF", "#76FF03",
    "#8C2F00", "#008C99", "#B89B00", "#000080", "#A00060", "#4A6600", "#00FF99", "#FF4081", "#6500A8", "#263238",
)


def cluster_colour(cluster: Column, clusters: int) -> Column:
    """Colour of a 1-based cluster: the list while it lasts, else hues spread evenly."""
    import colorsys

    if clusters <= len(CLUSTER_COLOURS):
        names = CLUSTER_COLOURS[:clusters]
    else:
        names = ["#" + "".join(f"{round(255 * v):02x}" for v in colorsys.hsv_to_rgb(i / clusters, 1, 1)) for i in range(clusters)]
    return F.get(F.array(*[F.lit(c) for c in names]), cluster - 1)
