"""Typed readers of the pipeline's files; every schema is declared, none inferred."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.functions import expressions as X
from lamella.operators.relational import ContractError, region_sources, require_columns, split_lists
from lamella.storage import stored

CELL_SCHEMA = "slide string, region string, cell_label long, type int, center string, contour string, cx_roi double, cy_roi double, cx_wsi double, cy_wsi double, cx_wsi_um double, cy_wsi_um double, area_px long, bbox_minr_roi long, bbox_minc_roi long, bbox_maxr_roi long, bbox_maxc_roi long, bbox_minr_wsi long, bbox_minc_wsi long, bbox_maxr_wsi long, bbox_maxc_wsi long"
SEGMENTER_SCHEMA = "cells array<struct<centroid: array<double>, contour: array<array<double>>, type: string, type_prob: double>>, type_map map<string, string>"
ANNOTATION_SCHEMA = "_Text string, _Type string, Vertices struct<Vertex: array<struct<_X: double, _Y: double>>>"
MANIFEST_SCHEMA = "pairs array<struct<pair_id: string, patient_id: string, he_slide: string, p53_slide: string, section_relationship: string, he_mpp: double, p53_mpp: double, landmarks: string, qc_landmarks: string>>"

_ROWS = 200_000  # pixel rows of a batch


def slides(spark: SparkSession, folder: str, suffix: str = "ndpi") -> DataFrame:
    """Slide files by any case of the suffix, in name order; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(F.lower(name).endswith("." + suffix)).select(F.regexp_replace(name, r"\.[^.]*$", "").alias("slide"), "path", "length").orderBy("slide")


def annotations(spark: SparkSession, path: str, level: int = 2) -> DataFrame:
    """Polygons of an annotation file: cleaned name and points over 2^level; fewer than three points are left out."""
    x = spark.read.format("xml").option("rowTag", "Region").schema(ANNOTATION_SCHEMA).load(path).withColumn("at", F.monotonically_increasing_id())
    x = x.filter("Vertices IS NOT NULL").withColumn("points", F.transform("Vertices.Vertex", lambda v: F.array(v["_X"] / 2**level, v["_Y"] / 2**level))).filter(F.size("points") >= 3)
    before = F.row_number().over(W.orderBy("at")) - 1  # one file's regions
    return x.select(X.region_name(F.col("_Text"), before).alias("region"), F.col("_Type").alias("kind"), "points")


def annotation_files(slides_: DataFrame, files: DataFrame) -> DataFrame:
    """Each slide's file, <slide>.ndpi.xml before <slide>.xml; slides with neither are left out. files: (name, path)."""
    full = files.select(F.col("name").alias("n1"), F.col("path").alias("p1"))
    bare = files.select(F.col("name").alias("n2"), F.col("path").alias("p2"))
    x = slides_.join(full, F.concat("slide", F.lit(".ndpi.xml")) == F.col("n1"), "left").join(bare, F.concat("slide", F.lit(".xml")) == F.col("n2"), "left")
    return x.select("slide", F.coalesce("p1", "p2").alias("annotation")).filter("annotation IS NOT NULL")


def segmenter(spark: SparkSession, path: str) -> DataFrame:
    """One row a detected cell, in file order: source, pos, centroid, contour, type, type_prob, type_name."""
    x = spark.read.schema(SEGMENTER_SCHEMA).option("multiLine", "true").json(path).withColumn("source", F.col("_metadata.file_path"))
    x = x.select("source", "type_map", F.posexplode("cells").alias("pos", "cell"))
    id_ = X.type_id(F.col("cell.type"))
    return x.select("source", "pos", X.rounded_point(F.col("cell.centroid")).alias("centroid"), X.contour_points(F.col("cell.contour")).alias("contour"), id_.alias("type"), F.col("cell.type_prob").alias("type_prob"), X.type_label(id_, F.col("type_map")).alias("type_name"))


def detections(cells: DataFrame, files: DataFrame) -> DataFrame:
    """Each segmenter file with the detection file beside it, null where there is none. cells: (source); files: (path)."""
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    beside = files.filter(F.col("path").endswith("/cell_detection.json")).select(folder(F.col("path")).alias("__folder"), F.col("path").alias("detection"))
    return cells.withColumn("__folder", folder(F.col("source"))).join(beside, "__folder", "left").drop("__folder")


def region_images(regions: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Each region's mask and image file, both from the first folder that has both. files: (path); raises where neither has."""
    here = files.select(F.col("path").alias("__p"))
    x = regions.withColumn("__f", X.region_files(root, F.col("slide"), F.col("region")))
    for n in ("mask", "rgb", "mask_2", "rgb_2"):
        x = x.join(here.withColumnRenamed("__p", f"__{n}"), F.col(f"__f.{n}") == F.col(f"__{n}"), "left")
    first = F.col("__mask").isNotNull() & F.col("__rgb").isNotNull()
    second = F.col("__mask_2").isNotNull() & F.col("__rgb_2").isNotNull()
    out = x.select(*regions.columns, F.when(first, F.col("__mask")).when(second, F.col("__mask_2")).alias("mask"), F.when(first, F.col("__rgb")).when(second, F.col("__rgb_2")).alias("rgb"))
    if not out.filter("mask IS NULL").isEmpty():
        raise ContractError("a region without an image and a mask")
    return out


def slide_files(names: list[str], slide: str | None = None, suffix: str = "_cell_coords.csv") -> list[str]:
    """A slide's cell table: the file of exactly its name, else all whose names start with it; every table without a slide."""
    own = sorted(n for n in names if n.rsplit("/", 1)[-1].endswith(suffix))
    if slide is None:
        return own
    exact = [n for n in own if n.rsplit("/", 1)[-1] == slide + suffix]
    return exact or [n for n in own if n.rsplit("/", 1)[-1].startswith(slide)]


def cell_tables(spark: SparkSession, paths: str | list[str], slide: str | None = None) -> DataFrame:
    """Cell CSVs with points parsed; a slide filter reaches the scan."""
    x = spark.read.option("header", "true").schema(CELL_SCHEMA).csv(paths)
    x = x.filter(F.col("slide") == slide) if slide else x
    return x.withColumn("center", F.from_json("center", "array<double>")).withColumn("contour", F.from_json("contour", "array<array<double>>"))


def numbered(scan: DataFrame) -> DataFrame:
    """A scan of files with source_file (its name), source_row and row_index: rows by file from 0, and over all files in the order of their paths.

    Each split's rows are numbered where they are read; only the counts of splits are summed up, by file and over files.
    """
    x = stored(scan.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at")), "numbered")
    ahead = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    splits = x.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    splits = splits.withColumn("__in_file", F.coalesce(F.sum("__n").over(ahead(W.partitionBy("__file").orderBy("__block"))), F.lit(0)))
    files = splits.groupBy("__file").agg(F.sum("__n").alias("__n"))
    files = files.select("__file", F.coalesce(F.sum("__n").over(ahead(W.orderBy("__file"))), F.lit(0)).alias("__over"))  # a row a file
    y = x.join(splits.drop("__n"), ["__file", "__block"]).join(files, "__file")
    row = F.col("__in_file") + F.col("__at") - F.col("__first")
    y = y.withColumns({"source_file": F.element_at(F.split("__file", "/"), -1), "source_row": row, "row_index": F.col("__over") + row})
    return y.drop("__file", "__block", "__at", "__first", "__in_file", "__over")


def one_file_a_region(df: DataFrame, keys: list[str], source: str = "source_file") -> DataFrame:
    """The table; raises if a region comes from more than one file, or a column starts with two underscores, which are reserved."""
    if any(c.startswith("__") for c in df.columns):
        raise ContractError("columns that start with two underscores")
    twice = region_sources(df, keys, source).first()
    if twice:
        raise ContractError(f"a region in several files: {tuple(twice[k] for k in keys)}")
    return df


def feature_tables(spark: SparkSession, paths: str | list[str], ids: list[str], features: list[str]) -> DataFrame:
    """Feature CSVs read as text by header, cast on read, with their file, its rows' numbers and numbers over all files; absent columns are null.

    Slides and regions default to the file's stem where the column is absent. Raises on rows without them, and on a region in several files.
    """
    raw = spark.read.option("header", "true").csv(paths)
    if any(c.startswith("__") for c in raw.columns):
        raise ContractError("columns that start with two underscores")
    x = numbered(raw.drop("source_file", "source_row", "row_index"))
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    cols = [(F.col(c) if c in x.columns else stem if c in ("slide", "region") else F.lit(None)).cast("string").alias(c) for c in ids]
    cols += [(X.finite(F.col(f"`{c}`").try_cast("double")) if c in x.columns else F.lit(None).cast("double")).alias(c) for c in features]
    out = x.select("source_file", "source_row", "row_index", *cols)
    if not out.filter(F.col(ids[0]).isNull() | F.col(ids[1]).isNull()).isEmpty():
        raise ContractError("rows without slide or region")
    return one_file_a_region(out, ids[:2])


def preferred_files(names: list[str], aggregate: str = "all_cell_features.csv") -> list[str]:
    """Per-slide feature files if there are any, else the aggregate; cleaned files never."""
    usable = sorted(n for n in names if n.endswith("_features.csv") and not n.endswith("_cleaned.csv"))
    own = [n for n in usable if n != aggregate]
    return own or usable


def masks(spark: SparkSession, folder: str, level: int = 2) -> DataFrame:
    """Mask files of a level, keys from the sidecar-free legacy file name."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", "polyepi_*.npy").load(folder)
    x = x.select("path", X.mask_name_parts(F.element_at(F.split("path", "/"), -1)).alias("p")).select("path", "p.*")
    return x.filter(F.col("level") == level)


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Mask sidecars, the truth on slide and region names."""
    return spark.read.schema("slide string, region_id string, level int, min_x int, min_y int, width int, height int").option("multiLine", "true").json(folder)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Slide pairs; ids must be unique and plain, one pair a slide."""
    p = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", "true").json(path).select(F.explode("pairs").alias("p")).select("p.*")
    bad = p.filter(F.col("pair_id").isNull() | ~F.col("pair_id").rlike("^[A-Za-z0-9_-]+$"))
    if not bad.isEmpty():
        raise ContractError("a pair id with other characters")
    for key in ("pair_id", "he_slide"):
        if not p.groupBy(key).count().filter("count > 1").isEmpty():
            raise ContractError(f"a repeated {key}")
    known = F.col("section_relationship").isin("same_section", "serial_section")
    return p.withColumn("section_relationship", F.when(known, F.col("section_relationship")).otherwise("unknown"))


def annotated_cells(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Human labels: target in -1, 0, 1; a reviewer for every labelled row, a patient for every row."""
    x = spark.read.option("header", "true").csv(path)
    require_columns(x, ["slide", "region", "cell_label", "patient_id", "reviewer", target], "annotations")
    x = x.withColumn("cell_label", F.col("cell_label").try_cast("long")).withColumn(target, F.col(target).try_cast("int"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = x.filter(F.col(target).isNull() | ~F.col(target).isin(-1, 0, 1) | blank("patient_id") | ((F.col(target) >= 0) & blank("reviewer")))
    if not bad.isEmpty():
        raise ContractError("annotation rows with a bad target, patient or reviewer")
    return x


def selected_features(spark: SparkSession, path: str, wanted: int = 40, forbidden: frozenset[str] = frozenset()) -> list[str]:
    """Names in a selection table, from ;-joined lists or one a row, as many and distinct as wanted."""
    x = spark.read.option("header", "true").csv(path)
    col = "selected_features" if "selected_features" in x.columns else "feature"
    names = [r["name"] for r in split_lists(x.withColumn("at", F.monotonically_increasing_id()).select("at", col), col, "name").orderBy("at", "pos").select("name").collect()]
    if len(names) != wanted or len(set(names)) != wanted or set(names) & forbidden:
        raise ContractError(f"needs {wanted} distinct features that are no metadata")
    return names


def stain_references(spark: SparkSession, path: str) -> DataFrame:
    """Reference stains a slide; maxima are 1e-9 at least."""
    x = spark.read.schema("slide string, m array<double>, max_c array<double>, metadata_json string").json(path)
    if not x.filter((F.size("m") != 6) | (F.size("max_c") != 2)).isEmpty():
        raise ContractError("a stain reference of another shape")
    return x.withColumn("max_c", F.transform("max_c", lambda v: F.greatest(v, F.lit(1e-9))))


def landmarks(spark: SparkSession, path: str, he_mpp: float, p53_mpp: float) -> DataFrame:
    """Landmark pairs in micrometres, all finite."""
    x = spark.read.option("header", "true").schema("he_x double, he_y double, p53_x double, p53_y double, region string").csv(path)
    cols = ["he_x", "he_y", "p53_x", "p53_y"]
    if not x.filter(" OR ".join(f"{c} IS NULL OR isnan({c}) OR abs({c}) = double('infinity')" for c in cols)).isEmpty():
        raise ContractError("a landmark without a number")
    return x.withColumns({c: F.col(c) * (he_mpp if c.startswith("he") else p53_mpp) for c in cols})


def array_pixels(spark: SparkSession, files: DataFrame, scale: int = 1) -> DataFrame:
    """Pixels of array files (.npy): path, row, col, value and, for arrays of three channels, r, g, b.

    files: (path, content). A file is read in one task and leaves it as rows. Of masks, only pixels other than 0 are given, each
    as scale x scale pixels of the finer level; greyscale images have one value in all channels; further channels are left out.
    """

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim == 2:
                    r, c = np.nonzero(a)
                    v = a[r, c].astype(np.int64)
                    r, c = ((x[:, None] * scale + np.tile(k, 1)).ravel() for x, k in ((r, np.repeat(np.arange(scale), scale)), (c, np.tile(np.arange(scale), scale))))
                    v = np.repeat(v, scale * scale)
                    colours = [v, v, v]
                else:
                    r, c = (x.ravel() for x in np.indices(a.shape[:2]))
                    colours = [a[..., k].ravel().astype(np.int64) for k in range(3)]
                    v = colours[0]
                for at in range(0, len(r), _ROWS):
                    s = slice(at, at + _ROWS)
                    yield pd.DataFrame({"path": path, "row": r[s], "col": c[s], "value": v[s], "r": colours[0][s], "g": colours[1][s], "b": colours[2][s]})

    return files.select("path", "content").mapInPandas(run, "path string, row long, col long, value long, r long, g long, b long")


def mask_pixels(spark: SparkSession, folder: str, level: int = 2) -> DataFrame:
    """Pixels of a level's region masks at the finest level: slide, region, row, col, with the frame's min_x and min_y."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "polyepi_*.npy").load(folder)
    named = files.select("path", X.mask_name_parts(F.element_at(F.split("path", "/"), -1)).alias("p")).select("path", "p.*").filter(F.col("level") == level)
    pixels = array_pixels(spark, files.join(named.select("path"), "path", "left_semi"), 2**level)
    return pixels.select("path", "row", "col").join(named, "path").select("slide", "region", "row", "col", (F.col("min_x") * 2**level).alias("min_x"), (F.col("min_y") * 2**level).alias("min_y"))
