"""Weak labels behind their gates, and the checks of a review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.expressions import finite, safe_double
from lamella.operators.relational import ContractError

LEAST_MAPPED, LEAST_TISSUE = 0.95, 0.5


def validate_review(review: dict) -> dict:
    """A review with its default fractions filled in; raises on values out of order."""
    r = {"negative_fraction": 0.1, "positive_fraction": 0.6, "dab_threshold": None, "registration_approved": False, "reviewer": ""} | review
    if r["dab_threshold"] is not None and not 0 < float(r["dab_threshold"]) < float("inf"):
        raise ContractError("the stain threshold must be positive")
    if not 0 <= float(r["negative_fraction"]) < float(r["positive_fraction"]) <= 1:
        raise ContractError("fractions must rise from negative to positive, within 0 and 1")
    if r["registration_approved"] is True and not str(r["reviewer"]).strip():
        raise ContractError("an approved registration needs a reviewer")
    return r


def weak_labels(cells: DataFrame, review: DataFrame, regions: DataFrame, allow_serial: bool = False, most_error: float = 2.0) -> DataFrame:
    """Cells with label 1, 0 or -1 (unknown).

    A label needs: an approved registration with a threshold, a fitting section relationship, an approved
    region with a known error within bounds, a cell that is mapped, on tissue and larger than the error.
    A measurement that is NaN or infinite is unknown and gives no label.
    review: one row a slide (slide, registration_approved, dab_threshold, section_relationship,
    positive_fraction, negative_fraction); regions: (slide, region, approved, max_registration_error_um).
    """
    approved = F.lower(F.col("approved").cast("string")).isin("true", "1")
    r = regions.select("slide", "region", approved.alias("region_ok"), safe_double(F.col("max_registration_error_um")).alias("error"))
    x = cells.join(review, "slide", "left").join(r, ["slide", "region"], "left")
    section = (F.col("section_relationship") == "same_section") | ((F.col("section_relationship") == "serial_section") & F.lit(allow_serial))
    gate = F.col("registration_approved") & F.col("dab_threshold").isNotNull() & section & F.col("region_ok") & F.col("error").between(0, most_error)
    mapped, tissue, radius, positive = (finite(F.col(f"p53_{c}")) for c in ("mapped_fraction", "tissue_fraction", "equivalent_radius_um", "positive_fraction"))
    open_ = F.coalesce(gate & (mapped >= LEAST_MAPPED) & (tissue >= LEAST_TISSUE) & (radius > F.col("error")), F.lit(False))
    label = F.when(open_ & (positive <= F.col("negative_fraction")), 0).when(open_ & (positive >= F.col("positive_fraction")), 1).otherwise(-1)
    return x.select(*cells.columns, label.alias("p53_label"))


def training_table(features: DataFrame, labels: DataFrame, keys: list[str], patient: str, slide: str, label: str) -> tuple[DataFrame, int]:
    """Labelled cells with their features, and how many labels have none; a slide must have one patient."""
    bad = labels.groupBy(slide).agg(F.count_distinct(patient).alias("n")).filter("n > 1")
    if not bad.isEmpty():
        raise ContractError("a slide with more than one patient")
    usable = labels.filter(F.col(label) >= 0)
    return usable.join(features, keys), usable.join(features, keys, "left_anti").count()


def pair_measurements(coords: DataFrame, measured: DataFrame, pair: DataFrame, review: DataFrame, regions: DataFrame, allow_serial: bool = False, most_error: float = 2.0) -> DataFrame:
    """All cells of the pairs' slides with their measurements, weak label and the pair's identity; unmeasured cells stay.

    pair: one row a slide (slide, patient_id, pair_id, registration_id, section_relationship).
    """
    keys = ["slide", "region", "cell_label"]
    if not coords.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ContractError("coordinates with a repeated cell")
    if not coords.filter(F.col("region").rlike(r"[/\\]")).isEmpty():
        raise ContractError("a region name with a path separator")
    x = coords.select(*keys, "cx_wsi", "cy_wsi").join(measured, keys, "left")
    section = review.drop("section_relationship").join(pair.select("slide", "section_relationship"), "slide")
    return weak_labels(x, section, regions, allow_serial, most_error).join(pair, "slide")


def review_regions(coords: DataFrame, residuals: DataFrame | None = None, at_least: int = 3) -> DataFrame:
    """A table to review: every region, not approved, with its largest landmark error where it has enough landmarks."""
    x = coords.select("slide", "region").distinct().withColumns({"approved": F.lit(False), "notes": F.lit("")})
    if residuals is None:
        return x.withColumn("max_registration_error_um", F.lit(None).cast("double"))
    worst = residuals.groupBy("slide", "region").agg(F.count("*").alias("n"), F.max("registration_error_um").alias("max_registration_error_um")).filter(F.col("n") >= at_least)
    return x.join(worst.drop("n"), ["slide", "region"], "left")


def current_weak_labels(measured: DataFrame, pairs: DataFrame, extractions: DataFrame) -> DataFrame:
    """Labels of all extracted pairs; raises if one was extracted for another registration, review or identity.

    measured: cells with pair_id, registration_id, patient_id, p53_label; pairs: (pair_id, patient_id, he_slide,
    pair_signature, registered_signature, registration_id, review, region_review_sha256), as they are now; extractions:
    (pair_id, registration_id, review, region_review_sha256), as they were. Pairs without extraction are left out.
    """
    e = extractions.select("pair_id", *[F.col(c).alias(f"__{c}") for c in ("registration_id", "review", "region_review_sha256")])
    now = pairs.join(e, "pair_id")
    if not now.filter(~F.col("pair_signature").eqNullSafe(F.col("registered_signature"))).isEmpty():
        raise ContractError("a source pair changed after its registration")
    stale = F.lit(False)
    for c in ("registration_id", "review", "region_review_sha256"):
        stale = stale | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    if not now.filter(stale).isEmpty():
        raise ContractError("a registration or review changed after the extraction")
    x = measured.join(now.select("pair_id", F.col("registration_id").alias("__now"), F.col("patient_id").alias("__patient"), F.col("he_slide").alias("__slide")), "pair_id")
    if not x.filter(~F.col("registration_id").eqNullSafe(F.col("__now"))).isEmpty():
        raise ContractError("measurements of an earlier registration")
    if not x.filter(~(F.col("patient_id").eqNullSafe(F.col("__patient")) & F.col("slide").eqNullSafe(F.col("__slide")))).isEmpty():
        raise ContractError("measurements of another patient or slide")
    return x.select("slide", "region", "cell_label", "patient_id", F.col("p53_label").alias("label"), F.lit("p53_staining_weak_label").alias("label_source"))


def after_registration(reviews: DataFrame, registrations: DataFrame) -> DataFrame:
    """Reviews as they stand after pairs were registered anew: approvals of another registration fall, all else is kept.

    reviews: (pair_id, registration_id, registration_approved, ...); registrations: (pair_id, registration_id).
    """
    now = registrations.select("pair_id", F.col("registration_id").alias("__now"))
    x = reviews.join(now, "pair_id", "left")
    same = F.col("__now").isNull() | F.col("registration_id").eqNullSafe(F.col("__now"))
    changed = {"registration_id": F.coalesce("__now", "registration_id"), "registration_approved": F.col("registration_approved") & same}
    return x.select(*[changed.get(c, F.col(c)).alias(c) for c in reviews.columns])
