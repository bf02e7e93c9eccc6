"""Whole runs composed of the operators: extraction, cleaning, clustering, supervision, prediction."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import expressions as X
from lamella.operators import cellular, geometry, labels, learning, ranking, relational, spatial
from lamella.storage import stored

REGION = ["slide", "region"]
RADII_UM = (20.0, 50.0, 100.0)


TYPE_REACH = 2.0


def spatial_features(cells: DataFrame, mpp: float, k: int = 6, radii_um: tuple[float, ...] = RADII_UM, delaunay: bool = True) -> DataFrame:
    """Cells (slide, region, cell_label, cx_roi, cy_roi, orientation) to their neighbourhood features, in pixels and micrometres.

    Cells of unknown place are set aside: they have no features and are no neighbours. With a column type_name, the shares of neighbours
    of another type and of inflammatory ones are among the features.
    """
    everyone = cells
    typed = "type_name" in cells.columns
    p = cells.select(*REGION, F.col("cell_label").alias("id"), F.col("cx_roi").alias("x"), F.col("cy_roi").alias("y"), F.col("orientation").alias("angle"), *(["type_name"] if typed else []))
    p = stored(spatial.placed(p), "places")
    near = stored(spatial.k_nearest(p.select(*REGION, "id", "x", "y"), REGION, k), "near")
    out = spatial.neighbour_distances(near, p, REGION)
    keys = [*REGION, "id"]
    names, twins = [], {}
    for um in radii_um:
        px = um / mpp
        r = spatial.radius_features(p, REGION, px)
        cols = {f"{c}_r{px:.1f}px": n for c, n in (("neighbor_count", "neighbor_count"), ("local_density", "local_density"), ("ripleys_k_l_proxy", "ripleys_proxy"))}
        out = out.join(r.select(*keys, *[F.col(n).alias(c) for c, n in cols.items()]), keys, "left")
        names += list(cols)
        twins[float(f"{px:.1f}")] = um
    places = p.select(*keys, "x", "y")
    edges = geometry.region_graph(places, REGION, k) if delaunay else near.select(*REGION, F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "dist").distinct()
    g = spatial.edge_features(edges, REGION).select(*keys, F.col("degree").alias("delaunay_degree"), F.col("edge_mean").alias("delaunay_edge_length_mean_px"), F.col("edge_var").alias("delaunay_edge_length_var_px"), F.col("clustering_coefficient").alias("graph_clustering_coefficient"))
    out = out.join(g, keys, "left").join(spatial.architecture(p.drop("type_name"), near, REGION), keys, "left")
    if delaunay:
        out = out.join(geometry.region_voronoi(places, REGION), keys, "left")
    if typed:
        t = spatial.neighbour_fraction(near, p, REGION, "type_name")
        out = out.join(t.select(*keys, F.col("heterotypic_fraction").alias("heterotypic_neighbor_fraction"), F.col("inflammatory_fraction").alias("inflammatory_neighbor_fraction")), keys, "left")
    out = out.withColumn("orientation_coherence_circular_variance", F.col("orientation_disorder"))
    scaled = X.scaled_features([c for c in out.columns if c not in keys], mpp, twins)
    out = out.withColumns(scaled).withColumnRenamed("id", "cell_label")
    return everyone.select(*REGION, "cell_label").join(out, [*REGION, "cell_label"], "left")


def assign_types(cells: DataFrame, detections: DataFrame, names: DataFrame) -> DataFrame:
    """Cells (slide, region, cell_label, cx_wsi, cy_wsi) with type, type_name and type_prob of the slide's nearest detection within two pixels.

    detections: (slide, id, x, y, type, type_prob); names: (slide, type, name); a type without a name is ``type_<n>``. Regions with a
    cell of unknown place get no types at all.
    """
    own = cells.select(*REGION, "cell_label", F.col("cx_wsi").cast("double").alias("x"), F.col("cy_wsi").cast("double").alias("y"))
    lost = own.join(spatial.placed(own), [*REGION, "cell_label"], "left_anti").select(*REGION).distinct()
    asked = own.join(lost, REGION, "left_anti").select("slide", F.struct("region", "cell_label").alias("id"), "x", "y")
    near = spatial.capped_nearest(asked, detections.select("slide", "id", "x", "y"), ["slide"], TYPE_REACH).filter("other IS NOT NULL")
    d = detections.select("slide", F.col("id").alias("other"), "type", "type_prob").join(names, ["slide", "type"], "left")
    found = near.join(d, ["slide", "other"]).select("slide", F.col("id.region").alias("region"), F.col("id.cell_label").alias("cell_label"), "type", F.coalesce("name", F.concat(F.lit("type_"), F.coalesce(F.col("type").cast("string"), F.lit("None")))).alias("type_name"), "type_prob")
    return cells.join(found, [*REGION, "cell_label"], "left")


def extract(pixels: DataFrame, coords: DataFrame, mpp: float, detections: DataFrame | None = None, type_names: DataFrame | None = None, stains: DataFrame | None = None, least_px: int = 200, **kw) -> DataFrame:
    """All features of a cell in one row: its coordinates' columns, morphology, intensity and texture from pixels (slide, region, row, col,
    label, r, g, b), its type, its neighbourhood, and the proxies that combine them.

    Cells whose area (area_px of the coordinates) is known to be under the least are taken out of table and pixels; cells without
    pixels give no row. stains: stain references a slide, see ``cellular.cell_features``.
    """
    small = coords.filter(~X.keep_missing(F.col("area_px"), least_px)).select(*REGION, F.col("cell_label").alias("label")).distinct()
    coords = relational.small_cells_out(coords, "area_px", least_px)
    gone = pixels.join(small.withColumn("__small", F.lit(True)), [*REGION, "label"], "left")
    label = F.when(F.col("__small"), 0).otherwise(F.col("label")).cast(pixels.schema["label"].dataType)
    pixels = stored(gone.select(*REGION, "row", "col", *"rgb", label.alias("label")), "pixels")
    own = stored(cellular.cell_features(pixels, REGION, mpp, stains).withColumnRenamed("label", "cell_label"), "cells")
    keys = [*REGION, "cell_label"]
    there = coords.join(own.select(*keys), keys, "left_semi")
    if detections is not None:
        there = assign_types(there, detections, type_names)
    angles = own.select(*keys, "orientation")
    neighbours = spatial_features(there.join(angles, keys), mpp, **kw)
    taken = [c for c in there.columns if c not in keys and c in own.columns]
    x = there.drop(*taken).join(own.drop("orientation"), keys).join(neighbours, keys, "left")
    return x.withColumns({
        "apoptotic_body_proxy": X.apoptotic(F.col("area_px"), F.col("hematoxylin_mean"), F.col("circularity"), F.col("nuclear_membrane_irregularity_index")),
        "nuclear_overlap_crowding_index": X.crowded(F.col("nn_distance_min_px"), F.col("equivalent_diameter_px")),
    })


def clean(features: DataFrame, metadata: set[str], most: int = 40, groups: int = 20, per_group: int = 2) -> tuple[DataFrame, list[dict]]:
    """Features that vary, robustly scaled, thinned to a diverse selection; scaled values stay unimputed."""
    features = features.toDF(*[c.replace(".", "_") for c in features.columns])  # radii in names hold points
    columns = [f.name for f in features.schema if f.dataType.typeName() in ("double", "float", "integer", "long") and X.is_feature(f.name, metadata)]
    x = learning.clean_numbers(features, columns)
    kept = learning.varying(x, columns)
    x, kept = learning.robust_scale(x.drop(*[c for c in columns if c not in kept]), kept)
    chosen = learning.select_features(kept, 1 - abs(learning.spearman_matrix(x, kept)), most, groups, per_group)
    names = [r["feature"] for r in chosen]
    return x.select(*[c for c in x.columns if c not in kept], *names), chosen


def cluster(cells: DataFrame, features: list[str], classes: list[str], per_class: int = 1000, components: int = 20, seed: int = 42, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sampled cells with cluster and confidence, cells a region and cluster, and cluster profiles."""
    x = ranking.sample_regions(cells, REGION, "roi_class", classes, per_class, seed)
    x = learning.standardise(learning.clean_numbers(x, features), features)
    m = learning.DiagonalMixture(components, seed=seed, **kw).fit(x, features)
    out = ranking.argmax_with_confidence(m.transform(x, features), "probabilities").drop("probabilities")
    return out, relational.pivot_counts(out, REGION, "cluster_id", list(range(1, components + 1)), "C{:02d}"), learning.cluster_profiles(out, features, "cluster_id")


def train(features: DataFrame, annotated: DataFrame, columns: list[str], label: str, folds: int = 5, **kw) -> tuple[PipelineModel, DataFrame | None, dict]:
    """A model on all labelled cells, out-of-fold predictions, and metadata; the headline only if every fold was judged."""
    table, absent = labels.training_table(features, annotated, relational.KEYS, "patient_id", "slide", label)
    out, notes = learning.cross_validate(table, columns, "patient_id", label, folds, **kw)
    model = learning.forest(columns, label, **kw).fit(learning.training_rows(table, columns, "patient_id", label))
    complete = all(n["evaluated"] for n in notes)
    headline = learning.binary_metrics(out, label, "probability", 0.5).first().asDict() if complete and out is not None else None
    return model, out, {"absent": absent, "folds": notes, "metrics": headline}


def evaluate(model: PipelineModel, features: DataFrame, annotated: DataFrame, trained: DataFrame, columns: list[str], label: str, threshold: float = 0.5) -> DataFrame:
    """Metrics a patient, on patients and slides that training has not seen."""
    for key in ("patient_id", "slide"):
        if not relational.overlap(annotated, trained, key).isEmpty():
            raise relational.ContractError(f"{key} seen in training")
    table = relational.join_complete(annotated.filter(F.col(label) >= 0), features, relational.KEYS, "evaluation")
    return learning.metrics_by_group(learning.predict(model, table, columns, threshold), "patient_id", label, "probability", threshold)
