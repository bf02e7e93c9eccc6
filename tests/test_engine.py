"""Rules that a clean rewrite would change, on hand-made rows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import expressions as X
from lamella.functions import statistics as S
from lamella.operators import geometry, labels, learning, ranking, raster, relational, spatial
from lamella.sources import readers, writers
from lamella.streaming import counts


def test_missing_area_stays(spark):
    df = spark.createDataFrame([(1, 199.0), (2, 200.0), (3, None), (4, float("nan"))], "id int, area_px double")
    assert [r.id for r in relational.small_cells_out(df).orderBy("id").collect()] == [2, 3, 4]


def test_moments_need_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 3.0), ("b", 3.0), ("b", 3.0), ("c", float("nan"))], "g string, v double")
    rows = {r.g: r for r in df.groupBy("g").agg(*S.nine_numbers("v", "v")).collect()}
    assert rows["a"].v_skew is None and rows["b"].v_kurtosis is None and rows["c"].v_mean is None and rows["a"].v_median == 1.5


def test_rounding_is_half_to_even(spark):
    r = spark.range(1).select(X.rounded_point(F.array(F.lit(2.5), F.lit(3.5))).alias("p"), X.rounded_point(F.array(F.lit(1.0))).alias("q")).first()
    assert r.p == [2, 4] and r.q is None


def test_mask_name_splits_at_first_underscore(spark):
    r = spark.range(1).select(X.mask_name_parts(F.lit("polyepi_A_1_R_L2_3_4_64x32.npy")).alias("p")).first().p
    assert tuple(r) == ("A", "1_R", 2, 3, 4, 64, 32)


def test_key_contract(spark):
    df = spark.createDataFrame([("s", "r", 1), ("s", "r", 1), ("s", None, 2), ("s", "r", 0)], "slide string, region string, cell_label long")
    assert {r.fault for r in relational.key_faults(df).collect()} == {"null key", "label not positive", "repeated key"}
    with pytest.raises(relational.ContractError):
        relational.validate_keys(df)


def test_cap_is_inclusive_and_unknown_place_disables_region(spark):
    a = spark.createDataFrame([("r", 1, 0.0, 0.0), ("q", 2, 0.0, 0.0), ("q", 3, None, 1.0)], "region string, id long, x double, y double")
    b = spark.createDataFrame([("r", 7, 2.0, 0.0), ("r", 8, 0.0, 2.0), ("q", 9, 0.0, 0.0)], "region string, id long, x double, y double")
    got = {r.id: r.other for r in spatial.capped_nearest(a, b, ["region"], 2.0).collect()}
    assert got == {1: 7, 2: None, 3: None}


@pytest.mark.parametrize("n,k", [(400, 4), (5, 6), (1, 2)])
def test_k_nearest_equals_brute_force(spark, n, k):
    rng = np.random.default_rng(n)
    xy = rng.random((n, 2)) ** 3 * 100
    df = spark.createDataFrame([("r", i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "region string, id long, x double, y double")
    got = {(r.id, r["rank"]): r.other for r in spatial.k_nearest(df, ["region"], k, per_cell=8).collect()}
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    want = {(i, j + 1): int(o) for i in range(n) for j, o in enumerate(np.argsort(d[i], kind="stable")[: min(k, n - 1)])}
    assert got == want


def test_delaunay_has_empty_circles():
    p = np.random.default_rng(3).random((60, 2))
    t = geometry.delaunay(p)
    for a, b, c in p[t]:
        m = np.array([b - a, c - a]) * 2
        centre = a + np.linalg.solve(m, [((b - a) ** 2).sum(), ((c - a) ** 2).sum()])
        assert (np.hypot(*(p - centre).T) > math.dist(centre, a) - 1e-7).all()
    hull = geometry.convex_hull(p)
    areas = sum(geometry.area_of(x) for x in p[t])
    assert areas == pytest.approx(geometry.area_of(hull), rel=1e-6)


def test_voronoi_of_a_grid_is_squares():
    g = np.array([(x + 1e-6 * y, y + 1e-6 * x * x) for x in range(5) for y in range(5)], float)
    area, irregular = geometry.voronoi_cells(g, geometry.delaunay(g))
    assert area[12] == pytest.approx(1, abs=1e-3) and irregular[12] == pytest.approx(16 / (4 * math.pi), abs=1e-2) and np.isnan(area[0])


def test_shapes_and_components():
    sq = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    assert geometry.area_of(sq) == 16 and geometry.length_of(sq) == 16 and geometry.concavities(sq) == (0.0, 0.0)
    dent = np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], float)
    assert geometry.concavities(dent) == (1.0, 3.0)
    assert geometry.fourier_amplitudes(sq)[0] == 1.0 and len(geometry.fill_polygon(sq, 10, 10)) >= 5
    m = np.array([[1, 0, 1], [1, 1, 1], [0, 0, 0], [1, 0, 0]], bool)
    lab = geometry.label_components(m)
    assert lab.max() == 2 and lab[0, 0] == lab[0, 2] == 1 and lab[3, 0] == 2 and geometry.keep_large(m, 2).sum() == 5
    assert geometry.close(m, 1).sum() >= m.sum() and geometry.boundary(np.ones((4, 4), bool)).sum() == 12


def test_affine_survives_outliers():
    rng = np.random.default_rng(1)
    src = rng.random((30, 2)) * 100
    m = np.array([[1.1, -0.2, 5], [0.2, 0.9, -3]])
    dst = src @ m[:, :2].T + m[:, 2]
    dst[:6] += 40
    fit, ok = geometry.fit_affine(src, dst, 1.0)
    assert np.allclose(fit, m, atol=1e-6) and ok.sum() == 24
    with pytest.raises(ValueError):
        geometry.fit_affine(np.array([(0, 0), (1, 1), (2, 2)], float), src[:3], 1.0)


def test_average_linkage_and_selection():
    d = np.array([[0, 0.1, 0.9, 0.8], [0.1, 0, 0.85, 0.9], [0.9, 0.85, 0, 0.2], [0.8, 0.9, 0.2, 0]])
    assert learning.average_linkage(d, 2) == [[0, 1], [2, 3]]
    assert learning.pick_diverse([0, 1, 2, 3], d, 2) == [0, 2] and learning.pick_diverse([0, 1, 2, 3], d, 0) == []
    picked = [r["feature"] for r in learning.select_features(list("abcd"), d, 3, 2, 1)]
    assert picked == ["a", "c", "d"] or len(picked) == 3


@pytest.mark.parametrize("kind", ["diag", "spherical", "tied", "full"])
def test_mixture_likelihood_rises(spark, kind):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(m, 0.3, (60, 2)) for m in ((0, 0), (4, 4))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    m = learning.DiagonalMixture(2, kind, starts=1, iterations=12).fit(df, ["a", "b"])
    assert all(b >= a - 1e-6 for a, b in zip(m.history, m.history[1:], strict=False))
    p = m.transform(df, ["a", "b"]).first().probabilities
    assert sum(p) == pytest.approx(1)


def test_weak_labels_gate(spark):
    c = spark.createDataFrame([("s", "r", 0.96, 0.6, 3.0, 0.7), ("s", "r", 0.94, 0.6, 3.0, 0.7), ("s", "r", 0.96, 0.6, 3.0, 0.05), ("s", "q", 0.96, 0.6, 3.0, 0.7), ("s", "r", 0.96, 0.6, 0.5, 0.7)], "slide string, region string, p53_mapped_fraction double, p53_tissue_fraction double, p53_equivalent_radius_um double, p53_positive_fraction double")
    review = spark.createDataFrame([("s", True, 0.2, "same_section", 0.6, 0.1)], "slide string, registration_approved boolean, dab_threshold double, section_relationship string, positive_fraction double, negative_fraction double")
    regions = spark.createDataFrame([("s", "r", "True", "1.0"), ("s", "q", "True", "nan")], "slide string, region string, approved string, max_registration_error_um string")
    assert [r.p53_label for r in labels.weak_labels(c, review, regions).collect()].count(1) == 1
    with pytest.raises(relational.ContractError):
        labels.validate_review({"registration_approved": True})


def test_sampling_keeps_regions_whole(spark):
    rows = [(r, "A" if r % 2 else "B", i) for r in range(10) for i in range(5)]
    df = spark.createDataFrame(rows, "region int, cls string, id int")
    got = ranking.sample_regions(df, ["region"], "cls", ["A", "B"], 12, 7)
    n = {(r.region, r.cls): r["count"] for r in got.groupBy("region", "cls").count().collect()}
    assert set(n.values()) == {5} and sum(v for (_, c), v in n.items() if c == "A") == 15
    with pytest.raises(relational.ContractError):
        ranking.sample_regions(df, ["region"], "cls", ["A"], 99, 7)


def test_folds_keep_groups_whole(spark):
    f = ranking.group_folds(spark.createDataFrame([(g,) for g in range(7) for _ in range(g + 1)], "g int"), "g", 3)
    assert f.count() == 7 and {r.fold for r in f.collect()} == {0, 1, 2}


def test_single_class_has_no_auc(spark):
    r = learning.binary_metrics(spark.createDataFrame([(1, 0.4), (1, 0.9)], "y int, s double"), "y", "s", 0.5).first()
    assert r.roc_auc is None and r.specificity is None and r.balanced_accuracy is None and r.precision == 1.0


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<A><Region Text=" Tumor, 1 " Type="0"><Vertices><Vertex X="4" Y="8"/><Vertex X="8.5" Y="8"/><Vertex X="4" Y="16"/></Vertices></Region><Region Text="" Type="0"><Vertices><Vertex X="0" Y="0"/><Vertex X="4" Y="0"/><Vertex X="0" Y="4"/></Vertices></Region><Region Text="x"/></A>')
    got = readers.annotations(spark, str(tmp_path / "a.xml")).collect()
    assert [r.region for r in got] == ["Tumor_1", "Region_2"] and got[0].points[1] == [2.125, 2.0]
    (tmp_path / "cells.json").write_text(json.dumps({"cells": [{"centroid": [2.5, 3.5], "contour": [[0, 0], [1, 0], [1, 1]], "type": 2, "type_prob": 0.9}, {"centroid": [1], "contour": [[0, 0]], "type": None}], "type_map": {"2": "immune"}}))
    c = readers.segmenter(spark, str(tmp_path / "cells.json")).orderBy("pos").collect()
    assert c[0].centroid == [2, 4] and c[0].type_name == "immune" and c[1].centroid is None and c[1].type_name == "background" and c[1].contour is None
    (tmp_path / "m.json").write_text(json.dumps({"pairs": [{"pair_id": "p-1", "he_slide": "a"}, {"pair_id": "p 2", "he_slide": "b"}]}))
    with pytest.raises(relational.ContractError):
        readers.manifest(spark, str(tmp_path / "m.json"))
    writers.template(spark, {"a": 1}, str(tmp_path / "t"))
    writers.template(spark, {"a": 2}, str(tmp_path / "t"))
    assert '"a": 1' in "".join(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
    with pytest.raises(ValueError):
        writers.json_value(spark, {"a": float("nan")}, str(tmp_path / "u"))
    df = spark.createDataFrame([("s1", "r", 1, 2.0), ("s2", "r", 1, 3.0)], "slide string, region string, cell_label long, f double")
    writers.by_slide(df, str(tmp_path / "p"), ["slide", "region", "cell_label"])
    assert spark.read.parquet(str(tmp_path / "p")).filter("slide = 's2'").first().f == 3.0
    assert readers.preferred_files(["a_cell_features.csv", "all_cell_features.csv", "a_features_cleaned.csv"]) == ["a_cell_features.csv"]


def test_otsu_last_maximum_wins(spark):
    px = spark.createDataFrame([("r", v) for v in [10] * 5 + [20] * 5], "region string, v int")
    assert raster.histogram_threshold(px, ["region"], "v").first().threshold == 19


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "a")], "region string, type string")
    df.write.parquet(str(tmp_path / "in"))
    q = counts.pivoted_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["region"], "type", ["a", "b", "c"]).writeStream.outputMode("complete").format("memory").queryName("pivoted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("pivoted").collect()} == {("r1", 1, 1, 0), ("r2", 1, 0, 0)}


def test_runs_compose(spark):
    from lamella.plans import runs

    rng = np.random.default_rng(0)
    rows = [(f"s{s}", f"r{r}", i + 1, float(x), float(y), float(a), "A" if s else "B") for s in range(2) for r in range(2) for i, (x, y, a) in enumerate(rng.random((20, 3)) * 300)]
    c = spark.createDataFrame(rows, "slide string, region string, cell_label long, cx_roi double, cy_roi double, orientation double, roi_class string")
    f = runs.spatial_features(c, 0.5)
    assert f.count() == 80 and {"nn_distance_mean_um", "local_density_r20um", "voronoi_area_um2", "epithelial_layer_thickness_um"} <= set(f.columns)
    cleaned, chosen = runs.clean(f, {"cell_label"}, 6, 4, 2)
    assert 1 <= len(chosen) <= 6 and cleaned.count() == 80


NAN, INF = float("nan"), float("inf")


def test_nan_is_unknown_everywhere(spark):
    cols = "p53_mapped_fraction double, p53_tissue_fraction double, p53_equivalent_radius_um double, p53_positive_fraction double"
    good = (1.0, 1.0, 5.0, 0.9)
    rows = [("s", "r", *good)] + [("s", "r", *(bad if i == k else v for i, v in enumerate(good))) for k in range(4) for bad in (NAN, INF, None)] + [("s", "r", NAN, NAN, NAN, NAN)]
    c = spark.createDataFrame(rows, f"slide string, region string, {cols}")
    review = spark.createDataFrame([("s", True, 0.2, "same_section", 0.6, 0.1)], "slide string, registration_approved boolean, dab_threshold double, section_relationship string, positive_fraction double, negative_fraction double")
    regions = spark.createDataFrame([("s", "r", "True", "1.0")], "slide string, region string, approved string, max_registration_error_um string")
    assert sorted(r.p53_label for r in labels.weak_labels(c, review, regions).collect()) == [-1] * (len(rows) - 1) + [1]
    df = spark.createDataFrame([(NAN, 1.0), (1.0, NAN), (1.0, 2.0), (None, 2.0), (1.0, INF)], "a double, b double")
    assert [r[0] for r in df.select(X.crowded(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1.0, 0.0, 1.0]
    assert [r[0] for r in df.select(X.apoptotic(F.lit(10), F.lit(1.0), F.col("a"), F.col("b"))).collect()] == [None, None, 1.0, None, None]
    assert [r[0] for r in df.select(X.missing_fraction(["a", "b"])).collect()] == [0.5, 0.5, 0.0, 0.5, 0.0]


def test_unknown_places_have_no_neighbours(spark):
    a = spark.createDataFrame([("r", 1, 0.0, 0.0), ("r", 2, INF, 0.0), ("q", 3, 0.0, 0.0), ("q", 4, 1.0, 0.0), ("q", 5, NAN, 1.0), ("q", 6, 0.0, 1.0)], "region string, id long, x double, y double")
    near = {r.id: r.other for r in spatial.capped_nearest(a, a.withColumn("id", F.col("id") + 10), ["region"], 2.0).collect()}
    assert set(near.values()) == {None}  # both groups have a point of unknown place
    assert {(r.id, r.other) for r in spatial.within_radius(a, a, ["region"], 1.1).collect()} == {(3, 4), (4, 3), (3, 6), (6, 3)}
    k = spatial.k_nearest(a, ["region"], 2).collect()
    assert {r.id for r in k} == {3, 4, 6} and {r.other for r in k} == {3, 4, 6}
    f = {r.id: r.neighbor_count for r in spatial.radius_features(a, ["region"], 1.1).collect()}
    assert f == {1: 0.0, 2: None, 3: 2.0, 4: 1.0, 5: None, 6: 1.0}


def test_tissue_is_judged_on_mapped_pixels(spark):
    rows = [("a", 1, 0.5, True, True), ("a", 1, 0.7, True, True), ("a", 1, 9.0, False, False), ("a", 1, 9.0, False, True), ("a", 2, 1.0, False, True)]
    p = spark.createDataFrame(rows, "region string, label long, v double, m boolean, t boolean")
    got = {r.label: r for r in relational.pixel_sums(p, ["region", "label"], "v", "m", "t", 0.6).collect()}
    assert (got[1].tissue_fraction, got[1].mapped_fraction, got[1].positive_fraction, got[1]["mean"]) == (1.0, 0.5, 0.5, pytest.approx(0.6))
    assert (got[2].tissue_fraction, got[2].mapped_fraction, got[2].positive_fraction, got[2]["mean"], got[2]["std"]) == (0.0, 0.0, None, None, None)


def test_region_names_of_any_script(spark):
    names = [" Läsion 1 ", "日本", "a\tb", "x\u200by", "tube (left)", "\u00a0", None, "a/b", "_-_", "e\u0301"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(X.region_name(F.col("n"), F.lit(4))).collect()]
    assert got == ["Läsion_1", "日本", "ab", "xy", "tube_left", "Region_5", "Region_5", "ab", "_-_", "e"]


def test_cross_validation_computes_features_once_and_trains_on_all_cores(spark, monkeypatch):
    seen, parts = spark.sparkContext.accumulator(0), []

    @F.udf("double")
    def feature(v):
        seen.add(1)
        return float(v)

    class Watched:
        def __init__(self, own):
            self.own = own

        def fit(self, df):
            parts.append(df.rdd.getNumPartitions())
            return self.own.fit(df)

    plain = learning.forest
    monkeypatch.setattr(learning, "forest", lambda *a, **kw: Watched(plain(*a, trees=3, depth=3, **kw)))
    df = spark.range(120).select("id", (F.col("id") % 4).alias("g"), feature("id").alias("f"), (F.col("id") % 3 == 0).cast("double").alias("y"))
    out, notes = learning.cross_validate(df, ["f"], "g", "y", 2)
    assert out.count() == 120 and [n["evaluated"] for n in notes] == [True, True]
    assert seen.value == 120 and parts == [spark.sparkContext.defaultParallelism] * 2
