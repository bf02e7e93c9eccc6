"""Slide pairs: staining through a transform, fits, mutual information, features; and whole cell rows from pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import cellular, features, geometry, pairing, raster, registration, relational, spatial
from lamella.plans import runs

M = list(registration.M)


# --- pairing -------------------------------------------------------------------------------------------------------------


def test_pair_staining_equals_numpy(spark):
    rng = np.random.default_rng(6)
    h, w = 40, 44
    rgb, alpha = rng.integers(0, 256, (h, w, 3)), np.where(rng.random((h, w)) < 0.02, 200, 255)
    labels = np.zeros((30, 34), int)
    for i in range(12):
        labels[2 + 7 * (i // 4) : 7 + 7 * (i // 4), 1 + 8 * (i % 4) : 7 + 8 * (i % 4)] = i + 1
    m, off, he, p53 = (0.9, -0.2, 4.0, 0.15, 1.05, -2.0), (5, 3), (0.5, 0.4), (0.45, 0.5)
    source = spark.createDataFrame([("s", r, c, *map(int, rgb[r, c]), int(alpha[r, c])) for r in range(h) for c in range(w)], "slide string, row long, col long, r int, g int, b int, a int")
    nuclei = spark.createDataFrame([("s", "A", r, c, int(labels[r, c])) for r in range(30) for c in range(34)], "slide string, region string, row long, col long, label long")
    offsets = spark.createDataFrame([("s", "A", *off)], "slide string, region string, off_x long, off_y long")
    pairs = spark.createDataFrame([("s", list(m), list(he), list(p53), w, h, 0.1)], "slide string, m array<double>, he_mpp array<double>, p53_mpp array<double>, width int, height int, dab_threshold double")
    got = {r.cell_label: r for r in pairing.measure(nuclei, source, offsets, pairs, tile=16, side=8).collect()}
    from lamella.functions.expressions import STAINS

    inverse = np.linalg.inv(np.array(STAINS))
    for label in range(1, 13):
        dab, mapped, tissue, n = [], 0, 0, 0
        for r, c in zip(*np.nonzero(labels == label), strict=True):
            n += 1
            x, y = (c + off[0]) * he[0], (r + off[1]) * he[1]
            px, py = (m[0] * x + m[1] * y + m[2]) / p53[0], (m[3] * x + m[4] * y + m[5]) / p53[1]
            if not (0 <= px < w - 1 and 0 <= py < h - 1):
                continue
            sx, sy = round(px * 32), round(py * 32)
            total = np.zeros(4)
            for a in (0, 1):
                for b in (0, 1):
                    weight = (sx % 32 if a else 32 - sx % 32) * (sy % 32 if b else 32 - sy % 32)
                    if weight:
                        total += weight * np.append(rgb[sy // 32 + b, sx // 32 + a], alpha[sy // 32 + b, sx // 32 + a])
            v = np.floor(total / 1024 + 0.5)
            if v[3] != 255:
                continue
            mapped += 1
            dab.append(max(0.0, float((-np.log(np.maximum(v[:3] / 255, 1e-6)) / math.log(1e6)) @ inverse[:, 2])))
            low, high, mean = v[:3].min(), v[:3].max(), v[:3].mean()
            tissue += ((low < 230 and high - low > 10) or mean < 180) and mean > 15
        row = got[label]
        assert row.p53_mapped_fraction == pytest.approx(mapped / n) and row.p53_tissue_fraction == pytest.approx(tissue / max(mapped, 1))
        assert row.p53_equivalent_radius_um == pytest.approx(math.sqrt(n * 0.2 / math.pi))
        if mapped:
            assert row.p53_dab_mean == pytest.approx(np.mean(dab)) and row.p53_dab_std == pytest.approx(np.std(dab), abs=1e-7)
            assert row.p53_positive_fraction == pytest.approx(np.mean(np.array(dab) >= 0.1))
        else:
            assert row.p53_dab_mean is None and row.p53_positive_fraction is None
    assert any(0 < r.p53_mapped_fraction < 1 for r in got.values())
    with pytest.raises(relational.ContractError):
        pairing.measure(nuclei, source, offsets, pairs, tile=16, largest_box=4)
    with pytest.raises(relational.ContractError):
        pairing.measure(nuclei, source, offsets, pairs.withColumn("m", F.array(*[F.lit(float("nan"))] * 6)))


def test_only_pixels_of_asked_tiles_are_read(spark, tmp_path):
    nuclei = spark.createDataFrame([("s", "A", r, c, 1) for r in range(4) for c in range(4)], "slide string, region string, row long, col long, label long")
    source = spark.range(64 * 64).select(F.lit("s").alias("slide"), F.expr("id div 64").alias("row"), (F.col("id") % 64).alias("col"), *[F.lit(120).alias(c) for c in "rgb"], F.lit(255).alias("a"))
    pairing.with_source_tiles(source, 16).write.partitionBy("slide", "source_row", "source_col").parquet(str(tmp_path / "tiles"))
    stored = spark.read.parquet(str(tmp_path / "tiles"))
    offsets = spark.createDataFrame([("s", "A", 20, 36)], "slide string, region string, off_x long, off_y long")
    one = [1.0, 1.0]
    pairs = spark.createDataFrame([("s", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], one, one, 64, 64, 0.1)], "slide string, m array<double>, he_mpp array<double>, p53_mpp array<double>, width int, height int, dab_threshold double")
    places = pairing.mapped_places(nuclei, pairing._frames(offsets, pairs))
    boxes = pairing.source_boxes(places, 512)
    assert [tuple(r)[4:] for r in boxes.collect()] == [(20, 36, 25, 41)]
    assert {tuple(r)[1:] for r in pairing.source_tiles(boxes, 16).collect()} == {(2, 1)}
    out = pairing.warp(places, stored, side=16)
    assert "dynamicpruning" in out._jdf.queryExecution().toString().lower() and out.filter("mapped AND r = 120").count() == 16


def test_region_offsets(spark):
    rows = [("s", "A", 10.0, 4.0, 7.0, 2.0), ("s", "A", 20.04, 14.0, 9.0, 4.0), ("s", "B", 1.0, 1.0, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "slide string, region string, cx_wsi double, cx_roi double, cy_wsi double, cy_roi double")
    assert {tuple(r) for r in pairing.region_offsets(df).collect()} == {("s", "A", 6, 5), ("s", "B", 0, 3)}
    for bad in (9.0, float("nan"), None):
        with pytest.raises(relational.ContractError):
            pairing.region_offsets(df.unionByName(spark.createDataFrame([("s", "B", bad, 1.0, 5.0, 2.0)], df.schema)))


def test_extract_pairs_checks_and_labels(spark):
    nuclei = spark.createDataFrame([("s", "A", r, c, 1 + c // 4) for r in range(8) for c in range(8)], "slide string, region string, row long, col long, label long")
    source = spark.createDataFrame([("s", r, c, 90, 60, 30 if c < 4 else 220, 255) for r in range(20) for c in range(20)], "slide string, row long, col long, r int, g int, b int, a int")
    coords = spark.createDataFrame([("s", "A", k, 2.0, 2.0, 2.0, 2.0) for k in (1, 2, 3)], "slide string, region string, cell_label long, cx_wsi double, cx_roi double, cy_wsi double, cy_roi double")
    one = F.array(F.lit(1.0), F.lit(1.0))
    base = spark.createDataFrame([("s", "p1", "m1", "r1", "same_section", "d", "d", 20, 20, 0.9, 0.0)], "slide string, pair_id string, patient_id string, registration_id string, section_relationship string, pair_signature string, registered_signature string, width int, height int, tissue_dice double, nonpositive_jacobian_fraction double")
    pairs = base.withColumns({"m": F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)]), "he_mpp": one, "p53_mpp": one})
    review = spark.createDataFrame([("s", True, 0.1, 0.6, 0.1)], "slide string, registration_approved boolean, dab_threshold double, positive_fraction double, negative_fraction double")
    regions = spark.createDataFrame([("s", "A", "true", 1.0)], "slide string, region string, approved string, max_registration_error_um double")
    got = {r.cell_label: r for r in pairing.extract_pairs(nuclei, source, coords, pairs, review, regions).collect()}
    assert [got[k].p53_label for k in (1, 2, 3)] == [1, 0, -1] and got[3].p53_mapped_fraction is None and got[1].registration_id == "r1"
    record = pairing.extraction_record(spark.createDataFrame(list(got.values())), False, 2.0).first()
    assert (record.cells, record.labeled_cells) == (3, 2)
    assert pairing.review_template(coords).first().tumor == -1
    for changed in ({"registered_signature": F.lit("x")}, {"tissue_dice": F.lit(0.4)}, {"nonpositive_jacobian_fraction": F.lit(0.1)}, {"slide": F.lit("t")}):
        with pytest.raises(relational.ContractError):
            pairing.extract_pairs(nuclei, source, coords, pairs.withColumns(changed), review, regions)
    with pytest.raises(relational.ContractError):
        pairing.extract_pairs(nuclei, source, coords.unionByName(coords), pairs, review, regions)


# --- registration --------------------------------------------------------------------------------------------------------


def smooth(seed, h, w, size=7):
    v = np.random.default_rng(seed).random((h, w))
    for _ in range(2):
        v = geometry.box_mean(v, size)
    return (v - v.min()) / np.ptp(v)


def bilinear(image, x, y):
    c, r = np.floor(x).astype(int), np.floor(y).astype(int)
    ok = (c >= 0) & (r >= 0) & (c + 1 < image.shape[1]) & (r + 1 < image.shape[0])
    c, r = np.where(ok, c, 0), np.where(ok, r, 0)
    fx, fy = x - c, y - r
    v = (1 - fy) * ((1 - fx) * image[r, c] + fx * image[r, c + 1]) + fy * ((1 - fx) * image[r + 1, c] + fx * image[r + 1, c + 1])
    return v, ok


def table(spark, image, slide="s"):
    return spark.createDataFrame([(slide, r, c, float(image[r, c])) for r in range(image.shape[0]) for c in range(image.shape[1])], "slide string, row long, col long, v double")


def frame(spark, image, spacing=1.0, slide="s"):
    return spark.createDataFrame([(slide, *image.shape, spacing, spacing, 0.0, 0.0)], "slide string, rows long, cols long, sx double, sy double, ox double, oy double")


def test_joint_histogram_equals_numpy(spark):
    f, g, m, bins = smooth(1, 30, 34), smooth(2, 32, 31), (0.97, 0.04, 0.3, -0.05, 1.02, 0.8), 50
    (low_f, step_f), (low_g, step_g) = (((v.min() - 2 * np.ptp(v) / (bins - 4)), np.ptp(v) / (bins - 4)) for v in (f, g))
    y, x = np.mgrid[:30, :34]
    v, ok = bilinear(g, m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5])
    want = np.zeros((bins, bins))
    row = np.clip(np.floor((f - low_f) / step_f), 2, bins - 3).astype(int)
    for r, value in zip(row[ok], v[ok], strict=True):
        t = (value - low_g) / step_g
        for b in range(math.floor(t) - 1, math.floor(t) + 3):
            a = abs(b - t)
            want[r, b] += 2 / 3 - a * a + a**3 / 2 if a < 1 else (2 - a) ** 3 / 6 if a < 2 else 0
    s = table(spark, f).join(registration.bin_range(table(spark, f), bins), "slide")
    s = s.select("slide", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), F.least(F.greatest(F.floor((F.col("v") - F.col("low")) / F.col("step")), F.lit(2)), F.lit(bins - 3)).cast("int").alias("fbin"))
    t = spark.createDataFrame([("s", 0, *m)], "slide string, k int, " + ", ".join(f"{c} double" for c in M))
    h = registration.joint_histogram(registration.warped(s, registration.quads(table(spark, g)), frame(spark, g), t), registration.bin_range(table(spark, g), bins), bins)
    got = np.zeros((bins, bins))
    for r in h.collect():
        got[r.fbin, r.mbin] = r.w
    assert np.abs(got - want).max() < 1e-9 and got.sum() == pytest.approx(ok.sum())
    p = want / want.sum()
    q = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    info = registration.information(h).first()
    assert info.information == pytest.approx((p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum()) and info.n == pytest.approx(ok.sum())


def test_gradient_of_the_information_equals_differences(spark):
    f, g, m = smooth(4, 24, 26, 5), smooth(4, 30, 29, 5), np.array([0.98, 0.03, 1.2, -0.02, 1.01, 0.9])
    s = table(spark, f).join(registration.bin_range(table(spark, f), 12), "slide")
    s = s.select("slide", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), F.least(F.greatest(F.floor((F.col("v") - F.col("low")) / F.col("step")), F.lit(2)), F.lit(9)).cast("int").alias("fbin"))
    quad, bins = registration.quads(table(spark, g)), registration.bin_range(table(spark, g), 12)

    def value(m):
        t = spark.createDataFrame([("s", 0, *map(float, m))], "slide string, k int, " + ", ".join(f"{c} double" for c in M))
        return registration.warped(s, quad, frame(spark, g), t)

    w = value(m)
    ratio = registration.log_ratios(registration.joint_histogram(w, bins, 12)).drop("k")
    z = w.join(bins, "slide").withColumn("t", (F.col("mv") - F.col("low")) / F.col("step")).withColumn("b", F.explode(F.array(*[F.floor("t") + d for d in (-1, 0, 1, 2)]))).withColumn("mbin", F.col("b").cast("int"))
    pull = -registration.spline_slope(F.col("b") - F.col("t")) * F.col("ratio") / F.col("step")
    got = z.join(ratio, ["slide", "fbin", "mbin"]).agg(F.sum(pull * F.col("gx")).alias("x"), F.sum(pull * F.col("gy")).alias("y")).first()
    n = w.count()
    for i, name in ((2, "x"), (5, "y")):
        step = np.eye(6)[i] * 1e-4
        a, b = (registration.information(registration.joint_histogram(value(m + d), bins, 12)).first().information for d in (step, -step))
        assert got[name] / n == pytest.approx((a - b) / 2e-4, rel=0.05, abs=2e-3)


def test_refinement_finds_a_known_transform(spark):
    true = np.array([0.98, -0.05, 2.3, 0.04, 1.01, -1.2])
    g = smooth(3, 64, 60, 9)
    y, x = np.mgrid[:56, :54]
    v, ok = bilinear(g, true[0] * x + true[1] * y + true[2], true[3] * x + true[4] * y + true[5])
    f = np.where(ok, 1 - v**2, 0.5)  # another contrast: correlation alone would not do
    start = spark.createDataFrame([("s", 1.0, 0.0, 3.4, 0.0, 1.0, -2.4)], "slide string, " + ", ".join(f"{c} double" for c in M))
    fixed = table(spark, f).filter("row > 2 AND col > 2")
    got = registration.refine(fixed, frame(spark, f), table(spark, g), frame(spark, g), start, iterations=30, shrink=(2, 1), sampled=1.0).first()
    m = np.array([got[c] for c in M])
    for cx in (0, 53):
        for cy in (0, 55):
            d = (m - true).reshape(2, 3) @ np.array([cx, cy, 1.0])
            assert np.hypot(*d) < 0.5
    assert got.affine_metric < 0 and got.evaluations > 0 and got.affine_stop in ("converged", "iterations")
    away = start.withColumn("m2", F.lit(5000.0))
    assert registration.refine(fixed, frame(spark, f), table(spark, g), frame(spark, g), away, iterations=2, shrink=(1,)).first().affine_stop == "no overlap"


def test_pyramid_means_and_frames(spark):
    v = np.random.default_rng(5).random((11, 9))
    base = spark.createDataFrame([("s", 11, 9, 0.5, 0.25, 0.1, 0.2)], "slide string, rows long, cols long, sx double, sy double, ox double, oy double")
    levels = registration.pyramid(table(spark, v), base, ["v"], (1, 2, 4))
    for k, (level, f) in zip((1, 2, 4), levels, strict=True):
        for r in level.collect():
            assert r.v == pytest.approx(v[r.row * k : r.row * k + k, r.col * k : r.col * k + k].mean())
        q = f.first()
        assert (q.rows, q.cols, q.sx, q.sy) == (-(-11 // k), -(-9 // k), 0.5 * k, 0.25 * k)
        assert q.ox == pytest.approx(0.1 + 0.5 * (k - 1) / 2) and q.oy == pytest.approx(0.2 + 0.25 * (k - 1) / 2)
    assert [registration.level_for([f for _, f in levels], mpp).first().level for mpp in (0.1, 0.5, 1.1, 9.0)] == [0, 0, 1, 2]


def marks(spark, rng, n, wrong, m, slide="s"):
    rows = []
    for i in range(n):
        x, y = map(float, rng.random(2) * 100)
        u, v = m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]
        rows.append((slide, i, x, y, float(u + (500 + i if i < wrong else 0)), float(v)))
    return spark.createDataFrame(rows, "slide string, id long, x double, y double, u double, v double")


def test_consensus_leaves_outliers_and_refuses(spark):
    rng, m = np.random.default_rng(0), (0.9, -0.2, 5.0, 0.1, 1.1, -3.0)
    df = marks(spark, rng, 40, 14, m).unionByName(marks(spark, rng, 5, 0, (1.0, 0, 0, 0, 1.0, 0), "t"))
    fit, points = registration.consensus(df, 0.01, hypotheses=80)
    got = {r.slide: [r[c] for c in M] for r in fit.collect()}
    assert got["s"] == pytest.approx(m) and got["t"] == pytest.approx((1, 0, 0, 0, 1, 0), abs=1e-9)
    assert {r.id for r in points.filter("slide = 's' AND NOT inlier").collect()} == set(range(14))
    with pytest.raises(relational.ContractError, match="mirrors"):
        registration.consensus(marks(spark, rng, 10, 0, (-1.0, 0, 0, 0, 1.0, 0)), 0.01, hypotheses=20)
    line = spark.createDataFrame([("s", i, float(i), 2.0 * i, float(i), float(i)) for i in range(6)], df.schema)
    for bad in (line, df.filter("id < 2"), marks(spark, rng, 10, 0, m).withColumn("u", F.lit(float("nan")))):
        with pytest.raises(relational.ContractError):
            registration.consensus(bad, 0.01, hypotheses=20)


def test_overlap_of_registered_previews(spark):
    def picture(mask):
        return spark.createDataFrame([("s", r, c, *((200, 60, 90) if mask[r, c] else (250, 250, 250))) for r in range(mask.shape[0]) for c in range(mask.shape[1])], "slide string, row long, col long, r int, g int, b int")

    a, b = np.zeros((20, 20), bool), np.zeros((20, 20), bool)
    a[5:10, 4:12] = b[5:10, 7:15] = True
    f = frame(spark, a)
    t = spark.createDataFrame([("s", 1.0, 0.0, 3.0, 0.0, 1.0, 0.0)], "slide string, " + ", ".join(f"{c} double" for c in M))
    assert tuple(registration.tissue_overlap(picture(a), f, picture(b), f, t).first())[1:] == (1.0, 0.0)
    off = registration.tissue_overlap(picture(a), f, picture(b), f, t.withColumn("m2", F.lit(0.0))).first()
    assert off.tissue_dice == pytest.approx(2 * 5 * 5 / 80)


# --- features ------------------------------------------------------------------------------------------------------------


def spots(seed, h, w, n):
    rng, y, x = np.random.default_rng(seed), *np.mgrid[:h, :w]
    out = np.zeros((h, w))
    for _ in range(n):
        r, c, s, a = rng.random() * h, rng.random() * w, 2 + 4 * rng.random(), rng.random() * 0.9 + 0.1
        out += a * np.exp(-((y - r) ** 2 + (x - c) ** 2 * (0.5 + rng.random())) / (2 * s * s))
    return np.clip(out / out.max(), 0, 1)


def test_points_do_not_depend_on_tiles(spark):
    image = spots(1, 70, 90, 60)
    sets = []
    for tile in (32, 128):
        rows = features.octave_points(table(spark, image), 0, tile).collect()
        sets.append({(round(r.row, 6), round(r.col, 6), round(r.angle, 5)): np.frombuffer(r.code, np.uint8).astype(int) for r in rows})
    assert set(sets[0]) == set(sets[1]) and len(sets[0]) > 5
    assert all(np.abs(code - sets[1][k]).max() <= 1 for k, code in sets[0].items())  # places within a tile round differently


def test_a_turned_and_scaled_slide_is_matched(spark):
    g = spots(2, 170, 170, 220)
    angle, scale = 0.35, 1.15
    m = np.array([scale * math.cos(angle), -scale * math.sin(angle), 25.0, scale * math.sin(angle), scale * math.cos(angle), -18.0])
    y, x = np.mgrid[:130, :130]
    v, ok = bilinear(g, m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5])
    f = np.where(ok, v, 0.0)
    got = features.initial_transforms(table(spark, f), frame(spark, f), table(spark, g), frame(spark, g), octaves=2).first()
    for cx, cy in ((30, 30), (100, 40), (60, 110)):
        d = (np.array([got[c] for c in M]) - m).reshape(2, 3) @ np.array([cx, cy, 1.0])
        assert np.hypot(*d) < 1.5
    assert got.method == "features" and got.inliers >= features.LEAST_MATCHES
    other = spots(9, 130, 130, 150)
    with pytest.raises(relational.ContractError):
        features.initial_transforms(table(spark, other), frame(spark, other), table(spark, g), frame(spark, g), octaves=1)
    landmarks = marks(spark, np.random.default_rng(3), 8, 0, m).drop("id")
    given = features.initial_transforms(table(spark, other), frame(spark, other), table(spark, g), frame(spark, g), landmarks).first()
    assert given.method == "landmarks" and [given[c] for c in M] == pytest.approx(m)


# --- whole cell rows -----------------------------------------------------------------------------------------------------


def test_extract_gives_whole_rows(spark):
    rng = np.random.default_rng(12)
    size, mpp = 96, 0.5
    labels = np.zeros((size, size), int)
    y, x = np.mgrid[:size, :size]
    centres = [(r, c) for r in range(12, size, 24) for c in range(12, size, 24)]
    for i, (r, c) in enumerate(centres):
        labels[((y - r) / (9 + i % 2)) ** 2 + ((x - c) / (8 + i % 3)) ** 2 <= 1] = i + 1
    labels[0:4, 60:64] = 40  # a small cell
    px = [("s", "A", r, c, int(labels[r, c]), *(int(v) for v in rng.integers(60, 220, 3))) for r in range(size) for c in range(size)]
    pixels = spark.createDataFrame(px, "slide string, region string, row long, col long, label long, r int, g int, b int")
    area = np.bincount(labels.ravel(), minlength=41)
    cells = [("s", "A", i + 1, float(c), float(r), c + 100.0, r + 50.0, float(area[i + 1])) for i, (r, c) in enumerate(centres)]
    cells[3] = (*cells[3][:3], float("nan"), *cells[3][4:])  # of unknown place in its region
    cells += [("s", "A", 40, 62.0, 2.0, 162.0, 52.0, 16.0), ("s", "A", 41, 1.0, 1.0, 101.0, 51.0, 300.0)]  # too small; without pixels
    coords = spark.createDataFrame(cells, "slide string, region string, cell_label long, cx_roi double, cy_roi double, cx_wsi double, cy_wsi double, area_px double")
    found = [("s", i, c + 100.5, r + 50.0, 1 + i % 3, 0.9) for i, (r, c) in enumerate(centres[:-1])]
    detections = spark.createDataFrame(found, "slide string, id int, x double, y double, type int, type_prob double")
    names = spark.createDataFrame([("s", 1, "Neoplastic"), ("s", 2, "Inflammatory")], "slide string, type int, name string")
    rows = {r.cell_label: r for r in runs.extract(pixels, coords, mpp, detections, names).collect()}
    assert set(rows) == set(range(1, 17))
    kept = pixels.withColumn("label", F.when(F.col("label") == 40, 0).otherwise(F.col("label")))
    own = {r.label: r for r in cellular.cell_features(kept, ["slide", "region"], mpp).collect()}
    place = {i + 1: (float(c), float(r)) for i, (r, c) in enumerate(centres) if i != 3}
    kind = {i + 1: ["Neoplastic", "Inflammatory", "type_3"][i % 3] for i in range(15)}
    for k, row in rows.items():
        assert row.type_name == kind.get(k)
        for c in ("perimeter_um", "convexity", "fourier_h2_amp", "cytoplasm_ring_eosin_mean", "lbp_bin_3", "gabor_f0.15_theta1_std"):
            assert row[c] == (pytest.approx(own[k][c]) if own[k][c] is not None else None)
        assert row.apoptotic_body_proxy in (0.0, None) and row.area_px == area[k]
        if k not in place:
            assert row.nn_distance_min_px is None and row.heterotypic_neighbor_fraction is None and row.nuclear_overlap_crowding_index == 0.0
            continue
        near = sorted((math.hypot(place[k][0] - a, place[k][1] - b), j) for j, (a, b) in place.items() if j != k)[:6]
        assert row.nn_distance_min_px == pytest.approx(near[0][0]) and row.nn_distance_mean_um == pytest.approx(np.mean([d for d, _ in near]) * mpp)
        mine = kind.get(k, "")
        others = [kind.get(j, "") for _, j in near]
        assert row.heterotypic_neighbor_fraction == pytest.approx(np.mean([o != mine and o != "" and mine != "" for o in others]))
        assert row.inflammatory_neighbor_fraction == pytest.approx(np.mean([o == "Inflammatory" for o in others]))
        assert row.nuclear_overlap_crowding_index == float(near[0][0] < math.sqrt(4 * area[k] / math.pi))
        assert row["neighbor_count_r20um"] == sum(math.hypot(place[k][0] - a, place[k][1] - b) <= 40 for j, (a, b) in place.items() if j != k)
        assert row.orientation_coherence_circular_variance == pytest.approx(row.orientation_disorder) and row.voronoi_area_um2 is not False
    lost = coords.withColumn("cx_wsi", F.when(F.col("cell_label") == 5, float("nan")).otherwise(F.col("cx_wsi")))
    typed = runs.assign_types(lost, detections, names)
    assert typed.filter("type IS NOT NULL").count() == 0 and typed.count() == coords.count()


def test_orientation_is_the_main_axis_from_the_rows(spark):
    rows = [("h", 0, c) for c in range(9)] + [("v", r, 0) for r in range(9)] + [("d", i, i) for i in range(9)] + [("u", i, 9 - i) for i in range(9)] + [("p", 3, 3)]
    got = {r.label: r for r in raster.region_properties(spark.createDataFrame(rows, "label string, row long, col long"), ["label"]).collect()}
    assert abs(got["h"].orientation) == pytest.approx(math.pi / 2) and got["v"].orientation == pytest.approx(0)
    assert got["d"].orientation == pytest.approx(math.pi / 4) and got["u"].orientation == pytest.approx(-math.pi / 4)
    assert got["h"].major_axis_length_px == pytest.approx(4 * math.sqrt(80 / 12)) and got["h"].aspect_ratio is None and got["p"].eccentricity == 0
    assert spatial.placed(spark.createDataFrame([("r", 1, 1.0, float("inf"))], "region string, id long, x double, y double")).count() == 0
