"""Masks and cell measurements against plain numpy, and the checks of readers and labels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import expressions as X
from lamella.operators import cellular, geometry, labels, masks, relational
from lamella.sources import readers, writers

BY = ["region"]


def pixels(spark, array, name="v", region="a"):
    rows = [(region, r, c, int(array[r, c])) for r in range(array.shape[0]) for c in range(array.shape[1])]
    return spark.createDataFrame(rows, f"region string, row long, col long, {name} int")


def as_mask(df, shape):
    out = np.zeros(shape, bool)
    for r in df.collect():
        out[r["row"], r["col"]] = True
    return out


def shifted(mask, offsets, outside):
    """For each offset, the mask seen from there."""
    h, w = mask.shape
    for a, b in offsets:
        out = np.full((h, w), outside)
        for r in range(h):
            for c in range(w):
                if 0 <= r + a < h and 0 <= c + b < w:
                    out[r, c] = mask[r + a, c + b]
        yield out


def grown(mask, offsets):
    return np.any(list(shifted(mask, offsets, False)), axis=0)


def shrunk(mask, offsets, outside):
    return np.all(list(shifted(mask, offsets, outside)), axis=0)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    return geometry.box_mean(rng.random((24, 30)), 5) > 0.5


def test_components_equal_numpy(spark, blobs):
    df = pixels(spark, blobs).filter("v = 1")
    got = {(r["row"], r["col"]): r["component"] for r in masks.components(df, BY).collect()}
    want = geometry.label_components(blobs)
    first = {}
    for r, c in zip(*np.nonzero(blobs), strict=True):
        first.setdefault(want[r, c], (int(r) << 32) + int(c))
    assert got == {(int(r), int(c)): first[want[r, c]] for r, c in zip(*np.nonzero(blobs), strict=True)}
    corner = np.array([[1, 0, 1], [0, 1, 0]])
    assert len({r["component"] for r in masks.components(pixels(spark, corner).filter("v = 1"), BY, diagonal=True).collect()}) == 1
    snake = np.zeros((15, 15), int)  # one component that winds through all rows
    snake[::2] = 1
    snake[1::4, -1] = snake[3::4, 0] = 1
    assert len({r["component"] for r in masks.components(pixels(spark, snake).filter("v = 1"), BY).collect()}) == 1
    assert masks.components(df.filter("false"), BY).count() == 0


def test_morphology_of_masks_equals_numpy(spark, blobs):
    image = pixels(spark, blobs)
    df, shape = image.filter("v = 1"), blobs.shape
    sq, el = masks.square(1), masks.ellipse(2)
    assert (as_mask(masks.dilate(df, BY, el, image), shape) == grown(blobs, el)).all()
    assert (as_mask(masks.erode(df, BY, sq), shape) == shrunk(blobs, sq, False)).all()
    assert (as_mask(masks.erode(df, BY, el, image), shape) == shrunk(blobs, el, True)).all()
    assert (as_mask(masks.close(df, BY, 1, image), shape) == shrunk(grown(blobs, sq), sq, False)).all()
    background = geometry.label_components(~blobs)
    edge = set(np.concatenate([background[0], background[-1], background[:, 0], background[:, -1]]).tolist())
    assert (as_mask(masks.fill_holes(df, BY, image), shape) == (blobs | ~np.isin(background, [*edge, 0]) & ~blobs)).all()


def test_windows_equal_numpy(spark):
    v = np.random.default_rng(5).integers(0, 200, (13, 17))
    df = pixels(spark, v)
    got = {(r["row"], r["col"]): r["m"] for r in masks.box_mean(df, BY, {"m": F.col("v")}, 5).collect()}
    p = np.pad(v.astype(float), 2, mode="reflect")
    assert all(got[r, c] == pytest.approx(p[r : r + 5, c : c + 5].mean()) for r in range(13) for c in range(17))
    got = {(r["row"], r["col"]): r["v"] for r in masks.median3(df, BY, "v").collect()}
    p = np.pad(v, 1, mode="edge")
    assert all(got[r, c] == np.median(p[r : r + 3, c : c + 3]) for r in range(13) for c in range(17))


def otsu(values):
    best, at = -1.0, 0
    hist = np.bincount(values[values > 0], minlength=256).astype(float)
    for t in range(256):
        a, b = hist[: t + 1].sum(), hist[t + 1 :].sum()
        if a and b:
            spread = a * b * ((hist[: t + 1] * np.arange(t + 1)).sum() / a - (hist[t + 1 :] * np.arange(t + 1, 256)).sum() / b) ** 2
            if spread >= best - 1e-9 * abs(best):
                best, at = max(best, spread), t
    return at


def test_epithelium_equals_numpy(spark):
    rng = np.random.default_rng(9)
    shape = (30, 34)
    smooth = geometry.box_mean(rng.random(shape), 7)
    hem = np.clip((smooth - smooth.min()) / np.ptp(smooth) * 255, 0, 255).astype(int)
    red, green, blue = (rng.integers(60, 255, shape) for _ in range(3))
    keep = np.zeros(shape, bool)
    keep[2:-3, 3:-2] = True
    rows = [("a", r, c, int(red[r, c]), int(green[r, c]), int(blue[r, c]), int(hem[r, c])) for r in range(shape[0]) for c in range(shape[1])]
    image = spark.createDataFrame(rows, "region string, row long, col long, r int, g int, b int, hem int")
    p = masks.EPITHELIUM | {"expand": 2}
    got = as_mask(masks.epithelium(image, pixels(spark, keep).filter("v = 1"), BY, 2.0, p), shape)

    dark = np.where(keep, 255 - hem, 0)
    pad = np.pad(dark, 1, mode="edge")
    dark = np.array([[int(np.median(pad[r : r + 3, c : c + 3])) for c in range(shape[1])] for r in range(shape[0])])
    at = otsu(dark.ravel())
    share = (dark[keep] < at).mean()
    top, low = np.max([red, green, blue], 0), np.min([red, green, blue], 0)
    saturation = np.rint(255 * (top - low) / np.maximum(top, 1))
    m = keep & ((abs(share - p["centre"]) < p["window"]) | (dark < at)) & (saturation >= p["saturation"])
    m = geometry.keep_large(m, round(25 / 4))
    m = grown(m, masks.ellipse(2)) & keep
    parts = geometry.label_components(m)
    sizes = np.bincount(parts.ravel())[1:]
    kept, total = [], 0
    for i in np.argsort(-sizes, kind="stable"):
        if total >= p["keep"] * sizes.sum():
            break
        kept.append(i + 1)
        total += sizes[i]
    m = geometry.keep_large(np.isin(parts, kept), round(25 / 4))
    m = shrunk(m, masks.ellipse(1), True) & m
    background = geometry.label_components(~m)
    edge = set(np.concatenate([background[0], background[-1], background[:, 0], background[:, -1]]).tolist())
    m = m | (~np.isin(background, [*edge, 0]) & ~m)
    m = shrunk(grown(m, masks.square(1)), masks.square(1), False)
    m = grown(shrunk(m, masks.square(2), False), masks.square(2))
    assert 0 < m.sum() and (got == m).all()


# --- cells ---------------------------------------------------------------------------------------------------------------


def disc(radius, size):
    y, x = np.mgrid[:size, :size]
    return (y - size // 2) ** 2 + (x - size // 2) ** 2 <= radius * radius


def test_shape_numbers_of_known_forms():
    names = [*cellular.SHAPES, *[f"h{i}" for i in range(10)]]
    d = dict(zip(names, cellular.shape_numbers(disc(20, 50), 10), strict=True))
    assert d["perimeter_px"] == pytest.approx(2 * math.pi * 20, rel=0.05) and d["solidity"] > 0.95 and d["concavity_count"] == 0
    square = np.zeros((20, 20), bool)
    square[4:16, 5:17] = True
    s = dict(zip(names, cellular.shape_numbers(square, 10), strict=True))
    assert s["convex_hull_area_px"] == 144 and s["solidity"] == 1 and s["convexity"] == pytest.approx((44 + 4 * math.sqrt(0.5)) / 44) and s["perimeter_px"] == 44  # no concavity: the contour's hull
    cross = np.zeros((21, 21), bool)
    cross[8:13, 1:20] = cross[1:20, 8:13] = True
    assert cellular.shape_numbers(cross, 10)[4] == 4
    two = np.zeros((9, 20), bool)
    two[1:3, 1:3] = two[2:8, 8:18] = True
    assert geometry.area_of(geometry.longest_contour(two)) == 60 - 0.5  # the longest contour counts; its corners are cut
    assert geometry.area_of(geometry.border_chain(two)) == 9 * 5


def test_shape_rules_of_boxes_and_small_cells():
    d = dict(zip(cellular.SHAPES, cellular.shape_numbers(disc(9, 19), 0), strict=True))
    assert d["fractal_dimension_boundary"] == pytest.approx(0.953, abs=5e-4)  # boxes of 2, 4 and 8
    hull = geometry.convex_hull(geometry.border_chain(disc(9, 19)))
    assert d["convexity"] == pytest.approx(geometry.length_of(hull) / d["perimeter_px"]) and d["concavity_count"] == 0
    full = dict(zip(cellular.SHAPES, cellular.shape_numbers(np.ones((5, 5), bool), 0), strict=True))
    assert math.isnan(full["fractal_dimension_boundary"]) and math.isnan(full["convexity"])  # no contour in its own box
    assert full["convex_hull_area_px"] == 25 and full["solidity"] == 1
    assert cellular.perimeter(np.ones((1, 1), bool)) == 0
    angle = np.zeros((12, 12), bool)
    angle[:, :4] = angle[8:] = True
    count, depth = cellular.shape_numbers(angle, 0)[4:6]
    assert count == 1 and depth == pytest.approx(7 / math.sqrt(2), abs=1 / 256)
    assert [cellular.ring_width(m) for m in (0.2215, 0.25, 0.8, 5.0)] == [9, 8, 2, 1]


def by_squares(values, level):
    """All segments of the half-level lines, square by square, as sets of two rounded points."""
    h, w = values.shape
    out = set()
    for r in range(h - 1):
        for c in range(w - 1):
            q = [(r, c), (r, c + 1), (r + 1, c + 1), (r + 1, c)]
            cross = []
            for i in range(4):
                (r0, c0), (r1, c1) = q[i], q[(i + 1) % 4]
                a, b = values[r0, c0], values[r1, c1]
                cross.append((round(c0 + (c1 - c0) * (level - a) / (b - a), 9), round(r0 + (r1 - r0) * (level - a) / (b - a), 9)) if (a > level) != (b > level) else None)
            there = [i for i in range(4) if cross[i]]
            if len(there) == 2:
                out.add(frozenset(cross[i] for i in there))
            elif len(there) == 4:  # high corners are cut off one by one
                for k in range(4):
                    if values[q[k]] > level:
                        out.add(frozenset((cross[k], cross[k - 1])))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_half_contours_are_the_segments_chained(seed):
    rng = np.random.default_rng(seed)
    values = rng.random((9, 11)) if seed % 2 else (geometry.box_mean(rng.random((24, 30)), 5) > 0.5).astype(float)
    chains = geometry.half_contours(values)
    segments = [frozenset(map(tuple, np.round(c[i : i + 2], 9).tolist())) for c in chains for i in range(len(c) - 1)]
    assert len(segments) == len(set(segments)) and set(segments) == by_squares(values, 0.5)
    for c in chains:
        if len(c) > 2 and (c[0] != c[-1]).any():  # an open chain ends at the image's edge
            for x, y in (c[0], c[-1]):
                assert x in (0, values.shape[1] - 1) or y in (0, values.shape[0] - 1)
    assert geometry.half_contours(np.ones((4, 4))) == [] and geometry.half_contours(np.zeros((1, 5))) == []


def lbp_by_hand(v, mask):
    h, w = v.shape
    at = lambda r, c: v[r, c] if 0 <= r < h and 0 <= c < w else 0.0
    bins = np.zeros(10)
    for r, c in zip(*np.nonzero(mask), strict=True):
        bits = []
        for k in range(8):
            y, x = r + round(-math.sin(k * math.pi / 4), 5), c + round(math.cos(k * math.pi / 4), 5)
            y0, x0 = math.floor(y), math.floor(x)
            y1, x1 = math.ceil(y), math.ceil(x)
            top, low = (1 - (x - x0)) * at(y0, x0) + (x - x0) * at(y0, x1), (1 - (x - x0)) * at(y1, x0) + (x - x0) * at(y1, x1)
            bits.append(int((1 - (y - y0)) * top + (y - y0) * low - v[r, c] >= 0))
        changes = sum(a != b for a, b in zip(bits, bits[1:], strict=False))
        bins[sum(bits) if changes <= 2 else 9] += 1
    return bins / mask.sum()


def test_local_patterns_sample_the_circle(spark):
    from lamella.operators import raster

    v = np.random.default_rng(8).random((14, 15))
    m = disc(6, 15)[:14]
    rows = [("a", r, c, float(v[r, c]), bool(m[r, c])) for r in range(14) for c in range(15)]
    got = raster.local_patterns(spark.createDataFrame(rows, "region string, row long, col long, v double, inside boolean"), BY, "v", "inside").first()
    assert [got[f"lbp_bin_{i}"] for i in range(10)] == pytest.approx(lbp_by_hand(v, m).tolist())


def test_texture_takes_the_stain_reference(spark):
    rng = np.random.default_rng(2)
    m = disc(5, 12)
    rows = [("s", "a", r, c, int(m[r, c]), *(int(x) for x in rng.integers(40, 240, 3))) for r in range(12) for c in range(12)]
    df = spark.createDataFrame(rows, "slide string, region string, row long, col long, label long, r int, g int, b int")
    ref = spark.createDataFrame([("s", [0.6, 0.7, 0.3, 0.1, 0.9, 0.2], [2.0, 1.0])], "slide string, m array<double>, max_c array<double>")
    other = spark.createDataFrame([("t", [0.6, 0.7, 0.3, 0.1, 0.9, 0.2], [2.0, 1.0])], ref.schema)
    both = ["slide", "region"]
    plain, known, without = (cellular.cell_features(df, both, 0.25, s).first() for s in (None, ref, other))
    assert known["haar_ll_energy"] != plain["haar_ll_energy"] and without["haar_ll_energy"] == pytest.approx(plain["haar_ll_energy"])
    from lamella.operators import raster

    want = cellular.texture(raster.od_stain(df, ref), both).first()
    assert known["haar_ll_energy"] == pytest.approx(want["haar_ll_energy"]) and known["hematoxylin_mean"] == pytest.approx(plain["hematoxylin_mean"])


def test_gabor_equals_direct_sum():
    v = np.random.default_rng(2).random((14, 11))
    sigma = math.sqrt(math.log(2) / 2) / math.pi * 3 / 0.3
    r = max(math.ceil(3 * sigma), 1)
    p = np.pad(v, r, mode="symmetric")
    got = geometry.gabor(v, 0.3, math.pi / 4)
    for row, col in [(0, 0), (5, 7), (13, 10)]:
        total = 0j
        for i in range(-r, r + 1):
            for j in range(-r, r + 1):
                u = j * math.cos(math.pi / 4) + i * math.sin(math.pi / 4)
                total += p[row + r - i, col + r - j] * math.exp(-0.5 * (i * i + j * j) / sigma**2) / (2 * math.pi * sigma**2) * complex(math.cos(0.6 * math.pi * u), math.sin(0.6 * math.pi * u))
        assert got[row, col] == pytest.approx(abs(total), rel=1e-9)


def test_texture_of_a_cell(spark):
    size, m = 22, disc(8, 22)
    rng = np.random.default_rng(4)
    v = rng.random((size, size)) * 0.2
    for r, c in ((8, 8), (13, 14)):
        v[r - 1 : r + 2, c - 1 : c + 2] += 2 + 0.1 * r
    rows = [("a", r, c, int(m[r, c]), float(v[r, c])) for r in range(size) for c in range(size)]
    df = spark.createDataFrame(rows, "region string, row long, col long, label long, hematoxylin double")
    tiny = spark.createDataFrame([("b", 0, 0, 1, 1.0), ("b", 0, 1, 1, 2.0)], df.schema)
    got = {r["region"]: r for r in cellular.texture(df.unionByName(tiny), BY).collect()}
    box = np.ix_(m.any(1), m.any(0))
    want = geometry.texture(v[box], m[box])
    for k in want:
        assert got["a"][k] == pytest.approx(want[k], nan_ok=True)
    assert got["a"]["nucleolar_peak_count"] == 2
    assert got["a"]["chromatin_clumping_index"] == pytest.approx(geometry.clumping(v[box], m[box]))
    assert sum(got["a"][f"lbp_bin_{i}"] for i in range(10)) == pytest.approx(1)
    assert got["b"]["glcm_energy"] is None and got["b"]["nucleolar_peak_count"] is None
    levels = cellular.quantised(cellular.crops(df, BY, "hematoxylin"), BY).agg(F.min("q"), F.max("q")).first()
    assert tuple(levels) == (0, 31)


# --- readers and labels --------------------------------------------------------------------------------------------------


def test_files_beside_and_fallbacks(spark):
    cells = spark.createDataFrame([("/x/s1/cells.json",), ("/x/s2/cells.json",)], "source string")
    files = spark.createDataFrame([("/x/s1/cell_detection.json",), ("/x/s2/other.json",)], "path string")
    assert {r.source: r.detection for r in readers.detections(cells, files).collect()} == {"/x/s1/cells.json": "/x/s1/cell_detection.json", "/x/s2/cells.json": None}
    regions = spark.createDataFrame([("s", "A"), ("s", "B")], "slide string, region string")
    files = spark.createDataFrame([(p,) for p in ("/o/region_mask/mask_s_A.tif", "/o/region_rgb/rgb_s_A.tif", "/o/region_rgb/rgb_s_B.tif", "/o/mask/mask_s_B.tif", "/o/rgb/rgb_s_B.tif")], "path string")
    got = {r.region: (r["mask"], r.rgb) for r in readers.region_images(regions, files, "/o").collect()}
    assert got == {"A": ("/o/region_mask/mask_s_A.tif", "/o/region_rgb/rgb_s_A.tif"), "B": ("/o/mask/mask_s_B.tif", "/o/rgb/rgb_s_B.tif")}
    with pytest.raises(relational.ContractError):
        readers.region_images(spark.createDataFrame([("../s", "A")], regions.schema), files, "/o")


def test_landmarks_must_be_finite(spark, tmp_path):
    (tmp_path / "a.csv").write_text("he_x,he_y,p53_x,p53_y,region\n1,2,3,4,R\n")
    assert readers.landmarks(spark, str(tmp_path / "a.csv"), 0.5, 2.0).first().p53_y == 8.0
    (tmp_path / "b.csv").write_text("he_x,he_y,p53_x,p53_y,region\n1,Infinity,3,4,R\n")
    with pytest.raises(relational.ContractError):
        readers.landmarks(spark, str(tmp_path / "b.csv"), 0.5, 2.0)


def test_stale_labels_are_refused(spark):
    measured = spark.createDataFrame([("p1", "r1", "m1", "s1", "A", 1, 1), ("p1", "r1", "m1", "s1", "A", 2, -1)], "pair_id string, registration_id string, patient_id string, slide string, region string, cell_label long, p53_label int")
    schema = "pair_id string, patient_id string, he_slide string, pair_signature string, registered_signature string, registration_id string, review string, region_review_sha256 string"
    good = ("p1", "m1", "s1", "x", "x", "r1", "v", "h")
    done = spark.createDataFrame([("p1", "r1", "v", "h")], "pair_id string, registration_id string, review string, region_review_sha256 string")
    rows = labels.current_weak_labels(measured, spark.createDataFrame([good, ("p2", *good[1:])], schema), done).collect()
    assert sorted((r.cell_label, r.label, r.label_source) for r in rows) == [(1, 1, "p53_staining_weak_label"), (2, -1, "p53_staining_weak_label")]
    for i, other in ((4, "y"), (5, "r2"), (6, "w"), (7, "g"), (1, "m2"), (2, "s2")):
        bad = list(good)
        bad[i] = other
        with pytest.raises(relational.ContractError):
            labels.current_weak_labels(measured, spark.createDataFrame([tuple(bad)], schema), done)


def test_masks_are_written_as_runs(spark, tmp_path, blobs):
    df = pixels(spark, blobs).filter("v = 1").withColumn("slide", F.lit("s"))
    frames = spark.createDataFrame([("s", "a", 2, 5, 6, 30, 24)], "slide string, region string, level int, min_x int, min_y int, width int, height int")
    writers.region_masks(df, frames, ["slide", "region"], str(tmp_path / "masks"))
    back = spark.read.parquet(str(tmp_path / "masks"))
    out = np.zeros(blobs.shape, bool)
    for r in back.collect():
        out[r["row"], r.first_col : r.last_col + 1] = True
        assert r.file == "polyepi_s_a_L2_5_6_30x24.npy"
    assert (out == blobs).all()
    assert back.select(X.mask_name_parts(F.col("file")).alias("p")).first().p.width == 30


def test_vocabulary_and_palette(spark):
    a, b = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int"), spark.createDataFrame([(1, 2)], "y int, w int")
    assert relational.vocabulary([a, b], ["y", "x"]) == (["w", "x", "y", "z"], ["y"])
    many = spark.range(1, 31).select(X.cluster_colour(F.col("id").cast("int"), 30).alias("c")).collect()
    assert len({r.c for r in many}) == 30 and many[0].c == "#ff0000"


@pytest.mark.parametrize("seed", range(3))
def test_level_lines_equal_the_chains_of_one_image(spark, seed):
    from lamella.operators import contours

    rng = np.random.default_rng(seed)
    images = {"a": rng.random((12, 15)), "b": (geometry.box_mean(rng.random((20, 22)), 5) > 0.5).astype(float), "c": np.ones((3, 3))}
    rows = [(n, r, c, float(v[r, c])) for n, v in images.items() for r in range(v.shape[0]) for c in range(v.shape[1])]
    df = spark.createDataFrame(rows, "region string, row long, col long, v double")
    got = {}
    for p in contours.chains(df, BY).orderBy("region", "chain", "pos").collect():
        got.setdefault((p.region, p.chain), []).append((round(p.x, 9), round(p.y, 9)))
    kinds = {(p.region, p.chain): p for p in contours.measures(contours.chains(df, BY), BY).collect()}

    def turned(points):  # closed lines from their least point
        if points[0] != points[-1]:
            return tuple(points)
        ring = points[:-1]
        k = ring.index(min(ring))
        return tuple(ring[k:] + ring[: k + 1])

    for name, v in images.items():
        want = sorted(turned([tuple(x) for x in np.round(c, 9).tolist()]) for c in geometry.half_contours(v))
        assert sorted(turned(p) for (n, _), p in got.items() if n == name) == want
        if want:
            assert max(k.points for k in kinds.values() if k.region == name) == len(geometry.longest_contour(v > 0.5) if name == "b" else max(want, key=len))
    for k in kinds.values():
        xy = np.array(got[k.region, k.chain])
        assert k.closed == bool((xy[0] == xy[-1]).all()) and (k.area is None or abs(k.area) == pytest.approx(geometry.area_of(xy)))
