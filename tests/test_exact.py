"""Results that must not hang on rounding or on the order of rows."""

import math

import numpy as np
import pyarrow as pa
import pytest

from lamella import queries as Q
from lamella.functions import statistics as S
from lamella.operators import geometry, grouped, learning, masks, ranking, raster, spatial


def test_halves_of_an_exact_scale_round_to_even(spark, tmp_path):
    rows = [(1, 40, 8.0), (4, 16, 940.8), (5, 28, 999.6)] + [(10 + s, s, (k + 0.5) * s * s / 100) for s in range(10, 51, 10) for k in (2, 3)] + [(2, 5, 7.0), (3, None, 7.0)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r.p_partkey, r.pixels) for r in Q.QUERIES["threshold_um2"](spark, str(tmp_path)).collect())
    assert got == sorted([(1, 1), (2, 200), (3, 200), (4, 368), (5, 128)] + [(10 + s, k) for s in range(10, 51, 10) for k in (2, 4)])


def test_a_square_lies_at_the_fixed_angle_whatever_the_order(spark):
    px = [(i, r, c) for i in range(6) for r in range(40) for c in range(40)]
    df = spark.createDataFrame(px, "label int, row long, col long")
    for parts in (1, 7):
        got = raster.region_properties(df.repartition(parts), ["label"]).collect()
        assert [(r.orientation, r.eccentricity) for r in got] == [(-math.pi / 4, 0.0)] * 6


def test_points_of_unknown_place_have_no_edges_and_no_area(spark):
    odd = [None, math.nan, math.inf]
    square = [(g, i, float(x), float(y)) for g in ("p", None) for i, (x, y) in enumerate([(0, 0), (2, 0), (0, 2), (2, 2), (1, 1)])]
    lost = [(g, 10 + i, v, 1.0) for g in ("p", "q") for i, v in enumerate(odd)] + [("p", 20, 1.0, None)]
    df = spark.createDataFrame(square + lost, "region string, id long, x double, y double")
    edges = {(r.region, r.a, r.b) for r in geometry.region_graph(df, ["region"]).collect()}
    assert edges == {(g, a, b) for g in ("p", None) for a, b in [(0, 1), (0, 2), (1, 3), (2, 3), (0, 4), (1, 4), (2, 4), (3, 4)]}
    area = {(r.region, r.id): r.voronoi_area_px2 for r in geometry.region_voronoi(df, ["region"]).collect()}
    assert len(area) == df.count() and {k: v for k, v in area.items() if v is not None} == {("p", 4): 2.0, (None, 4): 2.0}


def test_groups_stay_whole_across_batches(spark):
    sizes = {None: 5, 1: 1, 2: 23, 3: 7, 4: 10}
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g int, i int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        work = lambda t, heads: {"g": t["g"].take(pa.array(heads[:-1])), "n": pa.array(np.diff(heads))}
        got = [(r.g, r.n) for r in grouped.by_group(df, ["g"], ["i"], work, "g int, n long").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted(sizes.items(), key=str)


@pytest.mark.parametrize("whole", [1024, 0])
def test_k_nearest_with_many_copies_of_a_place(spark, whole):
    rng = np.random.default_rng(3)
    places = rng.integers(0, 12, (60, 2)).astype(float)
    xy = np.concatenate([places[rng.integers(0, 60, 500)], rng.random((100, 2)) * 40])
    df = spark.createDataFrame([("r", i, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [("one", 0, 1.0, 1.0), ("two", 1, -0.0, 1.0), ("two", 2, 0.0, 1.0), (None, 1, 1.0, 1.0), (None, 2, 1.0, 1.0)], "region string, id long, x double, y double")
    got = {(r.region, r.id, r["rank"]): r.other for r in spatial.k_nearest(df, ["region"], 6, per_cell=4, whole=whole).collect()}
    d = np.sqrt((xy[:, None, 0] - xy[None, :, 0]) ** 2 + (xy[:, None, 1] - xy[None, :, 1]) ** 2)
    np.fill_diagonal(d, np.inf)
    want = {("r", i, j + 1): int(o) for i in range(len(xy)) for j, o in enumerate(np.argsort(d[i], kind="stable")[:6])}
    assert got == want | {("two", 1, 1): 2, ("two", 2, 1): 1}


def test_copies_of_a_place_are_not_paired(spark, monkeypatch):
    """The places' rows do not grow with the copies of a place."""
    seen = []
    monkeypatch.setattr(spatial, "stored", lambda df, tag: seen.append((tag, df.persist())) or df)
    df = spark.range(4000).selectExpr("'r' AS region", "id", "CAST(id % 4 AS double) AS x", "0.0D AS y")
    assert spatial.k_nearest(df, ["region"], 3).count() == 12000
    spots = next(x for tag, x in seen if tag == "spots")
    assert spots.count() == 4 and spots.selectExpr("max(size(ids))").first()[0] == 4


def test_polygons_are_filled_a_batch_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(masks, "PIXELS", 7)
    one = [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]]
    rows = [(1, one, 10, 10), (2, one[:2], 10, 10), (3, [[1.5, -2.0], [9.0, 0.5], [1.5, 3.0]], 6, 2), (4, [*one[:3], [math.nan, 3.0]], 10, 10), (5, one[:2] + one, 3, 10)]
    df = spark.createDataFrame(rows, "id int, points array<array<double>>, width int, height int").coalesce(1)
    got = [(r.id, r.row, r.col) for r in masks.filled(df, ["id"]).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(1, r, c) for r in range(4) for c in range(5)} | {(3, r, c) for r in (0, 1) for c in range(2, 6)} | {(5, r, c) for r in range(4) for c in range(3)}


def test_numbers_in_ranges_go_on_from_range_to_range(spark):
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, 'a', IF(id % 3 = 1, 'b', NULL)) AS g", "(id * 7919) % 3000 AS pos")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = ranking.number_in_ranges(df, ["g"], ["pos"], "n").toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for _, own in got.groupby("g", dropna=False):
        assert own.sort_values("pos")["n"].tolist() == list(range(1, 1001))


@pytest.mark.parametrize("few", [64, 1])
def test_mixture_starts_share_their_passes(spark, monkeypatch, few):
    monkeypatch.setattr(learning, "FEW_PARTS", few)
    passes = []
    sufficient = learning._sufficient
    monkeypatch.setattr(learning, "_sufficient", lambda runs, full: passes.append(len(runs)) or sufficient(runs, full))
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(6, 0.5, (40, 2))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double").repartition(3)
    m = learning.DiagonalMixture(2, starts=3, iterations=40).fit(df, ["a", "b"])
    assert passes[0] == 3 and len(passes) <= 40 and passes == sorted(passes, reverse=True)
    assert sorted(m.weights) == pytest.approx([0.4, 0.6], abs=0.03)
    # the history is that of plain EM from the same state
    logs = learning._log_density(x, m.weights, m.means, m.covariances, False)
    top = logs.max(1, keepdims=True)
    assert float((np.log(np.exp(logs - top).sum(1, keepdims=True)) + top).mean()) == pytest.approx(m.log_likelihood, abs=1e-2)
    p = np.array([r[0] for r in m.transform(df, ["a", "b"]).select("probabilities").collect()])
    assert p.sum(1) == pytest.approx(1)


def test_percentiles_of_large_groups_come_from_counts(spark):
    values = [("a", float(v)) for v in [3, 1, 2, 2, 10, 7]] + [(None, 4.0), (None, 5.0), ("b", None), ("b", math.nan), ("c", math.inf), ("c", 6.0)]
    df = spark.createDataFrame(values, "g string, v double").repartition(4)
    rows = learning.nine_number_table(df, ["g"], "v", "v")
    want = {r.g: tuple(r) for r in df.groupBy("g").agg(*S.nine_numbers("v", "v")).collect()}
    got = {r.g: tuple(r) for r in rows.collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], nan_ok=True) for g in ("a", None, "c")) and got["b"] == want["b"]
    assert "percentile" not in rows._jdf.queryExecution().toString()


def test_ranks_looked_up_equal_ranks_in_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(a), float(b), float(-a * a)) for a, b in zip(rng.integers(-3, 4, 200), rng.random(200), strict=True)], "a int, b double, c double")
    one = learning.spearman_matrix(df, ["a", "b", "c"])
    monkeypatch.setattr(learning, "JOINED", 0)
    assert one == pytest.approx(learning.spearman_matrix(df, ["a", "b", "c"]))
