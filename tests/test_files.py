"""Readers, writers and runs over files on disk."""

import json

import pytest
from pyspark.sql import functions as F

from lamella.operators.relational import ContractError
from lamella.plans import runs
from lamella.sources import readers, writers

CELLS = "slide,region,cell_label,type,center,contour,cx_roi,cy_roi,cx_wsi,cy_wsi,cx_wsi_um,cy_wsi_um,area_px,a,b,c,d,e,f,g,h"


def test_cell_tables_parse_points_and_push_the_slide_filter(spark, tmp_path):
    row = '{},R1,{},1,"[1.5, 2.0]","[[0, 0], [1, 0], [1, 1]]",1,2,3,4,5,6,99,1,2,3,4,5,6,7,8\n'
    (tmp_path / "c.csv").write_text(CELLS + "\n" + row.format("s1", 1) + row.format("s2", 2))
    got = readers.cell_tables(spark, str(tmp_path / "c.csv"), "s1")
    assert [(r.cell_label, r.center, r.contour[2]) for r in got.collect()] == [(1, [1.5, 2.0], [1.0, 1.0])]
    assert "PushedFilters: [IsNotNull(slide), EqualTo(slide,s1)]" in got._jdf.queryExecution().toString()


def test_feature_tables_default_keys_and_missing_columns(spark, tmp_path):
    (tmp_path / "s9.csv").write_text("cell_label,area,bad\n1,2.5,x\n2,inf,3\n")
    rows = readers.feature_tables(spark, str(tmp_path), ["slide", "region", "cell_label"], ["area", "bad", "absent"]).orderBy("cell_label").collect()
    assert [(r.source_file, r.slide, r.area, r.bad, r.absent) for r in rows] == [("s9.csv", "s9", 2.5, None, None), ("s9.csv", "s9", None, 3.0, None)]
    assert readers.preferred_files(["all_cell_features.csv", "b_features.csv", "a_features.csv", "a_features_cleaned.csv"]) == ["a_features.csv", "b_features.csv"]
    assert readers.preferred_files(["all_cell_features.csv"]) == ["all_cell_features.csv"]


def test_masks_and_slides_by_name(spark, tmp_path):
    for n in ("polyepi_s1_R1_L2_5_6_30x40.npy", "polyepi_s1_R2_L1_5_6_30x40.npy", "other.npy", "B.NDPI", "a.ndpi", "c.svs"):
        (tmp_path / n).write_bytes(b"1")
    assert [(r.slide, r.region, r.width) for r in readers.masks(spark, str(tmp_path)).collect()] == [("s1", "R1", 30)]
    assert [r.slide for r in readers.slides(spark, str(tmp_path)).collect()] == ["B", "a"]


def test_annotation_file_prefers_the_full_name(spark):
    slides = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "slide string")
    files = spark.createDataFrame([("s1.ndpi.xml", "p1"), ("s1.xml", "p2"), ("s2.xml", "p3")], "name string, path string")
    assert {r.slide: r.annotation for r in readers.annotation_files(slides, files).collect()} == {"s1": "p1", "s2": "p3"}


def test_annotated_cells_need_reviewers(spark, tmp_path):
    head = "slide,region,cell_label,patient_id,reviewer,tumor\n"
    (tmp_path / "ok.csv").write_text(head + "s,R,1,p,me,1\ns,R,2,p,,-1\n")
    assert readers.annotated_cells(spark, str(tmp_path / "ok.csv"), "tumor").count() == 2
    for bad in ("s,R,1,p,,1", "s,R,1,,me,1", "s,R,1,p,me,2", "s,R,1,p,me,x"):
        (tmp_path / "bad.csv").write_text(head + bad + "\n")
        with pytest.raises(ContractError):
            readers.annotated_cells(spark, str(tmp_path / "bad.csv"), "tumor")


def test_stain_references_have_their_shape(spark, tmp_path):
    good = {"slide": "s", "m": [1, 2, 3, 4, 5, 6], "max_c": [0, 2], "metadata_json": "{}"}
    (tmp_path / "a.json").write_text(json.dumps(good))
    assert readers.stain_references(spark, str(tmp_path / "a.json")).first().max_c == [1e-9, 2.0]
    (tmp_path / "b.json").write_text(json.dumps(good | {"m": [1]}))
    with pytest.raises(ContractError):
        readers.stain_references(spark, str(tmp_path / "b.json"))


def test_templates_summaries_and_tables(spark, tmp_path):
    writers.manifest_template(spark, str(tmp_path / "m"))
    with pytest.raises(ContractError):
        writers.manifest_template(spark, str(tmp_path / "m"))
    writers.template(spark, {"a": 1}, str(tmp_path / "t"))
    writers.template(spark, {"a": 2}, str(tmp_path / "t"))
    assert json.loads("".join(r[0] for r in spark.read.text(str(tmp_path / "t"), wholetext=True).collect())) == {"a": 1}
    with pytest.raises(ValueError):
        writers.json_value(spark, {"a": float("nan")}, str(tmp_path / "n"))
    cells = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 3)], "slide string, cell_label int")
    s = writers.run_summary(cells, ["x"], spark.createDataFrame([("s2",)], "slide string")).first()
    assert (s.cells, s.total, s.with_reference, s.without_reference, s.features) == ({"s1": 2, "s2": 1}, 3, ["s2"], ["s1"], ["x"])
    writers.by_slide(cells, str(tmp_path / "by"), ["slide", "cell_label"])
    assert spark.read.parquet(str(tmp_path / "by" / "slide=s1")).count() == 2
    writers.csv_table(cells, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["slide", "cell_label"]
    wide = writers.matrix(spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "r string, c string, v double"), "r", "c", "v", ["x", "y"])
    assert [tuple(r) for r in wide.collect()] == [("a", 1.0, 2.0)]


def test_model_is_kept_and_judged_on_unseen_patients(spark, tmp_path):
    from pyspark.ml import PipelineModel

    def cells(patients):
        rows = [(f"s{p}", "R", i + 1, float(i % 2 + p / 100), float(i % 3), f"p{p}", i % 2) for p in patients for i in range(20)]
        return spark.createDataFrame(rows, "slide string, region string, cell_label long, u double, v double, patient_id string, label int")

    keys = ["slide", "region", "cell_label"]
    seen, unseen = cells(range(4)), cells(range(4, 6))
    split = lambda d: (d.select(*keys, "u", "v"), d.select(*keys, "patient_id", "label"))
    model, _, notes = runs.train(*split(seen), ["u", "v"], "label", folds=2, trees=5, depth=3)
    assert notes["absent"] == 0
    writers.model_bundle(model, {"features": ["u", "v"]}, str(tmp_path / "bundle"))
    back = PipelineModel.load(str(tmp_path / "bundle" / "model"))
    features, annotated = split(unseen)
    got = runs.evaluate(back, features, annotated, split(seen)[1], ["u", "v"], "label").collect()
    assert {r.patient_id for r in got} == {"p4", "p5"} and all(r.balanced_accuracy == 1 for r in got)
    with pytest.raises(ContractError):
        runs.evaluate(back, *split(seen), split(seen)[1], ["u", "v"], "label")


def test_clusters_of_sampled_regions(spark):
    rows = [(f"s{g % 2}", f"R{g}", "A" if g % 2 else "B", i, float(g % 2 * 10 + i % 3), float(i % 5)) for g in range(6) for i in range(20)]
    cells = spark.createDataFrame(rows, "slide string, region string, roi_class string, cell_label long, u double, v double")
    out, n, profiles = runs.cluster(cells, ["u", "v"], ["A", "B"], per_class=30, components=2, starts=2, iterations=20)
    rows = out.count()
    assert rows == out.filter("cluster_confidence BETWEEN 0.5 AND 1").count() and {r["count"] for r in out.groupBy("region").count().collect()} == {20}
    assert n.agg(F.sum("C01") + F.sum("C02")).first()[0] == rows >= 60


def test_array_files_become_pixels(spark, tmp_path):
    import numpy as np

    mask = np.zeros((3, 4), np.uint8)
    mask[1, 2] = mask[2, 0] = 1
    np.save(tmp_path / "polyepi_s1_R1_L1_5_6_4x3.npy", mask)
    got = readers.mask_pixels(spark, str(tmp_path), 1).collect()
    assert {(r["row"], r["col"]) for r in got} == {(a, b) for y, x in ((1, 2), (2, 0)) for a in (2 * y, 2 * y + 1) for b in (2 * x, 2 * x + 1)}
    assert {(r.slide, r.region, r.min_x, r.min_y) for r in got} == {("s1", "R1", 10, 12)}
    np.save(tmp_path / "rgb.npy", np.arange(24, dtype=np.uint8).reshape(2, 3, 4))
    files = spark.read.format("binaryFile").load(str(tmp_path / "rgb.npy"))
    px = {(r["row"], r["col"]): (r.r, r.g, r.b) for r in readers.array_pixels(spark, files).collect()}
    assert len(px) == 6 and px[1, 2] == (20, 21, 22)


def test_numbers_are_checked(spark):
    from lamella.operators import learning

    df = spark.createDataFrame([("1", 2.0), ("x", 3.0)], "a string, b double")
    with pytest.raises(ContractError):
        learning.checked_numbers(df, ["a", "b"])
    assert [tuple(r) for r in learning.checked_numbers(df.filter("b = 2"), ["a", "b"]).collect()] == [(1.0, 2.0)]
    with pytest.raises(ContractError):
        learning.checked_numbers(df.filter("b = 2").withColumn("b", F.lit(float("nan"))), ["a", "b"])


def test_command_line_runs_a_stage(spark, tmp_path, capsys):
    from lamella.__main__ import main

    main(["list"])
    assert "roi_type_pivot" in capsys.readouterr().out
    main(["query", "cells_per_slide", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "q")])
    assert spark.read.parquet(str(tmp_path / "q")).count() == 5
    rows = [(f"s{i % 2}", "R", i, float(i % 7), float(i * i % 11), float(i % 5)) for i in range(1, 60)]
    spark.createDataFrame(rows, "slide string, region string, cell_label long, f1 double, f2 double, f3 double").write.parquet(str(tmp_path / "f"))
    main(["clean", "--features", str(tmp_path / "f"), "--out", str(tmp_path / "c"), "--groups", "2", "--max-features", "2"])
    assert spark.read.parquet(str(tmp_path / "c" / "cleaned")).count() == 59
    assert 1 <= spark.read.parquet(str(tmp_path / "c" / "selection")).count() <= 2


def test_rows_are_numbered_by_file_and_split_back(spark, tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    sizes = {"b_features.csv": 3, "a_features.csv": 400, "c_features.csv": 1}
    for name, n in sizes.items():
        (place / name).write_text("slide,region,cell_label,f\n" + "".join(f"{name[0]},R{i % 2},{i},{i * 0.5}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # many splits a file
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = readers.feature_tables(spark, str(place), ["slide", "region", "cell_label"], ["f", "absent"])
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert all(r.source_row == int(r.cell_label) and r.f == r.source_row * 0.5 and r.absent is None for r in rows)
    assert sorted(r.row_index for r in rows) == list(range(404))
    assert {r.row_index - r.source_row for r in rows if r.source_file == "b_features.csv"} == {400}
    writers.by_source_file(df, str(tmp_path / "out"))
    for name, n in sizes.items():
        parts = sorted((tmp_path / "out" / f"__folder={name[:-4]}_cleaned").glob("part-*.csv"))
        lines = [x for p in parts for x in p.read_text().splitlines()[1:]]
        assert [int(x.split(",")[3]) for x in lines] == list(range(n))
    (place / "d_features.csv").write_text("slide,region,cell_label,f\na,R1,900,1\n")
    with pytest.raises(ContractError, match="several files"):
        readers.feature_tables(spark, str(place), ["slide", "region", "cell_label"], ["f"])


def test_a_slides_own_table_comes_before_those_that_start_with_its_name():
    names = ["/d/s1_cell_coords.csv", "/d/s10_cell_coords.csv", "/d/s2b_cell_coords.csv", "/d/notes.csv"]
    assert readers.slide_files(names, "s1") == names[:1]
    assert readers.slide_files(names, "s2") == names[2:3] and readers.slide_files(names, "t") == []
    assert readers.slide_files(names) == sorted(names[:3])
