"""Command line: lists and runs queries, and the stages, over tables on shared storage.

    python -m lamella list
    python -m lamella query NAME --data FOLDER --out FOLDER
    python -m lamella extract --pixels TABLE --cells TABLE --mpp 0.25 --out FOLDER
    python -m lamella clean --features TABLE --out FOLDER [--max-features 40 --groups 20 --per-group 2]
    python -m lamella cluster --cells TABLE --features NAMES --classes NAMES --out FOLDER [--per-class 1000 --components 20 --seed 42]
    python -m lamella train --features TABLE --labels TABLE --columns NAMES --label NAME --out FOLDER [--folds 5]

Tables are Parquet; names are separated by commas. Start it with spark-submit to run on a cluster.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lamella import image_queries  # noqa: F401  registers its queries
from lamella import queries as Q
from lamella.plans import runs
from lamella.sources import writers

IDS = {"slide", "region", "cell_label", "type", "type_name", "type_prob", "cx_roi", "cy_roi", "cx_wsi", "cy_wsi", "cx_wsi_um", "cy_wsi_um"}

SELECTION = "feature string, feature_group int, group_size int, within_group_rank int, distance double"


def names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lamella", description="Cell analytics on Spark")
    todo = p.add_subparsers(dest="todo", required=True)
    todo.add_parser("list")
    options = {
        "query": [("name", {}), ("--data", {"required": True})],
        "extract": [("--pixels", {"required": True}), ("--cells", {"required": True}), ("--mpp", {"type": float, "required": True})],
        "clean": [("--features", {"required": True}), ("--max-features", {"type": int, "default": 40}), ("--groups", {"type": int, "default": 20}), ("--per-group", {"type": int, "default": 2})],
        "cluster": [("--cells", {"required": True}), ("--features", {"type": names, "required": True}), ("--classes", {"type": names, "required": True}), ("--per-class", {"type": int, "default": 1000}), ("--components", {"type": int, "default": 20}), ("--seed", {"type": int, "default": 42})],
        "train": [("--features", {"required": True}), ("--labels", {"required": True}), ("--columns", {"type": names, "required": True}), ("--label", {"required": True}), ("--folds", {"type": int, "default": 5})],
    }
    for name, own in options.items():
        sub = todo.add_parser(name)
        for flag, kw in own:
            sub.add_argument(flag, **kw)
        sub.add_argument("--out", required=True)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.todo == "list":
        print("\n".join(sorted(Q.QUERIES)))
        return
    spark = SparkSession.builder.getOrCreate()
    read = spark.read.parquet
    if a.todo == "query":
        Q.QUERIES[a.name](spark, a.data).write.mode("overwrite").parquet(a.out)
    elif a.todo == "extract":
        writers.by_slide(runs.extract(read(a.pixels), read(a.cells), a.mpp), a.out, ["slide", "region", "cell_label"])
    elif a.todo == "clean":
        cleaned, chosen = runs.clean(read(a.features), IDS, a.max_features, a.groups, a.per_group)
        cleaned.write.mode("overwrite").parquet(f"{a.out}/cleaned")
        spark.createDataFrame(chosen, SELECTION).write.mode("overwrite").parquet(f"{a.out}/selection")
    elif a.todo == "cluster":
        for name, table in zip(("cells", "counts", "profiles"), runs.cluster(read(a.cells), a.features, a.classes, a.per_class, a.components, a.seed), strict=True):
            table.write.mode("overwrite").parquet(f"{a.out}/{name}")
    else:
        model, folds, notes = runs.train(read(a.features), read(a.labels), a.columns, a.label, a.folds)
        writers.model_bundle(model, {"features": a.columns, "label": a.label, **notes}, a.out)
        if folds is not None:
            folds.write.mode("overwrite").parquet(f"{a.out}/out_of_fold")


if __name__ == "__main__":
    main()
