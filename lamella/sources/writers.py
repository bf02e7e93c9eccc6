"""Sinks: partitioned tables in place of a file a slide, JSON for summaries, templates that are kept."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.operators.relational import ContractError


def by_slide(df: DataFrame, path: str, ids: list[str], partition: str = "slide") -> None:
    """Ids first, one folder a slide; nothing is written for an empty table."""
    rest = [c for c in df.columns if c not in ids]
    ordered = df.select(*[c for c in ids if c in df.columns], *rest)
    if not ordered.isEmpty():
        ordered.write.mode("overwrite").partitionBy(partition).parquet(path)


def csv_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def by_source_file(df: DataFrame, path: str) -> None:
    """Rows split back by the file they came from, in its order: a folder <stem>_cleaned a file, with header; parts of a large file ascend."""
    stem = F.concat(F.regexp_replace("source_file", r"\.[^.]*$", ""), F.lit("_cleaned"))
    x = df.withColumn("__folder", stem).repartitionByRange("__folder", "source_row").sortWithinPartitions("__folder", "source_row")
    x.drop("row_index", "source_row").write.mode("overwrite").option("header", "true").partitionBy("__folder").csv(path)


def json_value(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON object; NaN and infinities are refused."""
    text = json.dumps(value, allow_nan=False, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def run_summary(cells: DataFrame, features: list[str], references: DataFrame | None = None) -> DataFrame:
    """One row: cells a slide, features, slides with and without a stain reference."""
    n = cells.groupBy("slide").agg(F.count("*").alias("n"))
    if references is not None:
        n = n.join(references.select("slide").withColumn("ref", F.lit(True)), "slide", "left")
    else:
        n = n.withColumn("ref", F.lit(None).cast("boolean"))
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("slide"))))
    return n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slide", "n")))).alias("cells"), F.sum("n").alias("total"), pick(F.col("ref")).alias("with_reference"), pick(F.col("ref").isNull()).alias("without_reference")).withColumn("features", F.array(*[F.lit(f) for f in features]))


def matrix(long: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide, a column for each name."""
    return long.groupBy(row).pivot(column, names).agg(F.first(value))


def template(spark: SparkSession, value: dict, path: str) -> None:
    """Written only where nothing is: reruns keep what people filled in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        json_value(spark, value, path)


def manifest_template(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise ContractError("a manifest is there already")
    json_value(spark, {"pairs": [{"pair_id": "", "patient_id": "", "he_slide": "", "p53_slide": "", "section_relationship": "unknown"}]}, path)


def model_bundle(model: PipelineModel, metadata: dict, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    from pyspark.sql import SparkSession as S

    json_value(S.active(), metadata, f"{path}/metadata")


def region_masks(pixels: DataFrame, frames: DataFrame, by: list[str], path: str) -> None:
    """Region masks as runs of pixels with their frame and file name, one row a run, partitioned by slide."""
    from lamella.functions.expressions import mask_file

    w = W.partitionBy(*by, "row").orderBy("col")
    start = F.when(F.coalesce(F.lag("col").over(w) != F.col("col") - 1, F.lit(True)), F.col("col"))
    runs = pixels.select(*by, "row", "col").distinct().withColumn("__start", F.last(start, ignorenulls=True).over(w))
    runs = runs.groupBy(*by, "row", F.col("__start").alias("first_col")).agg(F.max("col").alias("last_col"))
    name = mask_file(F.col("slide"), F.col("region"), F.col("level"), F.col("min_x"), F.col("min_y"), F.col("width"), F.col("height"), "npy")
    runs.join(frames, by).withColumn("file", name).write.mode("overwrite").partitionBy("slide").parquet(path)
