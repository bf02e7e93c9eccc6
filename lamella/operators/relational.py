"""Contracts, filters, joins and aggregates over cell tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.functions import expressions as X

KEYS = ["slide", "region", "cell_label"]


class ContractError(ValueError):
    """A table breaks a stated rule."""


def require_columns(df: DataFrame, names: list[str], context: str = "table") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"{context} lacks columns: {', '.join(missing)}")
    return df


def key_faults(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys that are null, not positive, or repeated, with the reason and number of rows."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    whole = F.col(keys[-1]) > 0 if dict(df.dtypes)[keys[-1]] in ("int", "bigint", "smallint") else F.lit(True)
    return per.withColumn("fault", F.when(null, "null key").when(~whole, "label not positive").when(F.col("n") > 1, "repeated key")).filter("fault IS NOT NULL")


def validate_keys(df: DataFrame, keys: list[str] = KEYS, context: str = "table") -> DataFrame:
    bad = key_faults(require_columns(df, keys, context), keys).first()
    if bad:
        raise ContractError(f"{context}: {bad['fault']} at {tuple(bad[k] for k in keys)}")
    return df


def small_cells_out(df: DataFrame, area: str = "area_px", at_least: float = 200) -> DataFrame:
    """Drops cells known to be smaller; cells of unknown area stay."""
    return df.filter(X.keep_missing(F.col(area), at_least))


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Union by name; a column that some lack is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def zip_by_position(left: DataFrame, right: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Rows of both at the same position, in groups where both have as many."""
    n = lambda d, name: d.groupBy(*by).agg(F.count("*").alias(name))
    same = n(left, "n_left").join(n(right, "n_right"), by).filter("n_left = n_right").select(*by)
    return left.join(same, by, "left_semi").join(right, [*by, pos])


def last_wins(build: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row a key: the values of the row that is last in order."""
    return build.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("last")).select(*keys, "last.*")


def left_last_wins(left: DataFrame, build: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    return left.join(last_wins(build, keys, order, values), keys, "left")


def lookup(left: DataFrame, names: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """value by key, or the default where the key is unknown; Spark broadcasts names if its size allows."""
    return left.join(names.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), default))


def split_by_match(labels: DataFrame, features: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Labels with their features, and labels that have none."""
    return labels.join(features, keys), labels.join(features, keys, "left_anti")


def join_complete(left: DataFrame, right: DataFrame, keys: list[str], context: str = "join") -> DataFrame:
    """One-to-one join that must find every left row."""
    validate_keys(left, keys, context)
    validate_keys(right, keys, context)
    if not left.join(right, keys, "left_anti").isEmpty():
        raise ContractError(f"{context}: rows without a partner")
    return left.join(right, keys)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys found in both; training and evaluation must have none."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def all_in_common(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that every table has."""
    return reduce(lambda a, b: a.intersect(b), [t.select(*keys) for t in tables])


def group_max(errors: DataFrame, by: str, value: str, at_least: int = 3) -> DataFrame:
    """Largest value a group, for groups with enough rows."""
    return errors.groupBy(by).agg(F.count("*").alias("n"), F.max(value).alias(f"max_{value}")).filter(F.col("n") >= at_least)


def histogram(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by, value).agg(F.count("*").alias("n"))


def histogram_with_total(df: DataFrame, by: str, value: str, total: str = "TOTAL") -> DataFrame:
    """Counts a group and value, and over all groups under the name total."""
    sets = df.select(by, value).groupingSets([[F.col(by), F.col(value)], [F.col(value)]], by, value).agg(F.count("*").alias("n"), F.grouping(by).alias("g"))
    return sets.select(F.when(F.col("g") == 1, F.lit(total)).otherwise(F.col(by)).alias(by), value, "n")


def pivot_counts(df: DataFrame, by: list[str], value: str, values: list, name: str = "{}") -> DataFrame:
    """A row a group, a column for each value, named by the format, zero where a value is absent."""
    wide = df.groupBy(*by).pivot(value, values).count()
    return wide.select(*by, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(name.format(v)) for v in values])


def counts_of_classes(cells: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Cells a class, 0 for classes without cells."""
    n = cells.groupBy(key).agg(F.count("*").alias("n"))
    return classes.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def pixel_sums(pixels: DataFrame, by: list[str], value: str, mapped: str, tissue: str, threshold: float | Column | None) -> DataFrame:
    """Per nucleus, over pixels from any number of tiles: mean, spread and fractions of a stain.

    The positive and tissue fractions are of mapped pixels. Without mapped pixels mean, spread and positive fraction are null and
    the others 0. The threshold may be a column, the same for all pixels of a nucleus; where it is null, so is the positive fraction.
    """
    m, v = F.col(mapped).cast("int"), F.when(F.col(mapped), F.col(value))
    at = F.lit(threshold).cast("double") if not isinstance(threshold, Column) else threshold
    positive = F.sum(F.when(at.isNull(), None).when(v >= at, 1).otherwise(0))
    s = pixels.groupBy(*by).agg(F.count("*").alias("n"), F.sum(m).alias("n_mapped"), F.sum((F.col(mapped) & F.col(tissue)).cast("int")).alias("n_tissue"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), positive.alias("n_positive"))
    div = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    mean = div("s1", "n_mapped")
    return s.select(*by, "n", "n_mapped", mean.alias("mean"), F.when(F.col("n_mapped") > 0, F.sqrt(F.greatest(F.lit(0.0), div("s2", "n_mapped") - mean * mean))).alias("std"), div("n_positive", "n_mapped").alias("positive_fraction"), div("n_mapped", "n").alias("mapped_fraction"), (F.col("n_tissue") / F.greatest(F.col("n_mapped"), F.lit(1))).alias("tissue_fraction"))


def median_offset(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Median of a - b a group and the largest departure from it."""
    d = df.withColumn("offset", F.col(a) - F.col(b))
    mid = d.groupBy(*by).agg(F.percentile("offset", F.lit(0.5)).alias("median_offset"))
    return d.join(mid, by).groupBy(*by, "median_offset").agg(F.max(F.abs(F.col("offset") - F.col("median_offset"))).alias("max_departure"))


def summary_of_predictions(predictions: DataFrame, by: str) -> DataFrame:
    return predictions.groupBy(by).agg(F.count("*").alias("cells"), F.sum("predicted").alias("positives"), F.avg("predicted").alias("positive_fraction"), F.avg("probability").alias("mean_probability"))


def region_sources(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Regions that come from more than one file."""
    return df.groupBy(*keys).agg(F.count_distinct(source).alias("files")).filter("files > 1")


def joined_lists(df: DataFrame, by: list[str], value: str, order: str, name: str, separator: str = "; ") -> DataFrame:
    """Values of a group in order, as one text."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).alias("v")))), lambda s: s["v"])
    return df.groupBy(*by).agg(F.array_join(items, separator).alias(name))


def split_lists(df: DataFrame, column: str, name: str, separator: str = ";") -> DataFrame:
    """One row a trimmed, non-empty part of a text."""
    parts = F.filter(F.transform(F.split(column, separator), F.trim), lambda x: x != "")
    return df.select(*[c for c in df.columns if c != column], F.posexplode(parts).alias("pos", name))


def first_rows(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The debug limit: n rows a group in order."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*by).orderBy(order))).filter(F.col("__rank") <= n).drop("__rank")


def mask_agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Dice overlap of two pixel sets."""
    both = a.select(*keys).distinct().withColumn("in_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("in_b", F.lit(1)), keys, "full")
    return both.agg((2 * F.sum(F.coalesce("in_a", F.lit(0)) * F.coalesce("in_b", F.lit(0))) / (F.sum(F.coalesce("in_a", F.lit(0))) + F.sum(F.coalesce("in_b", F.lit(0))))).alias("dice"))


def tiles(boxes: DataFrame, keys: list[str], width: str, height: str, size: int = 1024, stride: int = 768, pad: int = 96) -> DataFrame:
    """Overlapping tiles clipped at the region's edge, with clipped context around each."""
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(n) - 1), F.lit(stride))
    t = boxes.select(*keys, width, height, F.explode(starts(width)).alias("x0")).select("*", F.explode(starts(height)).alias("y0"))
    t = t.withColumn("x1", F.least(F.col("x0") + size, F.col(width))).withColumn("y1", F.least(F.col("y0") + size, F.col(height)))
    return t.select(*keys, "x0", "y0", "x1", "y1", F.greatest(F.lit(0), F.col("x0") - pad).alias("cx0"), F.greatest(F.lit(0), F.col("y0") - pad).alias("cy0"), F.least(F.col("x1") + pad, F.col(width)).alias("cx1"), F.least(F.col("y1") + pad, F.col(height)).alias("cy1"))


def legend(counts: DataFrame, types: DataFrame, by: list[str]) -> DataFrame:
    """Types above 0 that occur, ascending, with their names; counts: (by, type, n), types: (type, name)."""
    w = W.partitionBy(*by).orderBy("type")
    x = counts.filter((F.col("type") > 0) & (F.col("n") > 0)).join(types, "type", "left")
    return x.withColumn("place", F.row_number().over(w))


def ordered_names(features: DataFrame, by: list[str], score: str, position: str, name: str) -> DataFrame:
    """Each group's names by falling score; equal scores keep their position, missing scores come last."""
    order = [F.col(score).desc_nulls_last(), F.col(position)]
    return features.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).select(*by, "place", name)


def largest_of(parts: DataFrame, by: list[str], size: Column, tie: str) -> DataFrame:
    """The row of largest size in each group, the first by tie."""
    best = parts.groupBy(*by).agg(F.max_by(F.struct(*[c for c in parts.columns if c not in by]), F.struct(size, -F.col(tie))).alias("__best"))
    return best.select(*by, "__best.*")


def vocabulary(tables: list[DataFrame], wanted: list[str]) -> tuple[list[str], list[str]]:
    """Names that any table has, and those of wanted that every table has, in order."""
    found = [set(t.columns) for t in tables]
    return sorted(set().union(*found)), [c for c in wanted if all(c in f for f in found)]


def distinct_rows(df: DataFrame, columns: list[str], digits: int = 12) -> DataFrame:
    """Number of distinct rows of a matrix, which bounds how many groups it can give."""
    return df.select(*[F.round(c, digits).alias(c) for c in columns]).distinct().agg(F.count("*").alias("n_distinct"))
