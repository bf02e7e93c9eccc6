"""Window operators: weights, cumulative picks, numbering, normalisation, argmax, folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.storage import stored


def balance_weights(df: DataFrame, patient: str, label: str) -> DataFrame:
    """Weight 1 / (rows of patient and label x patients of the label), scaled to a mean of one."""
    cell = df.groupBy(patient, label).agg(F.count("*").alias("__n"))
    label_patients = cell.groupBy(label).agg(F.count("*").alias("__patients"))
    weights = cell.join(label_patients, label).withColumn("__w", 1 / (F.col("__n") * F.col("__patients")))
    total = weights.agg((F.sum(F.col("__w") * F.col("__n")) / F.sum("__n")).alias("__mean"))  # one row
    return df.join(weights.crossJoin(F.broadcast(total)).select(patient, label, (F.col("__w") / F.col("__mean")).alias("weight")), [patient, label])


def take_until(groups: DataFrame, by: list[str], order: list, size: str, target: Column) -> DataFrame:
    """Whole groups in order while what came before is under the target: the last one taken may exceed it."""
    before = F.coalesce(F.sum(size).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return groups.withColumn("__before", before).filter(F.col("__before") < target).drop("__before")


def seeded_order(regions: DataFrame, class_column: str, classes: list[str], seed: int) -> DataFrame:
    """A random order of the regions of each class, from one generator that the classes share in turn.

    The region table has a row a region and is read to the driver; it must be in a fixed order there.
    """
    rows = regions.orderBy(*regions.columns).collect()
    rng, out = np.random.default_rng(seed), []
    for c in classes:
        own = [r for r in rows if r[class_column] == c]
        out += [(*own[i], k) for k, i in enumerate(rng.permutation(len(own)).tolist())]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in regions.schema) + ", place int"
    return regions.sparkSession.createDataFrame(out, schema)


def largest_until_fraction(parts: DataFrame, by: list[str], size: str, tie: str, fraction: float = 0.9) -> DataFrame:
    """Largest parts first until they hold the fraction of their group."""
    w = W.partitionBy(*by)
    before = F.coalesce(F.sum(size).over(w.orderBy(F.desc(size), tie).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("__before", before).withColumn("__all", F.sum(size).over(w)).filter(F.col("__before") < F.lit(fraction) * F.col("__all")).drop("__before", "__all")


def number_rows(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def number_in_ranges(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """As ``number_rows`` for few large groups: sorted ranges, each numbered in a task from the count of the ranges before it."""
    x = stored(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    parts = x.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    parts = parts.withColumn("__before", F.sum("__n").over(W.partitionBy(*by).orderBy("__part")) - F.col("__n")).drop("__n")  # a row a range
    within = F.row_number().over(W.partitionBy(*by, "__part").orderBy(*order))
    x = x.withColumn("__within", within).join(parts.withColumnsRenamed({c: f"__{c}" for c in [*by, "__part"]}), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*by, "__part"]])
    return x.select(*df.columns, (F.col("__before") + F.col("__within")).cast("int").alias(name))


def min_max_scaled(df: DataFrame, by: list[str], value: str, name: str, flat: float = 1e-12) -> DataFrame:
    """To -1 .. 1 within a group; 0 where the group is flat."""
    w = W.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(name, F.when(F.abs(high - low) <= flat, 0.0).otherwise(2 * (F.col(value) - low) / (high - low) - 1))


def nearest_level(levels: DataFrame, by: list[str], target: float) -> DataFrame:
    """The level whose scale is nearest to the target; the first on ties."""
    diff = F.abs(F.col("mpp") * F.col("downsample") - target)
    return levels.groupBy(*by).agg(F.min_by("level", F.struct(diff, F.col("level"))).alias("level"))


def argmax_with_confidence(df: DataFrame, probabilities: str) -> DataFrame:
    """1-based place of the largest entry, the first on ties, and its value."""
    top = F.array_max(probabilities)
    return df.withColumn("cluster_id", F.array_position(F.col(probabilities), top).cast("int")).withColumn("cluster_confidence", top)


def average_ranks(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Ranks from 1, ties averaged."""
    w = W.partitionBy(*(by or [F.lit(1)]))
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(*(by or []), value)) - 1) / 2)


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): groups, largest first, each to the fold with fewest rows so far; no more folds than groups."""
    sizes = [(r[0], r[1]) for r in df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).collect()]
    load, out = [0] * max(1, min(folds, len(sizes))), []
    for g, n in sizes:
        k = load.index(min(load))
        load[k] += n
        out.append((g, k))
    return df.sparkSession.createDataFrame(out, f"`{group}` {df.schema[group].dataType.simpleString()}, fold int")


def sample_regions(cells: DataFrame, keys: list[str], class_column: str, classes: list[str], per_class: int, seed: int) -> DataFrame:
    """Cells of whole regions, drawn at random until each class has its number; unknown classes are left out.

    Raises if a class falls short of the number even with all its regions.
    """
    from lamella.operators.relational import ContractError

    regions = cells.groupBy(*keys, class_column).agg(F.count("*").alias("n_cells"))
    have = {r[0]: r[1] for r in regions.groupBy(class_column).agg(F.sum("n_cells")).collect()}
    short = [c for c in classes if have.get(c, 0) < per_class]
    if short:
        raise ContractError(f"too few cells: {', '.join(short)}")
    ordered = seeded_order(regions.filter(F.col(class_column).isin(classes)), class_column, classes, seed)
    taken = take_until(ordered, [class_column], ["place"], "n_cells", F.lit(per_class))
    return cells.join(taken.select(*keys), keys, "left_semi")
