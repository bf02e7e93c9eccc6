"""Scaling, feature selection, clustering, supervision and metrics."""

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.functions.expressions import finite
from lamella.functions.statistics import nine_parts
from lamella.operators.relational import ContractError
from lamella.storage import stored


def clean_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles, infinities and NaN as null."""
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})


def checked_numbers(df: DataFrame, columns: list[str], strict: bool = True) -> DataFrame:
    """As ``clean_numbers``; raises on text that is no number and, if strict, on a column or row without any value."""
    text = [c for c in columns if df.schema[c].dataType.typeName() == "string"]
    odd = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & F.col(c).try_cast("double").isNull() for c in text], F.lit(False))
    if text and not df.filter(odd).isEmpty():
        raise ContractError("a feature that is no number")
    x = clean_numbers(df.withColumns({c: F.col(c).try_cast("double") for c in text}), columns)
    if strict:
        empty = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])
        row = x.agg(F.count_if(empty).alias("__rows"), *[F.count(c).alias(c) for c in columns]).first()
        if row["__rows"] or any(row[c] == 0 for c in columns):
            raise ContractError("a row or a column without any value")
    return x


def variances(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def varying(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose sample variance is known and not zero."""
    return [c for c, v in variances(df, columns).items() if v]


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's distinct finite values in order: c (the column's place), v, n, end (rows up to here), total.

    Counts combine before the shuffle; sorted values are cut into ranges, each summed in one task from the offset of the
    ranges before it, so that no column has to fit a task.
    """
    long = df.select(F.posexplode(F.array(*[finite(F.col(f"`{c}`").cast("double")) for c in columns])).alias("c", "v")).filter("v IS NOT NULL")
    x = stored(long.groupBy("c", "v").agg(F.count("*").alias("n")).orderBy("c", "v").withColumn("part", F.spark_partition_id()), "counted")
    parts = x.groupBy("c", "part").agg(F.sum("n").alias("m"))
    w = W.partitionBy("c").orderBy("part")  # a row a range
    parts = parts.select("c", "part", (F.sum("m").over(w) - F.col("m")).alias("before"), F.sum("m").over(W.partitionBy("c")).alias("total"))
    within = F.sum("n").over(W.partitionBy("c", "part").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    return x.join(parts, ["c", "part"]).select("c", "v", "n", (F.col("before") + within).alias("end"), "total")


def exact_quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...]) -> dict[str, list[float] | None]:
    """Interpolated quantiles of each column's finite values, by rank; None for a column without values."""
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)]))
    x = counted(df, columns).withColumn("w", wanted).withColumn("at", (F.col("total") - 1) * F.col("w.p"))
    inside = lambda i: (F.col("end") > i) & (F.col("end") - F.col("n") <= i)
    x = x.filter(inside(F.floor("at")) | inside(F.ceil("at")))
    rows = x.groupBy("c", "w.i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("at").alias("at")).collect()
    out: dict[str, list[float] | None] = {c: None for c in columns}
    for r in sorted(rows, key=lambda r: (r["c"], r["i"])):
        share = r["at"] - math.floor(r["at"])
        out[columns[r["c"]]] = [*(out[columns[r["c"]]] or []), r["lo"] + (r["hi"] - r["lo"]) * share if r["hi"] != r["lo"] else r["lo"]]
    return out


def group_quantiles(df: DataFrame, by: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column a name) of interpolated quantiles of each group's finite values, by rank; no row for a group without values.

    As in ``counted``, from counts of distinct values in sorted ranges, so that no group has to fit a task.
    """
    v = finite(F.col(column).cast("double"))
    x = df.select(*by, v.alias("__v")).filter("__v IS NOT NULL").groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    x = stored(x.orderBy(*by, "__v").withColumn("__part", F.spark_partition_id()), "counted")
    parts = x.groupBy(*by, "__part").agg(F.sum("__n").alias("__m"))
    before = F.sum("__m").over(W.partitionBy(*by).orderBy("__part")) - F.col("__m")  # a row a range
    parts = parts.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__of"), before.alias("__before"), F.sum("__m").over(W.partitionBy(*by)).alias("__total"))
    within = F.sum("__n").over(W.partitionBy(*by, "__part").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow))
    x = x.withColumn("__within", within).join(parts, [*[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col("__part") == F.col("__of")])
    end = F.col("__before") + F.col("__within")

    def quantile(p: float) -> Column:
        at = (F.col("__total") - 1) * F.lit(float(p))
        value = lambda i: F.max(F.when((end > i) & (end - F.col("__n") <= i), F.col("__v")))
        low, high, share = value(F.floor(at)), value(F.ceil(at)), F.max(at - F.floor(at))
        return F.when(low == high, low).otherwise(low + (high - low) * share)

    return x.groupBy(*by).agg(*[quantile(p).alias(name) for name, p in shares.items()])


def nine_number_table(df: DataFrame, by: list[str], prefix: str, column: str) -> DataFrame:
    """The nine numbers of few large groups: moments combine before the shuffle, percentiles come from counts of values."""
    names = {f"{prefix}_median": 0.5, f"{prefix}_p10": 0.1, f"{prefix}_p90": 0.9}
    q = group_quantiles(df, by, column, names).withColumnsRenamed({c: f"__{c}" for c in by})
    order = [c for c, _ in nine_parts(prefix, column)]
    m = df.groupBy(*by).agg(*[v.alias(c) for c, v in nine_parts(prefix, column) if c not in names])
    return m.join(q, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left").select(*by, *order)


def robust_scale(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """(x - median) / interquartile range, exact; columns without range leave. One pass for all quartiles."""
    q = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    kept = [c for c in columns if q[c] and q[c][2] - q[c][0] > 0]
    scaled = {c: (finite(F.col(c)) - F.lit(q[c][1])) / F.lit(q[c][2] - q[c][0]) for c in kept}
    return df.drop(*[c for c in columns if c not in kept]).withColumns(scaled), kept


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact medians for missing values, zero where a column has none."""
    m = exact_quantiles(df, columns, (0.5,))
    return df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(m[c][0] if m[c] else 0.0)) for c in columns})


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median-imputed, zero mean and unit population deviation; constant columns are centred only."""
    x = impute_median(df, columns)
    s = x.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns]).first()
    return x.withColumns({c: (F.col(c) - F.lit(s[f"{c}_m"])) / F.lit(s[f"{c}_s"] or 1.0) for c in columns})


#: Columns up to which ranks are joined one column after the other.
JOINED = 8


def rank_vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    """One vector of average ranks a row; columns hold no missing values.

    Up to ``JOINED`` columns look their ranks up one after the other: where a column has few values, that moves no row. More
    columns do so all at once, in a row a value.
    """
    if len(columns) <= JOINED:
        x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
        ranks = counted(df, columns).select("c", "v", (F.col("end") - (F.col("n") - 1) / 2).alias("rank"))
        for i in range(len(columns)):
            x = x.join(stored(ranks.filter(F.col("c") == i).select(F.col("v").alias(f"v{i}"), F.col("rank").alias(f"r{i}")), "ranks"), f"v{i}")
        return x.select(array_to_vector(F.array(*[F.col(f"r{i}") for i in range(len(columns))])).alias("v"))
    x = stored(df.select(*columns).withColumn("row", F.monotonically_increasing_id()), "rows")
    long = x.select("row", F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in columns])).alias("c", "v"))
    ranks = counted(x, columns).select("c", "v", (F.col("end") - (F.col("n") - 1) / 2).alias("rank"))
    back = long.join(ranks, ["c", "v"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("c", "rank"))).alias("r"))
    return back.select(array_to_vector(F.transform("r", lambda e: e["rank"])).alias("v"))


def spearman_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Rank correlations, ties averaged, clipped; missing values imputed by the median first."""
    v = rank_vectors(impute_median(df, columns), columns)
    m = np.clip(Correlation.corr(v, "v", "pearson").head()[0].toArray(), -1, 1)
    if not np.isfinite(m).all():
        raise ContractError("rank correlation of a constant column")
    return m


def matrix_rows(df: DataFrame, columns: list[str], m: np.ndarray, name: str) -> DataFrame:
    rows = [(a, b, float(m[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, f"feature string, other string, {name} double")


def average_linkage(distance: np.ndarray, groups: int) -> list[list[int]]:
    """At most so many groups of columns by average-linkage clustering, each in column order, ordered by first column.

    Merging stops at the lowest height that leaves no more than the wanted number, so that equal heights
    merge together and fewer groups may come out. The matrix holds features, not rows, and is small.
    """
    n = len(distance)
    members: dict[int, list[int]] = {i: [i] for i in range(n)}
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    last = -1.0
    while alive.sum() > 1:
        masked = np.where(alive[:, None] & alive[None, :], d, np.inf)
        i, j = np.unravel_index(int(masked.argmin()), masked.shape)
        height = masked[i, j]
        if alive.sum() <= groups and height > last + 1e-12:
            break
        i, j = min(i, j), max(i, j)
        a, b = len(members[i]), len(members[j])
        d[i] = d[:, i] = (a * d[i] + b * d[j]) / (a + b)
        d[i, i] = np.inf
        members[i] = sorted(members[i] + members.pop(j))
        alive[j] = False
        last = max(last, height)
    return sorted(members.values(), key=lambda g: g[0])


def pick_diverse(group: list[int], distance: np.ndarray, n: int) -> list[int]:
    """The farthest pair of a group, then whatever is farthest from what is picked; ties to column order."""
    if n < 1:
        return []
    if len(group) <= n:
        return list(group)
    sub = distance[np.ix_(group, group)]
    if n == 1:
        return [group[int(sub.mean(1).argmax())]]
    upper = np.where(np.triu(np.ones_like(sub, bool), 1), sub, -np.inf)
    picked = list(np.unravel_index(int(upper.argmax()), upper.shape))
    while len(picked) < n:
        least = sub[:, picked].min(1)
        least[picked] = -np.inf
        picked.append(int(least.argmax()))
    return [group[int(i)] for i in picked]


def select_features(columns: list[str], distance: np.ndarray, most: int = 40, groups: int = 20, per_group: int = 2) -> list[dict]:
    """Selected features in order: diverse ones of each group, then a global fill by largest distance."""
    found = average_linkage(distance, groups) if len(columns) > groups else [[i] for i in range(len(columns))]
    of = {i: g for g, own in enumerate(found, 1) for i in own}
    out, picked = [], []
    for g, own in enumerate(found, 1):
        chosen = pick_diverse(own, distance, min(per_group, most - len(picked)))
        for rank, i in enumerate(chosen, 1):
            others = [distance[i, j] for j in chosen if j != i]
            out.append({"feature": columns[i], "feature_group": g, "group_size": len(own), "within_group_rank": rank, "distance": float(np.mean(others)) if others else None})
        picked += chosen
    rest = [i for i in range(len(columns)) if i not in picked]
    while rest and len(picked) < most:
        far = [distance[i, picked].min() if picked else 1.0 for i in rest]
        i = rest.pop(int(np.argmax(far)))
        g = of[i]
        out.append({"feature": columns[i], "feature_group": g, "group_size": len(found[g - 1]), "within_group_rank": 1 + sum(x["feature_group"] == g for x in out), "distance": float(max(far))})
        picked.append(i)
    return out


#: Partitions up to which their statistics are summed on the driver, without a shuffle an iteration.
FEW_PARTS = 64


class DiagonalMixture:
    """Gaussian mixture by EM with diagonal, spherical, tied or full covariances.

    Each iteration is one pass over the rows for all starts that go on, for their sufficient statistics; parameters,
    of bounded size (components x features), live on the driver. The best of several starts is kept.
    """

    def __init__(self, components: int, kind: str = "diag", starts: int = 3, iterations: int = 500, floor: float = 1e-5, tolerance: float = 1e-3, seed: int = 42):
        self.components, self.kind, self.starts, self.iterations, self.floor, self.tolerance, self.seed = components, kind, starts, iterations, floor, tolerance, seed

    def fit(self, df: DataFrame, columns: list[str]) -> "DiagonalMixture":
        x = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x")).persist()
        n = x.count()
        if n < self.components:
            raise ContractError("fewer rows than components")
        spread = np.array(x.agg(*[F.var_pop(F.col("x")[i]) for i in range(len(columns))]).first(), float) + self.floor
        seeds = [np.array([r[0] for r in x.orderBy(F.xxhash64(F.lit(self.seed + start), "x")).limit(self.components).collect()]) for start in range(self.starts)]
        best = None
        for run in self._em(x, n, seeds, spread):
            if best is None or run[0] > best[0]:
                best = run
        x.unpersist()
        self.log_likelihood, self.weights, self.means, self.covariances, self.history = best
        return self

    def _em(self, x: DataFrame, n: int, seeds: list[np.ndarray], spread: np.ndarray) -> list[tuple]:
        """The runs of all starts: likelihood, weights, means, covariances, history. A start that has converged takes no further part."""
        k, d = seeds[0].shape
        full = self.kind in ("full", "tied")
        cov = np.stack([np.diag(spread)] * k) if full else np.tile(spread, (k, 1))
        runs = [(None, np.full(k, 1 / k), means, cov, []) for means in seeds]
        going = list(range(len(runs)))
        many = x.rdd.getNumPartitions() > FEW_PARTS
        for _ in range(self.iterations):
            stats = x.mapInArrow(_sufficient([runs[i][1:4] for i in going], full), "start int, v array<double>")
            if many:
                stats = stats.select("start", F.posexplode("v").alias("i", "v")).groupBy("start", "i").agg(F.sum("v").alias("v")).groupBy("start").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("v"))
            sums = np.zeros((len(going), k * (1 + d + (d * d if full else d)) + 1))
            for r in stats.collect():  # a row a partition and start at most
                sums[r["start"]] += r["v"]
            for place, i in enumerate(going):
                runs[i] = self._step(sums[place], n, k, d, runs[i][4])
            going = [i for i in going if len(runs[i][4]) < 2 or abs(runs[i][4][-1] - runs[i][4][-2]) >= self.tolerance]
            if not going:
                break
        return runs

    def _step(self, sums: np.ndarray, n: int, k: int, d: int, history: list[float]) -> tuple:
        nk, s1, s2 = sums[:k] + 1e-12, sums[k : k + k * d].reshape(k, d), sums[k + k * d : -1].reshape(k, -1)
        weights, means = nk / nk.sum(), s1 / nk[:, None]
        if self.kind in ("full", "tied"):
            cov = s2.reshape(k, d, d) / nk[:, None, None] - means[:, :, None] * means[:, None, :]
            if self.kind == "tied":
                cov = np.stack([(cov * weights[:, None, None]).sum(0)] * k)
            cov = cov + np.eye(d) * self.floor
        else:
            cov = np.maximum(s2 / nk[:, None] - means**2, 0) + self.floor
            if self.kind == "spherical":
                cov = np.tile(cov.mean(1, keepdims=True), (1, d))
        return sums[-1] / n, weights, means, cov, [*history, sums[-1] / n]

    def transform(self, df: DataFrame, columns: list[str], output: str = "probabilities") -> DataFrame:
        """Membership probabilities, arrays in batches."""
        weights, means, cov, full = self.weights, self.means, self.covariances, self.kind in ("full", "tied")

        @F.pandas_udf("array<double>")
        def probabilities(v: pd.Series) -> pd.Series:
            logs = _log_density(np.stack(v.to_numpy()), weights, means, cov, full)
            p = np.exp(logs - logs.max(1, keepdims=True))
            return pd.Series(list(p / p.sum(1, keepdims=True)))

        return df.withColumn(output, probabilities(F.array(*[F.col(c).cast("double") for c in columns])))


def _log_density(x: np.ndarray, weights: np.ndarray, means: np.ndarray, cov: np.ndarray, full: bool) -> np.ndarray:
    out = np.empty((len(x), len(weights)))
    for j, (w, m) in enumerate(zip(weights, means, strict=True)):
        diff = x - m
        if full:
            root = np.linalg.cholesky(cov[j])
            z = np.linalg.solve(root, diff.T)
            out[:, j] = math.log(w + 1e-300) - np.log(np.diag(root)).sum() - 0.5 * (z * z).sum(0) - 0.5 * x.shape[1] * math.log(2 * math.pi)
        else:
            out[:, j] = math.log(w + 1e-300) - 0.5 * (np.log(2 * math.pi * cov[j]).sum() + (diff * diff / cov[j]).sum(1))
    return out


def _sufficient(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], full: bool):
    """Per partition and start: responsibilities' sums, first and second moments a component, log-likelihood, in one array."""

    def run(batches):
        import pyarrow as pa

        sums = None
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
            part = []
            for weights, means, cov in runs:
                logs = _log_density(x, weights, means, cov, full)
                top = logs.max(1, keepdims=True)
                p = np.exp(logs - top)
                total = p.sum(1, keepdims=True)
                p /= total
                s2 = np.stack([(p[:, j, None] * x).T @ x for j in range(len(weights))]) if full else p.T @ (x * x)
                part.append(np.concatenate([p.sum(0), (p.T @ x).ravel(), s2.ravel(), [float((np.log(total) + top).sum())]]))
            sums = np.stack(part) if sums is None else sums + part
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(runs)), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], ["start", "v"])

    return run


def cluster_profiles(df: DataFrame, columns: list[str], cluster: str) -> DataFrame:
    """Mean a cluster and feature, and its min-max scaled value over clusters; long form."""
    from lamella.operators.ranking import min_max_scaled

    means = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in columns])
    long = means.unpivot([cluster], columns, "feature", "mean")
    return min_max_scaled(long, ["feature"], "mean", "scaled")


def principal_components(df: DataFrame, columns: list[str], k: int = 3) -> tuple[DataFrame, list[float]]:
    """Centred scores c1..ck and the share of variance each explains."""
    m = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centred = df.withColumns({c: F.col(c) - F.lit(m[c]) for c in columns})
    v = VectorAssembler(inputCols=columns, outputCol="__v").transform(centred)
    model = PCA(k=k, inputCol="__v", outputCol="__c").fit(v)
    out = model.transform(v).withColumn("__a", vector_to_array("__c"))
    return out.select(*[c for c in df.columns if c not in columns], *[F.col("__a")[i].alias(f"c{i + 1}") for i in range(k)]), model.explainedVariance.toArray().tolist()


def forest(columns: list[str], label: str = "label", weight: str | None = "weight", trees: int = 300, depth: int = 16, leaf: int = 5, seed: int = 42) -> Pipeline:
    """Medians for missing values, a flag for each column that had some, and a random forest."""
    filled = [f"{c}__filled" for c in columns]
    stages = [Imputer(inputCols=columns, outputCols=filled, strategy="median", relativeError=0.0001), VectorAssembler(inputCols=filled + [f"{c}__missing" for c in columns], outputCol="features")]
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed)
    return Pipeline(stages=[*stages, rf.setWeightCol(weight) if weight else rf])


def with_missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    return clean_numbers(df, columns).withColumns({f"{c}__missing": finite(F.col(c).cast("double")).isNull().cast("double") for c in columns})


def training_rows(df: DataFrame, columns: list[str], group: str, label: str) -> DataFrame:
    """Balanced rows with flags for a forest, written once and dealt over all cores.

    Rows are few bytes each, so that joins leave them in one or few partitions, while a row costs every tree at every level.
    """
    from lamella.operators.ranking import balance_weights

    x = with_missing_flags(balance_weights(df, group, label), columns)
    return stored(x.repartition(df.sparkSession.sparkContext.defaultParallelism), "training")


def predict(model: PipelineModel, df: DataFrame, columns: list[str], threshold: float = 0.5, seen: DataFrame | None = None, key: str = "slide") -> DataFrame:
    """Probability, decision, share of missing features, and whether the slide was trained on."""
    x = model.transform(with_missing_flags(df, columns)).withColumn("probability", vector_to_array("probability")[1])
    x = x.withColumn("predicted", (F.col("probability") >= threshold).cast("int")).withColumn("missing_fraction", sum((F.col(f"{c}__missing") for c in columns), F.lit(0.0)) / len(columns))
    if seen is not None:
        x = x.join(seen.select(key).distinct().withColumn("seen_training", F.lit(True)), key, "left").withColumn("seen_training", F.coalesce("seen_training", F.lit(False)))
    return x.drop(*[c for c in x.columns if "__" in c], "features", "rawPrediction", "prediction")


def cross_validate(df: DataFrame, columns: list[str], group: str, label: str, folds: int = 5, **kw) -> tuple[DataFrame, list[dict]]:
    """Out-of-fold probabilities, groups kept whole; folds that cannot be trained or judged are noted and left out."""
    from lamella.operators.ranking import group_folds

    df = stored(df, "samples")  # features are computed once
    x = df.join(group_folds(df, group, folds), group)
    seen = {(r["fold"], r[label]) for r in x.select("fold", label).distinct().collect()}  # a row a fold and label
    out, notes = None, []
    for k in range(folds):
        train, test = x.filter(F.col("fold") != k), x.filter(F.col("fold") == k)
        if len({y for fold, y in seen if fold != k}) < 2 or all(fold != k for fold, _ in seen):
            notes.append({"fold": k, "evaluated": False})
            continue
        model = forest(columns, label, **kw).fit(training_rows(train, columns, group, label))
        part = predict(model, test, columns).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
        notes.append({"fold": k, "evaluated": True})
    return out, notes


def confusion(y: Column, predicted: Column) -> dict[str, Column]:
    hit = lambda a, b: F.sum(((y == a) & (predicted == b)).cast("long"))
    return {"tn": hit(0, 0), "fp": hit(0, 1), "fn": hit(1, 0), "tp": hit(1, 1)}


def rates(df: DataFrame) -> DataFrame:
    """Precision and F1 are 0 on empty denominators; recall and specificity are null without their class; balanced accuracy needs both."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = F.when(tp + fn > 0, tp / (tp + fn)), F.when(tn + fp > 0, tn / (tn + fp))
    return df.withColumns({"precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), "recall": recall, "specificity": specificity, "f1": F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0), "balanced_accuracy": (recall + specificity) / 2})


def ranking_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC-AUC and average precision from counts per distinct score: one row, nulls with a single class.

    Rows shrink to one a score before anything is ordered.
    """
    per = df.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("q"))
    w = W.orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, W.currentRow)
    c = per.withColumn("cp", F.sum("p").over(w)).withColumn("cq", F.sum("q").over(w))
    total = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    c = c.withColumn("tp", F.sum("p").over(total)).withColumn("tq", F.sum("q").over(total))
    auc = F.sum(F.col("q") * (F.col("cp") - F.col("p") / 2) / (F.col("tp") * F.col("tq")))
    ap = F.sum(F.col("p") / F.col("tp") * F.col("cp") / (F.col("cp") + F.col("cq")))
    both = F.max("tp") * F.max("tq") > 0
    safe = c.withColumns({k: F.when(F.col(k) > 0, F.col(k)) for k in ("tp", "tq")})
    return safe.agg(F.when(both, auc).alias("roc_auc"), F.when(both, ap).alias("average_precision"))


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    counts = df.agg(*[v.alias(k) for k, v in confusion(F.col(label), (F.col(score) >= threshold).cast("int")).items()])
    return rates(counts).crossJoin(ranking_metrics(df, label, score))  # one row each


def metrics_by_group(df: DataFrame, group: str, label: str, score: str, threshold: float) -> DataFrame:
    return rates(df.groupBy(group).agg(*[v.alias(k) for k, v in confusion(F.col(label), (F.col(score) >= threshold).cast("int")).items()]))


def macro_mean(per_group: DataFrame, column: str) -> DataFrame:
    """Mean over the groups that have a value, and how many have."""
    return per_group.agg(F.avg(column).alias(f"macro_{column}"), F.count(column).alias("groups"))
