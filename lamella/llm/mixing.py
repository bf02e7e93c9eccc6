"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target in words: weights 1, 2, 3, repeating over the sources in code-point order
(null last), share all words; a target stops at ``max_epochs`` times its source's size and the excess
is shared again by weight. Within a source the target is met by complete epochs first; the rest goes
to documents in the order of their exponential key -ln(u)/w, w the document's quality weight, by a
prefix sum of sizes. The document at the budget's edge is taken in part, so the words taken equal the
rounded target.

Defined results: null text has size 0 and takes 0; a null source is a source of its own; documents
without a usable label weigh ``UNKNOWN``; repeated rows with one id are mixed one by one (equal keys,
so next to each other, smaller size first); empty tables give empty results; other columns pass by.

Prefix sums are two-level: keys are cut into ranges of about ``RANGE_ROWS`` rows within the source, by
the mixture of the exponential distributions of its documents' weights, ranges are summed, and only rows of one range meet in a task, so a hot source is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_RE, documents, materialise

RANGE_ROWS = 20_000
FEW_SOURCES = 20_000  # a row is some 150 bytes
#: Quality weight of a document labelled 1, labelled 0, and without label; averages of repeated labels lie between.
GOOD, POOR, UNKNOWN = 1.0, 0.25, 0.625
_EIGHTHS = range(2, 9)  # weights, in eighths, of which a source's key distribution is mixed


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight from the labels' mean quality."""
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.lit(POOR) + F.lit(GOOD - POOR) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("quality")))).alias("weight"))


def source_targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """(source, size) rows to one row a source: no_source, source_key, docs, source_size, target.

    The level L at which a source gets weight times L unless capped is the largest, over sources in
    order of cap / weight, of (all words - caps before) / (weights from there on).
    """
    per = sizes.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    rank = F.row_number().over(W.orderBy("no_source", "source_key"))
    per = per.withColumn("w", F.pmod(rank - 1, F.lit(3)) + 1)
    by_ratio = W.orderBy(F.col("source_size") / F.col("w"), "no_source", "source_key")
    total = F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    before = F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * max_epochs
    after = F.sum("w").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    per = per.withColumn("level", (total - before).cast("double") / after)
    level = F.max("level").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return per.withColumn("target", F.least((F.col("source_size") * max_epochs).cast("double"), F.col("w") * level)).select("no_source", "source_key", "docs", "source_size", "target")


def ranged(sizes: DataFrame, weights: DataFrame, max_epochs: int = 3, also: tuple[str, ...] = ()) -> DataFrame:
    """Documents with their key, its range within the source, and the source's numbers."""
    x = sizes.select("doc_id", "size", *also, F.isnull("source").cast("int").alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"))
    per = source_targets(x, max_epochs)
    x = x.join(weights.select(F.col("doc_id").alias("wid"), "weight"), F.col("doc_id") == F.col("wid"), "left").drop("wid")
    digits = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double")
    x = x.withColumn("weight", F.coalesce("weight", F.lit(UNKNOWN))).withColumn("key", -F.log((digits + 0.5) / float(1 << 52)) / F.col("weight"))
    shares = x.groupBy("no_source", "source_key").agg(F.array(*[F.avg((F.rint(F.col("weight") * 8) == k).cast("double")) for k in _EIGHTHS]).alias("shares"))
    per = materialise(per.join(shares, ["no_source", "source_key"]), "sources")
    # a table of few sources goes to every task, so that a hot source's documents are not gathered for the join
    x = x.join(F.broadcast(per) if per.count() <= FEW_SOURCES else per, ["no_source", "source_key"])
    # a key's place among its source's keys, by the mixture of their distributions: it grows with the key whatever the weights
    place = sum((F.col("shares")[i] * (1 - F.exp(-F.col("key") * (k / 8))) for i, k in enumerate(_EIGHTHS)), F.lit(0.0))
    ranges = F.ceil(F.col("docs") / RANGE_ROWS)
    return x.withColumn("range", F.least(ranges - 1, F.floor(ranges * place)).cast("long"))


def mix(sizes: DataFrame, weights: DataFrame, max_epochs: int = 3, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size) and (doc_id, weight) to doc_id, size, source_size, target, taken, and the columns in also."""
    x = ranged(sizes, weights, max_epochs, also)
    cols = ["no_source", "source_key", "range"]
    step = x.groupBy(*cols).agg(F.sum("size").alias("range_size"))
    step = step.withColumn("base", F.coalesce(F.sum("range_size").over(W.partitionBy("no_source", "source_key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("range_size")
    within = W.partitionBy(*cols).orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(step, cols)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    x = x.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    taken = F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("base") - F.col("within")))
    return x.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *also)


def word_sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"))


def mix_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    return mix(materialise(word_sizes(docs), "mix-sizes"), quality_weights(labels))


def mixed_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The mix as documents, all columns: a row for each complete pass over a document, and one with its
    first words where it is taken in part. Rows equal in id and text are one document here."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")
    own = [F.col("doc_id"), F.xxhash64("text").alias("tie")]
    sizes = materialise(docs.select(*own, "source", size.alias("size")).dropDuplicates(["doc_id", "tie"]), "mix-sizes")
    per = mix(sizes, quality_weights(labels), also=("tie",)).filter("taken > 0")
    per = per.select(F.col("doc_id").alias("mix_id"), F.col("tie").alias("mix_tie"), F.expr("taken div size").alias("passes"), F.expr("taken % size").alias("part"))
    whole = docs.select(F.struct("*").alias("row"), *own)
    x = whole.join(per, F.col("doc_id").eqNullSafe(F.col("mix_id")) & (F.col("tie") == F.col("mix_tie"))).dropDuplicates(["doc_id", "tie"])
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0))))
    cut = F.col("copy") > F.col("passes")
    text = F.when(cut, F.array_join(F.slice(F.regexp_extract_all(F.col("row").getField("text"), F.lit(WORD_RE), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")).otherwise(F.col("row").getField("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.char_length(text)).otherwise(F.col("row").getField("n_chars")).cast(docs.schema["n_chars"].dataType)
    return x.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, CAST(source IS NULL AS INT) AS no_source, coalesce(source, '') AS source_key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
l AS (SELECT doc_id AS wid, 0.25 + 0.75 * least(1.0, greatest(0.0, avg(quality))) AS weight
      FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
s AS (SELECT no_source, source_key, sum(size)::BIGINT AS source_size FROM d GROUP BY 1, 2),
r AS (SELECT *, (row_number() OVER (ORDER BY no_source, source_key) - 1) % 3 + 1 AS w FROM s),
v AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
        ORDER BY source_size::DOUBLE / w, no_source, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(w) OVER (ORDER BY source_size::DOUBLE / w, no_source, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
      FROM r),
t AS (SELECT no_source, source_key, source_size, least((3 * source_size)::DOUBLE, w * max(lev) OVER ()) AS target FROM v),
k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.no_source, d.source_key,
         -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / coalesce(l.weight, 0.625) AS key,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs
  FROM d JOIN t USING (no_source, source_key) LEFT JOIN l ON l.wid = d.doc_id),
p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY no_source, source_key ORDER BY key, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM p
"""
