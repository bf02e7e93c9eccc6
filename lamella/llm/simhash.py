"""Near-duplicates by SimHash with pigeonhole blocks.

A text's words are runs of bytes other than white space, A-Z lower-cased; its shingles are ``width``
neighbouring words joined by a space (the whole sequence if there are fewer), repeats included. A
fingerprint bit is 1 if set in over half of the shingles' XXH64 values (seed 42); no words give zero.

Fingerprints that differ in at most two bits agree in at least two of four 16-bit blocks, so each
distinct fingerprint goes to six buckets, one a pair of blocks; fingerprints of a bucket are joined and
their Hamming distance verified. A bucket of more than ``HOT_BUCKET`` distinct fingerprints is not
joined with itself: there each fingerprint names every value within one flip of its 32 other bits, and
those naming a common value are linked to the smallest of them. Two 32-bit values are within two flips
exactly if they name a common one, and those naming one value differ by at most two flips, so the links
are the same up to components, in linear space, without a cap.

Defined results: null text counts as empty; texts without words share fingerprint zero and are linked
like any other; repeated rows and ids stay, one result row each; a null id is never the smallest unless
alone; an empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import ASCII_LOWER, connected_components, documents, materialise, small_batches

SEED = 42
MAX_BITS = 2  # the block scheme is exact for this distance
HOT_BUCKET = 64


def fingerprint(text: str | None, width: int) -> int:
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    if len(words) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text) rows to doc_id, fp: the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _mask(kept: tuple[int, ...]) -> int:
    m = sum(0xFFFF << 16 * b for b in kept)
    return m - (1 << 64) if m >> 63 else m


def links(distinct: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(fp) rows, all different, to (a, b) links: the same components as all pairs within MAX_BITS bits."""
    buckets = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(kept)).cast("long")).alias("v")) for i, kept in enumerate(combinations(range(4), 2))]
    keyed = materialise(distinct.select("fp", F.explode(F.array(*buckets)).alias("k")).select("k.i", "k.v", "fp"), "blocks")
    size = keyed.groupBy("i", "v").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = keyed.join(size, ["i", "v"])
    cold = keyed.filter(F.col("n") <= hot_bucket).select("i", "v", "fp")
    pairs = cold.alias("x").join(cold.alias("y"), ["i", "v"]).filter("x.fp < y.fp")
    pairs = pairs.filter(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MAX_BITS).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    hot = keyed.filter(F.col("n") > hot_bucket)
    free = F.element_at(F.array(*[F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64) if b // 16 not in kept]) for kept in combinations(range(4), 2)]), F.col("i") + 1)
    named = hot.select("i", "v", "fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), free)).alias("flip")).select("i", "v", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("to"))
    low = named.groupBy("i", "v", "to").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)  # at most 33 values name one
    stars = low.select(F.explode("all").alias("a"), "b").filter("a <> b")
    return pairs.unionByName(stars)


def components(prints: DataFrame) -> DataFrame:
    """(doc_id, fp) rows to doc_id, fp, component_id: the smallest doc_id reachable over links."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(links(distinct.select("fp")))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(low, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def cluster(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text) rows to doc_id, fp, component_id."""
    small_batches(docs.sparkSession)
    return components(materialise(fingerprints(docs, width), "prints"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(documents(spark, sf_dir), 3).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
