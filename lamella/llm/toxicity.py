"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of bytes other than white space and ASCII punctuation, A-Z lower-cased. Features are
words, their stems (the first bytes, at two lengths, so that inflected forms share a weight),
neighbouring pairs and pairs with one word between, hashed into ``2**BITS`` buckets; a feature
is present or absent in a document. Fitting makes ``EPOCHS`` passes of FTRL-proximal with per-coordinate
rates; the L1 term leaves few non-zero weights, which are broadcast as (bucket, weight) arrays of at
most ``2**BITS`` entries.

Fitting uses a repeatable sample of about ``max_docs`` labelled documents (whole texts).

Defined results: null and empty texts have the bias feature alone; without labels every score is 0.5;
a document labelled more than once is toxic if any label says so; null labels and labels without a
document are left out; null ids count as not held out; repeated rows are scored one by one; other
columns pass by.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hash_sample, id_mod, small_batches

BITS = 20
MAX_DOCS = 12_000
MAX_TEXT = 64 << 20  # bytes of their texts, to some two bytes of features each
EPOCHS = 5
STEMS = (4, 5)
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.0
THRESHOLD = 0.7
_MASK = np.uint32((1 << BITS) - 1)
_TABLE = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))
_CACHE_WORDS = 400_000


class WordHashes(dict):
    """word -> its hash and those of its stems, in one number: 24, 20 and 20 bits."""

    def __missing__(self, word: bytes) -> int:
        stems = [zlib.crc32(word[:k], k) & int(_MASK) for k in STEMS]
        h = self[word] = (zlib.crc32(word) >> 8) << 2 * BITS | stems[0] << BITS | stems[1]
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return (h ^ (h >> np.uint32(16))) & _MASK


def hashed(texts: list[str | None], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all texts, with repeats, and the row of each."""
    words = [(t or "").encode().translate(_TABLE).split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    if len(cache) > _CACHE_WORDS:
        cache.clear()
    packed = np.fromiter((cache[w] for ws in words for w in ws), np.uint64, int(n.sum()))
    h = (packed >> np.uint64(2 * BITS)).astype(np.uint32)
    stems = [(packed >> np.uint64(s)).astype(np.uint32) & _MASK for s in (BITS, 0)]
    row = np.repeat(np.arange(len(words), dtype=np.int32), n)
    parts, rows = [_mix(h), *stems], [row, row, row]
    for gap, salt in ((1, 0x9E3779B1), (2, 0x85EBCA77)):
        same = row[gap:] == row[:-gap] if len(row) > gap else np.zeros(0, bool)
        pair = h[:-gap] * np.uint32(salt) + h[gap:] if len(row) > gap else np.zeros(0, np.uint32)
        parts.append(_mix(pair)[same])
        rows.append(row[gap:][same] if len(row) > gap else np.zeros(0, np.int32))
    return np.concatenate(parts), np.concatenate(rows)


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(distinct buckets, label) rows, in a fixed order, to the non-zero (bucket, weight) arrays and the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == bias, 0.0, L1)
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for buckets, label in rows:
            i = np.append(buckets, bias)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(bias + 1))
    used = np.flatnonzero(w[:bias])
    return used.astype(np.int32), w[used], float(w[bias])


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_text: int = MAX_TEXT) -> tuple[np.ndarray, np.ndarray, float]:
    """(doc_id, text) and (doc_id, toxic) rows to a model, of at most about max_docs documents and max_text bytes."""
    labels = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    size = labels.join(docs.select("doc_id", F.octet_length("text").alias("size")), "doc_id").agg(F.count("*").alias("n"), F.sum("size").alias("text")).first()
    share = min(max_docs / max(size["n"], 1), max_text / max(size["text"] or 0, 1))
    rows = hash_sample(labels, F.col("doc_id"), share).join(docs.select("doc_id", "text"), "doc_id")

    def features(batches):
        cache = WordHashes()
        for batch in batches:
            f, row = hashed(batch.column(1).to_pylist(), cache)
            cuts = np.searchsorted(np.sort(row), np.arange(1, batch.num_rows))
            by = np.split(f[np.argsort(row, kind="stable")], cuts)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([np.unique(x).astype("<i4").tobytes() for x in by], pa.binary()), batch.column(2).cast(pa.int32())], ["doc_id", "features", "label"])

    got = rows.select("doc_id", "text", "label").mapInArrow(features, "doc_id long, features binary, label int").toArrow()
    table = sorted(zip(got["doc_id"].to_pylist(), got["features"].to_pylist(), got["label"].to_pylist(), strict=True))
    order = np.random.default_rng(7).permutation(len(table))
    return train([(np.frombuffer(table[i][1], "<i4"), table[i][2]) for i in order])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, text) rows to doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        used, weights, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[used] = weights
        cache = WordHashes()
        for batch in batches:
            f, row = hashed(batch.column(1).to_pylist(), cache)
            w = dense[f]
            hit = np.flatnonzero(w)
            pairs = np.unique(row[hit].astype(np.int64) << BITS | f[hit])  # a feature counts once in a document
            total = bias + np.bincount(pairs >> BITS, dense[pairs & int(_MASK)], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir)
    held = id_mod("doc_id", 3) == 1
    model = fit(docs.filter(~held), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
