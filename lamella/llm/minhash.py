"""Near-duplicates by MinHash with tensored banding, links confirmed on whole shingle sets.

A text's words are runs of bytes other than white space, A-Z lower-cased; its set is the distinct hashes of its shingles of
``width`` words (the whole sequence if there are fewer). Two texts are linked if 100 * intersection >= 80 * union.

Keys of plain banding need a minhash each for every row of every table. Here two collections of ``HALVES`` keys of ``ROWS``
minhashes are made, and table (i, j) has the key (A_i, B_j): 2 * 14 * 3 = 84 minhashes serve 196 tables of six rows. A pair at
similarity s shares a table with probability (1 - (1 - s^3)^14)^2: 0.9999 at 0.8, and more above. Tables are not written
out: members meet in runs of equal A_i, and only those with an equal B_j are candidates. Candidates of fewer than ``LEAST``
equal minhashes of 84 (about one in 10,000 pairs at 0.8) are not verified.

Texts with equal sets are one class. ``linked.py`` compares classes with one class of each run first, then, in tiles, those still in
different groups, and confirms every link by the intersection of the whole sets. Sets hold 64-bit hashes of shingles; shingles' bytes
are not compared.

Defined results: null text counts as empty; texts without words have no set and are linked with nothing; repeated rows stay, one
result row each; a null id is never a component's smallest unless alone, and its row is not kept; an empty table gives an empty
result; other columns pass by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tiles
from .common import documents, materialise, remove, session
from .linked import class_name, groups, shingle_set, text_name

WIDTH = 4
PERCENT = 80
ROWS, HALVES = 3, 14
HASHES = 2 * ROWS * HALVES
LEAST = 52
_STEP = 1 << 13


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minhashes(shingles: np.ndarray, by: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """HASHES 32-bit minima over a set that isn't empty."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _STEP):
        low = np.minimum(low, (shingles[at : at + _STEP, None] * by[0] + by[1]).min(0))
    return (low >> np.uint64(32)).astype(np.uint32)


def half_keys(sigs: np.ndarray) -> np.ndarray:
    """The keys A_i of signatures, one column an i."""
    part = sigs[:, : ROWS * HALVES].reshape(len(sigs), HALVES, ROWS).astype(np.uint64)
    key = np.full(part.shape[:2], 1, np.uint64) + np.arange(HALVES, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ part[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return (key & ~np.uint64(15) | np.arange(HALVES, dtype=np.uint64)).view(np.int64)  # the low bits say which


def alike(x: np.ndarray, y: np.ndarray, run: int | None = None) -> np.ndarray:
    """For two byte matrices of signatures: which pairs share a key B_j and have LEAST equal minhashes; in the first of their runs, if one is given."""
    x, y = x.view(np.uint32), y.view(np.uint32)
    same = np.zeros((len(x), len(y)), np.uint8)
    shared, earlier = np.zeros((len(x), len(y)), bool), np.zeros((len(x), len(y)), bool)
    for j in range(HASHES // ROWS):
        all_rows = True
        for k in range(j * ROWS, j * ROWS + ROWS):
            equal = x[:, k, None] == y[:, k]
            same += equal
            all_rows = all_rows & equal
        if j >= HALVES:
            shared |= all_rows
        elif run is not None and j < run & 15:
            earlier |= all_rows
    return shared & ~earlier & (same >= LEAST)


def rows_alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same, row by row."""
    equal = x.view(np.uint32) == y.view(np.uint32)
    return equal[:, ROWS * HALVES :].reshape(len(x), HALVES, ROWS).all(2).any(1) & (equal.sum(1) >= LEAST)


def members(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text) rows to doc_id, cls, n, tie, sig, halves, one a row."""

    def run(batches):
        by = multipliers()
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column(2).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = np.zeros((len(sets), HASHES), np.uint32)
            for i in full:
                sig[i] = minhashes(sets[i], by)
            known = [len(s) > 0 for s in sets]
            cls = [class_name(s) if k else None for s, k in zip(sets, known, strict=True)]
            halves = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * HALVES, pa.int32()), pa.array(half_keys(sig).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), b.column(1), pa.array([x.tobytes() if k else None for x, k in zip(sig, known, strict=True)], pa.binary()), halves], ["doc_id", "cls", "n", "tie", "sig", "halves"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_name().alias("tie"), "text")
    with session(docs.sparkSession, 256):
        return materialise(rows.mapInArrow(run, "doc_id long, cls binary, n long, tie binary, sig binary, halves array<long>"), "members")


def cluster(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text) rows to doc_id, n_shingles, component_id, kept."""
    found = members(docs, width)
    first = F.min_by(F.struct(F.col("sig").alias("fp"), "halves", "tie"), "tie")
    classes = materialise(found.filter("cls IS NOT NULL").groupBy("cls").agg(first.alias("f"), F.min("doc_id").alias("first")).select("cls", "f.*", "first"), "classes")
    keys = classes.select("cls", F.explode("halves").alias("run"), F.lit(0).alias("sketch"))
    rooted = groups(classes, keys, docs, width, PERCENT, rows_alike, alike, 0, tiles.TILE)
    named = materialise(rooted.join(classes.select("cls", "first"), "cls"), "first")
    remove(classes)
    low = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = named.join(low, "root").select("cls", "component_id")
    out = found.select("doc_id", "n", "cls").join(by_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(documents(spark, sf_dir))
