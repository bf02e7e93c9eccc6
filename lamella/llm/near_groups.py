"""Near-duplicate groups at a shingle similarity, by long SimHash fingerprints and blocks.

At a Jaccard similarity of 0.8 over five-word shingles, fingerprints differ in up to 15% of their bits,
too many for the exact block scheme over 64 bits. Here a document's distinct shingles give ``BITS``
bits, the signs of random projections; the fingerprint is split into blocks, and documents that share a
block are candidates. Blocks are wide enough that chance meetings stay rare at the corpus' size, and
there are enough of them that a pair at the similarity shares one with probability ``RECALL``.
Candidates are verified by the Hamming distance of all bits, which at this length gives the angle to
within one percent, and then by the intersection of the whole sets, so that no pair below the similarity
is linked. Linked documents form groups (connected components).

Documents with equal shingle sets are one class, and a class is one member. Members that share a block's
value are a run; ``linked.py`` settles runs: one member of each is compared with all others first, then, in
tiles, those that are still in different groups, so that only runs of many groups, such as large
families below the similarity, take work by the square of their size.

Defined results: null text counts as empty; documents without words are one class; fewer words than
``width`` form one shingle; repeated rows are one class; other columns pass by.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linked
from .common import materialise, remove, session
from .linked import class_name, shingle_set, text_name

BITS = 2304
RECALL = 0.95
TILE, WAVES = 1024, 3
SIMILARITY = 0.8
WIDTH = 5
#: Of 32 bits carried along, more differing ones rule a pair out: chance pairs have 16, pairs at the similarity 5.
SKETCH = 12
_GROUP = 256


def signs() -> np.ndarray:
    """For each of eight byte lanes and each byte value, its part in every projection; a lane sums to zero, so that long texts don't lean one way."""
    table = np.random.default_rng(2024).integers(0, 2, (8, 256, BITS), np.int8).astype(np.float32) * 2 - 1
    return (table - table.mean(1, keepdims=True)).reshape(8 * 256, BITS)


def project(sets: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Packed fingerprints, a row a set."""
    lanes = np.arange(8) * 256
    counts = np.stack([np.bincount((s.view(np.uint8).reshape(-1, 8) + lanes).ravel(), minlength=2048) for s in sets]).astype(np.float32)
    return np.packbits(counts @ table > 0, axis=1)


def most_bits(similarity: float) -> int:
    """Differing bits at a Jaccard similarity of equal-sized sets, with a margin of one standard deviation."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(BITS * share + math.sqrt(BITS * share * (1 - share)))


def block_plan(n: int, similarity: float) -> tuple[int, int]:
    """Bits of a block and number of blocks."""
    width = min(60, max(12, math.ceil(math.log2(max(n, 2))) + 4))
    share = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    return width, math.ceil(math.log(1 - RECALL) / math.log1p(-(share**width)))


def members(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text) rows to doc_id, tie (a name of the text), cls, fp, one a row."""

    def run(batches):
        table = signs()
        for b in batches:
            texts = b.column(2).to_pylist()
            for at in range(0, len(texts), _GROUP):
                sets = [shingle_set(t, width) for t in texts[at : at + _GROUP]]
                part = b.slice(at, _GROUP)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([class_name(s) for s in sets], pa.binary()), pa.array([x.tobytes() for x in project(sets, table)], pa.binary())], ["doc_id", "tie", "cls", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_name().alias("tie"), "text")
    with session(docs.sparkSession, 1000):
        return materialise(rows.mapInArrow(run, "doc_id long, tie binary, cls binary, fp binary"), "members")


def block_keys(prints: DataFrame, bits: int, blocks: int) -> DataFrame:
    """(cls, fp) rows to run, cls, sketch: a row for each block, run naming the block and its value."""

    def keys(batches):
        for b in batches:
            if not b.num_rows:
                continue
            fp = np.unpackbits(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1)
            sketch = np.packbits(fp[:, :32], axis=1).view(">u4")[:, 0].astype(np.uint32).view(np.int32)
            out = np.empty((b.num_rows, blocks), np.uint64)
            for k in range(blocks):
                at = (np.arange(bits) + k * bits) % BITS if (k + 1) * bits <= BITS else np.random.default_rng(k).choice(BITS, bits, replace=False)
                value = (fp[:, at].astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.uint64)
                value = (value + np.uint64(k + 1) * np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
                out[:, k] = (value ^ value >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * blocks, pa.int32()), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sketch), rows], ["cls", "sketch", "runs"])

    return prints.select("cls", "fp").mapInArrow(keys, f"cls {dict(prints.dtypes)['cls']}, sketch int, runs array<long>").select("cls", "sketch", F.explode("runs").alias("run"))


def groups(found: DataFrame, similarity: float = SIMILARITY, docs: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """members() rows to cls, root: the smallest class of each class's group. Without docs, links are by fingerprints alone."""
    own = found if docs is not None else found.withColumn("tie", F.lit(None).cast("binary"))
    named = own.groupBy(F.col("cls").alias("name")).agg(F.min(F.struct("tie", "fp")).alias("f")).select("name", "f.*")
    classes = materialise(named.withColumn("cls", F.monotonically_increasing_id()), "long-prints")  # numbers are half as long as names
    bits, blocks = block_plan(classes.count(), similarity)
    most = most_bits(similarity)

    def rows_alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most

    def tiles_alike(x: np.ndarray, y: np.ndarray, run: int) -> np.ndarray:
        a, b = (np.unpackbits(v, axis=1).astype(np.float32) for v in (x, y))
        return a.sum(1)[:, None] + b.sum(1) - 2 * a @ b.T <= most

    with session(found.sparkSession, 2000):
        keys = materialise(block_keys(classes, bits, blocks), "block-keys")
    out = linked.groups(classes, keys, docs, width, round(100 * similarity), rows_alike, tiles_alike, SKETCH, TILE, WAVES, own_keys=True)
    named = classes.select("cls", "name").join(out, "cls")
    low = named.groupBy("root").agg(F.min("name").alias("low"))
    out = materialise(named.join(low, "root").select(F.col("name").alias("cls"), F.col("low").alias("root")), "named")
    remove(classes)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, less all but one of each group: the smallest doc_id (null last), then text hash, stays."""
    found = members(docs)
    first = found.join(groups(found, docs=docs), "cls").groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("no"), "doc_id", "tie")).alias("m"))
    first = first.select(F.col("m.doc_id").alias("keep_id"), F.col("m.tie").alias("keep_tie"))
    whole = docs.select(F.struct("*").alias("row"), text_name().alias("tie"), F.col("doc_id").cast("long").alias("doc_id"))
    kept = whole.join(first, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("tie") == F.col("keep_tie")), "left_semi")
    return kept.dropDuplicates(["doc_id", "tie"]).select("row.*")
