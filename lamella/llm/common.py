"""Helpers shared by the training-data operators: shared storage, batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators.masks import merge_nodes

#: White space as the word contracts name it: byte 32 and bytes 9 to 13, as bytes.split() has it.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z and nothing else.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that all executors share; a local one only where none is configured, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir() + "/lamella-checkpoints"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes df to shared storage and reads it back."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a materialised frame that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def bucketed(df: DataFrame, tag: str, key: str) -> tuple[DataFrame, str]:
    """As ``materialise``, but a table of buckets by key, one a shuffle partition: later joins by key move only their
    other side. Also the table's name, for ``drop``. A frame that comes from a join by key is not shuffled again."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{tag}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).option("path", shared_path(spark, tag)).saveAsTable(name)
    return spark.table(name), name


def drop(df: DataFrame, name: str) -> None:
    """Removes a bucketed table and its files."""
    remove(df)
    df.sparkSession.sql(f"DROP TABLE {name}")


@contextmanager
def session(spark: SparkSession, rows: int) -> Iterator[None]:
    """For actions inside: batches sent to Python hold at most so many rows, and shuffle files go as soon as the action
    that wrote them has ended. Both settings are put back afterwards."""
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of a batch sent to Python, as single texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold at most so many bytes, or a single row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(size):
        if i > at and held + n > most_bytes:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if batch.num_rows > at:
        yield batch.slice(at)


def id_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def hash_sample(df: DataFrame, key: Column, fraction: float, seed: int = 11) -> DataFrame:
    """A repeatable sample of about this fraction of the rows, by a hash of key."""
    if fraction >= 1:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(fraction * (1 << 30)))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges, in any direction, to (node, root): the smallest node of each component that has an edge."""
    return merge_nodes(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), []).select("node", "root")
