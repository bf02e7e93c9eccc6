"""Approximate nearest neighbours by collision-counting hashing, query-centred.

Every block of the base holds one sorted array for each of ``PROJECTIONS`` random projections. A query
opens a window around its own projection in each array and widens it by virtual rehashing. A vector that
lies in the windows of at least ``THRESHOLD`` of all projections is verified by its exact score. The
search widens until a vector as near as the k-th best found would have collided with high probability:
its projected differences are normal with its distance for deviation, so that a window of ``Z`` distances
holds ``THRESHOLD`` of them on average, and ``MARGIN`` times that all but a few. Nothing else ends a
search; an infinite margin verifies every vector, which is the exact way.

Nearness is the largest inner product. It becomes Euclidean distance by scaling with the largest norm M
and adding one coordinate sqrt(1 - |x|^2 / M^2), 0 for the unit query, which keeps the order.

Blocks are of bounded size (about ``BLOCK`` rows, by a hash of the id). A query first widens step by step
in one block, its home. The k-th best there bounds the windows in all other blocks, which it enters at
that width, counting once. Queries come in bounded chunks; each block-and-chunk pair is one task's work.
Copies of one vector collide together, so that ties are exact.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do null ids; rows equal in id and vector count once; rows of one id with different vectors are
queries and candidates of their own; vectors of different lengths do not meet; fewer candidates than k
give fewer rows; other columns pass by.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

PROJECTIONS = 96
THRESHOLD = 0.8
#: Half-width, in standard deviations of the projected difference, at which a vector collides with probability THRESHOLD.
Z = 1.2815515655446004
MARGIN = 1.15
START, GROWTH = 0.6, 1.5
BLOCK = 8192
CHUNK = 4096
K = 20


class Block:
    """One block of the base: its vectors and sorted projections."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray, top_norm: float, projections: int = PROJECTIONS):
        self.ids, self.keys, self.vectors, self.top = ids, keys, vectors, max(top_norm, 1e-300)
        self.directions = np.random.default_rng(97).standard_normal((vectors.shape[1] + 1, projections))
        scaled = vectors / self.top
        extra = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", scaled, scaled)))
        p = (scaled @ self.directions[:-1] + extra[:, None] * self.directions[-1]).T
        n = len(ids)
        order = np.argsort(p, axis=1, kind="stable")  # the sorted arrays: [projection, place] -> row
        kind = np.uint16 if n < 1 << 16 else np.uint32
        self.place = np.empty((projections, n), kind)
        np.put_along_axis(self.place, order, np.arange(n, dtype=kind)[None, :], 1)
        # one ascending array: each projection's sorted values, shifted apart, so that one call finds all windows
        self.reach = float(np.abs(p).max()) + 1 if n else 1.0
        self.shift = np.arange(projections) * 4 * self.reach
        self.values = (np.take_along_axis(p, order, 1) + self.shift[:, None]).ravel()
        self.base = np.arange(projections) * n
        self.need = int(np.ceil(THRESHOLD * projections))
        self.offset, self.inside = np.empty_like(self.place), np.empty(self.place.shape, bool)

    def ends(self, at: np.ndarray, side: str) -> np.ndarray:
        return np.searchsorted(self.values, np.clip(at, -self.reach, self.reach) + self.shift, side) - self.base

    def collisions(self, centre: np.ndarray, width: float) -> np.ndarray:
        """For each vector, the windows that hold it."""
        low, high = self.ends(centre - width, "left"), self.ends(centre + width, "right")
        kind = self.place.dtype
        np.subtract(self.place, low.astype(kind)[:, None], out=self.offset)  # wraps round below the window
        np.less(self.offset, (high - low).astype(kind)[:, None], out=self.inside)
        m = len(self.place)
        return sum(np.add.reduce(self.inside[j : j + 255].view(np.uint8), 0, np.uint8).astype(np.int32) for j in range(0, m, 255))

    def search(self, query_id: int, key: int, query: np.ndarray, k: int = K, bound: float | None = None, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best found, best first, ties to smaller ids; with a bound, of those that reach it."""
        size = np.linalg.norm(query)
        centre = (query / size) @ self.directions[:-1]

        def wide(score: float) -> float:
            """Half-width at which vectors of this score collide."""
            return float("inf") if margin == float("inf") else np.sqrt(max(0.0, 2 - 2 * score / (self.top * size))) * Z * margin

        verified = (self.ids == query_id) & (self.keys == key)  # the query itself takes no part
        found, score = np.zeros(0, np.int64), np.zeros(0)
        width = START if bound is None else wide(bound)
        last = bound is not None
        while True:
            new = np.flatnonzero((self.collisions(centre, width) >= self.need) & ~verified)
            if len(new):
                verified[new] = True
                got = (self.vectors[new] * query).sum(1)  # row by row alike, so that equal vectors score equally
                if bound is not None:
                    new, got = new[got >= bound], got[got >= bound]
                found, score = np.concatenate([found, new]), np.concatenate([score, got])
                best = np.lexsort((self.ids[found], -score))[:k]
                found, score = found[best], score[best]
            if last or verified.all():
                return self.ids[found], score
            if len(found) >= k:  # the k-th best only gets better, so that this width is enough
                last, width = True, max(width, wide(score[k - 1]))
            else:
                width *= GROWTH


def pack(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Valid rows as id, dim, norm, vec (little-endian doubles)."""
    v = F.col(vector_column).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(good).filter(F.exists("v", lambda x: x != 0)).distinct()

    def run(batches):
        for b in batches:
            lists = [np.array(x, "<f8") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in lists], pa.int32()), pa.array([float(np.linalg.norm(x)) for x in lists]), pa.array([x.tobytes() for x in lists], pa.binary())], ["id", "dim", "norm", "vec"])

    return rows.mapInArrow(run, "id long, dim int, norm double, vec binary").withColumn("key", F.xxhash64("vec"))


def search(base: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, chunk: int = CHUNK, margin: float = MARGIN) -> DataFrame:
    """Packed base and query rows to query_id, rank, vec_id, score; rows of one query share query_id and query_key."""
    per = {r["dim"]: (r["n"], r["top"]) for r in base.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}
    asked = {r["dim"]: r["n"] for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    dims = sorted(set(per) & set(asked)) or [0]
    blocks = {d: max(1, -(-per.get(d, (0, 0))[0] // block)) for d in dims}
    first_chunks = {d: max(1, -(-asked.get(d, 0) // (blocks[d] * chunk))) for d in dims}
    chunks = {d: max(1, -(-asked.get(d, 0) // chunk)) for d in dims}
    tops = {d: per.get(d, (0, 1.0))[1] for d in dims}

    def by_dim(x: dict) -> F.Column:
        return F.create_map(*[F.lit(y) for d in dims for y in (d, x[d])])[F.col("dim")]

    def hashed(salt: int, n: F.Column) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(salt), "id", "key"), n.cast("long")).cast("int")

    def copies(n: F.Column) -> F.Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    def work(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            index = Block(left["id"].to_numpy(), left["key"].to_numpy(), np.stack([np.frombuffer(x, "<f8") for x in left["vec"]]), tops[int(key[0])])
            for i, own, x, bound in zip(right["id"], right["key"], right["vec"], right["bound"], strict=True):
                out.append(index.search(int(i), int(own), np.frombuffer(x, "<f8"), k, None if pd.isna(bound) else bound, margin))
        elif len(right):
            out = [(np.zeros(0, np.int64), np.zeros(0))] * len(right)
        done = right[["dim", "id", "key", "vec", "block"]].copy()
        for j, name in enumerate(("ids", "scores")):
            done[name] = pd.Series([x[j] for x in out], dtype=object, index=done.index)
        return done

    keys, schema = ["dim", "block", "chunk"], "dim int, id long, key long, vec binary, block int, ids array<long>, scores array<double>"
    here = F.col("dim").isin(dims)
    b = base.filter(here).select("dim", "id", "key", "vec", hashed(1, by_dim(blocks)).alias("block"))
    q = queries.filter(here).select("dim", "id", "key", "vec", hashed(2, by_dim(blocks)).alias("block"), hashed(3, by_dim(first_chunks)).alias("chunk"), F.lit(None).cast("double").alias("bound"))
    home = b.select("*", copies(by_dim(first_chunks)).alias("chunk"))
    near = materialise(home.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(work, schema), "home")

    bound = F.when(F.size("scores") >= k, F.element_at("scores", k))
    further = near.select("dim", "id", "key", "vec", F.col("block").alias("home"), copies(by_dim(blocks)).alias("block"), hashed(4, by_dim(chunks)).alias("chunk"), bound.alias("bound")).filter("block <> home")
    other = b.select("*", copies(by_dim(chunks)).alias("chunk"))
    far = other.groupBy(*keys).cogroup(further.groupBy(*keys)).applyInPandas(work, schema)
    hits = near.unionByName(far).select(F.col("id").alias("query_id"), F.col("key").alias("query_key"), F.explode(F.arrays_zip("ids", "scores")).alias("hit"))
    hits = hits.select("query_id", "query_key", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = materialise(pack(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"), "vectors")
    return search(base, base.filter("id % 20 = 0"), K)
