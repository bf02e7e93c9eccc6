"""Pairs of a run's members that are still in different groups, in tiles that spread over tasks.

A run is a set of members that share a hash value. The members of a run's largest group meet only those outside it, the rest
meet all; each side is dealt by a hash into chunks of about ``TILE`` members and each pair of chunks is a tile, so that no run is
gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

TILE = 1024
TILE_ROWS = 20_000


def deal(runs: DataFrame, rooted: DataFrame, tile_size: int = TILE, part_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(run, cls) rows and classes' (cls, root, fp) to the rows of all tiles with cls, root, fp and the tile's part, and the written table to remove after them."""
    placed = runs.join(rooted.select("cls", "root"), "cls")
    sizes = placed.groupBy("run", "root").agg(F.count("*").alias("n")).groupBy("run").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"))
    # the largest group's members meet the rest, the rest meets all: tiles are pairs of a chunk of the rest and any chunk
    sizes = sizes.filter("n > top.n").select("run", F.col("top.root").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / tile_size).alias("chunks"), F.ceil(F.col("top.n") / tile_size).alias("top_chunks"))
    placed = placed.join(sizes, "run").withColumn("in_top", F.col("root") == F.col("top"))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), "cls"), F.when(F.col("in_top"), F.col("top_chunks")).otherwise(F.col("chunks"))))

    def tiles(low, high, tile):
        return F.when(low <= high, F.transform(F.sequence(low, high), tile)).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,top:boolean,left:boolean>>"))

    def tile(i, j, top, left):
        return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(top).alias("top"), F.lit(left).alias("left"))

    zero, own, end = F.lit(0).cast("long"), F.col("chunk"), F.col("chunks") - 1
    rest = F.concat(tiles(own, end, lambda j: tile(own, j, False, True)), tiles(zero, own - 1, lambda i: tile(i, own, False, False)), tiles(zero, F.col("top_chunks") - 1, lambda j: tile(own, j, True, True)))
    dealt = placed.select("run", "cls", F.explode(F.when(F.col("in_top"), tiles(zero, end, lambda i: tile(i, own, True, False))).otherwise(rest)).alias("t")).select("run", "cls", "t.*")
    stored = materialise(dealt, "tiles")
    parts = max(1, -(-stored.count() // part_rows))
    dealt = stored.withColumn("tile", F.xxhash64("run", "i", "j", "top")).withColumn("part", F.pmod("tile", F.lit(parts)))
    return dealt.join(rooted, "cls"), stored


def meetings(pdf: pd.DataFrame, alike: Callable[[np.ndarray, np.ndarray, int], np.ndarray], tile_size: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (x, y) of a part's sorted rows: pairs of different roots in a common tile whose fingerprints are alike.

    alike takes two byte matrices, a row a member, and the run, and returns a boolean matrix.
    """
    edge = np.flatnonzero((pdf[["run", "i", "j", "top"]] != pdf[["run", "i", "j", "top"]].shift()).any(axis=1).to_numpy())
    fp = np.frombuffer(b"".join(pdf["fp"]), np.uint8).reshape(len(pdf), -1)
    run = pdf["run"].tolist()
    root, left, same = pdf["root"].to_numpy(), pdf["left"].to_numpy(), ((pdf["i"] == pdf["j"]) & ~pdf["top"]).to_numpy()
    for a, b in zip(edge, np.append(edge[1:], len(pdf)), strict=True):
        x = a + np.flatnonzero(left[a:b])
        y = x if same[a] else a + np.flatnonzero(~left[a:b])
        for at in range(0, len(x), tile_size):
            own = x[at : at + tile_size]
            i, j = np.nonzero(alike(fp[own], fp[y], run[a]) & (root[own, None] != root[y]))
            yield own[i], y[j]


def in_tile_order(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["run", "i", "j", "top"], kind="stable").reset_index(drop=True)
