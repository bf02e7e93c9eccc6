"""Groups of linked classes from runs that share a key: candidates by fingerprints, links confirmed on whole shingle sets.

Classes are texts with equal sets; a run is the classes that share a key. First each class is compared with one class of each of its
runs, the least; that joins large families at a few pairs a class. Then the classes of a run of three or more that are still in
different groups are compared in tiles (``tiles.py``), by fingerprints and then, where these leave a candidate, by their sets, which the
members of a tile bring along: no pair leaves its task but links between groups that nothing else in the tile has joined. Every
link is confirmed by the intersection of two whole sets, which are made anew for the classes that need them. Sets hold 64-bit hashes
(XXH64, seed 42) of shingles; classes have 128-bit names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from lamella.operators.masks import merge_nodes

from .common import ASCII_LOWER, materialise, remove, session
from .tiles import deal, in_tile_order, meetings

Alike = Callable[..., np.ndarray]
#: Rows with their sets in a task's tiles, beyond what one tile holds.
PART_ROWS = 4000


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles; of the whole sequence if there are fewer words."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    if len(words) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends - 1).tolist(), strict=True)], np.uint64))


def class_name(shingles: np.ndarray) -> bytes:
    return xxh3_128_digest(shingles.tobytes())


def text_name() -> Column:
    """A 128-bit name of the column text, null as empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def sets_of(needed: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(cls) rows to stored cls, items: the whole sets of these classes, from one text each. Where classes have a column name, cls is a number for it."""
    ties = needed.distinct().join(classes.select("cls", "tie"), "cls").select("tie").distinct()
    texts = docs.select("text", text_name().alias("tie")).join(ties, "tie", "left_semi").dropDuplicates(["tie"]).select("text")

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([class_name(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "items"])

    sets = texts.mapInArrow(run, "cls binary, items binary")
    if "name" in classes.columns:
        sets = sets.withColumnRenamed("cls", "name").join(classes.select("name", "cls"), "name").select("cls", "items")
    with session(docs.sparkSession, 256):
        return materialise(sets, "sets")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame | None, width: int, percent: int) -> DataFrame:
    """The (a, b) pairs of classes with 100 * intersection >= percent * union of their whole sets; all pairs without docs."""
    if docs is None:
        return materialise(pairs, "links")
    def linked(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], ["a", "b"])

    with session(docs.sparkSession, 256):
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cls")), classes, docs, width)
        both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")
        found = materialise(both.select("a", "b", "x", "y").mapInArrow(linked, _pair(classes)), "links")
    remove(sets)
    return found


def _pair(classes: DataFrame) -> str:
    return "a {0}, b {0}".format(dict(classes.dtypes)["cls"])


def likely(pairs: DataFrame, classes: DataFrame, alike: Alike) -> DataFrame:
    """The (a, b) pairs whose fingerprints are alike, row by row."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
                ok = pa.array(alike(x, y))
                yield pa.RecordBatch.from_arrays([b.column(i).filter(ok) for i in (0, 1)], ["a", "b"])

    both = pairs.join(classes.select(F.col("cls").alias("a"), F.col("fp").alias("x")), "a").join(classes.select(F.col("cls").alias("b"), F.col("fp").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, _pair(classes))


def groups(classes: DataFrame, keys: DataFrame, docs: DataFrame | None, width: int, percent: int, rows_alike: Alike, tiles_alike: Alike, sketch_bits: int, tile: int, waves: int = 1, own_keys: bool = False) -> DataFrame:
    """Stored classes (cls, fp, tie) and keys (run, cls, sketch) to cls, root: the smallest class of each class's group.

    rows_alike compares fingerprints row by row, tiles_alike all of one matrix with all of another, in a given run; pairs whose sketches differ in
    more than sketch_bits bits are no candidates for it. Runs are compared in so many waves, each of which sees the groups that
    earlier ones have joined. With own_keys, keys is a written table of its own and deleted once it is read.
    """
    sizes = keys.groupBy("run").agg(F.count("*").alias("members"), F.min(F.struct("cls", "sketch")).alias("pivot")).filter("members > 1")
    runs = materialise(keys.join(sizes, "run").select("run", "cls", "sketch", "members", "pivot"), "runs")
    if own_keys:
        remove(keys)
    near = F.bit_count(F.col("sketch").bitwiseXOR(F.col("pivot.sketch"))) <= sketch_bits
    pairs = runs.filter((F.col("cls") != F.col("pivot.cls")) & near).select(F.col("pivot.cls").alias("a"), F.col("cls").alias("b")).distinct()
    first = materialise(likely(pairs, classes, rows_alike), "likely")
    links = confirmed(first, classes, docs, width, percent)
    roots = merge_nodes(links, []).select(F.col("node").alias("cls"), "root")
    rooted = materialise(classes.join(roots, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "fp"), "rooted")

    for df in (first, links):
        remove(df)
    kind = dict(classes.dtypes)["cls"]

    def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_tile_order(pdf)
        seen = np.zeros(len(pdf), bool)
        for x, y in meetings(pdf, tiles_alike, tile):
            seen[x] = seen[y] = True
        return pdf.loc[seen, ["run", "cls"]].drop_duplicates()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_tile_order(pdf)
        root = pdf["root"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["items"]] if "items" in pdf else None
        up: dict = {}

        def top(r):
            while (above := up.get(r, r)) != r:
                up[r] = r = up.get(above, above)
            return r

        out = []
        for x, y in meetings(pdf, tiles_alike, tile):
            for i, own in zip(*_grouped(x, y), strict=True):
                own = own[[top(r) != top(root[i]) for r in root[own]]]
                for j in own[_linked(sets, i, own, percent)] if sets else own:
                    a, b = top(root[i]), top(root[j])
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        out.append((root[i], root[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    # what a wave has written goes with it, so that the disk holds one wave's tables
    for wave in range(waves):
        # a run of two is settled by its pivot
        dealt, tiles = deal(runs.filter((F.col("members") > 2) & (F.pmod(F.xxhash64("run"), F.lit(waves)) == wave)).select("run", "cls"), rooted, tile)
        open_ = materialise(dealt.groupBy("part").applyInPandas(candidates, f"run long, cls {kind}").distinct(), "open")
        remove(tiles)
        own, done = rooted, [open_]
        if docs is not None:
            sets = sets_of(open_.select("cls"), classes, docs, width)
            done.append(sets)
            own = rooted.join(sets, "cls")
        dealt, tiles = deal(open_, own, tile, PART_ROWS)
        late = materialise(dealt.groupBy("part").applyInPandas(compare, _pair(classes)).distinct(), "late")
        joined = merge_nodes(late, []).select(F.col("node").alias("root"), F.col("root").alias("low"))
        done += [tiles, late, rooted]
        rooted = materialise(rooted.join(joined, "root", "left").select("cls", F.coalesce("low", "root").alias("root"), "fp"), "rooted")
        for df in done:
            remove(df)
    out = materialise(rooted.select("cls", "root"), "groups")
    for df in (runs, rooted):
        remove(df)
    return out


def _grouped(x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Pairs of row numbers as each x with all its y."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    edge = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, int)
    return x[edge].tolist(), np.split(y, edge[1:]) if len(x) else []


def _linked(sets: list[np.ndarray], i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of the others are linked with i, by whole sets."""
    size = np.array([len(sets[j]) for j in others], np.int64)
    ok = (100 * np.minimum(size, len(sets[i])) >= percent * np.maximum(size, len(sets[i]))) & (size > 0)
    near = np.flatnonzero(ok)
    for at in range(0, len(near), 256):
        part = near[at : at + 256]
        items = np.concatenate([sets[j] for j in others[part]])
        spot = np.minimum(np.searchsorted(sets[i], items), len(sets[i]) - 1)
        both = np.add.reduceat((sets[i][spot] == items).astype(np.int64), np.append(0, np.cumsum(size[part])[:-1]))
        ok[part] = 100 * both >= percent * (size[part] + len(sets[i]) - both)
    return ok
