"""Level lines of images of any size: crossings and segments by expressions over squares of four pixels, chains by pointer doubling.

A crossing lies on the side between two neighbouring pixels on different sides of the level, interpolated between them. Segments follow
the rule of ``geometry.half_contours``: high values stay on one side, and high corners across a saddle stay apart. A crossing begins
at most one segment and ends at most one. Chains are ordered by list ranking: each crossing knows its predecessor and jumps twice
as far each round, so that a chain of n points takes log2(n) joins and no chain is walked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.storage import discard, stored


def _links(case: int) -> list[tuple[int, int]]:
    """(first side, last side) of the segments of a square whose high corners are the case's bits, clockwise from the upper left; sides follow their corner."""
    up = [bool(case >> i & 1) for i in range(4)]
    out = []
    for i in range(4):
        if up[i] and not up[i - 1]:
            last = next(j for j in range(i, i + 4) if up[j % 4] and not up[(j + 1) % 4]) % 4
            out.append((last, (i - 1) % 4))
    return out


def segments(pixels: DataFrame, by: list[str], level: float = 0.5) -> DataFrame:
    """(by, row, col, v) to by, a, b, xa, ya, xb, yb: segments from crossing a to crossing b, named by their pixels and direction."""
    line = W.partitionBy(*by, "row").orderBy("col")
    right = pixels.select(*by, "row", "col", F.col("v").cast("double").alias("v0")).withColumns({"v1": F.lead("v0").over(line), "next": F.lead("col").over(line)})
    right = right.filter(F.col("next") == F.col("col") + 1).drop("next")
    below = right.select(*by, (F.col("row") - 1).alias("row"), "col", F.col("v0").alias("v3"), F.col("v1").alias("v2"))
    x = right.join(below, [*by, "row", "col"])
    case = sum((F.when(F.col(f"v{i}") > level, 1 << i).otherwise(0) for i in range(4)), F.lit(0))
    key = lambda r, c, down: F.shiftleft(r.cast("long"), 33) + F.shiftleft(c.cast("long"), 1) + down
    r, c = F.col("row"), F.col("col")
    part = lambda i, j: (F.lit(level) - F.col(f"v{i}")) / (F.col(f"v{j}") - F.col(f"v{i}"))
    side = [
        F.struct(key(r, c, 0).alias("k"), (c + part(0, 1)).alias("x"), r.cast("double").alias("y")),
        F.struct(key(r, c + 1, 1).alias("k"), (c + 1).cast("double").alias("x"), (r + part(1, 2)).alias("y")),
        F.struct(key(r + 1, c, 0).alias("k"), (c + part(3, 2)).alias("x"), (r + 1).cast("double").alias("y")),
        F.struct(key(r, c, 1).alias("k"), c.cast("double").alias("x"), (r + part(0, 3)).alias("y")),
    ]
    both = lambda n: F.array(*[F.struct(side[a].alias("a"), side[b].alias("b")) for a, b in _links(n)])
    found: Column = F.lit(None)
    for n in range(1, 15):
        found = F.when(F.col("case") == n, both(n)).otherwise(found)
    x = x.withColumn("case", case).filter("case BETWEEN 1 AND 14").withColumn("s", F.explode(found))
    return x.select(*by, F.col("s.a.k").alias("a"), F.col("s.b.k").alias("b"), F.col("s.a.x").alias("xa"), F.col("s.a.y").alias("ya"), F.col("s.b.x").alias("xb"), F.col("s.b.y").alias("yb"))


def chains(pixels: DataFrame, by: list[str], level: float = 0.5) -> DataFrame:
    """(by, row, col, v) to by, chain, pos, x, y, closed: the points of each level line in order, a closed line's first point again at its end.

    chain is the crossing that the line begins with: where the image cuts it, else the smallest.
    """
    s = stored(segments(pixels, by, level), "segments")
    points = s.select(*by, F.col("a").alias("k"), F.col("xa").alias("x"), F.col("ya").alias("y")).unionByName(s.select(*by, F.col("b").alias("k"), F.col("xb").alias("x"), F.col("yb").alias("y"))).dropDuplicates([*by, "k"])
    before = s.select(*by, F.col("b").alias("k"), F.col("a").alias("jump"))
    now = stored(points.select(*by, "k").join(before, [*by, "k"], "left").withColumn("low", F.least("k", F.coalesce("jump", "k"))), "jumps")
    most = now.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(max(1, most).bit_length()):  # after it, low is the least crossing of a closed line
        far = now.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("k").alias("to"), F.col("jump").alias("then"), F.col("low").alias("low2"))
        hit = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("jump") == F.col("to")]
        old, now = now, stored(now.join(far, hit, "left").select(*by, "k", F.col("then").alias("jump"), F.least("low", F.coalesce("low2", "low")).alias("low")), "jumps")
        discard(old)
        if now.filter("jump IS NOT NULL").isEmpty():
            break
    closed = F.col("jump").isNotNull()  # a closed line never runs out of predecessors
    heads = now.select(*by, "k", closed.alias("closed"), (closed & (F.col("k") == F.col("low"))).alias("cut"))
    rank = heads.join(before, [*by, "k"], "left").select(*by, "k", "closed", F.when(F.col("cut"), None).otherwise(F.col("jump")).alias("jump"))
    rank = stored(rank.withColumns({"pos": F.when(F.col("jump").isNull(), 0).otherwise(1).cast("long"), "head": F.coalesce("jump", "k")}), "ranks")
    while not rank.filter("jump IS NOT NULL").isEmpty():
        far = rank.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("k").alias("to"), F.col("jump").alias("then"), F.col("pos").alias("more"), F.col("head").alias("head2"))
        hit = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("jump") == F.col("to")]
        old, rank = rank, stored(rank.join(far, hit, "left").select(*by, "k", "closed", F.col("then").alias("jump"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"), F.coalesce("head2", "head").alias("head")), "ranks")
        discard(old)
    out = rank.join(points, [*by, "k"]).select(*by, F.col("head").alias("chain"), "pos", "x", "y", "closed")
    size = out.filter("closed").groupBy(*by, "chain").agg(F.count("*").alias("pos"))
    again = out.filter("closed AND pos = 0").drop("pos").join(size, [*by, "chain"]).select(*by, "chain", "pos", "x", "y", "closed")
    return out.unionByName(again)


def measures(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines to by, chain, points, length, area (of closed lines, above the level inside positive), closed, and longest: the line of most points of
    its image, ties to the smallest chain."""
    w = W.partitionBy(*by, "chain").orderBy("pos")
    z = lines.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    m = z.groupBy(*by, "chain", "closed").agg(F.count("*").alias("points"), F.coalesce(F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))), F.lit(0.0)).alias("length"), (F.sum(F.col("nx") * F.col("y") - F.col("x") * F.col("ny")) / 2).alias("area"))
    m = m.withColumn("area", F.when(F.col("closed"), F.col("area")))
    top = m.groupBy(*by).agg(F.max_by("chain", F.struct("points", -F.col("chain"))).alias("__top"))
    return m.join(top, by).withColumn("longest", F.col("chain") == F.col("__top")).drop("__top")
