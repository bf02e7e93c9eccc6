"""Merkle manifests: a tree over every group's leaves, a tree over the groups, and a proof for every leaf.

A node is the SHA-256 of its (up to) three children's digests, written as lowercase hex; a last run of one child
is hashed, too; a lone leaf is its tree's root. The rows are sorted by group and key in ranges, so that a
partition holds stretches of few groups and a large group spreads over many partitions. Stretches of at most
``CHUNK`` leaves are packed into one row each. Counts by (group, partition), summed over the partitions before,
give every stretch its place in its group, without sorting anything again. Then

* every stretch builds the complete aligned subtrees over its own leaves;
* the nodes whose parents reach into another stretch (at most two a level and side) are shuffled by the
  coordinate of their ancestor ``SPAN`` levels up, at most ``3 ** SPAN`` a group, until the roots are there;
* proofs come back the same way: the siblings of the upper levels join the stretches, which add their own.

A proof is the digests of a leaf's siblings, level by level, left to right, first in its group's tree and then
in the tree of groups; with a leaf's place and the sizes of both trees, ``fold`` gives the root from it.

Defined results: leaves of a group ascend by key, null first, equal keys by digest; equal rows are leaves each;
the null group is a group and comes first; null fields are written ``-`` and differ from empty ones; an empty
table has no root and gives an empty result; other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, materialise, remove, session

FAN = 3
CHUNK = FAN**8
SPAN = 6
#: The fields of a document's leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(*fields: Column) -> Column:
    """The binary digest of fields: each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    parts = []
    for c in fields:
        c = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def joined(digests: list[bytes]) -> bytes:
    """The hex digest over hex digests."""
    return sha256(b"".join(digests)).hexdigest().encode()


def height(total: int) -> int:
    """Levels above the leaves."""
    n = 0
    while total > 1:
        total, n = -(-total // FAN), n + 1
    return n


def fold(digest: bytes, at: int, total: int, proof: bytes, used: int = 0) -> tuple[bytes, int]:
    """The root over a leaf's hex digest, from its place, the tree's size and its siblings; also how much of the proof is used."""
    while total > 1:
        own, n = at % FAN, min(FAN, total - at // FAN * FAN)
        cut = used + 64 * own
        end = used + 64 * (n - 1)
        digest = sha256(proof[used:cut] + digest + proof[cut:end]).hexdigest().encode()
        at, total, used = at // FAN, -(-total // FAN), end
    return digest, used


# --- stretches of leaves ---------------------------------------------------------------------------------------------------


def stretches(rows: DataFrame, chunk: int) -> DataFrame:
    """(grp, ord, leaf, other) rows, sorted in ranges, to grp, part, chunk, first, n, ids, leaves, others: one row a stretch.

    first counts the group's leaves before the stretch in its partition; leaves and others are packed digests.
    """
    ord_type = pa.schema([("ord", _arrow(rows.schema["ord"].dataType))]).field("ord").type
    grp_type = _arrow(rows.schema["grp"].dataType)

    def pack(batches: Iterator[pa.RecordBatch]):
        part, number, first, held = TaskContext.get().partitionId(), 0, 0, 0
        group, ids, leaves, others = None, [], [], []

        def row():
            packed = pa.concat_arrays(ids)
            out = [pa.array([group], grp_type), pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([first], pa.int64()), pa.array([held], pa.int64())]
            out += [pa.ListArray.from_arrays(pa.array([0, len(packed)], pa.int32()), packed), pa.array([b"".join(leaves)], pa.large_binary()).cast(pa.binary()), pa.array([b"".join(others)], pa.large_binary()).cast(pa.binary())]
            return pa.RecordBatch.from_arrays(out, ["grp", "part", "chunk", "first", "n", "ids", "leaves", "others"])

        for b in batches:
            if not b.num_rows:
                continue
            other = pc.coalesce(b.column(3), b.column(2)).to_pylist()
            leaf = b.column(2).to_pylist()
            runs = pc.run_end_encode(b.column(0))
            at = 0
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if held and value != group:
                    yield row()
                    number, first, held, ids, leaves, others = number + 1, 0, 0, [], [], []
                elif value != group:
                    first = 0
                group = value
                while at < end:
                    if held == chunk:
                        yield row()
                        number, first, held, ids, leaves, others = number + 1, first + held, 0, [], [], []
                    n = min(end - at, chunk - held)
                    ids.append(b.column(1).slice(at, n).cast(ord_type))
                    leaves += leaf[at : at + n]
                    others += other[at : at + n]
                    at, held = at + n, held + n
        if held:
            yield row()

    schema = T.StructType([T.StructField("grp", rows.schema["grp"].dataType), *[T.StructField(c, T.LongType()) for c in ("part", "chunk", "first", "n")], T.StructField("ids", T.ArrayType(rows.schema["ord"].dataType)), T.StructField("leaves", T.BinaryType()), T.StructField("others", T.BinaryType())])
    # equal rows may fall on both sides of a range's edge: they are alike
    keyed = rows.select("grp", "ord", "leaf", "other", F.monotonically_increasing_id().alias("row"))
    keys = ["grp", "ord", "leaf", "row"]
    return materialise(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(pack, schema), "stretches")


def _arrow(kind: T.DataType) -> pa.DataType:
    return {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.IntegerType(): pa.int32()}[kind]


def places(packed: DataFrame) -> DataFrame:
    """(part, chunk, grp, start, n, total) of every stretch, from the counts of (group, partition)."""
    by_part = packed.groupBy("grp", "part").agg(F.sum("n").alias("own"))
    before = F.coalesce(F.sum("own").over(W.partitionBy("grp").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = by_part.select(F.col("grp").alias("g"), F.col("part").alias("p"), before.alias("before"), F.sum("own").over(W.partitionBy("grp")).alias("total"))
    found = packed.join(offsets, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    return materialise(found.select("part", "chunk", "grp", (F.col("before") + F.col("first")).alias("start"), "n", "total"), "places")


def subtrees(digests: list[bytes], start: int, total: int) -> list[tuple[int, list[bytes]]]:
    """Level by level, the first coordinate and the digests of the nodes that a stretch of leaves can build alone."""
    levels = [(start, digests)]
    while True:
        low, nodes = levels[-1]
        high = low + len(nodes)
        first, last = -(-low // FAN), -(-high // FAN) if high == total else high // FAN
        if total == 1 or first >= last:
            return levels
        levels.append((first, [joined(nodes[c * FAN - low : c * FAN - low + FAN]) for c in range(first, last)]))
        total = -(-total // FAN)


def edges(levels: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(level, coordinate, digest) of the nodes whose parents the stretch can't build."""
    for level, (low, nodes) in enumerate(levels):
        high = low + len(nodes)
        if level + 1 < len(levels):
            first, n = levels[level + 1][0], len(levels[level + 1][1])
            outside = [*range(low, min(first * FAN, high)), *range(min((first + n) * FAN, high), high)]
        else:
            outside = range(low, high)
        for c in outside:
            yield level, c, nodes[c - low]


def _hexed(packed: bytes) -> list[bytes]:
    text = packed.hex().encode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


# --- upper levels ----------------------------------------------------------------------------------------------------------


def _climb(nodes: dict[tuple[int, int], bytes], total: int, low: int, span: int) -> tuple[dict[tuple[int, int], bytes], tuple[int, int]]:
    """Fills in the parents of nodes up to ``low + span`` levels or the root; returns siblings of every node, cut there, and the top."""
    top = min(low + span, height(total))
    sizes = [total]
    for _ in range(top):
        sizes.append(-(-sizes[-1] // FAN))
    by_level: list[set[int]] = [set() for _ in range(top + 1)]
    for level, c in nodes:
        by_level[level].add(c)
    for level in range(low, top):
        for c in {c // FAN for c in by_level[level]}:
            nodes[level + 1, c] = joined([nodes[level, k] for k in range(c * FAN, min(c * FAN + FAN, sizes[level]))])
            by_level[level + 1].add(c)
    (peak,) = by_level[top]
    paths = {(top, peak): b""}
    for level in range(top - 1, low - 1, -1):
        for c in by_level[level]:
            base = c // FAN * FAN
            own = b"".join(nodes[level, k] for k in range(base, min(base + FAN, sizes[level])) if k != c)
            paths[level, c] = own + paths[level + 1, c // FAN]
    return paths, (top, peak)


def forest(rows: DataFrame, chunk: int = CHUNK, span: int = SPAN) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(grp, ord, leaf, other) rows to: stretches; for each of them (part, chunk), its place and the proofs of its edge nodes;
    (grp, total, root) of each group; and the stored tables, for ``remove``."""
    packed = stretches(rows, chunk)
    placed = places(packed)
    grp = T.StructField("grp", rows.schema["grp"].dataType)
    long = [T.StructField(c, T.LongType()) for c in ("total", "level", "coord")]

    def build(batches):
        for b in batches:
            out = []
            for g, part, number, start, total, leaves in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                out += [(g, total, level, c, d, part, number) for level, c, d in edges(subtrees(_hexed(leaves), start, total))]
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [_arrow(grp.dataType), *[pa.int64()] * 3, pa.binary(), *[pa.int64()] * 2], strict=True)], ["grp", "total", "level", "coord", "digest", "part", "chunk"])

    schema = T.StructType([grp, *long, T.StructField("digest", T.BinaryType()), T.StructField("part", T.LongType()), T.StructField("chunk", T.LongType())])
    with session(rows.sparkSession, 64):
        local = packed.select("part", "chunk", "leaves").join(placed, ["part", "chunk"]).select("grp", "part", "chunk", "start", "total", "leaves")
        nodes = materialise(local.mapInArrow(build, schema), "nodes")
    kept = [packed, placed, nodes]
    largest = nodes.agg(F.max("total")).first()[0]
    levels = height(largest or 0)
    rounds, carried = [], None
    now = nodes.select("grp", "total", "level", "coord", "digest")
    step = T.StructType([grp, *long, T.StructField("digest", T.BinaryType()), T.StructField("path", T.BinaryType()), T.StructField("up", T.LongType())])

    def block(low: int):
        def run(table: pa.Table) -> pa.Table:
            g, total = table["grp"][0], table["total"][0].as_py()
            given = dict(zip(zip(table["level"].to_pylist(), table["coord"].to_pylist(), strict=True), table["digest"].to_pylist(), strict=True))
            own = list(given)
            paths, (top, peak) = _climb(given, total, low, span)
            out = [(level, c, None, paths[level, c], peak if top < height(total) else None) for level, c in own] + [(top, peak, given[top, peak], None, None)]
            level, coord, digest, path, up = zip(*out, strict=True)
            return pa.Table.from_arrays([pa.array([g.as_py()] * len(out), g.type), pa.array([total] * len(out), pa.int64()), pa.array(level, pa.int64()), pa.array(coord, pa.int64()), pa.array(digest, pa.binary()), pa.array(path, pa.binary()), pa.array(up, pa.int64())], step.names)

        return run

    done = []
    tall = F.expr("aggregate(sequence(1, 64), struct(total as t, 0L as h), (a, i) -> if(a.t > 1, struct((a.t + 2) div 3 as t, a.h + 1 as h), a)).h")
    now = now.withColumn("tall", tall)
    done.append(now.filter("level = tall").select("grp", "total", "level", "coord", "digest"))
    now = now.filter("level < tall").drop("tall")
    for low in range(0, levels, span):
        own = now.filter((F.col("level") >= low) & (F.col("level") < low + span))
        if carried is not None:
            own = own.unionByName(carried)
        ancestor = F.expr(f"coord div cast(power({FAN}, {low + span} - level) as bigint)")
        found = materialise(own.withColumn("anc", ancestor).groupBy("grp", "anc").applyInArrow(block(low), step), "levels")
        kept.append(found)
        rounds.append(found)
        up = found.filter("path IS NULL").withColumn("tall", tall)
        done.append(up.filter("level = tall").select("grp", "total", "level", "coord", "digest"))
        carried = up.filter("level < tall").select("grp", "total", "level", "coord", "digest")
    roots = done[0]
    for d in done[1:]:
        roots = roots.unionByName(d)
    roots = materialise(roots.select("grp", "total", F.col("digest").alias("root")), "roots")
    kept.append(roots)
    # proofs from the top down; the nodes of a round end at a root or at a node of the next round
    full = None
    for i in reversed(range(len(rounds))):
        own = rounds[i].filter("path IS NOT NULL").select("grp", "level", "coord", "path", "up")
        ended = own.filter("up IS NULL").select("grp", "level", "coord", "path")
        if full is not None:
            top = full.select(F.col("grp").alias("g"), F.col("level").alias("l"), F.col("coord").alias("c"), F.col("path").alias("rest"))
            climbing = own.filter("up IS NOT NULL").join(top, F.col("grp").eqNullSafe(F.col("g")) & (F.lit((i + 1) * span) == F.col("l")) & (F.col("up") == F.col("c")))
            ended = ended.unionByName(climbing.select("grp", "level", "coord", F.concat("path", "rest").alias("path")))
        full = ended if full is None else ended.unionByName(full)
    edge = nodes.select("grp", "level", "coord", "part", "chunk")
    if full is None:
        proofs = edge.withColumn("path", F.lit(b""))
    else:
        full = full.select(F.col("grp").alias("g"), F.col("level").alias("l"), F.col("coord").alias("c"), "path")
        proofs = edge.join(full, F.col("grp").eqNullSafe(F.col("g")) & (F.col("level") == F.col("l")) & (F.col("coord") == F.col("c")), "left")
    info = proofs.groupBy("part", "chunk").agg(F.collect_list(F.struct("level", "coord", F.coalesce("path", F.lit(b"")).alias("path"))).alias("nodes"))
    info = placed.join(info, ["part", "chunk"])
    return packed, info, roots, kept


def leaf_proofs(levels: list[tuple[int, list[bytes]]], total: int, above: dict[tuple[int, int], bytes]) -> list[bytes]:
    """The proof of each leaf of a stretch, from its subtrees and the proofs of its edge nodes."""
    sizes = [total]
    for _ in levels:
        sizes.append(-(-sizes[-1] // FAN))
    parents, paths = (0, []), []
    for level in range(len(levels) - 1, -1, -1):
        low, nodes = levels[level]
        paths = []
        for c in range(low, low + len(nodes)):
            up = c // FAN - parents[0]
            if 0 <= up < len(parents[1]):
                base = c // FAN * FAN
                paths.append(b"".join(nodes[k - low] for k in range(base, min(base + FAN, sizes[level])) if k != c) + parents[1][up])
            else:
                paths.append(above[level, c])
        parents = (low, paths)
    return paths


# --- manifests of documents --------------------------------------------------------------------------------------------------

_PROVED = "source string, doc_id long, leaf string, subroot string, root string, proof binary, proof_sha256 string, folded_root string, verified boolean, at long, source_total long, source_at long, sources long"


def manifest(rows: DataFrame, chunk: int = CHUNK, span: int = SPAN, proofs: bool = True) -> DataFrame:
    """(source, doc_id, leaf, other) rows to one row each: its leaf, the roots, its proof and whether ``other`` (null: the leaf),
    folded along that proof, gives the root. ``proofs`` False leaves the column ``proof`` null, and its digest in place."""
    spark = rows.sparkSession
    kept_rows = materialise(rows.select(F.col("source").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("ord"), "leaf", "other"), "leaves")
    packed, info, roots, kept = forest(kept_rows, chunk, span)
    remove(kept_rows)
    top_rows = roots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("ord"), F.unhex(F.col("root").cast("string")).alias("leaf"), F.lit(None).cast("binary").alias("other"))
    top_packed, top_info, top_roots, top_kept = forest(top_rows, chunk, span)

    def groups(batches):
        for b in batches:
            for ids, leaves, start, total, nodes in zip(*(b.column(i) for i in range(5)), strict=True):
                own = subtrees(_hexed(leaves.as_py()), start.as_py(), total.as_py())
                paths = leaf_proofs(own, total.as_py(), {(x["level"], x["coord"]): x["path"] for x in nodes.as_py()})
                n = len(paths)
                yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), pa.string()), pa.array(range(start.as_py(), start.as_py() + n), pa.int64()), pa.array([total.as_py()] * n, pa.int64()), pa.array(paths, pa.binary())], ["source", "source_at", "sources", "upper"])

    with session(spark, 64):
        above = top_packed.join(top_info, ["part", "chunk"]).select("ids", "leaves", "start", "total", "nodes").mapInArrow(groups, "source string, source_at long, sources long, upper binary")
        above = materialise(above.crossJoin(top_roots.select(F.col("root").alias("top"))), "upper")  # one root row
    # a stretch meets its group's row; a group of many stretches is dealt over its copies
    deal, copies = F.pmod("part", F.lit(32)), F.explode(F.sequence(F.lit(0), F.lit(31)))
    named = roots.select(F.col("grp").alias("r"), F.col("root").alias("subroot")).join(above, F.col("r").eqNullSafe(F.col("source"))).withColumn("copy", copies)
    info = info.withColumn("deal", deal).join(named, (F.col("deal") == F.col("copy")) & F.col("grp").eqNullSafe(F.col("r")))
    info = materialise(info.select("part", "chunk", "start", "total", "nodes", "subroot", "source_at", "sources", "upper", "top"), "proofs")

    def prove(batches):
        for b in batches:
            for g, ids, leaves, others, start, total, nodes, subroot, source_at, sources, upper, top in zip(*(b.column(i) for i in range(12)), strict=True):
                start, total, source_at, sources, upper, top = (x.as_py() for x in (start, total, source_at, sources, upper, top))
                own, changed = _hexed(leaves.as_py()), _hexed(others.as_py())
                paths = leaf_proofs(subtrees(own, start, total), total, {(x["level"], x["coord"]): x["path"] for x in nodes.as_py()})
                folded = []
                for i, (leaf, path) in enumerate(zip(changed, paths, strict=True)):
                    sub, _ = fold(leaf, start + i, total, path)
                    folded.append(fold(sub, source_at, sources, upper)[0])
                n = len(own)
                cols = [pa.array([g.as_py()] * n, pa.string()), ids.values, pa.array([x.decode() for x in own]), pa.array([subroot.as_py().decode()] * n), pa.array([top.decode()] * n)]
                cols += [pa.array([p + upper for p in paths] if proofs else [None] * n, pa.binary()), pa.array([sha256(p + upper).hexdigest() for p in paths]), pa.array([x.decode() for x in folded]), pa.array([x == top for x in folded])]
                cols += [pa.array(range(start, start + n), pa.int64()), *[pa.array([x] * n, pa.int64()) for x in (total, source_at, sources)]]
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in _PROVED.split(", ")])

    with session(spark, 64):
        both = packed.select("grp", "part", "chunk", "ids", "leaves", "others").join(info, ["part", "chunk"])
        out = materialise(both.select("grp", "ids", "leaves", "others", "start", "total", "nodes", "subroot", "source_at", "sources", "upper", "top").mapInArrow(prove, _PROVED), "manifest")
    for df in [*kept, *top_kept, above, info]:
        remove(df)
    return out


def tampered_leaves(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, other) of documents: other is the leaf without the text's newlines where 2 divides the id's crc32, if that differs."""
    fields = [F.col(c) for c in FIELDS]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    other = F.when(even & F.col("text").contains("\n"), leaf_of(*fields[:-1], F.translate("text", "\n", "")))
    return docs.select("source", "doc_id", leaf_of(*fields).alias("leaf"), other.alias("other"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(tampered_leaves(documents(spark, sf_dir)), proofs=False)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", F.col("at").alias("leaf_at"), "source_total")


# crc32 by its bits; runs by levels; the root along a proof by one step a level
ORACLE_SQL = """
WITH RECURSIVE doc AS (
  SELECT doc_id, source, text, row_number() OVER () AS n,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents
), tam AS (
  SELECT *, CASE WHEN ((list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))) & 1) = 1)
    THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM doc
), leaf AS (
  SELECT n, doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(changed)) || ':' || changed, '-')) AS other
  FROM tam
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total FROM leaf
), lev AS (
  SELECT source, 0 AS l, pos AS c, leaf AS d, total FROM placed
  UNION ALL
  SELECT source, l + 1, c // 3, sha256(string_agg(d, '' ORDER BY c)), any_value((total + 2) // 3) FROM lev WHERE total > 1 GROUP BY source, l, c // 3
), sub AS (
  SELECT source, d AS subroot, l AS h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS sat, count(*) OVER () AS sources FROM lev WHERE total = 1
), top AS (
  SELECT 0 AS l, sat AS c, subroot AS d, sources AS total FROM sub
  UNION ALL
  SELECT l + 1, c // 3, sha256(string_agg(d, '' ORDER BY c)), any_value((total + 2) // 3) FROM top WHERE total > 1 GROUP BY l, c // 3
), step AS (
  SELECT p.n, s.l, s.c, s.d, s.c = p.pos // (3 ** s.l)::BIGINT AS own
  FROM placed p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source
  JOIN lev s ON s.source IS NOT DISTINCT FROM p.source AND s.total > 1 AND s.c // 3 = p.pos // (3 ** (s.l + 1))::BIGINT
  UNION ALL
  SELECT p.n, sub.h + t.l, t.c, t.d, t.c = sub.sat // (3 ** t.l)::BIGINT
  FROM placed p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source
  JOIN top t ON t.total > 1 AND t.c // 3 = sub.sat // (3 ** (t.l + 1))::BIGINT
), proof AS (
  SELECT n, sha256(coalesce(string_agg(d, '' ORDER BY l, c) FILTER (WHERE NOT own), '')) AS proof_sha256 FROM step GROUP BY n
), fold AS (
  SELECT n, 0 AS l, other AS d FROM placed
  UNION ALL
  SELECT f.n, f.l + 1, sha256(string_agg(CASE WHEN s.own THEN f.d ELSE s.d END, '' ORDER BY s.c)) FROM fold f JOIN step s ON s.n = f.n AND s.l = f.l GROUP BY f.n, f.l
), folded AS (SELECT n, arg_max(d, l) AS folded_root FROM fold GROUP BY n)
SELECT p.doc_id, p.leaf, sub.subroot, r.d AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = r.d AS verified,
  p.pos AS leaf_at, p.total AS source_total
FROM placed p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source JOIN top r ON r.total = 1
LEFT JOIN proof USING (n) JOIN folded USING (n)
"""
