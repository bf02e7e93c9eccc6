"""Line dedup by prefix doubling over sequences of line identifiers.

Every non-blank line is one symbol: the 128-bit hash of its bytes (two 64-bit hashes of different seeds).
Suffixes of the documents' line sequences are sorted by doubling. At depth d every suffix has the rank of its
first d lines; at depth 2d, the rank of the pair of its own rank and that of the suffix d lines on. Ranks are
given by a distributed sort of the distinct pairs, so that they are in suffix order, and suffixes of one rank are
an interval of the suffix array with a common prefix of at least d lines. Suffixes alone in their interval leave
(their longest common prefix is settled), and doubling goes on until none is left. Matches never cross documents.

In an interval the first suffix (smallest doc_id, null last, then position) is the original; the others
repeat it. A line is deleted if it lies in a run of at least ``min_lines`` lines of which an earlier copy
exists, or is a repeated line of at least ``min_words`` words. The query and the pipeline's stage delete later
copies of runs of any length, a single line included. Runs are maximal deleted stretches; ``depth`` is
the largest power of two of lines at which some suffix of the document repeats an earlier one, so that long
repeated passages can be told from stray lines. Blank lines are never symbols and stay.

Defined results: null text has no lines and stays null; rows equal in id and text are one document and
share its result; a null id sorts last; empty tables give empty results; other columns pass by.
"""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RE, documents, materialise, remove, small_batches

MIN_LINES = 2
MIN_WORDS = 20
_INK = rf"{WORD_RE[:-1]}"


def _key():
    return F.xxhash64(F.lit(3), F.col("doc_id"), F.col("text"))


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text) rows to one row a non-blank line: key, no_id, doc_id, pos, line (its hash), long_line."""
    lines = docs.select(_key().alias("key"), "doc_id", F.posexplode(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(_INK))).alias("pos", "line"))
    long_line = F.regexp_count("line", F.lit(WORD_RE)) >= min_words if min_words > 1 else F.lit(True)
    return lines.select("key", F.isnull("doc_id").cast("int").alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), long_line.alias("long_line")).dropDuplicates(["key", "pos"])


def _order():
    return F.struct("no_id", "doc_id", "key", "pos")


def ranked(suffixes: DataFrame, *by: str) -> DataFrame:
    """Suffixes that share the columns ``by`` with others, with ``rank`` (ascending as by does) and ``copy`` (not the first).

    One row for each distinct value is sorted; its place across partitions is the rank. A value that fills the
    corpus is counted before the shuffle, and Spark splits its join.
    """
    classes = suffixes.groupBy(*by).agg(F.count("*").alias("n"), F.min(_order()).alias("first")).filter("n > 1").drop("n")
    classes = materialise(classes.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), "ranks")
    out = materialise(suffixes.drop("rank").join(classes, list(by)).withColumn("copy", _order() != F.col("first")).drop("first", *by), "suffixes")
    remove(classes)
    return out


def further(suffixes: DataFrame, at: DataFrame, lines: int) -> DataFrame:
    """Suffixes with ``next``, the rank at ``at`` of the suffix so many lines on; those without one leave."""
    return suffixes.join(at.select("key", (F.col("pos") - lines).alias("pos"), F.col("rank").alias("next")), ["key", "pos"])


def repeated(lines: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """key, pos, depth, cover: suffixes that repeat an earlier one at a power-of-two depth, and the lines deleted there."""
    first = materialise(lines, "lines")
    now, depth, used = ranked(first, "h1", "h2"), 1, [first]
    found = now.filter("copy").select("key", "pos", F.lit(1).alias("depth"), F.when(F.col("long_line") | F.lit(min_lines == 1), 1).otherwise(0).alias("cover"))
    while not now.isEmpty():
        if depth < min_lines <= 2 * depth:  # runs of exactly min_lines: two overlapping halves
            runs = ranked(further(now, now, min_lines - depth).withColumnRenamed("rank", "own"), "own", "next")
            used.append(runs)
            found = found.unionByName(runs.filter("copy").select("key", "pos", F.lit(0).alias("depth"), F.lit(min_lines).alias("cover")))
        used.append(now)
        now = ranked(further(now, now, depth).withColumnRenamed("rank", "own"), "own", "next")
        depth *= 2
        found = found.unionByName(now.filter("copy").select("key", "pos", F.lit(depth).alias("depth"), F.lit(0).alias("cover")))
    hits = materialise(found.groupBy("key", "pos").agg(F.max("depth").alias("depth"), F.max("cover").alias("cover")), "hits")
    for x in used:
        remove(x)
    return hits


def _rebuild(text: str | None, hits: list[dict] | None) -> tuple[str | None, int, int, int, int]:
    """Text without its deleted lines; lines, deleted lines, runs, deepest interval."""
    if text is None:
        return None, 0, 0, 0, 0
    gone: set[int] = set()
    deepest = 0
    for h in hits or ():
        gone.update(range(h["pos"], h["pos"] + h["cover"]))
        deepest = max(deepest, h["depth"])
    kept, n, runs, before = [], 0, 0, False
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            if n in gone:
                runs += not before
                before = True
            else:
                kept.append(line)
                before = False
            n += 1
        else:
            kept.append(line)
    return "\n".join(kept), n, len(gone), runs, deepest


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_lines: int = MIN_LINES) -> DataFrame:
    """Two struct columns: ``row``, all columns of docs, and ``dedup``: text, n_lines, n_removed, n_runs, depth."""
    small_batches(docs.sparkSession)
    hits = repeated(line_table(docs, min_words), min_lines).groupBy("key").agg(F.collect_list(F.struct("pos", "depth", "cover")).alias("hits"))
    whole = docs.select(F.struct("*").alias("row"), F.col("text").alias("__text"), _key().alias("key"))
    joined = whole.join(hits, "key", "left").select("row", "__text", "hits")
    schema = "text:string,n_lines:bigint,n_removed:bigint,n_runs:bigint,depth:bigint"

    def run(batches):
        for b in batches:
            out = [_rebuild(t, h) for t, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = [pa.array([x[i] for x in out], pa.string() if i == 0 else pa.int64()) for i in range(5)]
            made = pa.StructArray.from_arrays(cols, ["text", "n_lines", "n_removed", "n_runs", "depth"])
            yield pa.RecordBatch.from_arrays([b.column(0), made], ["row", "dedup"])

    row = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(run, f"row {row}, dedup struct<{schema}>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_words=1, min_lines=1)
    return d.select("row.doc_id", "dedup.n_lines", "dedup.n_removed", "dedup.n_runs", "dedup.depth", F.md5(F.coalesce("dedup.text", F.lit(""))).alias("kept_md5"))


def stage_docs(docs: DataFrame) -> DataFrame:
    """Documents with deleted lines gone; a document of which all lines went leaves, one that had none stays."""
    d = dedup_lines(docs, min_words=1, min_lines=1)
    kept = d.filter((F.col("dedup.n_lines") == 0) | (F.col("dedup.n_lines") > F.col("dedup.n_removed")))
    changed = {"text": F.col("dedup.text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("dedup.n_removed") > 0, F.char_length("dedup.text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


_SQL_LINES = r"""
d AS (SELECT DISTINCT doc_id, text FROM documents),
raw AS (SELECT doc_id, md5(coalesce(text, '')) AS own, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM d),
ink AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS inked FROM raw),
lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id, own, inked ORDER BY ord) AS pos FROM ink),
n1 AS (SELECT doc_id, own, ord, pos, dense_rank() OVER (ORDER BY line) AS n FROM lines WHERE inked),
hit AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY doc_id NULLS LAST, own, pos) > 1 AS gone FROM n1),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id, own ORDER BY pos), false) AS starts FROM hit)
"""
#: Names of prefixes of 2, 4, ... lines, each from those of half the length, and where one is a repeat.
_SQL_DEPTHS = ",\n".join(
    f"f{2 * k} AS (SELECT *, lead(n, {k}) OVER (PARTITION BY doc_id, own ORDER BY pos) AS nxt FROM n{k}), n{2 * k} AS (SELECT doc_id, own, ord, pos, CASE WHEN n IS NOT NULL AND nxt IS NOT NULL THEN dense_rank() OVER (ORDER BY n, nxt) END AS n FROM f{2 * k})"
    for k in (1 << i for i in range(13))
)
_SQL_DEEPEST = " UNION ALL ".join(
    f"SELECT doc_id, own, {k} AS depth FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY doc_id NULLS LAST, own, pos) AS r FROM n{k} WHERE n IS NOT NULL) WHERE r > 1" for k in (1 << i for i in range(14))
)
ORACLE_SQL = (
    "WITH"
    + _SQL_LINES
    + ",\n"
    + _SQL_DEPTHS
    + f""",
deep AS (SELECT doc_id, own, max(depth) AS depth FROM ({_SQL_DEEPEST}) GROUP BY 1, 2)"""
    + r""",
kept AS (SELECT i.doc_id, i.own, string_agg(i.line, chr(10) ORDER BY i.ord) AS text
         FROM ink i LEFT JOIN runs r ON r.doc_id IS NOT DISTINCT FROM i.doc_id AND r.own = i.own AND r.ord = i.ord
         WHERE NOT coalesce(r.gone, false) GROUP BY 1, 2),
per AS (SELECT doc_id, own, count(*) AS n_lines, sum(gone::INT) AS n_removed, sum(starts::INT) AS n_runs FROM runs GROUP BY 1, 2)
SELECT o.doc_id, coalesce(p.n_lines, 0)::BIGINT AS n_lines, coalesce(p.n_removed, 0)::BIGINT AS n_removed,
       coalesce(p.n_runs, 0)::BIGINT AS n_runs, coalesce(deep.depth, 0)::BIGINT AS depth, md5(coalesce(k.text, '')) AS kept_md5
FROM documents o
LEFT JOIN per p ON p.doc_id IS NOT DISTINCT FROM o.doc_id AND p.own = md5(coalesce(o.text, ''))
LEFT JOIN deep ON deep.doc_id IS NOT DISTINCT FROM o.doc_id AND deep.own = md5(coalesce(o.text, ''))
LEFT JOIN kept k ON k.doc_id IS NOT DISTINCT FROM o.doc_id AND k.own = md5(coalesce(o.text, ''))
"""
)
