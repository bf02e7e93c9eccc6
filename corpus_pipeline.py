"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and makes its decisions
take effect; all but the last return the columns of docs. Every stage takes an empty table to an empty one, repeated rows and
ids, nulls in any column and columns with any other name; what it does with them its function says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import language_id, line_dedup, mixing, near_groups, piece_lattice
from lamella.llm.common import materialise, small_batches


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined, or told with less than even odds, go.

    Null texts and texts without a letter are undetermined and go; a null lang is filled in; repeated rows share their fate; languages of
    equal odds tie below even odds and go. Without a labelled document nothing can be told and all go.
    """
    return language_id.keep_known(docs)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go from the texts; a document of which all lines went goes.

    The first copy is the one of the smallest doc_id (null last), then text hash, then line; rows alike in id and text count once and share
    their fate. Null and blank texts have no line and stay as they are.
    """
    return line_dedup.stage_docs(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, at five-word shingles and a similarity of 0.8.

    It is the one of the smallest doc_id (null last), then text hash, once if its row is repeated. Texts without words are one group.
    """
    return near_groups.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that the mix takes over a document.

    Null texts have no words and no row; the null source is a source of its own, the last; rows alike in id and text count once; documents of
    equal keys are taken by doc_id, then size.
    """
    return mixing.mixed_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the number of bytes that they decode to; a null text has no tokens; equal scores go to the first in piece order."""
    small_batches(spark, 200)
    return piece_lattice.encode(docs)


STAGES = [
    ("language ID", known_language),
    ("line dedup", line_runs),
    ("SimHash near-dedup", near_duplicates),
    ("mixing to target weights", source_mix),
    ("SentencePiece encoding", pieces),
]
#: PPM models, SimHash groups and the piece lattice cannot be put in SQL; tests hold each stage's operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
