"""A training corpus from documents, stage by stage.

Each stage takes the session, the documents that the stage before it kept and the folder
of the tables, and returns the documents that it keeps, with their columns; the last one
returns their places in sequences. No stage looks at a part of its input only.

Rows: documents without an id or with a repeated one go through all stages as rows like
others; those without text or with few words go at the first. Very long texts are rows
like others. Empty documents give no sequences. Columns of any name are carried on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import discard, stored, tables_made
from millrace.llm.prefix_tree_join import one_of_each
from millrace.llm.quality_ratio import quality_rules
from millrace.llm.queries import FLATTEN
from millrace.llm.sequence_packing import packed
from millrace.llm.source_mixing import mixed, pieces_for, shuffled, source_sizes, tempered_weights
from millrace.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold the rules and read like those labelled good."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return quality_rules(docs, trusted).filter("kept").select("doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by 75 of 100 five-word shingles."""
    return one_of_each(docs, k=5, percent=75)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that stand before them."""
    return without_repeats(docs, span=50, head=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, so many that sources have flattened shares, shuffled."""
    sizes = stored(source_sizes(docs))
    return shuffled(mixed(docs, tempered_weights(sizes, FLATTEN)), pieces_for(sizes)).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens."""
    return packed(docs)


STAGES = [
    ("quality rules", quality),
    ("near copies", near_copies),
    ("repeated passages", repeats),
    ("source mixing", mixing),
    ("packing", packing),
]

#: SQL cannot express every stage; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written and read by the next one.

    When a stage is written, its input and the tables that it made on the way are removed.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = tables_made()
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        discard(spark, since, docs)
    return docs
