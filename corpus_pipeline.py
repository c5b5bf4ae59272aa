"""A corpus from raw documents to packed sequences.

Each stage takes what its predecessor kept and returns the columns of documents; the
last returns the pieces of the packed sequences. In every stage null texts count as
empty, null ids are ids like any other and come last, rows that repeat are rows of
their own until exact dedup leaves one, texts are read whole however long, columns of
any name stay, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import exact_dedup, mixing, near_dedup, packing, quality
from strandlake.plans.session import Workspace, table

#: Scores below this are rejected.
CUT = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score ``CUT`` or more by a classifier that is fitted on them and the labels."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, cut=CUT).where(F.col("predicted") == 1).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the smallest id."""
    return exact_dedup.keep_owners(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest id."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("packing", pack),
]

#: Classifier, near dedup and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's result is a table that goes once the next one's is written."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.written(docs, f"stage-{i}")
            work.drop(last)
    return docs
