"""A training corpus from raw documents: five stages, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs, so rows keep their order in the files and a stage may read them more than once.
All but the last return the columns of documents.

Defined results: a document without text or letters goes in the first stage, so later stages see none; rows with
a null id stay and are told apart as rows; of repeated rows one stays; where texts tie, the largest id stays
(exact copies), then the row with the smallest id of its class (near copies); very long texts are worked on
whole; an empty table gives an empty result; more columns, whatever their names, are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import release, stage, table
from vitrine.llm.exact_dedup import drop_copies
from vitrine.llm.langid import keep_identified, training_text
from vitrine.llm.ngram_join import keep_one
from vitrine.llm.packing import pack_documents
from vitrine.llm.pii import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the parse of some language recognises, a null lang filled in; others go, and those without letters."""
    return keep_identified(docs, training_text(docs, F.lit(True)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join."""
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024."""
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_join", near_dedup), ("pii", pii), ("packing", packing)]

#: SQL can't express language identification, the join or the packing; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  A stage's documents go once the next stage's are written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES[:-1]):
        before, docs = docs, stage(step(spark, docs, sf_dir), name)
        if k:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
