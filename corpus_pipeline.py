"""A filtering and packing pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the docs of the next stage.  All stages but the last return the columns of documents, whatever their
names.  Nulls may stand in any column: a row with a null doc_id or text is kept by every stage, up to the packing, which places
what has words.  Rows that repeat stay until the second stage keeps one of them, but for those with nulls.  Texts of any length are used whole, and an empty
table gives an empty result.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from steppe.llm.common import removed, shared_folder
from steppe.llm.decontaminate import drop_contaminated
from steppe.llm.ngram_join import keep_one_of_each_group
from steppe.llm.packing import pack_documents
from steppe.llm.substring import drop_repeats
from steppe.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't hold to be toxic (operator 8).

    It learns from the labels of the documents given; without any nothing goes.  Null and empty texts stay.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the least doc_id, and all others (operator 1).

    Documents without words, and rows with a null id or text, are in no group.
    """
    return keep_one_of_each_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of a lesser doc_id has too (operator 5).

    A document of which nothing is left goes; n_chars is set anew.  Rows with a null id or text stay as they are.
    """
    return drop_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark (operator 9); without items all stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of what is left in training sequences (operator 3): a row for each piece of a document.

    Rows with a null doc_id are packed under it; null texts and those without words take no place.
    """
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: SQL can't express the trained classifier of the first stage nor the search of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each reading what the one before it wrote in the shared folder.

    What a stage read is deleted when the next table is written; the last one stays, as the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        path = posixpath.join(home, f"stage{k}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
