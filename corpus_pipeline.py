"""The training-data pipeline over `documents`: filter, deduplicate, decontaminate, redact, pack.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and
read again. All but the last return the columns of documents (extra columns go along, whatever their names). A table
without rows gives none at every stage. Whole texts are read, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common, decontaminate, minhash, packing, quality_rules, secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject.

    Null and empty texts, and those of under 20 words, fail the base rules and go. Rows with a null or repeated doc_id are
    judged one by one, by their texts; equal texts have equal verdicts.
    """
    return quality_rules.kept_rows(docs, common.table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8 or more): the least doc_id.

    Texts that are null or have no word are near nothing and stay; so do all rows with a null doc_id. Of rows that share a
    doc_id one stays.
    """
    return minhash.one_of_each(docs, words=5, percent=80)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no test item leaks.

    Null and empty texts hold no item and stay, and so do rows with a null doc_id; rows that share a doc_id go together if an
    item leaks into one of them. Without test items all stay.
    """
    return decontaminate.clean_rows(docs, common.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows.

    A null text stays null with its n_chars, an empty one empty. Equal texts are redacted alike. Without any labelled
    credential only base spans are replaced.
    """
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequence and the place in it.

    A null or empty text is one piece of one id. Rows with a null or repeated doc_id are packed like others; pieces of one
    length are alike, and which of them is in which sequence follows from doc_id, piece and content.
    """
    return packing.packed(docs, packing.vocabulary_file())


STAGES = [
    ("quality_rules", quality),
    ("minhash", deduplicate),
    ("decontaminate", clean_of_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Learned rules, signatures, alignment and automata have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what is between two of them lies in the shared folder until its reader has ended."""
    docs = common.table(spark, sf_dir, "documents")
    scratch = common.Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
