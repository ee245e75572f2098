"""Queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, language, minhash, packing, pii, quality_model, quality_rules, secrets, sql, substrings

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_packing": packing.op2_packing,
    "op3_minhash": minhash.op3_minhash,
    "op4_quality_model": quality_model.op4_quality_model,
    "op5_pii": pii.op5_pii,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_language": language.op7_language,
    "op8_html": html_extract.op8_html,
    "op9_substrings": substrings.op9_substrings,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that its base patterns alone decide."""
    return secrets.op1_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that its base patterns alone decide."""
    return pii.op5_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that counting alone decides."""
    return quality_rules.op10_quality_rules(spark, sf_dir).select("doc_id", *quality_rules.COUNTS[:5], "base_failed")


def packing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the whole result of op2 (a report of one row)."""
    pieces = packing.op2_packing(spark, sf_dir)
    end = F.col("offset") + F.col("length")
    sequences = pieces.groupBy("sequence_id").agg(F.sum("length").alias("filled"), F.max(end).alias("end"), F.count_distinct("offset").alias("places"), F.count("*").alias("n"))
    wrong = sequences.agg(F.count_if(F.col("end") > packing.CAPACITY).alias("n_over"), F.count_if((F.col("filled") != F.col("end")) | (F.col("places") != F.col("n"))).alias("n_with_gaps"))
    parts = pieces.groupBy("doc_id").agg(F.max("piece").alias("last"), F.sum("length").alias("ids"), F.count("*").alias("n"))
    short = (F.col("n") != F.ceil(F.col("ids") / packing.CAPACITY)) | (F.col("last") != F.col("n") - 1)
    return parts.agg(F.count("*").alias("n_documents"), F.count_if(short).alias("n_cut_short")).join(F.broadcast(wrong))


#: Parts of the operators' results that SQL can express.
QUERIES |= {"base_secrets": base_secrets, "base_pii": base_pii, "rule_counts": rule_counts, "packing_totals": packing_totals}
ORACLE_SQL: dict[str, str] = {"op3_minhash": sql.NEAR_DUPLICATES, "base_secrets": sql.BASE_SECRETS, "base_pii": sql.BASE_PII, "rule_counts": sql.RULE_COUNTS, "packing_totals": sql.PACKING}
