"""Error analysis of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import first_per


def contingency(matrix: DataFrame, a: str, b: str) -> DataFrame:
    """outcome (both, a_only, b_only, neither), n, percent (two decimals) of two hit columns."""
    x, y = F.col(a) == 1, F.col(b) == 1
    row = matrix.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"), F.count_if(~x & ~y).alias("neither"))
    total = F.col("both") + F.col("a_only") + F.col("b_only") + F.col("neither")
    rows = row.withColumn("total", total).unpivot(["total"], ["both", "a_only", "b_only", "neither"], "outcome", "n")
    return rows.select("outcome", "n", F.when(F.col("total") > 0, F.round(100 * F.col("n") / F.col("total"), 2)).otherwise(0.0).alias("percent"))


def failures(run: DataFrame, gold: DataFrame, queries: DataFrame, titles: DataFrame, k: int = 10, shown: int = 3) -> DataFrame:
    """query_id, text, gold_id, top_1 .. top_n (titles): queries without a gold article among the first k."""
    hit = run.where(F.col("rank") <= k).join(gold.select("query_id", "article_id"), ["query_id", "article_id"], "left_semi").select("query_id").distinct()
    bad = queries.join(hit, "query_id", "left_anti")
    one = gold.groupBy("query_id").agg(F.min("article_id").alias("gold_id"))
    top = titles.join(F.broadcast(run.where(F.col("rank") <= shown)), "article_id")  # a few rows a query
    tops = top.groupBy("query_id").agg(*(F.max(F.when(F.col("rank") == r, F.col("title"))).alias(f"top_{r}") for r in range(1, shown + 1)))
    return bad.join(one, "query_id").join(tops, "query_id", "left")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with their hand-given cause, null where there is none."""
    return rows.join(labels.select("query_id", "cause"), "query_id", "left")


def unlabelled(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("cause").isNull()).alias("unlabelled"))


def causes(rows: DataFrame) -> DataFrame:
    """cause, n, percent (one decimal), most frequent first; null is left out."""
    counts = rows.where("cause IS NOT NULL").groupBy("cause").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("cause", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent")).orderBy(F.desc("n"), "cause")


def examples(rows: DataFrame, by: str, n: int = 8) -> DataFrame:
    """The first n rows of each stratum, by query_id."""
    return first_per(rows, [by], ["query_id"], n)
