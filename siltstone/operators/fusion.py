"""Fusing runs: weighted sums after min-max, and reciprocal ranks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .ranking import ranked


def scaled(run: DataFrame) -> DataFrame:
    """The run with scores from 0 to 1 within each query."""
    return run.withColumn("score", V.minmax(F.col("score"), "query_id"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, article_id, a, b: the scaled scores of two runs; where a run lacks an article, 0."""
    left = scaled(a).select("query_id", "article_id", F.col("score").alias("a"))
    right = scaled(b).select("query_id", "article_id", F.col("score").alias("b"))
    rows = left.join(right, ["query_id", "article_id"], "full_outer")
    return rows.select("query_id", "article_id", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


def weighted(a: DataFrame, b: DataFrame, alpha: float | Column = 0.5, k: int | None = None) -> DataFrame:
    """(1 - alpha) * a + alpha * b over the articles of either run."""
    return ranked(both(a, b).withColumn("score", (1 - F.lit(alpha)) * F.col("a") + F.lit(alpha) * F.col("b")), k)


def reciprocal(runs: Sequence[DataFrame], constant: int = 60, k: int | None = None) -> DataFrame:
    """Sum of 1 / (constant + rank) over any number of runs; scores are not looked at."""
    rows = reduce(DataFrame.union, (r.select("query_id", "article_id", "rank") for r in runs))
    return ranked(rows.groupBy("query_id", "article_id").agg(F.sum(1 / (constant + F.col("rank"))).alias("score")), k)
