"""Measures of runs against gold (query_id, article_id; distinct rows).

Averages are over the given queries, those without any result included. Values have four decimals, rounded half up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KS = (1, 5, 10, 20)


def hits(run: DataFrame, gold: DataFrame) -> DataFrame:
    """The rows of a run that are gold."""
    return run.join(gold.select("query_id", "article_id").distinct(), ["query_id", "article_id"], "left_semi")


def require_gold(queries: DataFrame, gold: DataFrame) -> DataFrame:
    """queries, with an error on action where one has no gold."""
    has = gold.select("query_id").distinct().withColumn("__has", F.lit(True))
    lack = F.raise_error(F.concat(F.lit("query without gold: "), F.col("query_id").cast("string"))).cast("boolean")
    return queries.join(has, "query_id", "left").where(F.coalesce("__has", lack)).drop("__has")


def require_results(queries: DataFrame, run: DataFrame) -> DataFrame:
    """queries, with an error on action where the run has no row for one."""
    has = run.select("query_id").distinct().withColumn("__has", F.lit(True))
    lack = F.raise_error(F.concat(F.lit("query missing from the run: "), F.col("query_id").cast("string"))).cast("boolean")
    return queries.join(has, "query_id", "left").where(F.coalesce("__has", lack)).drop("__has")


def per_query(run: DataFrame, gold: DataFrame, queries: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """query_id, n_gold, and for each k: recall, mrr, ndcg and f2 (precision is hits over k, however many were returned)."""
    sizes = gold.select("query_id", "article_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    aggregates = []
    for k in ks:
        inside = F.col("rank") <= k
        aggregates += [
            F.count_if(inside).alias(f"n{k}"),
            F.min(F.when(inside, F.col("rank"))).alias(f"f{k}"),
            F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1))).alias(f"d{k}"),
        ]
    found = hits(run, gold).groupBy("query_id").agg(*aggregates)
    rows = queries.select("query_id").distinct().join(sizes, "query_id", "left").join(found, "query_id", "left")
    gold_size = F.coalesce("n_gold", F.lit(0))
    out = [F.col("query_id"), gold_size.alias("n_gold")]
    for k in ks:
        n = F.coalesce(f"n{k}", F.lit(0))
        recall = F.when(gold_size > 0, n / gold_size).otherwise(0.0)
        best = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(gold_size, F.lit(1)), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        p = n / F.lit(k)
        out += [
            recall.alias(f"recall_{k}"),
            F.coalesce(1 / F.col(f"f{k}"), F.lit(0.0)).alias(f"mrr_{k}"),
            F.when(gold_size > 0, F.coalesce(f"d{k}", F.lit(0.0)) / best).otherwise(0.0).alias(f"ndcg_{k}"),
            F.when(4 * p + recall > 0, 5 * p * recall / (4 * p + recall)).otherwise(0.0).alias(f"f2_{k}"),
        ]
    return rows.select(*out)


def evaluated(run: DataFrame, gold: DataFrame, queries: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """measure, value: averages over the queries; without queries, no rows. A query without gold is an error."""
    each = per_query(run, gold, require_gold(queries, gold), ks)
    names = [f"{m}_{k}" for k in ks for m in ("recall", "mrr", "ndcg", "f2")]
    means = each.agg(*(F.round(F.avg(c), 4).alias(c) for c in names))
    return means.unpivot([], names, "measure", "value").where("value IS NOT NULL")


def recall_at(run: DataFrame, gold: DataFrame, queries: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The mean recall at k, of each setting in the columns `by` if the run has several."""
    sizes = gold.select("query_id", "article_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    base = queries.select("query_id").distinct().join(sizes, "query_id")
    if by:
        base = base.join(F.broadcast(run.select(*by).distinct()))
    found = hits(run.where(F.col("rank") <= k), gold).groupBy(*by, "query_id").agg(F.count("*").alias("n"))
    rows = base.join(found, [*by, "query_id"], "left")
    return rows.groupBy(*by).agg(F.round(F.avg(F.coalesce("n", F.lit(0)) / F.col("n_gold")), 6).alias("recall"))


def hit_matrix(runs: dict[str, DataFrame], gold: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id and one column a system: 1 if a gold article is among its first k."""
    rows = queries.select("query_id").distinct()
    for name, run in runs.items():
        found = hits(run.where(F.col("rank") <= k), gold).select("query_id").distinct().withColumn(name, F.lit(1))
        rows = rows.join(found, "query_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows


def gold_rank(run: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id and the first rank of a gold article, or null."""
    found = hits(run, gold).groupBy("query_id").agg(F.min("rank").alias("gold_rank"))
    return queries.select("query_id").distinct().join(found, "query_id", "left")


def ceiling(matrix: DataFrame, a: str, b: str, fused: str | None = None) -> DataFrame:
    """system, share: hit rates of two systems, of their fusion, and of either one (what fusion could reach)."""
    rates = [F.round(F.avg(c), 4).alias(c) for c in (a, b, *([fused] if fused else []))]
    rates.append(F.round(F.avg(F.greatest(a, b)), 4).alias("either"))
    row = matrix.agg(*rates)
    return row.unpivot([], row.columns, "system", "share")


def expanded_gold(gold: DataFrame, groups: DataFrame) -> DataFrame:
    """Gold with all duplicates of each gold article. groups: article_id, dup_group; an unknown article keeps itself."""
    groups = groups.select("article_id", "dup_group")
    twins = groups.select(F.col("article_id").alias("twin"), "dup_group")
    rows = gold.select("query_id", "article_id").join(groups, "article_id", "left")
    # once for each group of a query, for a group of n copies that are all gold would make n * n rows
    whole = rows.where("dup_group IS NOT NULL").select("query_id", "dup_group").distinct().join(twins, "dup_group")
    alone = rows.where("dup_group IS NULL").select("query_id", "article_id")
    return whole.select("query_id", F.col("twin").alias("article_id")).union(alone).distinct()
