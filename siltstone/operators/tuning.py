"""Parameter sweeps and selection. A sweep is one plan over a small table of settings."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fusion, metrics, sparse
from .ranking import ranked

# The grids.
K1S = (0.6, 0.9, 1.2, 1.5, 1.8)
BS = (0.3, 0.5, 0.75, 0.9)
CONSTANTS = (10, 20, 60, 100)
ALPHAS = tuple(round(0.05 * k, 2) for k in range(21))
TUNE_K = 10


def settings(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """Every combination of the axes' values as a row."""
    out = None
    for name, values in axes.items():
        kind = "int" if all(isinstance(v, int) for v in values) else "double"
        axis = spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
        out = axis if out is None else out.join(axis)
    return out


def _spread(rows: DataFrame, grid: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(grid))


def bm25(index: sparse.Index, queries: DataFrame, gold: DataFrame, k1s: Sequence[float] = K1S, bs: Sequence[float] = BS, k: int = TUNE_K) -> DataFrame:
    """k1, b, recall of every setting, from one reading of the index: its tasks keep the best k by each setting and query."""
    grid = settings(queries.sparkSession, k1=[float(x) for x in k1s], b=[float(x) for x in bs])
    gold = gold.select("query_id", "article_id").distinct().join(queries.select("query_id").distinct(), "query_id", "left_semi")
    run = sparse.grid(index, sparse.query_terms(queries), grid, k)
    found = metrics.hits(run, gold).groupBy("k1", "b", "query_id").agg(F.count("*").alias("n"))
    rows = _spread(gold.groupBy("query_id").agg(F.count("*").alias("n_gold")), grid).join(found, ["k1", "b", "query_id"], "left")
    return rows.groupBy("k1", "b").agg(F.round(F.avg(F.coalesce("n", F.lit(0)) / F.col("n_gold")), 6).alias("recall"))


def alphas(a: DataFrame, b: DataFrame, gold: DataFrame, queries: DataFrame, values: Sequence[float] = ALPHAS, k: int = TUNE_K) -> DataFrame:
    """alpha, recall of weighted fusions of two runs."""
    rows = _spread(fusion.both(a, b), settings(queries.sparkSession, alpha=values))
    rows = rows.withColumn("score", (1 - F.col("alpha")) * F.col("a") + F.col("alpha") * F.col("b")).withColumn("query_id", F.struct("alpha", "query_id"))
    run = ranked(rows, k).select(F.col("query_id.alpha").alias("alpha"), F.col("query_id.query_id").alias("query_id"), "article_id", "rank")
    return metrics.recall_at(run, gold, queries, k, ("alpha",))


def constants(runs: Sequence[DataFrame], gold: DataFrame, queries: DataFrame, values: Sequence[int] = CONSTANTS, k: int = TUNE_K) -> DataFrame:
    """constant, recall of reciprocal rank fusions."""
    rows = runs[0].select("query_id", "article_id", "rank")
    for run in runs[1:]:
        rows = rows.union(run.select("query_id", "article_id", "rank"))
    rows = _spread(rows, settings(queries.sparkSession, constant=values))
    score = rows.groupBy("constant", "query_id", "article_id").agg(F.sum(1 / (F.col("constant") + F.col("rank"))).alias("score"))
    run = ranked(score.withColumn("query_id", F.struct("constant", "query_id")), k)
    run = run.select(F.col("query_id.constant").alias("constant"), F.col("query_id.query_id").alias("query_id"), "article_id", "rank")
    return metrics.recall_at(run, gold, queries, k, ("constant",))


def best(sweep: DataFrame, *order) -> DataFrame:
    """The row of greatest recall; of equal ones the first in the stated order."""
    return sweep.orderBy(F.desc("recall"), *order).limit(1)


def best_alpha(sweep: DataFrame) -> DataFrame:
    """The best alpha, of equal ones that nearest to a half, and whether it lies at an end of the grid."""
    ends = sweep.agg(F.min("alpha").alias("lo"), F.max("alpha").alias("hi"))
    top = best(sweep, F.abs(F.col("alpha") - 0.5), "alpha")
    return top.join(F.broadcast(ends)).select("alpha", "recall", ((F.col("alpha") == F.col("lo")) | (F.col("alpha") == F.col("hi"))).alias("at_end"))


def select_clean(results: DataFrame) -> DataFrame:
    """Of rows (system, recall, contaminated): the best clean one is chosen; the best contaminated one is reported beside it."""
    top = lambda c: best(results.where(F.col("contaminated") == c), "system")
    return top(False).withColumn("chosen", F.lit(True)).union(top(True).withColumn("chosen", F.lit(False)))


def pooling_of(results: DataFrame, model: str, default: str = "max") -> DataFrame:
    """pooling: the best one of a model in rows (model, pooling, recall), or the default where there is none."""
    found = best(results.where(F.col("model") == model), "pooling").agg(F.max("pooling").alias("p"))
    return found.select(F.coalesce("p", F.lit(default)).alias("pooling"))


def comparison(runs: dict[str, DataFrame], gold: DataFrame, queries: DataFrame, facts: DataFrame | None = None, ks: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """system and a column for each measure; `facts` (system, ...) adds what is known of the systems, such as latency."""
    out = None
    for name, run in runs.items():
        each = metrics.per_query(run, gold, queries, ks)
        columns = [f"recall_{k}" for k in ks] + ["mrr_10", "ndcg_10", "f2_10"]
        row = each.agg(*(F.round(F.avg(c), 4).alias(c) for c in columns)).withColumn("system", F.lit(name))
        out = row if out is None else out.union(row)
    return out.join(F.broadcast(facts), "system", "left") if facts is not None else out


def side_by_side(runs: dict[str, DataFrame], k: int = 3) -> DataFrame:
    """query_id, rank and for each system the article at that rank, null where it has none."""
    out = None
    for name, run in runs.items():
        part = run.where(F.col("rank") <= k).select("query_id", "rank", F.col("article_id").alias(name))
        out = part if out is None else out.join(part, ["query_id", "rank"], "full_outer")
    return out


def latency(search: Callable[[str], object], texts: Sequence[str], most: int = 60) -> dict[str, float]:
    """p50_ms and p95_ms of a search that is called for one query after the other, after one call to warm up."""
    some = list(texts)[:most]
    if not some:
        return {"p50_ms": 0.0, "p95_ms": 0.0}
    search(some[0])
    took = []
    for text in some:
        began = time.perf_counter()
        search(text)
        took.append(1000 * (time.perf_counter() - began))
    return {"p50_ms": float(np.percentile(took, 50)), "p95_ms": float(np.percentile(took, 95))}
