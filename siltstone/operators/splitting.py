"""Splits of queries and training rows."""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sparse
from .ranking import first_per, ranked

SEED, VAL_RATIO, NEGATIVES = 42, 0.2, 4


def split_queries(queries: DataFrame, ratio: float = VAL_RATIO, seed: int = SEED, parts: int = 1024) -> DataFrame:
    """query_id and split: the round(n * ratio) queries that come first by a hash of seed and id are `val`, the rest `train`.

    The result depends on the set of ids and the seed alone. The order is found in two steps, counts by hash prefix
    and then ranks within a prefix, so that no task sorts all ids.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("query_id").cast("string")))
    ids = queries.select("query_id").distinct().withColumn("h", digest).withColumn("part", F.pmod(F.conv(F.substring("h", 1, 4), 16, 10).cast("int"), F.lit(65536)) * parts / 65536)
    ids = ids.withColumn("part", F.col("part").cast("int"))
    counts = ids.groupBy("part").agg(F.count("*").alias("n"))
    sums = counts.select("part", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rows = ids.join(F.broadcast(sums), "part").withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("h", "query_id")))
    first = F.col("place") + F.coalesce("before", F.lit(0)) <= F.bround(F.col("total") * ratio)
    return rows.select("query_id", F.when(first, "val").otherwise("train").alias("split"))


def with_split(rows: DataFrame, ids: DataFrame, ratio: float = VAL_RATIO, seed: int = SEED) -> DataFrame:
    """rows (query_id, ...) with the split of `split_queries` over ids: by comparing with the last `val` id in the order of
    hashes, so that the rows are not joined."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("query_id").cast("string")))
    last = split_queries(ids, ratio, seed).where("split = 'val'").agg(F.max(F.struct(digest.alias("h"), "query_id")).alias("x")).select("x.*").first()
    kind = rows.schema["query_id"].dataType
    first = F.lit(False) if last.h is None else (digest < last.h) | ((digest == last.h) & (F.col("query_id") <= F.lit(last.query_id).cast(kind)))
    return rows.withColumn("split", F.when(first, "val").otherwise("train"))


def shuffled_split(ids: Iterable[str], ratio: float = VAL_RATIO, seed: int = SEED) -> tuple[list[str], list[str]]:
    """(train, val) of a list of ids that fits the driver, by a seeded shuffle of the sorted distinct ids; the first
    round(n * ratio) are val. For results that must equal those of such a shuffle elsewhere."""
    order = sorted(set(ids))
    random.Random(seed).shuffle(order)
    cut = round(len(order) * ratio)
    return order[cut:], order[:cut]


def without_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both qrels in one table with split; train rows of queries that test has are dropped, test stays whole."""
    kept = train.join(test.select("query_id").distinct(), "query_id", "left_anti")
    return kept.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)


def positives(gold: DataFrame, queries: DataFrame, chunks: DataFrame, query_tokens: Column, chunk_tokens: Column) -> DataFrame:
    """query_id, article_id, chunk_no, overlap: of each query's first gold article the chunk with most of the query's tokens."""
    first = first_per(gold.select("query_id", "article_id").distinct(), ["query_id"], ["article_id"])
    rows = first.join(queries.select("query_id", F.array_distinct(query_tokens).alias("q")), "query_id")
    rows = rows.join(chunks.select("article_id", "chunk_no", F.array_distinct(chunk_tokens).alias("c")), "article_id")
    rows = rows.withColumn("overlap", F.size(F.array_intersect("q", "c")).cast("long"))
    return first_per(rows, ["query_id"], [F.desc("overlap"), "chunk_no"]).select("query_id", "article_id", "chunk_no", "overlap")


def hard_negatives(queries: DataFrame, gold: DataFrame, articles: DataFrame, n: int = NEGATIVES, index: sparse.Index | None = None) -> DataFrame:
    """query_id and negative_1 .. negative_n: the best BM25 hits of the query's distinct terms (of 5 * n) that are in no
    duplicate group of its gold. Queries with fewer are left out. articles: article_id, dup_group and what tokens come from.
    """
    terms = sparse.query_terms(queries).withColumn("qtf", F.lit(1))
    index = index or sparse.build(articles, only=terms)
    # the articles of the run and of gold go to where the texts are, whose groups are then all that is kept
    top, gold = ranked(sparse.scores(index, terms, k=5 * n), 5 * n), gold.select("query_id", "article_id")
    asked = top.select("article_id").union(gold.select("article_id")).distinct()
    groups = articles.select("article_id", "dup_group").join(F.broadcast(asked), "article_id", "left_semi")
    top, known = top.join(groups, "article_id"), gold.join(groups, "article_id").select("query_id", "dup_group").distinct()
    rest = top.join(known, ["query_id", "dup_group"], "left_anti")
    some = first_per(rest, ["query_id"], ["rank"], n)
    sorted_ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "article_id"))), lambda r: r["article_id"])
    rows = some.groupBy("query_id").agg(sorted_ids.alias("ids")).where(F.size("ids") == n)
    return rows.select("query_id", *(F.col("ids")[k].alias(f"negative_{k + 1}") for k in range(n)))
