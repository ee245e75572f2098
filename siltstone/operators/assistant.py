"""Answering questions: restore accents, search both ways, fuse, explain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import dense, fusion, sparse

DEPTH = 100


def answers(
    queries: DataFrame, articles: DataFrame, index: sparse.Index, restored: DataFrame | None = None, vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None, alpha: float = 0.75, k: int = 3, k1: float = 0.6, b: float = 0.9, chars: int = 600,
) -> DataFrame:
    """query_id, asked, used, is_restored, rank, article_id, title, score, snippet, terms, n_terms for the k best articles.

    `restored` (query_id, text, restored) has the queries with accents set, which then are what is searched for; without
    it they are taken as they are. Without vectors the search is BM25 alone. The snippet is of the article's nearest chunk if vectors come with text,
    else of the article.
    """
    if restored is not None:
        asked = restored.select("query_id", F.col("text").alias("asked"), F.col("restored").alias("used"))
    else:
        asked = queries.select("query_id", F.col("text").alias("asked"), F.col("text").alias("used"))
    used = asked.select("query_id", F.col("used").alias("text"))
    run = sparse.search_index(index, used, DEPTH, k1, b)
    if vectors is not None and query_vectors is not None:
        run = fusion.weighted(run, dense.search(query_vectors, vectors, DEPTH), alpha, k)
    run = run.where(F.col("rank") <= k)
    found = sparse.explained(run, used, articles, index.idf())
    title = F.col("title") if "title" in articles.columns else F.substring_index("text", "\n", 1)
    shown = articles.select("article_id", title.alias("title"), T.snippet("text", title if "title" in articles.columns else None, chars).alias("snippet"))
    # the few rows of the run go to where the texts are
    rows = shown.join(F.broadcast(run.join(found, ["query_id", "article_id"])), "article_id").join(asked, "query_id")
    return rows.select(
        "query_id", "asked", "used", (F.col("asked") != F.col("used")).alias("is_restored"), "rank", "article_id", "title", "score", "snippet", "terms", F.size("terms").cast("long").alias("n_terms")
    )


def rendered(found: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id and answer: one text for each query, with a warning if no word matches and a note if nothing was found."""
    item = F.struct("rank", "article_id", "title", "snippet", "terms", "n_terms", "used", "is_restored")
    grouped = queries.select("query_id", "text").join(found.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("hits")), "query_id", "left")
    first = F.col("hits")[0]
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    others = F.transform(F.slice("hits", 2, 1 << 30), lambda h: line("  - ", h["title"], "  [", h["article_id"].cast("string"), "]"))
    asked = line("Question: ", F.coalesce("text", F.lit("")))
    restored: Column = F.when(first["is_restored"], line("(Accents restored: ", first["used"], ")"))
    warning = F.when(first["n_terms"] == 0, F.lit("(Warning: no word of the question matches the article below; it may be out of scope)"))
    body = F.concat_ws(
        "\n", asked, restored, warning, F.lit(""), line("Best match: ", first["title"], "  [", first["article_id"].cast("string"), "]"), line("Passage: ", first["snippet"]),
        line("Matching words: ", T.listed(first["terms"])), F.lit(""), F.lit("See also:"), F.array_join(others, "\n"),
    )
    nothing = F.concat_ws("\n", asked, F.lit(""), F.lit("No article was found."))
    return grouped.select("query_id", F.when(F.col("hits").isNull(), nothing).otherwise(body).alias("answer"))
