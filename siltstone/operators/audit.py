"""Audit of a corpus: duplicates, near-duplicates, leaks and statistics.

No operator collects a group. Exact copies are a key (their content hash); near-duplicates are pairs between different
codes plus the members of each code, so that a large group of copies is never expanded into pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..sources import tables

NEAR_HAMMING, SIMHASH_GRAM = 3, 5
QUESTION_GRAM, QUESTION_JACCARD = 3, 0.8
#: Buckets of hashes in which grams are counted to tell frequent ones.
BUCKETS = 1 << 18


def duplicate_groups(articles: DataFrame) -> DataFrame:
    """articles with dup_group, the content hash of title and text: articles of one title-less body and of none differ."""
    title = F.coalesce("title", F.lit("")) if "title" in articles.columns else F.lit("")
    return articles.withColumn("dup_group", H.content_hash(F.concat(title, F.lit(" "), F.coalesce("text", F.lit("")))))


def duplicates(grouped: DataFrame, document: str = "document") -> DataFrame:
    """dup_group, article_id, n_members, n_documents of all members of groups with two or more.

    Group sizes are aggregated first and joined back, so that a group's rows need not be in one task.
    """
    several = grouped.groupBy("dup_group").agg(F.count("*").alias("n_members")).where("n_members > 1")
    documents = grouped.select("dup_group", document).distinct().groupBy("dup_group").agg(F.count(document).alias("n_documents"))
    rows = grouped.select("dup_group", "article_id").join(several, "dup_group").join(documents, "dup_group")
    return rows.select("dup_group", "article_id", "n_members", "n_documents")


def simhash_codes(rows: DataFrame, tokens: Column, n: int = SIMHASH_GRAM) -> DataFrame:
    """article_id and the SimHash of its set of n-grams; without tokens the code is 0."""
    grams = rows.select("article_id", F.explode_outer(T.ngrams(tokens, n)).alias("gram"))
    return grams.groupBy("article_id").agg(H.simhash(H.token_hash(F.col("gram"))).alias("code"))


def near_duplicates(codes: DataFrame, distance: int = NEAR_HAMMING) -> DataFrame:
    """a, b, distance: pairs a < b of codes at most `distance` bits apart, each code by its least article_id; and at
    distance 0 each further article of a code with that id. Every such pair is found.
    """
    classes = codes.groupBy("code").agg(F.min("article_id").alias("rep"))
    keyed = classes.select("rep", "code", F.explode(H.keys_within(F.col("code"), distance)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keyed = keyed.join(shared, "key")
    left, right = (keyed.select("key", F.col("rep").alias(x), F.col("code").alias(f"code_{x}")) for x in "ab")
    pairs = left.join(right, "key").where("a < b").withColumn("distance", H.hamming(F.col("code_a"), F.col("code_b")))
    pairs = pairs.where(F.col("distance") <= distance).select("a", "b", "distance").distinct()
    members = codes.join(classes, "code").where("article_id > rep").select(F.col("rep").alias("a"), F.col("article_id").alias("b"), F.lit(0).alias("distance"))
    return pairs.union(members)


def crowded_bands(codes: DataFrame, bands: int = 8, most: int = 2000) -> DataFrame:
    """band, value, n of LSH buckets with more than `most` codes: those that a banded join with that cap would skip."""
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("band"), H.band(F.col("code"), k, bands).alias("value")) for k in range(bands))))
    return codes.select(keys.alias("k")).groupBy("k.band", "k.value").agg(F.count("*").alias("n")).where(F.col("n") > most)


def near_queries(a: DataFrame, b: DataFrame, n: int = QUESTION_GRAM, least: float = QUESTION_JACCARD, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """id_a, id_b, jaccard (four decimals): queries of a and b (query_id, text) whose sets of n-grams have that similarity.

    Queries of one side with equal sets are one class, which its least id stands for; `query_classes` gives the members,
    so that copies are not expanded into all pairs. Sets that are alike enough share one of their first grams in any fixed order
    of all grams: of a set of m, one of the first m - ceil(least * m) + 1. Only these are joined, by their hashes. The order is by
    how often the grams of a hash's bucket occur, so that frequent grams come last and make no pairs; one gram more than needed
    is taken, for two grams of a set that have one hash. Candidates, which `keep` holds, are confirmed on whole sets, made anew for them alone.
    """
    often = _often(a.select("query_id", "text").union(b.select("query_id", "text")), n)
    shared = a.sparkSession.sparkContext.broadcast(often)
    one, two = (_first_grams(rows, n, least, shared) for rows in (a, b))
    keyed = lambda rows, x: rows.select(F.col("id").alias(x), F.col("s").alias(f"s_{x}"), F.col("m").alias(f"m_{x}"), F.explode("keys").alias("key"))
    near = keyed(one, "x").join(keyed(two, "y"), "key").where(F.least("m_x", "m_y") >= least * F.greatest("m_x", "m_y"))
    near = keep(near.select("x", "s_x", "y", "s_y").distinct())

    def whole(rows: DataFrame, x: str) -> DataFrame:
        ids = F.broadcast(near.select(F.col(x).alias("query_id")).distinct())
        some = rows.join(ids, "query_id", "left_semi")
        return some.select(F.col("query_id").alias(x), _text_hash().alias(f"s_{x}"), T.ngrams(T.tokens("text"), n).alias(f"g_{x}")).dropDuplicates([x, f"s_{x}"])

    both = near.join(whole(a, "x"), ["x", "s_x"]).join(whole(b, "y"), ["y", "s_y"]).withColumn("jaccard", H.jaccard(F.col("g_x"), F.col("g_y")))
    return both.where(F.col("jaccard") >= least).select(F.col("x").alias("id_a"), F.col("y").alias("id_b"), F.round("jaccard", 4).alias("jaccard"))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _token_hashes(rows: DataFrame) -> DataFrame:
    """query_id, s (of the text) and h, the hashes of its tokens in order."""
    return tables.batched(rows.select("query_id", _text_hash().alias("s"), F.transform(T.tokens("text"), lambda t: F.xxhash64(t)).alias("h")))


def _hashed_grams(lists: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each list of hashes, as hashes in rising order, and how many each list has; fewer than n are one."""
    flat, sizes = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy().astype(np.int64)
    row, first = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
    place, size = np.arange(len(row)) - first, sizes[row]
    start = np.flatnonzero((place + n <= size) | ((size < n) & (place == 0)))
    gram, row, size = np.full(len(start), 0x8445D61A4E774912, np.uint64), row[start], size[start]
    for k in range(n):
        some = k < size
        mixed = (gram[some] ^ flat[start[some] + k]) * np.uint64(0x9E3779B97F4A7C15)
        gram[some] = mixed ^ (mixed >> np.uint64(29))
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    return gram[new], np.bincount(row[new], minlength=len(sizes))


def _often(rows: DataFrame, n: int) -> np.ndarray:
    """How many grams of all texts fall into each bucket of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            found += np.bincount((_hashed_grams(batch.column("h"), n)[0] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["bucket", "n"])

    sums = _token_hashes(rows).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def _first_grams(rows: DataFrame, n: int, least: float, shared) -> DataFrame:
    """id and s (of the text) of each class of the queries that have a token, its number of grams m and keys, its first grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            gram, m = _hashed_grams(batch.column("h"), n)
            ends, row = np.concatenate([[0], np.cumsum(m)]), np.repeat(np.arange(len(m)), m)
            ids = [hashlib.blake2b(gram[x:y].tobytes(), digest_size=16).digest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            order = np.lexsort((gram, often[(gram % np.uint64(BUCKETS)).astype(np.int64)], row))
            kept = np.arange(len(row)) - ends[row] < (m - np.ceil(least * m) + 2)[row]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(m)))]), pa.int32())
            keys = pa.ListArray.from_arrays(ends, pa.array(gram[order][kept].view(np.int64)))
            out = pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("s"), pa.array(ids, pa.binary()), pa.array(m, pa.int64()), keys], names=["query_id", "s", "set_id", "m", "keys"])
            yield out.filter(pa.array(m > 0))

    kind = rows.schema["query_id"].dataType.simpleString()
    each = _token_hashes(rows).mapInArrow(run, f"query_id {kind}, s long, set_id binary, m long, keys array<long>")
    one = each.groupBy("set_id").agg(F.min(F.struct("query_id", "s")).alias("x"), F.first("m").alias("m"), F.first("keys").alias("keys"))
    return one.select(F.col("x.query_id").alias("id"), F.col("x.s").alias("s"), "m", "keys")


def _gram_sets(rows: DataFrame, n: int) -> DataFrame:
    """query_id, grams and set_id of the queries that have a token."""
    grams = F.array_sort(T.ngrams(T.tokens("text"), n))
    return rows.select("query_id", grams.alias("grams")).where(F.size("grams") > 0).withColumn("set_id", F.sha1(F.array_join("grams", "\n")))


def query_classes(rows: DataFrame, n: int = QUESTION_GRAM) -> DataFrame:
    """query_id and class_id, the least id among the queries (query_id, text) with the same set of n-grams; those without
    a token are left out."""
    each = _gram_sets(rows, n).select("query_id", "set_id")
    return each.join(each.groupBy("set_id").agg(F.min("query_id").alias("class_id")), "set_id").select("query_id", "class_id")


def same_ids(a: DataFrame, b: DataFrame, column: str = "query_id") -> DataFrame:
    """Ids that occur in both, with kind `same_id`."""
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_semi").withColumn("kind", F.lit("same_id"))


def repeated_ids(queries: DataFrame, order: str | Column = "text") -> DataFrame:
    """query_id, n_rows, n_texts, first_text of ids that occur more than once."""
    grouped = queries.groupBy("query_id").agg(F.count("*").alias("n_rows"), F.count_distinct("text").alias("n_texts"), F.min_by("text", order).alias("first_text"))
    return grouped.where("n_rows > 1")


def require_one_text(queries: DataFrame) -> DataFrame:
    """queries, with an error on action if an id has two different texts."""
    bad = queries.groupBy("query_id").agg(F.count_distinct("text").alias("n")).where("n > 1").select("query_id").withColumn("__bad", F.lit(True))
    fail = F.raise_error(F.concat(F.lit("two texts for query "), F.col("query_id").cast("string"))).cast("boolean")
    return queries.join(bad, "query_id", "left").where(F.when(F.col("__bad"), fail).otherwise(True)).drop("__bad")


def spelling_variants(articles: DataFrame, column: str = "document") -> DataFrame:
    """folded, variant, n_articles: document ids that differ in nothing but accents."""
    counts = articles.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("variant")).agg(F.count("*").alias("n_articles"))
    counts = counts.withColumn("folded", T.folded("variant"))
    several = counts.groupBy("folded").agg(F.count("*").alias("n")).where("n > 1").select("folded")
    return counts.join(several, "folded").select("folded", "variant", "n_articles")


def statistics(articles: DataFrame, document: str = "document") -> DataFrame:
    """name, value: ten statistics of the corpus. Word counts are of the text; percentiles are exact and cut to integers."""
    rows = articles.select("article_id", document, T.word_count("text").alias("n"))
    wide = rows.agg(
        F.count("*").cast("double").alias("articles"),
        F.count_distinct("article_id").cast("double").alias("article_ids"),
        F.count_distinct(document).cast("double").alias("documents"),
        F.floor(F.percentile("n", 0.5)).cast("double").alias("median_words"),
        F.round(F.avg("n"), 1).alias("mean_words"),
        F.floor(F.percentile("n", 0.9)).cast("double").alias("p90_words"),
        F.max("n").cast("double").alias("max_words"),
        F.round(100 * F.count_if(F.col("n") > 200) / F.count("*"), 1).alias("percent_over_200"),
        F.round(100 * F.count_if(F.col("n") > 400) / F.count("*"), 1).alias("percent_over_400"),
        F.count_if(F.col("n") == 0).cast("double").alias("empty"),
    )
    return wide.unpivot([], wide.columns, "name", "value")


def length_histogram(articles: DataFrame, width: int = 20, most: int = 1000) -> DataFrame:
    """bucket (its first word count; `most` stands for that many and more) and n."""
    bucket = (F.least(F.floor(T.word_count("text") / width), F.lit(most // width)) * width).cast("long")
    return articles.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def empty_articles(articles: DataFrame) -> DataFrame:
    """Articles whose text is null or white space."""
    return articles.where(F.coalesce("text", F.lit("")).rlike(r"^\s*$"))


def unaccented(queries: DataFrame) -> DataFrame:
    """Queries without any accent."""
    return queries.where(~T.accented("text"))


def conflicting_gold(train: DataFrame, test: DataFrame) -> DataFrame:
    """query_id, train_gold, test_gold (sorted ids) and equal, for queries with gold in both."""
    ids = lambda df, name: df.groupBy("query_id").agg(F.array_sort(F.collect_set("article_id")).alias(name))
    return ids(train, "train_gold").join(ids(test, "test_gold"), "query_id").withColumn("equal", F.col("train_gold") == F.col("test_gold"))


def gold_twins(gold: DataFrame, groups: DataFrame) -> DataFrame:
    """query_id, article_id, n_twins, first_twin: gold articles that have exact copies."""
    groups = groups.select("article_id", "dup_group").distinct()
    # the number and the two least ids of a group say all that is asked, so that its members are never listed
    sizes = groups.groupBy("dup_group").agg(F.count("*").alias("n"), F.min("article_id").alias("one")).where("n > 1")
    second = groups.join(sizes, "dup_group").where("article_id <> one").groupBy("dup_group").agg(F.min("article_id").alias("two"))
    rows = gold.select("query_id", "article_id").distinct().join(groups, "article_id").join(sizes, "dup_group").join(second, "dup_group")
    twin = F.when(F.col("article_id") == F.col("one"), F.col("two")).otherwise(F.col("one"))
    return rows.select("query_id", "article_id", (F.col("n") - 1).alias("n_twins"), twin.alias("first_twin"))


def leaks(parts: DataFrame) -> DataFrame:
    """a, b, n_common: how many queries two splits share. parts: query_id, split."""
    one = parts.select("query_id", "split").distinct()
    names = one.select("split").distinct()
    pairs = names.select(F.col("split").alias("a")).join(F.broadcast(names.select(F.col("split").alias("b"))), F.col("a") < F.col("b"))
    met = one.withColumnRenamed("split", "a").join(one.withColumnRenamed("split", "b"), "query_id").where("a < b")
    counts = met.groupBy("a", "b").agg(F.count("*").alias("n_common"))
    return pairs.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n_common", F.lit(0)).alias("n_common"))


def require_disjoint(parts: DataFrame) -> DataFrame:
    """parts, with an error on action if a query is in two splits."""
    bad = parts.groupBy("query_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select("query_id").withColumn("__bad", F.lit(True))
    fail = F.raise_error(F.concat(F.lit("query in two splits: "), F.col("query_id").cast("string"))).cast("boolean")
    return parts.join(bad, "query_id", "left").where(F.when(F.col("__bad"), fail).otherwise(True)).drop("__bad")


def split_distribution(qrels: DataFrame) -> DataFrame:
    """split, n_queries, n_pairs, mean_gold (three decimals)."""
    counts = qrels.groupBy("split").agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_pairs"))
    return counts.withColumn("mean_gold", F.round(F.col("n_pairs") / F.col("n_queries"), 3))
