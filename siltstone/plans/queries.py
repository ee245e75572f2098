"""Every query of the engine over the driver's tables, and SQL of the same results where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assistant, audit, chunking, dense, errors, fusion, metrics, restoring, sparse, splitting, tuning
from ..sources import tables
from . import corpus as P
from . import sql as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def put(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return put


# --- text ---------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {Q.NORM} AS norm FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id", T.normalized(T.composed("text")).alias("norm"))


@query(f"SELECT doc_id, array_to_string({Q.TOKENS}, ' ') AS tokens, len({Q.TOKENS})::BIGINT AS n_tokens, {Q.WORD_COUNT} AS n_words FROM documents")
def token_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.table(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("t"), T.word_count("text").alias("n_words"))
    return rows.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n_tokens"), "n_words")


@query(f"SELECT doc_id, len(g)::BIGINT AS n_grams, md5(array_to_string(list_sort(g), '|')) AS digest FROM (SELECT doc_id, {Q.grams(Q.TOKENS, 5)} AS g FROM documents)")
def word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.table(spark, sf_dir, "documents").select("doc_id", T.ngrams(T.tokens("text"), 5).alias("g"))
    return rows.select("doc_id", F.size("g").cast("long").alias("n_grams"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("digest"))


@query(f"SELECT doc_id, {Q.fold('text')} AS folded, {Q.fold('text')} <> coalesce(text, '') AS is_accented FROM documents")
def fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id", T.folded("text").alias("folded"), T.accented("text").alias("is_accented"))


@query(f"SELECT doc_id, array_to_string({Q.SYLLABLES}, ' ') AS syllables, array_to_string({Q.syllables(Q.fold('text'))}, ' ') AS plain FROM documents")
def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.syllables("text"), " ").alias("syllables"), F.array_join(T.folded_syllables("text"), " ").alias("plain"))


@query("SELECT doc_id, source || '+x' AS document, (doc_id % 1000)::INTEGER AS number, source || '+x+' || (doc_id % 1000) AS article FROM documents")
def parse_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made of source and doc_id, taken apart again; the article is that of a chunk id."""
    name = F.concat("source", F.lit("+x+"), (F.col("doc_id") % 1000).cast("string"))
    document, number = T.article_id(name)
    return P.table(spark, sf_dir, "documents").select("doc_id", document.alias("document"), number.alias("number"), T.article_of(F.concat(name, F.lit("#7"))).alias("article"))


@query(f"""SELECT doc_id, CASE WHEN length(text) <= 600 THEN coalesce(text, '') WHEN contains(left(text, 600), ' ')
    THEN regexp_replace(left(text, 600), ' [^ ]*$', '') || ' ...' ELSE left(text, 600) || ' ...' END AS snippet FROM documents""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id", T.snippet("text").alias("snippet"))


@query(f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda p, i:
    CASE WHEN ((((doc_id % 65521) * 31 + 42 + i - 1) * 2654435761) % 4294967296 >> 16) % 100 < 50 THEN {Q.fold('p')} ELSE p END), '') AS text FROM documents""")
def half_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id", T.half_stripped("text", F.col("doc_id")).alias("text"))


@query(f"WITH RECURSIVE {Q.CHUNKS} SELECT article_id || '#' || chunk_no AS chunk_id, article_id, chunk_no, text FROM chunks")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(P.articles(spark, sf_dir).withColumn("title", F.col("document")))


# --- audit --------------------------------------------------------------------------------------------

_GROUPS = f"groups AS (SELECT doc_id AS article_id, source AS document, text, sha1({Q.NORM}) AS dup_group FROM documents)"


@query(f"""WITH {_GROUPS}, sizes AS (SELECT dup_group, count(*) AS n_members, count(DISTINCT document) AS n_documents FROM groups GROUP BY 1 HAVING count(*) > 1)
    SELECT dup_group, article_id, n_members, n_documents FROM groups JOIN sizes USING (dup_group)""")
def content_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicates(P.groups(spark, sf_dir))


@query(f"{Q.CODES} SELECT doc_id, code FROM codes")
def simhash_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.simhash_codes(P.articles(spark, sf_dir), T.tokens("text")).select(F.col("article_id").alias("doc_id"), "code")


@query(f"""{Q.CODES}, classes AS (SELECT code, min(doc_id) AS rep FROM codes GROUP BY 1)
    SELECT x.rep AS a, y.rep AS b, bit_count(xor(x.code, y.code))::INTEGER AS distance FROM classes x JOIN classes y ON x.rep < y.rep AND bit_count(xor(x.code, y.code)) <= 3
    UNION ALL SELECT rep, doc_id, 0 FROM codes JOIN classes USING (code) WHERE doc_id > rep""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.near_duplicates(audit.simhash_codes(P.articles(spark, sf_dir), T.tokens("text")))


@query(f"""{Q.CODES}, bands AS (SELECT unnest(range(0, 8)) AS band, code FROM codes)
    SELECT band::INTEGER AS band, ((code::HUGEINT + 18446744073709551616) // (1::HUGEINT << (8 * band)::INTEGER) % 256)::BIGINT AS value, count(*) AS n FROM bands GROUP BY 1, 2 HAVING count(*) > 10""")
def crowded_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.crowded_bands(audit.simhash_codes(P.articles(spark, sf_dir), T.tokens("text")), most=10)


_SPLIT = """split AS (SELECT doc_id AS query_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= round_even(count(*) OVER () * 0.2, 0) THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT doc_id FROM documents))"""
_SETS = f"sets AS (SELECT doc_id AS id, split, {Q.grams(Q.TOKENS, 3)} AS g FROM documents JOIN split ON query_id = doc_id)"


def _split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text and split of all documents."""
    rows = P.articles(spark, sf_dir).select(F.col("article_id").alias("query_id"), "text")
    return splitting.with_split(rows, rows.select("query_id"))


@query(f"""WITH {_SPLIT}, {_SETS}, classes AS (SELECT split, list_sort(g) AS g, min(id) AS id FROM sets WHERE len(g) > 0 GROUP BY 1, 2), each AS (SELECT split, id, len(g) AS n, unnest(g) AS s FROM classes),
    p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM each a JOIN each b ON a.s = b.s WHERE a.split = 'train' AND b.split = 'val' GROUP BY 1, 2)
    SELECT id_a, id_b, round(c / (na + nb - c), 4) AS jaccard FROM p WHERE c / (na + nb - c) >= 0.8""")
def near_dup_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of the train split that are alike to those of the validation split, by class representatives."""
    rows = _split_texts(spark, sf_dir)
    return audit.near_queries(rows.where("split = 'train'"), rows.where("split = 'val'"), keep=P.shared)


@query(f"WITH {_SPLIT}, {_SETS} SELECT id AS query_id, min(id) OVER (PARTITION BY list_sort(g)) AS class_id FROM sets WHERE len(g) > 0")
def near_dup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of texts with the same set of n-grams that each document is a member of."""
    return audit.query_classes(P.articles(spark, sf_dir).select(F.col("article_id").alias("query_id"), "text"))


@query(f"""WITH c AS (SELECT doc_id, source, {Q.WORD_COUNT} AS n FROM documents), s AS (SELECT count(*)::DOUBLE AS articles, count(DISTINCT doc_id)::DOUBLE AS article_ids, count(DISTINCT source)::DOUBLE AS documents,
    floor(quantile_cont(n, 0.5))::DOUBLE AS median_words, round(avg(n), 1) AS mean_words, floor(quantile_cont(n, 0.9))::DOUBLE AS p90_words, max(n)::DOUBLE AS max_words,
    round(100 * count(*) FILTER (n > 200) / count(*), 1) AS percent_over_200, round(100 * count(*) FILTER (n > 400) / count(*), 1) AS percent_over_400, (count(*) FILTER (n = 0))::DOUBLE AS empty FROM c)
    SELECT name, value FROM (UNPIVOT s ON COLUMNS(*) INTO NAME name VALUE value)""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.statistics(P.articles(spark, sf_dir))


@query(f"SELECT (least({Q.WORD_COUNT} // 20, 50) * 20)::BIGINT AS bucket, count(*) AS n FROM documents GROUP BY 1")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.length_histogram(P.articles(spark, sf_dir))


@query(r"SELECT doc_id FROM documents WHERE regexp_full_match(CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END, '\s*')")
def empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a body: a first line is their title, and what comes after it is the text."""
    body = F.when(F.contains("text", F.lit("\n")), F.substring_index("text", "\n", 1)).otherwise(F.coalesce("text", F.lit("")))
    rows = P.articles(spark, sf_dir).select("article_id", F.substr(F.coalesce("text", F.lit("")), F.length(body) + 1).alias("text"))
    return audit.empty_articles(rows).select(F.col("article_id").alias("doc_id"))


@query("""SELECT conv_id AS query_id, count(*) AS n_rows, count(DISTINCT text) AS n_texts, min_by(text, turn) AS first_text FROM conversations GROUP BY 1 HAVING count(*) > 1""")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.repeated_ids(P.table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "query_id"), "turn")


@query("SELECT DISTINCT doc_id AS query_id, 'same_id' AS kind FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda name: P.table(spark, sf_dir, name).select(F.col("doc_id").alias("query_id"))
    return audit.same_ids(ids("documents"), ids("labels"))


@query(f"""WITH c AS (SELECT variant, count(*) AS n_articles FROM (SELECT unnest({Q.SYLLABLES}) AS variant FROM documents) GROUP BY 1), f AS (SELECT {Q.fold('variant')} AS folded, * FROM c)
    SELECT folded, variant, n_articles FROM f WHERE folded IN (SELECT folded FROM f GROUP BY 1 HAVING count(*) > 1)""")
def fold_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts that differ in nothing but accents, each taken for an id."""
    return audit.spelling_variants(P.articles(spark, sf_dir).select(F.explode_outer(T.syllables("text")).alias("document")))


@query(f"SELECT item_id AS query_id FROM benchmark WHERE {Q.fold('text')} = coalesce(text, '')")
def unaccented_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.unaccented(P.queries(spark, sf_dir)).select("query_id")


@query(f"""WITH {Q.GOLD}, {_GROUPS}, more AS (SELECT DISTINCT g.query_id, t.article_id FROM gold g JOIN groups s USING (article_id) JOIN groups t USING (dup_group)),
    tr AS (SELECT query_id, list_sort(list(DISTINCT article_id)) AS l FROM gold GROUP BY 1), te AS (SELECT query_id, list_sort(list(DISTINCT article_id)) AS l FROM more GROUP BY 1)
    SELECT query_id, array_to_string(tr.l, ',') AS train_gold, array_to_string(te.l, ',') AS test_gold, tr.l = te.l AS equal FROM tr JOIN te USING (query_id)""")
def conflicting_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold and the gold with copies of its articles, as two splits that share queries."""
    gold = P.gold(spark, sf_dir)
    found = audit.conflicting_gold(gold, metrics.expanded_gold(gold, P.groups(spark, sf_dir)))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("query_id", joined("train_gold"), joined("test_gold"), "equal")


@query(f"""WITH {Q.GOLD}, {_GROUPS} SELECT g.query_id, g.article_id, count(*) AS n_twins, min(t.article_id) AS first_twin FROM gold g JOIN groups s USING (article_id)
    JOIN groups t ON t.dup_group = s.dup_group AND t.article_id <> g.article_id GROUP BY 1, 2""")
def gold_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.gold_twins(P.gold(spark, sf_dir), P.groups(spark, sf_dir))


@query(f"""WITH {Q.GOLD}, {_GROUPS} SELECT DISTINCT g.query_id, t.article_id FROM gold g JOIN groups s USING (article_id) JOIN groups t USING (dup_group)""")
def gold_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.expanded_gold(P.gold(spark, sf_dir), P.groups(spark, sf_dir))


# --- sparse search --------------------------------------------------------------------------------------


@query(f"WITH {Q.index(Q.TOKENS)} SELECT term, df, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM terms, totals")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.whole_index(spark, sf_dir).idf().select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {Q.index(Q.TOKENS)} SELECT n_docs, round(mean_length, 6) AS mean_length, (SELECT count(*) FROM postings) AS n_postings, (SELECT count(*) FROM terms) AS n_terms FROM totals")
def bm25_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = P.whole_index(spark, sf_dir)
    counts = index.terms.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"), F.count("*").alias("n_terms"))
    return index.totals.select("n_docs", F.round("mean_length", 6).alias("mean_length")).join(F.broadcast(counts))


@query(f"WITH {Q.run('word')} SELECT * FROM word WHERE rank <= 10")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each test item."""
    return P.word_run(spark, sf_dir, P.TOP)


@query(f"WITH {Q.run('plain', Q.syllables(Q.fold('text')))} SELECT * FROM plain WHERE rank <= 10")
def bm25_folded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.folded_run(spark, sf_dir, P.TOP)


@query(f"WITH {Q.run('syl', Q.SYLLABLES)} SELECT * FROM syl WHERE rank <= 10")
def bm25_syllable_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.syllable_run(spark, sf_dir, P.TOP)


@query(f"""WITH {Q.GOLD}, {Q.index(Q.TOKENS)}, {Q.query_terms(Q.TOKENS)}, grid AS (SELECT unnest([0.6, 0.9, 1.2, 1.5, 1.8])::DOUBLE AS k1), bs AS (SELECT unnest([0.3, 0.5, 0.75, 0.9])::DOUBLE AS b),
    s AS (SELECT k1, b, query_id, article_id, round(sum(qtf * idf * tf / (tf + k1 * (1 - b + b * dl / mean_length))), 6) AS score FROM matches, grid, bs GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY k1, b, query_id ORDER BY score DESC, article_id) AS rank FROM s),
    h AS (SELECT k1, b, query_id, count(*) AS n FROM r JOIN gold USING (query_id, article_id) WHERE rank <= 10 GROUP BY ALL),
    z AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1)
    SELECT k1, b, round(avg(coalesce(n, 0) / n_gold), 6) AS recall FROM z CROSS JOIN grid CROSS JOIN bs LEFT JOIN h USING (k1, b, query_id) GROUP BY ALL""")
def bm25_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = P.answerable(spark, sf_dir)
    return tuning.bm25(P.index(spark, sf_dir), asked, P.gold(spark, sf_dir))


@query(f"""WITH {Q.run('word')}, tf2 AS (SELECT article_id, query_id, term, tf, idf FROM matches), w AS (SELECT query_id, article_id, term, round(idf * (tf * 2.2) / (tf + 1.2), 4) AS weight FROM tf2 JOIN word USING (query_id, article_id) WHERE rank <= 3)
    SELECT query_id, article_id, term, weight, row_number() OVER (PARTITION BY query_id, article_id ORDER BY weight DESC, term)::INTEGER AS place FROM w""")
def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the three best articles of each query were found."""
    asked, docs = P.queries(spark, sf_dir), P.articles(spark, sf_dir)
    found = sparse.explained(P.word_run(spark, sf_dir, 3), asked, docs, P.index(spark, sf_dir).idf())
    rows = found.select("query_id", "article_id", F.posexplode("terms").alias("at", "t"))
    return rows.select("query_id", "article_id", F.col("t.term").alias("term"), F.col("t.score").alias("weight"), (F.col("at") + 1).alias("place"))


# --- dense search ---------------------------------------------------------------------------------------


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: (x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) ** 2)), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dense.normalized(P.vectors(spark, sf_dir))
    return rows.select(F.col("chunk_id").alias("vec_id"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"), F.round(F.col("vector")[0], 6).alias("first"))


@query(f"WITH {Q.NEAREST} SELECT query_id, chunk_id, article_id, round(score, 6) AS score FROM nearest")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 nearest vectors of each query vector (ids divisible by 50, against all)."""
    return P.nearest(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {Q.NEAREST} {Q.pooled('max')}")
def pool_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.pooled(P.nearest(spark, sf_dir), "max", P.TOP)


@query(f"WITH {Q.NEAREST} {Q.pooled('avg')}")
def pool_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.pooled(P.nearest(spark, sf_dir), "mean", P.TOP)


@query(f"""WITH {Q.NEAREST}, run AS (SELECT query_id, article_id FROM nearest GROUP BY 1, 2), s AS (SELECT r.query_id, r.article_id, v.vec_id AS chunk_id,
    round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM run r JOIN embeddings q ON q.vec_id = r.query_id JOIN embeddings v ON v.label = r.article_id)
    SELECT query_id, article_id, chunk_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id, article_id ORDER BY score DESC, chunk_id) = 1""")
def best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.best_chunks(P.vector_queries(spark, sf_dir), P.vectors(spark, sf_dir), dense.pooled(P.nearest(spark, sf_dir), "max"))


@query()
def encode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the documents by the stand-in encoder, through the encoder interface."""
    return dense.encoded(P.articles(spark, sf_dir).select("article_id", "text"), dense.hashing_encoder()).select("article_id", "vector")


# --- fusion -----------------------------------------------------------------------------------------------

_BOTH = f"{Q.run('word')}, {Q.run('plain', Q.syllables(Q.fold('text')), 'p_')}"
_DEPTHS = "a AS (SELECT * FROM word WHERE rank <= 100), c AS (SELECT * FROM plain WHERE rank <= 100)"
_SCALED = """sa AS (SELECT query_id, article_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM a WINDOW w AS (PARTITION BY query_id)),
    sc AS (SELECT query_id, article_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS y FROM c WINDOW w AS (PARTITION BY query_id)),
    fused AS (SELECT query_id, article_id, coalesce(x, 0)::DOUBLE AS x, coalesce(y, 0)::DOUBLE AS y FROM sa FULL JOIN sc USING (query_id, article_id))"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id)::INTEGER AS rank"


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return P.word_run(spark, sf_dir), P.folded_run(spark, sf_dir)


@query(f"WITH {_BOTH}, {_DEPTHS}, {_SCALED} SELECT query_id, article_id, round(x, 6) AS score, rank FROM sa JOIN a USING (query_id, article_id)")
def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.scaled(P.word_run(spark, sf_dir)).withColumn("score", F.round("score", 6)).select("query_id", "article_id", "score", "rank")


@query(f"WITH {_BOTH}, {_DEPTHS}, {_SCALED}, s AS (SELECT query_id, article_id, round(0.25 * x + 0.75 * y, 6) AS score FROM fused), r AS (SELECT *, {_RANK} FROM s) SELECT * FROM r WHERE rank <= 10")
def fuse_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.weighted(*_pair(spark, sf_dir), 0.75, P.TOP)


_RRF = "u AS (SELECT query_id, article_id, rank FROM a UNION ALL SELECT query_id, article_id, rank FROM c)"


@query(f"WITH {_BOTH}, {_DEPTHS}, {_RRF}, s AS (SELECT query_id, article_id, round(sum(1 / (10 + rank)), 6) AS score FROM u GROUP BY 1, 2), r AS (SELECT *, {_RANK} FROM s) SELECT * FROM r WHERE rank <= 10")
def fuse_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal(_pair(spark, sf_dir), 10, P.TOP)


_ALPHAS = "alphas AS (SELECT unnest([" + ", ".join(map(str, tuning.ALPHAS)) + "])::DOUBLE AS alpha)"
_RECALL = "z AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1)"
_ALPHA_SWEEP = f"""{Q.GOLD}, {_BOTH}, {_DEPTHS}, {_SCALED}, {_ALPHAS}, {_RECALL}, s AS (SELECT alpha, query_id, article_id, round((1 - alpha) * x + alpha * y, 6) AS score FROM fused, alphas),
    r AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, article_id) AS rank FROM s), h AS (SELECT alpha, query_id, count(*) AS n FROM r JOIN gold USING (query_id, article_id) WHERE rank <= 10 GROUP BY ALL),
    sweep AS (SELECT alpha, round(avg(coalesce(n, 0) / n_gold), 6) AS recall FROM z CROSS JOIN alphas LEFT JOIN h USING (alpha, query_id) GROUP BY 1)"""


def _alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.alphas(*_pair(spark, sf_dir), P.gold(spark, sf_dir), P.answerable(spark, sf_dir))


@query(f"WITH {_ALPHA_SWEEP} SELECT * FROM sweep")
def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alphas(spark, sf_dir)


@query(f"WITH {_ALPHA_SWEEP} SELECT alpha, recall, alpha IN (0, 1) AS at_end FROM sweep ORDER BY recall DESC, abs(alpha - 0.5), alpha LIMIT 1")
def select_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alpha that tuning chooses (a report of one row)."""
    return tuning.best_alpha(_alphas(spark, sf_dir))


@query(f"""WITH {Q.GOLD}, {_BOTH}, {_DEPTHS}, {_RRF}, {_RECALL}, ks AS (SELECT unnest([10, 20, 60, 100])::INTEGER AS constant), s AS (SELECT constant, query_id, article_id, round(sum(1 / (constant + rank)), 6) AS score FROM u, ks GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY constant, query_id ORDER BY score DESC, article_id) AS rank FROM s), h AS (SELECT constant, query_id, count(*) AS n FROM r JOIN gold USING (query_id, article_id) WHERE rank <= 10 GROUP BY ALL)
    SELECT constant, round(avg(coalesce(n, 0) / n_gold), 6) AS recall FROM z CROSS JOIN ks LEFT JOIN h USING (constant, query_id) GROUP BY 1""")
def rrf_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.constants(_pair(spark, sf_dir), P.gold(spark, sf_dir), P.answerable(spark, sf_dir))


@query(f"""WITH {Q.NEAREST}, m AS (SELECT query_id, article_id, max(score) AS mx, avg(score) AS mn FROM nearest GROUP BY 1, 2), both_ways AS (SELECT query_id, article_id, 'max' AS pooling, round(mx, 6) AS score FROM m UNION ALL SELECT query_id, article_id, 'mean', round(mn, 6) FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY pooling, query_id ORDER BY score DESC, article_id) AS rank FROM both_ways), g AS (SELECT vec_id AS query_id, label::BIGINT AS article_id FROM embeddings WHERE vec_id % 50 = 0)
    SELECT pooling, round(avg(CASE WHEN r.rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM g JOIN r USING (query_id, article_id) GROUP BY 1""")
def pooling_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 1 of the own label for both ways of pooling."""
    hits = P.nearest(spark, sf_dir)
    gold = P.vectors(spark, sf_dir).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "article_id")
    runs = dense.pooled(hits, "max").withColumn("pooling", F.lit("max")).union(dense.pooled(hits, "mean").withColumn("pooling", F.lit("mean")))
    return metrics.recall_at(runs, gold, gold, 1, ("pooling",))


_OWN = "g AS (SELECT vec_id AS query_id, label::BIGINT AS article_id FROM embeddings WHERE vec_id % 50 = 0)"


@query(f"""WITH {Q.NEAREST}, m AS (SELECT query_id, article_id, max(score) AS mx, avg(score) AS mn FROM nearest GROUP BY 1, 2), both_ways AS (SELECT query_id, article_id, 'max' AS pooling, round(mx, 6) AS score FROM m UNION ALL SELECT query_id, article_id, 'mean', round(mn, 6) FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY pooling, query_id ORDER BY score DESC, article_id) AS rank FROM both_ways), {_OWN}
    SELECT pooling FROM g JOIN r USING (query_id, article_id) GROUP BY 1 ORDER BY round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) DESC, pooling LIMIT 1""")
def chosen_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better way of pooling, looked up in the sweep (a report of one row)."""
    return tuning.pooling_of(pooling_sweep(spark, sf_dir).withColumn("model", F.lit("vectors")), "vectors")


@query(f"""WITH {_BOTH}, f AS (SELECT query_id, rank, article_id AS folded FROM plain WHERE rank <= 3)
    SELECT query_id, rank, article_id AS bm25, folded FROM (SELECT * FROM word WHERE rank <= 3) FULL JOIN f USING (query_id, rank)""")
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best articles of two systems."""
    a, b = _pair(spark, sf_dir)
    return tuning.side_by_side({"bm25": a, "folded": b})


# --- metrics ------------------------------------------------------------------------------------------------


@query(f"WITH {Q.GOLD} SELECT item_id AS query_id, text FROM benchmark WHERE item_id IN (SELECT query_id FROM gold)")
def guarded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries that have gold and results, through the guards that fail where one has not."""
    asked = P.answerable(spark, sf_dir)
    return metrics.require_results(metrics.require_gold(asked, P.gold(spark, sf_dir)), P.word_run(spark, sf_dir)).select("query_id", "text")


@query("SELECT doc_id AS query_id, text FROM documents")
def one_text_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, through the guard that fails where an id has two texts."""
    return audit.require_one_text(P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text")).select("query_id", "text")


@query(f"WITH {Q.GOLD}, {Q.run('word')}, {Q.measures('word')} SELECT query_id, n_gold, {Q.rounded(6)} FROM measured")
def metrics_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = metrics.per_query(P.word_run(spark, sf_dir), P.gold(spark, sf_dir), P.answerable(spark, sf_dir))
    return each.select("query_id", "n_gold", *(F.round(c, 6).alias(c) for c in each.columns[2:]))


@query(f"WITH {Q.GOLD}, {Q.run('word')}, {Q.measures('word')}, m AS (SELECT {Q.averaged(4)} FROM measured) SELECT measure, value FROM (UNPIVOT m ON COLUMNS(*) INTO NAME measure VALUE value)")
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluated(P.word_run(spark, sf_dir), P.gold(spark, sf_dir), P.answerable(spark, sf_dir))


_HITS = f"""{Q.GOLD}, {_BOTH}, {_DEPTHS}, {_SCALED}, fw AS (SELECT query_id, article_id, round(0.25 * x + 0.75 * y, 6) AS score FROM fused), f AS (SELECT *, {_RANK} FROM fw), qs AS (SELECT DISTINCT query_id FROM gold),
    m AS (SELECT query_id, (query_id IN (SELECT query_id FROM word JOIN gold USING (query_id, article_id) WHERE rank <= 10))::INTEGER AS bm25, (query_id IN (SELECT query_id FROM plain JOIN gold USING (query_id, article_id) WHERE rank <= 10))::INTEGER AS folded,
    (query_id IN (SELECT query_id FROM f JOIN gold USING (query_id, article_id) WHERE rank <= 10))::INTEGER AS fused FROM qs)"""


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _pair(spark, sf_dir)
    return metrics.hit_matrix({"bm25": a, "folded": b, "fused": fusion.weighted(a, b, 0.75)}, P.gold(spark, sf_dir), P.answerable(spark, sf_dir))


@query(f"WITH {_HITS} SELECT * FROM m")
def hit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir)


@query(f"""WITH {_HITS}, t AS (SELECT count(*) FILTER (bm25 = 1 AND folded = 1) AS both, count(*) FILTER (bm25 = 1 AND folded = 0) AS a_only, count(*) FILTER (bm25 = 0 AND folded = 1) AS b_only, count(*) FILTER (bm25 = 0 AND folded = 0) AS neither FROM m)
    SELECT outcome, n, round(100 * n / (SELECT count(*) FROM m), 2) AS percent FROM (UNPIVOT t ON COLUMNS(*) INTO NAME outcome VALUE n)""")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.contingency(_matrix(spark, sf_dir), "bm25", "folded")


@query(f"""WITH {_HITS}, t AS (SELECT round(avg(bm25), 4) AS bm25, round(avg(folded), 4) AS folded, round(avg(fused), 4) AS fused, round(avg(greatest(bm25, folded)), 4) AS either FROM m)
    SELECT system, share FROM (UNPIVOT t ON COLUMNS(*) INTO NAME system VALUE share)""")
def fusion_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ceiling(_matrix(spark, sf_dir), "bm25", "folded", "fused")


@query(f"WITH {Q.GOLD}, {Q.run('word')}, qs AS (SELECT item_id AS query_id FROM benchmark) SELECT query_id, (SELECT min(rank) FROM word w JOIN gold g USING (query_id, article_id) WHERE w.query_id = qs.query_id AND rank <= 100)::INTEGER AS gold_rank FROM qs")
def rank_of_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gold_rank(P.word_run(spark, sf_dir), P.gold(spark, sf_dir), P.queries(spark, sf_dir))


@query(f"""WITH {Q.GOLD}, {_GROUPS}, more AS (SELECT DISTINCT g.query_id, t.article_id FROM gold g JOIN groups s USING (article_id) JOIN groups t USING (dup_group)), {Q.run('word')},
    one AS (SELECT query_id, (SELECT count(*) FROM word w JOIN gold g USING (query_id, article_id) WHERE w.query_id = q.query_id AND rank <= 10) / count(*) AS r FROM gold q GROUP BY 1),
    two AS (SELECT query_id, (SELECT count(*) FROM word w JOIN more g USING (query_id, article_id) WHERE w.query_id = q.query_id AND rank <= 10) / count(*) AS r FROM more q GROUP BY 1)
    SELECT 'gold' AS kind, round(avg(r), 6) AS recall FROM one UNION ALL SELECT 'expanded', round(avg(r), 6) FROM two""")
def gold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, asked, run = P.gold(spark, sf_dir), P.answerable(spark, sf_dir), P.word_run(spark, sf_dir)
    more = metrics.expanded_gold(gold, P.groups(spark, sf_dir))
    one = metrics.recall_at(run, gold, asked).select(F.lit("gold").alias("kind"), "recall")
    return one.union(metrics.recall_at(run, more, asked).select(F.lit("expanded"), "recall"))


# --- splits and training rows -------------------------------------------------------------------------------


@query(f"WITH {_SPLIT} SELECT * FROM split")
def split_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_queries(P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id")))


@query(f"WITH {_SPLIT} SELECT split, count(DISTINCT query_id) AS n_queries, count(*) AS n_pairs, round(count(*) / count(DISTINCT query_id), 3) AS mean_gold FROM split JOIN labels ON doc_id = query_id GROUP BY 1")
def split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in the two parts of the split."""
    labels = P.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"))
    return audit.split_distribution(split_queries(spark, sf_dir).join(labels, "query_id"))


@query(f"""WITH {_SPLIT}, test AS (SELECT labels.*, split FROM labels LEFT JOIN split ON query_id = doc_id)
    SELECT doc_id AS query_id, quality AS score, CASE WHEN split = 'val' THEN 'test' ELSE 'train' END AS split FROM test""")
def remove_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels for training and those of the validation split for tests: what the test part has is dropped from the train part."""
    rows = P.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.col("quality").alias("score"))
    test = rows.join(split_queries(spark, sf_dir).where("split = 'val'").select("query_id"), "query_id", "left_semi")
    return audit.require_disjoint(splitting.without_overlap(rows, test))


@query(f"WITH {_SPLIT}, every AS (SELECT * FROM split UNION ALL SELECT doc_id, 'test' FROM labels) SELECT x.split AS a, y.split AS b, (SELECT count(DISTINCT p.query_id) FROM every p JOIN every q USING (query_id) WHERE p.split = x.split AND q.split = y.split) AS n_common FROM (SELECT DISTINCT split FROM every) x JOIN (SELECT DISTINCT split FROM every) y ON x.split < y.split")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = P.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.lit("test").alias("split"))
    return audit.leaks(split_queries(spark, sf_dir).union(test))


@query(f"""WITH {Q.GOLD}, {_GROUPS}, {Q.index(Q.TOKENS)}, {Q.query_terms(Q.TOKENS)}, s AS (SELECT query_id, article_id, round(sum(idf * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean_length))), 6) AS score FROM matches GROUP BY 1, 2),
    top AS (SELECT *, {_RANK} FROM s), known AS (SELECT DISTINCT query_id, dup_group FROM gold JOIN groups USING (article_id)),
    rest AS (SELECT query_id, article_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM top JOIN groups USING (article_id) ANTI JOIN known USING (query_id, dup_group) WHERE rank <= 20)
    SELECT query_id, max(article_id) FILTER (n = 1) AS negative_1, max(article_id) FILTER (n = 2) AS negative_2, max(article_id) FILTER (n = 3) AS negative_3, max(article_id) FILTER (n = 4) AS negative_4 FROM rest WHERE n <= 4 GROUP BY 1 HAVING count(*) = 4""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.hard_negatives(P.queries(spark, sf_dir), P.gold(spark, sf_dir), P.groups(spark, sf_dir), index=P.index(spark, sf_dir))


@query(f"""WITH RECURSIVE {Q.GOLD}, {Q.CHUNKS}, one AS (SELECT query_id, min(article_id) AS article_id FROM gold GROUP BY 1), asked AS (SELECT item_id AS query_id, list_distinct({Q.TOKENS}) AS q FROM benchmark),
    o AS (SELECT query_id, article_id, chunk_no, len(list_intersect(q, {Q.TOKENS}))::BIGINT AS overlap FROM one JOIN asked USING (query_id) JOIN chunks USING (article_id))
    SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, chunk_no) = 1""")
def positive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = P.gold(spark, sf_dir)
    first = gold.groupBy("query_id").agg(F.min("article_id").alias("article_id")).select("article_id").distinct()  # one a query at most
    docs = P.articles(spark, sf_dir).withColumn("title", F.col("document")).join(F.broadcast(first), "article_id", "left_semi")
    return splitting.positives(gold, P.queries(spark, sf_dir), chunking.chunks(docs), T.tokens("text"), T.tokens("text"))


# --- language model -----------------------------------------------------------------------------------------

_LM = f"""s AS (SELECT doc_id, {Q.SYLLABLES} AS s FROM documents), words AS (SELECT w, count(*) AS c FROM (SELECT unnest(s) AS w FROM s) GROUP BY 1),
    pairs AS (SELECT w1, w2, count(*) AS c FROM (SELECT unnest(list_slice(s, 1, len(s) - 1)) AS w1, unnest(list_slice(s, 2, len(s))) AS w2 FROM s WHERE len(s) > 1) GROUP BY 1, 2), totals AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM words)"""


def _model(spark: SparkSession, sf_dir: str) -> restoring.Model:
    """Learned from all documents."""
    return restoring.train(P.articles(spark, sf_dir))


@query(f"WITH {_LM} SELECT w, c FROM words")
def lm_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).words


@query(f"WITH {_LM} SELECT w1, w2, c FROM pairs")
def lm_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).pairs


@query(f"""WITH {_LM}, f AS (SELECT {Q.fold('w')} AS plain, list_sort(list(w)) AS forms FROM words GROUP BY 1)
    SELECT w, CASE WHEN {Q.fold('w')} <> w THEN w ELSE coalesce(array_to_string(forms, ' '), w) END AS candidates FROM words LEFT JOIN f ON f.plain = w""")
def lm_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _model(spark, sf_dir)
    return restoring.candidates(model.words.select("w"), model).select("w", F.array_join("candidates", " ").alias("candidates"))


@query(f"""WITH {_LM} SELECT w1, w2, round(0.9 * p.c / a.c + 0.1 * (b.c + 1) / (n + v), 9) AS p, round(ln(0.9 * p.c / a.c + 0.1 * (b.c + 1) / (n + v)), 6) AS log_p
    FROM pairs p JOIN words a ON a.w = w1 JOIN words b ON b.w = w2, totals""")
def lm_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restoring.pair_chances(_model(spark, sf_dir)).select("w1", "w2", F.round("p", 9).alias("p"), F.round("log_p", 6).alias("log_p"))


@query()
def restore_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded queries, restored."""
    asked = P.queries(spark, sf_dir).select("query_id", T.folded("text").alias("text"))
    return restoring.restored(asked, P.model(spark, sf_dir)).select("query_id", "text", "restored")


@query()
def restore_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on folded, half-folded and unchanged queries, before and after."""
    asked = P.queries(spark, sf_dir)
    forms = [("folded", T.folded("text")), ("half", T.half_stripped("text", F.col("query_id"))), ("accented", F.col("text"))]
    rows = None
    for name, form in forms:
        part = asked.select(F.lit(name).alias("form"), F.col("text").alias("truth"), form.alias("text"))
        rows = part if rows is None else rows.union(part)
    found = restoring.restored(rows, P.model(spark, sf_dir))
    before = restoring.accuracy(found, "truth", "text", ("form",)).select("form", F.col("accuracy").alias("before"))
    return restoring.accuracy(found, "truth", "restored", ("form",)).join(before, "form")


@query()
def lambda_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restoring.swept(P.queries(spark, sf_dir), P.model(spark, sf_dir))


# --- comparison and errors ----------------------------------------------------------------------------------

_SYSTEMS = ("bm25", "folded", "weighted", "rrf")


@query(f"""WITH {Q.GOLD}, {_BOTH}, {_DEPTHS}, {_SCALED}, {_RRF}, fw AS (SELECT query_id, article_id, round(0.25 * x + 0.75 * y, 6) AS score FROM fused), f AS (SELECT *, {_RANK} FROM fw),
    rw AS (SELECT query_id, article_id, round(sum(1 / (10 + rank)), 6) AS score FROM u GROUP BY 1, 2), rr AS (SELECT *, {_RANK} FROM rw),
    {Q.measures('a', 'm1')}, {Q.measures('c', 'm2')}, {Q.measures('f', 'm3')}, {Q.measures('rr', 'm4')}
    {' UNION ALL '.join(f"SELECT {Q.averaged(4, ('recall_1', 'recall_5', 'recall_10', 'recall_20', 'mrr_10', 'ndcg_10', 'f2_10'))}, '{s}' AS system FROM m{k}" for k, s in enumerate(_SYSTEMS, 1))}""")
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _pair(spark, sf_dir)
    runs = {"bm25": a, "folded": b, "weighted": fusion.weighted(a, b, 0.75), "rrf": fusion.reciprocal([a, b], 10)}
    return tuning.comparison(runs, P.gold(spark, sf_dir), P.answerable(spark, sf_dir))


@query(f"""WITH {Q.GOLD}, {_BOTH}, {Q.measures('word', 'm1')}, {Q.measures('plain', 'm2')}, t AS (SELECT 'bm25' AS system, round(avg(recall_1), 6) AS recall, false AS contaminated FROM m1 UNION ALL SELECT 'folded', round(avg(recall_1), 6), true FROM m2)
    SELECT system, recall, contaminated, NOT contaminated AS chosen FROM t""")
def clean_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best system that is not contaminated, beside the best of the others; the folded index stands for one of these."""
    gold, asked = P.gold(spark, sf_dir), P.answerable(spark, sf_dir)
    runs = zip(("bm25", "folded"), _pair(spark, sf_dir), (False, True), strict=True)
    one, two = (metrics.recall_at(run, gold, asked, 1).select(F.lit(name).alias("system"), "recall", F.lit(bad).alias("contaminated")) for name, run, bad in runs)
    return tuning.select_clean(one.union(two))


@query(f"""WITH {Q.GOLD}, {Q.run('word')}, {Q.run('syl', Q.SYLLABLES, 's_')}, {Q.run('plain', Q.syllables(Q.fold('text')), 'p_')}, {Q.measures('word', 'm1')}, {Q.measures('syl', 'm2')}, {Q.measures('plain', 'm3')}
    SELECT 'tokens' AS tokenisation, round(avg(recall_10), 4) AS recall_10 FROM m1 UNION ALL SELECT 'syllables', round(avg(recall_10), 4) FROM m2 UNION ALL SELECT 'folded', round(avg(recall_10), 4) FROM m3""")
def tokenisation_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, asked = P.gold(spark, sf_dir), P.answerable(spark, sf_dir)
    rows = None
    for name, run in (("tokens", P.word_run), ("syllables", P.syllable_run), ("folded", P.folded_run)):
        row = metrics.recall_at(run(spark, sf_dir), gold, asked).select(F.lit(name).alias("tokenisation"), F.round("recall", 4).alias("recall_10"))
        rows = row if rows is None else rows.union(row)
    return rows


@query()
def robustness_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """form of the query x treatment x system, recall at 10: 18 rows, from one restoration and one search of each kind.

    The forms and treatments of a query are queries of one set, with ids "<form>|<treatment>|<query_id>".
    """
    asked, gold = P.answerable(spark, sf_dir), P.gold(spark, sf_dir)
    forms = {"accented": F.col("text"), "half": T.half_stripped("text", F.col("query_id")), "folded": T.folded("text")}
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("form"), text.alias("text")) for name, text in forms.items())))
    changed = asked.select("query_id", each.alias("x")).select("query_id", "x.form", "x.text")
    fixed = restoring.restored(changed, P.model(spark, sf_dir))
    named = lambda rows, treatment, text: rows.select(F.concat_ws("|", "form", F.lit(treatment), "query_id").alias("query_id"), F.col(text).alias("text"))
    every = P.shared(named(changed, "none", "text").union(named(fixed, "restored", "restored")))
    plain, folded = T.folded_syllables("text"), named(changed.where("form = 'folded'"), "folded_index", "text")
    vectors = P.shared(dense.encode_queries(every.union(folded), dense.hashing_encoder()))
    runs = {"bm25": sparse.search_index(P.index_for(spark, sf_dir, every), every, P.DEPTH, P.K1, P.B), "dense": dense.search(vectors, P.chunk_vectors(spark, sf_dir), P.DEPTH)}
    runs = {name: P.shared(run) for name, run in runs.items()}
    alone = P.shared(sparse.search_index(P.index(spark, sf_dir, "folded"), folded, P.DEPTH, P.K1, P.B, plain))
    runs["fused"] = fusion.weighted(runs["bm25"], runs["dense"].where("query_id NOT LIKE '%|folded_index|%'"), 0.75, P.TOP)
    runs["bm25_folded"], runs["fused_folded"] = alone, fusion.weighted(alone, runs["dense"].where("query_id LIKE '%|folded_index|%'"), 0.75, P.TOP)
    rows = None
    for system, run in runs.items():
        part = run.where(F.col("rank") <= P.TOP).select(F.split("query_id", "[|]").alias("p"), "article_id", "rank")
        part = part.select(F.lit(system).alias("system"), F.col("p")[0].alias("form"), F.col("p")[1].alias("treatment"), F.col("p")[2].cast("long").alias("query_id"), "article_id", "rank")
        rows = part if rows is None else rows.union(part)
    found = metrics.recall_at(rows, gold, asked, P.TOP, ("system", "form", "treatment"))
    listed = "(treatment <> 'folded_index' OR system LIKE '%_folded') AND NOT (form = 'accented' AND treatment = 'restored' AND system <> 'fused')"
    return found.where(listed)


@query()
def restore_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that restoration gets wholly right or not, and hits lost and gained by searching with the restored form."""
    asked, gold = P.answerable(spark, sf_dir), P.gold(spark, sf_dir)
    fixed = P.shared(restoring.restored(asked.select("query_id", F.col("text").alias("truth"), T.folded("text").alias("text")), P.model(spark, sf_dir)))
    used = fixed.select("query_id", F.col("restored").alias("text"))
    after = sparse.search_index(P.index_for(spark, sf_dir, used), used, P.TOP, P.K1, P.B)
    hits = metrics.hit_matrix({"before": P.word_run(spark, sf_dir, P.TOP), "after": after}, gold, asked)
    rows = hits.join(fixed.select("query_id", (F.col("restored") == F.col("truth")).alias("complete")), "query_id")
    return restoring.effect(rows.select("complete", (F.col("before") == 1).alias("before"), (F.col("after") == 1).alias("after")))


@query(f"""WITH {Q.GOLD}, {Q.run('word')}, one AS (SELECT query_id, max(article_id) AS gold_id FROM gold GROUP BY 1), hit AS (SELECT query_id FROM word JOIN one USING (query_id) WHERE rank <= 1 AND article_id = gold_id),
    tops AS (SELECT query_id, max(source) FILTER (rank = 1) AS top_1, max(source) FILTER (rank = 2) AS top_2, max(source) FILTER (rank = 3) AS top_3 FROM word JOIN documents ON doc_id = article_id WHERE rank <= 3 GROUP BY 1)
    SELECT item_id AS query_id, text, gold_id, top_1, top_2, top_3 FROM benchmark JOIN one ON query_id = item_id LEFT JOIN tops USING (query_id) WHERE item_id NOT IN (SELECT query_id FROM hit)""")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose first result is not the last article that contains them, with the sources of the three best."""
    titles = P.articles(spark, sf_dir).select("article_id", F.col("document").alias("title"))
    last = P.gold(spark, sf_dir).groupBy("query_id").agg(F.max("article_id").alias("article_id"))
    return errors.failures(P.word_run(spark, sf_dir), last, P.queries(spark, sf_dir), titles, k=1)


@query("""WITH c AS (SELECT CASE WHEN quality = 0 THEN 'junk' WHEN toxic = 1 THEN 'toxic' WHEN quality IS NOT NULL THEN 'fine' END AS cause FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT cause, count(*) AS n FROM c WHERE cause IS NOT NULL GROUP BY 1)
    SELECT cause, n, round(100 * n / sum(n) OVER (), 1) AS percent FROM n""")
def taxonomy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causes that labels give to documents; documents without label are left out."""
    labels = P.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.expr("CASE WHEN quality = 0 THEN 'junk' WHEN toxic = 1 THEN 'toxic' ELSE 'fine' END").alias("cause"))
    return errors.causes(errors.labelled(P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id")), labels))


@query("SELECT count(*) FILTER (l.doc_id IS NULL) AS unlabelled FROM documents LEFT JOIN labels l USING (doc_id)")
def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = P.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.lit("x").alias("cause"))
    return errors.unlabelled(errors.labelled(P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id")), labels))


@query("SELECT doc_id AS query_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 8")
def stratum_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight documents of each language (a report)."""
    return errors.examples(P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "lang"), "lang")


@query("SELECT label::INTEGER AS label, count(*) AS n FROM embeddings WHERE label <> 3 GROUP BY 1 UNION ALL SELECT 3, 0")
def upsert_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of counts in which one row is replaced."""
    counts = P.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return tables.upserted(counts, spark.createDataFrame([(3, 0)], "label int, n long"), ["label"])


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant with all its parts: restored once, searched by words and by vectors, fused."""
    asked, docs = P.queries(spark, sf_dir), P.articles(spark, sf_dir)
    fixed = P.shared(restoring.restored(asked, P.model(spark, sf_dir)).select("query_id", "text", "restored"))
    used = fixed.select("query_id", F.col("restored").alias("text"))
    return assistant.answers(asked, docs, P.index_for(spark, sf_dir, used), fixed, P.chunk_vectors(spark, sf_dir), dense.encode_queries(used, dense.hashing_encoder()))


@query()
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("query_id", "is_restored", "rank", "article_id", "score", "snippet", T.listed(F.col("terms")).alias("terms"), "n_terms")


@query()
def lookup_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assistant.rendered(_answers(spark, sf_dir), P.queries(spark, sf_dir))


@query(f"""WITH {Q.run('word')}, hit AS (SELECT query_id, rank, article_id, score FROM word WHERE rank <= 3), tw AS (SELECT query_id, article_id, term, round(idf * (tf * 2.2) / (tf + 1.2), 4) AS weight FROM matches),
    w AS (SELECT query_id, article_id, count(*) AS n_terms, arg_min(term, (-weight, term)) AS first_term FROM tw GROUP BY 1, 2)
    SELECT query_id, rank, article_id, score, n_terms, first_term, CASE WHEN length(text) <= 600 THEN coalesce(text, '') WHEN contains(left(text, 600), ' ')
    THEN regexp_replace(left(text, 600), ' [^ ]*$', '') || ' ...' ELSE left(text, 600) || ' ...' END AS snippet FROM hit JOIN w USING (query_id, article_id) JOIN documents ON doc_id = article_id""")
def lookup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant by words alone, on questions as they are."""
    asked, docs = P.queries(spark, sf_dir), P.articles(spark, sf_dir)
    found = assistant.answers(asked, docs, P.index(spark, sf_dir))
    return found.select("query_id", "rank", "article_id", "score", "n_terms", F.col("terms")[0]["term"].alias("first_term"), "snippet")
