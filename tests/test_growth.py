"""What makes queries grow no faster than their input: a task hands on few rows, and no text or posting is shuffled."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.operators import audit, dense, metrics, ranking, restoring, sparse, splitting, tuning


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(n, words, seed=5):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for k in range(n)]


def test_rounding_is_sparks(spark):
    rng = np.random.default_rng(1)
    values = [*rng.normal(size=400).tolist(), *(k / 2e6 for k in range(-41, 42)), 1.0000005, 2.5e-7, -1e-9, 0.0]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, x double").select("k", F.round("x", 6).alias("r")).orderBy("k").collect()
    assert [r.r for r in rows] == ranking.half_up(np.array(values)).tolist()


def test_best_keeps_k_rows_of_a_group_whatever_ties(monkeypatch):
    monkeypatch.setattr(ranking.Best, "WAITING", 0)
    rng = np.random.default_rng(2)
    scores = np.round(rng.random((3, 500)), 1)
    scores[2] = 0.5
    scores[rng.random((3, 500)) < 0.2] = -np.inf
    ids = rng.permutation(500)
    best = ranking.Best(3, 4)
    for at in range(0, 500, 60):
        best.add(scores[:, at : at + 60], {"article_id": pa.array(ids[at : at + 60])})
    got = {g: [] for g in range(3)}
    for batch in best.batches(["g", "article_id", "score"]):
        for r in batch.to_pylist():
            got[r["g"]].append((-r["score"], r["article_id"]))
    for g in range(3):
        want = sorted((-s, int(i)) for s, i in zip(scores[g].tolist(), ids, strict=True) if s > -np.inf)[:4]
        assert sorted(got[g]) == want


def test_search_shuffles_the_best_rows_alone(spark):
    docs = spark.createDataFrame(texts(300, ["the", "of", "a1", "b2", "c3"]), "article_id long, text string").repartition(3)
    asked = spark.createDataFrame([(0, "the a1 a1"), (1, "of b2"), (2, "zebra")], "query_id long, text string")
    index = sparse.build(docs, only=sparse.query_terms(asked))
    best = sparse.scores(index, sparse.query_terms(asked), k=5)
    assert "SortMergeJoin" not in plan(best) and "ShuffledHashJoin" not in plan(best)
    assert best.count() <= 2 * 5 * index.lists.rdd.getNumPartitions()
    every = ranking.ranked(sparse.scores(index, sparse.query_terms(asked)))
    assert sorted(sparse.search(asked, docs, 5).collect()) == sorted(every.where("rank <= 5").collect())
    assert sparse.search(asked, docs, 1000).count() == every.count() > 300
    whole = sparse.build(docs)
    assert sorted(sparse.search_index(whole, asked, 5).collect()) == sorted(sparse.search(asked, docs, 5).collect())


def test_queries_in_blocks_and_slices(spark, monkeypatch):
    docs = spark.createDataFrame(texts(80, list("abcdefgh")), "article_id long, text string")
    asked = spark.createDataFrame([(f"q{k}", t) for k, t in texts(9, list("abcdefgh"), 7)], "query_id string, text string")
    index, terms = sparse.build(docs), sparse.query_terms(asked)
    want = sorted(sparse.scores(index, terms).collect())
    one = list(sparse.blocks(terms, 4))
    assert [len(names) for names, _ in one] == [4, 4, 1] and sorted(n for names, _ in one for n in names) == [f"q{k}" for k in range(9)]
    block = sparse.blocks
    monkeypatch.setattr(sparse, "blocks", lambda terms: block(terms, 4))
    assert sorted(sparse.scores(index, terms).collect()) == want
    lists = pa.array([list("aab"), [], None, list("ca")], pa.list_(pa.string()))
    monkeypatch.setattr(sparse, "PAIRS", 3)
    part = sparse.Asked(["a", "a", "b"], np.array([0, 1, 1]), np.ones(3))
    assert [x[:2] for x in part.met(lists, 1)] == [(0, 1), (1, 4)]
    assert sum(len(x[5]) for x in part.met(lists, 1)) == 5 + 2


def test_grid_recall_equals_that_of_runs(spark):
    docs = spark.createDataFrame(texts(120, list("abcdefgh")), "article_id long, text string")
    asked = spark.createDataFrame(texts(6, list("abcdefgh"), 9), "query_id long, text string")
    gold = spark.createDataFrame([(q, d) for q in range(5) for d in (q, q + 40)], "query_id long, article_id long")
    index = sparse.build(docs)
    got = {(r.k1, r.b): r.recall for r in tuning.bm25(index, asked, gold, (0.6, 1.5), (0.3, 0.9), 10).collect()}
    for (k1, b), recall in got.items():
        assert recall == metrics.recall_at(sparse.search_index(index, asked, 10, k1, b), gold, asked.where("query_id < 5")).first().recall
    assert len(got) == 4


def test_containing_equals_brute_force(spark):
    rows = [(1, "the cat concatenates"), (2, "Cat of the day"), (3, ""), (4, None), (5, "xx yy zz"), (6, "axx yyb"), (7, "a. b! c"), (8, "the cat")]
    asked = [(0, "cat"), (1, "xx yy"), (2, ""), (3, None), (4, "a. b! c"), (5, "e cat"), (6, "the cat"), (7, "the cat"), (8, "?")]
    got = sparse.containing(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(rows, "article_id long, text string"))
    assert "SortMergeJoin" not in plan(got)
    assert sorted(tuple(r) for r in got.collect()) == sorted((q, d) for q, t in asked for d, x in rows if t is not None and x is not None and t in x)


def test_a_model_for_stated_texts_restores_them_alike(spark):
    corpus = ["luật giao thông đường bộ", "luật giáo dục", "Bộ luật lao động", "người lao động", "giao thông và lao động", "", None]
    rows = spark.createDataFrame([(t,) for t in corpus], "text string")
    asked = spark.createDataFrame([(0, "luat giao thong"), (1, "Bộ LUAT lao dong"), (2, "zebra 7"), (3, None)], "k int, text string")
    whole, some = restoring.train(rows), restoring.train(rows, only=asked)
    assert some.totals.first() == whole.totals.first()
    assert sorted(restoring.restored(asked, some).collect()) == sorted(restoring.restored(asked, whole).collect())
    plains = {"luat", "giao", "thong", "bo", "lao", "dong", "zebra", "7"}
    assert {(r.plain, r.w, r.c) for r in some.spellings.collect()} == {(r.plain, r.w, r.c) for r in whole.spellings.collect() if r.plain in plains}
    want = Counter((a, b) for t in corpus for w in [(t or "").lower().split()] for a, b in zip(w, w[1:], strict=False))
    beside = {("luật", "giao"), ("luật", "giáo"), ("giao", "thông"), ("bộ", "luật"), ("luật", "lao"), ("lao", "động")}
    assert {(r.w1, r.w2): r.c for r in some.pairs.collect()} == {p: n for p, n in want.items() if p in beside}
    assert restoring.train(rows.where("false"), only=asked).totals.first() == (0, 0)
    assert math.isclose(restoring.pair_chances(whole).count(), len(want))


def test_best_chunks_are_one_row_a_task_and_pair(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 6)).round(2)
    v[7], v[300] = v[5], v[5]
    rows = [(k, k % 3, x.tolist() if k % 50 else None) for k, x in enumerate(v)] + [(900, 8, None), (901, 8, None)]
    vectors = spark.createDataFrame(rows, "chunk_id long, article_id int, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(f"q{k}", v[k].tolist()) for k in (5, 6, 11)], "query_id string, vector array<double>")
    run = spark.createDataFrame([(f"q{q}", a) for q in (5, 6) for a in (0, 1, 2, 8, 9)], "query_id string, article_id int")
    found = dense.best_chunks(queries, vectors, run)
    want = set()
    for q in (5, 6):
        for a in (0, 1, 2):
            s, c = min((-round(sum(x * y for x, y in zip(v[q].tolist(), r[2], strict=True)), 6), r[0]) for r in rows if r[1] == a and r[2])
            want.add((f"q{q}", a, c, -s))
        want |= {(f"q{q}", 8, 900, None), (f"q{q}", 9, None, None)}
    assert {tuple(r) for r in found.collect()} == want
    assert dense.best_chunks(queries.where("false"), vectors, run).count() == 0


def test_nearest_hands_on_k_rows_of_a_task(spark):
    v = np.ones((5000, 2))
    vectors = spark.createDataFrame([(k, 0, x.tolist()) for k, x in enumerate(v)], "chunk_id long, article_id long, vector array<double>").coalesce(1)
    found = dense.nearest(vectors.where("chunk_id = 3").select(F.col("chunk_id").alias("query_id"), "vector"), vectors, 7)
    assert sorted(r.chunk_id for r in found.collect()) == list(range(7))


def test_gold_of_many_copies_expands_once(spark):
    groups = spark.createDataFrame([(k, "g") for k in range(2000)] + [(5000, "h")], "article_id long, dup_group string")
    gold = spark.createDataFrame([("q", k) for k in range(2000)] + [("q", 7000), ("r", 5000)], "query_id string, article_id long")
    found = metrics.expanded_gold(gold, groups)
    assert sorted(tuple(r) for r in found.collect()) == sorted([*(("q", k) for k in range(2000)), ("q", 7000), ("r", 5000)])


def test_the_encoder_forgets_words_without_changing_vectors(monkeypatch):
    texts = ["a b a", "c", "", "A c d e f"]
    want = dense.hashing_encoder(16)(texts)
    monkeypatch.setattr(dense, "WORDS_KEPT", 1)
    assert (dense.hashing_encoder(16)(texts) == want).all()


def test_hashed_grams_are_as_many_as_grams():
    rng = random.Random(8)
    lists = [[rng.randrange(-3, 3) for _ in range(rng.randrange(9))] for _ in range(60)]
    grams, sizes = audit._hashed_grams(pa.array(lists, pa.list_(pa.int64())), 3)
    sets = [{tuple(x[k : k + 3]) for k in range(len(x) - 2)} if len(x) >= 3 else {tuple(x)} - {()} for x in lists]
    assert sizes.tolist() == [len(s) for s in sets] and len(set(grams.tolist())) == len(set().union(*sets))


def test_split_without_a_join(spark):
    ids = spark.createDataFrame([(k,) for k in range(57)], "query_id long")
    rows = splitting.with_split(ids, ids)
    assert "Join" not in plan(rows)
    assert sorted(rows.collect()) == sorted(splitting.split_queries(ids).collect())
    assert [r.split for r in splitting.with_split(ids.limit(1), ids.limit(1)).collect()] == ["train"]
