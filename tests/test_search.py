"""BM25, dense search, fusion, metrics against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import dense, errors, fusion, metrics, sparse, tuning
from siltstone.operators.ranking import ranked

DOCS = [("d1", "speed limit of cars in town"), ("d2", "tax of cars"), ("d3", "speed speed speed of light"), ("d4", ""), ("d5", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "article_id string, text string")


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "query_id string, text string")


def run(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, article_id string, score double, rank int")


def bm25(query, k1, b):
    lists = {d: (t or "").split() for d, t in DOCS}
    n, mean = len(lists), sum(map(len, lists.values())) / len(lists)
    df = Counter(w for t in lists.values() for w in set(t))
    out = {}
    for d, t in lists.items():
        s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) / (t.count(w) + k1 * (1 - b + b * len(t) / mean)) for w in query.split() if w in t)
        if s:
            out[d] = round(s, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize(("k1", "b"), [(1.2, 0.75), (0.6, 0.9), (1.8, 0.0)])
def test_bm25_scores(spark, docs, k1, b):
    got = sparse.search(asked(spark, "speed of cars"), docs, 10, k1, b).orderBy("rank").collect()
    assert [(r.article_id, pytest.approx(r.score, abs=1e-6)) for r in got] == bm25("speed of cars", k1, b)


def test_repeated_query_words_count_twice(spark, docs):
    one, two = (sparse.search(asked(spark, t), docs).where("article_id = 'd2'").first().score for t in ("tax", "tax tax"))
    assert two == pytest.approx(2 * one, abs=2e-6)


def test_no_match_empty_query_and_large_k(spark, docs):
    assert sparse.search(asked(spark, "zebra", "", None), docs, 1000).count() == 0
    assert sparse.search(asked(spark, "of"), docs, 1000).count() == 3


def test_given_tokens_are_used(spark):
    rows = spark.createDataFrame([("a", ["x_y"]), ("b", ["z"])], "article_id string, tokens array<string>")
    assert [r.article_id for r in sparse.search(asked(spark, "x_y"), rows).collect()] == ["a"]


def test_index_survives_saving(spark, docs, tmp_path):
    index = sparse.build(docs)
    index.save(str(tmp_path / "i"))
    again = sparse.Index.load(spark, str(tmp_path / "i"))
    q = asked(spark, "speed limit")
    assert sparse.search_index(again, q).collect() == sparse.search(q, docs).collect()
    with pytest.raises(FileNotFoundError, match="writes it"):
        sparse.Index.load(spark, str(tmp_path / "none"))


def test_grid_equals_single_searches(spark, docs):
    q = asked(spark, "speed of cars")
    grid = sparse.grid(sparse.build(docs), sparse.query_terms(q), tuning.settings(spark, k1=[0.6, 1.2], b=[0.3, 0.9]))
    got = [(r.article_id, r.score) for r in grid.where("k1 = 0.6 AND b = 0.9").orderBy("rank").collect()]
    assert got == [(r.article_id, r.score) for r in sparse.search(q, docs, 10, 0.6, 0.9).orderBy("rank").collect()]
    assert grid.select("k1", "b").distinct().count() == 4


def test_explanations(spark, docs):
    q = asked(spark, "speed limit limit zebra")
    idf = spark.createDataFrame([("speed", 1.0), ("limit", 2.0)], "term string, idf double")
    found = sparse.explained(run(spark, ("q0", "d1", 1.0, 1), ("q0", "d4", 0.5, 2)), q, docs, idf).orderBy("article_id").collect()
    assert [(t.term, t.score) for t in found[0].terms] == [("limit", 2.0), ("speed", 1.0)]
    assert found[1].terms == []


def test_ties_go_to_the_lesser_id_and_zero_means_all(spark):
    rows = spark.createDataFrame([("q", x, 1.0) for x in "cab"], "query_id string, article_id string, score double")
    assert [r.article_id for r in ranked(rows, 0).orderBy("rank").collect()] == ["a", "b", "c"]
    assert ranked(rows, 2).count() == 2


def test_fusion(spark):
    a = run(spark, ("q", "a", 3.0, 1), ("q", "b", 2.0, 2), ("q", "c", 1.0, 3))
    b = run(spark, ("q", "c", 0.9, 1), ("q", "a", 0.5, 2), ("q", "d", 0.1, 3))
    order = lambda df: [r.article_id for r in df.orderBy("rank").collect()]
    assert order(fusion.weighted(a, b, 0.0))[:2] == ["a", "b"]
    assert order(fusion.weighted(a, b, 1.0))[0] == "c"
    assert sorted(order(fusion.weighted(a, b, 0.5))) == ["a", "b", "c", "d"]
    assert order(fusion.reciprocal([a, b], 60))[0] == "a"
    assert order(fusion.reciprocal([a, b], 60)) == order(fusion.reciprocal([a.withColumn("score", F.col("score") * 9), b], 60))
    assert len(order(fusion.reciprocal([a, b, a], 60, 2))) == 2
    even = run(spark, ("q", "a", 1.0, 1), ("q", "b", 1.0, 2))
    assert {r.score for r in fusion.scaled(even).collect()} == {0.0}
    assert order(fusion.weighted(a.where("false"), b, 0.5))[0] == "c"


def test_measures(spark):
    r = run(spark, *(("q", x, 1.0, k) for k, x in enumerate("abcde", 1)))
    gold = lambda *x: spark.createDataFrame([("q", v) for v in x], "query_id string, article_id string")
    q = asked(spark, "").withColumn("query_id", F.lit("q"))
    row = metrics.per_query(r, gold("c", "z"), q, (1, 3, 10)).first()
    assert (row.recall_1, row.recall_3, row.mrr_10) == (0.0, 0.5, pytest.approx(1 / 3))
    assert row.ndcg_3 == pytest.approx((1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    p, rec = 1 / 10, 0.5
    assert row.f2_10 == pytest.approx(5 * p * rec / (4 * p + rec))
    assert metrics.per_query(r, gold("a"), q, (5,)).first().ndcg_5 == 1.0
    assert metrics.per_query(r, gold("a").where("false"), q, (5,)).first().recall_5 == 0.0


def test_evaluation_counts_queries_without_results_and_wants_gold(spark):
    gold = spark.createDataFrame([("q0", "a"), ("q1", "a")], "query_id string, article_id string")
    r = run(spark, ("q0", "a", 1.0, 1))
    got = {x.measure: x.value for x in metrics.evaluated(r, gold, asked(spark, "", ""), (1,)).collect()}
    assert got["recall_1"] == 0.5
    with pytest.raises(Exception, match="query without gold"):
        metrics.evaluated(r, gold, asked(spark, "", "", ""), (1,)).collect()
    with pytest.raises(Exception, match="missing from the run"):
        metrics.require_results(asked(spark, "", ""), r).collect()
    assert metrics.evaluated(r, gold, asked(spark, "").where("false"), (1,)).count() == 0


def test_hits_and_contingency(spark):
    gold = spark.createDataFrame([(f"q{k}", "a") for k in range(4)], "query_id string, article_id string")
    x = run(spark, ("q0", "a", 1.0, 1), ("q1", "a", 1.0, 1))
    y = run(spark, ("q0", "a", 1.0, 1), ("q2", "a", 1.0, 11))
    matrix = metrics.hit_matrix({"x": x, "y": y}, gold, asked(spark, *"abcd"))
    got = {r.outcome: (r.n, r.percent) for r in errors.contingency(matrix, "x", "y").collect()}
    assert got == {"both": (1, 25.0), "a_only": (1, 25.0), "b_only": (0, 0.0), "neither": (2, 50.0)}
    assert {r.system: r.share for r in metrics.ceiling(matrix, "x", "y").collect()} == {"x": 0.5, "y": 0.25, "either": 0.5}
    ranks = {r.query_id: r.gold_rank for r in metrics.gold_rank(y, gold, asked(spark, *"abcd")).collect()}
    assert ranks == {"q0": 1, "q1": None, "q2": 11, "q3": None}


def test_expanded_gold(spark):
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "article_id string, dup_group string")
    gold = spark.createDataFrame([("q", "a"), ("q", "unknown")], "query_id string, article_id string")
    assert {r.article_id for r in metrics.expanded_gold(gold, groups).collect()} == {"a", "b", "unknown"}


def test_nearest_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[10] = v[20]  # a tie
    vectors = spark.createDataFrame([(k, k % 7, x.tolist()) for k, x in enumerate(v)], "chunk_id long, article_id long, vector array<float>").repartition(5)
    queries = vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    got = {}
    for r in dense.nearest(queries, vectors, 9, block=2).collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 9), r.chunk_id))
    for q in range(0, 300, 50):
        want = sorted((-round(float(s), 9), k) for k, s in enumerate(v.astype(float) @ v[q].astype(float)))[:9]
        assert [c for _, c in sorted(got[q])] == [c for _, c in want]


def test_pooling(spark):
    hits = spark.createDataFrame([("q", 1, "a", 0.9), ("q", 2, "a", 0.1), ("q", 3, "b", 0.6)], "query_id string, chunk_id long, article_id string, score double")
    assert [r.article_id for r in dense.pooled(hits, "max").orderBy("rank").collect()] == ["a", "b"]
    assert [r.article_id for r in dense.pooled(hits, "mean").orderBy("rank").collect()] == ["b", "a"]
    with pytest.raises(ValueError, match="max or mean"):
        dense.pooled(hits, "sum")


def test_best_chunk_and_normal_form(spark):
    vectors = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "a", [0.0, 1.0]), (2, "b", [0.6, 0.8])], "chunk_id long, article_id string, vector array<double>")
    q = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, vector array<double>")
    found = dense.best_chunks(q, vectors, run(spark, ("q", "a", 1.0, 1), ("q", "none", 1.0, 2)))
    assert {(r.article_id, r.chunk_id) for r in found.collect()} == {("a", 1), ("none", None)}
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "vector array<double>")
    assert [r.vector for r in dense.normalized(rows).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_encoder_is_deterministic(spark):
    rows = spark.createDataFrame([("a b",), ("a b",), (None,)], "text string")
    a, b, c = (r.vector for r in dense.encoded(rows, dense.hashing_encoder(16)).collect())
    assert a == b and set(c) == {0.0} and sum(x * x for x in a) == pytest.approx(1.0, abs=1e-5)


def test_sweeps_agree_with_single_fusions(spark):
    rng = random.Random(1)
    rows = lambda: [(f"q{q}", f"d{d}", rng.random(), 0) for q in range(6) for d in rng.sample(range(30), 15)]
    a, b = (ranked(run(spark, *rows())) for _ in range(2))
    gold = spark.createDataFrame([(f"q{q}", f"d{d}") for q in range(6) for d in (1, 2)], "query_id string, article_id string")
    q = asked(spark, *"abcdef")
    sweep = {r.alpha: r.recall for r in tuning.alphas(a, b, gold, q, (0.0, 0.35, 1.0), 3).collect()}
    for alpha, recall in sweep.items():
        assert metrics.recall_at(fusion.weighted(a, b, alpha), gold, q, 3).first().recall == recall
    constants = {r.constant: r.recall for r in tuning.constants([a, b], gold, q, (10, 60), 3).collect()}
    assert constants[60] == metrics.recall_at(fusion.reciprocal([a, b], 60), gold, q, 3).first().recall


def test_selection(spark):
    sweep = spark.createDataFrame([(0.0, 0.9), (0.4, 0.9), (0.7, 0.9), (1.0, 0.1)], "alpha double, recall double")
    row = tuning.best_alpha(sweep).first()
    assert (row.alpha, row.at_end) == (0.4, False)
    rows = spark.createDataFrame([("a", 0.5, False), ("b", 0.9, True), ("c", 0.6, False)], "system string, recall double, contaminated boolean")
    assert {(r.system, r.chosen) for r in tuning.select_clean(rows).collect()} == {("c", True), ("b", False)}
    pools = spark.createDataFrame([("m", "mean", 0.4), ("m", "max", 0.3)], "model string, pooling string, recall double")
    assert tuning.pooling_of(pools, "m").first().pooling == "mean"
    assert tuning.pooling_of(pools, "other").first().pooling == "max"


def test_latency_and_side_by_side(spark):
    found = tuning.latency(len, ["a", "b"])
    assert 0 <= found["p50_ms"] <= found["p95_ms"] and tuning.latency(len, []) == {"p50_ms": 0.0, "p95_ms": 0.0}
    rows = tuning.side_by_side({"x": run(spark, ("q", "a", 1.0, 1)), "y": run(spark, ("q", "b", 1.0, 1), ("q", "c", 1.0, 2))})
    assert {tuple(r) for r in rows.collect()} == {("q", 1, "a", "b"), ("q", 2, None, "c")}


def test_failures_and_causes(spark):
    gold = spark.createDataFrame([("q0", "a"), ("q1", "b")], "query_id string, article_id string")
    titles = spark.createDataFrame([(x, x.upper()) for x in "abc"], "article_id string, title string")
    r = run(spark, ("q0", "a", 1.0, 1), ("q1", "c", 2.0, 1), ("q1", "b", 1.0, 2))
    rows = errors.failures(r, gold, asked(spark, "x", "y"), titles, k=1).collect()
    assert [(x.query_id, x.gold_id, x.top_1, x.top_2, x.top_3) for x in rows] == [("q1", "b", "C", "B", None)]
    labels = spark.createDataFrame([("q0", "p"), ("q1", "p"), ("q2", "r")], "query_id string, cause string")
    found = errors.labelled(asked(spark, *"abcd"), labels)
    assert errors.unlabelled(found).first().unlabelled == 1
    assert [(x.cause, x.n, x.percent) for x in errors.causes(found).collect()] == [("p", 2, 66.7), ("r", 1, 33.3)]
    assert errors.examples(found.withColumn("k", F.lit(1)), "k", 2).count() == 2
