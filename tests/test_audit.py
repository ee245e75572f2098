import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import audit, splitting


def articles(spark, *rows):
    return spark.createDataFrame(list(rows), "article_id long, document string, title string, text string")


def test_exact_duplicates(spark):
    rows = audit.duplicate_groups(articles(spark, (1, "x", "T", "Hello, world"), (2, "y", "t", "hello world!"), (3, "x", "U", "hello world"), (4, "x", "V", ""), (5, "x", "W", None)))
    found = {r.article_id: (r.n_members, r.n_documents) for r in audit.duplicates(rows).collect()}
    assert found == {1: (2, 2), 2: (2, 2)}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    codes = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(60):
        c = rng.choice(codes)
        for bit in rng.sample(range(64), rng.randint(0, 5)):
            c ^= 1 << bit
        codes.append(c)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    rows = spark.createDataFrame(list(enumerate(signed)), "article_id long, code long")
    reps = {c: i for i, c in reversed(list(enumerate(codes)))}
    want = {(a, b, d) for x, a in reps.items() for y, b in reps.items() if a < b and (d := (x ^ y).bit_count()) <= 3}
    want |= {(reps[c], i, 0) for i, c in enumerate(codes) if reps[c] != i}
    assert {tuple(r) for r in audit.near_duplicates(rows).collect()} == want


def test_many_copies_make_no_pairs_among_themselves(spark):
    rows = spark.range(500).select(F.col("id").alias("article_id"), F.lit(7).cast("long").alias("code"))
    assert audit.near_duplicates(rows).count() == 499
    assert audit.crowded_bands(rows, most=100).count() == 8


def test_simhash_of_alike_texts(spark):
    text = " ".join(f"w{k}" for k in range(60))
    codes = audit.simhash_codes(articles(spark, (1, "", "", text), (2, "", "", text.upper()), (3, "", "", "")), T.tokens("text"))
    got = {r.article_id: r.code for r in codes.collect()}
    assert got[1] == got[2] and got[3] == 0


def test_near_queries_equal_brute_force(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 14))] for _ in range(25)]
    texts = base + [[*t[:-1], "new"] for t in base] + [[], ["x"]] + [base[k // 2] for k in range(8)]
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "query_id long, text string")
    sets = [{" ".join(t[i : i + 3]) for i in range(len(t) - 2)} if len(t) >= 3 else ({" ".join(t)} if t else set()) for t in texts]
    a, b = rows.where("query_id % 2 = 0"), rows.where("query_id % 2 = 1")
    want = {(i, j) for i in range(0, len(sets), 2) for j in range(1, len(sets), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert want
    members = [{}, {}]
    for k, side in enumerate((a, b)):
        for r in audit.query_classes(side, 3).collect():
            members[k].setdefault(r.class_id, []).append(r.query_id)
            assert sets[r.query_id] == sets[r.class_id] and r.class_id <= r.query_id
    pairs = [(r.id_a, r.id_b) for r in audit.near_queries(a, b, 3, 0.6).collect()]
    assert len(pairs) == len(set(pairs)) < len(want)
    assert {(i, j) for x, y in pairs for i in members[0][x] for j in members[1][y]} == want


def test_ids(spark):
    q = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "query_id string, text string")
    assert [tuple(r) for r in audit.repeated_ids(q).collect()] == [("a", 2, 2, "x")]
    assert [tuple(r) for r in audit.same_ids(q, q.where("query_id = 'b'")).collect()] == [("b", "same_id")]
    with pytest.raises(Exception, match="two texts"):
        audit.require_one_text(q).collect()
    assert audit.require_one_text(q.where("text <> 'y'")).count() == 2


def test_spelling_variants(spark):
    rows = articles(spark, (1, "nd-cp", "", ""), (2, "nđ-cp", "", ""), (3, "nđ-cp", "", ""), (4, "other", "", ""), (5, None, "", ""))
    assert {tuple(r) for r in audit.spelling_variants(rows).collect()} == {("nd-cp", "nd-cp", 1), ("nd-cp", "nđ-cp", 2)}


def test_statistics(spark):
    rows = articles(spark, (1, "x", "", "a b c"), (2, "x", "", " "), (3, "y", "", " ".join("w" * 250)), (4, None, "", None))
    got = {r.name: r.value for r in audit.statistics(rows).collect()}
    assert (got["articles"], got["documents"], got["max_words"], got["empty"], got["percent_over_200"]) == (4.0, 2.0, 250.0, 2.0, 25.0)
    assert {(r.bucket, r.n) for r in audit.length_histogram(rows).collect()} == {(0, 3), (240, 1)}
    assert {r.article_id for r in audit.empty_articles(rows).collect()} == {2, 4}


def test_gold_reports(spark):
    gold = lambda *rows: spark.createDataFrame(list(rows), "query_id string, article_id string")
    got = {r.query_id: r.equal for r in audit.conflicting_gold(gold(("q", "b"), ("q", "a"), ("r", "a")), gold(("q", "a"), ("q", "b"), ("r", "c"), ("s", "a"))).collect()}
    assert got == {"q": True, "r": False}
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "article_id string, dup_group string")
    assert [tuple(r) for r in audit.gold_twins(gold(("q", "a"), ("q", "c")), groups).collect()] == [("q", "a", 1, "b")]


def test_leaks(spark):
    parts = spark.createDataFrame([("q", "train"), ("q", "test"), ("r", "val")], "query_id string, split string")
    assert {(r.a, r.b): r.n_common for r in audit.leaks(parts).collect()} == {("test", "train"): 1, ("test", "val"): 0, ("train", "val"): 0}
    with pytest.raises(Exception, match="two splits"):
        audit.require_disjoint(parts).collect()
    assert audit.require_disjoint(parts.where("split <> 'test'")).count() == 2


def test_split(spark):
    ids = spark.createDataFrame([(f"q{k}",) for k in range(100)], "query_id string")
    split = lambda df, **o: {r.query_id: r.split for r in splitting.split_queries(df, **o).collect()}
    one = split(ids)
    assert sorted(one) == sorted(f"q{k}" for k in range(100))
    assert sum(v == "val" for v in one.values()) == 20
    assert one == split(ids.union(ids).orderBy(F.desc("query_id"))) == split(ids, parts=3)
    assert one != split(ids, seed=7)
    assert split(ids.where("false")) == {}
    assert sum(v == "val" for v in split(ids.limit(5), ratio=0.5).values()) == 2


def test_shuffled_split():
    train, val = splitting.shuffled_split([f"q{k}" for k in range(100)] * 2)
    assert len(val) == 20 and sorted(train + val) == sorted(f"q{k}" for k in range(100))
    assert (train, val) == splitting.shuffled_split(reversed([f"q{k}" for k in range(100)]))
    assert splitting.shuffled_split([]) == ([], [])


def test_overlap_is_taken_from_train(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "query_id string, article_id string")
    got = {(r.query_id, r.article_id, r.split) for r in splitting.without_overlap(rows(("q", "a"), ("r", "b")), rows(("q", "c"))).collect()}
    assert got == {("r", "b", "train"), ("q", "c", "test")}


def test_training_rows(spark):
    docs = spark.createDataFrame([("g", "car speed", "1"), ("twin", "car speed", "1"), *((f"n{k}", f"car w{k}", f"d{k}") for k in range(6))], "article_id string, text string, dup_group string")
    gold = spark.createDataFrame([("q", "g")], "query_id string, article_id string")
    asked = spark.createDataFrame([("q", "car car"), ("none", "zebra")], "query_id string, text string")
    rows = splitting.hard_negatives(asked, gold, docs).collect()
    assert [tuple(r) for r in rows] == [("q", "n0", "n1", "n2", "n3")]
    chunks = spark.createDataFrame([("g", 0, "road"), ("g", 1, "car"), ("g", 2, "car")], "article_id string, chunk_no int, text string")
    got = splitting.positives(gold, asked, chunks, T.tokens("text"), T.tokens("text")).collect()
    assert [tuple(r) for r in got] == [("q", "g", 1, 1)]
