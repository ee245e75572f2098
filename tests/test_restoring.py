import itertools
import math

import pytest
from pyspark.sql import functions as F

from siltstone.operators import assistant, restoring, sparse

CORPUS = ["người lao động có quyền nghỉ phép", "người sử dụng lao động phải trả lương", "lương tối thiểu vùng", "phép năm của người lao động"]


@pytest.fixture(scope="module")
def model(spark):
    return restoring.train(spark.createDataFrame([(t,) for t in CORPUS], "text string"))


def fixed(spark, model, *texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.restored for r in restoring.restored(rows, model, **options).orderBy("id").collect()]


def test_context_case_and_other_characters(spark, model):
    got = fixed(spark, model, "nguoi lao dong, phai tra LUONG!", "Nguoi lao động", "xyz 12", "", None)
    assert got == ["người lao động, phải trả LƯƠNG!", "Người lao động", "xyz 12", "", ""]


def test_accented_words_stay(spark, model):
    assert fixed(spark, model, "lướng") == ["lướng"]


def test_counts(spark, model):
    words = {r.w: r.c for r in model.words.collect()}
    assert words["lao"] == 3
    assert {(r.w1, r.w2): r.c for r in model.pairs.collect()}["lao", "động"] == 3
    assert model.totals.first().n_words == sum(words.values())


def test_best_path_equals_enumeration(spark, model):
    counts = {r.w: r.c for r in model.words.collect()}
    pairs = {(r.w1, r.w2): r.c for r in model.pairs.collect()}
    forms = {"a": ["a", "á", "à"], "b": ["b", "ḃ"], "c": ["c", "ć"]}
    counts |= {"á": 3, "a": 1, "à": 2, "b": 2, "ḃ": 2, "ć": 1, "c": 1}
    pairs |= {("à", "ḃ"): 2, ("ḃ", "c"): 1, ("á", "b"): 1}
    d = restoring.Decoder(counts, pairs, forms, 30, 20)
    for words in (["a", "b", "c"], ["c", "a", "b", "a"], ["b"], ["x", "a"]):
        for weight in (0.5, 0.9, 1.0):
            def value(path, weight=weight):
                return sum(d.chance(path[k - 1] if k else None, w, weight) for k, w in enumerate(path))

            best = max(value(p) for p in itertools.product(*(forms.get(w, [w]) for w in words)))
            got = value(d.best(words, words, weight))
            assert got == best or math.isclose(got, best)


def test_accuracy_and_sweep(spark, model):
    rows = spark.createDataFrame([("một hai ba", "một hai bà"), ("x", "x")], "a string, b string")
    got = restoring.accuracy(rows, "a", "b").first()
    assert (got.matches, got.total, got.accuracy) == (3, 4, 0.75)
    with pytest.raises(Exception, match="different numbers"):
        restoring.accuracy(rows.withColumn("b", F.lit("x y z w")), "a", "b").collect()
    sweep = restoring.swept(spark.createDataFrame([(t,) for t in CORPUS], "text string"), model).collect()
    assert len(sweep) == 6 and sweep[0].accuracy == 1.0


def test_effect(spark):
    rows = spark.createDataFrame([(True, True, True), (True, False, True), (False, True, False)], "complete boolean, before boolean, after boolean")
    got = {r.restoration: (r.n, r.hits_before, r.hits_after, r.lost, r.gained) for r in restoring.effect(rows).collect()}
    assert got == {"complete": (2, 1, 2, 0, 1), "with_errors": (1, 1, 0, 1, 0)}


def test_model_survives_saving(spark, model, tmp_path):
    model.save(str(tmp_path / "m"))
    assert fixed(spark, restoring.Model.load(spark, str(tmp_path / "m")), "luong toi thieu") == ["lương tối thiểu"]


def test_answers(spark, model):
    docs = spark.createDataFrame([(f"d{k}", f"Article {k}", f"Article {k}. {t}") for k, t in enumerate(CORPUS)], "article_id string, title string, text string")
    asked = spark.createDataFrame([("q0", "luong toi thieu"), ("q1", "zebra")], "query_id string, text string")
    found = assistant.answers(asked, docs, sparse.build(docs), restoring.restored(asked, model))
    top = found.where("rank = 1").first()
    assert (top.article_id, top.used, top.is_restored, top.snippet) == ("d2", "lương tối thiểu", True, "lương tối thiểu vùng")
    text = {r.query_id: r.answer for r in assistant.rendered(found, asked).collect()}
    assert "Accents restored" in text["q0"] and "Article 2  [d2]" in text["q0"] and "lương (" in text["q0"]
    assert "No article was found." in text["q1"]


def test_candidates(spark, model):
    rows = spark.createDataFrame([("nguoi",), ("người",), ("zzz",)], "w string")
    assert {r.w: r.candidates for r in restoring.candidates(rows, model).collect()} == {"nguoi": ["người"], "người": ["người"], "zzz": ["zzz"]}


def test_texts_that_need_many_counts_are_restored_in_blocks(spark, monkeypatch):
    texts = ["luật giao thông đường bộ", "điều khiển xe máy", "người tham gia giao thông", "bộ luật lao động"]
    model = restoring.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(["luat giao thong", "dieu khien xe", "nguoi tham gia", "bo luat"])], "k int, text string")
    whole = {r.k: r.restored for r in restoring.restored(asked, model).collect()}
    monkeypatch.setattr(restoring, "SENT", 1)
    assert {r.k: r.restored for r in restoring.restored(asked, model).collect()} == whole
    assert whole[0] == "luật giao thông"
