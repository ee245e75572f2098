"""The pipeline's stages: columns, effect of decisions, and whole results."""

import re
import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import packing


@pytest.fixture(scope="module")
def stages(spark):
    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], where).cache())
        out[-1].count()
    return out


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash", "decontaminate", "secrets", "packing"]
    for df in stages[:-1]:
        assert df.columns == stages[0].columns


def test_rules_reject_junk_and_keep_good_documents(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    rows = stages[0].join(labels, "doc_id").select("doc_id", "quality", F.size(F.split("text", " ")).alias("n")).collect()
    good = [r.doc_id for r in rows if r.quality == 1 and r.n >= 40]
    assert sum(k in kept for k in good) >= 0.95 * len(good)


def test_no_near_duplicates_are_left(stages):
    sets = [s for r in stages[2].select("text").collect() if (s := shingles(r.text))]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert len(a & b) < 0.8 * len(a | b)
    gone = {r.doc_id for r in stages[1].join(stages[2], "doc_id", "left_anti").collect()}
    before = {r.doc_id: shingles(r.text) for r in stages[1].collect()}
    for k in gone:  # each has a near copy of lesser id
        assert any(len(before[k] & s) >= 0.8 * len(before[k] | s) for j, s in before.items() if j < k)


def test_no_item_is_left(spark, stages):
    plain = lambda t: re.sub(r"[^0-9a-z\u0080-\U0010ffff]+", " ", t.lower()).strip()
    items = [plain(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    held = lambda df: {r.doc_id for r in df.collect() if any(f" {i} " in f" {plain(r.text or '')} " for i in items)}
    assert not held(stages[3])
    assert held(stages[2]) <= {r.doc_id for r in stages[2].join(stages[3], "doc_id", "left_anti").collect()}


def test_secrets_are_redacted_and_all_rows_stay(stages):
    assert stages[4].count() == stages[3].count()
    assert not stages[4].where(F.col("text").rlike("AKIA[A-Z0-9]{12}|[0-9a-f]{32}")).count()


def test_everything_is_packed(stages):
    pieces = stages[5]
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in stages[4].collect()}
    full = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where(f"n <> end OR n > {packing.CAPACITY}").count() == 0


def test_run_is_the_stages_in_order(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(got) == key(stages[5])


def long_prose(k):
    return " ".join(f"The{k} word{i * k % 97} number{i} of text{k} stands here." for i in range(12))


ODD = [(1, None), (2, ""), (3, "  \n "), (4, " ".join(f"w{k}" for k in range(30_000))), (5, long_prose(1)), (5, long_prose(1)), (None, long_prose(1)), (6, "é ü 漢字 😀"), (7, long_prose(2)), (8, long_prose(2) + " token=abcdefgh12")]


@pytest.fixture(scope="module")
def odd_docs(spark):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row", "n", "key", "kept", "rep", "salt", "length"):
        df = df.withColumn(name, F.lit("x"))
    return df.cache()


@pytest.mark.parametrize("rows", [True, False])
def test_each_stage_on_odd_rows_and_on_none(spark, odd_docs, rows):
    """What the stages' docstrings say of null, empty and repeated rows, ties, and tables without rows."""
    docs = odd_docs if rows else odd_docs.where("false")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "packing":
            assert out.columns == docs.columns
        got[name] = sorted((r.doc_id for r in out.collect()), key=repr)
    if not rows:
        assert not any(got.values())
        return
    every = sorted((i for i, _ in ODD), key=repr)
    assert got["quality_rules"] == sorted((i for i in every if i not in (1, 2, 3, 6)), key=repr)
    assert got["minhash"] == sorted([1, 2, 3, 4, 5, 6, 7, None], key=repr)
    assert got["decontaminate"] == got["secrets"] == every
    assert set(got["packing"]) == set(every)


@pytest.mark.parametrize("rows", [True, False])
def test_run_on_odd_rows_and_on_none(spark, odd_docs, rows, tmp_path):
    docs = odd_docs if rows else odd_docs.where("false")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == ({4, 5, 7, None} if rows else set())
    assert sum(r.doc_id == 5 and r.piece == 0 for r in got) == rows
