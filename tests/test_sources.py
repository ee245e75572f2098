import pytest

from siltstone.sources import tables


def test_loaders(spark, tmp_path):
    path = tmp_path / "articles.jsonl"
    path.write_text('{"_id": "a/1+2", "title": "T", "text": "x"}\n\n{"_id": "b+10"}\n')
    rows = {r.article_id: tuple(r)[1:] for r in tables.articles(spark, str(path)).collect()}
    assert rows == {"a/1+2": ("a/1", 2, "T", "x"), "b+10": ("b", 10, "", "")}
    q = tmp_path / "queries.jsonl"
    q.write_text('{"_id": "q1", "text": "why"}\n')
    g = tmp_path / "qrels.jsonl"
    g.write_text('{"query-id": "q1", "corpus-id": "b+10", "score": 1}\n{"query-id": "q1", "corpus-id": "a/1+2", "score": 1.0}\n')
    qrels = tables.qrels(spark, str(g), "train")
    row = tables.split_gold(qrels, tables.queries(spark, str(q)), "train").first()
    assert (row.query_id, row.text, row.gold) == ("q1", "why", ["a/1+2", "b+10"])
    assert {r.score for r in qrels.collect()} == {1}


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="download"):
        tables.articles(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="split"):
        tables.qrels(spark, str(tmp_path), "val")
    with pytest.raises(ValueError, match="split"):
        tables.split_gold(None, None, "dev")
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"_id": "no number"}\n')
    with pytest.raises(Exception, match="not an article id"):
        tables.articles(spark, str(bad)).collect()


def test_csv_params_and_sizes(spark, tmp_path):
    with_mark = tmp_path / "r.csv"
    with_mark.write_bytes(b"\xef\xbb\xbfname,text\na,\"x, \"\"y\"\"\nz\"\n")
    row = tables.csv(spark, str(with_mark)).first()
    assert (row["name"], row["text"]) == ("a", 'x, "y"\nz')
    tables.write_csv(spark.createDataFrame([("é", 1)], "a string, b int"), str(tmp_path / "out"))
    assert tables.csv(spark, str(tmp_path / "out"), "a string, b int").first().a == "é"
    tables.write_params(spark, str(tmp_path / "p"), {"k1": 0.6, "name": "é"})
    assert tables.read_params(spark, str(tmp_path / "p")) == {"k1": 0.6, "name": "é"}
    assert tables.size_bytes(spark, str(tmp_path / "p")) > 0


def test_upsert_and_reuse(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = tables.upserted(old, spark.createDataFrame([("b", 9)], "k string, v int"), ["k"])
    assert [tuple(r) for r in new.collect()] == [("a", 1), ("b", 9)]
    made = []

    def make():
        made.append(1)
        return old

    path = str(tmp_path / "t")
    for _ in range(2):
        assert tables.reused(spark, path, old, "k", make).count() == 2
    assert len(made) == 1
    tables.reused(spark, path, old.where("k = 'a'"), "k", make)
    assert len(made) == 2
    tables.write_parquet(old, str(tmp_path / "q"), ["k"])
    assert spark.read.parquet(str(tmp_path / "q")).where("k = 'b'").first().v == 2
