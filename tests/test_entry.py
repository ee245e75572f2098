"""The driver's contract: names, schemas, and results against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FEW = ["token_list", "bm25_search", "fuse_weighted", "near_dup_pairs", "lm_candidates", "split_queries", "pool_max", "evaluate", "chunk_documents", "half_stripped"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 50


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "article_id", "score", "rank"]


@pytest.mark.parametrize("name", FEW)
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    rows = lambda table: sorted(repr(tuple(plain(v) for v in r)) for r in table)
    assert rows(df.select(*columns).collect()) == rows(want)
