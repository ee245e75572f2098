"""Readers and writers: JSON lines, CSV, Parquet, parameters.

Schemas are declared; missing text is the empty text; a missing file is an error that says what makes it.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import shutil
import tempfile
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T

_S = S.StringType()
ARTICLE_LINES = S.StructType([S.StructField("_id", _S), S.StructField("title", _S), S.StructField("text", _S)])
QUERY_LINES = S.StructType([S.StructField("_id", _S), S.StructField("text", _S)])
QREL_LINES = S.StructType([S.StructField("query-id", _S), S.StructField("corpus-id", _S), S.StructField("score", S.DoubleType())])
RUN = S.StructType([S.StructField("query_id", _S), S.StructField("article_id", _S), S.StructField("score", S.DoubleType()), S.StructField("rank", S.IntegerType())])
SPLITS = ("train", "val", "test")
#: Rows of one Arrow batch between the JVM and Python, so that batches of long texts stay small.
BATCH_ROWS = 1000


def _present(spark: SparkSession, path: str, remedy: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(f"{path} is missing; {remedy}")


def batched(rows: DataFrame) -> DataFrame:
    """The rows, in a session whose Arrow batches are bounded."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return rows


def saved(spark: SparkSession, path: str, maker: str) -> DataFrame:
    """A Parquet table that `maker` writes."""
    _present(spark, path, f"{maker} writes it")
    return spark.read.parquet(path)


def json_lines(spark: SparkSession, path: str, schema: S.StructType) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, missing fields are null."""
    _present(spark, path, "download the data set first")
    return spark.read.schema(schema).json(path)


def articles(spark: SparkSession, path: str) -> DataFrame:
    """article_id, document, number, title, text; ids that are not `<document>+<number>` are an error on action."""
    rows = json_lines(spark, path, ARTICLE_LINES)
    document, number = T.article_id("_id")
    return rows.select(F.col("_id").alias("article_id"), document.alias("document"), number.alias("number"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, QUERY_LINES).select(F.col("_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


def qrels(spark: SparkSession, path: str, split: str) -> DataFrame:
    if split not in ("train", "test"):
        raise ValueError(f"split must be train or test, not {split!r}")
    rows = json_lines(spark, path, QREL_LINES)
    return rows.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("article_id"), F.col("score").cast("int").alias("score"), F.lit(split).alias("split"))


def split_gold(qrels_: DataFrame, queries_: DataFrame, split: str) -> DataFrame:
    """query_id, text, gold (sorted ids) of one split; an unknown split is an error."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, not {split!r}")
    gold = qrels_.where(F.col("split") == split).groupBy("query_id").agg(F.array_sort(F.collect_set("article_id")).alias("gold"))
    return gold.join(queries_.select("query_id", "text"), "query_id").select("query_id", "text", "gold")


def csv(spark: SparkSession, path: str, schema: S.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header; a byte order mark is skipped. Without a schema all columns are strings."""
    _present(spark, path, "run the step that reports it")
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A report as CSV with a header, in one file; reports are small."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(rows: DataFrame, path: str, by: Iterable[str] = ()) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_params(spark: SparkSession, path: str) -> dict:
    """Parameters as written by write_params."""
    _present(spark, path, "run the tuning step first")
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_params(spark: SparkSession, path: str, params: dict) -> None:
    """A small JSON document, through Spark's writer so that any store works."""
    spark.createDataFrame([(json.dumps(params, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def upserted(table: DataFrame, row: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows of `row` in place of those with equal keys, sorted by keys."""
    return table.join(row.select(*keys), keys, "left_anti").unionByName(row, allowMissingColumns=True).orderBy(*keys)


def size_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    _present(spark, path, "nothing was written there")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def reused(spark: SparkSession, path: str, base: DataFrame, key: str, make) -> DataFrame:
    """The table at `path` if it has the ids of `base`, as many rows each; else `make()`, written there."""
    try:
        old = spark.read.parquet(path)
        same = old.select(key).exceptAll(base.select(key)).isEmpty() and base.select(key).exceptAll(old.select(key)).isEmpty()
    except AnalysisException:
        same = False
    if not same:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)




def workspace(spark: SparkSession) -> str:
    """A folder for derived tables that all executors share: in spark.checkpoint.dir, else in the warehouse; in a single
    local process without the former a temporary folder. What an application leaves is removed as its driver ends."""
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if app not in _spaces:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and (master == "local" or master.startswith("local[")):
            where = tempfile.mkdtemp(prefix="siltstone-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        _spaces[app] = f"{(where or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/siltstone-{app}"
        atexit.register(_remove, spark, _spaces[app])
    return _spaces[app]


_spaces: dict[str, str] = {}


def _remove(spark: SparkSession, where: str) -> None:
    with contextlib.suppress(Exception):  # the application may have ended, and its files with it
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
