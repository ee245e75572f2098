"""Tables, scratch space in the shared folder, and Arrow batch helpers.

Scratch tables live as long as results that read them may be asked for: `clean` deletes those of a session when its results
have been written, and what is left is deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer single text is handled alone.
SLICE_BYTES = 1_000_000
#: Rows of one Arrow batch between the JVM and Python.
BATCH_ROWS = 1000
#: Ids that may be broadcast; more are joined by a shuffle.
IDS_SENT = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the data folder, read by Spark."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of this session, so that whole long texts fit in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a folder in the warehouse, which a
    cluster shares too; in a single local process (tests) a temporary folder, removed at its end."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master == "local" or master.startswith("local["):
            where = tempfile.mkdtemp(prefix="siltstone-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        else:
            where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/siltstone-scratch"
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_roots: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession | None = None) -> None:
    """Deletes the scratch tables of a session (of all if None), once no result that reads them is needed any more."""
    for entry in [e for e in _roots if spark is None or e[0] is spark]:
        _roots.remove(entry)
        with contextlib.suppress(Exception):  # the session may have ended, and its files with it
            _delete(*entry)


atexit.register(clean)


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
        _roots.append((spark, self.root))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in `ids` (a written table with the column doc_id); null stays."""
    gone = ids.select(F.col("doc_id").alias("__gone")).distinct()
    gone = F.broadcast(gone) if ids.count() <= IDS_SENT else gone
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n+1 offsets between them; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts have about `limit` bytes, one row at least."""
    if not batch.num_rows:
        return
    _, offs = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str | None = "text") -> DataFrame:
    """mapInArrow of `work` over slices of the batches; `work` returns the output columns in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column) if column else [batch]:
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], names=list(columns))
