"""Runs (query_id, article_id, score, rank) and how ranks are decided."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Decimals on which scores are compared; beyond them, sums depend on the order of their terms.
DECIMALS = 6


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Ranks within each query by score (falling, to 6 decimals) and id; the first k, or all if k is None or 0."""
    rows = scores.withColumn("score", F.round("score", DECIMALS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "article_id")
    rows = rows.withColumn("rank", F.row_number().over(order))
    rows = rows.where(F.col("rank") <= k) if k else rows
    return rows.select("query_id", "article_id", "score", "rank")


def first_per(rows: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group in an explicit order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def half_up(values: np.ndarray, decimals: int = DECIMALS) -> np.ndarray:
    """Rounded as by Spark's round: half up (away from zero), of the number's decimal form."""
    unit = 10.0**decimals
    scaled = np.abs(values) * unit
    low = np.floor(scaled)
    out = np.copysign((low + (scaled - low >= 0.5)) / unit, values)
    for k in np.flatnonzero(np.abs(scaled - low - 0.5) <= 1e-6 + scaled * 1e-15):
        out.flat[k] = float(Decimal(repr(float(values.flat[k]))).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP))
    return out + 0.0


class Best:
    """The first k rows of each group that a task has met, by score (falling, to some decimals) and then by id: a task
    hands on k rows of a group, however many it reads and however many of them tie."""

    #: Rows that wait until they are sorted, beside twice those that can stay.
    WAITING = 200_000

    def __init__(self, groups: int, k: int, decimals: int = DECIMALS):
        self.k, self.decimals, self.slack = k, decimals, 2 * 10.0**-decimals
        self.least, self.limit = np.full(groups, -np.inf), 2 * groups * k + self.WAITING
        self.parts: list[pa.Table] = []
        self.size = 0

    def add(self, scores: np.ndarray, columns: dict[str, pa.Array], first: int = 0) -> None:
        """scores: a row for each group from `first` on, a column for each of the rows in `columns` (the id comes first);
        minus infinity is no row."""
        groups, n = scores.shape
        least = self.least[first : first + groups]
        if n > self.k and np.count_nonzero(scores >= (least - self.slack)[:, None]) > groups * self.k:
            least = np.maximum(least, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        group, row = np.nonzero((scores >= (least - self.slack)[:, None]) & (scores > -np.inf))
        if not len(group):
            return
        found, taken = scores[group, row], pa.array(row)
        names = {"__group": pa.array(group + first), "__key": pa.array(-half_up(found, self.decimals)), "score": pa.array(found)}
        self.parts.append(pa.table(names | {name: c.take(taken) for name, c in columns.items()}))
        self.size += len(group)
        if self.size > self.limit:
            self._cut()

    def _cut(self) -> None:
        if not self.parts:
            return
        rows = pa.concat_tables(self.parts).combine_chunks()
        rows = rows.sort_by([(name, "ascending") for name in ("__group", "__key", rows.column_names[3])])
        group = rows["__group"].to_numpy()
        place = np.arange(len(group)) - np.searchsorted(group, group)
        last = np.flatnonzero(place == self.k - 1)
        self.least[group[last]] = -rows["__key"].to_numpy()[last]
        rows = rows.filter(pa.array(place < self.k))
        self.parts, self.size = [rows], len(rows)

    def batches(self, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
        """What is left, with the group's number under the first name."""
        self._cut()
        for table in self.parts:
            table = table.rename_columns([names[0] if name == "__group" else name for name in table.column_names]).select(list(names))
            yield from table.to_batches(max_chunksize=50_000)
