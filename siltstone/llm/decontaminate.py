"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are lower-cased (A-Z) runs between white space and ASCII marks. A first pass over all documents counts
in how many of them each `SEED`-word gram of the test items occurs. A gram is a seed if it is rare where it stands: in at
most `SPREAD` times as many documents (and as many more) as the rarest of the grams up to `NEAR` places before and after
it. Every stretch of 2 * `NEAR` + 1 grams of an item thus has a seed, whatever part of it is quoted, edited or copied into
a third of the corpus, and whatever the size of the table. A second pass joins the seeds with the documents and aligns the item with the
words about each hit: match +2, mismatch and gap -1; the score is the best local alignment's share of 2 times
the item's length. A pair leaks if its score is `SCORE` or more; items under `SHORT` words must align wholly.

The test items go to the executors in blocks of at most `BLOCK_CHARS` characters, as many as needed, and every
block sees all documents. A copy that shares no three words in a row with its item has no seed and is not met, though it may score just `SCORE`
(every third word edited). Null or empty items and texts match nothing; a repeated item_id yields a row for its
best score; rows with a null doc_id or item_id are left out. Repeated documents yield a row for each doc_id. Very long
texts are read whole. Of equal alignments the first in the text counts. Without documents or items there are no rows.
Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

SEED, SCORE, SHORT = 3, 0.5, 8
NEAR, SPREAD = 2, 100
BLOCK_CHARS = 8_000_000
SCHEMA = "doc_id long, item_id long, score double, first_word long, last_word long"
_SMALL = (1 << 20) - 1


class Items:
    """Words and grams of one block of test items; small enough to be sent to every task."""

    def __init__(self, ids: np.ndarray, texts: list[str]):
        data, offs = C.utf8(pa.array(texts, pa.string()))
        data = K.PLAIN[data]
        starts, ends, firsts = K.word_bounds(data, offs)
        self.ids, self.words, self.firsts = ids, K.Spans(data).hash(starts, ends), firsts
        at, gram = K.windows(self.words, firsts, SEED)
        self.at, self.of = at, K.owner(firsts)[at]
        short = np.flatnonzero((np.diff(firsts) > 0) & (np.diff(firsts) < SEED))
        self.short = {int(k): self.words[firsts[k] : firsts[k + 1]] for k in short}
        self.grams, self.gram = np.unique(gram, return_inverse=True)

    def seeds(self, found: dict[int, int]) -> Seeds:
        """The grams that are rare where they stand; found: documents by gram."""
        often = np.array([found.get(k, 0) for k in range(len(self.grams))], np.int64)[self.gram]
        least = often.copy()
        for d in range(1, NEAR + 1):  # grams come in the order of items and places
            for one, other in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
                same = self.of[one] == self.of[other]
                least[one] = np.where(same, np.minimum(least[one], often[other]), least[one])
        return Seeds(self, np.flatnonzero(often <= SPREAD * (least + 1)))


def _member(grams: np.ndarray) -> np.ndarray:
    small = np.zeros(_SMALL + 1, bool)
    small[(grams & np.uint64(_SMALL)).astype(np.int64)] = True
    return small


def _hits(value: np.ndarray, grams: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `value` of members of the sorted `grams`, and which ones."""
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.flatnonzero(small[(value & np.uint64(_SMALL)).astype(np.int64)])
    which = np.minimum(np.searchsorted(grams, value[place]), len(grams) - 1)
    same = grams[which] == value[place]
    return place[same], which[same]


class Seeds:
    def __init__(self, items: Items, keep: np.ndarray):
        self.items = items
        gram, at, of = items.gram[keep], items.at[keep], items.of[keep]
        order = np.argsort(gram, kind="stable")
        used, first = np.unique(gram[order], return_index=True)
        self.grams, self.first = items.grams[used], np.append(first, len(order))
        self.at, self.of = at[order] - items.firsts[of[order]], of[order]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score of two word sequences and the place [first, last] in `text`."""
    n = len(text)
    row, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps, best = np.arange(n + 1), (0, 0, 0)
    for word in item:
        same = np.where(text == word, 2, -1)
        diagonal, up = row[:-1] + same, row[1:] - 1
        new, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = np.maximum(diagonal, up)
        positive = take > 0
        new[1:] = np.where(positive, take, 0)
        start[1:] = np.where(positive, np.where(diagonal >= up, origin[:-1], origin[1:]), start[1:])
        # gaps along the text: the best earlier cell less its distance
        level = new + steps
        reach = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == reach, steps, 0))
        better = reach - steps > new
        start = np.where(better, start[source], start)
        row, origin = np.where(better, reach - steps, new), start
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), int(origin[top]), top - 1)
    return best


def _leaks(seeds: Seeds, words: np.ndarray, lo: int, hi: int, item: int, places: list[int]) -> tuple[float, int, int] | None:
    """The best alignment of one item with the document words[lo:hi]; places: where the item would start."""
    items = seeds.items
    target = items.words[items.firsts[item] : items.firsts[item + 1]]
    size, best = len(target), (0.0, 0, 0)
    least = SCORE if size >= SHORT else 1.0
    groups: list[list[int]] = []
    for p in sorted(set(places)):
        if 0 <= p - lo and p + size <= hi and (words[p : p + size] == target).all():
            return 1.0, p - lo, p - lo + size - 1
        if groups and p - groups[-1][1] <= 2 * size:
            groups[-1][1] = p
        else:
            groups.append([p, p])
    for first, last in groups:
        a, b = max(lo, first - size), min(hi, last + 2 * size)
        if np.isin(target, words[a:b]).sum() < least * size:
            continue  # each of the item's words adds 2 at most, and only if the text has it there
        score, start, end = align(target, words[a:b])
        if score / (2 * size) > best[0]:
            best = (score / (2 * size), a + start - lo, a + end - lo)
    return best if best[0] >= least else None


def _document_grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offs = C.utf8(batch.column("text"))
    data = K.PLAIN[data]
    starts, ends, firsts = K.word_bounds(data, offs)
    words = K.Spans(data).hash(starts, ends)
    at, gram = K.windows(words, firsts, SEED)
    return words, firsts, at, gram


def count_grams(docs: DataFrame, grams: np.ndarray) -> dict[int, int]:
    """Documents that hold each of the grams; at most one row a gram comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches):
        grams, small, total = shared.value, None, None
        for batch in batches:
            for part in C.slices(batch, "text"):
                if small is None:
                    small, total = _member(grams), np.zeros(len(grams), np.int64)
                _, firsts, at, value = _document_grams(part)
                place, which = _hits(value, grams, small)
                doc = K.owner(firsts)[at[place]]
                total += np.bincount(np.unique(doc * len(grams) + which) % max(1, len(grams)), minlength=len(grams))
        if total is not None and total.any():
            some = np.flatnonzero(total)
            yield C.record(gram=some, n=total[some])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    return dict(zip(rows["gram"].tolist(), rows["n"].tolist(), strict=True))


def scored(docs: DataFrame, seeds: Seeds) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches):
        seeds, small = shared.value, None
        for batch in batches:
            for part in C.slices(batch, "text"):
                small = _member(seeds.grams) if small is None else small
                words, firsts, at, value = _document_grams(part)
                doc_of, ids = K.owner(firsts), part.column("doc_id").to_numpy(zero_copy_only=False)
                places: dict[tuple[int, int], list[int]] = defaultdict(list)
                place, which = _hits(value, seeds.grams, small)
                for p, g in zip(at[place].tolist(), which.tolist(), strict=True):
                    for k in range(seeds.first[g], seeds.first[g + 1]):
                        places[int(doc_of[p]), int(seeds.of[k])].append(p - int(seeds.at[k]))
                for item, target in seeds.items.short.items():
                    m = np.ones(max(0, len(words) - len(target) + 1), bool)
                    for j, w in enumerate(target):
                        m &= words[j : j + len(m)] == w
                    for p in np.flatnonzero(m).tolist():
                        if p + len(target) <= firsts[doc_of[p] + 1]:
                            places[int(doc_of[p]), item].append(p)
                rows = []
                for (doc, item), where in places.items():
                    if found := _leaks(seeds, words, int(firsts[doc]), int(firsts[doc + 1]), item, where):
                        rows.append((ids[doc], seeds.items.ids[item], *found))
                if rows:
                    yield C.record(**{c.split()[0]: pa.array([r[k] for r in rows], pa.float64() if k == 2 else pa.int64()) for k, c in enumerate(SCHEMA.split(", "))})

    return docs.mapInArrow(run, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word of each document and test item that leaks into it."""
    spark = C.tuned(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    blocks, out = -(-chars // BLOCK_CHARS), []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct().orderBy("item_id", "text").collect()
        if not rows:
            continue
        some = Items(np.array([r.item_id for r in rows]), [r.text for r in rows])
        out.append(scored(docs, some.seeds(count_grams(docs, some.grams))))
    if not out:
        return spark.createDataFrame([], SCHEMA)
    found = out[0]
    for df in out[1:]:
        found = found.union(df)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("first_word")).alias("f"), "last_word")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.f")).alias("first_word"), F.col("b.last_word").alias("last_word"))


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs into which no test item leaks."""
    return C.without(docs, C.Scratch(docs.sparkSession, "leaks").save(leaks(docs, benchmark).select("doc_id").distinct(), "leaks"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
