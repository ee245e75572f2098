"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over byte n-grams of order `ORDER`, so that a gram is an exact integer key and no text is out of
vocabulary. Trusted text is that of all documents labelled good and not toxic (four fifths of them; the rest set the
thresholds). Its highest-order grams are counted in each task first and then by key; lower orders have continuation
counts. Joins of the tables, sharded by key, give each gram its interpolated probability and each context its
back-off weight, in the JVM.

A model of at most `SENT_ROWS` rows (its size is counted) goes to the documents as a broadcast table: one pass. A larger one
stays where it is, and the documents' grams go to it: each document's distinct grams and their counts are saved with the
row's number, grams are resolved once each by joins with the orders' tables on their keys, and the results come back by a
join on the gram, of which the most frequent ones are salted, and are summed by row. Both give the same perplexities. A document is kept if its log-perplexity per byte is at most the threshold of
its language: the `QUANTILE` of held-out trusted documents, whose distance to their median is widened for short texts,
whose perplexity varies more. A language with under `LEAST` such documents has the threshold of all together.

Null or empty texts have no perplexity and are not kept. A null lang counts as the language `und`. A document with
several labels is trusted if none of them is bad. Without trusted text all texts that have a byte are kept, with
perplexity null. Repeated rows and null doc_ids are judged row by row. Equal losses are judged alike (`NEAR`). Very long
texts are read whole; an empty table gives no rows. Other columns of docs are not read, so their names do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ORDER = 5
#: Rows of a model that is broadcast (13 bytes each); a larger one is joined.
SENT_ROWS = 2_000_000
#: Rows of a gram from which it is salted: at least so many, and so many that few grams are.
HOT_ROWS, HOT_GRAMS = 1_000_000, 10_000
QUANTILE, LEAST = 0.95, 20
#: Nats per byte by which equal texts may differ as their shares are added up.
NEAR = 1e-6
#: Bytes from which a text's perplexity counts as settled.
SETTLED = 400
#: Distinct grams that a counting task holds before it hands them on.
HELD = 2_000_000

EVEN = float(np.log(1 / 256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def keys(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte, the `ORDER` bytes that end there as one number; places before a text's first byte are 0."""
    wide = data.astype(np.int64)
    out = wide.copy()
    start = np.repeat(offs[:-1], np.diff(offs))
    place = np.arange(len(data)) - start
    for j in range(1, ORDER):
        shifted = np.zeros(len(data), np.int64)
        shifted[j:] = wide[: len(data) - j]
        shifted[place < j] = 0
        out |= shifted << (8 * j)
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """key and its count c in all texts of docs."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([k for k, _ in held])
            value, inverse = np.unique(every, return_inverse=True)
            return value, np.bincount(inverse, np.concatenate([n for _, n in held]), len(value)).astype(np.int64)

        for batch in batches:
            for part in C.slices(batch, "text"):
                held.append(np.unique(keys(*C.utf8(part.column("text"))), return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield C.record(key=held[0][0], c=held[0][1])
                        held.clear()
                        size = 0
        if size:
            value, times = merged()
            yield C.record(key=value, c=times)

    return docs.select("text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from how many grams occur once, twice, three and four times."""
    n1, n2, n3, n4 = (counts.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def train(docs: DataFrame, scratch: C.Scratch) -> DataFrame | None:
    """n, key, logp, back of all seen grams (back is null) and contexts (logp is null); None without text.

    A context of n - 1 bytes is kept under order n. The lowest order is interpolated with the even chance of 256 bytes.
    """
    counts = scratch.save(count_grams(docs), f"grams{ORDER}")
    if counts.isEmpty():
        return None
    orders = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        suffix = F.col("key").bitwiseAND((1 << (8 * n)) - 1).alias("key")
        orders[n] = scratch.save(orders[n + 1].groupBy(suffix).agg(F.count("*").alias("c")), f"grams{n}")
    lower, out = None, None
    for n in range(1, ORDER + 1):
        few = {r.c: r["count"] for r in orders[n].where("c <= 4").groupBy("c").count().collect()}
        d = discounts(few)
        grams = orders[n].select("key", "c", F.shiftright("key", 8).alias("context"))
        less = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = grams.groupBy("context").agg(F.sum("c").alias("total"), F.sum(less).alias("less"))
        contexts = contexts.select("context", "total", (F.col("less") / F.col("total")).alias("gamma"))
        if n == 1:
            found = grams.crossJoin(F.broadcast(contexts.drop("context")))  # one row
            found = found.select("key", ((F.col("c") - less) / F.col("total") + F.col("gamma") / 256).alias("p"))
        else:
            found = grams.join(contexts, "context").withColumn("low", F.col("key").bitwiseAND((1 << (8 * (n - 1))) - 1))
            found = found.join(lower.select(F.col("key").alias("low"), F.col("p").alias("q")), "low")
            found = found.select("key", ((F.col("c") - less) / F.col("total") + F.col("gamma") * F.col("q")).alias("p"))
        lower = scratch.save(found, f"p{n}")
        none = F.lit(None).cast("double")
        part = lower.select(F.lit(n).alias("n"), "key", F.log("p").alias("logp"), none.alias("back"))
        part = part.union(contexts.select(F.lit(n), F.col("context"), none, F.log("gamma")))
        out = part if out is None else out.union(part)
    model = scratch.save(out, "model")
    scratch.drop(*(f"grams{n}" for n in orders), *(f"p{n}" for n in orders))
    return model


class Table:
    """Values by integer key, found by open addressing."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        bits = max(4, int(2 * max(1, len(key)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        todo, at, self.tries = np.arange(len(key)), self._slot(key), 0
        while len(todo):
            self.tries += 1
            free = todo[self.key[at[todo]] == -1]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.key[at[put]], self.value[at[put]] = key[put], value[put]
            todo = todo[self.key[at[todo]] != key[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _MIX >> self.shift).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and whether there is one."""
        at = self._slot(key)
        there = self.key[at]
        found = there == key
        value = np.where(found, self.value[at], np.float32(0))
        todo = np.flatnonzero(~found & (there != -1))
        for step in range(1, self.tries + 1):
            if not len(todo):
                break
            at = (self._slot(key[todo]) + step) & self.mask
            there = self.key[at]
            hit = there == key[todo]
            found[todo[hit]], value[todo[hit]] = True, self.value[at[hit]]
            todo = todo[~hit & (there != -1)]
        return value, found


class Grams:
    """A whole model as tables, for one task."""

    def __init__(self, rows: pa.Table):
        kind, key, value = (rows.column(c).to_numpy() for c in ("kind", "key", "value"))
        #: keys and values of grams (kind n) and contexts (kind -n); tasks make tables of them
        self.parts = {int(k): (key[kind == k], value[kind == k]) for k in np.unique(kind)}
        self.grams: dict[int, Table] = {}
        self.backs: dict[int, Table] = {}

    def opened(self) -> Grams:
        """With its tables, which a task makes once."""
        if not self.grams:
            none = np.zeros(0, np.int64), np.zeros(0, np.float32)
            self.backs = {k: Table(*self.parts.get(-k, none)) for k in range(1, ORDER + 1)}
            self.grams = {k: Table(*self.parts.get(k, none)) for k in range(1, ORDER + 1)}
        return self

    def log_chances(self, key: np.ndarray) -> np.ndarray:
        """Natural log-probability of each gram's last byte after the others."""
        out = np.zeros(len(key), np.float64)
        left = np.arange(len(key))
        for n in range(ORDER, 0, -1):
            value, found = self.grams[n].find(key[left] & ((1 << (8 * n)) - 1))
            out[left[found]] += value[found]
            left = left[~found]
            if not len(left):
                return out
            value, _ = self.backs[n].find(key[left] >> 8 & ((1 << (8 * (n - 1))) - 1))
            out[left] += value
        out[left] += EVEN
        return out


def _columns(docs: DataFrame) -> tuple[list[str], str]:
    """The columns of docs but text, and their schema."""
    kept = [c for c in docs.columns if c != "text"]
    return kept, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)


def _sent(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The columns of docs but text, n_bytes and the log-likelihood `share`, by a model that is broadcast."""
    kept, schema = _columns(docs)
    kind = F.when(F.col("logp").isNull(), -F.col("n")).otherwise(F.col("n")).cast("byte").alias("kind")
    rows = model.select(kind, "key", F.coalesce("logp", "back").cast("float").alias("value"))
    shared = docs.sparkSession.sparkContext.broadcast(Grams(rows.toArrow()))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = C.utf8(batch.column("text"))
        total = np.concatenate([[0.0], np.cumsum(shared.value.opened().log_chances(keys(data, offs)))])
        return C.record(**{c: batch.column(c) for c in kept}, n_bytes=np.diff(offs), share=total[offs[1:]] - total[offs[:-1]])

    return C.arrow_map(docs, work, f"{schema}, n_bytes long, share double")


def resolved(asked: DataFrame, model: DataFrame) -> DataFrame:
    """key and logp of the grams in `asked` (column key, distinct), by joins with the model's orders from the highest down.

    Tables of up to two bytes have 65,792 rows at most and are broadcast.
    """
    rows = asked.select("key", F.lit(0.0).alias("logp"), F.lit(True).alias("open"))
    for n in range(ORDER, 0, -1):
        grams = model.where(f"n = {n} AND logp IS NOT NULL").select(F.col("key").alias("g"), F.col("logp").alias("p"))
        contexts = model.where(f"n = {n} AND logp IS NULL").select(F.col("key").alias("c"), "back")
        rows = rows.withColumn("g", F.when(F.col("open"), F.col("key").bitwiseAND((1 << (8 * n)) - 1)))
        rows = rows.withColumn("c", F.when(F.col("open"), F.shiftright("key", 8).bitwiseAND((1 << (8 * (n - 1))) - 1)))
        rows = rows.join(F.broadcast(grams) if n <= 2 else grams, "g", "left").join(F.broadcast(contexts) if n <= 3 else contexts, "c", "left")
        more = F.when(F.col("p").isNotNull(), F.col("p")).otherwise(F.coalesce("back", F.lit(0.0)))
        rows = rows.select("key", F.when(F.col("open"), F.col("logp") + more).otherwise(F.col("logp")).alias("logp"), (F.col("open") & F.col("p").isNull()).alias("open"))
    return rows.select("key", F.when(F.col("open"), F.col("logp") + EVEN).otherwise(F.col("logp")).alias("logp"))


def _joined(docs: DataFrame, model: DataFrame, scratch: C.Scratch, hot_rows: int = HOT_ROWS) -> DataFrame:
    """As `_sent`, by joins of the documents' grams with the model."""
    kept, schema = _columns(docs)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = C.utf8(batch.column("text"))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(offs))
        some, times = np.unique(doc << (8 * ORDER) | keys(data, offs), return_counts=True)
        lists = pa.array(np.searchsorted(some >> (8 * ORDER), np.arange(batch.num_rows + 1)).astype(np.int32))
        own = {"keys": some & ((1 << (8 * ORDER)) - 1), "times": times}
        arrays = {c: pa.ListArray.from_arrays(lists, pa.array(v.astype(np.int64))) for c, v in own.items()}
        return C.record(**{c: batch.column(c) for c in ("__row", *kept)}, n_bytes=np.diff(offs), **arrays)

    numbered = docs.select(F.monotonically_increasing_id().alias("__row"), *kept, "text")
    saved = C.arrow_map(numbered, work, f"__row long, {schema}, n_bytes long, keys array<bigint>, times array<bigint>")
    saved = scratch.save(saved, "own")  # numbers are given once
    each = saved.select("__row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("__row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    asked = scratch.save(each.groupBy("key").agg(F.count("*").alias("rows")), "asked")
    total = asked.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    part = max(hot_rows, total // HOT_GRAMS)  # at most HOT_GRAMS grams have more rows
    hot = F.broadcast(asked.where(F.col("rows") > part).select("key", F.ceil(F.col("rows") / part).alias("salts")))
    found = scratch.save(resolved(asked, model), "resolved").join(hot, "key", "left")
    found = found.select("key", "logp", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1).cast("long")) - 1)).alias("salt"))
    each = each.join(hot, "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("__row"), F.col("salts")), F.lit(0).cast("long")))
    sums = each.join(found, ["key", "salt"]).groupBy("__row").agg(F.sum(F.col("times") * F.col("logp")).alias("share"))
    return saved.drop("keys", "times").join(sums, "__row", "left").drop("__row")


def scored(docs: DataFrame, model: DataFrame | None, scratch: C.Scratch, sent_rows: int = SENT_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The columns of docs but text, n_bytes and log_loss: nats per byte, null without a byte or a model."""
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(*(c for c in docs.columns if c != "text"), F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"), none.alias("log_loss"))
    out = _sent(docs, model) if model.count() <= sent_rows else _joined(docs, model, scratch, hot_rows)
    return out.withColumn("log_loss", F.when(F.col("n_bytes") > 0, -F.col("share") / F.col("n_bytes"))).drop("share")


def chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids (distinct)."""
    ids = ids.select(F.col("doc_id").alias("__id"))
    ids = F.broadcast(ids) if ids.count() <= C.IDS_SENT else ids
    return docs.join(ids, docs["doc_id"] == F.col("__id"), "left_semi")


def judged(docs: DataFrame, labels: DataFrame, sent_rows: int = SENT_ROWS) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (per byte), threshold, kept for each row of docs."""
    spark = C.tuned(docs.sparkSession)
    scratch = C.Scratch(spark, "quality-model")
    good = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    good = good.agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 AND t = 0").select("doc_id")
    good = scratch.save(good, "good")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(5)) == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    model = train(chosen(rows, good.where(~fold)), scratch)
    losses = scratch.save(scored(rows, model, scratch, sent_rows), "losses")
    held = chosen(losses, good.where(fold)).where("log_loss IS NOT NULL").withColumn("wide", widening())
    # a deviation is divided by the width of its text, so that short and long texts have one scale
    middle = held.where(f"n_bytes >= {SETTLED}").groupBy("lang").agg(F.percentile_approx("log_loss", 0.5, 10_000).alias("middle"))
    overall = held.agg(F.percentile_approx("log_loss", 0.5, 10_000).alias("all_middle"), F.count("*").alias("all_n"))
    spread = F.percentile_approx((F.col("log_loss") - F.col("middle")) / F.col("wide"), QUANTILE, 10_000)
    own = held.join(F.broadcast(middle), "lang").groupBy("lang", "middle").agg(spread.alias("spread"), F.count("*").alias("n")).where(f"n >= {LEAST}")
    together = F.percentile_approx((F.col("log_loss") - F.col("all_middle")) / F.col("wide"), QUANTILE, 10_000)
    every = held.crossJoin(F.broadcast(overall)).groupBy("all_middle").agg(together.alias("all_spread"))  # one row
    every = scratch.save(every, "every")
    own = scratch.save(own.select("lang", "middle", "spread"), "own")
    out = losses.join(F.broadcast(own), "lang", "left")
    if every.isEmpty():
        out = out.withColumn("threshold", F.lit(None).cast("double"))
    else:
        whole = every.first()
        out = out.withColumn("threshold", F.coalesce("middle", F.lit(whole.all_middle)) + widening() * F.coalesce("spread", F.lit(whole.all_spread)) + NEAR)
    kept = (F.col("n_bytes") > 0) & F.coalesce(F.col("log_loss") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_bytes", F.exp("log_loss").alias("perplexity"), F.exp("threshold").alias("threshold"), kept.alias("kept"))


def widening():
    """How much wider a short text's perplexity varies than a settled one's."""
    return F.sqrt(F.greatest(F.lit(1.0), F.lit(float(SETTLED)) / F.greatest(F.col("n_bytes"), F.lit(1))))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
