"""Restoring accents with a bigram model: counts as tables, best paths by Viterbi.

Training is grouped counts in the JVM; of a model for stated texts only what these need is counted, beside the totals. Decoding goes from left to right over each word's spellings, in
Arrow batches. Joins pick the counts that the given texts may need; only these go to the tasks, for blocks of texts that
are made smaller until a block needs no more than a stated number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..sources import tables

WEIGHT = 0.9
WEIGHTS = (0.5, 0.7, 0.8, 0.9, 0.95, 0.99)
#: Counts that may be sent to the tasks at once; texts that need more are restored in smaller blocks.
SENT = 1_000_000
#: Parts that a block is cut into.
BLOCKS = 8


@dataclass
class Model:
    """words (w, c), pairs (w1, w2, c), spellings (plain, w, c) and totals (n_words, n_forms; one row)."""

    words: DataFrame
    pairs: DataFrame
    spellings: DataFrame
    totals: DataFrame

    def save(self, path: str) -> None:
        for name in ("words", "pairs", "spellings", "totals"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        return Model(*(tables.saved(spark, f"{path}/{name}", "restoring.train(...).save") for name in ("words", "pairs", "spellings", "totals")))


def train(texts: DataFrame, column: str = "text", only: DataFrame | None = None) -> Model:
    """Counts of all words, of neighbours within a text, and which forms each folded word was seen in.

    `only` (a column text: a stated set) leaves what restoring these texts needs: the forms of their words, and of neighbours
    those that are forms of neighbours there. The totals are of all words.
    """
    rows = texts.select(T.syllables(column).alias("s"))
    if only is not None:
        return _needed(rows, only)
    words = rows.select(F.explode_outer("s").alias("w")).where("w IS NOT NULL").groupBy("w").agg(F.count("*").alias("c"))
    neighbours = F.arrays_zip(F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))).alias("w1"), F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))).alias("w2"))
    pairs = rows.select(F.explode_outer(neighbours).alias("p")).where("p IS NOT NULL").groupBy("p.w1", "p.w2").agg(F.count("*").alias("c"))
    spellings = words.select(T.folded("w").alias("plain"), "w", "c")
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_words"), F.count("*").alias("n_forms"))
    return Model(words, pairs, spellings, totals)


def _needed(rows: DataFrame, only: DataFrame) -> Model:
    """The part of the model of rows (s) that the texts may need. All other words make two numbers."""
    spark = rows.sparkSession
    plains = only.select(T.composed("text").alias("t")).select(F.transform(_lower_words(T.parts("t")), T.folded).alias("p")).distinct()
    lists = [r.p for r in plains.collect()]
    number = {p: k for k, p in enumerate(sorted({p for x in lists for p in x}))}
    beside = np.array(sorted({number[x] * len(number) + number[y] for p in lists for x, y in zip(p, p[1:], strict=False)}), np.int64)
    wanted = spark.createDataFrame([(p, True) for p in number], "plain string, wanted boolean")
    words = rows.select(F.explode_outer("s").alias("w")).where("w IS NOT NULL").groupBy("w").agg(F.count("*").alias("c"))
    each = words.withColumn("plain", T.folded("w")).join(F.broadcast(wanted), "plain", "left")
    own = lambda name: F.when(F.col("wanted"), F.col(name)).alias(name)
    found = each.groupBy(own("plain"), own("w")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    known = sorted((r.plain, r.w, r.c) for r in found if r.w is not None)
    n_words, n_forms = sum(r.c for r in found), sum(r.n for r in found)
    names, plain = pa.array([w for _, w, _ in known], pa.string()), np.array([number[p] for p, _, _ in known], np.int64)
    shared = spark.sparkContext.broadcast((names, plain, beside, len(number)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, plain, beside, n = shared.value
        keys, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([keys, *waiting]), return_inverse=True)
            weights = np.concatenate([counts, np.ones(len(at) - len(keys), np.int64)])
            return every, np.bincount(at, weights=weights, minlength=len(every)).astype(np.int64)

        for batch in batches:
            s = batch.column("s")
            ids = pc.index_in(s.flatten(), value_set=names).fill_null(-1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(s)), s.value_lengths().fill_null(0).to_numpy())
            first = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (row[:-1] == row[1:]))
            one, two = ids[first], ids[first + 1]
            met = np.isin(plain[one] * n + plain[two], beside)
            waiting.append(one[met] * len(names) + two[met])
            if sum(map(len, waiting)) > SENT:
                keys, counts = summed()
                waiting = []
        keys, counts = summed()
        one, two = np.divmod(keys, max(1, len(names)))
        for at in range(0, len(keys), 50_000):
            some = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(one[some])), names.take(pa.array(two[some])), pa.array(counts[some])], names=["w1", "w2", "c"])

    pairs = tables.batched(rows).mapInArrow(run, "w1 string, w2 string, c long").groupBy("w1", "w2").agg(F.sum("c").alias("c"))
    spellings = spark.createDataFrame(known, "plain string, w string, c long")
    totals = spark.createDataFrame([(n_words, n_forms)], "n_words long, n_forms long")
    return Model(spellings.select("w", "c"), pairs, spellings, totals)


def _lower_words(parts: Column | str) -> Column:
    """The words among the parts of a text, in lower case."""
    return F.transform(F.filter(parts, lambda p: p.rlike(T.WORD)), F.lower)


def pair_chances(model: Model, weight: float = WEIGHT) -> DataFrame:
    """w1, w2, p, log_p of every seen pair."""
    first = model.words.select(F.col("w").alias("w1"), F.col("c").alias("c1"))
    second = model.words.select(F.col("w").alias("w2"), F.col("c").alias("c2"))
    rows = model.pairs.join(first, "w1").join(second, "w2").join(F.broadcast(model.totals))
    p = V.word_chance(F.col("c2"), F.col("c"), F.col("c1"), F.col("n_words"), F.col("n_forms"), weight)
    return rows.select("w1", "w2", p.alias("p"), V.log_chance(p).alias("log_p"))


def candidates(words: DataFrame, model: Model) -> DataFrame:
    """w and candidates: an accented word stays; another takes any form that its folding was seen in, or itself."""
    forms = model.spellings.groupBy("plain").agg(F.array_sort(F.collect_set("w")).alias("forms"))
    rows = words.select("w").distinct().join(forms, F.col("w") == F.col("plain"), "left")
    own = F.array("w")
    return rows.select("w", F.when(T.accented("w"), own).otherwise(F.coalesce("forms", own)).alias("candidates"))


class Decoder:
    """Viterbi over the spellings of a text's words, given counts as dictionaries."""

    def __init__(self, counts: dict[str, int], pairs: dict[tuple[str, str], int], forms: dict[str, list[str]], n_words: int, n_forms: int):
        self.counts, self.pairs, self.forms, self.n, self.v = counts, pairs, forms, n_words, n_forms

    def chance(self, before: str | None, word: str, weight: float) -> float:
        c = self.counts.get(word, 0)
        alone = (c + 1) / (self.n + self.v) if self.n + self.v else 0.0
        seen = self.counts.get(before, 0) if before is not None else 0
        p = weight * self.pairs.get((before, word), 0) / seen + (1 - weight) * alone if seen else alone
        return math.log(p) if p > 0 else -math.inf

    def options(self, word: str, plain: str) -> list[str]:
        """More frequent forms first, then in the order of their letters; of equal paths the first stays."""
        if word != plain:
            return [word]
        return sorted(self.forms.get(word, [word]), key=lambda w: (-self.counts.get(w, 0), w))

    def best(self, words: list[str], plains: list[str], weight: float) -> list[str]:
        if not words:
            return []
        column = [(self.chance(None, w, weight), w) for w in self.options(words[0], plains[0])]
        trail = []  # for each later word: its forms, and from which form of the word before each is best reached
        for word, plain in zip(words[1:], plains[1:], strict=True):
            new, came = [], []
            for w in self.options(word, plain):
                value, at = -math.inf, 0
                for k, (score, before) in enumerate(column):
                    if (s := score + self.chance(before, w, weight)) > value:
                        value, at = s, k
                new.append((value, w))
                came.append(at)
            trail.append((column, came))
            column = new
        at = max(range(len(column)), key=lambda k: (column[k][0], -k))
        out = [column[at][1]]
        for earlier, came in reversed(trail):
            at = came[at]
            out.append(earlier[at][1])
        return out[::-1]


def _relevant(rows: DataFrame, model: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The parts of the model that the words of rows (s, plain) may need."""
    words = rows.select(F.explode(F.arrays_zip("s", "plain")).alias("x")).select(F.col("x.s").alias("w"), F.col("x.plain").alias("plain")).distinct()
    open_ = words.where("w = plain").select("plain").distinct()
    forms = model.spellings.join(open_, "plain", "left_semi")
    every = forms.select("w").union(words.select("w")).distinct()
    counts = model.words.join(every, "w", "left_semi")
    pairs = model.pairs.join(every.select(F.col("w").alias("w1")), "w1", "left_semi").join(every.select(F.col("w").alias("w2")), "w2", "left_semi")
    return counts, pairs, forms


def restored(texts: DataFrame, model: Model, weights: tuple[float, ...] = (WEIGHT,), column: str = "text") -> DataFrame:
    """texts with `weight` and `restored`, one row for each weight: accents set by the most likely path, other characters
    and the case of the input kept. A null text counts as empty; letters are composed.

    The queries are a stated set. The counts that their words may need are selected by joins. Where they are more than
    `SENT`, the texts are cut into blocks by their hash, and those again; a block of one text is restored whatever it
    needs.
    """
    rows = texts.withColumn("__parts", T.parts(T.composed(column)))
    rows = rows.withColumn("__s", _lower_words("__parts")).withColumn("__plain", F.transform("__s", T.folded))
    totals, out, todo = model.totals.first(), None, [(rows, 1, 0)]
    while todo:
        some, blocks, number = todo.pop()
        counts, pairs, forms = _relevant(some.select(F.col("__s").alias("s"), F.col("__plain").alias("plain")), model)
        found = pairs.limit(SENT + 1).collect()
        if len(found) > SENT and some.select("__s").distinct().limit(2).count() > 1:
            hashed = F.pmod(F.xxhash64("__s"), F.lit(blocks * BLOCKS))
            todo += [(rows.where(hashed == k * blocks + number), blocks * BLOCKS, k * blocks + number) for k in range(BLOCKS)]
            continue
        found = pairs.collect() if len(found) > SENT else found
        part = _decoded(some, counts, found, forms, totals, weights)
        out = part if out is None else out.union(part)
    return out.withColumn("restored", _rejoined(F.col("__parts"), F.col("__words"))).drop("__parts", "__words")


def _decoded(rows: DataFrame, counts: DataFrame, found: list, forms: DataFrame, totals, weights: tuple[float, ...]) -> DataFrame:
    """rows with `weight` and the words of their best paths, by the counts that they need."""
    by_plain: dict[str, list[str]] = {}
    for r in forms.select("plain", "w").collect():
        by_plain.setdefault(r.plain, []).append(r.w)
    decoder = Decoder({r.w: r.c for r in counts.collect()}, {(r.w1, r.w2): r.c for r in found}, by_plain, totals.n_words, totals.n_forms)
    shared = rows.sparkSession.sparkContext.broadcast(decoder)
    kept = [f for f in rows.schema.fields if f.name not in ("__s", "__plain")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "weight double", "__words array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared.value
        for batch in batches:
            words, plains = batch.column("__s").to_pylist(), batch.column("__plain").to_pylist()
            for weight in weights:
                best = [decoder.best(w, p, weight) for w, p in zip(words, plains, strict=True)]
                columns = [batch.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([weight] * len(best), pa.float64()), pa.array(best, pa.list_(pa.string()))], names=[*(f.name for f in kept), "weight", "__words"])

    return rows.select(*(f.name for f in kept), "__s", "__plain").mapInArrow(run, schema)


def _rejoined(parts: Column, words: Column) -> Column:
    """The parts with their words replaced, in the case of the original."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def take(state: Column, part: Column) -> Column:
        is_word = part.rlike(T.WORD)
        piece = F.when(is_word, T.recased(F.element_at(words, state["at"] + 1), part)).otherwise(part)
        return F.struct((state["at"] + is_word.cast("int")).alias("at"), F.concat(state["out"], piece).alias("out"))

    return F.aggregate(parts, start, take, lambda s: s["out"])


def accuracy(rows: DataFrame, truth: str, found: str, by: tuple[str, ...] = ()) -> DataFrame:
    """matches, total, accuracy over the syllables of two texts; texts of different numbers of syllables are an error on action."""
    a, b = T.syllables(truth), T.syllables(found)
    fail = F.raise_error(F.lit("texts of different numbers of syllables")).cast("long")
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)).cast("long")
    each = rows.select(*by, F.when(F.size(a) == F.size(b), same).otherwise(fail).alias("m"), F.size(a).cast("long").alias("t"))
    return each.groupBy(*by).agg(F.sum("m").alias("matches"), F.sum("t").alias("total")).withColumn("accuracy", F.round(F.col("matches") / F.col("total"), 4))


def swept(texts: DataFrame, model: Model, weights: tuple[float, ...] = WEIGHTS, column: str = "text") -> DataFrame:
    """weight, matches, total, accuracy of restoring the folded texts, best weight first (of equal ones the least)."""
    folded = texts.select(F.col(column).alias("truth"), T.folded(column).alias("text"))
    return accuracy(restored(folded, model, weights), "truth", "restored", ("weight",)).orderBy(F.desc("accuracy"), "weight")


def effect(rows: DataFrame) -> DataFrame:
    """restoration (complete, with_errors), n, hits_before, hits_after, lost, gained. rows: complete, before, after (booleans)."""
    named = rows.withColumn("restoration", F.when(F.col("complete"), "complete").otherwise("with_errors"))
    return named.groupBy("restoration").agg(
        F.count("*").alias("n"), F.count_if("before").alias("hits_before"), F.count_if("after").alias("hits_after"),
        F.count_if(F.col("before") & ~F.col("after")).alias("lost"), F.count_if(~F.col("before") & F.col("after")).alias("gained"),
    )
