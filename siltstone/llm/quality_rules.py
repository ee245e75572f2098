"""Quality rules: a decision list learned by sequential covering, emitted as Spark conditionals.

Statistics of each whole text are counted once (Arrow batches, numpy). A bounded sample of labelled rows
(the `LABELLED` rows with the least hash of doc_id) goes to the driver, where rules are grown on two thirds
and pruned on one third: a rule is a conjunction of thresholds on ratios that marks low quality. The list
becomes one CASE expression that the JVM evaluates over all rows.

Null or empty texts have all counts 0 and fail the base rules. Rows with a null or repeated doc_id are each
judged by their own text. Without labels (or with one class only) the list is empty and keeps all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

#: Labelled rows that rules are learned from.
LABELLED = 20_000
#: Least share of truly low-quality rows among those a rule covers, on the rows kept for pruning.
PRECISION = 0.97
#: Least number of rows a rule covers there.
SUPPORT = 8
MAX_RULES, MAX_TERMS = 12, 4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_points", "n_digits", "n_upper", "n_marks", "n_stopped"]

#: The features that rules may use, as expressions over the counts.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "digit_ratio": "n_digits / greatest(n_points, 1)",
    "upper_ratio": "n_upper / greatest(n_points, 1)",
    "mark_ratio": "n_marks / greatest(n_points, 1)",
    "stopped_ratio": "n_stopped / greatest(n_lines, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def count_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offs = C.utf8(batch.column("text"))
    starts, ends, firsts = K.word_bounds(data, offs)
    spans = K.Spans(data)
    words = spans.hash(starts, ends)
    at, value = K.windows(words, firsts, 8)
    doc = K.owner(firsts)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(at):
        twice = at[K.repeated(doc[at], value) > 1]
        np.add.at(covered, twice, 1)
        np.subtract.at(covered, np.minimum(twice + 8, len(words)), 1)
    repeat = np.cumsum(covered[:-1]) > 0
    head, solid = _HEAD[data], ~K.SPACE[data]
    # lines: cut at \n and at the ends of texts
    breaks = data == 0x0A
    line_start = np.concatenate([offs[:-1], np.flatnonzero(breaks) + 1])
    line_end = np.concatenate([offs[1:], np.flatnonzero(breaks)])
    line_start.sort()
    line_end.sort()
    line_doc = np.searchsorted(offs, line_start, "right") - 1
    # an empty text shares its offset with the next; such lines have no word and count nowhere
    has = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[has], line_end[has], line_doc[has]
    n = len(offs) - 1
    lines = np.bincount(line_doc, minlength=n)
    if len(line_start):
        key = K.mix(spans.hash(line_start, line_end) ^ K.mix(line_doc.astype(np.uint64) + np.uint64(1)))
        _, index = np.unique(key, return_index=True)
        distinct = np.bincount(line_doc[index], minlength=n)
        last = data[ends[np.searchsorted(starts, line_end) - 1] - 1]
        stopped = np.bincount(line_doc, weights=np.isin(last, list(b".!?\"")), minlength=n).astype(np.int64)
    else:
        distinct, stopped = lines, np.zeros(n, np.int64)
    return C.record(
        doc_id=batch.column("doc_id"), n_words=np.diff(firsts), word_chars=K.per_text(head & solid, offs), n_symbols=K.per_text(_SYMBOL[data], offs),
        n_dup_lines=lines - distinct, n_repeat_words=np.bincount(doc, weights=repeat, minlength=n).astype(np.int64), n_lines=lines, n_points=K.per_text(head, offs),
        n_digits=K.per_text(_DIGIT[data], offs), n_upper=K.per_text(_UPPER[data], offs), n_marks=K.per_text(_MARK[data], offs), n_stopped=stopped,
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each row of `docs` (columns doc_id, text)."""
    C.tuned(docs.sparkSession)
    return C.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), count_batch, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")


class DecisionList:
    """Ordered rules; each is a conjunction of (feature, '<=' or '>', threshold) that marks low quality."""

    def __init__(self, rules: list[list[tuple[str, str, float]]]):
        self.rules = rules

    def expression(self) -> Column:
        """The number of the first rule that holds, or 0."""
        out = F.lit(0)
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            held = F.lit(True)
            for name, op, limit in rule:
                held = held & F.expr(f"({FEATURES[name]}) {op} {limit!r}D")
            out = F.when(held, F.lit(k)).otherwise(out)
        return out

    def describe(self) -> list[str]:
        return [" AND ".join(f"{n} {o} {t:.6g}" for n, o, t in r) for r in self.rules]


def _held(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, op, limit in rule:
        out &= x[:, f] <= limit if op == "<=" else x[:, f] > limit
    return out


def _centred(rule: list[tuple[int, str, float]], x: np.ndarray, bad: np.ndarray) -> list[tuple[int, str, float]]:
    """Moves each threshold half way to the nearest low-quality row that the rule covers."""
    on, out = _held(x, rule) & bad, []
    for f, op, limit in rule:
        near = x[on, f].min() if op == ">" else x[on, f].max()
        out.append((f, op, float((limit + near) / 2)))
    return out


def learn(x: np.ndarray, bad: np.ndarray) -> DecisionList:
    """Sequential covering with reduced-error pruning. Rows must come in an order that is fixed."""
    names, rules = list(FEATURES), []
    fold = np.arange(len(x)) % 3 == 2
    gx, gy, px, py = x[~fold], bad[~fold], x[fold], bad[fold]
    while len(rules) < MAX_RULES and gy.sum() >= SUPPORT and (~gy).any():
        rule: list[tuple[int, str, float]] = []
        inside = np.ones(len(gx), bool)
        while len(rule) < MAX_TERMS and (inside & ~gy).any():
            p, n = (inside & gy).sum(), (inside & ~gy).sum()
            base, best = np.log2(p / (p + n)), (0.0, None)
            for f in range(x.shape[1]):
                column = gx[inside, f]
                for limit in np.unique(np.quantile(column, np.linspace(0.01, 0.99, 50))):
                    low = column <= limit
                    for op, mask in (("<=", low), (">", ~low)):
                        tp = (mask & gy[inside]).sum()
                        if tp >= SUPPORT and (gain := tp * (np.log2(tp / mask.sum()) - base)) > best[0] + 1e-9:
                            best = (gain, (f, op, float(limit)))
            if best[1] is None:
                break
            rule.append(best[1])
            inside &= _held(gx, rule[-1:])
        worth = [((t := _held(px, rule[:k]))[py].sum() - t[~py].sum()) / max(1, t.sum()) for k in range(1, len(rule) + 1)]
        if not rule:
            break
        rule = rule[: int(np.argmax(worth)) + 1]
        on = _held(px, rule)
        if on.sum() < SUPPORT // 2 or py[on].mean() < PRECISION or gy[_held(gx, rule)].mean() < PRECISION:
            break
        rules.append(_centred(rule, gx, gy))
        rule = rules[-1]
        on = _held(px, rule)
        gx, gy, px, py = gx[~(r := _held(gx, rule))], gy[~r], px[~on], py[~on]
    return DecisionList([[(names[f], op, limit) for f, op, limit in r] for r in rules])


def fit(counts: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DecisionList:
    """Learns from the `limit` labelled documents with the least hash of doc_id; of contrary labels the lower counts."""
    some = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    features = [F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()]
    rows = counts.where(~base_failed()).join(F.broadcast(some), "doc_id").select("doc_id", "quality", *features).toPandas()
    if not len(rows):
        return DecisionList([])
    rows = rows.assign(h=K.mix(rows.doc_id.to_numpy().astype(np.uint64))).sort_values(["h", *FEATURES], kind="stable")
    return learn(rows[list(FEATURES)].to_numpy(float), rows.quality.to_numpy() == 0)


def judge(counts: DataFrame, rules: DecisionList) -> DataFrame:
    return counts.withColumn("base_failed", base_failed()).withColumn("rule", rules.expression()).withColumn("kept", F.expr("NOT base_failed AND rule = 0"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base_failed, the rule that holds, and kept, for each row of docs."""
    counts = C.Scratch(docs.sparkSession, "rules").save(statistics(docs), "counts")
    return judge(counts, fit(counts, labels))


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep; texts are not shuffled."""
    counts = C.Scratch(docs.sparkSession, "rules").save(statistics(docs), "counts")
    rules = fit(counts, labels)
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = count_batch(batch)
        return C.record(row=batch.column("row"), **{c: found.column(c) for c in COUNTS})

    kind = row.schema["row"].dataType.simpleString()
    return judge(C.arrow_map(row, work, f"row {kind}, " + ", ".join(f"{c} long" for c in COUNTS)), rules).where("kept").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")
