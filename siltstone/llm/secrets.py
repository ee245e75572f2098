"""Secret scans: base patterns, and formats learned by grammar inference.

A first pass over all whole texts gathers what is learned from: credentials that the base patterns label (assign,
access, hex) and ordinary runs, which are all other runs of `SHORTEST` or more of the assign value's alphabet
`[A-Za-z0-9+/_.=-]`, without dots at their ends. Of the distinct values of both, each task hands on the `LABELLED` with
the least hash and the count of all, and so does the whole: two bounded samples of the corpus and two counts. Values
of more than `LONGEST` characters are no part of the samples. A prefix tree of the sampled credentials' symbol classes
is built and its statistically compatible states are merged (Hoeffding bounds, red-blue order) into a probabilistic
automaton; a second one is learned alike from the ordinary runs.

The second pass scores every candidate, which is every such run, whatever its length and characters: its mean
log-likelihood per symbol under the first automaton, and the log-likelihood ratio of the two over the whole run. It is
a secret (kind `grammar`) if the likelihood reaches the lowest twentieth of held-out credentials and the ratio exceeds
the prior odds of ordinary runs against credentials, so that chance hits do not grow with the number of candidates.
The method adds spans; base spans stay.

Null or empty texts have no spans. Without any labelled credential nothing is added. A candidate that overlaps
a base span is not added again. Each row is judged by itself, so repeated rows have equal results, and rows with a null
doc_id are judged like others; an empty table gives no rows. Very long texts are read whole. Ties of hashes go by the
value. Only doc_id and text are read, so other columns' names do not matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

#: Labelled credentials, and ordinary runs, that the automata are learned from.
LABELLED = 2_000
#: Characters of the shortest candidate, and of the longest value that is sampled for learning; scores know no longest.
SHORTEST, LONGEST = 8, 256
#: Verdicts on distinct runs that a worker keeps at most; then it starts anew.
KNOWN = 1_000_000
KINDS = ("assign", "access", "hex", "grammar")

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX_RUN = re.compile(r"[0-9a-f]{32,}")
#: Bytes of candidates: letters, digits and `+ / _ . = -`.
_VALUE = np.zeros(256, bool)
_VALUE[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False
#: Cheap tests of which texts need a closer look, on all bytes of a batch.
_MAY = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}

Span = tuple[int, int, int]


def base_spans(text: str, may: tuple[bool, bool, bool] = (True, True, True)) -> list[Span]:
    """(start, kind, end) by start and kind; ends exclusive, in code points."""
    out: list[Span] = []
    if may[0]:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if may[1]:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if may[2]:
        out += [(m.start(), 2, m.end()) for m in _HEX_RUN.finditer(text)]
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def symbols(value: str) -> str:
    """Classes: digit 0, a-f, g-z, A-F, G-Z, and each other mark as itself."""
    return value.translate(_CLASSES)


_CLASSES = {c: "0" for c in range(48, 58)} | {c: "a" for c in range(97, 103)} | {c: "z" for c in range(103, 123)} | {c: "A" for c in range(65, 71)} | {c: "Z" for c in range(71, 91)}
#: Characters of each class; those of a class share its chance, so that no spelling of a format is likelier than another.
_MEMBERS = {"0": 10, "a": 6, "z": 20, "A": 6, "Z": 20}


class Automaton:
    """A probabilistic deterministic automaton: transitions with counts, and counts of ends."""

    ALPHABET = 5 + 5 + 1  # classes, marks, end

    def __init__(self, words: list[str], alpha: float = 0.05, least: int = 3):
        self.next: list[dict[str, int]] = [{}]
        self.times: list[dict[str, int]] = [{}]
        self.ends, self.total = [0], [0]
        for word in words:
            self._add(word)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.least = least
        self._merge_all()
        self._tables()

    def _add(self, word: str) -> None:
        at = 0
        for c in word:
            self.total[at] += 1
            self.times[at][c] = self.times[at].get(c, 0) + 1
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.times.append({})
                self.ends.append(0)
                self.total.append(0)
            at = self.next[at][c]
        self.total[at] += 1
        self.ends[at] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether all frequent pairs of states below a and b have alike ends and transitions."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self.total[a], self.total[b]
            if n1 < self.least or n2 < self.least:
                continue
            if self._differ(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in self.times[a].keys() | self.times[b].keys():
                if self._differ(self.times[a].get(c, 0), n1, self.times[b].get(c, 0), n2):
                    return False
                if a != b and c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to the automaton at a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for c, n in self.times[b].items():
                self.times[a][c] = self.times[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_all(self) -> None:
        red = [0]
        while True:
            inside = set(red)
            blue = [(self.total[t], s, c, t) for s in red for c, t in self.next[s].items() if t not in inside]
            if not blue:
                break
            _, source, symbol, state = max(blue, key=lambda x: (x[0], -x[1], x[2]))
            for r in red:
                if self._compatible(r, state):
                    self.next[source][symbol] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
        self.states = red

    def _tables(self) -> None:
        self.log: dict[int, dict[str, float]] = {}
        self.floor: dict[int, float] = {}
        self.end: dict[int, float] = {}
        for s in self.states:
            n = self.total[s] + self.ALPHABET
            self.log[s] = {c: math.log((k + 1) / n) for c, k in self.times[s].items()}
            self.floor[s] = math.log(1 / n)
            self.end[s] = math.log((self.ends[s] + 1) / n)
        del self.times, self.ends, self.total

    def score(self, word: str) -> float:
        """Mean log-likelihood per character, the end included. After an unseen symbol it goes on from the start."""
        at, total = 0, -sum(math.log(_MEMBERS[c]) * word.count(c) for c in set(word) if c in _MEMBERS)
        for c in word:
            log = self.log[at].get(c)
            if log is None:
                total += self.floor[at]
                at = 0
            else:
                total += log
                at = self.next[at][c]
        return (total + self.end[at]) / (len(word) + 1)


class Model:
    """Both automata, the least likelihood that held-out credentials set, and the prior odds."""

    def __init__(self, credentials: list[str], ordinary: list[str], n_credentials: int = 1, n_ordinary: int = 1):
        words = [symbols(x) for x in credentials]
        held = words[::5] if len(words) >= 10 else words
        train = [w for k, w in enumerate(words) if k % 5] if len(words) >= 10 else words
        self.format = Automaton(train)
        self.other = Automaton([symbols(x) for x in ordinary] or [""])
        self.least_score = float(np.quantile([self.format.score(w) for w in held], 0.05))
        self.odds = max(0.0, math.log(max(1, n_ordinary) / max(1, n_credentials)))

    def secret(self, value: str) -> bool:
        word = symbols(value)
        score = self.format.score(word)
        return score >= self.least_score - 1e-12 and (score - self.other.score(word)) * (len(word) + 1) > self.odds


class Scan:
    """Base spans and candidates of the texts of one batch."""

    def __init__(self, batch: pa.RecordBatch):
        column = batch.column("text").fill_null("") if batch.column("text").null_count else batch.column("text")
        may = [pc.match_substring_regex(column, p).to_numpy(zero_copy_only=False) for p in _MAY.values()]
        self.data, self.offs = C.utf8(column)
        self.labelled: list[str] = []
        #: base spans by text, in code points
        self.base: dict[int, list[Span]] = {}
        starts, ends, _ = K.runs(_VALUE[self.data], self.offs)
        for edge, at in ((starts, 0), (ends, -1)):  # dots at the ends are marks of sentences
            while (dotted := (starts < ends) & (self.data[np.minimum(edge + at, len(self.data) - 1)] == 0x2E)).any():
                edge[dotted] += 1 + 2 * at
        keep = ends - starts >= SHORTEST
        self.starts, self.ends = starts[keep], ends[keep]
        self.text = np.searchsorted(self.offs, self.starts, "right") - 1
        points = np.concatenate([[0], np.cumsum(_HEAD[self.data])])
        self.first = points[self.starts] - points[self.offs[self.text]]
        self.last = self.first + self.ends - self.starts  # all of a run's bytes are ASCII
        free = np.ones(len(self.starts), bool)
        for i in np.flatnonzero(np.logical_or.reduce(may)).tolist():
            text = column[i].as_py()
            if not (spans := base_spans(text, tuple(bool(m[i]) for m in may))):
                continue
            self.base[i] = spans
            self.labelled += [_ASSIGN.fullmatch(text, s, e)[2] if k == 0 else text[s:e] for s, k, e in spans]
            a, b = np.searchsorted(self.text, [i, i + 1])
            for s, _, e in spans:
                free[a:b] &= (self.last[a:b] <= s) | (self.first[a:b] >= e)
        for name in ("starts", "ends", "text", "first", "last"):
            setattr(self, name, getattr(self, name)[free])
        self.hash = K.Spans(self.data).hash(self.starts, self.ends)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct candidates, one place of each, and which of them each candidate is."""
        return np.unique(self.hash, return_index=True, return_inverse=True)

    def value(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].tobytes().decode()

    def secrets(self, model: Model | None, known: dict[int, bool]) -> np.ndarray:
        """The candidates that the model takes for secrets; verdicts on distinct runs are kept in `known`."""
        if model is None or not len(self.starts):
            return np.zeros(0, np.int64)
        if len(known) > KNOWN:
            known.clear()
        hashes, place, which = self.distinct()
        verdict = np.zeros(len(hashes), bool)
        for n, (h, k) in enumerate(zip(hashes.tolist(), place.tolist(), strict=True)):
            if (v := known.get(h)) is None:
                v = known[h] = model.secret(self.value(k))
            verdict[n] = v
        return np.flatnonzero(verdict[which])

    def spans(self, model: Model | None, known: dict[int, bool]) -> tuple[dict[int, list[Span]], dict[int, int]]:
        """All spans by text, and how many of each text's are learned ones."""
        out, more = {i: list(s) for i, s in self.base.items()}, {}
        for k in self.secrets(model, known).tolist():
            i = int(self.text[k])
            out.setdefault(i, []).append((int(self.first[k]), 3, int(self.last[k])))
            more[i] = more.get(i, 0) + 1
        return out, more


LEARNED = "kind int, h long, value string, n long"


def _least(best: dict[int, str], limit: int) -> None:
    if len(best) > 2 * limit:
        for h in sorted(best)[limit:]:
            del best[h]


def learn(docs: DataFrame, limit: int = LABELLED) -> Model | None:
    """The automata from bounded samples of all distinct labelled values (kind 0) and of all ordinary runs (kind 1)."""

    def run(batches):
        best: tuple[dict[int, str], dict[int, str]] = ({}, {})
        total = [0, 0]
        for batch in batches:
            for part in C.slices(batch, "text"):
                scan = Scan(part)
                values = [v for v in scan.labelled if len(v) <= LONGEST]
                total[0] += len(scan.labelled)
                total[1] += len(scan.starts)
                if values:
                    data, offs = C.utf8(pa.array(values, pa.string()))
                    best[0].update(zip(K.Spans(data).hash(offs[:-1], offs[1:]).tolist(), values, strict=True))
                hashes, place, _ = scan.distinct()
                short = scan.ends[place] - scan.starts[place] <= LONGEST
                # hashes are sorted: no more than the first `limit` can be among the least
                best[1].update((h, scan.value(k)) for h, k in zip(hashes[short][:limit].tolist(), place[short][:limit].tolist(), strict=True))
                for some in best:
                    _least(some, limit)
        rows = [(kind, h, best[kind][h], 0) for kind in (0, 1) for h in sorted(best[kind])[:limit]]
        rows += [(kind, 0, None, total[kind]) for kind in (0, 1)]
        kinds, hashes, values, n = zip(*rows, strict=True)
        yield C.record(kind=pa.array(kinds, pa.int32()), h=np.array(hashes, np.uint64).view(np.int64), value=pa.array(values, pa.string()), n=pa.array(n, pa.int64()))

    found = C.Scratch(docs.sparkSession, "secrets").save(docs.select("text").mapInArrow(run, LEARNED), "samples")
    counts = {r.kind: r.n for r in found.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    # as unsigned numbers, the way tasks compare hashes
    order = [F.shiftrightunsigned("h", 1), F.col("h").bitwiseAND(1), "value"]

    def sample(kind: int) -> list[str]:
        return [r.value for r in found.where(f"kind = {kind} AND value IS NOT NULL").select("h", "value").distinct().orderBy(*order).limit(limit).collect()]

    credentials = sample(0)
    return Model(credentials, sample(1), counts[0], counts[1]) if credentials else None


def found(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_grammar, n_candidates, base_sha256 and spans for each row of docs."""
    spark = C.tuned(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = spark.sparkContext.broadcast(learn(rows))
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        known: dict[int, bool] = {}
        for batch in batches:
            for part in C.slices(batch, "text"):
                scan, n = Scan(part), part.num_rows
                every, more = scan.spans(shared.value, known)
                counts, sha, spans = np.zeros((4, n), np.int64), [nothing] * n, [""] * n
                for i, some in every.items():
                    for _, k, _ in some:
                        counts[k, i] += 1
                    sha[i], spans[i] = hashlib.sha256(joined(scan.base.get(i, [])).encode()).hexdigest(), joined(sorted(some))
                yield C.record(
                    doc_id=part.column("doc_id"), n_assign=counts[0], n_access=counts[1], n_hex=counts[2], n_grammar=counts[3],
                    n_candidates=np.bincount(scan.text, minlength=n).astype(np.int64), base_sha256=sha, spans=spans,
                )

    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_grammar long, n_candidates long, base_sha256 string, spans string")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with all secrets (base and learned) in text replaced; all columns stay, n_chars follows the text."""
    spark = C.tuned(docs.sparkSession)
    shared = spark.sparkContext.broadcast(learn(docs))
    at, counted = docs.columns.index("text"), "n_chars" in docs.columns

    def run(batches):
        known: dict[int, bool] = {}
        for batch in batches:
            for part in C.slices(batch, "text"):
                every, _ = Scan(part).spans(shared.value, known)
                columns, values = list(part.columns), part.column("text").to_pylist() if every else []
                for i, spans in every.items():
                    text, out, end = values[i], [], 0
                    for s, _, e in sorted(spans):
                        if s >= end:
                            out += [text[end:s], mark]
                        end = max(end, e)
                    values[i] = "".join([*out, text[end:]])
                if every:
                    columns[at] = pa.array(values, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if counted else out


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(C.table(spark, sf_dir, "documents"))
