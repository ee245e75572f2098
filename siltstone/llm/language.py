"""Language identification: a linear-chain conditional random field that labels words.

Features of a word (ASCII letters in lower case, with marks at both ends): byte trigrams, which hold its
affixes, four-byte prefix and suffix, and the whole word (the lexicon), hashed into one table of weights for
each language. The chain's transition weights are learned with them from code-switched sequences, which are made
by stringing together runs of words from labelled documents of different languages. Forward-backward gives each
word's probability of each language; a text's language has the greatest mean over its words, which is the score.

Learning takes a bounded sample: about `PER_LANGUAGE` labelled documents of each language with the least hash,
`SAMPLE_WORDS` words of each from a place that its hash decides. Every language of the training fold is learned; memory
grows with their number (2**`BITS` weights for each). Prediction sees all words of a text and nothing but the text.

A text that is null or has no letter gets `und` and score 0. Words without a letter take no part. Ties go to the
language that sorts first. Without any labelled document all texts with letters get `und` and 0. A null doc_id is not held
out, nor learned from; repeated rows have equal results; an empty table gives no rows. Very long texts are read whole,
one at a time. Columns other than doc_id, text and lang are not read, so their names do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

PER_LANGUAGE, SAMPLE_WORDS = 500, 200
BITS = 17
EPOCHS, STEP, DECAY = 6, 0.2, 1e-4
SEQUENCE, RUN = 40, 12
#: Bytes of text that one forward-backward takes; its steps are shared by blocks of a sequence.
SLICE = 1 << 22

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_OPEN, _CLOSE = 2, 3
_SHIFT = np.uint64(64 - BITS)
_FAMILY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices of the words data[start:end], word after word, and n+1 offsets."""
    size = ends - starts
    n = len(size)
    begin = np.concatenate([[0], np.cumsum(size + 2)])
    padded = np.empty(begin[-1], np.uint64)
    inner = np.ones(begin[-1], bool)
    inner[begin[:-1]] = inner[begin[1:] - 1] = False
    padded[begin[:-1]], padded[begin[1:] - 1] = _OPEN, _CLOSE
    source = np.repeat(starts - (begin[:-1] + 1), size) + np.flatnonzero(inner)
    padded[inner] = K.LOWER[data[source]]
    tri = padded[:-2] | padded[1:-1] << np.uint64(8) | padded[2:] << np.uint64(16)
    index = ((tri + np.uint64(1)) * _FAMILY[0] >> _SHIFT).astype(np.int64)
    ok = np.ones(len(tri), bool)
    ok[begin[1:-1] - 1] = False  # trigrams over two words
    ok[begin[1:-1] - 2] = False
    gram_word = np.repeat(np.arange(n), size)
    long = size >= 3
    at, to = begin[:-1][long], begin[1:][long]
    prefix = padded[at] | padded[at + 1] << np.uint64(8) | padded[at + 2] << np.uint64(16) | padded[at + 3] << np.uint64(24)
    suffix = padded[to - 4] | padded[to - 3] << np.uint64(8) | padded[to - 2] << np.uint64(16) | padded[to - 1] << np.uint64(24)
    affixes = [((x + np.uint64(1)) * f >> _SHIFT).astype(np.int64) for x, f in ((prefix, _FAMILY[1]), (suffix, _FAMILY[2]))]
    whole = (K.Spans(K.LOWER[data]).hash(starts, ends) * _FAMILY[3] >> _SHIFT).astype(np.int64)
    word = np.concatenate([gram_word, np.flatnonzero(long), np.flatnonzero(long), np.arange(n)])
    value = np.concatenate([index[ok], *affixes, whole])
    order = np.argsort(word, kind="stable")
    return value[order], np.concatenate([[0], np.cumsum(size + 2 * long + 1)])


def words_with_letters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, firsts = K.word_bounds(data, offs)
    if not len(starts):
        return starts, ends, firsts
    some = np.concatenate([[0], np.cumsum(_LETTER[data])])
    keep = some[ends] > some[starts]
    return starts[keep], ends[keep], np.concatenate([[0], np.cumsum(keep)])[firsts]


class Field:
    """Weights of features by language, transitions and starts."""

    def __init__(self, names: list[str]):
        k = len(names)
        self.names = names
        self.weights = np.zeros((1 << BITS, k), np.float32)
        self.moves, self.starts = np.zeros((k, k)), np.zeros(k)

    def fit(self, value: np.ndarray, firsts: np.ndarray, sequences: np.ndarray, labels: np.ndarray) -> None:
        """Maximises the conditional likelihood by AdaGrad. sequences: words (rows of equal length); labels alike."""
        k = len(self.names)
        square, square_moves, square_starts = np.full(self.weights.shape, 1e-6, np.float32), np.full((k, k), 1e-6), np.full(k, 1e-6)
        rng = np.random.default_rng(11)
        size = np.diff(firsts)
        for _ in range(EPOCHS):
            order = rng.permutation(len(sequences))
            for at in range(0, len(order), 64):
                some, gold = sequences[order[at : at + 64]], labels[order[at : at + 64]]
                words = some.ravel()
                many = size[words]
                index = value[np.repeat(firsts[words] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
                scores = np.add.reduceat(self.weights[index], np.concatenate([[0], np.cumsum(many)[:-1]]), axis=0).astype(float).reshape(*some.shape, k)
                node, edge, first = self._expected(scores)
                one = np.eye(k)[gold]
                gradient = (one - node).reshape(-1, k)
                moved = np.einsum("bti,btj->ij", one[:, :-1], one[:, 1:]) - edge
                begun = one[:, 0].sum(0) - first
                total = np.stack([np.bincount(index, np.repeat(gradient[:, j], many), 1 << BITS) for j in range(k)], 1).astype(np.float32)
                used = np.unique(index)
                g = total[used] - DECAY * self.weights[used]
                square[used] += g * g
                self.weights[used] += STEP * g / np.sqrt(square[used])
                square_moves += moved**2
                self.moves += STEP * moved / np.sqrt(square_moves)
                square_starts += begun**2
                self.starts += STEP * begun / np.sqrt(square_starts)

    def _expected(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b, t, k = scores.shape
        e = np.exp(scores - scores.max(2, keepdims=True))
        a, s = np.exp(self.moves - self.moves.max()), np.exp(self.starts - self.starts.max())
        forward, backward = np.empty((b, t, k)), np.ones((b, t, k))
        now = s * e[:, 0]
        forward[:, 0] = now / now.sum(1, keepdims=True)
        for i in range(1, t):
            now = (forward[:, i - 1] @ a) * e[:, i]
            forward[:, i] = now / now.sum(1, keepdims=True)
        edge = np.zeros((k, k))
        for i in range(t - 2, -1, -1):
            ahead = e[:, i + 1] * backward[:, i + 1]
            joint = forward[:, i, :, None] * a * ahead[:, None, :]
            edge += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            now = ahead @ a.T
            backward[:, i] = now / now.sum(1, keepdims=True)
        node = forward * backward
        node /= node.sum(2, keepdims=True)
        return node, edge, node[:, 0].sum(0)

    def marginals(self, scores: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each word; fresh marks the first words of texts.

        The words of many texts make one chain that starts anew at each text. It is cut into blocks that run side by
        side: first each block's transfer matrix, then the vectors at the blocks' ends, then the words within.
        """
        n, k = scores.shape
        width = max(1, int(np.sqrt(n)))
        blocks = -(-n // width)
        e = np.ones((blocks * width, k))
        e[:n] = np.exp(scores - scores.max(1, keepdims=True))
        new = np.ones(blocks * width, bool)
        new[:n] = fresh
        e, new = e.reshape(blocks, width, k).transpose(1, 0, 2).copy(), new.reshape(blocks, width).T.copy()
        a, s = np.exp(self.moves - self.moves.max()), np.exp(self.starts - self.starts.max())
        across = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
        anywhere = new.any(1)
        for t in range(width):
            step = across @ a
            if anywhere[t]:
                step[new[t]] = across[new[t]].sum(2, keepdims=True) * s
            step *= e[t][:, None, :]
            across = step / step.max((1, 2), keepdims=True)
        before, after = np.ones((blocks, k)), np.ones((blocks, k))
        for b in range(1, blocks):
            now = before[b - 1] @ across[b - 1]
            before[b] = now / now.sum()
        for b in range(blocks - 2, -1, -1):
            now = across[b + 1] @ after[b + 1]
            after[b] = now / now.sum()
        forward, now = np.empty_like(e), before
        for t in range(width):
            step = now @ a
            if anywhere[t]:
                step[new[t]] = now[new[t]].sum(1, keepdims=True) * s
            step *= e[t]
            now = forward[t] = step / step.sum(1, keepdims=True)
        now = after
        for t in range(width - 1, -1, -1):
            ahead = e[t] * now
            forward[t] *= now
            step = ahead @ a.T
            if anywhere[t]:
                step[new[t]] = (ahead[new[t]] * s).sum(1, keepdims=True)
            now = step / step.sum(1, keepdims=True)
        out = forward.transpose(1, 0, 2).reshape(-1, k)[:n]
        return out / out.sum(1, keepdims=True)


def learn(texts: list[str], langs: list[str], seed: int = 5) -> Field | None:
    """A field from labelled texts, on sequences that switch between them."""
    names = sorted(set(langs))
    if not names:
        return None
    data, offs = C.utf8(pa.array(texts, pa.string()))
    starts, ends, firsts = words_with_letters(data, offs)
    field = Field(names)
    rng = np.random.default_rng(seed)
    chains, labels = [], []
    code = np.array([names.index(x) for x in langs])
    runs = [(int(a), int(min(a + RUN, firsts[d + 1])), int(code[d])) for d in range(len(texts)) for a in range(int(firsts[d]), int(firsts[d + 1]), RUN)]
    for r in rng.permutation(len(runs)):
        a, b, lang = runs[r]
        chains += range(a, b)
        labels += [lang] * (b - a)
    count = len(chains) // SEQUENCE
    if not count:
        chains, labels, count = (chains * SEQUENCE)[:SEQUENCE], (labels * SEQUENCE)[:SEQUENCE], min(1, len(chains))
    if not count:
        return None
    value, at = features(data, starts, ends)
    field.fit(value, at, np.array(chains[: count * SEQUENCE]).reshape(-1, SEQUENCE), np.array(labels[: count * SEQUENCE]).reshape(-1, SEQUENCE))
    return field


def held_out() -> Column:
    """A fifth of the documents, by the crc32 of doc_id as text; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Texts (word runs) and languages to learn from."""
    usable = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    counts = C.Scratch(docs.sparkSession, "language").save(usable.groupBy("lang").agg(F.least(F.lit(1.0), PER_LANGUAGE / F.count("*")).alias("share")), "counts")
    languages = counts.count()
    if not languages:
        return [], []
    usable, share = usable.join(counts, "lang"), F.col("share")
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    cut = F.when(F.length("text") > 8 * SAMPLE_WORDS, F.substr("text", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.length("text") - 8 * SAMPLE_WORDS) + 1).cast("int"), F.lit(8 * SAMPLE_WORDS))).otherwise(F.col("text"))
    some = usable.where(hashed < share * (1 << 20)).select("doc_id", cut.alias("text"), "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * PER_LANGUAGE * languages)
    rows = sorted(some.collect(), key=lambda r: (r.lang, r.doc_id, r.text))
    return [" ".join(r.text.split()[1:-1]) or r.text for r in rows], [r.lang for r in rows]


def predicted(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        field, n = shared.value, batch.num_rows
        data, offs = C.utf8(batch.column("text"))
        starts, ends, firsts = words_with_letters(data, offs)
        lang, score = ["und"] * n, np.zeros(n)
        count = np.diff(firsts)
        ascii_letters = K.per_text((data < 128) & _LETTER[data], offs)
        real = ascii_letters > 0
        for i in np.flatnonzero(~real & (count > 0)).tolist():
            real[i] = any(c.isalpha() for c in batch.column("text")[i].as_py())
        if field and real.any():
            _, example, inverse = np.unique(K.Spans(K.LOWER[data]).hash(starts, ends), return_index=True, return_inverse=True)
            value, at = features(data, starts[example], ends[example])
            scores = np.add.reduceat(field.weights[value], at[:-1], axis=0)[inverse].astype(float)
            fresh = np.zeros(len(starts), bool)
            fresh[firsts[:-1][count > 0]] = True
            chance = field.marginals(scores, fresh)
            full = np.flatnonzero(count > 0)
            mean = np.add.reduceat(chance, firsts[:-1][full], axis=0) / count[full][:, None]
            best = mean.argmax(1)
            for i, b, m in zip(full.tolist(), best.tolist(), mean.max(1).tolist(), strict=True):
                if real[i]:
                    lang[i], score[i] = field.names[b], min(1.0, m)
        return C.record(doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), lang_pred=lang, score=score)

    C.tuned(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")

    def run(batches):
        for batch in batches:
            for part in C.slices(batch, "text", SLICE):
                yield work(part)

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    return predicted(docs, learn(*sample(docs)))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(C.table(spark, sf_dir, "documents"))
