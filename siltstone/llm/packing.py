"""Best-fit packing of tokenised documents into sequences, by minimum bin slack.

Documents are tokenised (a vocabulary file of the `tokenizers` library), ended by id 0, and only those longer
than `capacity` are cut. What remains to be packed is a histogram of piece lengths: at most `capacity` numbers,
whatever the size of the corpus. On it, each bin takes the largest remaining length and the fullest feasible
combination of the others, found by subset-sum dynamic programming over a bitset; the combination is removed as
often as the counts allow. That yields at most `capacity` distinct patterns. Pieces of one length are alike, so
the pieces are numbered within their length (in salted groups, for a length may hold a third of all rows), and
the number decides the sequence and the place in it.

A null text counts as empty: its only id is 0. Rows with a null or repeated doc_id are packed like all others.
An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

CAPACITY, END = 2048, 0
#: Words kept with their ids in a worker, at most.
KNOWN_WORDS = 1_500_000
#: Pieces that one numbering group is meant to hold.
GROUP_ROWS = 200_000
#: The mark between words when new words are encoded together; texts with it are encoded alone.
_SENTINEL = "\x01"
#: What a vocabulary does before its merges, if `Encoder` may cut words into runs of letters, digits and other marks.
_FORM = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
)
_SPACE, _LETTER, _DIGIT, _MARK, _GUARD, _WHOLE = range(6)
_visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
#: The letter that a byte-level vocabulary has for each byte.
_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _visible)}


def _kinds(spec: dict) -> np.ndarray | None:
    """The kind of each byte, or None if words are not to be cut.

    A word with a guard is encoded as a whole: an apostrophe may begin a contraction, marks of added tokens may be one of them,
    and of the letters beyond ASCII only those of Latin-1 (two bytes, the first 0xC3) are known not to compose.
    """
    form = tuple((spec.get(k) or {}).get(f"{k.replace('_', '')}s") for k in ("normalizer", "pre_tokenizer"))
    if form != _FORM or spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
        return None
    kinds = np.full(256, _GUARD, np.uint8)
    for b in range(128):
        kinds[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
    kinds[K.SPACE] = _SPACE
    for content in ["'", *(t["content"] for t in spec.get("added_tokens") or [])]:
        marks = [b for b in content.encode() if kinds[b] in (_MARK, _GUARD)]
        if not marks:
            return None
        kinds[marks] = _GUARD
    return kinds


class Encoder:
    """Ids of whole texts. The vocabulary drops white space, so words between ASCII white space are independent; if its form is
    known, so are a word's runs of letters (in lower case), digits and other marks. Each distinct run or word is encoded once
    and its ids are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(_SENTINEL, add_special_tokens=False).ids
        spaced = self.tokenizer.encode(f"a {_SENTINEL} b", add_special_tokens=False).ids
        alone = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in ("a", "b")]
        self.by_word = len(self.mark) == 1 and spaced == alone[0] + self.mark + alone[1]
        self.kinds, self.model = _kinds(json.loads(Path(path).read_text("utf-8"))), self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.keys, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _cut(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        """The bytes to encode, starts and ends of runs or whole words, n+1 indices of each text's first, and which are letters."""
        starts, ends, firsts = K.word_bounds(data, offs)
        if self.kinds is None or not len(starts):
            return data, starts, ends, firsts, np.zeros(len(starts), bool)
        kind = self.kinds[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs of multiplication and division
        kind[lead] = kind[lead + 1] = _LETTER
        whole = np.unique(np.searchsorted(starts, np.flatnonzero(kind == _GUARD), "right") - 1)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[whole]] += 1
        inside[ends[whole]] -= 1
        kind[np.cumsum(inside[:-1], dtype=np.int8) > 0] = _WHOLE
        data = np.where(kind == _LETTER, K.LOWER[data], data)
        upper = lead[(kind[lead] == _LETTER) & (data[lead + 1] < 0x9F)] + 1
        data[upper] += 0x20
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[offs] = True
        starts = np.flatnonzero(edge[:-1] & (kind != _SPACE))
        ends = np.flatnonzero(edge[1:] & (kind != _SPACE)) + 1
        return data, starts, ends, np.searchsorted(starts, offs), kind[starts] == _LETTER

    def _learn(self, keys: np.ndarray, words: list[bytes], letters: np.ndarray) -> None:
        """Adds words that are new; keys are sorted and not known yet. What is letters alone needs the merges only."""
        sizes, parts = np.zeros(len(words), np.int64), []
        merged: list[int] = []
        for k in np.flatnonzero(letters).tolist():
            word = words[k]
            found = [t.id for t in self.model.tokenize(word.decode() if word.isascii() else word.decode("latin-1").translate(_LETTERS))]
            merged += found
            sizes[k] = len(found)
        whole = [None if a else w.decode() for w, a in zip(words, letters.tolist(), strict=True)]
        odd = np.array([w is not None and _SENTINEL in w for w in whole])
        joined = ~odd & ~letters
        if joined.any():
            text = f" {_SENTINEL} ".join(w for w, j in zip(whole, joined.tolist(), strict=True) if j)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.concatenate([[-1], np.flatnonzero(ids == self.mark[0]), [len(ids)]])
            sizes[joined] = np.diff(cut) - 1
            parts.append(np.delete(ids, cut[1:-1]))
        for k in np.flatnonzero(odd).tolist():
            parts.append(np.array(self.tokenizer.encode(whole[k], add_special_tokens=False).ids, np.uint32))
            sizes[k] = len(parts[-1])
        parts.append(np.array(merged, np.uint32))
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(odd), np.flatnonzero(letters)])
        where = np.empty(len(words), np.int64)
        where[order] = len(self.first) - 1 + np.arange(len(words))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes[order])])
        self.ids = np.concatenate([self.ids, *parts])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.where = np.insert(self.keys, at, keys), np.insert(self.where, at, where)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and n+1 offsets."""
        if not self.by_word:
            raw = data.tobytes()
            parts = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(offs[:-1], offs[1:], strict=True)], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        data, starts, ends, firsts, letters = self._cut(data, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        unique, example, inverse = np.unique(K.Spans(data).hash(starts, ends), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        new = self.keys[place] != unique if len(self.keys) else np.ones(len(unique), bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > KNOWN_WORDS:
                self._forget()
                new = np.ones(len(unique), bool)
            raw = data.tobytes()
            self._learn(unique[new], [raw[a:b] for a, b in zip(starts[example[new]].tolist(), ends[example[new]].tolist(), strict=True)], letters[example[new]])
        known = self.where[np.searchsorted(self.keys, unique)]
        size, begin = (self.first[known + 1] - self.first[known])[inverse], self.first[known][inverse]
        total = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(total[-1]) + np.repeat(begin - total[:-1], size)
        return self.ids[index], total[firsts]


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the documents' token ids, cut at `capacity`.

    `vocabulary` is the file of a tokenizer, present on every machine.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(vocabulary)
        ids, firsts = _encoders[vocabulary].encode(*C.utf8(batch.column("text")))
        n = batch.num_rows
        size = np.diff(firsts) + 1
        ids = np.insert(ids, firsts[1:], np.uint32(end)).astype("<u4")
        firsts = np.concatenate([[0], np.cumsum(size)])
        many = -(-size // capacity)
        row = np.repeat(np.arange(n), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = piece * capacity
        length = np.minimum(capacity, size[row] - start)
        raw = memoryview(ids.tobytes())
        begin = firsts[row] + start
        crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(begin.tolist(), length.tolist(), strict=True)]
        return C.record(doc_id=batch.column("doc_id").take(pa.array(row)), piece=piece.astype(np.int32), start=start, length=length, ids_crc32=np.array(crc, np.int64))

    C.tuned(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return C.arrow_map(rows, work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination of the available lengths with the greatest sum up to `room`.

    Bit s of the set tells that sum s can be reached. Counts are split into powers of two; the sets after each
    step are kept, so that the combination can be read back. Larger lengths come first.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach = (reach | reach << (length * k)) & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repetitions, [(length, times), ...]) for patterns that use up the histogram."""
    left = {k: v for k, v in histogram.items() if v}
    out = []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        rest = {k: v for k, v in rest.items() if v}
        pattern = dict(fullest(rest, capacity - seed))
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[k] // v for k, v in pattern.items())
        out.append((times, sorted(pattern.items(), reverse=True)))
        for k, v in pattern.items():
            left[k] -= times * v
            if not left[k]:
                del left[k]
    return out


class Places:
    """For the i-th piece of a length: its sequence and offset."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        blocks: dict[int, list[tuple[int, int, int, int]]] = {}
        done, first = dict.fromkeys(histogram, 0), 0
        for times, pattern in plan(histogram, capacity):
            offset = 0
            for length, k in pattern:
                blocks.setdefault(length, []).append((done[length], first, k, offset))
                done[length] += times * k
                offset += length * k
            first += times
        self.sequences, self.blocks = first, {k: np.array(v, np.int64).T for k, v in blocks.items()}

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(number), np.empty_like(number)
        for k in np.unique(length):
            on = length == k
            begin, first, times, at = self.blocks[int(k)]
            b = np.searchsorted(begin, number[on], "right") - 1
            within = number[on] - begin[b]
            sequence[on] = first[b] + within // times[b]
            offset[on] = at[b] + within % times[b] * k
        return sequence, offset


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    spark = docs.sparkSession
    cut = C.Scratch(spark, "packing").save(pieces(docs, vocabulary, capacity, end), "pieces")
    rows = cut.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = {r["length"]: r["count"] for r in rows}
    shared = spark.sparkContext.broadcast(Places(histogram, capacity))
    salt = max(1, -(-max(histogram.values(), default=0) // GROUP_ROWS))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salt)))
    before = salted.groupBy("length", "salt").count()  # at most capacity * salt rows
    before = before.selectExpr("length", "salt", "sum(count) OVER (PARTITION BY length ORDER BY salt) - count AS before")
    numbered = salted.selectExpr("*", "row_number() OVER (PARTITION BY length, salt ORDER BY doc_id, piece, ids_crc32, start) - 1 AS number")
    numbered = numbered.join(F.broadcast(before) if salt * capacity <= 1 << 20 else before, ["length", "salt"]).selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "CAST(number + before AS BIGINT) AS number")

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        sequence, offset = shared.value.find(batch.column("length").to_numpy(), batch.column("number").to_numpy())
        return C.record(**{c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, sequence_id=sequence, offset=offset)

    return C.arrow_map(numbered, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", None)


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    """The installed vocabulary file of that name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return packed(C.table(spark, sf_dir, "documents"), vocabulary or vocabulary_file())
