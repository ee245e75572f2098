"""Removal of repeated 400-byte strings, by deep-shallow suffix sorting within anchor buckets.

A byte goes if a string of `LENGTH` bytes that covers it also starts anywhere else (same text included); all is
judged on the input. Sorting every suffix of the corpus is not needed for that. Of each `LENGTH`-byte window only
the place of its least `GRAM`-byte hash (its anchor, leftmost of equals) is kept; equal windows have equal anchors at the
same place within. Suffixes at anchors are dealt out by the hash of their first `GRAM` bytes, which is the
shallow bucket; buckets with one anchor end there. Within a bucket the bytes right of the anchors, and those
left of them read backwards, are ordered by multikey quicksort to a shallow depth and by blind tries beyond it.
The common prefixes of neighbours give for each window place x the classes of equal left x and equal right
`LENGTH` - x bytes; a window is repeated if a pair of classes is met twice.

First only hashes move: of an anchor's gram and of the bytes about it that windows may reach (its context). Where all
contexts of a gram are equal, all their windows are repeated; bytes are read again only for grams with different
contexts, once for each context. No group is unbounded in one task: equal texts are one class and equal contexts of
an anchor one row (partial aggregates). A bucket with more than `BUCKET` different contexts is dealt out once to `SPLIT`
ranges of x, each keyed by the bytes that all its windows share, which spreads a hot gram over tasks; what is then
still larger than `HELD` is split by ranges of ranges. A context thus becomes `SPLIT` rows, and `SPLIT` more for each
range of a bucket over `HELD` in which it differs from all others at an end only: at most 4 / 3 * `BACK` rows, however
large its group is. Texts are not shuffled, but for those that lose a part of their bytes; fixed-size bit filters
spare work on others, and joins remove what passes by chance.

Null and empty texts have no bytes; an empty table gives no rows. Rows with equal texts have equal results, whatever
their doc_id; a null doc_id is a row like others. Very long texts are read whole, one at a time. There are no ties:
a byte is covered or not. Other columns of docs are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

LENGTH, GRAM = 400, 32
BACK = LENGTH - GRAM
#: Different contexts of a gram that one task sorts at first, and those of a range that one task sorts later on.
BUCKET, HELD = 2_000, 20_000
#: Elements of the class tables that `repeats` holds at once.
CELLS = 4_000_000
#: Keys of crowded buckets that are broadcast; more are joined by a shuffle.
KEYS_SENT = 100_000
#: Classes of equal texts that are broadcast; more are joined by a shuffle.
CLASSES_SENT = 500_000
#: Ranges that a crowded bucket's windows are split into.
SPLIT = 4
#: Bytes that multikey quicksort looks at before blind tries take over, and groups that it leaves to them at once.
SHALLOW, FEW = 24, 4

# --- deep-shallow sorting -------------------------------------------------------------------------


def _common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix; `known` bytes are equal."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - ((x.bit_length() + 7) >> 3)


class _BlindTrie:
    """A trie with branching bytes and depths only; byte -1 ends a string."""

    __slots__ = ("root", "texts")

    def __init__(self, texts: list[bytes], first: int):
        self.texts, self.root = texts, first

    def insert(self, k: int, known: int) -> None:
        texts, new, node = self.texts, self.texts[k], self.root
        while type(node) is tuple:  # blind search
            depth, kids = node
            c = new[depth] if len(new) > depth else -1
            node = kids[c] if c in kids else next(iter(kids.values()))
        leaf = node if type(node) is int else node[0]
        lcp = _common(texts[leaf], new, known)
        parent, at, node = None, None, self.root
        while type(node) is tuple and node[0] < lcp:
            c = new[node[0]] if len(new) > node[0] else -1
            parent, at, node = node, c, node[1][c]
        mine = new[lcp] if len(new) > lcp else -1
        if type(node) is tuple and node[0] == lcp:
            kid = node[1].get(mine)  # only texts that end here can meet at a leaf
            node[1][mine] = k if kid is None else [kid, k] if type(kid) is int else [*kid, k]
            return
        other = texts[leaf][lcp] if len(texts[leaf]) > lcp else -1
        if mine == other == -1:  # equal strings
            joined = [node, k] if type(node) is int else [*node, k]
            branch: object = joined
        else:
            branch = (lcp, {other: node, mine: k})
        if parent is None:
            self.root = branch
        else:
            parent[1][at] = branch

    def walk(self, lcp: int, order: list[int], lcps: list[int]) -> None:
        todo: list[tuple[object, int]] = [(self.root, lcp)]
        while todo:
            node, lcp = todo.pop()
            if type(node) is int:
                order.append(node)
                lcps.append(lcp)
            elif type(node) is list:
                for k in node:
                    order.append(k)
                    lcps.append(lcp)
                    lcp = len(self.texts[k])
            else:
                depth, kids = node
                names = sorted(kids, reverse=True)
                todo += [(kids[c], depth) for c in names[:-1]]
                todo.append((kids[names[-1]], lcp))


def deep_shallow(texts: list[bytes], known: int = 0) -> tuple[list[int], list[int]]:
    """The sorted order of texts and each one's common prefix with its predecessor (-1 for the first).

    All texts are known to share their first `known` bytes (as far as they reach).
    """
    order: list[int] = []
    lcps: list[int] = []
    todo = [(list(range(len(texts))), known, -1)]
    while todo:  # multikey quicksort: three parts about a middle byte; an ended text sorts first
        some, depth, before = todo.pop()
        if len(some) == 1:
            order.append(some[0])
            lcps.append(before)
        elif len(some) <= FEW or depth >= known + SHALLOW:
            trie = _BlindTrie(texts, some[0])
            for k in some[1:]:
                trie.insert(k, min(depth, len(texts[k])))
            trie.walk(before, order, lcps)
        else:
            heads = [texts[k][depth] if len(texts[k]) > depth else -1 for k in some]
            pivot = sorted((heads[0], heads[len(heads) // 2], heads[-1]))[1]
            less, same, more = ([k for k, c in zip(some, heads, strict=True) if keep(c)] for keep in (lambda c: c < pivot, lambda c: c == pivot, lambda c: c > pivot))
            parts = [(less, depth), (same, depth + 1 if pivot >= 0 else depth), (more, depth)]
            parts = [p for p in parts if p[0]]
            lcp = [before, *[depth] * (len(parts) - 1)]
            if pivot < 0 and same:  # ended texts are equal
                parts = [p for p in parts if p[0] is not same]
                at = 0
                for k in same:
                    order.append(k)
                    lcps.append(before if at == 0 else depth)
                    at += 1
                lcp = [depth] * len(parts)
            todo += [(p, d, b) for (p, d), b in zip(reversed(parts), reversed(lcp), strict=True)]
    return order, lcps


class _Classes:
    """Classes of texts among equal prefixes of any depth, from their sorted order."""

    def __init__(self, texts: list[bytes], known: int):
        order, lcps = deep_shallow(texts, known)
        self.order, self.lcps, self.size = np.array(order), np.array(lcps), np.array([len(t) for t in texts])

    def at(self, depth: np.ndarray) -> np.ndarray:
        """[d, i]: the class of text i among equal prefixes of depth[d] bytes, or -1 if it is shorter."""
        out = np.empty((len(depth), len(self.order)), np.int64)
        out[:, self.order] = np.cumsum(self.lcps[None, :] < depth[:, None], axis=1)
        out[depth[:, None] > self.size[None, :]] = -1
        return out


def _again(left: np.ndarray, right: np.ndarray, several: np.ndarray) -> np.ndarray:
    """[x, i]: whether context i has a window at x whose two classes another context has too, or that is there several times."""
    n = left.shape[1]
    fits = (left >= 0) & (right >= 0)
    key = np.where(fits, left * (n + 1) + right, -1 - np.arange(n))
    order = np.argsort(key, axis=1, kind="stable")
    ranked = np.take_along_axis(key, order, 1)
    same = np.zeros_like(fits)
    equal = ranked[:, 1:] == ranked[:, :-1]
    same[:, 1:] |= equal
    same[:, :-1] |= equal
    again = np.zeros_like(fits)
    np.put_along_axis(again, order, same, 1)
    return (again | several[None, :]) & fits


def repeats(lefts: list[bytes], rights: list[bytes], times: list[int], lo: int = 0, hi: int = BACK) -> list[list[tuple[int, int]]]:
    """For each context of one anchor, the covered intervals [from, to) relative to it.

    lefts and rights are the bytes about the anchor; times counts equal contexts; x is in lo..hi. Besides the sorted
    strings, `CELLS` elements are held at once, and a bit for each context and x.
    """
    n = len(lefts)
    if n == 1 and times[0] == 1:
        return [[]]
    if n == 2 and max(times) == 1:
        a = _common(lefts[0][::-1], lefts[1][::-1])
        b = _common(rights[0], rights[1])
        x0, x1 = max(lo, LENGTH - b), min(hi, a)
        return [[(-x1, LENGTH - x0)] if x0 <= x1 else []] * 2
    x = np.arange(lo, hi + 1)
    left, right, several = _Classes([t[::-1] for t in lefts], 0), _Classes(rights, GRAM), np.array(times) > 1
    again, step = np.zeros((len(x) + 2, n), bool), max(1, CELLS // n)
    for k in range(0, len(x), step):
        some = x[k : k + step]
        again[k + 1 : k + 1 + len(some)] = _again(left.at(some), right.at(LENGTH - some), several)
    out: list[list[tuple[int, int]]] = []
    for i in range(n):
        edge = np.flatnonzero(again[1:, i] != again[:-1, i])
        out.append([(-int(x[b - 1]), LENGTH - int(x[a])) for a, b in zip(edge[::2], edge[1::2], strict=True)])
    return out


# --- anchors ----------------------------------------------------------------------------------------


def anchors(data: np.ndarray, offs: np.ndarray, spans: K.Spans) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors and the hashes of their grams."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < LENGTH:
        return none
    place = np.arange(len(data) - GRAM + 1)
    gram = spans.hash(place, place + GRAM)
    width = BACK + 1
    keyed = (gram & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)
    pad = -len(keyed) % width
    table = np.concatenate([keyed, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(data) - LENGTH + 1
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    inside = np.zeros(len(data) + 1, np.int64)
    size = np.diff(offs)
    some = size >= LENGTH
    np.add.at(inside, offs[:-1][some], 1)
    np.subtract.at(inside, offs[1:][some] - LENGTH + 1, 1)
    at = (least[np.cumsum(inside[:-1])[:count] > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        return none
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, gram[at]


def bit_filter(values: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A Bloom filter of a bigint column; 2**20 to 2**27 bits, so 16 MB at most."""
    n = values.count()
    bits = 1 << min(27, max(20, (16 * n).bit_length()))
    rows = values.select(F.explode(F.array(F.col(column), F.expr(f"shiftrightunsigned({column}, 29)"))).alias("v")).select(F.expr(f"v & {bits - 1}").alias("bit"))
    words = rows.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("mask")).toPandas()
    table = np.zeros(bits >> 6, np.int64)
    table[words["at"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)
    return table, bits - 1


def _passes(found: tuple[np.ndarray, int], value: np.ndarray) -> np.ndarray:
    table, mask = found
    value = value.astype(np.uint64)
    out = np.ones(len(value), bool)
    for v in (value, value >> np.uint64(29)):
        bit = (v & np.uint64(mask)).astype(np.int64)
        out &= (table[bit >> 6] >> (bit & 63)) & 1 == 1
    return out


def _digests(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """128 bits of each text's SHA-256, and all of it."""
    raw = memoryview(data.tobytes())
    sha = [hashlib.sha256(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    words = np.frombuffer(b"".join(x.digest()[:16] for x in sha), np.uint64).reshape(-1, 2)
    return words[:, 0], words[:, 1], [x.hexdigest() for x in sha]


def _row_key(ids: pa.Array, d1: np.ndarray) -> np.ndarray:
    return K.mix(d1 ^ K.mix(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))


SIGNED = "doc_id long, row_key long, d1 long, d2 long, n_bytes long, sha string, grams array<bigint>, digests array<bigint>, places array<int>"
CONTEXTS = "row_key long, gram long, digest long, left binary, right binary"
HITS = "row_key long, n_bytes long, copies long, gram long, digest long, place int"


def _contexts_of(data: np.ndarray, offs: np.ndarray, spans: K.Spans) -> tuple[np.ndarray, ...]:
    """For each anchor: its place, text and gram, the bytes [from, to) about it that windows may reach, and their digest."""
    at, gram = anchors(data, offs, spans)
    doc = np.searchsorted(offs, at, "right") - 1
    a, b = np.maximum(at - BACK, offs[doc]), np.minimum(at + LENGTH, offs[doc + 1])
    return at, doc, gram, a, b, spans.hash(a, b) ^ K.mix((at - a).astype(np.uint64))


def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The whole text's digest, and its anchors: gram, digest of the context, place."""
    data, offs = C.utf8(batch.column("text"))
    at, doc, gram, _, _, digest = _contexts_of(data, offs, K.Spans(data))
    lists = pa.array(np.searchsorted(doc, np.arange(len(offs))).astype(np.int32))
    d1, d2, sha = _digests(data, offs)
    return C.record(
        doc_id=batch.column("doc_id"), row_key=_row_key(batch.column("doc_id"), d1).view(np.int64), d1=d1.copy().view(np.int64), d2=d2.copy().view(np.int64), n_bytes=np.diff(offs), sha=sha,
        grams=pa.ListArray.from_arrays(lists, pa.array(gram.view(np.int64))), digests=pa.ListArray.from_arrays(lists, pa.array(digest.view(np.int64))),
        places=pa.ListArray.from_arrays(lists, pa.array((at - offs[doc]).astype(np.int32))),
    )


def anchors_of(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """One row for each anchor whose gram passes a filter of `grams` (column gram): what is no repeat is left in its array."""
    shared = rows.sparkSession.sparkContext.broadcast(bit_filter(grams, "gram"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        lists = batch.column("grams")
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        gram = lists.flatten().to_numpy()
        keep = np.flatnonzero(_passes(shared.value, gram.view(np.uint64)))
        if not len(keep):
            return None
        row = pa.array(np.repeat(np.arange(len(size)), size)[keep])
        flat = {c: batch.column(f"{c}s").flatten().take(pa.array(keep)) for c in ("gram", "digest", "place")}
        return C.record(**{c: batch.column(c).take(row) for c in ("row_key", "n_bytes", "copies")}, **flat)

    return C.arrow_map(rows.select("row_key", "n_bytes", "copies", "grams", "digests", "places"), work, HITS, None).join(grams, "gram")


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, digest, times, left, right: the bytes about one anchor of each context in `wanted` (gram, digest, times, row_key)."""
    key = wanted.select(F.expr("gram ^ digest").alias("key"))
    shared = docs.sparkSession.sparkContext.broadcast((bit_filter(wanted.select("row_key").distinct(), "row_key"), bit_filter(key, "key")))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        wanted_rows, wanted_contexts = shared.value
        data, offs = C.utf8(batch.column("text"))
        row_key = _row_key(batch.column("doc_id"), _digests(data, offs)[0])
        wanted = _passes(wanted_rows, row_key)
        if not wanted.any():
            return None
        at, doc, gram, a, b, digest = _contexts_of(data, offs, K.Spans(data))
        keep = np.flatnonzero(wanted[doc] & _passes(wanted_contexts, gram ^ digest))
        if not len(keep):
            return None
        _, first = np.unique(K.mix(gram[keep] ^ K.mix(digest[keep] ^ K.mix(doc[keep].astype(np.uint64)))), return_index=True)
        f, raw = keep[first], data.tobytes()
        return C.record(
            row_key=row_key[doc[f]].view(np.int64), gram=gram[f].view(np.int64), digest=digest[f].view(np.int64),
            left=pa.array([raw[x:y] for x, y in zip(a[f].tolist(), at[f].tolist(), strict=True)], pa.binary()),
            right=pa.array([raw[x:y] for x, y in zip(at[f].tolist(), b[f].tolist(), strict=True)], pa.binary()),
        )

    found = C.arrow_map(docs, work, CONTEXTS).withColumnRenamed("row_key", "holder")
    both = found.join(wanted, ["gram", "digest"]).where("holder = row_key")
    return both.groupBy("gram", "digest").agg(F.first("times").alias("times"), F.first("left").alias("left"), F.first("right").alias("right"))


COVERED = "gram long, digest long, a int, b int"


def _sort_buckets(rows: DataFrame) -> DataFrame:
    """Covered intervals of contexts in buckets (key) that each fit into a task: gram, digest, times, left, right, x range."""

    def run(batches):
        held: list[tuple] = []
        out: list[tuple[int, int, int, int]] = []

        def flush() -> None:
            if held:
                found = repeats([h[4] for h in held], [h[5] for h in held], [h[3] for h in held], held[0][6], held[0][7])
                out.extend((h[1], h[2], a, b) for h, spans in zip(held, found, strict=True) for a, b in spans)
                held.clear()

        def done() -> pa.RecordBatch:
            batch = C.record(**{c.split()[0]: pa.array([r[k] for r in out], pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(COVERED.split(", "))})
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    flush()
                held.append(row)
            if len(out) > 5_000:
                yield done()
        flush()
        if out:
            yield done()

    columns = ["key", "gram", "digest", "times", "left", "right", "lo", "hi"]
    dealt = rows.select(*columns).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, COVERED)


def _keyed(value: bytes, mark: str) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8, key=mark.encode()).digest(), signed=True)


def _split(rows: DataFrame) -> DataFrame:
    """For contexts of crowded buckets: keys of the parts that the windows of each range of x share (key) and span (digest)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for key, gram, digest, times, left, right, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            step = -(-(hi - lo + 1) // SPLIT)
            for x0 in range(lo, hi + 1, step):
                x1 = min(hi, x0 + step - 1)
                if len(left) >= x0 and len(right) >= LENGTH - x1:
                    core, span = left[len(left) - x0 :] + right[: LENGTH - x1], (left[max(0, len(left) - x1) :], right[: LENGTH - x0])
                    mark = f"{gram}:{x0}:{x1}"
                    core = _keyed(core, mark)
                    whole = _keyed(b"".join(span), f"{mark}:{len(span[0])}")
                    out.append((core, whole, gram, digest, times, x0, x1, len(span[0]) == x1 and len(span[1]) == LENGTH - x0))
        names = ("key", "whole", "gram", "digest", "times", "lo", "hi", "full")
        types = (pa.int64(),) * 5 + (pa.int32(),) * 2 + (pa.bool_(),)
        return C.record(**{c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(zip(names, types, strict=True))})

    columns = ["key", "gram", "digest", "times", "left", "right", "lo", "hi"]
    return C.arrow_map(rows.select(*columns), work, "key long, whole long, gram long, digest long, times long, lo int, hi int, full boolean", None)


def covered(different: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Intervals (a, b) that are covered about each context (gram, digest, times, left, right)."""
    rows = different.select(F.col("gram").alias("key"), "*", F.lit(0).alias("lo"), F.lit(BACK).alias("hi"))
    out, level = None, 0
    while True:
        limit = HELD if level else BUCKET
        crowded = scratch.save(rows.groupBy("key").count().where(f"count > {limit}").select("key"), f"crowded{level}")
        many = crowded.count()
        hint = F.broadcast(crowded) if many <= KEYS_SENT else crowded
        part = scratch.save(_sort_buckets(rows.join(hint, "key", "left_anti") if many else rows), f"covered{level}")
        out = part if out is None else out.union(part)
        if not many:
            return out
        pieces = scratch.save(_split(rows.join(hint, "key")), f"pieces{level}")
        full = pieces.where("full").groupBy("key", "whole").agg(F.sum("times").alias("all"), F.min(F.struct("gram", "digest", "lo", "hi")).alias("one"))
        full = scratch.save(full, f"full{level}")
        whole = pieces.where("full").join(full.where("all > 1").select("key", "whole"), ["key", "whole"])
        out = out.union(scratch.save(whole.selectExpr("gram", "digest", "-hi AS a", f"{LENGTH} - lo AS b"), f"whole{level}"))
        # of equal pieces one goes on, for others to be compared with; a shorter one (at an end of its text) goes on by itself
        rest = full.selectExpr("key", "one.gram", "one.digest", "all AS times", "one.lo", "one.hi", "false AS alone")
        rest = rest.union(pieces.where("NOT full").selectExpr("key", "gram", "digest", "times", "lo", "hi", "times > 1 AS alone"))
        # a piece that meets no other is decided
        open_ = scratch.save(rest.groupBy("key").agg(F.count("*").alias("n"), F.max("alone").alias("alone")).where("n > 1 OR alone").select("key"), f"open{level}")
        rows = rest.join(open_, "key").drop("alone").join(different.select("gram", "digest", "left", "right"), ["gram", "digest"])
        # only the bytes that windows of the range reach go on
        part_left, part_right = F.expr("substring(left, greatest(1, length(left) - hi + 1), hi)").alias("left"), F.expr(f"substring(right, 1, {LENGTH} - lo)").alias("right")
        rows = scratch.save(rows.select("key", "gram", "digest", "times", part_left, part_right, "lo", "hi"), f"rows{level}")
        scratch.drop(f"pieces{level}", f"full{level}", f"open{level}", *([f"rows{level - 1}"] if level else []))
        level += 1


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats, n_kept for each row of docs."""
    spark = C.tuned(docs.sparkSession)
    scratch = C.Scratch(spark, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.save(C.arrow_map(docs, sign, SIGNED), "signed")
    classes = signed.groupBy("d1", "d2", "n_bytes").agg(F.count("*").alias("copies"), F.min("row_key").alias("first")).where("copies > 1")
    classes = scratch.save(classes.select("d1", "d2", "copies", "first"), "classes")
    hint = F.broadcast(classes) if classes.count() <= CLASSES_SENT else classes
    # of equal texts one takes part; it is not scored itself, for all of it goes
    long = signed.where(f"n_bytes >= {LENGTH}").join(hint, ["d1", "d2"], "left").where("copies IS NULL OR row_key = first")
    whole = long.where("copies IS NULL").unionByName(long.where("copies > 1").dropDuplicates(["d1", "d2"]))
    each = whole.select(F.explode(F.arrays_zip("grams", "digests")).alias("x"))
    again = each.groupBy(F.col("x.grams").alias("gram")).agg(F.count("*").alias("n"), (F.min("x.digests") == F.max("x.digests")).alias("alike"))
    again = scratch.save(again.where("n > 1").select("gram", "alike"), "again")
    hits = scratch.save(anchors_of(whole, again), "hits")
    # where all contexts of a gram are equal, all their windows are repeated; others are compared, by the bytes of one of each
    some = hits.where("NOT alike").groupBy("gram", "digest").agg(F.count("*").alias("times"), F.min("row_key").alias("row_key"))
    different = scratch.save(contexts(docs, scratch.save(some, "some")), "different")
    spans = covered(different, scratch)
    single = hits.where("copies IS NULL")
    alike = single.where(f"alike AND least({BACK}, place) + least({LENGTH}, n_bytes - place) >= {LENGTH}")
    alike = alike.selectExpr("row_key", f"CAST(place - least({BACK}, place) AS INT) AS a", f"CAST(place + least({LENGTH}, n_bytes - place) AS INT) AS b")
    per_text = single.where("NOT alike").join(spans, ["gram", "digest"]).selectExpr("row_key", "place + a AS a", "place + b AS b").union(alike)
    per_text = scratch.save(per_text.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans")), "spans")
    scratch.drop("hits", "different", "again", "some")

    shared = spark.sparkContext.broadcast(bit_filter(per_text, "row_key"))

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offs = C.utf8(batch.column("text"))
        key = _row_key(batch.column("doc_id"), _digests(data, offs)[0])
        keep = _passes(shared.value, key)
        return C.record(row_key=key.view(np.int64), text=batch.column("text")).filter(pa.array(keep)) if keep.any() else None

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for key, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw, merged = (text or "").encode(), []
            for s in spans:
                if merged and s["a"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["b"])
                else:
                    merged.append([s["a"], s["b"]])
            sha, at = hashlib.sha256(), 0
            for a, b in merged:
                sha.update(raw[at:a])
                at = b
            sha.update(raw[at:])
            out.append((key, sum(b - a for a, b in merged), len(merged), sha.hexdigest()))
        keys, gone, many, kept = zip(*out, strict=True)
        return C.record(row_key=pa.array(keys, pa.int64()), gone=pa.array(gone, pa.int64()), many=pa.array(many, pa.int64()), kept=pa.array(kept))

    texts = C.arrow_map(docs, pick, "row_key long, text string").join(per_text, "row_key").select("row_key", "text", "spans")
    parts = C.arrow_map(texts, cut, "row_key long, gone long, many long, kept string", "text").dropDuplicates(["row_key"])
    out = signed.select("doc_id", "row_key", "d1", "d2", "n_bytes", "sha").join(classes.select("d1", "d2", "copies"), ["d1", "d2"], "left").join(parts, "row_key", "left")
    everything = F.expr(f"copies > 1 AND n_bytes >= {LENGTH}")
    gone = F.when(everything, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0)))
    return out.select(
        "doc_id", "n_bytes", gone.alias("n_removed"),
        F.when(everything, F.lit(1)).otherwise(F.coalesce("many", F.lit(0))).cast("long").alias("n_spans"),
        F.when(everything, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        (gone > 0).alias("repeats"), (F.col("n_bytes") - gone).alias("n_kept"),
    )


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then whether a document loses bytes (repeats) and how many stay (n_kept)."""
    return removed(C.table(spark, sf_dir, "documents"))
