"""Near-duplicates by min-max hashing.

Each of `PERMUTATIONS` hash functions gives both the least and the greatest value of a text's shingle set, so
that half as many hash evaluations fill a signature. Signatures are banded; texts that share a band are
candidates, and a link is confirmed on the two full shingle sets, in the JVM.

Texts with equal sets become one class first (a partial aggregate, no shuffle of texts). The members of a band's
bucket are then compared with one pivot, the member that most others share buckets with. Only in groups whose
members are in several components after that, members are compared with each other: in blocks, by the differences
of their sets from the pivot's, from which the full sets' similarity follows exactly. No pairs are emitted, only
links that join components, so that no link between candidates is lost and no group lands in one task.

A pivot's set meets its members in salted parts of at most about `SHARE` rows, so that a large group is compared by many
tasks; joins with what only large groups have are by a broadcast of checked size.

Null or empty texts have no shingles and link with nothing; an empty table gives no rows. Very long texts are read whole,
one at a time. Columns other than doc_id and text are not read, so their names do not matter. Rows with a null doc_id link with nothing, get a
null component and are kept. Rows that share a doc_id count as one document for links. Ties: the least doc_id
stands for a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

PERMUTATIONS, ROWS = 48, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Members, and elements of their differences from the pivot, that one unit of comparison holds; columns of one matrix product.
BLOCK, ELEMENTS, COLUMNS = 1024, 2_000_000, 2048
#: Members of a group that one part of a salted join has, about; groups with more than one block that are broadcast at most.
SHARE, LARGE_SENT = 500, 100_000
#: Bits of the filter that spares building sets for texts without candidates; its size is fixed, and rows that pass by chance are removed by a join.
FILTER_BITS = 1 << 24

_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), d1 and d2 (a 128-bit digest of the set), bands (hashes of signature bands)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = C.utf8(batch.column("text"))
        value, firsts = K.shingles(K.LOWER[data], offs, words)
        size = np.diff(firsts)
        full = np.flatnonzero(size)
        at = firsts[:-1][full]
        bands = np.zeros((len(size), BANDS), np.uint64)
        d1, d2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        if len(full):
            signature = np.empty((2 * PERMUTATIONS, len(full)), np.uint64)
            for k in range(PERMUTATIONS):
                image = value * _MULTIPLY[k] + _ADD[k]
                signature[2 * k] = np.minimum.reduceat(image, at)
                signature[2 * k + 1] = np.maximum.reduceat(image, at)
            for b in range(BANDS):
                key = np.full(len(full), b + 1, np.uint64)
                for row in signature[b * ROWS : (b + 1) * ROWS]:
                    key = K.mix(key + row)
                bands[full, b] = key
            d1[full], d2[full] = np.add.reduceat(value, at), np.add.reduceat(K.mix(value + np.uint64(99)), at)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64)))
        return C.record(doc_id=batch.column("doc_id"), n=size, d1=d1.view(np.int64), d2=d2.view(np.int64), bands=lists)

    C.tuned(docs.sparkSession)
    return C.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """doc_id and its shingle set, for the doc_id in `wanted` (column rep, distinct)."""
    spark, mask = docs.sparkSession, FILTER_BITS - 1
    bits = wanted.select(F.explode(F.array(*(F.xxhash64("rep", F.lit(s)).bitwiseAND(mask) for s in (1, 2)))).alias("bit"))
    bits = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("mask"))
    found = bits.toPandas()
    table = np.zeros(FILTER_BITS >> 6, np.int64)
    table[found["at"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(table)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        table = shared.value
        inside = np.ones(batch.num_rows, bool)
        for name in ("h1", "h2"):
            bit = batch.column(name).to_numpy() & mask
            inside &= (table[bit >> 6] >> (bit & 63)) & 1 == 1
        if not inside.any():
            return None
        batch = batch.filter(pa.array(inside))
        data, offs = C.utf8(batch.column("text"))
        value, firsts = K.shingles(K.LOWER[data], offs, words)
        return C.record(rep=batch.column("doc_id"), shingles=pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(value.view(np.int64))))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("doc_id", "text", *(F.xxhash64("doc_id", F.lit(s)).alias(f"h{s}") for s in (1, 2)))
    return C.arrow_map(rows, work, "rep long, shingles array<long>").join(wanted, "rep")


def components(edges: DataFrame, scratch: C.Scratch, tag: str) -> DataFrame:
    """node and comp, the least node of its component, by alternating large-star and small-star rounds."""

    now = scratch.save(edges.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), f"{tag}-0")
    count, k = now.count(), 0
    while count:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        k += 1
        before, now = now, scratch.save(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), f"{tag}-{k}")
        count, last = now.count(), count
        # two sets of as many edges, one within the other, are equal
        done = count == last and now.join(before, ["hi", "lo"], "left_anti").isEmpty()
        scratch.drop(f"{tag}-{k - 1}")
        if done:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))


def _sides(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (p, x) with both shingle sets. A p with many x is dealt out by a salt of x; its set goes to the parts that
    have a pair, and to no others."""
    most = pairs.groupBy("p").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-most // SHARE))
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(salts)))
    p = sets.select(F.col("rep").alias("p"), F.col("shingles").alias("sp"))
    x = sets.select(F.col("rep").alias("x"), F.col("shingles").alias("sx"))
    if salts > 1:
        p = pairs.select("p", "salt").distinct().join(p, "p")
    else:
        p = p.withColumn("salt", F.lit(0).cast("long"))
    return pairs.join(x, "x").join(p, ["p", "salt"]).drop("salt")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, x) whose full sets have a Jaccard similarity of percent or more."""
    both = _sides(pairs, sets).withColumn("common", F.size(F.array_intersect("sp", "sx")).cast("long"))
    return both.where(f"100 * common >= {int(percent)} * (size(sp) + size(sx) - common)").select("p", "x")


def _compare_block(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links that join components. rows: (x, n, comp, side, diff); sides 0 and 1 are compared with each other, 2 with all.

    With D = the difference of a member's set from the pivot's, |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|, so that the full
    sets' similarity follows exactly from the differences.
    """
    names = {}
    root = [names.setdefault(r[2], len(names)) for r in rows]
    parent = list(range(len(names)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    size = np.array([r[1] for r in rows], np.int64)
    side = np.array([r[3] for r in rows])
    many = np.array([len(r[4]) for r in rows], np.int64)
    flat = np.concatenate([np.asarray(r[4], np.int64) for r in rows])
    owner = np.repeat(np.arange(len(rows)), many)
    _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[code] > 1
    owner, (_, code) = owner[shared], np.unique(code[shared], return_inverse=True)
    common = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    last = int(code[-1]) + 1 if len(code) else 0
    for first in range(0, last, COLUMNS):
        a, b = np.searchsorted(code, [first, first + COLUMNS])
        part = np.zeros((len(rows), min(COLUMNS, last - first)), np.float32)
        part[owner[a:b], code[a:b] - first] = 1
        common += part @ part.T
    apart = many[:, None] + many[None, :] - 2 * common.astype(np.int64)
    total = size[:, None] + size[None, :]
    inside = (total - apart) // 2
    linked = 100 * inside >= percent * (total - inside)
    linked &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        if (u := find(root[i])) != (v := find(root[j])):
            parent[u] = v
            out.append((rows[i][0], rows[j][0]))
    return out


def compared(groups: DataFrame, scratch: C.Scratch, percent: int) -> DataFrame:
    """Links (hi, lo) between members of different components in a pivot's group.

    groups: p, x, n, comp, diff. A group with more than `BLOCK` members or `ELEMENTS` elements is cut into blocks, and
    each pair of blocks is a unit of its own. Units give the links that join components, not pairs.
    """
    sizes = groups.groupBy("p").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.size("diff").cast("long")) / ELEMENTS)).alias("blocks"))
    large = scratch.save(sizes.where("blocks > 1"), "large")
    large = F.broadcast(large) if large.count() <= LARGE_SENT else large
    rows = groups.join(large, "p", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("x"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    rows = rows.select("p", "x", "n", "comp", "diff", "at", other)
    rows = rows.selectExpr("p", "least(at, other) AS i", "greatest(at, other) AS j", "x", "n", "comp", "CASE WHEN at = other THEN 2 WHEN at < other THEN 0 ELSE 1 END AS side", "diff")

    def run(batches):
        held: list[tuple] = []
        unit, out = None, []

        def flush() -> None:
            if len(held) > 1:
                out.extend(_compare_block(held, percent))
            held.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("p", "i", "j", "x", "n", "comp", "side")]
            diffs = batch.column("diff")
            flat, at = diffs.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(diffs).to_numpy())])
            for k, (p, i, j, *rest) in enumerate(zip(*columns, strict=True)):
                if (p, i, j) != unit:
                    flush()
                    unit = (p, i, j)
                held.append((*rest, flat[at[k] : at[k + 1]]))
        flush()
        if out:
            hi, lo = zip(*((max(u, v), min(u, v)) for u, v in out), strict=True)
            yield C.record(hi=pa.array(hi, pa.int64()), lo=pa.array(lo, pa.int64()))

    return rows.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j").mapInArrow(run, "hi long, lo long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; links have Jaccard similarity of percent or more."""
    spark, percent = docs.sparkSession, int(percent)
    scratch = C.Scratch(spark, "minhash")
    signed = scratch.save(signatures(docs, words), "signed")
    classes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    classes = scratch.save(classes, "classes")
    rows = signed.join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"]).where("doc_id = rep")
    keys = rows.select("rep", "n", F.explode("bands").alias("key"))
    crowded = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key", "c")
    members = scratch.save(keys.join(crowded, "key").select("key", "rep", "n", "c"), "members")
    # the pivot of a bucket is its member that shares most buckets with most others: the text that copies were made of
    central = scratch.save(members.groupBy("rep").agg(F.sum("c").alias("score")), "central")
    pivots = members.join(central, "rep").groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("r"), "n")).alias("v"))
    groups = members.select("key", F.col("rep").alias("x"), "n").join(pivots.select("key", (-F.col("v.r")).alias("p"), F.col("v.n").alias("np")), "key")
    groups = scratch.save(groups.where("p <> x").select("p", "np", "x", "n").distinct(), "groups")
    sets = scratch.save(shingle_sets(docs, central.select("rep"), words), "sets")

    alike = groups.where(f"100 * least(n, np) >= {percent} * greatest(n, np)").select("p", "x")
    links = scratch.save(confirmed(alike, sets, percent).select(F.col("x").alias("hi"), F.col("p").alias("lo")), "links")
    comps = components(links, scratch, "stars")
    # groups whose members are of several components: all of these are compared with each other
    placed = groups.join(comps, F.col("x") == F.col("node"), "left").select("p", "x", "n", F.coalesce("comp", "x").alias("comp"))
    placed = scratch.save(placed, "placed")
    several = placed.groupBy("p").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("p")
    several = scratch.save(several, "several")
    hint = F.broadcast(several) if several.count() <= C.IDS_SENT else several
    open_ = scratch.save(placed.join(hint, "p").select("p", "x", "n", "comp"), "open")
    if not open_.isEmpty():
        diff = F.concat(F.array_except("sp", "sx"), F.array_except("sx", "sp"))
        apart = scratch.save(_sides(open_, sets).select("p", "x", "n", "comp", diff.alias("diff")), "apart")
        more = scratch.save(compared(apart, scratch, percent), "more")
        comps = components(links.union(more), scratch, "all")
    scratch.drop("members", "central", "groups", "sets", "placed", "open", "several", "apart", "large")
    named = classes.join(comps, F.col("rep") == F.col("node"), "left").select("d1", "d2", "n", F.coalesce("comp", "rep").alias("comp"))
    out = signed.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stand for their group. Of rows that share a doc_id one stays; null doc_ids all stay."""
    scratch = C.Scratch(docs.sparkSession, "one")
    judged = scratch.save(near_duplicates(docs, words, percent).select("doc_id", "kept"), "judged")
    kept = C.without(docs, judged.where("NOT kept").select("doc_id"))
    twice = scratch.save(judged.where("doc_id IS NOT NULL AND kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    once = kept.join(twice.withColumnRenamed("doc_id", "__twice"), kept["doc_id"].cast("long") == F.col("__twice"), "left_semi").dropDuplicates(["doc_id"])
    return C.without(kept, twice).unionByName(once)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"), words=3, percent=85)
