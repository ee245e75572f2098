"""Hashes, SimHash codes and set similarity as expressions."""

from __future__ import annotations

import hashlib
from itertools import combinations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalized

BITS = 64


def content_hash(text: Column) -> Column:
    """SHA-1 (hex) of the normal form, so that case, punctuation and decomposed letters do not matter."""
    return F.sha1(normalized(text))


def token_hash(token: Column) -> Column:
    """64 bits of a token's MD5, as a bigint."""
    return F.conv(F.substring(F.md5(token), 1, 16), 16, -10).cast("long")  # a negative base gives signed numbers


def blake_hash(token: Column) -> Column:
    """64 bits of a token's BLAKE2b, big-endian, as a bigint; Spark has no such function, so this one runs in Python."""

    @F.pandas_udf("long")
    def hashed(tokens: pd.Series) -> pd.Series:
        one = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=True)
        return tokens.map(lambda t: None if t is None else one(t)).astype("Int64")

    return hashed(token)


def simhash(hashed: Column) -> Column:
    """An aggregate: the 64-bit SimHash of a group's hashes. Bit b is set if more than half of them have it; none give 0.

    Two bits share one sum, so that 32 sums, combined before the shuffle, make a code.
    """
    n, code = F.count(hashed), F.lit(0).cast("long")
    bit = lambda k: F.shiftrightunsigned(hashed, k).bitwiseAND(1)
    for k in range(BITS // 2):
        votes = F.sum(bit(k) + F.shiftleft(bit(k + 32), 32))
        low = F.when(2 * votes.bitwiseAND(0xFFFFFFFF) > n, F.lit(1 << k)).otherwise(F.lit(0))
        high = F.when(2 * F.shiftrightunsigned(votes, 32) > n, F.lit(1 << (k + 32) if k < 31 else -(1 << 63))).otherwise(F.lit(0))
        code = code.bitwiseOR(low.cast("long")).bitwiseOR(high.cast("long"))
    return code


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; two empty sets have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def band(code: Column, number: int, bands: int) -> Column:
    """The number-th of `bands` equal parts of a code."""
    width = BITS // bands
    return F.shiftrightunsigned(code, number * width).bitwiseAND((1 << width) - 1)


def keys_within(code: Column, distance: int, free: int = 3) -> Column:
    """Keys such that codes at most `distance` bits apart share at least one.

    The code is cut into distance + free blocks; of two such codes at least `free` blocks are equal, so every choice
    of `free` blocks is a key. With 3 free blocks and distance 3 a key has half of all bits.
    """
    blocks = distance + free
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    keys = []
    for number, some in enumerate(combinations(range(blocks), free)):
        mask = 0
        for k in some:
            mask |= ((1 << (edges[k + 1] - edges[k])) - 1) << edges[k]
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("choice"), code.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)
