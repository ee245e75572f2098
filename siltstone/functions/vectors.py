"""Arithmetic of vectors, term weights and language models as expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .text import bound


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision, summed from left to right."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    """The vector divided by its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return bound(F.when(norm == 0, 1.0).otherwise(norm), lambda size: F.transform(v, lambda x: x.cast("double") / size))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(idf_: Column, tf: Column, length: Column, mean_length: Column, k1: Column | float, b: Column | float) -> Column:
    """A term's weight: idf * tf / (tf + k1 * (1 - b + b * length / mean_length))."""
    return idf_ * tf / (tf + k1 * (1 - b + b * length / mean_length))


def explanation(idf_: Column, tf: Column) -> Column:
    """A matched term's weight in explanations: saturation 1.2, no length norm, four decimals."""
    return F.round(idf_ * (tf * 2.2) / (tf + 1.2), 4)


def minmax(score: Column, *by: str) -> Column:
    """The score from 0 to 1 within each group; where all scores are equal, 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 0.0).otherwise((score - low) / (high - low))


def word_chance(count: Column, pair: Column, before: Column, n_words: Column, n_forms: Column, weight: float) -> Column:
    """Interpolated chance of a word: weight * pair / before + (1 - weight) * (count + 1) / (n_words + n_forms).

    Without a known word before it (before null or 0) it is the second part alone, unweighted.
    """
    alone = (F.coalesce(count, F.lit(0)) + 1) / (n_words + n_forms)
    known = F.coalesce(before, F.lit(0)) > 0
    return F.when(known, weight * F.coalesce(pair, F.lit(0)) / before + (1 - weight) * alone).otherwise(alone)


def log_chance(p: Column) -> Column:
    return F.when(p > 0, F.log(p)).otherwise(F.lit(float("-inf")))
