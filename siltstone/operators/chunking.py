"""Cutting articles into overlapping chunks along numbered clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound

#: Words of a chunk, and words that the windows of one long clause share.
CHUNK_WORDS, CHUNK_OVERLAP = 180, 40


def clauses(text: Column | str) -> Column:
    """The text cut before every "1. " to "99. " at its start or after a line break; trimmed, blanks dropped."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    cut = F.split(text, r"(?:(?<=\n)|^)\s*(?=[0-9]{1,2}\.\s)")
    trimmed = F.transform(cut, lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda c: c != "")


def windows(parts: Column, most: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Arrays of words: short clauses are packed while `most` words suffice; a longer one closes what is open and is
    cut into windows that overlap, the last of which reaches its end."""
    step = max(1, most - overlap)
    none = F.array().cast("array<array<string>>")
    nothing = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), nothing.alias("open"))

    def closed(state: Column) -> Column:
        return F.when(F.size(state["open"]) > 0, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])

    def take(state: Column, clause: Column) -> Column:
        return bound(F.filter(F.split(clause, r"\s+"), lambda w: w != ""), lambda found: merged(state, found))

    def merged(state: Column, found: Column) -> Column:
        size = F.size(found)
        count = F.when(size > most, F.ceil((size - most) / step).cast("int") + 1).otherwise(1)
        slid = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(found, i * step + 1, most))
        long = F.struct(F.concat(closed(state), slid).alias("done"), nothing.alias("open"))
        packed = F.struct(state["done"].alias("done"), F.concat(state["open"], found).alias("open"))
        fresh = F.struct(closed(state).alias("done"), found.alias("open"))
        return F.when(size > most, long).when(F.size(state["open"]) + size <= most, packed).otherwise(fresh)

    return F.aggregate(parts, start, take, closed)


def chunks(articles: DataFrame, most: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, limit: int | None = None) -> DataFrame:
    """chunk_id "<article_id>#<n>", article_id, chunk_no, text: "<title>. <words>" for each window of each article.

    An article without words has its title as its only chunk, or its id where the title is empty too. `limit` keeps
    the first windows of each article; None keeps all.
    """
    found = windows(clauses("text"), most, overlap)
    found = F.slice(found, 1, limit) if limit else found
    title = F.regexp_replace(F.coalesce("title", F.lit("")), r"^\s+|\s+$", "")
    made = F.transform(found, lambda w: F.trim(F.concat(title, F.lit(". "), F.array_join(w, " "))))
    texts = F.when(F.size(found) > 0, made).otherwise(F.array(F.when(title != "", title).otherwise(F.col("article_id").cast("string"))))
    rows = articles.select("article_id", F.posexplode(texts).alias("chunk_no", "text"))
    return rows.select(F.concat(F.col("article_id").cast("string"), F.lit("#"), F.col("chunk_no").cast("string")).alias("chunk_id"), "article_id", "chunk_no", "text")
