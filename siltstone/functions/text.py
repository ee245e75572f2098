"""Text expressions: normal form, tokens, n-grams, accent folding, ids, snippets.

All are Column -> Column and stay in the JVM. A null text counts as the empty text unless a function says otherwise.
Word characters are letters, digits and the underscore in Unicode's sense, the same in Spark and in DuckDB.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"

# Stop words of the search index, Vietnamese; compounds are joined by an underscore.
STOP_WORDS = tuple(
    """
và với của cho về từ tại theo trong ngoài trên dưới ra vào lên xuống
là làm có không chưa đã đang sẽ vẫn còn rồi
này kia đó ấy nào đâu gì ai sao
một hai các những mọi từng mỗi cả tất_cả
thì mà nên nếu tuy nhưng hoặc hay cùng
khi lúc sau trước nay giờ
ta tôi bạn họ nó mình chúng_ta chúng_tôi
rất khá hơi lắm quá
việc điều_kiện_này cái con chiếc
để do bởi vì nhằm
ạ à ơi nhé nhỉ
""".split()
)


def _of(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once a row however often it is used, in lambdas too."""
    return F.transform(F.array(value), use)[0]


@cache
def _nfc():
    """One function for all plans, so that equal plans stay equal and share their exchanges."""

    @F.pandas_udf("string")
    def nfc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))

    return nfc


def composed(text: Column | str) -> Column:
    """Unicode normal form C. Only texts that hold a combining mark go to Python (null goes for the others); Spark has no
    built-in form. Not for use within lambdas."""
    text = _of(text)
    marked = text.rlike(r"\p{M}")
    return F.when(marked, _nfc()(F.when(marked, text))).otherwise(text)


def normalized(text: Column | str) -> Column:
    """Composed and in lower case; every run of other than word characters becomes one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(composed(text)), NOT_WORD, " "))


def words(text: Column | str) -> Column:
    """The words of the normal form, in order; an empty text has none."""
    return F.filter(F.split(F.lower(composed(text)), NOT_WORD), lambda w: w != "")


def tokens(text: Column | str, stop: Iterable[str] = STOP_WORDS, segment=None) -> Column:
    """Words that are no stop words. `segment` (Column -> Column) may join compounds of the raw text first."""
    raw = segment(composed(text)) if segment else composed(text)
    unwanted = ["", *sorted(stop)]
    return F.filter(F.split(F.lower(raw), NOT_WORD), lambda w: ~w.isin(unwanted))


def segmenter(compounds: Iterable[str]):
    """A segmenter (Column -> Column) that joins known compounds by underscores, longer ones first, in any case.

    For dictionaries of some hundred entries; a trained segmenter has the same form.
    """
    import re

    known = sorted({tuple(c.split()) for c in compounds if len(c.split()) > 1}, key=lambda c: (-len(c), c))

    def joined(text: Column) -> Column:
        for compound in known:
            pattern = r"(?iu)(?<![\p{L}\p{N}_])" + r"\s+".join(f"({re.escape(w)})" for w in compound) + r"(?![\p{L}\p{N}_])"
            text = F.regexp_replace(text, pattern, "_".join(f"${k}" for k in range(1, len(compound) + 1)))
        return text

    return joined


def syllables(text: Column | str) -> Column:
    """Word runs of the composed, lower-cased text; stop words stay."""
    return F.regexp_extract_all(F.lower(composed(text)), F.lit(f"({WORD})"), 1)


def ngrams(items: Column, n: int) -> Column:
    """The set of n-grams, in order of first occurrence; fewer than n items are one gram, none have none."""

    def grams(t: Column) -> Column:
        several = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        few = F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(t, " ")))
        return F.when(F.size(t) < n, few).otherwise(F.array_distinct(several))

    return bound(items, grams)


@cache
def fold_table() -> tuple[str, str]:
    """Letters that lose their marks, and what remains of them: from Unicode's decompositions of one base letter."""
    source, target = [], []
    for code in range(0xC0, sys.maxunicode + 1 if sys.maxunicode < 0x3000 else 0x3000):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        plain = unicodedata.normalize("NFC", plain)
        if plain != chr(code) and len(plain) == 1:
            source.append(chr(code))
            target.append(plain)
    source += "đĐ"
    target += "dD"
    return "".join(source), "".join(target)


def folded(text: Column | str) -> Column:
    """The text without accents; case stays."""
    source, target = fold_table()
    return F.regexp_replace(F.translate(_of(text), source, target), r"\p{Mn}", "")


def accented(text: Column | str) -> Column:
    """Whether folding changes the text."""
    return folded(text) != _of(text)


def folded_syllables(text: Column | str) -> Column:
    return syllables(folded(text))


def parts(text: Column | str) -> Column:
    """Alternating runs of other characters and of word characters, from the first on; joined they are the text."""
    return F.regexp_extract_all(_of(text), F.lit(rf"({WORD}|{NOT_WORD})"), 1)


def recased(restored: Column, original: Column) -> Column:
    """`restored` in the case of `original`: all capitals (if longer than one), first capital, or lower."""
    capitals = (F.upper(original) == original) & (F.lower(original) != original) & (F.length(original) > 1)
    first = F.substring(original, 1, 1)
    initial = (F.upper(first) == first) & (F.lower(first) != first)
    titled = F.concat(F.upper(F.substring(restored, 1, 1)), F.substring(restored, 2, 1 << 30))
    return F.when(capitals, F.upper(restored)).when(initial, titled).otherwise(F.lower(restored))


def half_stripped(text: Column | str, key: Column, seed: int = 42, percent: int = 50) -> Column:
    """The text with about `percent` of its words folded; which ones follows from seed, key (an integer) and place alone."""
    base = F.pmod(key, F.lit(65521)).cast("long") * 31 + seed

    def chance(i: Column) -> Column:
        """The middle bits of a multiplicative hash; all products stay below 2**63."""
        product = (base + i % 65521) * F.lit(2654435761).cast("long")
        return F.shiftright(F.pmod(product, F.lit(1 << 32)), 16) % 100 < percent

    return F.array_join(F.transform(parts(text), lambda p, i: F.when(chance(i), folded(p)).otherwise(p)), "")


def article_id(name: Column | str) -> tuple[Column, Column]:
    """Document part and number of `<document>+<number>`, cut at the last plus sign; anything else raises on action."""
    name = F.col(name) if isinstance(name, str) else name
    fits = name.rlike(r"^[\s\S]*\+[0-9]+$")
    bad = F.raise_error(F.concat(F.lit("not an article id: "), F.coalesce(name, F.lit("null"))))
    number = F.regexp_extract(name, r"\+([0-9]+)$", 1)
    return F.when(fits, F.regexp_extract(name, r"^([\s\S]*)\+[0-9]+$", 1)).otherwise(bad), F.when(fits, number.cast("int")).otherwise(bad.cast("int"))


def article_of(chunk: Column | str) -> Column:
    """The article of a chunk id `<article>#<number>`, cut at the last mark; without one it raises on action."""
    chunk = F.col(chunk) if isinstance(chunk, str) else chunk
    bad = F.raise_error(F.concat(F.lit("not a chunk id: "), F.coalesce(chunk, F.lit("null"))))
    return F.when(chunk.contains("#"), F.regexp_extract(chunk, r"^([\s\S]*)#[^#]*$", 1)).otherwise(bad)


def word_count(text: Column | str) -> Column:
    """Number of runs without white space."""
    return F.size(F.filter(F.split(_of(text), r"\s+"), lambda w: w != "")).cast("long")


def snippet(text: Column | str, title: Column | None = None, limit: int = 600) -> Column:
    """The text without a leading "<title>. "; if over `limit` characters, cut at its last space and " ..." added."""
    body = _of(text)
    if title is not None:
        lead = F.concat(_of(title), F.lit(". "))
        body = F.when(body.startswith(lead), F.substr(body, F.length(lead) + 1)).otherwise(body)
    cut = F.substring(body, 1, limit)
    whole = F.when(cut.contains(" "), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(body) > limit, F.concat(whole, F.lit(" ..."))).otherwise(body)


def listed(terms: Column, most: int = 6, none: str = "(no matching word)") -> Column:
    """The first terms (structs of term and score) as "term (score), ..."."""
    shown = F.transform(F.slice(terms, 1, most), lambda t: F.concat(t["term"], F.lit(" ("), F.call_function("format_number", t["score"], F.lit("0.####")), F.lit(")")))
    return F.when(F.size(terms) == 0, F.lit(none)).otherwise(F.array_join(shown, ", "))
