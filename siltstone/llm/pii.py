"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) come from regular expressions; their places are the running lengths of what
`split` leaves and `regexp_extract_all` takes. Looser candidates (local phone numbers, identity numbers, bank account
numbers, long numbers that fail the card check, obfuscated mail addresses) come from one more expression. Five
labelers vote 1, 0 or -1 on each span, base spans included: its form, a gazetteer (top-level domains, issuer,
country and area prefixes), the words before it, the variety of its digits, and other personal data in the text.
Expectation-maximisation over the counts of vote patterns (a bounded table, summed over all spans of the corpus)
estimates each labeler's reliability; the resulting soft labels train the final span classifier, a naive Bayes
model over family, votes and neighbouring characters, which becomes one Spark expression. Candidates that it
accepts are added with their family as kind; base spans stay.

The model of the labelers is identified by two assumptions: none of them is worse than chance (its vote for a span is
at least as likely for true spans as for false ones, its vote against at most), and a span whose form speaks against it
is false unless words before it name it. Such a span is not accepted either.

Work in one text grows with its length and with the number n of its spans as n to the power 1.5 at most: running sums
are made in blocks of about the square root of n, and context is taken from the pieces between matches.

Null or empty texts have no spans. A candidate that overlaps a base span is not added. Without any span the
classifier accepts nothing. Rows are judged one by one, so repeated rows have equal results, and rows with a null doc_id
are judged like others; an empty table gives no rows. Vote patterns that tie are one pattern. Only doc_id and text are
read, so other columns' names do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
#: Families of looser candidates, in the order of the marks that tell them apart.
FAMILIES = ("mail_words", "bank_account", "identity", "local_phone", "number")
ROUNDS = 50
#: Probability from which the classifier accepts a candidate.
ACCEPT = 0.9
#: Characters before a span that its context is taken from.
CONTEXT = 40

# Possessive quantifiers keep Java from backtracking; a match may start only where a run starts or a match has ended.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_EDGE, _END = r"(?<![0-9A-Za-z+@._-])", r"(?![0-9A-Za-z@_-])"
_LOOSE = {
    "mail_words": _EDGE + r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){1,8}",
    "bank_account": _EDGE + r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?" + _END,
    "identity": _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "local_phone": _EDGE + r"(?:\([0-9]{3}\)[\x20-]?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}" + _END,
    "number": _EDGE + r"[0-9](?:[\x20-]?[0-9]){12,18}" + _END,
}
_MAY = {
    "email": "@[A-Za-z0-9-]+\\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "loose": r"[0-9]{3}[-.)\x20]{1,2}[0-9]{2}|[0-9](?:[\x20-]?[0-9]){12}|[A-Z]{2}[0-9]{2}|[\[(]at[\])]",
}

_DOMAINS = "com|org|net|edu|gov|io|de|fr|es|it|nl|uk|us|eu|info|biz|co|at|ch|be|pl|se|no|dk|fi|pt|ca|au|jp|cn|in|br|mx|ru"
_COUNTRIES = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR"
_BEFORE_YES = r"(?:phone|tel|telefon|téléphone|teléfono|call|mobile|handy|cell|fax|contact|kontakt|e-?mail|mail|correo|address|adresse|ip|host|server|card|carte|karte|tarjeta|visa|mastercard|account|konto|compte|cuenta|ssn|social|security|iban|passport|id|number|numéro|nummer|número)\W{0,12}$"
_BEFORE_NO = r"(?:order|invoice|version|isbn|issn|page|pages|volume|vol|chapter|section|article|part|model|serial|build|release|price|total|[$€£#%=])\W{0,3}$"


def _sql(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'" if "'" in text else f"r'{text}'"


_SPAN = "STRUCT<s: INT, e: INT, v: STRING, l: STRING, r: STRING>"


def _bound(value: str, name: str, body: str) -> str:
    """body, in which `name` is the value, computed once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, op: str) -> str:
    """For each element of an array<int> (none negative) what `op` (sum or max) makes of all before it, 0 for the first.

    Blocks of about the square root of the size keep the cost of appending low.
    """
    put = (lambda a, x: f"{a} + {x}") if op == "sum" else (lambda a, x: f"greatest({a}, {x})")
    none = "CAST(array() AS ARRAY<INT>)"

    def within(array: str, start: str) -> str:
        return f"aggregate({array}, named_struct('at', {start}, 'out', {none}), (a, x) -> named_struct('at', {put('a.at', 'x')}, 'out', concat(a.out, array(a.at))), a -> a.out)"

    width = "CAST(ceil(sqrt(size(z))) AS INT)"
    blocks = f"transform(sequence(0, CAST((size(z) - 1) div {width} AS INT)), b -> slice(z, b * {width} + 1, {width}))"
    totals = f"transform(w, b -> aggregate(b, 0, (a, x) -> {put('a', 'x')}))"
    joined = f"flatten(zip_with(w, {within(totals, '0')}, (b, o) -> {within('b', 'o')}))"
    return _bound(values, "z", f"CASE WHEN size(z) = 0 THEN {none} ELSE {_bound(blocks, 'w', joined)} END")


def _found(pattern: str) -> str:
    """The leftmost non-overlapping matches in `text`: where they are, what they are, and what is left and right of them."""
    lists = f"named_struct('p', split(text, {_sql(pattern)}, -1), 'm', regexp_extract_all(text, {_sql(pattern)}, 0))"
    left = f"right(concat(coalesce(get(y.p, i - 1), ''), coalesce(get(y.m, i - 1), ''), get(y.p, i)), {CONTEXT})"
    side = "left(concat(get(y.p, i + 1), coalesce(get(y.m, i + 1), '')), 1)"
    each = _bound(lists, "y", f"transform(y.m, (m, i) -> named_struct('n', length(get(y.p, i)), 'v', m, 'l', {left}, 'r', {side}))")
    starts = _running("transform(q, x -> x.n + length(x.v))", "sum")
    return _bound(each, "q", f"zip_with(q, {starts}, (x, o) -> CAST(named_struct('s', o + x.n, 'e', o + x.n + length(x.v), 'v', x.v, 'l', x.l, 'r', x.r) AS {_SPAN}))")


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _luhn(v: str) -> str:
    """Whether a string of digits passes the Luhn check."""
    digit = f"CAST(substring({v}, length({v}) + 1 - i, 1) AS INT)"
    return f"aggregate(sequence(1, length({v})), 0, (t, i) -> t + CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END) % 10 = 0"


_PASS = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), q -> CASE WHEN length(ltrim('0', q)) <= 3 THEN CAST(concat('0', ltrim('0', q)) AS INT) <= 255 ELSE false END)",
    "card": f"CASE WHEN length({_digits('x.v')}) BETWEEN 14 AND 19 THEN {_luhn(_digits('x.v'))} ELSE false END",
    "phone": f"length({_digits('x.v')}) BETWEEN 10 AND 15",
}


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with one array of spans for each base kind, and the loose candidates."""
    none = f"CAST(array() AS ARRAY<{_SPAN}>)"
    patterns = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE, "loose": "|".join(f"(?:{p})" for p in _LOOSE.values())}
    out = docs.selectExpr("doc_id", "coalesce(text, '') AS text")
    out = out.select("doc_id", "text", *(F.expr(f"CASE WHEN text RLIKE {_sql(_MAY[k])} THEN {_found(p)} ELSE {none} END").alias(f"all_{k}") for k, p in patterns.items()))
    return out.select("doc_id", "text", *(F.expr(f"filter(all_{k}, x -> {_PASS[k]})").alias(k) for k in KINDS), "all_loose")


def _family(v: str) -> str:
    """Which family a loose match is of; the marks exclude one another in the order of FAMILIES."""
    return f"""CASE WHEN {v} RLIKE r'[\\[(]at[\\])]' THEN 'mail_words' WHEN {v} RLIKE '^[A-Z]' THEN 'bank_account'
        WHEN {v} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'identity' WHEN length({_digits(v)}) = 10 THEN 'local_phone' ELSE 'number' END"""


def _votes(x: str) -> str:
    """family:form:gazetteer:context:variety:company:before:after of a span x (s, e, v, l, r, family, base)."""
    v, digits, before = f"{x}.v", _digits(f"{x}.v"), f"lower({x}.l)"
    form = f"""CASE WHEN {x}.base THEN 1 WHEN {x}.family = 'identity' THEN CASE WHEN {v} RLIKE '^(?:000|666|9)|-00-|-0000$' THEN -1 ELSE 1 END
        WHEN {x}.family = 'local_phone' THEN CASE WHEN {v} RLIKE '^[(]?[01]' THEN 0 WHEN {v} RLIKE r'^\\(|([-. ])[0-9]{{3}}\\1' THEN 1 ELSE 0 END
        WHEN {x}.family = 'bank_account' THEN CASE WHEN length(replace({v}, ' ', '')) BETWEEN 15 AND 34 THEN 1 ELSE -1 END
        WHEN {x}.family = 'mail_words' THEN 1 ELSE -1 END"""
    gazetteer = f"""CASE WHEN {x}.family IN ('email', 'mail_words') THEN CASE WHEN lower({v}) RLIKE r'(?:\\.|dot[\\])] ?)(?:{_DOMAINS})$' THEN 1 ELSE 0 END
        WHEN {x}.family IN ('card', 'number') THEN CASE WHEN {digits} RLIKE '^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|62)' THEN 1 ELSE 0 END
        WHEN {x}.family = 'bank_account' THEN CASE WHEN {v} RLIKE '^(?:{_COUNTRIES})' THEN 1 ELSE -1 END
        WHEN {x}.family = 'ip' THEN CASE WHEN {v} RLIKE r'^(?:0|22[4-9]|2[3-5][0-9])\\.' THEN -1 ELSE 0 END
        WHEN {x}.family = 'phone' THEN CASE WHEN {v} RLIKE r'^\\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21|22|23|24|25|26|29|35|37|38|42|50|59|67|68|69|85|88|96|97|99)' THEN 1 ELSE -1 END
        ELSE CASE WHEN {digits} RLIKE '^(?:000|123456789|987654321)' THEN -1 ELSE 0 END END"""
    context = f"CASE WHEN {before} RLIKE {_sql(_BEFORE_YES)} THEN 1 WHEN {before} RLIKE {_sql(_BEFORE_NO)} THEN -1 ELSE 0 END"
    different = f"size(array_distinct(split({digits}, '')))"
    variety = f"CASE WHEN {x}.family IN ('email', 'mail_words') THEN 0 WHEN {different} <= 2 THEN -1 WHEN {different} >= 5 THEN 1 ELSE 0 END"
    company = f"CASE WHEN n_base > CASE WHEN {x}.base THEN 1 ELSE 0 END THEN 1 ELSE 0 END"
    side = lambda at: f"CASE WHEN {at} RLIKE r'^\\s?$' THEN 's' WHEN {at} RLIKE '^[0-9A-Za-z]' THEN 'w' ELSE 'm' END"
    left = f"CASE WHEN {x}.s = 0 THEN 's' ELSE {side(f'right({x}.l, 1)')} END"
    return f"concat_ws(':', {x}.family, {form}, {gazetteer}, {context}, {variety}, {company}, {left}, {side(f'{x}.r')})"


def _free() -> str:
    """Of all spans (`every`, sorted by place) the base spans and those that overlap none: nothing reaches over their start,
    and the next base span starts at their end or later."""
    before = _running("transform(every, x -> CASE WHEN x.base THEN x.e ELSE 0 END)", "max")
    after = _running("transform(reverse(every), x -> CASE WHEN x.base THEN 2147483647 - x.s ELSE 0 END)", "max")
    edges = f"zip_with({before}, reverse({after}), (x, y) -> named_struct('reach', x, 'next', 2147483647 - y))"
    both = f"zip_with(every, {edges}, (x, o) -> CASE WHEN x.base OR (o.reach <= x.s AND o.next >= x.e) THEN x END)"
    return f"filter({both}, x -> x IS NOT NULL)"


def spanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind>, base (sorted spans s, k, e), and spans with their votes; one pass over the texts."""
    rows = base_spans(docs)
    parts = ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))" for i, k in enumerate(KINDS))
    span = lambda family, base: f"named_struct('s', x.s, 'e', x.e, 'v', x.v, 'l', x.l, 'r', x.r, 'family', {family}, 'base', {base})"
    own = ", ".join(f"transform({k}, x -> {span(repr(k), 'true')})" for k in KINDS)
    loose = f"transform(all_loose, x -> {span(_family('x.v'), 'false')})"
    every = f"array_sort(concat({own}, {loose}))"
    rows = rows.select("doc_id", F.expr(f"array_sort(concat({parts}))").alias("base"), *(F.expr(f"CAST(size({k}) AS BIGINT)").alias(f"n_{k}") for k in KINDS), F.expr(every).alias("every"))
    rows = rows.select("*", F.expr("size(base)").alias("n_base"), F.expr(f"CASE WHEN size(base) IN (0, size(every)) THEN every ELSE {_free()} END").alias("free"))
    seen = f"transform(free, x -> named_struct('s', x.s, 'e', x.e, 'family', x.family, 'base', x.base, 'seen', {_votes('x')}))"
    none = "CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, family: STRING, base: BOOLEAN, seen: STRING>>)"
    return rows.select("doc_id", "base", *(f"n_{k}" for k in KINDS), F.expr(f"CASE WHEN size(free) = 0 THEN {none} ELSE {seen} END").alias("spans"))


LABELERS = 5
#: Places of the labelers for form and context among the votes.
FORM, WORDS = 0, 2


def _denied(votes: tuple[int, ...]) -> bool:
    """Whether the form speaks against a span and no words before it speak for it."""
    return votes[FORM] < 0 and votes[WORDS] <= 0


def reliabilities(counts: dict[tuple[int, ...], int]) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over vote patterns: prior, P(vote | true or false) of each labeler, and soft labels."""
    soft = {v: 0.0 if _denied(v) else min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for v in counts}
    prior, tables = 0.5, []
    for _ in range(ROUNDS):
        total = sum(counts.values()) + 2
        prior = (sum(soft[v] * n for v, n in counts.items()) + 1) / total
        tables = []
        for j in range(LABELERS):
            yes, no = {-1: 1.0, 0: 1.0, 1: 1.0}, {-1: 1.0, 0: 1.0, 1: 1.0}
            for v, n in counts.items():
                yes[v[j]] += soft[v] * n
                no[v[j]] += (1 - soft[v]) * n
            a, b = sum(yes.values()), sum(no.values())
            table = {k: (yes[k] / a, no[k] / b) for k in yes}
            if table[1][0] < table[1][1] or table[-1][0] > table[-1][1]:  # worse than chance: its votes say nothing
                table = {k: ((yes[k] + no[k]) / (a + b),) * 2 for k in yes}
            tables.append(table)
        for v in counts:
            if _denied(v):
                continue
            odds = math.log(prior / (1 - prior)) + sum(math.log(tables[j][x][0] / tables[j][x][1]) for j, x in enumerate(v))
            soft[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, tables, soft


def train(counts: dict[str, int]) -> tuple[float, list[dict[str, float]]]:
    """Bias and weights by feature of the span classifier, from the counts of `seen` strings."""
    rows = [(k.split(":"), n) for k, n in counts.items()]
    patterns: dict[tuple[int, ...], int] = {}
    for parts, n in rows:
        v = tuple(int(x) for x in parts[1 : 1 + LABELERS])
        patterns[v] = patterns.get(v, 0) + n
    _, _, soft = reliabilities(patterns)
    yes = no = 1.0
    tables: list[dict[str, list[float]]] = [{} for _ in range(LABELERS + 3)]
    for parts, n in rows:
        p = soft[tuple(int(x) for x in parts[1 : 1 + LABELERS])]
        yes, no = yes + p * n, no + (1 - p) * n
        for table, value in zip(tables, parts, strict=True):
            cell = table.setdefault(value, [0.5, 0.5])
            cell[0] += p * n
            cell[1] += (1 - p) * n
    weights = [{v: math.log((a / (yes + len(t))) / (b / (no + len(t)))) for v, (a, b) in t.items()} for t in tables]
    return math.log(yes / no), weights


def classifier(bias: float, weights: list[dict[str, float]], seen: str = "x.seen") -> str:
    """The classifier as a Spark expression: whether its log-odds reach ACCEPT."""
    terms = [repr(bias) + "D"]
    for j, table in enumerate(weights):
        cases = " ".join(f"WHEN '{v}' THEN {w!r}D" for v, w in sorted(table.items()))
        terms.append(f"(CASE split({seen}, ':')[{j}] {cases} ELSE 0D END)")
    denied = f"split({seen}, ':')[{1 + FORM}] = '-1' AND split({seen}, ':')[{1 + WORDS}] <> '1'"
    return f"NOT ({denied}) AND ({' + '.join(terms)}) >= {math.log(ACCEPT / (1 - ACCEPT))!r}D"


def found(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans for each row of docs."""
    spark = C.tuned(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = C.Scratch(spark, "pii").save(spanned(rows), "spanned")
    counts = rows.select(F.explode("spans.seen").alias("seen")).groupBy("seen").count().collect()  # families * 3**5 * 9 rows at most
    accepted = classifier(*train({r.seen: r["count"] for r in counts})) if counts else "false"
    kinds = "array(" + ", ".join(f"'{k}'" for k in (*KINDS, *FAMILIES)) + ")"
    added = f"transform(filter(spans, x -> NOT x.base AND {accepted}), x -> named_struct('s', x.s, 'k', CAST(array_position({kinds}, x.family) AS INT) - 1, 'e', x.e))"
    rows = rows.select("doc_id", "base", *(f"n_{k}" for k in KINDS), F.expr(added).alias("added"))
    text = f"array_join(transform(%s, x -> concat_ws(':', {kinds}[x.k], x.s, x.e)), ',')"
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS), F.expr("CAST(size(added) AS BIGINT)").alias("n_added"), F.expr(f"sha2({text % 'base'}, 256)").alias("base_sha256"), F.expr(text % "array_sort(concat(base, added))").alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(C.table(spark, sf_dir, "documents"))
