"""Parts of the SQL (DuckDB) that the queries' results are held against."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.text import STOP_WORDS

_CLASS = r"[^\p{L}\p{N}_]+"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

NORM = f"trim(regexp_replace(lower(coalesce(text, '')), '{_CLASS}', ' ', 'g'))"
WORDS = f"list_filter(string_split({NORM}, ' '), lambda w: w <> '')"
TOKENS = f"list_filter(string_split({NORM}, ' '), lambda w: w <> '' AND w NOT IN ({_STOP}))"
WORD_COUNT = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))::BIGINT"


def fold(column: str) -> str:
    return f"replace(replace(strip_accents(coalesce({column}, '')), 'đ', 'd'), 'Đ', 'D')"


def syllables(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"


SYLLABLES = syllables("coalesce(text, '')")


def grams(tokens: str, n: int) -> str:
    joined = f"array_to_string(list_slice(t, i, i + {n - 1}), ' ')"
    return f"""(SELECT CASE WHEN len(t) = 0 THEN []::VARCHAR[] WHEN len(t) < {n} THEN [array_to_string(t, ' ')]
        ELSE list_distinct(list_transform(range(1, len(t) - {n - 2}), lambda i: {joined})) END FROM (SELECT {tokens} AS t))"""


def _codes() -> str:
    sums = ", ".join(f"sum((lo >> {k}) & 1) AS l{k}, sum((hi >> {k}) & 1) AS h{k}" for k in range(32))
    bits = " + ".join(f"CASE WHEN 2 * coalesce(l{k}, 0) > n THEN {1 << k}::HUGEINT ELSE 0 END + CASE WHEN 2 * coalesce(h{k}, 0) > n THEN {1 << (k + 32)}::HUGEINT ELSE 0 END" for k in range(32))
    return f"""WITH g AS (SELECT doc_id, unnest({grams(TOKENS, 5)}) AS gram FROM documents), h AS (SELECT doc_id, ('0x' || substr(md5(gram), 9, 8))::BIGINT AS lo, ('0x' || substr(md5(gram), 1, 8))::BIGINT AS hi FROM g),
    votes AS (SELECT d.doc_id, count(lo) AS n, {sums} FROM documents d LEFT JOIN h USING (doc_id) GROUP BY 1), wide AS (SELECT doc_id, {bits} AS u FROM votes),
    codes AS (SELECT doc_id, (CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END)::BIGINT AS code FROM wide)"""


CODES = _codes()

GOLD = "gold AS (SELECT item_id AS query_id, doc_id AS article_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def index(tokens: str, p: str = "") -> str:
    return f"""{p}lists AS (SELECT doc_id AS article_id, {tokens} AS t FROM documents), {p}postings AS (SELECT article_id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT article_id, len(t) AS dl, unnest(t) AS term FROM {p}lists) GROUP BY 1, 2),
    {p}terms AS (SELECT term, count(*) AS df FROM {p}postings GROUP BY 1), {p}totals AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_length FROM {p}lists)"""


def query_terms(tokens: str, p: str = "") -> str:
    return f"""{p}asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({tokens}) AS term FROM benchmark) GROUP BY 1, 2),
    {p}matches AS (SELECT query_id, article_id, term, qtf, tf, dl, mean_length, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf FROM {p}asked JOIN {p}postings USING (term) JOIN {p}terms USING (term), {p}totals)"""


def run(name: str, tokens: str = TOKENS, p: str = "", k1: float = 0.6, b: float = 0.9) -> str:
    """A run of all matching documents, as a table of that name."""
    return f"""{index(tokens, p)}, {query_terms(tokens, p)}, {p}scored AS (SELECT query_id, article_id, round(sum(qtf * idf * tf / (tf + {k1} * (1 - {b} + {b} * dl / mean_length))), 6) AS score FROM {p}matches GROUP BY 1, 2),
    {name} AS (SELECT query_id, article_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id)::INTEGER AS rank FROM {p}scored)"""


NEAREST = """dots AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, v.label::BIGINT AS article_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
    nearest AS (SELECT * FROM dots QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= 500)"""


def pooled(how: str) -> str:
    return f""", p AS (SELECT query_id, article_id, round({how}(score), 6) AS score FROM nearest GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id)::INTEGER AS rank FROM p)
    SELECT query_id, article_id, score, rank FROM r WHERE rank <= 10"""


#: article_id, chunk_no, text: clauses start at numbered lines; short ones are packed into 180 words, long ones cut into windows.
CHUNKS = r"""lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n, len(l) AS total FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
    cut AS (SELECT doc_id, n, list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '') AS w, sum(CASE WHEN regexp_matches(line, '^\s*[0-9]{1,2}\.\s') OR (n < total AND regexp_matches(line, '^\s*[0-9]{1,2}\.$')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM lines),
    clause AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS k, w FROM (SELECT doc_id, g, flatten(list(w ORDER BY n)) AS w FROM cut GROUP BY 1, 2) WHERE len(w) > 0),
    walk AS (SELECT doc_id, 0::BIGINT AS k, []::VARCHAR[][] AS done, []::VARCHAR[] AS open FROM documents UNION ALL
    SELECT c.doc_id, c.k, CASE WHEN len(w) <= 180 AND len(open) + len(w) <= 180 THEN done ELSE list_concat(done, CASE WHEN len(open) > 0 THEN [open] ELSE [] END, CASE WHEN len(w) > 180
        THEN list_transform(range(0, ceil((len(w) - 180) / 140)::BIGINT + 1), lambda i: list_slice(w, i * 140 + 1, i * 140 + 180)) ELSE [] END) END,
        CASE WHEN len(w) > 180 THEN [] WHEN len(open) + len(w) <= 180 THEN list_concat(open, w) ELSE w END
    FROM walk JOIN clause c ON c.doc_id = walk.doc_id AND c.k = walk.k + 1),
    found AS (SELECT doc_id, CASE WHEN len(open) > 0 THEN list_append(done, open) ELSE done END AS f FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1),
    listed AS (SELECT doc_id, CASE WHEN len(f) > 0 THEN list_transform(f, lambda w: trim(coalesce(source, '') || '. ' || array_to_string(w, ' '))) WHEN coalesce(source, '') <> '' THEN [source] ELSE [doc_id::VARCHAR] END AS t FROM found JOIN documents USING (doc_id)),
    chunks AS (SELECT doc_id AS article_id, (generate_subscripts(t, 1) - 1)::INTEGER AS chunk_no, unnest(t) AS text FROM listed)"""

KS = (1, 5, 10, 20)
MEASURES = tuple(f"{m}_{k}" for k in KS for m in ("recall", "mrr", "ndcg", "f2"))


def measures(run_name: str, name: str = "measured") -> str:
    found = ", ".join(f"count(*) FILTER (rank <= {k}) AS n{k}, min(rank) FILTER (rank <= {k}) AS f{k}, sum(1 / log2(rank + 1)) FILTER (rank <= {k}) AS d{k}" for k in KS)
    out = ", ".join(
        f"""coalesce(n{k}, 0) / n_gold AS recall_{k}, coalesce(1 / f{k}, 0) AS mrr_{k}, coalesce(d{k}, 0) / list_sum(list_transform(range(1, least(n_gold, {k}) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_{k},
        CASE WHEN coalesce(n{k}, 0) = 0 THEN 0 ELSE 5 * (n{k} / {k}) * (n{k} / n_gold) / (4 * (n{k} / {k}) + n{k} / n_gold) END AS f2_{k}"""
        for k in KS
    )
    return f"""{name}_z AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1), {name}_h AS (SELECT query_id, {found} FROM {run_name} JOIN gold USING (query_id, article_id) WHERE rank <= 100 GROUP BY 1),
    {name} AS (SELECT query_id, n_gold, {out} FROM {name}_z LEFT JOIN {name}_h USING (query_id))"""


def rounded(digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in MEASURES)


def averaged(digits: int, columns: Sequence[str] = MEASURES) -> str:
    return ", ".join(f"round(avg({c}), {digits}) AS {c}" for c in columns)
