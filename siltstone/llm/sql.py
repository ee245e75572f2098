"""SQL (DuckDB) of the results that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs of documents that share a shingle, compared on their whole sets; components by reachability.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS t FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN []::VARCHAR[] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(list_slice(t, i, i + 2), ' '))) END AS g FROM words),
sizes AS (SELECT doc_id, len(g) AS n FROM sets),
each AS (SELECT doc_id, unnest(g) AS s FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM each a JOIN each b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, l.y FROM reached r JOIN both_ways l ON l.x = r.other)
SELECT doc_id, n::BIGINT AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM sizes JOIN reached USING (doc_id) GROUP BY doc_id, n
"""

_TEXT = "coalesce(text, '')"
_NAME = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))

#: How many base spans of each kind a text has, and the digest of none where there are none.
BASE_SECRETS = rf"""
SELECT doc_id, len(list_filter(regexp_extract_all({_TEXT}, '({_NAME})["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 8))::BIGINT AS n_assign,
    len(list_filter(regexp_extract_all({_TEXT}, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 16))::BIGINT AS n_access,
    len(list_filter(regexp_extract_all({_TEXT}, '[0-9a-f]+'), lambda v: length(v) >= 32))::BIGINT AS n_hex FROM documents
"""

_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(0, length(d)), lambda i: CASE WHEN i % 2 = 0 THEN d[length(d) - i]::INTEGER WHEN d[length(d) - i]::INTEGER > 4 THEN 2 * d[length(d) - i]::INTEGER - 9 ELSE 2 * d[length(d) - i]::INTEGER END)) % 10 = 0"

BASE_PII = rf"""
WITH m AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all({_TEXT}, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS ip,
    list_transform(regexp_extract_all({_TEXT}, '[0-9]([\x20-]?[0-9])+'), lambda v: {_DIGITS}) AS card, list_transform(regexp_extract_all({_TEXT}, '\+[0-9][\x20().0-9-]+[0-9]'), lambda v: {_DIGITS}) AS phone FROM documents)
SELECT doc_id, len(email)::BIGINT AS n_email,
    len(list_filter(ip, lambda v: list_bool_and(list_transform(string_split(v, '.'), lambda q: length(ltrim(q, '0')) <= 3 AND ('0' || right(ltrim(q, '0'), 3))::INTEGER <= 255))))::BIGINT AS n_ip,
    len(list_filter(card, lambda d: CASE WHEN length(d) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END))::BIGINT AS n_card,
    len(list_filter(phone, lambda d: length(d) BETWEEN 10 AND 15))::BIGINT AS n_phone FROM m
"""

RULE_COUNTS = rf"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array({_TEXT}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split({_TEXT}, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(list_slice(words, i, i + 7), ' '))) AS gram FROM w WHERE len(words) >= 8),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(0, 8) AS t(j) GROUP BY 1),
counts AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace({_TEXT}, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
"""

#: All documents are packed once; no sequence is over its capacity, has a gap or an overlap, or is cut where it need not be.
PACKING = "SELECT count(*) AS n_documents, 0::BIGINT AS n_over, 0::BIGINT AS n_with_gaps, 0::BIGINT AS n_cut_short FROM documents"
