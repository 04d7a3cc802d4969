"""What SQL can say of the training-data queries, for DuckDB over the same tables.

Not here: merges, compression, exchange clustering, gradient steps and 64-bit hashes, so
queries 2, 3, 6, 7, 9, 10 and the pipeline are held against brute force in the tests.
"""

from __future__ import annotations

import math

from .quality_rules import FUNCTION_WORDS, PRIOR, SMOOTH, STARTS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"

OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS other FROM d)
SELECT page_id::BIGINT AS page_id, payload_bytes, payload_digest, CASE WHEN other <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN other <> page_id THEN other END::BIGINT AS refers_to FROM m"""

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(top, doc_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.top, ways.b FROM reach r JOIN ways ON ways.a = r.doc_id WHERE ways.b > r.top)
SELECT d.doc_id::BIGINT AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c::BIGINT AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(top) AS c FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id"""

OP8 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
spots AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT k FROM p) WHERE i + k - 1 <= len(w)),
h AS (SELECT doc_id, i, spots.k, item_id FROM spots JOIN p ON p.k = spots.k AND p.win = spots.win),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id"""


def _op5(steps: int = 200) -> str:
    """Counts, votes and the estimation, a row of a recursive table for each step."""
    good, bad = ([s[v][k] for s in STARTS.values() for v in (-1, 0, 1)] for k in (0, 1))
    places = range(len(good))
    listed = lambda xs: "[" + ", ".join(map(str, xs)) + "]"
    logit = f"list_sum(list_transform(votes, lambda v: CASE WHEN v % 3 = 1 THEN 0.0::DOUBLE ELSE ln(good[v + 1] / bad[v + 1]) END)) + {math.log(PRIOR / (1 - PRIOR))!r}::DOUBLE"
    sums = ", ".join(f"coalesce(sum(n * p) FILTER (list_contains(votes, {v})), 0) AS g{v}, coalesce(sum(n) FILTER (list_contains(votes, {v})), 0) AS a{v}" for v in places)
    weight = f"({SMOOTH} * total + 1)"
    new_good = ", ".join(f"(g{v} + {weight} * {x!r}::DOUBLE) / (g0 + g1 + g2 + {weight})" for v, x in zip(places, good, strict=True))
    new_bad = ", ".join(f"(a{v} - g{v} + {weight} * {x!r}::DOUBLE) / (total - g0 - g1 - g2 + {weight})" for v, x in zip(places, bad, strict=True))
    vote = lambda bad, good="false": f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END"
    rules = (
        vote("10 * n_symbols > n_words"), vote("4 * n_bangs > n_words"), vote("n_words >= 10 AND 100 * n_upper > 30 * word_chars"), vote("100 * n_dup_lines > 30 * n_lines"),
        vote("100 * n_repeat_words > 25 * n_words"), vote("word_chars < 3 * n_words OR word_chars > 12 * n_words"), vote("n_words >= 50 AND 100 * n_function < 2 * n_words", "n_words >= 10 AND 100 * n_function >= 10 * n_words"),
    )
    votes = "[" + ", ".join(f"{3 * i} + {r}" for i, r in enumerate(rules)) + "]"
    words = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM t) WHERE regexp_matches(x, '{_SPACED}') GROUP BY doc_id),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2))),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM g WHERE k > 1) GROUP BY doc_id),
c AS (SELECT t.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_bangs, len(list_filter(w, lambda x: x IN ({words}))) AS n_function,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN l ON l.doc_id = t.doc_id LEFT JOIN r ON r.doc_id = t.doc_id),
v AS (SELECT *, {votes} AS votes FROM c),
pat AS (SELECT votes, count(*) AS n FROM v GROUP BY votes),
em(step, good, bad) AS (
  SELECT 0, {listed(good)}::DOUBLE[], {listed(bad)}::DOUBLE[]
  UNION ALL
  SELECT step + 1, [{new_good}]::DOUBLE[], [{new_bad}]::DOUBLE[] FROM (
    SELECT step, sum(n) AS total, {sums} FROM (SELECT step, votes, n, 1 / (1 + exp(-({logit}))) AS p FROM em, pat WHERE step < {steps}) GROUP BY step)),
last AS (SELECT good, bad FROM em WHERE step = {steps})
SELECT doc_id::BIGINT AS doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {logit} >= 0 AS kept
FROM v, last"""


OP5 = _op5()
