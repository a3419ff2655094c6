"""DuckDB statements that state the same results as the pN_ queries, where SQL can."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"

_P3 = f"""
WITH c AS (SELECT DISTINCT ON (sentence_id) sentence_id, session, text FROM corpus),
n AS (SELECT count(*) AS n_all FROM c),
t AS (SELECT sentence_id, unnest({_WORDS}) AS v FROM c WHERE text IS NOT NULL),
f AS (
  SELECT 'text' AS field_name, v AS field_value, count(*)::BIGINT AS occurrences, count(DISTINCT sentence_id)::BIGINT AS n_rows, 0.115::DOUBLE AS lim FROM t GROUP BY v
  UNION ALL
  SELECT 'session', session, count(*)::BIGINT, count(*)::BIGINT, 0.05::DOUBLE FROM c WHERE session IS NOT NULL GROUP BY session
),
m AS (
  SELECT field_name, field_value, occurrences, n_rows,
         CASE WHEN n_rows <= 2 THEN 'rare' WHEN n_rows > lim * n_all THEN 'common' END AS mark
  FROM f, n
)
"""

_P2 = f"""
WITH c AS (SELECT DISTINCT ON (sentence_id) sentence_id, session, text FROM corpus),
t AS (SELECT DISTINCT sentence_id, session, unnest({_WORDS}) AS term FROM c WHERE text IS NOT NULL),
r AS (SELECT term, count(*) AS rows_total FROM t GROUP BY term),
s AS (SELECT session, term, count(*) AS n_rows FROM t WHERE session IS NOT NULL GROUP BY session, term),
k AS (
  SELECT DISTINCT run_id || ':' || p1_cluster AS record_key, term FROM (
    SELECT run_id, p1_cluster, lower(regexp_replace(unnest(string_split_regex(p1_top_terms, '[,;]')), '^\\s+|\\s+$', '', 'g')) AS term
    FROM multipipeline_per_cluster) WHERE term <> ''
),
d AS (SELECT term, count(*) AS n_lists FROM k GROUP BY term)
SELECT 'corpus' AS record_kind, session AS record_key, term FROM s JOIN r USING (term) WHERE n_rows >= 6 AND 2 * n_rows >= rows_total
UNION ALL
SELECT 'cluster', record_key, term FROM k JOIN d USING (term) WHERE n_lists <= 4
"""

ORACLES = {
    "p2_found": _P2,
    "p3_frequency": _P3 + "SELECT field_name, field_value, occurrences, n_rows, mark FROM m",
    "p3_found": _P3 + "SELECT field_name, field_value, mark FROM m WHERE mark IS NOT NULL",
}
