"""Corpus, masking and provenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.math import r6
from tessera.functions.text import strip_ws, ws_tokens
from tessera.operators import corpus as C
from tessera.queries.base import S_SQL, Family, sentences
from tessera.sources.tables import one_delivery, table

family = Family()
add = family.add
WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x{000b}]"
STRIPPED = rf"regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')"
NAMES = [("Safety Car", "DROP"), ("full course yellow", "DROP"), ("race directors", "TEAM"), ("stewards", "TEAM"), ("the hairpin", "PLACE"), ("pit entry", "PLACE"), ("the booth", "PERSON"), ("hairpin", "PLACE"), ("crew chief", "PERSON")]


def _mask_sql(expr: str) -> str:
    for v, cls in sorted(NAMES, key=lambda p: -len(p[0])):
        expr = f"regexp_replace({expr}, '(?i)\\b{v}\\b(''s)?', '{' ' if cls == 'DROP' else f'<{cls}>'}', 'g')"
    return f"regexp_replace(regexp_replace({expr}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


@add(f"""WITH t AS (SELECT DISTINCT ON (sentence_id) sentence_id, coalesce(session, 'all') AS session, {STRIPPED} AS text, channel FROM corpus WHERE text IS NOT NULL),
u AS (SELECT *, len(list_filter(string_split_regex(text, '{WS}+'), lambda w: w <> ''))::INTEGER AS token_count FROM t)
SELECT row_number() OVER (ORDER BY sentence_id) - 1 AS position, sentence_id, session, text, token_count, channel FROM u WHERE token_count >= 3""")
def corpus_load(spark, d):
    """SRC-03, TXT-01..03, PRJ-01."""
    c = one_delivery(table(spark, d, "corpus"), "sentence_id")
    return C.load_sentences(c, ["sentence_id"], min_tokens=3).select("position", "sentence_id", "session", "text", "token_count", "channel")


@add(f"""WITH {S_SQL}, m AS (SELECT *, regexp_replace(text, ' .*', '') AS first_word FROM s)
SELECT session, count(*)::BIGINT AS n, min(series) AS series, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM s), 1) AS pct FROM s GROUP BY session""")
def provenance_table(spark, d):
    """AGG-01, AGG-02."""
    return C.provenance_table(sentences(spark, d), ["series"]).select("session", "n", "series", "pct")


@add(f"WITH {S_SQL} SELECT sentence_id, {_mask_sql('text')} AS masked FROM s WHERE regexp_matches(text, '^[\\x00-\\x7f]*$')")
def mask_text(spark, d):
    """TXT-04, TXT-05: a short gazetteer, longest variant first (texts in ASCII, where the engines' word boundaries agree)."""
    return sentences(spark, d).filter(F.col("text").rlike(r"^[\x00-\x7f]*$")).select("sentence_id", C.mask_expression(F.col("text"), NAMES).alias("masked"))


@add()
def mask_gazetteer(spark, d):
    """TXT-05, TXT-07, SRC-04: every sentence masked by the whole gazetteer."""
    g = one_delivery(table(spark, d, "gazetteer"), "entry_id")
    return C.mask_sentences(sentences(spark, d).select("sentence_id", "text"), g).select("sentence_id", "masked")


@add(f"""WITH {S_SQL}, m AS (SELECT {_mask_sql('text')} AS t FROM s WHERE regexp_matches(text, '^[\\x00-\\x7f]*$')), p AS (SELECT unnest(['<PERSON>', '<TEAM>', '<PLACE>', 'any']) AS placeholder),
x AS (SELECT placeholder, (length(t) - length(replace(t, CASE placeholder WHEN 'any' THEN '<' ELSE placeholder END, ''))) // (CASE placeholder WHEN 'any' THEN 1 ELSE length(placeholder) END) AS n FROM m, p)
SELECT placeholder, count(*) FILTER (n > 0)::BIGINT AS n_sentences, sum(n)::BIGINT AS n_occurrences FROM x GROUP BY placeholder""")
def masking_report(spark, d):
    """TXT-08."""
    return C.masking_report(mask_text(spark, d))


@add(f"WITH {S_SQL} SELECT sentence_id, sha256(text) AS source_text_hash FROM s")
def source_hashes(spark, d):
    """TXT-10."""
    return C.source_hashes(sentences(spark, d))


@add("SELECT DISTINCT ON (video_id) video_id, concat_ws(', ', video_title, upload_date) AS label FROM (SELECT DISTINCT video_id, video_title, upload_date FROM sessions WHERE video_id IS NOT NULL)")
def source_label(spark, d):
    """TXT-11, TXT-20."""
    s = one_delivery(table(spark, d, "sessions").filter("video_id is not null"), "video_id")
    return s.select("video_id", F.concat_ws(", ", "video_title", "upload_date").alias("label"))


@add("SELECT DISTINCT video_id, replace(lower(video_id), '_gp', '') AS event_key, replace(replace(video_id, '_gp', ''), '_', ' ') AS pretty FROM sessions WHERE video_id IS NOT NULL")
def event_key_norm(spark, d):
    """TXT-12, TXT-19."""
    s = table(spark, d, "sessions").filter("video_id is not null").select("video_id").distinct()
    pretty = F.replace(F.replace(F.col("video_id"), F.lit("_gp"), F.lit("")), F.lit("_"), F.lit(" "))
    return s.select("video_id", C.event_key(F.col("video_id")).alias("event_key"), pretty.alias("pretty"))


@add(f"""WITH {S_SQL}, c AS (SELECT sentence_id, CASE WHEN sentence_id % 11 = 0 THEN NULL ELSE text END AS masked, sha256(CASE WHEN sentence_id % 13 = 0 THEN text || '!' ELSE text END) AS h FROM s WHERE sentence_id % 17 <> 0),
j AS (SELECT s.sentence_id AS sid, c.sentence_id AS cid, masked, h, sha256(s.text) AS sh FROM s FULL JOIN c USING (sentence_id))
SELECT count(sid)::BIGINT AS n_source, count(cid)::BIGINT AS n_cached, count(DISTINCT cid)::BIGINT AS n_unique, count(*) FILTER (cid IS NULL)::BIGINT AS n_missing, count(*) FILTER (sid IS NULL)::BIGINT AS n_unknown,
count(*) FILTER (cid IS NOT NULL AND masked IS NULL)::BIGINT AS n_null, count(*) FILTER (h <> sh)::BIGINT AS n_stale FROM j""")
def cache_verify(spark, d):
    """CAC-03, JOIN-08, SET-06: a damaged copy of the corpus against its source."""
    s = sentences(spark, d).select("sentence_id", "text")
    damaged = s.filter("sentence_id % 17 <> 0").select("sentence_id", F.expr("case when sentence_id % 11 = 0 then null else text end").alias("masked"), F.sha2(F.expr("case when sentence_id % 13 = 0 then concat(text, '!') else text end"), 256).alias("source_text_hash"))
    return C.verify_cache(s, damaged)


START, ENDS = "(?i)(lights go out|welcome back)", ["(?i)(celebrate a win|wins the)", "(?i)(goes wild|standings)"]


@add(f"""WITH {S_SQL}, a AS (SELECT session, coalesce(min(sentence_id) FILTER (regexp_matches(text, '{START}')), min(sentence_id)) AS first, max(sentence_id) AS fin FROM s GROUP BY session),
e AS (SELECT a.session, min(sentence_id) FILTER (regexp_matches(text, '{ENDS[0]}')) AS e1, min(sentence_id) FILTER (regexp_matches(text, '{ENDS[1]}')) AS e2 FROM a JOIN s ON s.session = a.session AND sentence_id > first GROUP BY a.session)
SELECT a.session, first, coalesce(e1, e2, fin) AS last, (CASE WHEN e1 IS NOT NULL THEN 1 WHEN e2 IS NOT NULL THEN 2 END)::INTEGER AS tier FROM a LEFT JOIN e USING (session)""")
def segment_cut(spark, d):
    """TXT-23."""
    return C.segment_cut(sentences(spark, d), START, ENDS)


@add()
def segment_documents(spark, d):
    """TXT-22: documents split into sentences (look-behind has no counterpart in the other engine)."""
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.posexplode(C.segment_text(F.col("text"))).alias("idx", "sentence"))


@add(f"""WITH {S_SQL}, x AS (SELECT session, count(*) AS n, sum(token_count) AS t FROM s GROUP BY session)
SELECT sum(n)::BIGINT AS n_sentences, count(*)::BIGINT AS n_sessions, sum(t)::BIGINT AS n_tokens, round_even(avg(n), 6) AS mean_sentences, min(n)::BIGINT AS min_sentences, max(n)::BIGINT AS max_sentences FROM x""")
def corpus_stats(spark, d):
    """AGG-28, AGG-25."""
    return C.corpus_summary(sentences(spark, d))


@add("""WITH s AS (SELECT DISTINCT ON (video_id) video_id, register FROM sessions WHERE video_id IS NOT NULL),
p AS (SELECT video_id AS primary_session, replace(lower(video_id), '_gp', '') AS k FROM s WHERE register = 'HIGHLIGHT'),
q AS (SELECT video_id AS session, regexp_replace(replace(lower(video_id), '_gp', ''), '[aeiou]$', 'a') AS k2 FROM s WHERE register = 'FULL_RACE'),
al AS (SELECT DISTINCT k2 AS ak, min(primary_session) AS by_alias FROM q JOIN p ON substr(p.k, 1, 6) = substr(q.k2, 1, 6) GROUP BY k2)
SELECT session, coalesce(primary_session, by_alias) AS primary_session, CASE WHEN primary_session IS NOT NULL THEN 'exact' WHEN by_alias IS NOT NULL THEN 'alias' ELSE 'none' END AS match_type
FROM q LEFT JOIN p ON k = k2 LEFT JOIN al ON ak = k2""")
def event_pairing(spark, d):
    """XR-08, JOIN-14: exact keys first, then aliases (here: the same first letters) whose target exists."""
    s = one_delivery(table(spark, d, "sessions").filter("video_id is not null"), "video_id")
    primary = s.filter("register = 'HIGHLIGHT'").select(F.col("video_id").alias("session"))
    second = s.filter("register = 'FULL_RACE'").select(F.col("video_id").alias("session"))
    keyed = second.select("session", F.regexp_replace(C.event_key(F.col("session")), "[aeiou]$", "a").alias("k2"))
    pk = primary.select(F.col("session").alias("p"), C.event_key(F.col("session")).alias("k"))
    target = keyed.join(pk, F.substring("k", 1, 6) == F.substring("k2", 1, 6)).groupBy("k2").agg(F.min("p").alias("p"))
    aliases = target.select(F.col("k2").alias("key"), C.event_key(F.col("p")).alias("target"))
    out = C.pair_events(primary, keyed.select(F.col("k2").alias("session")).distinct(), aliases)
    return keyed.join(out.withColumnRenamed("session", "k2"), "k2").select("session", "primary_session", "match_type")


@add(f"""WITH ss AS (SELECT DISTINCT ON (video_id) video_id, register FROM sessions WHERE video_id IS NOT NULL), c AS (SELECT DISTINCT ON (sentence_id) sentence_id, session, text FROM corpus),
o AS (SELECT count(*) AS n, count(DISTINCT sentence_id) AS ids, count(*) FILTER (video_id IS NULL) AS orphans, count(*) FILTER (coalesce(trim(text), '') = '') AS blank, count(DISTINCT register) AS regs FROM c LEFT JOIN ss ON session = video_id)
SELECT 'has_rows' AS "check", n > 0 AS ok, n::BIGINT AS detail FROM o UNION ALL SELECT 'unique_ids', n = ids, ids FROM o UNION ALL SELECT 'known_sessions', orphans = 0, orphans FROM o UNION ALL SELECT 'no_blank_text', blank = 0, blank FROM o UNION ALL SELECT 'two_registers', regs = 2, regs FROM o""")
def register_checks(spark, d):
    """SRC-11."""
    s = one_delivery(table(spark, d, "sessions").filter("video_id is not null"), "video_id").select(F.col("video_id").alias("session"), "register")
    return C.register_checks(one_delivery(table(spark, d, "corpus"), "sentence_id").select("sentence_id", "session", "text"), s)


@add(rf"""WITH t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, length({STRIPPED})::INTEGER AS n_stripped, len(list_filter(string_split_regex(text, '{WS}+'), lambda w: w <> ''))::INTEGER AS n_tokens FROM t""")
def text_tokens(spark, d):
    """TXT-01, TXT-02 over whole documents in all scripts."""
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", F.length(strip_ws(F.col("text"))).alias("n_stripped"), F.size(ws_tokens(F.col("text"))).alias("n_tokens"))


@add(f"""WITH {S_SQL} SELECT series, count(*)::BIGINT AS n, round_even(stddev_samp(token_count), 6) AS sd, round_even(quantile_cont(token_count, 0.25), 6) AS q1, round_even(quantile_cont(token_count, 0.5), 6) AS median, round_even(quantile_cont(token_count, 0.75), 6) AS q3 FROM s GROUP BY series""")
def length_summary(spark, d):
    """AGG-07."""
    q = F.percentile("token_count", [0.25, 0.5, 0.75])
    g = sentences(spark, d).groupBy("series").agg(F.count(F.lit(1)).alias("n"), r6(F.stddev_samp("token_count")).alias("sd"), q.alias("q"))
    return g.select("series", "n", "sd", *[r6(F.col("q")[k]).alias(n) for k, n in enumerate(("q1", "median", "q3"))])
