"""Vocabulary and enrichment queries over the whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.math import r6
from tessera.operators import lexical as L
from tessera.plans.lineage import Workspace
from tessera.queries.base import S_SQL, STOP, STOP_SQL, Family, sentences

family = Family()
add = family.add

_O = S_SQL + rf""", w AS (SELECT sentence_id, label, session, list_filter(regexp_extract_all(lower(regexp_replace(text, '<(PERSON|TEAM|PLACE)>', ' ', 'g')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({STOP_SQL}, x)) AS w FROM s),
o AS (SELECT sentence_id, label, session, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
voc AS (SELECT term, count(DISTINCT sentence_id) AS df_term, count(*) AS tf FROM o GROUP BY term HAVING count(DISTINCT sentence_id) >= 3 ORDER BY tf DESC, term LIMIT 3000)"""
_K = _O + """, inc AS (SELECT DISTINCT sentence_id, label, session, term FROM o JOIN voc USING (term)),
cat AS (SELECT label, count(*) AS n_cluster FROM s WHERE label <> -1 GROUP BY label), tot AS (SELECT count(*) AS n_docs FROM s),
k AS (SELECT term, label, count(*) AS k_in FROM inc GROUP BY ALL), dt AS (SELECT term, count(*) AS df_term FROM inc GROUP BY term),
cn AS (SELECT dt.term, cat.label, n_docs, dt.df_term, n_cluster, coalesce(k_in, 0) AS k_in FROM dt CROSS JOIN cat CROSS JOIN tot LEFT JOIN k ON k.term = dt.term AND k.label = cat.label)"""


def _tail(k: str = "k_in", n: str = "n_docs", t: str = "df_term", c: str = "n_cluster") -> str:
    term = f"exp(lgamma({t}+1)-lgamma(i+1)-lgamma({t}-i+1)+lgamma({n}-{t}+1)-lgamma({c}-i+1)-lgamma({n}-{t}-{c}+i+1)-lgamma({n}+1)+lgamma({c}+1)+lgamma({n}-{c}+1))"
    return f"CASE WHEN {k} <= greatest(0, {t}+{c}-{n}) THEN 1.0::DOUBLE WHEN {k} > {c}::DOUBLE*{t}/{n} THEN coalesce(list_sum(list_transform(generate_series({k}, least({t},{c})), lambda i: {term})), 0) ELSE 1 - coalesce(list_sum(list_transform(generate_series(greatest(0, {t}+{c}-{n}), {k}-1), lambda i: {term})), 0) END"


def _bh(source: str, name: str, group: str = "") -> str:
    by, over = (f"PARTITION BY {group}", f"PARTITION BY {group}") if group else ("", "")
    return f"""{name}0 AS (SELECT *, count(*) OVER ({by}) AS n_all, count(*) OVER ({over} ORDER BY p RANGE UNBOUNDED PRECEDING) AS rk FROM {source}),
{name}1 AS (SELECT *, max(CASE WHEN p <= 0.05::DOUBLE * rk / n_all THEN p END) OVER ({by}) AS cut, least(1, min(p * n_all / rk) OVER ({over} ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q_value FROM {name}0),
{name} AS (SELECT *, coalesce(p <= cut, false) AS rejected FROM {name}1)"""


_E = _K + f", t AS (SELECT *, round_even(n_cluster::DOUBLE * df_term / n_docs, 3) AS expected, {_tail()} AS p FROM cn), " + _bh("t", "e")


def _counts(spark, d):
    s = sentences(spark, d)
    ws = Workspace(spark, "lexical")
    occ = L.occurrences(s, STOP, 2, ("sentence_id", "label", "session"))
    vocab = ws.write(L.vocabulary(occ, 3, 3000), "vocabulary")
    inc = ws.write(L.incidence(occ, vocab, ("sentence_id", "label", "session")), "incidence")
    return s, inc, L.term_counts(s.select("sentence_id", "label"), inc)


@add(f"WITH {_O} SELECT term, df_term::BIGINT AS df_term, tf::BIGINT AS tf, contains(term, ' ') AS is_bigram FROM voc")
def vocabulary(spark, d):
    """LEX-01, TXT-09, TXT-13..16, LEX-06."""
    v = L.vocabulary(L.occurrences(sentences(spark, d), STOP), 3, 3000)
    return v.select("term", "df_term", "tf", F.col("term").contains(" ").alias("is_bigram"))


@add(f"WITH {_K} SELECT term, label, n_docs::BIGINT AS n_docs, df_term::BIGINT AS df_term, n_cluster::BIGINT AS n_cluster, k_in::BIGINT AS k_in FROM cn")
def term_counts(spark, d):
    """LEX-03, LEX-04, PVT-06."""
    return _counts(spark, d)[2].select("term", "label", "n_docs", "df_term", "n_cluster", "k_in")


@add(f"WITH {_E} SELECT term, label, k_in::BIGINT AS k_in, expected, round_even(log10(greatest(p, 1e-290)), 4) AS log10_p, round_even(log10(greatest(q_value, 1e-290)), 4) AS log10_q FROM e WHERE rejected")
def enrichment(spark, d):
    """LEX-05, STT-01, STT-03, WIN-01."""
    e = L.enrichment(_counts(spark, d)[2]).filter("rejected")
    return e.select("term", "label", "k_in", "expected", r6(F.log10(F.greatest("p", F.lit(1e-290))), 4).alias("log10_p"), r6(F.log10(F.greatest("q_value", F.lit(1e-290))), 4).alias("log10_q"))


@add(f"""WITH {_E}, h AS (SELECT label, count(*) AS n, avg(contains(term, ' ')::INTEGER) AS b FROM e WHERE rejected GROUP BY label)
SELECT cat.label, n_cluster::BIGINT AS size, coalesce(n, 0)::BIGINT AS n_enriched, round_even(coalesce(b, 0), 6) AS bigram_share FROM cat LEFT JOIN h USING (label)""")
def enrichment_summary(spark, d):
    """AGG-17."""
    s, _, counts = _counts(spark, d)
    return L.enrichment_summary(L.enrichment(counts), s)


@add(f"WITH {_K}, t AS (SELECT *, {_tail()} AS p FROM cn WHERE NOT contains(term, ' ')), {_bh('t', 'e', 'label')} SELECT label, count(*) FILTER (rejected)::BIGINT AS n_enriched FROM e GROUP BY label")
def enrichment_screen(spark, d):
    """LEX-08, WIN-02."""
    return L.enrichment_screen(_counts(spark, d)[2])


_TOP = _E + ", tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round_even(log10(greatest(p, 1e-290)), 6), term)::INTEGER AS rank FROM e WHERE rejected) WHERE rank <= 15)"


@add(f"WITH {_TOP} SELECT label, rank, term FROM tp WHERE rank <= 10")
def top_terms(spark, d):
    """WIN-03, LEX-12."""
    return L.top_terms(L.enrichment(_counts(spark, d)[2]), 10).select("label", "rank", "term")


@add(f"WITH {_TOP} SELECT label, string_agg(term, ', ' ORDER BY rank) AS signature, count(*)::BIGINT AS n FROM tp GROUP BY label")
def lexical_signature(spark, d):
    """LEX-12, TXT-20."""
    t = L.top_terms(L.enrichment(_counts(spark, d)[2]), 15)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return t.groupBy("label").agg(F.array_join(F.transform(ranked, lambda x: x.term), ", ").alias("signature"), F.count(F.lit(1)).alias("n"))


@add()
def keyword_handles(spark, d):
    """TXT-17, TXT-21, WIN-04: size-ordered handles with keywords none of which contains another."""
    s, _, counts = _counts(spark, d)
    t = L.top_terms(L.enrichment(counts), 15)
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x.term)
    from pyspark.sql import Window

    sizes = s.filter("label <> -1").groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    handle = F.format_string("K%02d", F.row_number().over(Window.orderBy(F.desc("size"), "label")) - 1)  # some dozens of categories
    return sizes.withColumn("handle", handle).join(t.groupBy("label").agg(L.dedupe_keywords(words).alias("keywords")), "label", "left")


_W = _K + ", wt AS (SELECT label, term, k_in::DOUBLE / n_cluster AS weight, label % 2 AS half FROM cn WHERE k_in > 0)"


@add(f"""WITH {_W}, a AS (SELECT label AS h, term, weight AS wa FROM wt WHERE half = 0), b AS (SELECT label AS f, term, weight AS wb FROM wt WHERE half = 1),
m AS (SELECT h, f, sum(least(wa, wb)) AS m FROM a JOIN b USING (term) GROUP BY ALL),
ta AS (SELECT h, sum(wa) AS ta FROM a GROUP BY h), tb AS (SELECT f, sum(wb) AS tb FROM b GROUP BY f)
SELECT ta.h, tb.f, round_even(coalesce(m, 0) / (ta + tb - coalesce(m, 0)), 6) AS similarity FROM ta CROSS JOIN tb LEFT JOIN m ON m.h = ta.h AND m.f = tb.f""")
def weighted_jaccard(spark, d):
    """LEX-10, LEX-11, JOIN-10: even against odd categories."""
    w = L.term_weights(_counts(spark, d)[2]).filter("k_in > 0")
    j = L.weighted_jaccard(w.filter("label % 2 = 0"), w.filter("label % 2 = 1"))
    return j.select("h", "f", r6("similarity").alias("similarity"))


@add(f"""WITH {_TOP} SELECT a.label AS h, b.label AS f, round_even(count(*) / 15.0::DOUBLE, 6) AS overlap FROM tp a JOIN tp b ON a.term = b.term AND a.label < b.label GROUP BY ALL""")
def topk_overlap(spark, d):
    """SET-05: shared top terms over a fixed K, whatever the lists' lengths."""
    t = L.top_terms(L.enrichment(_counts(spark, d)[2]), 15).select("label", "term")
    o = t.select(F.col("label").alias("f"), "term")
    return t.join(o, "term").filter("label < f").groupBy(F.col("label").alias("h"), "f").agg(r6(F.count(F.lit(1)) / F.lit(15.0)).alias("overlap"))


def _half(spark, d):
    s = sentences(spark, d).withColumn("train", F.conv(F.substring(F.md5("session"), 1, 4), 16, 10).cast("int") % 2 == 0)
    ws = Workspace(spark, "halves")
    occ = L.occurrences(s, STOP, 2, ("sentence_id", "label", "train"))
    vocab = ws.write(L.vocabulary(occ.filter("train"), 3, 3000), "vocabulary")
    inc = ws.write(L.incidence(occ, vocab, ("sentence_id", "label", "train")), "incidence")
    return tuple(ws.write(L.term_counts(s.filter(t).select("sentence_id", "label"), inc.filter(t)), "counts") for t in ("train", "not train"))


_H = _O.split(",\nvoc AS")[0] + """, oo AS (SELECT *, ('0x' || substr(md5(session), 1, 4))::INTEGER % 2 = 0 AS train FROM o), st AS (SELECT *, ('0x' || substr(md5(session), 1, 4))::INTEGER % 2 = 0 AS train FROM s),
voc AS (SELECT term, count(*) AS tf FROM oo WHERE train GROUP BY term HAVING count(DISTINCT sentence_id) >= 3 ORDER BY tf DESC, term LIMIT 3000),
inc AS (SELECT DISTINCT sentence_id, label, train, term FROM oo JOIN voc USING (term)), k AS (SELECT train, term, label, count(*) AS k_in FROM inc GROUP BY ALL), dt AS (SELECT train, term, count(*) AS df_term FROM inc GROUP BY ALL),
cat AS (SELECT train, label, count(*) AS n_cluster FROM st WHERE label <> -1 GROUP BY ALL), tot AS (SELECT train, count(*) AS n_docs FROM st GROUP BY train),
cn AS (SELECT dt.train, dt.term, cat.label, n_docs, df_term, n_cluster, coalesce(k_in, 0) AS k_in FROM dt JOIN cat USING (train) JOIN tot USING (train) LEFT JOIN k ON k.train = dt.train AND k.term = dt.term AND k.label = cat.label)""" + f""",
t AS (SELECT *, {_tail()} AS p FROM cn WHERE train), {_bh('t', 'a')}, u AS (SELECT c.*, {_tail('c.k_in', 'c.n_docs', 'c.df_term', 'c.n_cluster')} AS p FROM cn c JOIN a USING (term, label) WHERE NOT c.train AND a.rejected), {_bh('u', 'b')},
z AS (SELECT label, rejected, p, (k_in - n_cluster::DOUBLE * df_term / n_docs) / sqrt(greatest((n_cluster::DOUBLE * df_term / n_docs) * (1 - df_term::DOUBLE / n_docs) * (n_docs - n_cluster) / greatest(n_docs - 1, 1), 1e-12)) AS z FROM b),
g AS (SELECT label, count(*) AS n, avg(rejected::INTEGER) AS strict, avg((z > 0 AND p < 0.10)::INTEGER) AS lenient, avg((z > 0)::INTEGER) AS direction FROM z GROUP BY label)
SELECT c.label, coalesce(n, 0)::BIGINT AS n_terms, round_even(strict, 6) AS strict, round_even(lenient, 6) AS lenient, round_even(direction, 6) AS direction, coalesce(strict >= 0.5 AND direction >= 0.5, false) AS passes, round_even(least(strict, direction), 6) AS score FROM (SELECT DISTINCT label FROM cat WHERE train) c LEFT JOIN g USING (label)"""


@add("WITH " + _H)
def heldout_replication_terms(spark, d):
    """LEX-02, LEX-09, STT-02."""
    train, test = _half(spark, d)
    r = L.heldout_replication(train, test)
    return r.select("label", "n_terms", *[r6(c).alias(c) for c in ("strict", "lenient", "direction")], "passes", r6("score").alias("score"))


_P = _O + """, pl AS (SELECT unnest([7, 8, 9])::INTEGER AS mcs), sp AS (SELECT mcs, sentence_id, (token_count % mcs - 1)::INTEGER AS label FROM s, pl),
inc AS (SELECT DISTINCT mcs, sp.sentence_id, sp.label, term FROM o JOIN voc USING (term) JOIN sp USING (sentence_id)), k AS (SELECT mcs, term, label, count(*) AS k_in FROM inc GROUP BY ALL), dt AS (SELECT mcs, term, count(*) AS df_term FROM inc GROUP BY ALL),
cat AS (SELECT mcs, label, count(*) AS n_cluster FROM sp WHERE label <> -1 GROUP BY ALL), tot AS (SELECT mcs, count(*) AS n_docs FROM sp GROUP BY mcs),
cn AS (SELECT dt.mcs, dt.term, cat.label, n_docs, df_term, n_cluster, coalesce(k_in, 0) AS k_in FROM dt JOIN cat USING (mcs) JOIN tot USING (mcs) LEFT JOIN k ON k.mcs = dt.mcs AND k.term = dt.term AND k.label = cat.label)""" + f", t AS (SELECT *, {_tail()} AS p FROM cn), {_bh('t', 'e', 'mcs')}"


@add(f"WITH {_P}, x AS (SELECT mcs, label, count(*) FILTER (rejected) AS n FROM e GROUP BY ALL) SELECT mcs, count(*)::BIGINT AS n_clusters, sum(n)::BIGINT AS n_enriched, round_even(avg((n >= 5)::INTEGER), 6) AS share_with_five FROM x GROUP BY mcs")
def enrichment_plateau(spark, d):
    """LEX-07: one grouped query over partitions keyed by granularity."""
    s = sentences(spark, d)
    ws = Workspace(spark, "plateau")
    occ = L.occurrences(s, STOP, 2, ("sentence_id",))
    vocab = ws.write(L.vocabulary(occ, 3, 3000), "vocabulary")
    base = ws.write(L.incidence(occ, vocab, ("sentence_id",)), "incidence")
    parts = s.select("sentence_id", "token_count", F.explode(F.array(F.lit(7), F.lit(8), F.lit(9))).alias("mcs")).select("sentence_id", "mcs", (F.col("token_count") % F.col("mcs") - 1).cast("int").alias("label"))
    counts = L.term_counts(parts, base.join(parts, "sentence_id"), ["mcs"])
    from tessera.functions.exact import hypergeom_tail
    from tessera.operators.ordering import benjamini_hochberg_within

    tested = counts.withColumn("p", hypergeom_tail(F.col("k_in"), F.col("n_docs"), F.col("df_term"), F.col("n_cluster")))
    n = benjamini_hochberg_within(tested, ["mcs"], "p", 0.05).groupBy("mcs", "label").agg(F.count_if("rejected").alias("n"))
    return n.groupBy("mcs").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n_enriched"), r6(F.avg((F.col("n") >= 5).cast("int"))).alias("share_with_five"))


@add(f"""WITH {_K}, x AS (SELECT label, term, k_in, k_in * (ln((1.0::DOUBLE + n_docs) / (1 + df_term)) + 1) AS x FROM cn WHERE k_in > 0), y AS (SELECT label, term, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS tfidf FROM x)
SELECT label, rank, term, round_even(tfidf, 6) AS tfidf FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round_even(tfidf, 9) DESC, term)::INTEGER AS rank FROM y) WHERE rank <= 5""")
def tfidf_top_terms(spark, d):
    """ML-17."""
    from tessera.operators.vectors import top_by

    t = L.tfidf(_counts(spark, d)[2].filter("k_in > 0"), F.col("n_docs"), F.col("df_term"), F.col("k_in"))
    return top_by(t, ["label"], [F.desc(F.bround("tfidf", 9)), F.col("term")], 5).select("label", "rank", "term", r6("tfidf").alias("tfidf"))


@add(f"""WITH {_TOP}, f AS (SELECT label, term FROM tp WHERE rank <= 8), dd AS (SELECT DISTINCT sentence_id, term FROM inc WHERE term IN (SELECT term FROM f)), n1 AS (SELECT term, count(*) AS n FROM dd GROUP BY term), nn AS (SELECT count(*) AS n FROM s),
pr AS (SELECT a.label, a.term AS t1, b.term AS t2 FROM f a JOIN f b ON a.label = b.label AND a.term < b.term), tg AS (SELECT a.term AS t1, b.term AS t2, count(*) AS n12 FROM dd a JOIN dd b ON a.sentence_id = b.sentence_id AND a.term < b.term GROUP BY ALL)
SELECT label, count(*)::BIGINT AS n_pairs, round_even(avg(CASE WHEN n12 IS NULL THEN -1 WHEN n12 = nn.n THEN 1 ELSE ln((n12::DOUBLE / nn.n) / ((x.n::DOUBLE / nn.n) * (y.n::DOUBLE / nn.n))) / -ln(n12::DOUBLE / nn.n) END), 6) AS npmi
FROM pr LEFT JOIN tg USING (t1, t2) JOIN n1 x ON x.term = t1 JOIN n1 y ON y.term = t2, nn GROUP BY label""")
def npmi(spark, d):
    """STT-18."""
    s, inc, counts = _counts(spark, d)
    tops = Workspace(spark, "npmi").write(L.top_terms(L.enrichment(counts), 8).select("label", "term"), "tops")
    return L.npmi_coherence(inc, tops, s.count()).select("label", "n_pairs", r6("npmi").alias("npmi"))
