"""Report tables, rater agreement, publication safety, figure data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.math import r6
from tessera.operators import report as R
from tessera.operators import vectors as V
from tessera.queries.base import S_SQL, V_SQL, Family, sentences, vectors
from tessera.queries.lexical import _TOP as TOP_SQL
from tessera.queries.lexical import _counts
from tessera.sources.tables import table

family = Family()
add = family.add

_INV = V_SQL + ", iv AS (SELECT label, count(*) AS size FROM v WHERE label <> -1 GROUP BY label)"


@add(f"WITH {_INV} SELECT label, 'category ' || label AS name, size::BIGINT AS size, round_even(size::DOUBLE / sum(size) OVER (), 6) AS share FROM iv")
def category_inventory(spark, d):
    """REP-02, AGG-03, JOIN-06."""
    return R.inventory(vectors(spark, d), F.concat(F.lit("category "), F.col("label").cast("string")))


@add(f"""WITH {_INV}, r AS (SELECT size, row_number() OVER (ORDER BY size, label) AS i, row_number() OVER (ORDER BY size DESC, label) AS k FROM iv)
SELECT round_even(sum(size) FILTER (k = 1)::DOUBLE / sum(size), 6) AS top1, round_even(sum(size) FILTER (k <= 5)::DOUBLE / sum(size), 6) AS top5, quantile_cont(size::DOUBLE, 0.5) AS median_size, round_even((2 * sum(i * size) - (count(*) + 1) * sum(size))::DOUBLE / (count(*) * sum(size)), 6) AS gini FROM r""")
def size_concentration(spark, d):
    """AGG-29, WIN-12."""
    return R.size_concentration(R.inventory(vectors(spark, d), F.lit("")).select("label", "size"))


@add(f"""WITH {TOP_SQL}, ct AS (SELECT label, count(*) AS size FROM s WHERE label <> -1 GROUP BY label), kw AS (SELECT label, string_agg(term, ', ' ORDER BY rank) AS keywords FROM tp WHERE rank <= 4 GROUP BY label),
ex AS (SELECT label, string_agg(sentence_id::VARCHAR, ';' ORDER BY rk) AS exemplars FROM (SELECT label, sentence_id, row_number() OVER (PARTITION BY label ORDER BY token_count DESC, sentence_id) AS rk FROM s WHERE label <> -1) WHERE rk <= 3 GROUP BY label)
SELECT label, size::BIGINT AS size, 'K' || lpad((row_number() OVER (ORDER BY size DESC, label) - 1)::VARCHAR, 2, '0') AS handle, keywords, exemplars FROM ct LEFT JOIN kw USING (label) LEFT JOIN ex USING (label)""")
def cluster_cards(spark, d):
    """REP-01, WIN-04."""
    from tessera.operators import lexical as L

    s, _, counts = _counts(spark, d)
    clustered = s.filter("label <> -1")
    ex = V.top_by(clustered, ["label"], [F.desc("token_count"), F.col("sentence_id")], 3).select("label", "rank", F.col("sentence_id").alias("id"))
    sizes = clustered.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return R.cluster_cards(sizes, L.top_terms(L.enrichment(counts), 4), ex)


@add("SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE substr(sha1(text), 1, 16) END AS text_sha1, lang FROM documents")
def strip_text(spark, d):
    """PUB-01, SNK-04."""
    return R.strip_text(table(spark, d, "documents").select("doc_id", "text", "lang"), ["text"])


_PROSE = "coalesce(length(v) >= 45 AND len(list_filter(string_split_regex(v, '[ \\t\\n\\r\\f\\x{000b}]+'), lambda w: w <> '')) >= 8 AND NOT (len(string_split(v, ',')) >= 4 AND len(list_filter(string_split_regex(v, '[ \\t\\n\\r\\f\\x{000b}]+'), lambda w: w <> ''))::DOUBLE / len(string_split(v, ',')) <= 3) AND len(list_filter(string_split_regex(v, '[ \\t\\n\\r\\f\\x{000b}]+'), lambda w: list_contains(['the', 'a', 'an', 'of', 'to', 'in', 'is', 'was', 'and', 'that', 'it', 'for', 'on', 'with', 'as', 'at', 'by'], lower(w)))) > 0, false)"


@add(f"""WITH x AS (SELECT 'text' AS "column", text AS v FROM corpus UNION ALL SELECT 'session', session FROM corpus UNION ALL SELECT 'channel', channel FROM corpus) SELECT "column", count(*) FILTER ({_PROSE})::BIGINT AS n FROM x GROUP BY "column" HAVING count(*) FILTER ({_PROSE}) >= 3""")
def prose_leak_scan(spark, d):
    """PUB-02, TXT-18: over all rows, not a sample of them."""
    return R.prose_leaks(table(spark, d, "corpus"), ["text", "session", "channel"])


_SR = "sr AS (SELECT DISTINCT ON (study_id, rater, cluster_id) * FROM survey_responses WHERE study_id IS NOT NULL AND rater IS NOT NULL AND cluster_id IS NOT NULL ORDER BY study_id, rater, cluster_id, submitted_at DESC NULLS LAST, t1 DESC NULLS LAST, t3 DESC NULLS LAST, t4 DESC NULLS LAST)"


def _answers(spark, d):
    s = table(spark, d, "survey_responses").filter("study_id is not null and rater is not null and cluster_id is not null")
    last = s.groupBy("study_id", "rater", "cluster_id").agg(F.max(F.struct("submitted_at", "t1", "t3", "t4", "t5", "match_t1", "match_t3", "match_t4")).alias("a"))
    return last.select("study_id", "rater", "cluster_id", "a.*")


@add(f"WITH {_SR} SELECT cluster_id, count(*)::BIGINT AS n, round_even(avg(match_t1::INTEGER), 6) AS accuracy_t1, round_even(avg(match_t3::INTEGER), 6) AS accuracy_t3, round_even(avg(match_t4::INTEGER), 6) AS accuracy_t4, round_even(avg(t5), 6) AS mean_t5 FROM sr GROUP BY cluster_id")
def rater_accuracy(spark, d):
    """STT-19."""
    return R.rater_accuracy(_answers(spark, d), ["cluster_id"])


@add(f"""WITH {_SR}, b AS (SELECT study_id, cluster_id, rater, upper(trim(t3)) AS v FROM sr WHERE t3 IS NOT NULL), t AS (SELECT x.rater AS rater_a, y.rater AS rater_b, x.v AS va, y.v AS vb, count(*) AS n FROM b x JOIN b y ON x.study_id = y.study_id AND x.cluster_id = y.cluster_id AND x.rater < y.rater GROUP BY ALL),
tt AS (SELECT rater_a, rater_b, sum(n) AS n, sum(n) FILTER (va = vb) AS same FROM t GROUP BY ALL), ma AS (SELECT rater_a, rater_b, va AS v, sum(n) AS na FROM t GROUP BY ALL), mb AS (SELECT rater_a, rater_b, vb AS v, sum(n) AS nb FROM t GROUP BY ALL),
ch AS (SELECT rater_a, rater_b, sum(na * nb) AS c FROM ma JOIN mb USING (rater_a, rater_b, v) GROUP BY ALL), k AS (SELECT rater_a, rater_b, n, coalesce(same, 0)::DOUBLE / n AS po, coalesce(c, 0)::DOUBLE / (n * n) AS pe FROM tt LEFT JOIN ch USING (rater_a, rater_b))
SELECT rater_a, rater_b, n::BIGINT AS n, round_even(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM k""")
def cohen_kappa(spark, d):
    """STT-17, JOIN-12."""
    a = _answers(spark, d).filter("t3 is not null").withColumn("v", F.upper(F.trim("t3")))
    return R.cohen_kappa(a, ["study_id", "cluster_id"], "rater", "v").withColumn("kappa", r6("kappa"))


@add(f"""WITH {_SR}, b AS (SELECT study_id, cluster_id, upper(trim(t4)) AS v FROM sr WHERE t4 IS NOT NULL), c AS (SELECT study_id, cluster_id, v, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT study_id, cluster_id, sum(n) AS m, sum(n * (n - 1)) AS agree FROM c GROUP BY ALL HAVING sum(n) >= 2),
nv AS (SELECT c.study_id, v, sum(n) AS nv FROM c JOIN m USING (study_id, cluster_id) GROUP BY ALL), t AS (SELECT study_id, sum(nv) AS n, sum(nv * (nv - 1)) AS same FROM nv GROUP BY study_id), o AS (SELECT study_id, sum(agree::DOUBLE / (m - 1)) AS a FROM m GROUP BY study_id)
SELECT study_id, n::BIGINT AS n, round_even(CASE WHEN 1 - same::DOUBLE / (n * (n - 1)) = 0 THEN 1 ELSE 1 - (1 - a / n) / (1 - same::DOUBLE / (n * (n - 1))) END, 6) AS alpha FROM t JOIN o USING (study_id)""")
def krippendorff_alpha(spark, d):
    """STT-17."""
    a = _answers(spark, d).withColumn("v", F.upper(F.trim("t4")))
    return R.krippendorff_alpha(a, ["cluster_id"], "v", ["study_id"]).withColumn("alpha", r6("alpha"))


@add(f"WITH {V_SQL} SELECT label, round_even(avg(vec[1]), 6) AS x, round_even(avg(vec[2]), 6) AS y FROM v WHERE label <> -1 GROUP BY label")
def label_positions(spark, d):
    """FIG-04: mean display coordinates."""
    v = vectors(spark, d).filter("label <> -1")
    return v.groupBy("label").agg(r6(F.avg(F.col("vec")[0])).alias("x"), r6(F.avg(F.col("vec")[1])).alias("y"))


@add(f"WITH {V_SQL} SELECT round_even(quantile_cont(vec[1], 0.005), 6) AS x_lo, round_even(quantile_cont(vec[1], 0.995), 6) AS x_hi, round_even(quantile_cont(vec[2], 0.005), 6) AS y_lo, round_even(quantile_cont(vec[2], 0.995), 6) AS y_hi FROM v")
def axis_window(spark, d):
    """FIG-03, T24."""
    v = vectors(spark, d)
    q = [F.percentile(F.col("vec")[k], F.lit([0.005, 0.995])) for k in (0, 1)]
    return v.agg(q[0].alias("x"), q[1].alias("y")).select(*[r6(F.col(a)[k]).alias(f"{a}_{n}") for a in "xy" for k, n in enumerate(("lo", "hi"))])


@add(f"""WITH {S_SQL}, c0 AS (SELECT label, series, count(*) AS n FROM s WHERE label <> -1 GROUP BY ALL), c AS (SELECT *, dense_rank() OVER (ORDER BY series) AS pos FROM c0), b AS (SELECT label, sum(pos * n)::DOUBLE / sum(n) AS b FROM c GROUP BY label)
SELECT label, round_even(b, 6) AS barycentre, (row_number() OVER (ORDER BY round_even(b, 9), label) - 1)::INTEGER AS position FROM b""")
def seriation(spark, d):
    """WIN-15, WIN-14."""
    from pyspark.sql import Window

    c = sentences(spark, d).filter("label <> -1").groupBy("label", "series").agg(F.count(F.lit(1)).alias("n"))
    pos = c.select("series").distinct().withColumn("pos", F.dense_rank().over(Window.orderBy("series")))  # a handful of series
    return R.seriation(c.join(F.broadcast(pos), "series"), "pos", "label", "n").withColumn("barycentre", r6("barycentre"))


@add(f"WITH {S_SQL}, t AS (SELECT series, register_n, n FROM (SELECT series, count(DISTINCT session) AS register_n, count(*) AS n FROM s GROUP BY series)) SELECT format('{{}} of {{}}', register_n, n) AS cell, series FROM t")
def x_of_n_cells(spark, d):
    """REP-07: text cells of published tables."""
    g = sentences(spark, d).groupBy("series").agg(F.countDistinct("session").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.select(F.format_string("%d of %d", "k", "n").alias("cell"), "series")


@add(f"""WITH {S_SQL} SELECT count(*)::BIGINT AS sentences, count(DISTINCT session)::BIGINT AS sessions, count(DISTINCT label) FILTER (label <> -1)::BIGINT AS categories, round_even(avg((label = -1)::INTEGER), 6) AS unclustered, round_even(avg(token_count), 6) AS mean_tokens FROM s""")
def headline(spark, d):
    """REP-08, AGG-25: every headline figure is computed."""
    s = sentences(spark, d)
    return s.agg(F.count(F.lit(1)).alias("sentences"), F.countDistinct("session").alias("sessions"), F.countDistinct(F.when(F.col("label") != -1, F.col("label"))).alias("categories"), r6(F.avg((F.col("label") == -1).cast("int"))).alias("unclustered"), r6(F.avg("token_count")).alias("mean_tokens"))
