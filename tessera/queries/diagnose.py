"""Partition comparison, diagnostic dimensions and replicate tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.math import r6
from tessera.operators import compare as C
from tessera.operators import diagnose as D
from tessera.queries.base import C_SQL, V_SQL, Family, vectors
from tessera.sources.tables import one_delivery, table

family = Family()
add = family.add

# four deterministic alternative partitions of the embedded documents
_JUDGES = {"shift": "CASE WHEN id % 9 = 0 THEN -1 ELSE (label + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END) % 10 END", "merge": "CASE WHEN label < 0 THEN -1 ELSE label - label % 2 END", "split": "CASE WHEN label < 0 THEN id % 3 ELSE label * 2 + id % 2 END", "noise": "CAST(id % 7 AS INT) - 1"}
_J_SQL = V_SQL + ", pj AS (" + " UNION ALL ".join(f"SELECT '{n}' AS judge, id, ({e.replace('CAST(id % 7 AS INT)', '(id % 7)')})::INTEGER AS lb FROM v" for n, e in _JUDGES.items()) + ")"


def _judges(v):
    out = None
    for name, expr in _JUDGES.items():
        part = v.select(F.lit(name).alias("judge"), "id", F.expr(expr).cast("int").alias("lb"))
        out = part if out is None else out.unionByName(part)
    return out


def _parts(spark, d):
    v = vectors(spark, d).select("id", "label")
    return v.select("id", F.col("label").alias("la")), _judges(v)


@add(f"WITH {_J_SQL} SELECT judge, label AS la, lb, count(*)::BIGINT AS n FROM v JOIN pj USING (id) GROUP BY ALL")
def contingency(spark, d):
    """AGG-23, JOIN-11."""
    return C.contingency(*_parts(spark, d), ["judge"])


_BJ = _J_SQL + """, na AS (SELECT label AS la, count(*) AS na FROM v WHERE label <> -1 GROUP BY label), nb AS (SELECT judge, lb, count(*) AS nb FROM pj WHERE lb <> -1 GROUP BY ALL),
ct AS (SELECT judge, label AS la, lb, count(*) AS n FROM v JOIN pj USING (id) WHERE label <> -1 AND lb <> -1 GROUP BY ALL),
bj AS (SELECT * FROM (SELECT judge, la, lb, n::DOUBLE / (na + nb - n) AS j, row_number() OVER (PARTITION BY judge, la ORDER BY n::DOUBLE / (na + nb - n) DESC, lb) AS rn FROM ct JOIN na USING (la) JOIN nb USING (judge, lb)) WHERE rn = 1),
fj AS (SELECT jj.judge, na.la, lb AS matched, coalesce(j, 0) AS jaccard FROM (SELECT DISTINCT judge FROM nb) jj CROSS JOIN na LEFT JOIN bj ON bj.judge = jj.judge AND bj.la = na.la)"""


@add(f"WITH {_BJ} SELECT judge, la, matched, round_even(jaccard, 6) AS jaccard FROM fj")
def best_jaccard(spark, d):
    """CMP-01, SET-04."""
    return C.best_jaccard(*_parts(spark, d), ["judge"]).select("judge", "la", "matched", r6("jaccard").alias("jaccard"))


@add(f"""WITH {_J_SQL}, ct AS (SELECT judge, label AS la, lb, count(*)::DOUBLE AS n FROM v JOIN pj USING (id) GROUP BY ALL), ra AS (SELECT judge, la, sum(n) AS n FROM ct GROUP BY ALL), rb AS (SELECT judge, lb, sum(n) AS n FROM ct GROUP BY ALL),
x AS (SELECT judge, sum(n * (n - 1) / 2) AS pc, sum(n * ln(n)) AS ec, sum(n) AS n FROM ct GROUP BY judge), y AS (SELECT judge, sum(n * (n - 1) / 2) AS pa, sum(n * ln(n)) AS ea FROM ra GROUP BY judge), z AS (SELECT judge, sum(n * (n - 1) / 2) AS pb, sum(n * ln(n)) AS eb FROM rb GROUP BY judge)
SELECT judge, n::BIGINT AS n, round_even((pc - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS ari, round_even(((ln(n) - ea / n) + (ln(n) - eb / n) - (ln(n) - ec / n)) / (((ln(n) - ea / n) + (ln(n) - eb / n)) / 2), 6) AS nmi FROM x JOIN y USING (judge) JOIN z USING (judge)""")
def agreement_ari_nmi(spark, d):
    """CMP-02, DIA-18."""
    return C.agreement(*_parts(spark, d), ["judge"]).select("judge", "n", r6("ari").alias("ari"), r6("nmi").alias("nmi"))


@add(f"WITH {V_SQL} SELECT count(*)::BIGINT AS n_rows, count(DISTINCT label) FILTER (label <> -1)::BIGINT AS n_categories, count(*) FILTER (label = -1)::BIGINT AS n_noise, min(label) FILTER (label <> -1) = 0 AND max(label) = count(DISTINCT label) FILTER (label <> -1) - 1 AS contiguous FROM v")
def validate_partition(spark, d):
    """CMP-07."""
    return C.validate_partition(vectors(spark, d))


PIPES = ("p2_kmeans_minilm_umap", "p3_ward_minilm_umap", "p4_hdbscan_bge_umap", "p5_gmm_minilm_pca", "p6_spectral_minilm_umap", "p7_gmm_minilm_umap")
_M = "m AS (SELECT DISTINCT ON (run_id, p1_cluster) * FROM multipipeline_per_cluster WHERE run_id IS NOT NULL AND p1_cluster IS NOT NULL), sc AS (" + " UNION ALL ".join(f"SELECT run_id, p1_cluster, '{p}' AS judge, {p}_matched_cluster AS matched, {p}_jaccard AS jaccard FROM m" for p in PIPES) + ")"


def _scores(spark, d):
    m = one_delivery(table(spark, d, "multipipeline_per_cluster").filter("run_id is not null and p1_cluster is not null"), "run_id", "p1_cluster")
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("judge"), F.col(f"{p}_matched_cluster").alias("matched"), F.col(f"{p}_jaccard").alias("jaccard")) for p in PIPES])).alias("x")
    return m.select("run_id", "p1_cluster", rows).select("run_id", "p1_cluster", "x.*")


@add(f"WITH {_M} SELECT run_id, p1_cluster, count(jaccard)::BIGINT AS n_judges, coalesce(sum((jaccard >= 0.30::DOUBLE)::INTEGER), 0)::BIGINT AS n_recovered, count(jaccard) = count(*) AS complete, round_even(CASE WHEN count(jaccard) > 0 THEN coalesce(sum((jaccard >= 0.30::DOUBLE)::INTEGER), 0)::DOUBLE / count(jaccard) END, 6) AS recovery FROM sc GROUP BY ALL")
def alt_model_recovery(spark, d):
    """DIA-03: recovery of each category by the pipelines that ran."""
    r = D.recovery(_scores(spark, d), ["run_id", "p1_cluster"])
    return r.select("run_id", "p1_cluster", "n_judges", "n_recovered", "complete", r6("recovery").alias("recovery"))


@add(f"WITH {_M} SELECT run_id, p1_cluster, " + ", ".join(f"max(jaccard) FILTER (judge = '{p}') AS {p}" for p in PIPES) + " FROM sc GROUP BY ALL")
def alt_model_detail(spark, d):
    """DIA-04, PVT-01: one column for each judge."""
    return _scores(spark, d).groupBy("run_id", "p1_cluster").pivot("judge", list(PIPES)).agg(F.max("jaccard"))


@add(f"""WITH {_M}, h AS (SELECT run_id, p1_cluster, judge, (jaccard >= 0.30::DOUBLE)::INTEGER AS hit FROM sc WHERE jaccard IS NOT NULL), jj AS (SELECT DISTINCT judge FROM sc),
x AS (SELECT jj.judge, run_id, p1_cluster, avg(hit) FILTER (h.judge <> jj.judge) AS rest FROM h, jj GROUP BY ALL), b AS (SELECT count(*) AS base FROM (SELECT avg(hit) AS m FROM h GROUP BY run_id, p1_cluster) WHERE m >= 0.5)
SELECT judge, count(*) FILTER (rest >= 0.5)::BIGINT AS n_majority, any_value(base)::BIGINT AS n_baseline FROM x, b GROUP BY judge""")
def judge_loo(spark, d):
    """DIA-12."""
    return D.leave_one_judge_out(_scores(spark, d), ["run_id", "p1_cluster"])


@add(f"""WITH {_M}, a AS (SELECT run_id, avg(jaccard) AS mean_jaccard, count(*) FILTER (jaccard IS NULL) AS n_missing FROM sc GROUP BY run_id), b AS (SELECT run_id, count(*) AS n_clusters, sum(size) AS n_sentences FROM m WHERE size > 40 GROUP BY run_id)
SELECT coalesce(a.run_id, b.run_id) AS run_id, round_even(mean_jaccard, 6) AS mean_jaccard, n_missing::BIGINT AS n_missing, n_clusters::BIGINT AS n_clusters, n_sentences::BIGINT AS n_sentences FROM a FULL JOIN b ON a.run_id = b.run_id""")
def profile_outer(spark, d):
    """DIA-14, JOIN-03."""
    a = _scores(spark, d).groupBy("run_id").agg(r6(F.avg("jaccard")).alias("mean_jaccard"), F.count_if(F.col("jaccard").isNull()).alias("n_missing"))
    m = one_delivery(table(spark, d, "multipipeline_per_cluster").filter("run_id is not null and p1_cluster is not null"), "run_id", "p1_cluster")
    b = m.filter("size > 40").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("size").alias("n_sentences"))
    return D.profile([a, b], ["run_id"])


_CORR = [(a, b) for i, a in enumerate(PIPES) for b in PIPES[i + 1 :]]


@add(f"WITH {_M} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round_even(corr({a}_jaccard, {b}_jaccard), 6) AS r FROM m" for a, b in _CORR))
def dimension_correlations(spark, d):
    """AGG-21, STT-16."""
    m = one_delivery(table(spark, d, "multipipeline_per_cluster").filter("run_id is not null and p1_cluster is not null"), "run_id", "p1_cluster")
    named = m.select(*[F.col(f"{p}_jaccard").alias(p) for p in PIPES])
    return D.correlations(named, list(PIPES)).withColumn("r", r6("r"))


@add(f"""WITH {_M}, x AS (SELECT run_id, p1_cluster, coalesce((p2_kmeans_minilm_umap_jaccard >= 0.5::DOUBLE)::INTEGER, 0) + coalesce((p3_ward_minilm_umap_jaccard >= 0.5::DOUBLE)::INTEGER, 0) + coalesce((p4_hdbscan_bge_umap_jaccard >= 0.5::DOUBLE)::INTEGER, 0) AS n_pass FROM m)
SELECT CASE n_pass WHEN 3 THEN 'STRONG' WHEN 2 THEN 'MODERATE' WHEN 1 THEN 'WEAK' ELSE 'UNSUPPORTED' END AS verdict, n_pass::INTEGER AS n_pass, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def verdict_legacy(spark, d):
    """DIA-15, AGG-22 (opt-in bands)."""
    m = one_delivery(table(spark, d, "multipipeline_per_cluster").filter("run_id is not null and p1_cluster is not null"), "run_id", "p1_cluster")
    return D.legacy_verdict(m, [f"{p}_jaccard" for p in PIPES[:3]]).groupBy("verdict", "n_pass").agg(F.count(F.lit(1)).alias("n"))


@add(f"""WITH {V_SQL}, tr AS (SELECT *, id % 3 <> 0 AS train FROM v WHERE label <> -1), en AS (SELECT label FROM tr WHERE train GROUP BY label HAVING count(*) >= 3),
cm AS (SELECT label, p, avg(vec[p]) AS m FROM (SELECT label, vec, unnest(generate_series(1, len(vec))) AS p FROM tr WHERE train AND label IN (SELECT label FROM en)) GROUP BY ALL), c0 AS (SELECT label, list(m ORDER BY p) AS mu FROM cm GROUP BY label), c AS (SELECT label, list_transform(mu, lambda x: x / sqrt(list_dot_product(mu, mu))) AS vec FROM c0),
te AS (SELECT * FROM tr WHERE NOT train), n AS (SELECT * FROM (SELECT te.id, te.label, c.label AS nearest, row_number() OVER (PARTITION BY te.id ORDER BY list_dot_product(te.vec, c.vec) DESC, c.label) AS rn FROM te, c) WHERE rn = 1),
r AS (SELECT label, nearest, count(*) AS n FROM n GROUP BY ALL), b AS (SELECT label, sum(n) AS n_test, coalesce(sum(n) FILTER (nearest = label), 0) AS own, max(n) AS most FROM r GROUP BY label),
k AS (SELECT l.label, coalesce(b.n_test, 0) AS n_test, CASE WHEN l.label IN (SELECT label FROM en) THEN coalesce(own::DOUBLE / n_test, 0) ELSE 0 END AS strict, CASE WHEN l.label IN (SELECT label FROM en) THEN coalesce(most::DOUBLE / n_test, 0) ELSE 0 END AS direction FROM (SELECT DISTINCT label FROM tr) l LEFT JOIN b ON l.label = b.label)
SELECT label, n_test::BIGINT AS n_test, round_even(strict, 6) AS strict, round_even(direction, 6) AS direction, round_even(least(strict, direction), 6) AS score FROM k""")
def heldout_centroid_diag(spark, d):
    """DIA-08."""
    h = D.heldout_centroids(vectors(spark, d), F.col("id") % 3 != 0)
    return h.select("label", "n_test", r6("strict").alias("strict"), r6("direction").alias("direction"), r6("score").alias("score"))


_SW = f"{V_SQL}, sw AS (SELECT mcs, id, (CASE WHEN id % mcs = 0 THEN -1 ELSE (id * 7) % (60 // mcs + 2) END)::INTEGER AS label FROM v, (SELECT unnest([5, 8, 10, 12, 15, 20, 25, 30])::INTEGER AS mcs)), sc AS (SELECT mcs, label, count(*) AS n FROM sw GROUP BY ALL), cu AS (SELECT mcs, count(*) FILTER (label <> -1) AS n_clusters, coalesce(sum(n) FILTER (label = -1)::DOUBLE / sum(n), 0) AS noise, max(n) FILTER (label <> -1) AS largest FROM sc GROUP BY mcs)"


def _sweep(spark, d):
    v = vectors(spark, d).select("id", F.explode(F.array(*[F.lit(m) for m in (5, 8, 10, 12, 15, 20, 25, 30)])).alias("mcs"))
    return D.sweep_counts(v.select("mcs", "id", F.expr("CASE WHEN id % mcs = 0 THEN -1 ELSE (id * 7) % (60 div mcs + 2) END").cast("int").alias("label")))


@add(f"WITH {_SW} SELECT mcs, n_clusters::BIGINT AS n_clusters, round_even(noise, 6) AS noise, largest::BIGINT AS largest FROM cu")
def mcs_sweep_given(spark, d):
    """DIA-19."""
    return _sweep(spark, d).select("mcs", "n_clusters", r6("noise").alias("noise"), "largest")


@add(f"""WITH {_SW}, f AS (SELECT mcs, abs(n_clusters - 6) <= 1 AS ok, row_number() OVER (ORDER BY mcs) AS rn FROM cu), g AS (SELECT mcs, ok, rn - sum(ok::INTEGER) OVER (ORDER BY mcs) AS g FROM f)
SELECT min(mcs) AS first, max(mcs) AS last, count(*)::BIGINT AS width FROM g WHERE ok GROUP BY g ORDER BY width DESC, first LIMIT 1""")
def plateau(spark, d):
    """WIN-06."""
    return C.plateau(_sweep(spark, d), 6, 1)


@add(f"""WITH {_SW}, al AS (SELECT *, row_number() OVER (ORDER BY mcs) AS rn FROM cu WHERE NOT (n_clusters < 4 OR noise < 0.03)), w AS (SELECT a.rn AS s, b.rn AS e, a.mcs AS first, b.mcs AS last FROM al a JOIN al b ON b.rn >= a.rn),
x AS (SELECT s, e, first, last, quantile_cont(al.n_clusters::DOUBLE, 0.5) AS med, min(n_clusters) AS lo, max(n_clusters) AS hi FROM w JOIN al ON al.rn BETWEEN s AND e GROUP BY ALL),
r AS (SELECT first, last, e - s + 1 AS width, 'core' AS rule, 0 AS o, s AS tie, 0.0 AS v FROM x WHERE greatest(hi - med, med - lo) <= 0.10::DOUBLE * med AND e - s + 1 >= 3 UNION ALL SELECT mcs, mcs, 1, 'dbcv', 1, rn, -noise FROM al)
SELECT first, last, width::INTEGER AS width, rule FROM r ORDER BY o, width DESC, v, tie LIMIT 1""")
def granularity_core(spark, d):
    """WIN-07, DIA-20 (selection rule on a given sweep)."""
    s = _sweep(spark, d).withColumn("degenerate", (F.col("n_clusters") < 4) | (F.col("noise") < 0.03)).withColumn("dbcv", F.col("noise"))
    return C.granularity_core(s)


# replicates: a deterministic roster of 60 runs over ten categories
_REP = "rp AS (SELECT r AS replicate, c AS category, ((r * 37 + c * 101 + r * c * 13) % 97) / 97.0::DOUBLE AS jaccard, CASE WHEN r % 17 = 3 THEN 'failed' WHEN r % 11 = 5 THEN 'degenerate' ELSE 'ok' END AS status FROM (SELECT unnest(range(60))::INTEGER AS r), (SELECT unnest(range(10))::INTEGER AS c))"


def _replicates(spark):
    r = spark.range(60).select(F.col("id").cast("int").alias("r")).select("r", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("c"))
    return r.select(F.col("r").alias("replicate"), F.col("c").alias("category"), (F.expr("(r * 37 + c * 101 + r * c * 13) % 97") / F.lit(97.0)).alias("jaccard"), F.expr("CASE WHEN r % 17 = 3 THEN 'failed' WHEN r % 11 = 5 THEN 'degenerate' ELSE 'ok' END").alias("status"))


@add(f"WITH {_REP} SELECT category, count(*)::BIGINT AS n_viable, round_even(avg(jaccard), 4) AS mean, round_even(stddev_samp(jaccard), 6) AS sd, round_even(quantile_cont(jaccard, 0.5), 6) AS median, round_even(min(jaccard), 6) AS lowest, round_even(max(jaccard), 6) AS highest, round_even(avg(jaccard), 4) >= 0.5 AS passes FROM rp WHERE status = 'ok' GROUP BY category")
def mc_category_summary(spark, d):
    """AGG-12, AGG-13, DIA-06."""
    return D.replicate_summary(_replicates(spark))


@add(f"WITH {_REP}, p AS (SELECT replicate, min(status) AS status FROM rp GROUP BY replicate) SELECT count(*)::BIGINT AS n_replicates, count(*) FILTER (status = 'degenerate')::BIGINT AS n_degenerate, count(*) FILTER (status = 'failed')::BIGINT AS n_failed, count(*) FILTER (status = 'ok')::BIGINT AS n_ok FROM p")
def mc_summary(spark, d):
    """AGG-14."""
    return D.replicate_status(_replicates(spark))


@add(f"WITH {_REP}, x AS (SELECT k AS checkpoint, category, avg(jaccard) AS m FROM rp, (SELECT unnest([10, 30, 60])::INTEGER AS k) WHERE status = 'ok' AND replicate < k GROUP BY ALL) SELECT checkpoint, count(*)::BIGINT AS n_categories, round_even(quantile_cont(m, 0.5), 6) AS median, count(*) FILTER (round_even(m, 6) >= 0.5)::BIGINT AS n_stable FROM x GROUP BY checkpoint")
def mc_convergence(spark, d):
    """WIN-09."""
    return D.convergence(_replicates(spark), [10, 30, 60])


_FAC = "fr AS (SELECT cache, mcs, seed, ((seed * 7 + mcs + CASE cache WHEN 'B' THEN 3 ELSE 0 END) % 23)::INTEGER AS n_pass, (seed * 3 + mcs) % 8 = 0 AS degenerate FROM (SELECT unnest(['A', 'B']) AS cache), (SELECT unnest([30, 35])::INTEGER AS mcs), (SELECT unnest(range(50))::INTEGER AS seed))"


def _factorial(spark):
    """SMP-05: seeds x granularity x realisation."""
    r = spark.range(50).select(F.col("id").cast("int").alias("seed")).select("seed", F.explode(F.array(F.lit(30), F.lit(35))).alias("mcs")).select("*", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("cache"))
    return r.select("cache", "mcs", "seed", F.expr("CAST((seed * 7 + mcs + CASE cache WHEN 'B' THEN 3 ELSE 0 END) % 23 AS INT)").alias("n_pass"), F.expr("(seed * 3 + mcs) % 8 = 0").alias("degenerate"))


@add(f"WITH {_FAC} SELECT cache, mcs, count(*)::BIGINT AS n_runs, count(*) FILTER (NOT degenerate)::BIGINT AS n_viable, round_even(quantile_cont(n_pass::DOUBLE, 0.5) FILTER (NOT degenerate), 6) AS median, round_even(quantile_cont(n_pass::DOUBLE, 0.25) FILTER (NOT degenerate), 6) AS q1, round_even(quantile_cont(n_pass::DOUBLE, 0.75) FILTER (NOT degenerate), 6) AS q3, round_even(stddev_samp(n_pass) FILTER (NOT degenerate), 6) AS sd FROM fr GROUP BY ALL")
def factorial_cells(spark, d):
    """AGG-08, PRJ-07, DIA-10."""
    return D.factorial_cells(_factorial(spark))


@add(f"WITH {_FAC} SELECT mcs, count(*)::BIGINT AS n_runs, sum(degenerate::INTEGER)::BIGINT AS n_degenerate, round_even(avg(degenerate::INTEGER), 6) AS share FROM fr GROUP BY mcs")
def factorial_degeneracy(spark, d):
    """AGG-09."""
    return _factorial(spark).groupBy("mcs").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.col("degenerate").cast("int")).alias("n_degenerate"), r6(F.avg(F.col("degenerate").cast("int"))).alias("share"))


@add(f"WITH {_FAC}, g AS (SELECT mcs, seed, max(n_pass) FILTER (cache = 'A') AS a, max(n_pass) FILTER (cache = 'B') AS b FROM fr WHERE NOT degenerate GROUP BY ALL), h AS (SELECT mcs, b - a AS delta FROM g WHERE a IS NOT NULL AND b IS NOT NULL) SELECT mcs, count(*)::BIGINT AS n_pairs, round_even(quantile_cont(delta::DOUBLE, 0.5), 6) AS median_delta, round_even(avg(delta), 6) AS mean_delta, count(*) FILTER (delta < 0)::BIGINT AS n_lower, count(*) FILTER (delta > 0)::BIGINT AS n_higher FROM h GROUP BY mcs")
def emb_sensitivity(spark, d):
    """DIA-11, JOIN-13: the two realisations at equal seed and granularity."""
    return D.paired_delta(_factorial(spark), ["mcs", "seed"], "cache", "A", "B")


@add(f"WITH {_FAC}, g AS (SELECT a.cache, b.n_pass - a.n_pass AS delta FROM fr a JOIN fr b ON a.cache = b.cache AND a.seed = b.seed WHERE a.mcs = 30 AND b.mcs = 35 AND NOT a.degenerate AND NOT b.degenerate) SELECT cache, count(*)::BIGINT AS n_pairs, round_even(quantile_cont(delta::DOUBLE, 0.5), 6) AS median_delta, round_even(avg(delta), 6) AS mean_delta, count(*) FILTER (delta < 0)::BIGINT AS n_lower, count(*) FILTER (delta > 0)::BIGINT AS n_higher FROM g GROUP BY cache")
def gran_sensitivity(spark, d):
    """DIA-11: the two granularities at equal seed and realisation."""
    return D.paired_delta(_factorial(spark).withColumn("mcs", F.col("mcs").cast("string")), ["cache", "seed"], "mcs", "30", "35")


@add(f"WITH {_FAC}, c AS (SELECT * FROM fr WHERE cache = 'A' AND mcs = 30), r AS (SELECT n_pass AS ref, degenerate AS dg FROM c WHERE seed = 41) SELECT ref, CASE WHEN NOT dg THEN round_even(100 * avg((n_pass < ref)::INTEGER), 6) END AS percentile FROM c, r WHERE NOT degenerate GROUP BY ref, dg")
def reference_location(spark, d):
    """WIN-10."""
    return D.reference_location(_factorial(spark), "A", 30, 41)


@add(f"WITH {_REP} SELECT category, count(*) FILTER (abs(round_even(jaccard - 0.5, 9)) <= 0.05::DOUBLE)::BIGINT AS n_close, round_even(avg(jaccard - 0.5), 6) AS mean_margin FROM rp WHERE status = 'ok' GROUP BY category")
def threshold_margins(spark, d):
    """AGG-11, AGG-10."""
    r = _replicates(spark).filter("status = 'ok'").withColumn("m", F.col("jaccard") - 0.5)
    return r.groupBy("category").agg(F.count_if(F.abs(F.bround("m", 9)) <= 0.05).alias("n_close"), r6(F.avg("m")).alias("mean_margin"))


@add(f"WITH {V_SQL} SELECT replicate, label, id FROM (SELECT r AS replicate, label, id, row_number() OVER (PARTITION BY r, label ORDER BY sha256(r || '-' || id), id) AS rn FROM v, (SELECT unnest(range(5))::INTEGER AS r) WHERE label <> -1) WHERE rn <= 15")
def stratified_sample(spark, d):
    """SMP-04."""
    return D.stratified_sample(vectors(spark, d), "label", "id", 15, 5)
