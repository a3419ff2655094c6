"""Vector, coverage and separation queries over embedded documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.math import dot, r6
from tessera.operators import vectors as V
from tessera.queries.base import C_SQL, N_SQL, V_SQL, Family, vectors

family = Family()
add = family.add
TAUS = [0.15, 0.20, 0.25, 0.30, 0.40]
GRID = "(SELECT unnest([15, 20, 25, 30, 40])::INTEGER AS tau_pct)"


def _near(spark, d):
    v = vectors(spark, d)
    return V.nearest_centroid(v, V.centroids(v))


@add(f"WITH {C_SQL} SELECT label, round_even(vec[1], 6) AS x1, round_even(vec[2], 6) AS x2, round_even(list_aggregate(vec, 'min'), 6) AS lowest, len(vec)::INTEGER AS d FROM c")
def centroids(spark, d):
    """VEC-02/04."""
    c = V.centroids(vectors(spark, d))
    return c.select("label", r6(F.col("vec")[0]).alias("x1"), r6(F.col("vec")[1]).alias("x2"), r6(F.array_min("vec")).alias("lowest"), F.size("vec").alias("d"))


@add(f"WITH {N_SQL} SELECT id, nearest, round_even(cosine, 6) AS cosine FROM n")
def nearest_centroid(spark, d):
    """VEC-05, JOIN-09, WIN-05."""
    return _near(spark, d).select("id", "nearest", r6("cosine").alias("cosine"))


@add(f"WITH {N_SQL} SELECT CASE WHEN cosine >= 0.2::DOUBLE THEN nearest ELSE -1 END AS assigned, count(*)::BIGINT AS n FROM n GROUP BY 1")
def assign_tau(spark, d):
    """VEC-06, AGG-03."""
    return V.assign_at(_near(spark, d), 0.2).groupBy("assigned").agg(F.count(F.lit(1)).alias("n"))


@add(f"""WITH {N_SQL} SELECT session, count(*)::BIGINT AS n, round_even(quantile_cont(cosine, 0.5), 6) AS median_cosine, sum((cosine >= 0.2::DOUBLE)::BIGINT)::BIGINT AS covered,
round_even(100.0::DOUBLE * sum((cosine >= 0.2::DOUBLE)::BIGINT) / count(*), 6) AS coverage_pct FROM n GROUP BY session""")
def coverage_by_session(spark, d):
    """XR-01, XR-02, AGG-04: how much of each session the category centroids cover."""
    c = V.coverage_by(_near(spark, d), "session", 0.2)
    return c.select("session", "n", r6("median_cosine").alias("median_cosine"), "covered", r6("coverage_pct").alias("coverage_pct"))


@add(f"WITH {N_SQL} SELECT tau_pct, count(*)::BIGINT AS n, sum((cosine >= tau_pct / 100.0::DOUBLE)::BIGINT)::BIGINT AS covered, round_even(100.0::DOUBLE * sum((cosine >= tau_pct / 100.0::DOUBLE)::BIGINT) / count(*), 6) AS coverage_pct FROM n, {GRID} GROUP BY tau_pct")
def tau_sweep(spark, d):
    """XR-02, AGG-06, PRJ-06."""
    return V.tau_sweep(_near(spark, d), TAUS).withColumn("coverage_pct", r6("coverage_pct"))


@add(f"""WITH {N_SQL}, e AS (SELECT session, tau_pct, 100.0::DOUBLE * sum((cosine >= tau_pct / 100.0::DOUBLE)::BIGINT) / count(*) AS pct FROM n, (SELECT unnest(generate_series(0, 100, 2))::INTEGER AS tau_pct) GROUP BY ALL)
SELECT tau_pct, round_even(min(pct), 6) AS lowest, round_even(avg(pct), 6) AS mean, round_even(max(pct), 6) AS highest FROM e GROUP BY tau_pct""")
def coverage_curve(spark, d):
    """FIG-01: envelope of the sessions' coverage over all thresholds."""
    c = V.tau_sweep(_near(spark, d), [k / 50 for k in range(51)], ["session"])
    return c.groupBy("tau_pct").agg(r6(F.min("coverage_pct")).alias("lowest"), r6(F.avg("coverage_pct")).alias("mean"), r6(F.max("coverage_pct")).alias("highest"))


@add(f"""WITH {N_SQL} SELECT tau_pct, round_even(avg((cosine >= tau_pct / 100.0::DOUBLE)::INTEGER) FILTER (label <> -1), 6) AS retain, round_even(avg((cosine >= tau_pct / 100.0::DOUBLE)::INTEGER) FILTER (label = -1), 6) AS admit,
round_even(avg((cosine >= tau_pct / 100.0::DOUBLE)::INTEGER) FILTER (label <> -1) - avg((cosine >= tau_pct / 100.0::DOUBLE)::INTEGER) FILTER (label = -1), 6) AS youden_j FROM n, {GRID} GROUP BY tau_pct""")
def threshold_floor(spark, d):
    """STT-15."""
    t = V.threshold_floor(_near(spark, d), F.col("label") != -1, TAUS)
    return t.select("tau_pct", r6("retain").alias("retain"), r6("admit").alias("admit"), r6("youden_j").alias("youden_j"))


_OWN = f"{C_SQL}, o AS (SELECT v.id, v.label, list_dot_product(v.vec, c.vec) / (sqrt(list_dot_product(v.vec, v.vec)) + 1e-12::DOUBLE) AS own FROM v JOIN c ON v.label = c.label)"


@add(f"WITH {_OWN} SELECT label, count(*)::BIGINT AS n, round_even(avg(own), 6) AS mean_cosine FROM o GROUP BY label")
def own_centroid_cosine(spark, d):
    """VEC-08."""
    v = vectors(spark, d)
    return V.own_cosine(v, V.centroids(v)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("own_cosine")).alias("mean_cosine"))


@add(f"WITH {_OWN} SELECT label, rank, id, round_even(own, 6) AS own_cosine FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round_even(own, 9) DESC, id)::INTEGER AS rank FROM o) WHERE rank <= 3")
def exemplars(spark, d):
    """VEC-09, SRT-03."""
    v = vectors(spark, d)
    top = V.top_by(V.own_cosine(v, V.centroids(v)), ["label"], [F.desc(F.bround("own_cosine", 9)), F.col("id")], 3)
    return top.select("label", "rank", "id", r6("own_cosine").alias("own_cosine"))


@add(f"""WITH {N_SQL} SELECT count(*)::BIGINT AS n_noise, round_even(quantile_cont(cosine, 0.5), 6) AS median_cosine, round_even(avg((cosine >= 0.2::DOUBLE)::INTEGER), 6) AS share_above,
arg_min(id, (-round_even(cosine, 9), id)) AS closest, arg_min(id, (round_even(cosine, 9), id)) AS farthest FROM n WHERE label = -1""")
def noise_profile(spark, d):
    """AGG-26, AGG-05."""
    n = _near(spark, d).filter("label = -1").withColumn("c", F.bround("cosine", 9))
    return n.agg(F.count(F.lit(1)).alias("n_noise"), r6(F.percentile("cosine", 0.5)).alias("median_cosine"), r6(F.avg((F.col("cosine") >= 0.2).cast("int"))).alias("share_above"), F.min_by("id", F.struct(-F.col("c"), F.col("id"))).alias("closest"), F.min_by("id", F.struct("c", "id")).alias("farthest"))


@add(f"""WITH {V_SQL} SELECT count(*)::BIGINT AS n_rows, min(len(vec))::INTEGER AS min_dim, max(len(vec))::INTEGER AS max_dim, sum(len(list_filter(vec, lambda x: isnan(x))))::BIGINT AS n_nan, sum(len(list_filter(vec, lambda x: isinf(x))))::BIGINT AS n_inf,
sum((len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)::BIGINT)::BIGINT AS finite_rows, round_even(min(list_aggregate(vec, 'min')), 6) AS min_value, round_even(max(list_aggregate(vec, 'max')), 6) AS max_value, round_even(avg(sqrt(list_dot_product(vec, vec))), 6) AS mean_norm FROM v""")
def matrix_audit(spark, d):
    """AGG-27, VEC-01, SRC-05/06, MTH-07."""
    a = V.matrix_audit(vectors(spark, d))
    return a.select(*[c for c in a.columns if c not in ("min_value", "max_value", "mean_norm")], *[r6(c).alias(c) for c in ("min_value", "max_value", "mean_norm")])


_KNN = f"""{V_SQL}, k AS (SELECT * FROM (SELECT a.id AS src, b.id AS dst, list_dot_product(a.vec, b.vec) AS cosine, row_number() OVER (PARTITION BY a.id ORDER BY round_even(list_dot_product(a.vec, b.vec), 12) DESC, b.id)::INTEGER AS rank FROM v a, v b WHERE a.id <> b.id) WHERE rank <= 5)"""


@add(f"WITH {_KNN} SELECT src, dst, rank, round_even(cosine, 6) AS cosine FROM k")
def knn(spark, d):
    """VEC-07 by blocks."""
    return V.neighbours(vectors(spark, d), 5).select("src", "dst", "rank", r6("cosine").alias("cosine"))


@add(f"WITH {_KNN} SELECT src, dst, round_even(cosine, 6) AS weight FROM k WHERE src < dst")
def knn_edges(spark, d):
    """ML-18: connectivity edges a < b; an edge found only from its greater end is left out."""
    return V.neighbours(vectors(spark, d), 5).filter("src < dst").select("src", "dst", r6("cosine").alias("weight"))


@add(f"WITH {C_SQL} SELECT round_even(quantile_cont(list_dot_product(a.vec, b.vec), 0.95), 6) AS p95, count(*)::BIGINT AS n_pairs FROM c a, c b WHERE a.label <> b.label")
def within_reference_p95(spark, d):
    """STT-07, JOIN-12: off-diagonal similarity of the categories' centroids."""
    c = V.centroids(vectors(spark, d))
    b = c.select(F.col("label").alias("l2"), F.col("vec").alias("v2"))
    # a square of the categories, of which a partition has some dozens
    pairs = c.join(b, F.col("label") != F.col("l2")).select(dot(F.col("vec"), F.col("v2")).alias("s"))
    return pairs.agg(r6(F.percentile("s", 0.95)).alias("p95"), F.count(F.lit(1)).alias("n_pairs"))


@add(f"""WITH {V_SQL}, x AS (SELECT a.id, a.label, b.label AS l2, avg(list_distance(a.vec, b.vec)) AS dist FROM v a JOIN v b ON a.id <> b.id WHERE a.label <> -1 AND b.label <> -1 GROUP BY ALL),
y AS (SELECT id, label, min(dist) FILTER (label = l2) AS a, min(dist) FILTER (label <> l2) AS b FROM x GROUP BY ALL)
SELECT label, count(*)::BIGINT AS n, round_even(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM y GROUP BY label""")
def silhouette_exact(spark, d):
    """ML-08, DIA-13."""
    return V.silhouette(vectors(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("silhouette")).alias("silhouette"))


@add(f"""WITH {C_SQL}, sp AS (SELECT v.label, count(*) AS n, avg(list_distance(v.vec, c.mu)) AS s, sum(list_distance(v.vec, c.mu) ** 2) AS w FROM v JOIN c ON v.label = c.label GROUP BY v.label),
g AS (SELECT list(m ORDER BY p) AS grand FROM (SELECT p, avg(vec[p]) AS m FROM (SELECT vec, unnest(generate_series(1, len(vec))) AS p FROM v WHERE label <> -1) GROUP BY p)),
w AS (SELECT a.label, max((sa.s + sb.s) / list_distance(a.mu, b.mu)) AS r FROM c a JOIN c b ON a.label <> b.label JOIN sp sa ON sa.label = a.label JOIN sp sb ON sb.label = b.label GROUP BY a.label),
h AS (SELECT sum(n * list_distance(mu, grand) ** 2) AS bt, sum(w) AS wi, count(*) AS k, sum(n) AS n FROM c JOIN sp USING (label), g)
SELECT round_even((SELECT avg(r) FROM w), 6) AS davies_bouldin, round_even((bt / (k - 1)) / (wi / (n - k)), 6) AS calinski_harabasz, k::BIGINT AS k, n::BIGINT AS n FROM h""")
def separation_indices(spark, d):
    """ML-19."""
    s = V.separation_indices(vectors(spark, d))
    return s.select(r6("davies_bouldin").alias("davies_bouldin"), r6("calinski_harabasz").alias("calinski_harabasz"), "k", "n")
