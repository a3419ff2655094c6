"""Stochastic nulls and clustering models: checked by rows here, by statistics and planted clusters in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import diagnose as D
from tessera.operators import lexical as L
from tessera.operators import models as M
from tessera.operators import nulls as N
from tessera.operators.vectors import centroids, coverage_by, nearest_centroid
from tessera.plans.lineage import Workspace
from tessera.queries.base import DOMAINS, STOP, Family, domain_of, registered, sentences, vectors
from tessera.sources.tables import table

family = Family()
add = family.add


def _projected(spark, d):
    return Workspace(spark, "projected").write(M.project(vectors(spark, d), 5).select("id", "session", "label", "vec", "proj"), "projected")


@add()
def pca_project(spark, d):
    """ML-02..04."""
    p = _projected(spark, d)
    return p.select("id", *[F.bround(F.col("proj")[i], 6).alias(f"c{i + 1}") for i in range(5)])


@add()
def hashed_vectors(spark, d):
    """ML-01: the deterministic fallback encoder over the whole corpus."""
    return M.hashed_encoder(32)(sentences(spark, d).select("sentence_id", "text")).select("sentence_id", F.size("vec").alias("d"), F.bround(F.col("vec")[0], 6).alias("x1"))


@add()
def hdbscan_labels(spark, d):
    """ML-05, ML-06."""
    return M.density_partition(_projected(spark, d), 12)


@add()
def granularity_sweep(spark, d):
    """DIA-20, ML-07."""
    return M.granularity_sweep(_projected(spark, d), [5, 8, 12, 18])


@add()
def judge_partitions(spark, d):
    """DIA-01, DIA-02, ML-09, ML-10, ML-13, ML-14."""
    return M.judge_partitions(_projected(spark, d), 10, 12)


@add()
def ward_groups(spark, d):
    """ML-11, ML-15, ML-16, CMP-03, CMP-04, DIA-17."""
    return M.category_groups(centroids(vectors(spark, d)), 4, 0.3)


@add()
def ward_cuts(spark, d):
    """ML-12."""
    return M.ward_cut_profile(centroids(vectors(spark, d)))


@add()
def resampling_stability(spark, d):
    """DIA-05, DIA-06, SMP-03."""
    p = _projected(spark, d)
    return D.replicate_status(M.resampling_stability(p, p.select("id", "label"), 12, 30))


@add()
def geometry_separability(spark, d):
    """DIA-07."""
    p = _projected(spark, d)
    return D.replicate_summary(M.geometry_separability(p, p.select("id", "label"), 15, 100))


@add()
def factorial_run(spark, d):
    """DIA-09, DIA-10, SMP-01, SMP-05, CMP-06."""
    p = _projected(spark, d)
    return M.factorial(p, p.select("id", "label"), 10, [8, 12])


def _replication(spark, d):
    """Labels and rates of the factorial over the documents that have a vector."""
    ws, p = Workspace(spark, "factorial"), _projected(spark, d)
    labels = ws.write(M.factorial_labels(p, p.select("id", "label"), 2, [8, 12]), "labels")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").join(p.select("id"), "id", "left_semi")
    return labels, ws.write(L.replication_by_run(docs, labels, ["seed", "mcs"], STOP, 3, 2000), "rates")


@add()
def replication_runs(spark, d):
    """DIA-09, DIA-10: refit, align, predict and replicate the terms of every run; degeneracy and passes."""
    labels, rates = _replication(spark, d)
    return M.replication_runs(labels, rates, ["seed", "mcs"], 10)


@add()
def replication_summary(spark, d):
    """DIA-10b, AGG-08..11: cells and margins of the runs themselves."""
    labels, rates = _replication(spark, d)
    runs = M.replication_runs(labels, rates, ["seed", "mcs"], 10)
    cells = D.factorial_cells(runs.withColumn("cache", F.lit("A"))).select(F.lit("cell").alias("row"), F.col("mcs").alias("key"), F.col("n_viable").alias("n"), F.col("median").alias("value"))
    margins = M.replication_margins(rates, runs, ["seed", "mcs"]).select(F.lit("margin").alias("row"), F.col("label").alias("key"), "n", F.col("median_margin").alias("value"))
    return cells.unionByName(margins)


@add()
def second_register(spark, d):
    """XR-03, XR-04: clusters of the half not covered by the other half's centroids, with their spread over sessions."""
    p = _projected(spark, d)
    near = nearest_centroid(p.filter("id % 2 = 1"), centroids(p.filter("id % 2 = 0")))
    rest = near.filter(F.col("cosine") < 0.4)
    labels = M.density_partition(rest, 8)
    return rest.select("id", "session").join(labels, "id").groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("session").alias("n_sessions"))


@add()
def permutation_null(spark, d):
    """STT-06."""
    v = vectors(spark, d)
    return N.null_thresholds(N.permutation_null(v.filter("id % 2 = 1"), centroids(v.filter("id % 2 = 0")), 1000))


@add()
def shuffle_null(spark, d):
    """STT-08, STT-09."""
    r = registered(spark, d).filter("register = 'HIGHLIGHT'")
    return N.null_verdict(N.shuffle_null(r.select("session", "label")), 3)


@add()
def session_bootstrap(spark, d):
    """STT-10."""
    v = vectors(spark, d)
    c = coverage_by(nearest_centroid(v, centroids(v)), "session", 0.2)
    return N.session_bootstrap(c.select("session", F.col("covered").alias("hits"), "n"))


@add()
def matched_length_null(spark, d):
    """STT-12, STT-14, STT-05."""
    r = registered(spark, d).filter("label <> -1").withColumn("primary", domain_of(F.col("label")) == DOMAINS[0])
    g = r.groupBy("event").agg(*[F.count_if((F.col("register") == reg) & (F.col("primary") == flag)).alias(f"{reg[0]}{int(flag)}") for reg in ("HIGHLIGHT", "FULL_RACE") for flag in (True, False)])
    ok = g.filter("H1 + H0 > 0 and F1 + F0 > 0")
    counts = ok.select("event", F.array("F1", "F0").alias("domain_n"), (F.col("H1") + F.col("H0")).alias("n_draw"), (F.col("H1") / (F.col("H1") + F.col("H0"))).alias("observed"))
    return N.matched_length_null(counts)


@add()
def contiguous_null(spark, d):
    """STT-13, WIN-13, CAC-05."""
    s = sentences(spark, d)
    return N.contiguous_null(s.select("session", F.col("sentence_id").alias("position"), (F.col("label") % 4 == 0).alias("hit")))
