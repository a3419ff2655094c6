"""Networks, sweep stability, group keywords, splits and literal report tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions.math import r6
from tessera.operators import compare as C
from tessera.operators import lexical as L
from tessera.operators import models as M
from tessera.operators import network as W
from tessera.operators import nulls as N
from tessera.operators import registers as R
from tessera.operators import vectors as V
from tessera.operators.ordering import positional_ids
from tessera.plans.lineage import Workspace
from tessera.queries.base import DOMAIN_SQL, V_SQL, Family, domain_of, sentences, vectors
from tessera.queries.compose import _TWO, _edges
from tessera.queries.diagnose import _BJ, _parts
from tessera.queries.lexical import _TOP, _counts
from tessera.queries.vectors import _KNN
from tessera.sources.tables import one_delivery, table

family = Family()
add = family.add


@add(f"""WITH {_KNN}, e AS (SELECT src, dst, cosine AS w FROM k WHERE src < dst), b AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e), by_ AS (SELECT b.src, v.label AS t, sum(w) AS k, count(*) AS m FROM b JOIN v ON v.id = b.dst GROUP BY ALL),
nd AS (SELECT src, v.label AS module, sum(m) AS degree, sum(k) AS strength, sum(k * k) AS sq, coalesce(sum(k) FILTER (t = v.label), 0) AS inside FROM by_ JOIN v ON v.id = src GROUP BY ALL), st AS (SELECT module, avg(inside) AS mu, stddev_pop(inside) AS sd FROM nd GROUP BY module)
SELECT src AS id, module, degree::BIGINT AS degree, round_even(strength, 6) AS strength, round_even(1 - sq / (strength * strength), 6) AS participation, round_even(CASE WHEN coalesce(sd, 0) = 0 THEN 0 ELSE (inside - mu) / sd END, 5) AS within_z FROM nd JOIN st USING (module)""")
def network_roles(spark, d):
    """DIA-22: degree, participation and within-module score in the neighbour graph."""
    v = vectors(spark, d)
    e = V.neighbours(v, 5).filter("src < dst").select("src", "dst", F.col("cosine").alias("weight"))
    r = W.roles(e, v.select("id", F.col("label").alias("module")))
    return r.select("id", "module", "degree", r6("strength").alias("strength"), r6("participation").alias("participation"), r6("within_z", 5).alias("within_z"))


_SW = V_SQL + ", sw AS (SELECT mcs, id, (CASE WHEN id % mcs = 0 THEN -1 ELSE (id * 7) % (60 // mcs + 2) END)::INTEGER AS label FROM v, (SELECT unnest([5, 8, 10, 12])::INTEGER AS mcs))"


@add(f"""WITH {_SW}, o AS (SELECT mcs, lead(mcs) OVER (ORDER BY mcs) AS nx FROM (SELECT DISTINCT mcs FROM sw)), j AS (SELECT a.mcs, a.id, a.label AS la, b.label AS lb FROM sw a JOIN o USING (mcs) JOIN sw b ON b.mcs = nx AND b.id = a.id),
ct AS (SELECT mcs, la, lb, count(*)::DOUBLE AS n FROM j GROUP BY ALL), ra AS (SELECT mcs, sum(n * (n - 1) / 2) AS p FROM (SELECT mcs, la, sum(n) AS n FROM ct GROUP BY ALL) GROUP BY mcs), rb AS (SELECT mcs, sum(n * (n - 1) / 2) AS p FROM (SELECT mcs, lb, sum(n) AS n FROM ct GROUP BY ALL) GROUP BY mcs),
x AS (SELECT mcs, sum(n * (n - 1) / 2) AS p, sum(n) AS n FROM ct GROUP BY mcs), cc AS (SELECT mcs, la, lb, n FROM ct WHERE la <> -1 AND lb <> -1),
s1 AS (SELECT mcs, count(*) AS k FROM (SELECT mcs, la FROM (SELECT *, sum(n) OVER (PARTITION BY mcs, la) AS t FROM cc) WHERE n >= 0.2 * t GROUP BY ALL HAVING count(*) >= 2) GROUP BY mcs), s2 AS (SELECT mcs, count(*) AS k FROM (SELECT mcs, lb FROM (SELECT *, sum(n) OVER (PARTITION BY mcs, lb) AS t FROM cc) WHERE n >= 0.2 * t GROUP BY ALL HAVING count(*) >= 2) GROUP BY mcs)
SELECT mcs, round_even((x.p - ra.p * rb.p / (x.n * (x.n - 1) / 2)) / ((ra.p + rb.p) / 2 - ra.p * rb.p / (x.n * (x.n - 1) / 2)), 6) AS ari, coalesce(s1.k, 0)::BIGINT AS splits, coalesce(s2.k, 0)::BIGINT AS merges FROM x JOIN ra USING (mcs) JOIN rb USING (mcs) LEFT JOIN s1 USING (mcs) LEFT JOIN s2 USING (mcs)""")
def neighbour_stability(spark, d):
    """CMP-08."""
    v = vectors(spark, d).select("id", F.explode(F.array(*[F.lit(m) for m in (5, 8, 10, 12)])).alias("mcs"))
    parts = v.select("mcs", "id", F.expr("CASE WHEN id % mcs = 0 THEN -1 ELSE (id * 7) % (60 div mcs + 2) END").cast("int").alias("label"))
    return W.neighbour_stability(parts).withColumn("ari", r6("ari"))


@add(f"""WITH {_BJ}, nz AS (SELECT judge, avg((lb = -1)::INTEGER) AS noise FROM pj GROUP BY judge)
SELECT judge, count(*)::BIGINT AS n_categories, count(*) FILTER (jaccard >= 0.30::DOUBLE)::BIGINT AS survived, round_even(any_value(noise), 6) AS noise, round_even(count(*) FILTER (jaccard >= 0.30::DOUBLE)::DOUBLE / count(*) / greatest(1 - any_value(noise), 1e-12), 6) AS adjusted FROM fj JOIN nz USING (judge) GROUP BY judge""")
def survival_noise_adjusted(spark, d):
    """DIA-22."""
    s = W.noise_adjusted_survival(*_parts(spark, d))
    return s.select("judge", "n_categories", "survived", r6("noise").alias("noise"), r6("adjusted").alias("adjusted"))


@add(f"""WITH {_TOP}, g AS (SELECT {DOMAIN_SQL} AS domain, term, min(p) AS p FROM tp GROUP BY ALL) SELECT domain, rank, term FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY round_even(log10(greatest(p, 1e-290)), 6), term)::INTEGER AS rank FROM g) WHERE rank <= 8""")
def domain_keywords(spark, d):
    """AGG-20, DIA-17: smallest p of each term over a group of categories."""
    t = L.top_terms(L.enrichment(_counts(spark, d)[2]), 15).withColumn("domain", domain_of(F.col("label")))
    g = t.groupBy("domain", "term").agg(F.min("p").alias("p"))
    return V.top_by(g, ["domain"], [F.bround(F.log10(F.greatest("p", F.lit(1e-290))), 6), F.col("term")], 8).select("domain", "rank", "term")


@add("WITH " + _TWO + " SELECT 'H' || h AS h, " + ", ".join(f"round_even(max(cosine) FILTER (f = {k}), 6) AS \"F{k}\"" for k in range(10)) + " FROM ed GROUP BY h")
def similarity_matrix(spark, d):
    """PVT-05: the wide form, at the sink only."""
    e, _ = _edges(spark, d)
    wide = e.groupBy(F.concat(F.lit("H"), F.col("h").cast("string")).alias("h")).pivot("f", list(range(10))).agg(r6(F.max("cosine")))
    return wide.select("h", *[F.col(str(k)).alias(f"F{k}") for k in range(10)])


@add(f"WITH {V_SQL}, mp AS (SELECT unnest(range(9))::INTEGER AS label) SELECT count(*) = 0 AS applies, count(*)::BIGINT AS n_missing FROM (SELECT DISTINCT label FROM v WHERE label <> -1 AND label NOT IN (SELECT label FROM mp))")
def domain_map_applies(spark, d):
    """PRJ-12."""
    return W.map_covers(vectors(spark, d).filter("label <> -1"), spark.range(9).select(F.col("id").cast("int").alias("label")))


@add("SELECT * FROM (VALUES (1, 'recovery', 0.3::DOUBLE), (2, 'pass', 0.5::DOUBLE), (3, 'majority', 0.5::DOUBLE), (4, 'coverage', 0.4::DOUBLE)) t(position, criterion, threshold)")
def criteria_table(spark, d):
    """REP-03, PRJ-11: literal tables come from the settings."""
    s = Settings()
    return spark.createDataFrame([(1, "recovery", s.recovery), (2, "pass", s.pass_at), (3, "majority", s.majority), (4, "coverage", s.tau)], "position int, criterion string, threshold double")


@add(f"WITH {V_SQL}, a AS (SELECT label, avg(id % 5) AS single FROM v WHERE label <> -1 GROUP BY label), b AS (SELECT label, avg(id % 3) AS mc FROM v WHERE label <> -1 AND label % 2 = 0 GROUP BY label) SELECT label, round_even(coalesce(mc, single), 6) AS score, mc IS NOT NULL AS from_replicates FROM a LEFT JOIN b USING (label)")
def diagnostic_detail(spark, d):
    """REP-04: replicate results go before single passes."""
    v = vectors(spark, d).filter("label <> -1")
    a = v.groupBy("label").agg(F.avg(F.col("id") % 5).alias("single"))
    b = v.filter("label % 2 = 0").groupBy("label").agg(F.avg(F.col("id") % 3).alias("mc"))
    return a.join(b, "label", "left").select("label", r6(F.coalesce("mc", "single")).alias("score"), F.col("mc").isNotNull().alias("from_replicates"))


@add("""WITH s AS (SELECT DISTINCT video_id AS session FROM sessions WHERE video_id IS NOT NULL), r AS (SELECT session, row_number() OVER (ORDER BY sha256('42-' || session), session) AS rn, count(*) OVER () AS n FROM s)
SELECT session, 10 * rn <= 7 * n AS train FROM r""")
def session_split(spark, d):
    """SMP-01, SMP-02, SMP-06: a seeded share of the sessions trains, the first in a portable hash order."""
    s = table(spark, d, "sessions").filter("video_id is not null").select(F.col("video_id").alias("session")).distinct()
    ranked = positional_ids(s.withColumn("h", F.sha2(F.concat(F.lit("42-"), "session"), 256)), ["h", "session"], "at")
    return ranked.select("session", (10 * (F.col("at") + 1) <= 7 * F.lit(s.count())).alias("train"))


@add()
def seed_stability(spark, d):
    """DIA-21: partitions under other seeds (here: rotated projections) against the first one."""
    p = Workspace(spark, "seeds").write(M.project(vectors(spark, d), 5).select("id", "proj"), "proj")
    base = M.kmeans_best(p, 10, 1, 42).select("id", F.col("label").alias("la"))
    parts = None
    for seed in (1, 2, 3):
        one = M.kmeans_best(p, 10, 1, seed).select(F.lit(seed).alias("seed"), "id", F.col("label").alias("lb"))
        parts = one if parts is None else parts.unionByName(one)
    return C.agreement(base, parts, ["seed"])


@add()
def encoder_chance(spark, d):
    """STT-11, DIA-18: agreement of two groupings of the categories against shuffled labels."""
    g = M.category_groups(V.centroids(vectors(spark, d)), 4, 0.3, trials=10).orderBy("label").collect()
    a, b = np.array([r["ward"] for r in g]), np.array([r["louvain"] for r in g])

    def nmi(x, y):
        t = np.array([[((x == i) & (y == j)).sum() for j in np.unique(y)] for i in np.unique(x)], float) / max(1, len(x))
        h = lambda p: -(p[p > 0] * np.log(p[p > 0])).sum()
        hx, hy, hxy = h(t.sum(1)), h(t.sum(0)), h(t.ravel())
        return 1.0 if hx + hy == 0 else 2 * (hx + hy - hxy) / (hx + hy)

    obs, mean, p = N.label_chance(a, b, 2000, nmi)
    return spark.createDataFrame([(obs, mean, p)], "observed double, null_mean double, p double")


@add()
def subcluster_profile(spark, d):
    """DIA-16: Ward's three groups within each of the three largest categories."""
    p = M.project(vectors(spark, d), 5)
    top = p.filter("label <> -1").groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(3)

    inside = p.select("id", "label", "proj").join(top.select("label"), "label", "left_semi")
    return M.subgroups(inside, 3).groupBy("label", "sub").agg(F.count(F.lit(1)).alias("n"))


@add()
def register_correspondence(spark, d):
    """XR-06, XR-09: edges, null thresholds and relations in one run."""
    v = vectors(spark, d)
    first, second = v.filter("id % 2 = 0"), v.filter("id % 2 = 1")
    cents = V.centroids(first)
    null = Workspace(spark, "null").write(N.permutation_null(second, cents, 200), "null")
    pooled = null.agg(F.percentile("best", 0.95).alias("p")).first()["p"]
    th = N.null_thresholds(null).select("h", F.col("null_p95").alias("own"))
    return R.relations(R.similarity_edges(cents, V.centroids(second)), th, float(pooled))


@add()
def cumulative_recovery_ci(spark, d):
    """STT-20: categories recovered by at least so many pipelines, with intervals."""
    from tessera.operators.diagnose import recovery
    from tessera.queries.diagnose import _scores

    return N.cumulative_ci(recovery(_scores(spark, d), ["run_id", "p1_cluster"]), 6)


@add()
def entity_spans(spark, d):
    """TXT-06: the recogniser hook, here with runs of capitalised words inside a sentence."""
    import re

    from tessera.operators.corpus import mask_entities

    pattern = re.compile(r"(?<=[a-z,] )[A-Z][a-z]+(?: [A-Z][a-z]+)*")
    s = sentences(spark, d).select("sentence_id", "text")
    return mask_entities(s, lambda t: [(m.start(), m.end(), "NAME") for m in pattern.finditer(t)]).select("sentence_id", "masked")
