"""Composition and register queries: the series are events, each in two registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.math import r6
from tessera.operators import compose as C
from tessera.operators import registers as R
from tessera.operators.vectors import centroids
from tessera.queries.base import C_SQL, DOMAIN_SQL, DOMAINS, R_SQL, Family, domain_of, registered, vectors

family = Family()
add = family.add
CATS = "(SELECT unnest(range(9))::INTEGER AS category)"


def _categories(spark):
    return spark.range(9).select(F.col("id").cast("int").alias("category"))


def _prev(spark, d):
    return C.prevalence(registered(spark, d), _categories(spark))


_P = R_SQL + f""", cn AS (SELECT event, register, label AS category, count(*) AS n FROM r GROUP BY ALL), tt AS (SELECT event, register, sum(n) AS n_total, coalesce(sum(n) FILTER (category <> -1), 0) AS n_assigned FROM cn GROUP BY ALL),
pv AS (SELECT tt.event, tt.register, cc.category, coalesce(cn.n, 0) AS n_category, n_total, n_assigned, coalesce(cn.n, 0)::DOUBLE / n_total AS p_all, coalesce(cn.n, 0)::DOUBLE / nullif(n_assigned, 0) AS p_assigned FROM tt CROSS JOIN {CATS} cc LEFT JOIN cn ON cn.event = tt.event AND cn.register = tt.register AND cn.category = cc.category),
dl AS (SELECT event, category, max(p_all) FILTER (register = 'HIGHLIGHT') - max(p_all) FILTER (register = 'FULL_RACE') AS delta_p_all, max(p_assigned) FILTER (register = 'HIGHLIGHT') - max(p_assigned) FILTER (register = 'FULL_RACE') AS delta_p_assigned FROM pv GROUP BY ALL HAVING count(DISTINCT register) = 2)"""
_SIGN = "round_even(least(1.0::DOUBLE, 2 * list_sum(list_transform(generate_series(greatest(greatest(ng, ps), n - greatest(ng, ps)), n), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))))), 6)"


def _summary_sql(source: str, keys: str, value: str) -> str:
    return f"""sm AS (SELECT {keys}, count({value}) AS n, avg({value}) AS mean, stddev_samp({value}) AS sd, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3, min({value}) AS lo, max({value}) AS hi, count(*) FILTER ({value} < 0) AS ng, count(*) FILTER ({value} > 0) AS ps FROM {source} GROUP BY ALL)
SELECT {keys}, n::BIGINT AS n, round_even(mean, 6) AS mean, round_even(sd, 6) AS sd, round_even(q1, 6) AS q1, round_even(median, 6) AS median, round_even(q3, 6) AS q3, round_even(lo, 6) AS lowest, round_even(hi, 6) AS highest, ng::BIGINT AS n_negative, ps::BIGINT AS n_positive, {_SIGN} AS sign_p FROM sm"""


@add(f"WITH {_P} SELECT event, register, category, n_category::BIGINT AS n_category, n_total::BIGINT AS n_total, n_assigned::BIGINT AS n_assigned, round_even(p_all, 6) AS p_all, round_even(p_assigned, 6) AS p_assigned FROM pv")
def prevalence(spark, d):
    """COMP-01, AGG-24, JOIN-16."""
    p = _prev(spark, d)
    return p.select("event", "register", "category", "n_category", "n_total", "n_assigned", r6("p_all").alias("p_all"), r6("p_assigned").alias("p_assigned"))


@add(f"WITH {_P} SELECT event, category, round_even(delta_p_all, 6) AS delta_p_all, round_even(delta_p_assigned, 6) AS delta_p_assigned FROM dl")
def event_deltas(spark, d):
    """COMP-02, JOIN-15, PVT-01, PVT-03."""
    e = C.event_deltas(_prev(spark, d))
    return e.select("event", "category", r6("delta_p_all").alias("delta_p_all"), r6("delta_p_assigned").alias("delta_p_assigned"))


@add(f"WITH {_P}, {_summary_sql('dl', 'category', 'delta_p_all')}")
def category_effects(spark, d):
    """COMP-03, COMP-13, STT-04."""
    return C.summarise(C.event_deltas(_prev(spark, d)), ["category"], "delta_p_all")


@add(f"WITH {_P} SELECT a.category, a.event AS omitted, round_even(quantile_cont(b.delta_p_all, 0.5), 6) AS median, sign(quantile_cont(b.delta_p_all, 0.5))::INTEGER AS sign FROM dl a LEFT JOIN dl b ON a.category = b.category AND a.event <> b.event GROUP BY ALL")
def loo_event(spark, d):
    """WIN-08, COMP-13."""
    return C.leave_one_out(C.event_deltas(_prev(spark, d)), ["category"], "delta_p_all").withColumn("median", r6("median"))


def _domain(spark, d):
    r = registered(spark, d).filter("label <> -1").withColumn("domain", domain_of(F.col("label")))
    return C.domain_counts(r.select("event", "register", "domain"), DOMAINS, ["event", "register"])


_D = R_SQL + f""", dm AS (SELECT event, register, {DOMAIN_SQL} AS domain FROM r WHERE label <> -1), dk AS (SELECT DISTINCT event, register FROM dm), dd AS (SELECT unnest(['{"', '".join(DOMAINS)}']) AS domain),
dc AS (SELECT dk.event, dk.register, dd.domain, count(dm.event) AS n FROM dk CROSS JOIN dd LEFT JOIN dm ON dm.event = dk.event AND dm.register = dk.register AND dm.domain = dd.domain GROUP BY ALL)"""


def _rep_sql(src: str, keys: str) -> str:
    z = f"""zt AS (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS tot, count(*) FILTER (n = 0) OVER (PARTITION BY {keys}) AS nz, count(*) OVER (PARTITION BY {keys}) AS np FROM {src}),
zv AS (SELECT *, CASE WHEN tot = 0 THEN 1.0::DOUBLE / np WHEN n = 0 THEN 0.5::DOUBLE / tot ELSE n::DOUBLE / tot * (1 - nz * 0.5::DOUBLE / tot) END AS vv FROM zt), zp AS (SELECT *, vv / sum(vv) OVER (PARTITION BY {keys}) AS p FROM zv),
zc AS (SELECT *, ln(p) - avg(ln(p)) OVER (PARTITION BY {keys}) AS clr FROM zp)"""
    bal = []
    for k in range(len(DOMAINS) - 1):
        den = "', '".join(DOMAINS[k + 1 :])
        s = len(DOMAINS) - 1 - k
        bal.append(f"sqrt({s}::DOUBLE / {s + 1}) * (avg(ln(p)) FILTER (domain = '{DOMAINS[k]}') - avg(ln(p)) FILTER (domain IN ('{den}'))) AS b{k + 1}")
    rep = f"rep AS (SELECT {keys}, sum(n) FILTER (domain = 'Alpha')::DOUBLE / nullif(sum(n), 0) AS raw, ln(max(p) FILTER (domain = 'Alpha') / (1 - max(p) FILTER (domain = 'Alpha'))) AS logit, max(clr) FILTER (domain = 'Alpha') AS clr, {', '.join(bal)} FROM zc GROUP BY ALL)"
    return z + ", " + rep


_RV = ["raw", "logit", "clr", "b1", "b2", "b3"]


def _delta_sql(keys: str) -> str:
    return "rd AS (" + " UNION ALL ".join(f"SELECT {keys}, '{v}' AS representation, max({v}) FILTER (register = 'HIGHLIGHT') - max({v}) FILTER (register = 'FULL_RACE') AS delta FROM rep GROUP BY {keys} HAVING count(DISTINCT register) = 2" for v in _RV) + ")"


_Z = _D + ", " + _rep_sql("dc", "event, register") + ", " + _delta_sql("event")


def _rep(spark, d):
    z = C.zero_replaced(_domain(spark, d), ["event", "register"])
    return C.representation(z, ["event", "register"], DOMAINS, "Alpha")


@add(f"WITH {_D} SELECT event, register, " + ", ".join(f"max(n) FILTER (domain = '{x}')::BIGINT AS \"{x}\"" for x in DOMAINS) + " FROM dc GROUP BY ALL")
def domain_wide(spark, d):
    """PVT-02, AGG-18."""
    return _domain(spark, d).groupBy("event", "register").pivot("domain", list(DOMAINS)).agg(F.max("n"))


@add(f"WITH {_Z} SELECT event, register, domain, n::BIGINT AS n, nz::BIGINT AS n_zero, round_even(p, 6) AS p, round_even(clr, 6) AS clr FROM zc")
def zero_replace(spark, d):
    """COMP-04, COMP-05."""
    z = C.clr(C.zero_replaced(_domain(spark, d), ["event", "register"]), ["event", "register"])
    return z.select("event", "register", "domain", "n", "n_zero", r6("p").alias("p"), r6("clr").alias("clr"))


@add(f"WITH {_Z} SELECT event, register, " + ", ".join(f"round_even({v}, 6) AS {v}" for v in _RV) + " FROM rep")
def ilr(spark, d):
    """COMP-05..07, MTH-01: raw share, logit, centred log-ratio and balances."""
    return _rep(spark, d).select("event", "register", *[r6(v).alias(v) for v in _RV])


@add(f"WITH {_Z} SELECT event, representation, round_even(delta, 6) AS delta FROM rd")
def logit_delta(spark, d):
    """COMP-07, PVT-04."""
    return C.representation_deltas(_rep(spark, d), ["event"]).withColumn("delta", r6("delta"))


@add(f"WITH {_Z}, {_summary_sql('rd', 'representation', 'delta')}")
def composition_summary(spark, d):
    """COMP-08..10, COMP-16."""
    return C.summarise(C.representation_deltas(_rep(spark, d), ["event"]), ["representation"], "delta")


@add("SELECT n::BIGINT AS n, ng::BIGINT AS n_negative, ps::BIGINT AS n_positive, " + _SIGN + " AS p FROM (SELECT * FROM (VALUES (10, 10, 0), (10, 9, 1), (10, 2, 8), (10, 7, 3), (10, 5, 5), (10, 3, 3), (1, 0, 1), (20, 4, 16)) t(n, ng, ps))")
def sign_test(spark, d):
    """STT-04, COMP-09."""
    from tessera.functions.math import sign_test_p

    rows = spark.createDataFrame([(10, 10, 0), (10, 9, 1), (10, 2, 8), (10, 7, 3), (10, 5, 5), (10, 3, 3), (1, 0, 1), (20, 4, 16)], "n long, n_negative long, n_positive long")
    return rows.withColumn("p", r6(sign_test_p(F.col("n_negative"), F.col("n_positive"), F.col("n"))))


def _variants(spark, d, moves):
    base = _categories(spark).withColumn("domain", domain_of(F.col("category")))
    maps = C.variant_maps(base, moves)
    # one grouped query for all variants: the map's variant is one more key
    r = registered(spark, d).filter("label <> -1").groupBy("event", "register", F.col("label").alias("category")).agg(F.count(F.lit(1)).alias("c"))
    keys = ["variant", "event", "register"]
    mapped = r.join(F.broadcast(maps), "category").filter("domain is not null")
    wide = mapped.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("domain") == x, F.col("c"))), F.lit(0)).alias(x) for x in DOMAINS])
    full = wide.unpivot(keys, list(DOMAINS), "domain", "n")
    rep = C.representation(C.zero_replaced(full, keys), keys, DOMAINS, "Alpha")
    return C.summarise(C.representation_deltas(rep, ["variant", "event"]).filter("representation = 'clr'"), ["variant"], "delta")


def _variant_sql(moves: str) -> str:
    return R_SQL + f""", bs AS (SELECT category, {DOMAIN_SQL.replace('label', 'category')} AS domain FROM {CATS}), mv AS ({moves}),
mp AS (SELECT v.variant, bs.category, CASE WHEN mv.category IS NOT NULL THEN mv.domain ELSE bs.domain END AS domain FROM (SELECT DISTINCT variant FROM mv) v CROSS JOIN bs LEFT JOIN mv ON mv.variant = v.variant AND mv.category = bs.category UNION ALL SELECT 'base', category, domain FROM bs),
cn AS (SELECT event, register, label AS category, count(*) AS c FROM r WHERE label <> -1 GROUP BY ALL), nn AS (SELECT variant, event, register, domain, sum(c) AS n FROM cn JOIN mp USING (category) WHERE domain IS NOT NULL GROUP BY ALL),
dd AS (SELECT unnest(['{"', '".join(DOMAINS)}']) AS domain), dc AS (SELECT k.variant, k.event, k.register, dd.domain, coalesce(nn.n, 0) AS n FROM (SELECT DISTINCT variant, event, register FROM nn) k CROSS JOIN dd LEFT JOIN nn ON nn.variant = k.variant AND nn.event = k.event AND nn.register = k.register AND nn.domain = dd.domain),
{_rep_sql('dc', 'variant, event, register')}, rd AS (SELECT variant, event, max(clr) FILTER (register = 'HIGHLIGHT') - max(clr) FILTER (register = 'FULL_RACE') AS delta FROM rep GROUP BY variant, event HAVING count(DISTINCT register) = 2), {_summary_sql('rd', 'variant', 'delta')}"""


@add("WITH " + _variant_sql(f"SELECT 'without ' || category AS variant, category, NULL::VARCHAR AS domain FROM {CATS}"))
def domain_membership_loo(spark, d):
    """COMP-11, COMP-12: every category left out in turn."""
    moves = _categories(spark).select(F.concat(F.lit("without "), F.col("category").cast("string")).alias("variant"), "category", F.lit(None).cast("string").alias("domain"))
    return _variants(spark, d, moves)


@add("WITH " + _variant_sql("SELECT 'move 3' AS variant, 3 AS category, 'Alpha' AS domain UNION ALL SELECT 'move 4', 4, 'Beta' UNION ALL SELECT 'both', 3, 'Alpha' UNION ALL SELECT 'both', 4, 'Beta'"))
def boundary_reassign(spark, d):
    """COMP-12: boundary categories moved, one by one and together."""
    moves = spark.createDataFrame([("move 3", 3, "Alpha"), ("move 4", 4, "Beta"), ("both", 3, "Alpha"), ("both", 4, "Beta")], "variant string, category int, domain string")
    return _variants(spark, d, moves)


@add(f"""WITH {_Z}, w AS (SELECT event, max(raw) FILTER (register = 'HIGHLIGHT') AS share_primary, max(raw) FILTER (register = 'FULL_RACE') AS share_second FROM rep GROUP BY event HAVING count(DISTINCT register) = 2), g AS (SELECT event, count(*) FILTER (register = 'HIGHLIGHT') AS n_primary, count(*) FILTER (register = 'FULL_RACE') AS n_second FROM r GROUP BY event)
SELECT event, n_primary::BIGINT AS n_primary, n_second::BIGINT AS n_second, round_even(share_primary, 6) AS share_primary, round_even(share_second, 6) AS share_second, round_even(share_primary - share_second, 6) AS delta, CASE WHEN share_primary < share_second THEN 'lower' WHEN share_primary > share_second THEN 'higher' ELSE 'equal' END AS direction FROM w JOIN g USING (event)""")
def matched_event_comparison(spark, d):
    """COMP-14, AGG-18, PRJ-10."""
    rep = C.by_register(_rep(spark, d).select("event", "register", "raw"), ["event"], ["raw"])
    g = registered(spark, d).groupBy("event").agg(F.count_if(F.col("register") == "HIGHLIGHT").alias("n_primary"), F.count_if(F.col("register") == "FULL_RACE").alias("n_second"))
    a, b = F.col("raw_HIGHLIGHT"), F.col("raw_FULL_RACE")
    return rep.join(g, "event").select("event", "n_primary", "n_second", r6(a).alias("share_primary"), r6(b).alias("share_second"), r6(a - b).alias("delta"), F.when(a < b, "lower").when(a > b, "higher").otherwise("equal").alias("direction"))


@add(f"""WITH {_Z}, md AS (SELECT representation, median(delta) AS m, count(*) FILTER (delta < 0) AS ng, count(*) FILTER (delta > 0) AS ps, count(*) AS n FROM rd GROUP BY representation)
SELECT representation, round_even(m, 6) AS median, n::BIGINT AS n_events, CASE WHEN m < 0 THEN 'lower' WHEN m > 0 THEN 'higher' ELSE 'none' END || ' in ' || greatest(ng, ps) || ' of ' || n AS direction FROM md""")
def compositional_sensitivity(spark, d):
    """COMP-15, AGG-19."""
    s = C.representation_deltas(_rep(spark, d), ["event"]).groupBy("representation").agg(F.percentile("delta", 0.5).alias("m"), F.count_if(F.col("delta") < 0).alias("ng"), F.count_if(F.col("delta") > 0).alias("ps"), F.count(F.lit(1)).alias("n_events"))
    word = F.when(F.col("m") < 0, "lower").when(F.col("m") > 0, "higher").otherwise("none")
    return s.select("representation", r6("m").alias("median"), "n_events", F.format_string("%s in %d of %d", word, F.greatest("ng", "ps"), F.col("n_events")).alias("direction"))


@add(f"""WITH {R_SQL}, ev AS (SELECT event FROM r GROUP BY event HAVING count(DISTINCT register) = 2), x AS (SELECT label AS category, count(*) AS s, count(DISTINCT event) AS e FROM r WHERE register = 'FULL_RACE' AND event IN (SELECT event FROM ev) GROUP BY label)
SELECT c.category, coalesce(s, 0)::BIGINT AS matched_sentences, coalesce(e, 0)::BIGINT AS matched_events, CASE WHEN s >= 15 AND e >= 5 THEN 'WELL' WHEN s >= 5 AND e >= 2 THEN 'SPARSE' ELSE 'ABSENT' END AS availability FROM {CATS} c LEFT JOIN x USING (category)""")
def availability(spark, d):
    """XR-05, JOIN-07."""
    r = registered(spark, d)
    ev = r.groupBy("event").agg(F.countDistinct("register").alias("k")).filter("k = 2").select("event")
    return R.availability(r.filter("register = 'FULL_RACE'"), _categories(spark), ev)


_TWO = C_SQL.split(", cm AS")[0] + "".join(f""", cm{k} AS (SELECT label, p, avg(vec[p]) AS m FROM (SELECT label, vec, unnest(generate_series(1, len(vec))) AS p FROM v WHERE label <> -1 AND id % 2 = {k}) GROUP BY ALL), cz{k} AS (SELECT label, list(m ORDER BY p) AS mu FROM cm{k} GROUP BY label), ce{k} AS (SELECT label, list_transform(mu, lambda x: x / sqrt(list_dot_product(mu, mu))) AS vec FROM cz{k})""" for k in (0, 1)) + """, ed AS (SELECT a.label AS h, b.label AS f, list_dot_product(a.vec, b.vec) AS cosine FROM ce0 a, ce1 b),
th AS (SELECT label AS h, 0.30::DOUBLE + (label % 5) / 20.0::DOUBLE AS own FROM ce0)"""


def _edges(spark, d):
    v = vectors(spark, d)
    a, b = centroids(v.filter("id % 2 = 0")), centroids(v.filter("id % 2 = 1"))
    th = a.select(F.col("label").alias("h"), (F.lit(0.30) + (F.col("label") % 5) / F.lit(20.0)).alias("own"))
    return R.similarity_edges(a, b), th


@add(f"WITH {_TWO} SELECT h, f, round_even(cosine, 6) AS cosine FROM ed")
def similarity_edges(spark, d):
    """XR-06, JOIN-10: the two halves of the documents as registers."""
    return _edges(spark, d)[0].withColumn("cosine", r6("cosine"))


_REL = _TWO + """, ab AS (SELECT h, count(*) AS n FROM ed JOIN th USING (h) WHERE cosine > own GROUP BY h), st AS (SELECT h, f FROM ed JOIN th USING (h) WHERE cosine > greatest(own, 0.40::DOUBLE)), sh AS (SELECT f FROM st GROUP BY f HAVING count(*) >= 2), mg AS (SELECT h, count(*) AS n FROM st WHERE f IN (SELECT f FROM sh) GROUP BY h),
bt AS (SELECT h, f, cosine FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY cosine DESC, f) AS rn FROM ed) WHERE rn = 1),
rl AS (SELECT th.h, bt.f AS best_match, round_even(bt.cosine, 6) AS best_cosine, coalesce(ab.n, 0) AS n_above, CASE WHEN coalesce(ab.n, 0) = 0 THEN 'NON_RECOVERY' WHEN ab.n >= 2 THEN 'SPLIT' WHEN coalesce(mg.n, 0) > 0 THEN 'MERGE' ELSE 'SINGLE_MATCH' END AS relation FROM th LEFT JOIN bt USING (h) LEFT JOIN ab USING (h) LEFT JOIN mg USING (h))"""


@add(f"WITH {_REL} SELECT h, best_match, best_cosine, n_above::BIGINT AS n_above, relation FROM rl")
def relation_class(spark, d):
    """XR-07 with the stricter merge rule."""
    e, th = _edges(spark, d)
    return R.relations(e, th, 0.40)


@add(f"""WITH {_REL}, o AS (SELECT * FROM (VALUES (0, 'SINGLE_MATCH'), (1, 'SPLIT'), (2, 'MERGE'), (3, 'NON_RECOVERY')) t(position, relation))
SELECT position, o.relation, count(h)::BIGINT AS n, count(h) FILTER (h % 2 = 0)::BIGINT AS n_well FROM o LEFT JOIN rl USING (relation) GROUP BY ALL""")
def correspondence_summary(spark, d):
    """AGG-16, SRT-04."""
    e, th = _edges(spark, d)
    rel = R.relations(e, th, 0.40)
    return R.correspondence_summary(rel, th.filter("h % 2 = 0").select("h"))


@add(f"WITH {_TWO} SELECT DISTINCT f FROM ed WHERE f NOT IN (SELECT f FROM ed JOIN th USING (h) WHERE cosine > own)")
def unmatched_second(spark, d):
    """XR-07, JOIN-08."""
    return R.unmatched_second(*_edges(spark, d))


@add(f"""WITH {R_SQL}, rs AS (SELECT session, label FROM r WHERE register = 'HIGHLIGHT'), t AS (SELECT count(DISTINCT session) AS a, count(DISTINCT session) FILTER (label <> -1) AS c FROM rs)
SELECT label AS cluster, count(*)::BIGINT AS size, count(DISTINCT session)::BIGINT AS n_sessions, count(DISTINCT session) = any_value(a) AS universal, count(DISTINCT session) = any_value(c) AS universal_clustered FROM rs, t WHERE label <> -1 GROUP BY label""")
def universality(spark, d):
    """AGG-15 with both definitions of all sessions."""
    return R.universality(registered(spark, d).filter("register = 'HIGHLIGHT'").select("session", "label"))


@add(f"""WITH {R_SQL}, p AS (SELECT label, count(DISTINCT session) AS n_sessions FROM r WHERE label <> -1 GROUP BY label) SELECT n_sessions::BIGINT AS n_sessions, count(*)::BIGINT AS n_clusters FROM p GROUP BY n_sessions""")
def spread_histogram(spark, d):
    """FIG-02."""
    return R.spread_histogram(R.universality(registered(spark, d).select("session", "label")))
