import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import compare as C
from tessera.operators import compose as P
from tessera.operators import corpus as O
from tessera.operators import diagnose as D
from tessera.operators import kernels as K
from tessera.operators import lexical as L
from tessera.operators import models as M
from tessera.operators import nulls as N
from tessera.operators import registers as R
from tessera.operators import report as S
from tessera.operators import vectors as V


def test_mask_longest_first_with_possessive(spark):
    pats = [("max", "PERSON"), ("max power", "TEAM"), ("team", "DROP")]
    df = spark.createDataFrame([("Max Power's car and max's team",), ("maxi stays",)], "t string")
    got = [r.m for r in df.select(O.mask_expression(F.col("t"), pats).alias("m")).collect()]
    # one by one, as defined: a later variant may match inside a placeholder put in before it
    assert got == ["< > car and <PERSON>", "maxi stays"]
    mask = O.compile_masker([("max", "PERSON"), ("max power", "TEAM"), ("team", "DROP")])
    # the automaton reads the text once, so placeholders stay whole
    assert mask("Max Power's car and max's team") == "<TEAM> car and <PERSON>" and mask("maxi stays") == "maxi stays"


def test_mask_keeps_letters_with_longer_lower_case_and_blanks_other_classes(spark):
    mask = O.compile_masker([("ali veli", "PERSON"), ("acme", "SPONSOR"), ("person", "PLACE")])
    assert mask("İstanbul GP Winner ALI VELI") == "İstanbul GP Winner <PERSON>"
    assert mask("the Acme car") == "the car" and O.compile_masker([("acme", "SPONSOR")], ("SPONSOR",))("the Acme car") == "the <SPONSOR> car"
    names = spark.createDataFrame([("Ali Veli", "person", None), ("person", "PLACE", ["veli"]), ("acme", "sponsor", [])], "canonical string, category string, variants array<string>")
    df = spark.createDataFrame([(1, "İzmir: Ali Veli's person, Veli at Acme"), (2, None)], "sentence_id int, text string")
    whole = {r.sentence_id: r.masked for r in O.mask_sentences(df, names).collect()}
    # one variant at a time gives the same: what an earlier one put in is not read again
    assert whole == {r.sentence_id: r.masked for r in O.mask_sentences(df, names, max_variants=1).collect()}
    assert whole == {1: "İzmir: <PERSON> <PLACE>, <PLACE> at", 2: None}


def test_recogniser_spans_go_in_from_the_right(spark):
    df = spark.createDataFrame([("ann met <TEAM> bob",), (None,)], "text string")
    find = lambda t: [(0, 3, "P"), (4, 12, "Q"), (15, 18, "P"), (16, 18, "R")]
    assert [r.masked for r in O.mask_entities(df, find).collect()] == ["<P> met <TEAM> b<R>", None]


def test_cumulative_counts(spark):
    got = {r.level: r for r in N.cumulative_ci(spark.createDataFrame([(k % 4,) for k in range(40)], "n_recovered long"), 3, 500).collect()}
    assert [got[k].n for k in (1, 2, 3)] == [30, 20, 10] and all(r.low < r.n < r.high for r in got.values())


def test_load_needs_text_and_numbers_rows(spark):
    df = spark.createDataFrame([(3, " a b "), (1, None), (2, "one two three")], "k long, text string")
    got = O.load_sentences(df, ["k"], min_tokens=2).orderBy("position").collect()
    assert [(r.position, r.k, r.text, r.session) for r in got] == [(0, 2, "one two three", "all"), (1, 3, "a b", "all")]
    with pytest.raises(ValueError):
        O.load_sentences(df.drop("text"), ["k"])


def test_grams_drop_stop_words_first(spark):
    df = spark.createDataFrame([("cat of hats <PERSON> ran",), ("one",), (None,)], "t string")
    got = [r.g for r in df.select(L.grams(F.col("t"), ("of",), 2).alias("g")).collect()]
    assert got == [["cat", "hats", "ran", "cat hats", "hats ran"], ["one"], []]


def test_dedupe_keywords(spark):
    df = spark.createDataFrame([(["safety car", "car", "yellow", "yellow flag", "pit", "lap", "tyre"],)], "w array<string>")
    assert df.select(L.dedupe_keywords(F.col("w")).alias("k")).first().k == ["safety car", "yellow", "pit", "lap"]


def test_best_jaccard_ties_take_lowest(spark):
    a = spark.createDataFrame([(i, 0) for i in range(4)], "id long, la int")
    b = spark.createDataFrame([("j", i, 5 if i < 2 else 3) for i in range(4)], "judge string, id long, lb int")
    r = C.best_jaccard(a, b, ["judge"]).first()
    assert (r.matched, r.jaccard) == (3, 0.5)


def test_agreement_of_equal_partitions(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, la int")
    b = a.select(F.lit("x").alias("j"), "id", (F.col("la") * 2).alias("lb"))
    r = C.agreement(a, b, ["j"]).first()
    assert r.ari == pytest.approx(1) and r.nmi == pytest.approx(1)


def test_plateau_skips_dead_settings(spark):
    rows = [(10, 20), (15, 9), (20, 9), (25, 30), (30, 9), (35, 8)]
    got = C.plateau(spark.createDataFrame(rows, "mcs int, n_clusters int"), 9).first()
    assert (got["first"], got["last"], got["width"]) == (15, 20, 2)
    sweep = spark.createDataFrame([(100, 18, False, 0.1), (125, 16, False, 0.2), (150, 16, False, 0.3)], "mcs int, n_clusters int, degenerate boolean, dbcv double")
    assert C.granularity_core(sweep).first()["rule"] == "dbcv"


def test_zero_replacement_sums_to_one(spark):
    rows = [("a", "x", 0), ("a", "y", 3), ("a", "z", 7), ("b", "x", 0), ("b", "y", 0), ("b", "z", 0)]
    z = P.zero_replaced(spark.createDataFrame(rows, "e string, domain string, n long"), ["e"])
    by = {(r.e, r.domain): r for r in P.clr(z, ["e"]).collect()}
    for e in "ab":
        assert sum(by[e, d].p for d in "xyz") == pytest.approx(1)
        assert sum(by[e, d].clr for d in "xyz") == pytest.approx(0, abs=1e-12)
    assert by["a", "x"].p == pytest.approx(0.05) and by["b", "x"].p == pytest.approx(1 / 3) and by["b", "x"].n_zero == 3


def test_leave_one_out_single_event(spark):
    df = spark.createDataFrame([("c", "e1", 1.0), ("c", "e2", -2.0), ("c", "e3", 3.0), ("d", "e1", 1.0)], "c string, event string, x double")
    got = {(r.c, r.omitted): r.median for r in P.leave_one_out(df, ["c"], "x").collect()}
    assert got == {("c", "e1"): 0.5, ("c", "e2"): 2.0, ("c", "e3"): -0.5, ("d", "e1"): None}


def test_relations_use_the_stricter_merge_rule(spark):
    edges = spark.createDataFrame([(0, 0, 0.9), (1, 0, 0.9), (2, 1, 0.5), (3, 1, 0.5), (4, 2, 0.9), (4, 3, 0.8), (5, 3, 0.1)], "h int, f int, cosine double")
    th = spark.createDataFrame([(h, 0.4) for h in range(6)], "h int, own double")
    got = {r.h: r.relation for r in R.relations(edges, th, 0.6).collect()}
    assert got == {0: "MERGE", 1: "MERGE", 2: "SINGLE_MATCH", 3: "SINGLE_MATCH", 4: "SPLIT", 5: "NON_RECOVERY"}


def test_neighbours_and_silhouette_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = rng.integers(0, 3, 40)
    df = spark.createDataFrame([(i, int(lab[i]), x[i].tolist()) for i in range(40)], "id long, label int, vec array<double>")
    got = {(r.src, r["rank"]): r.dst for r in V.neighbours(df, 3, buckets=4).collect()}
    sim = x @ x.T
    np.fill_diagonal(sim, -9)
    assert all([got[i, k + 1] for k in range(3)] == np.argsort(-sim[i])[:3].tolist() for i in range(40))
    d = K.pairwise(x)
    for r in V.silhouette(df, buckets=4).collect():
        means = {c: d[r.id][(lab == c) & (np.arange(40) != r.id)].mean() for c in range(3)}
        a, b = means[r.label], min(v for c, v in means.items() if c != r.label)
        assert r.silhouette == pytest.approx((b - a) / max(a, b))


def test_nearest_centroid_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, i % 5, rng.normal(size=3).tolist()) for i in range(50)], "id long, label int, vec array<double>")
    c = V.centroids(df)
    whole = {r.id: (r.nearest, round(r.cosine, 12)) for r in V.nearest_centroid(df, c).collect()}
    monkeypatch.setattr(V, "BROADCAST_NUMBERS", 6)
    assert {r.id: (r.nearest, round(r.cosine, 12)) for r in V.nearest_centroid(df, c).collect()} == whole


def planted():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (100, 5)) for c in np.eye(5)[:4] * 4] + [rng.uniform(-3, 7, (60, 5))])
    return x, np.repeat([0, 1, 2, 3, -1], [100] * 4 + [60])


def test_density_clusters_find_planted_ones():
    x, y = planted()
    got, info = K.density_clusters(x, 20)
    assert len(set(got.tolist()) - {-1}) == 4
    assert all((got[y == c] == np.bincount(got[y == c] + 1).argmax() - 1).mean() > 0.95 for c in range(4))
    assert K.relative_validity(info["tree"], got) > 0
    assert (K.predict_density(x, got, info["core"], np.full((1, 5), 50.0), 20) == -1).all()


def test_ward_and_assignment():
    x, y = planted()
    w = K.ward(x[y >= 0], 4)
    assert all(len(set(w[y[y >= 0] == c].tolist())) == 1 for c in range(4))
    heights = K.ward_merges(x)[:, 2]
    assert (np.diff(heights) >= -1e-9).all()
    g = np.array([[5.0, 9, 1], [10, 3, 2]])
    assert K.hungarian(g) == [(0, 1), (1, 0)] and K.hungarian(g.T) == [(0, 1), (1, 0)]


def test_partition_beyond_the_fit_limit(spark):
    x, y = planted()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, proj array<double>")
    full = {r.id: r.label for r in M.density_partition(df, 15).collect()}
    part = {r.id: r.label for r in M.density_partition(df, 15, limit=300).collect()}
    assert len(full) == len(part) == len(x)
    assert len({part[i] for i in range(len(x)) if y[i] == 0} - {-1}) == 1


def test_replicate_roster_is_prefix_stable(spark):
    x, y = planted()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, proj array<double>")
    ref = spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "id long, label int")
    key = lambda rows: {(r.replicate, r.category): r.jaccard for r in rows}
    short = key(M.geometry_separability(df, ref, 10, 3).collect())
    longer = key(M.geometry_separability(df, ref, 10, 6).collect())
    assert all(longer[k] == v for k, v in short.items()) and len(longer) == 24
    # four planted clusters are fewer than the ten a viable replicate needs
    assert {r.status for r in M.resampling_stability(df, ref, 15, 4).collect()} == {"degenerate"}
    runs = M.resampling_stability(df, ref, 15, 4, least_clusters=3)
    assert {(r.n_fit, r.n_rows) for r in runs.collect()} == {(460, 460)}
    stable = D.replicate_summary(runs).collect()
    assert len(stable) == 4 and all(r.mean > 0.8 for r in stable)


def test_matched_length_null_mean_is_the_share(spark):
    df = spark.createDataFrame([("e", [300, 700], 50, 0.10), ("f", [5, 5], 100, 0.5)], "event string, domain_n array<long>, n_draw long, observed double")
    got = {r.event: r for r in N.matched_length_null(df, 4000).collect()}
    assert got["e"].mean == pytest.approx(0.3, abs=0.01)
    var = 0.3 * 0.7 / 50 * (1000 - 50) / 999
    assert got["e"].sd == pytest.approx(var**0.5, rel=0.08) and got["e"].below_p2_5
    assert got["f"].sd == 0


def test_permutation_null_keeps_sizes(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, int(i % 3) - 1, rng.normal(size=4).tolist()) for i in range(90)], "id long, label int, vec array<double>")
    null = N.permutation_null(df, V.centroids(df), 40, buckets=3)
    t = N.null_thresholds(null).collect()
    assert len(t) == 2 and all(r.replicates == 40 and -1 <= r.null_p95 <= 1 for r in t)
    obs = spark.createDataFrame([(0, 2.0), (1, -2.0)], "h int, observed double")
    p = {r.h: r.p for r in N.empirical_p(null, obs).collect()}
    assert p == {0: pytest.approx(1 / 41), 1: pytest.approx(1.0)}
    assert N.empirical_p(null, obs, plus_one=False).filter("h = 0").first().p == 0


def test_session_bootstrap_brackets_the_share(spark):
    df = spark.createDataFrame([(f"s{i}", i % 7, 10) for i in range(60)], "session string, hits long, n long")
    r = N.session_bootstrap(df, 500, buckets=3).first()
    assert r.low < r.coverage_pct < r.high and r.replicates == 500


def test_shuffle_null_bounds(spark):
    df = spark.createDataFrame([(f"s{i % 4}", i % 3) for i in range(120)], "session string, label int")
    null = N.shuffle_null(df, 20)
    assert null.agg(F.max("n_universal")).first()[0] <= 3
    v = N.null_verdict(null, 0).first()
    assert v.p_high == 1.0


def test_contiguous_null_reports_infeasible(spark):
    df = spark.createDataFrame([("a", i, i % 2 == 0) for i in range(40)], "session string, position long, hit boolean")
    got = {r.k: r for r in N.contiguous_null(df, (1, 5, 20), 0.3, 300).collect()}
    assert got[1].mean == pytest.approx(0.5, abs=0.05) and got[20].status == "infeasible"


def test_prose_and_leaks(spark):
    rows = [("the quick car went round the whole track and then it stopped",), ("gap, lap, tyre, flag, wing, stop, pit, radio, north wall",), ("short text",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert [r.p for r in df.select(S.prose_like(F.col("t")).alias("p")).collect()] == [True, False, False, False]
    many = spark.createDataFrame(rows[:1] * 3, "t string")
    assert S.prose_leaks(many, ["t"]).first().n == 3 and S.prose_leaks(df, ["t"]).count() == 0
    assert S.strip_text(df, ["t"]).columns == ["t_sha1"]


def test_alpha_of_full_agreement(spark):
    df = spark.createDataFrame([("s", i, r, "abc"[i % 3]) for i in range(6) for r in range(3)], "s string, item int, rater int, v string")
    assert S.krippendorff_alpha(df, ["item"], "v", ["s"]).first().alpha == pytest.approx(1)
    k = S.cohen_kappa(df, ["s", "item"], "rater", "v").collect()
    assert len(k) == 3 and all(r.kappa == pytest.approx(1) for r in k)


def test_universality_keeps_both_definitions(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("c", -1), ("a", 1)], "session string, label int")
    got = {r.cluster: (r.universal, r.universal_clustered) for r in R.universality(df).collect()}
    assert got == {0: (False, True), 1: (False, False)}


def test_judges_label_rows_beyond_the_fit(spark):
    from tessera.operators.models import judge_partitions

    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 0.1, 2) + [8.0 * (i % 3), 0]).tolist()) for i in range(120)]
    got = judge_partitions(spark.createDataFrame(rows, "id bigint, proj array<double>"), 3, 9, limit=60).toPandas()
    assert got.groupby("judge")["id"].nunique().to_dict() == {j: 120 for j in ("ward", "optics", "communities", "kmeans")} and len(got) == 480
    ward = got[got["judge"] == "ward"].set_index("id")["label"]
    assert all(ward[ward.index % 3 == k].nunique() == 1 for k in range(3)) and ward.nunique() == 3


def test_heldout_centroids_by_hand(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(k, 0, a, True) for k in range(3)] + [(k, 1, b, True) for k in range(3, 6)] + [(k, 2, c, True) for k in range(6, 8)] + [(k, 3, [0.0, 0.6, 0.8], True) for k in range(8, 11)]
    # of category 0 one of four comes back, two go to 1, one to 3; of category 1 all; 2 has too few to train, 3 none held out
    rows += [(20, 0, a, False), (21, 0, b, False), (22, 0, b, False), (23, 0, c, False), (24, 1, b, False), (25, 2, c, False), (26, -1, a, False)]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>, train boolean")
    got = {r.label: (r.n_test, r.strict, r.direction, r.score) for r in D.heldout_centroids(df, F.col("train")).collect()}
    assert got == {0: (4, 0.25, 0.5, 0.25), 1: (1, 1.0, 1.0, 1.0), 2: (1, 0.0, 0.0, 0.0), 3: (0, 0.0, 0.0, 0.0)}


def test_chance_agreement_of_random_labelings():
    # the published value for four groups of 34 items
    assert M.agreement_by_chance(34, 4) == pytest.approx(0.3934, abs=5e-5)
    assert M.agreement_by_chance(0, 4) == 0.0


def test_blocks_are_distinct_places_moved_on():
    rng = np.random.default_rng(0)
    sizes = np.array([3, 2, 2])
    starts = N.block_starts(rng, 12, sizes, 4000)
    assert (starts[:, 1:] >= starts[:, :-1] + sizes[:-1]).all() and (starts[:, -1] + sizes[-1] <= 12).all()
    # every choice of 3 of 12 - 7 + 3 = 8 places is as likely: 56 outcomes
    _, count = np.unique(starts, axis=0, return_counts=True)
    assert len(count) == 56 and count.min() > 40 and count.max() < 110
    wide = N.block_starts(rng, 2000, np.array([5, 5]), 500)
    assert (wide[:, 1] - wide[:, 0] >= 5).all() and N.block_starts(rng, 6, np.array([4, 4]), 10) is None
    assert N.block_starts(rng, 100, np.array([1, 0]), 10) is None


def test_groups_dealt_to_buckets_add_up():
    counts, sizes = [5, 9, 1, 7, 8], [10, 4, 16]
    dealt = [N.dealt_groups(counts, b, sizes, 300, 1) for b in range(5)]
    assert all((d.sum(1) == c).all() and (d >= 0).all() for d, c in zip(dealt, counts))
    assert (sum(dealt) == sizes).all()
    assert dealt[1][:, 0].mean() == pytest.approx(9 * 10 / 30, abs=0.3)


def test_noise_takes_no_part_in_the_permutation(spark):
    rows = [(k, k % 2, [1.0, 0.1 * k]) for k in range(20)]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    more = df.unionByName(spark.createDataFrame([(k, -1, [-9.0, 9.0]) for k in range(100, 160)], df.schema))
    c = V.centroids(df)
    one, two = ([(r.replicate, r.h, round(r.best, 12)) for r in N.permutation_null(x, c, 20, buckets=3).orderBy("replicate", "h").collect()] for x in (df, more))
    assert one == two and len(one) == 40


def test_degeneracy_needs_ten_clusters_and_some_noise():
    from tessera.config import factorial_degenerate, resample_degenerate, sweep_degenerate

    assert [resample_degenerate(9, 0.3), resample_degenerate(10, 0.04), resample_degenerate(10, 0.05)] == [True, True, False]
    assert [sweep_degenerate(9, 0.3), sweep_degenerate(10, 0.04), sweep_degenerate(10, 0.05)] == [True, True, False]
    assert [factorial_degenerate(9, 0.3), factorial_degenerate(10, 0.04), factorial_degenerate(10, 0.05)] == [True, True, False]


def test_term_sets_without_a_shared_term_have_similarity_0(spark):
    a = spark.createDataFrame([(0, "x", 0.5), (0, "y", 0.5)], "label int, term string, weight double")
    b = spark.createDataFrame([(1, "x", 1.0), (2, "z", 1.0)], "label int, term string, weight double")
    got = {(r.h, r.f): r.similarity for r in L.weighted_jaccard(a, b).collect()}
    assert got == {(0, 1): pytest.approx(1 / 3), (0, 2): 0.0}


def test_blocks_do_not_grow_with_the_rows(spark, monkeypatch):
    sizes = []
    for n in (3000, 30_000, 3_000_000):
        k = V.bucket_count(n)
        sizes.append(n / k)
    assert max(sizes) <= V.BUCKET_ROWS and V.bucket_count(0) == 1
    monkeypatch.setattr(V, "BUCKET_ROWS", 10)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, i % 2, rng.normal(size=3).tolist()) for i in range(60)], "id long, label int, vec array<double>")
    assert [tuple(r) for r in V.neighbours(df, 2).orderBy("src", "rank").collect()] == [tuple(r) for r in V.neighbours(df, 2, buckets=1).orderBy("src", "rank").collect()]


def test_replication_chain_on_planted_topics(spark):
    rng = np.random.default_rng(7)
    centres = np.eye(12)[:, :6] * 6 + np.eye(12)[:, 6:] * 3
    rows = []
    for k in range(960):
        c = k % 12
        noise = k % 16 == 15
        said = [f"topic{c}w{rng.integers(4)}" for _ in range(3)] if not noise else [f"any{rng.integers(40)}" for _ in range(3)]
        at = rng.normal(centres[c], 0.15) if not noise else rng.uniform(-4, 10, 6)
        rows.append((k, f"s{rng.integers(20)}", -1 if noise else c, at.tolist(), " ".join(said + ["the", "race"])))
    df = spark.createDataFrame(rows, "id long, session string, label int, proj array<double>, text string")
    labels = M.factorial_labels(df, df.select("id", "label"), 2, [8, 10])
    assert labels.groupBy("seed", "mcs").count().filter("count = 960").count() == 4
    rates = L.replication_by_run(df.select("id", "text"), labels, ["seed", "mcs"], ("the",))
    runs = M.replication_runs(labels, rates, ["seed", "mcs"], 12).collect()
    assert len(runs) == 4 and all(r.aligned >= 11 and r.n_pass >= 11 and r.noise > 0 and r.n_not_reconstructed <= 1 for r in runs)
    # one family a run gives what the run alone gives
    one = labels.filter("seed = 1 and mcs = 8")
    alone = L.replication_by_run(df.select("id", "text"), one, ["seed"], ("the",))
    key = lambda f: sorted((r.label, r.n_terms, r.strict, r.direction, r.passes) for r in f.collect())
    assert key(rates.filter("seed = 1 and mcs = 8")) == key(alone)
    margins = M.replication_margins(rates, M.replication_runs(labels, rates, ["seed", "mcs"], 12).withColumn("degenerate", F.lit(False)), ["seed", "mcs"]).collect()
    assert len(margins) >= 11 and all(r.min_margin <= r.median_margin <= r.max_margin <= 0.5 for r in margins)
