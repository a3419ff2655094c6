import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import exact as E
from tessera.functions import math as M
from tessera.functions.text import strip_ws, terms, token_count
from tessera.operators.ordering import benjamini_hochberg, benjamini_hochberg_within, positional_ids


def exact_tail(k, n_total, n_term, n_cluster):
    total = sum(math.comb(n_term, i) * math.comb(n_total - n_term, n_cluster - i) for i in range(max(k, 0), min(n_term, n_cluster) + 1) if n_cluster - i <= n_total - n_term)
    return total / math.comb(n_total, n_cluster)


def test_ln_factorial(spark):
    rows = spark.range(0, 3000, 7).select("id", M.ln_factorial(F.col("id")).alias("v")).collect()
    assert max(abs(r.v - math.lgamma(r.id + 1)) for r in rows) < 1e-8


def test_hypergeom_tail_is_exact(spark):
    cases = [(0, 50, 10, 5), (3, 50, 10, 5), (5, 50, 10, 5), (6, 50, 10, 5), (1, 7, 7, 3), (30, 1000, 200, 100), (4, 1000, 200, 100), (2, 3, 2, 3), (90, 2000, 100, 900)]
    df = spark.createDataFrame(cases, "k long, n long, t long, c long").withColumn("p", M.hypergeom_tail(F.col("k"), F.col("n"), F.col("t"), F.col("c")))
    batch = df.withColumn("b", E.hypergeom_tail(F.col("k"), F.col("n"), F.col("t"), F.col("c")))
    for r in batch.collect():
        want = exact_tail(r.k, r.n, r.t, r.c)
        assert r.p == pytest.approx(min(1.0, want), rel=1e-8, abs=1e-12)
        assert r.b == pytest.approx(min(1.0, want), rel=1e-8, abs=1e-12)


def test_sign_test_goldens(spark):
    rows = [(10, 0, 10), (9, 1, 10), (2, 8, 10), (7, 3, 10), (5, 5, 10), (0, 0, 0)]
    df = spark.createDataFrame(rows, "a long, b long, n long").select(M.sign_test_p(F.col("a"), F.col("b"), F.col("n")).alias("p"))
    got = [r.p for r in df.collect()]
    assert got[:5] == pytest.approx([0.001953125, 0.021484375, 0.109375, 0.34375, 1.0], rel=1e-9)
    assert got[5] is None


def test_terms_and_strip(spark):
    rows = [("It's ÉTÉ_1 a Bb",), ("",), (None,), ("  x y\n",)]
    df = spark.createDataFrame(rows, "t string").select(terms(F.col("t")).alias("w"), strip_ws(F.col("t")).alias("s"), token_count(F.col("t")).alias("n"))
    got = df.collect()
    assert [r.w for r in got] == [["it", "été_1", "bb"], [], [], []]
    assert got[3].s == "x y" and got[3].n == 2


def step_up(ps, q):
    order = sorted(ps)
    n = len(ps)
    cut = max([p for i, p in enumerate(order, 1) if p <= q * i / n], default=-1)
    qv = {}
    floor = 1.0
    for i in range(n, 0, -1):
        p = order[i - 1]
        floor = min(floor, p * n / i)
        qv[p] = min(floor, qv.get(p, 1.0))
    return cut, qv


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.001, 0.01, 0.01, 0.02, 0.04, 0.2, 0.5, 1.0]), min_size=1, max_size=40))
def test_step_up_over_partitions(spark, ps):
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(ps)], "i long, p double")
    cut, qv = step_up(ps, 0.05)
    for r in benjamini_hochberg(df, "p", 0.05, partitions=3).collect():
        assert r.rejected == (r.p <= cut)
        assert r.q_value == pytest.approx(qv[r.p])
    same = benjamini_hochberg_within(df.withColumn("g", F.lit(1)), ["g"], "p", 0.05).collect()
    assert all(r.rejected == (r.p <= cut) and r.q_value == pytest.approx(qv[r.p]) for r in same)


def test_step_up_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, 0.001)], "i long, p double")
    got = {r.i: r for r in benjamini_hochberg(df, "p", 0.05).collect()}
    assert got[2].rejected and got[1].q_value is None
    assert benjamini_hochberg(df.filter("i > 5"), "p", 0.05).count() == 0


def test_positional_ids(spark):
    df = spark.createDataFrame([(k * 3 % 101,) for k in range(101)], "k long")
    rows = positional_ids(df, ["k"], "at", partitions=5).orderBy("k").collect()
    assert [r["at"] for r in rows] == list(range(101))
    assert positional_ids(df.filter("k < 0"), ["k"], "at").count() == 0
