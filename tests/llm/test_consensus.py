import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.consensus import _digamma, consensus_letters, letter_of, rater_reliability

SCHEMA = "study_id string, cluster_id int, rater string, t1 string, intruder_letter string, submitted_at timestamp"
T0 = dt.datetime(2025, 1, 1)


def test_letters(spark):
    rows = [(x,) for x in ("b", " B", "(c)", "d)", "option e", "?", "", None, "a or b", "abc", "A.")]
    got = [r.l for r in spark.createDataFrame(rows, "t string").select(letter_of(F.col("t")).alias("l")).collect()]
    assert got == ["b", "b", "c", "d", "e", None, None, None, None, None, "a"]


def test_digamma():
    assert _digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890], abs=1e-8)


def answers(seed=0, items=60, good=4, shifted=3, stuck=3):
    """A minority of careful raters against raters that are off by one and raters stuck on e."""
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 5, items)
    rows = []
    for i, t in enumerate(truth):
        for r in range(good):
            rows.append(("s", i, f"g{r}", "abcde"[t if rng.random() < 0.9 else rng.integers(5)], None, T0))
        for r in range(shifted):
            rows.append(("s", i, f"x{r}", "abcde"[(t + 1) % 5], None, T0))
        for r in range(stuck):
            rows.append(("s", i, f"e{r}", "e", None, T0))
    return rows, truth


def test_beats_the_majority_and_rates_raters(spark):
    rows, truth = answers()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.cluster_id: r for r in consensus_letters(df).collect()}
    hits = np.mean([got[i].letter == "abcde"[t] for i, t in enumerate(truth)])
    majority = np.mean([max("abcde", key=[x[3] for x in rows if x[1] == i].count) == "abcde"[t] for i, t in enumerate(truth)])
    assert hits > 0.95 and hits > majority
    rel = {r.rater: r.reliability for r in rater_reliability(df).collect()}
    assert min(rel[f"g{k}"] for k in range(4)) > 0.8 > 0.3 > max(rel[f"x{k}"] for k in range(3))


def test_latest_answer_repeats_open_items_and_nulls(spark):
    later = T0 + dt.timedelta(days=1)
    rows = [("s", 1, "r1", "a", None, T0), ("s", 1, "r1", "b", None, later), ("s", 1, "r1", "b", None, later), ("s", 1, "r2", "b", None, T0), ("s", 2, "r1", "?", "d", T0), ("s", 3, "r1", None, None, None), (None, 4, "r1", "a", None, T0), ("s", None, "r1", "a", None, T0), ("s", 1, None, "b", None, T0)]
    got = {r.cluster_id: r for r in consensus_letters(spark.createDataFrame(rows, SCHEMA).withColumn("letter", F.lit("clash"))).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].letter, got[1].n_answers, got[1].agreement) == ("b", 3, 1.0)
    assert (got[2].letter, got[2].probability, got[2].n_answers) == ("d", None, 0) and got[3].letter is None
    assert consensus_letters(spark.createDataFrame([], SCHEMA)).count() == 0


def test_answers_without_an_annotator_all_count(spark):
    rows, _ = answers()
    rows += [("s", 0, None, x, None, T0 + dt.timedelta(hours=k)) for k, x in enumerate("abab")] + [("s", 0, None, "b", None, T0 + dt.timedelta(hours=3))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.cluster_id: r.n_answers for r in consensus_letters(df).collect()}[0] == 14
    assert {r.rater for r in rater_reliability(df).collect()} == {x[2] for x in rows if x[2]}
