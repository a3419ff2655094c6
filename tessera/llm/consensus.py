"""Consensus from annotators who disagree: a community confusion model.

Annotators fall into a few communities (careful, hasty, guessing, fixed on one letter,
off by one position ...), each with a confusion matrix shared by its members.  An
annotator's own matrix is a Dirichlet posterior around the matrices of the communities
they belong to, so a few labels move it little and many labels move it far.  Variational
updates alternate between the posterior over each item's letter and the communities.

Every round is two relational passes: answers joined with item posteriors are summed by
annotator, answers joined with annotator matrices are summed by item.  Only the
communities' matrices (a fixed number of numbers) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.lineage import Workspace

LETTERS = "abcde"
K = len(LETTERS)


#: Begins the names given to answers whose annotator is not known.
ANONYMOUS = "\x00"


def letter_of(answer: Column) -> Column:
    """The one letter a to e that stands alone in a free-form answer; null if there is none or several."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(answer), F.lit(r"(?<![\p{L}\p{N}])([a-e])(?![\p{L}\p{N}])"), F.lit(1)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def latest_answers(responses: DataFrame) -> DataFrame:
    """``(study_id, cluster_id, rater, letter int)`` with the letter's position, null if left open.

    Of an annotator's answers to an item the latest counts, equal times are settled by the
    text; every different answer of a null annotator is one of somebody else, named by a hash
    after ``ANONYMOUS``; rows without study or item are none.
    """
    nobody = F.concat(F.lit(ANONYMOUS), F.xxhash64("study_id", "cluster_id", "t1", "submitted_at").cast("string"))
    last = responses.filter("study_id is not null and cluster_id is not null").groupBy("study_id", "cluster_id", F.coalesce("rater", nobody).alias("rater")).agg(F.max(F.struct("submitted_at", "t1")).alias("a"))
    return last.select("study_id", "cluster_id", "rater", (F.instr(F.lit(LETTERS), letter_of(F.col("a.t1"))) - 1).alias("letter"))


def _digamma(x: np.ndarray) -> np.ndarray:
    x, out = x.astype(float).copy(), np.zeros(x.shape)
    for _ in range(6):
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def prototypes() -> np.ndarray:
    """Where the communities start: three degrees of care, a fixed letter each, off by one."""
    eye, flat = np.eye(K), np.full((K, K), 1 / K)
    mix = lambda m, a: a * m + (1 - a) * (1 - m) / (K - 1)
    fixed = [mix(np.tile(eye[k], (K, 1)), 0.7) for k in range(K)]
    return np.stack([mix(eye, 0.85), mix(eye, 0.55), flat, *fixed, mix(np.roll(eye, 1, 1), 0.8), mix(np.roll(eye, -1, 1), 0.8)])


@dataclass
class Consensus:
    items: DataFrame  #: study_id, cluster_id, p0..p4
    raters: DataFrame  #: rater, n (25 expected counts), weights (communities), log_confusion (25)
    answers: DataFrame  #: study_id, cluster_id, rater, letter
    rounds: int


_RATER = T.StructType(
    [T.StructField("rater", T.StringType())] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("n", "weights", "log_confusion")]
)


def _rater_step(matrices: np.ndarray, log_weights: np.ndarray, log_matrices: np.ndarray, strength: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf[[f"n{k}" for k in range(K * K)]].to_numpy(float)
            r = _softmax(log_weights + n @ log_matrices.reshape(len(log_matrices), -1).T)
            alpha = (n + strength * (r @ matrices.reshape(len(matrices), -1))).reshape(-1, K, K)
            logs = _digamma(alpha) - _digamma(alpha.sum(2))[:, :, None]
            yield pd.DataFrame({"rater": pdf["rater"], "n": list(n), "weights": list(r), "log_confusion": list(logs.reshape(-1, K * K))})

    return run


def _community_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial sums by community of membership (k = -1) and of the 25 expected counts."""
    total: np.ndarray | int = 0
    for pdf in batches:
        if len(pdf):
            w, n = np.stack(pdf["weights"].to_numpy()), np.stack(pdf["n"].to_numpy())
            total = total + np.concatenate([w.sum(0)[:, None], w.T @ n], axis=1)
    if not isinstance(total, int):
        m, k = np.indices(total.shape)
        yield pd.DataFrame({"m": m.ravel(), "k": k.ravel() - 1, "v": total.ravel()})


def _posterior(log_kappa: np.ndarray):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(scores: pd.Series) -> pd.Series:
        return pd.Series(list(_softmax(np.stack(scores.to_numpy()) + log_kappa))) if len(scores) else scores

    return run


def community_consensus(responses: DataFrame, strength: float = 30.0, proto_weight: float = 20.0, max_rounds: int = 20, tolerance: float = 1e-4) -> Consensus:
    """Fit the model to all answers; stops when under ``tolerance`` of the posteriors' mass moves.

    ``strength`` is the number of answers a community's matrix counts for in a member's own
    matrix, ``proto_weight`` the answers a starting matrix counts for in its community.
    """
    spark = responses.sparkSession
    ws = Workspace(spark, "consensus")
    answers = ws.write(latest_answers(responses), "answers")
    known = answers.filter("letter >= 0")
    start = prototypes()
    matrices, log_matrices = start, np.log(start)
    log_weights = np.full(len(start), -np.log(len(start)))
    log_kappa = np.full(K, -np.log(K))
    votes = [F.sum(F.when(F.col("letter") == c, 1.0).otherwise(0.0)) for c in range(K)]
    items = ws.write(known.groupBy("study_id", "cluster_id").agg(*[v.alias(f"v{c}") for c, v in enumerate(votes)]).select("study_id", "cluster_id", *[((F.col(f"v{c}") + 0.3) / sum((F.col(f"v{x}") + 0.3 for x in range(K)), F.lit(0.0))).alias(f"p{c}") for c in range(K)]), "items")
    raters, rounds = None, 0
    for rounds in range(1, max_rounds + 1):
        counted = known.join(items, ["study_id", "cluster_id"]).groupBy("rater").agg(*[F.sum(F.when(F.col("letter") == j, F.col(f"p{c}")).otherwise(0.0)).alias(f"n{c * K + j}") for c in range(K) for j in range(K)])
        new_raters = ws.write(counted.mapInPandas(_rater_step(matrices, log_weights, log_matrices, strength), _RATER), "raters")
        sums = {(r["m"], r["k"]): r["v"] for r in new_raters.select("n", "weights").mapInPandas(_community_sums, "m int, k int, v double").groupBy("m", "k").agg(F.sum("v").alias("v")).collect()}
        if not sums:
            raters = new_raters
            break
        alpha = np.array([[sums[m, k] for k in range(K * K)] for m in range(len(start))]).reshape(-1, K, K)
        alpha = alpha + proto_weight * start
        matrices = alpha / alpha.sum(2, keepdims=True)
        log_matrices = _digamma(alpha) - _digamma(alpha.sum(2))[:, :, None]
        log_weights = np.log((np.array([sums[m, -1] for m in range(len(start))]) + 1) / (sum(sums[m, -1] for m in range(len(start))) + len(start)))
        scored = known.join(new_raters.select("rater", "log_confusion"), "rater").groupBy("study_id", "cluster_id").agg(*[F.sum(F.element_at("log_confusion", F.col("letter") + 1 + c * K)).alias(f"s{c}") for c in range(K)])
        q = scored.select("study_id", "cluster_id", _posterior(log_kappa)(F.array(*[f"s{c}" for c in range(K)])).alias("q")).select("study_id", "cluster_id", *[F.col("q")[c].alias(f"p{c}") for c in range(K)])
        new_items = ws.write(q, "items")
        moved = new_items.alias("a").join(items.alias("b"), ["study_id", "cluster_id"]).agg(
            F.avg(sum((F.abs(F.col(f"a.p{c}") - F.col(f"b.p{c}")) for c in range(K)), F.lit(0.0))).alias("moved"), *[F.avg(f"a.p{c}").alias(f"k{c}") for c in range(K)], F.count(F.lit(1)).alias("n")
        ).first()
        log_kappa = np.log([(moved[f"k{c}"] * moved["n"] + 5) / (moved["n"] + 5 * K) for c in range(K)])
        ws.drop(items)
        if raters is not None:
            ws.drop(raters)
        items, raters = new_items, new_raters
        if moved["moved"] < tolerance:
            break
    return Consensus(items, raters, answers, rounds)


def consensus_letters(responses: DataFrame, **model) -> DataFrame:
    """``study_id, cluster_id, letter, probability, n_answers, agreement, pair_agreement``.

    One row for each item anyone was asked.  ``agreement`` is the share of answers equal to
    the consensus, ``pair_agreement`` the share of answer pairs that agree (null below two).
    An item whose answers are all open takes the letter of the key sheet, the first of
    several in alphabetical order, or null without one; its probability is null.
    Equal posteriors go to the letter that comes first.
    """
    fit = community_consensus(responses, **model)
    tops = [F.struct(F.col(f"p{c}").alias("p"), F.lit(-c).alias("o")) for c in range(K)]
    best = fit.items.select("study_id", "cluster_id", F.greatest(*tops).alias("b")).select("study_id", "cluster_id", F.col("b.p").alias("probability"), (-F.col("b.o")).alias("best"))
    votes = fit.answers.groupBy("study_id", "cluster_id").agg(*[F.count_if(F.col("letter") == c).alias(f"v{c}") for c in range(K)])
    n = sum((F.col(f"v{c}") for c in range(K)), F.lit(0))
    pairs = sum((F.col(f"v{c}") * (F.col(f"v{c}") - 1) for c in range(K)), F.lit(0))
    sheet = responses.groupBy("study_id", "cluster_id").agg(F.min(letter_of(F.col("intruder_letter"))).alias("sheet"))
    joined = votes.join(best, ["study_id", "cluster_id"], "left").join(sheet, ["study_id", "cluster_id"], "left")
    hits = sum((F.when(F.col("best") == c, F.col(f"v{c}")).otherwise(0) for c in range(K)), F.lit(0))
    return joined.select(
        "study_id",
        "cluster_id",
        F.coalesce(F.substring(F.lit(LETTERS), F.col("best") + 1, F.lit(1)), F.col("sheet")).alias("letter"),
        "probability",
        n.cast("long").alias("n_answers"),
        F.try_divide(hits, n).alias("agreement"),
        F.try_divide(pairs, n * (n - 1)).alias("pair_agreement"),
    )


def rater_reliability(responses: DataFrame, **model) -> DataFrame:
    """``rater, n_answers, reliability, community``: expected share of right answers by annotator.

    The diagonal of the annotator's posterior matrix, averaged over letters; annotators with
    few answers stay near their community's value.  Annotators without a legible answer and
    answers without an annotator have no row.  ``community`` is the index of the likeliest starting matrix.
    """
    fit = community_consensus(responses, **model)
    diagonal = sum((F.exp(F.col("log_confusion")[c * K + c]) for c in range(K)), F.lit(0.0)) / K
    named = fit.raters.filter(~F.startswith("rater", F.lit(ANONYMOUS)))
    return named.select("rater", F.aggregate("n", F.lit(0.0), lambda a, x: a + x).alias("n"), diagonal.alias("reliability"), (F.array_position("weights", F.array_max("weights")) - 1).cast("int").alias("community")).select("rater", F.round("n").cast("long").alias("n_answers"), "reliability", "community")
