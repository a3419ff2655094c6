"""Null models and resampling whose draws are distributed exactly, not approximated.

Permutations and resamples over all rows are dealt to buckets of rows, whose number grows
with the rows: how many of each group fall into each bucket is a hypergeometric or
multinomial draw, and every bucket permutes its own rows.  The joint law is that of one draw
over all rows, and no task ever sees more than its bucket.  A bucket finds its part of a
hypergeometric table by halving: at each node of a tree over the buckets the groups are
split between the two halves by a draw whose seed is the node's, so all tasks agree and no
table of all buckets exists anywhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.math import r6


#: Rows a bucket holds about.
BUCKET_ROWS = 100_000


def _buckets(df: DataFrame, key: str, buckets: int | None) -> tuple[DataFrame, dict[int, int]]:
    buckets = buckets or max(8, -(-df.count() // BUCKET_ROWS))
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    return dealt, {r["bucket"]: r["n"] for r in dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}


def dealt_groups(counts: list[int], bucket: int, sizes: list[int], replicates: int, seed: int) -> np.ndarray:
    """Rows of each group in one bucket, a row a replicate, of a random deal of groups to buckets of ``counts`` rows."""
    left = np.tile(np.array(sizes, np.int64), (replicates, 1))
    lo, hi = 0, len(counts)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        first = np.stack([rng.multivariate_hypergeometric(row, sum(counts[lo:mid]), method="marginals") for row in left])
        left, lo, hi = (first, lo, mid) if bucket < mid else (left - first, mid, hi)
    return left


def permutation_null(second: DataFrame, primary: DataFrame, replicates: int = 1000, seed: int = 4242, buckets: int | None = None) -> DataFrame:
    """``(replicate, h, best)``: best cosine of each primary centroid under shuffled membership of the second register.

    Only the assigned rows of ``second(id, label, vec)`` are permuted, with their group sizes
    kept; noise takes no part.  ``primary(label, vec)`` are unit centroids, few by nature.
    """
    second = second.filter(F.col("label") != -1)
    dealt, counts = _buckets(second, "id", buckets)
    sizes = {r["label"]: r["n"] for r in second.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups, order = sorted(sizes), sorted(counts)
    held, share = [counts[b] for b in order], [sizes[g] for g in groups]
    fixed = [(r["label"], np.array(r["vec"], float)) for r in primary.select("label", "vec").collect()]

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["vec"].to_numpy()).astype(float)
        local = np.random.default_rng([seed, b])
        plan = dealt_groups(held, order.index(b), share, replicates, seed)
        rows = []
        for r in range(replicates):
            p = x[local.permutation(len(x))]
            edges = np.concatenate([[0], np.cumsum(plan[r])])
            total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(p, axis=0)])
            part = total[edges[1:]] - total[edges[:-1]]
            rows += [(r, g, part[i]) for i, g in enumerate(groups)]
        return pd.DataFrame(rows, columns=["replicate", "g", "total"])

    parts = dealt.select("id", "vec", "bucket").groupBy("bucket").applyInPandas(sums, "replicate int, g int, total array<double>")
    by_place = parts.select("replicate", "g", F.posexplode("total").alias("at", "x")).groupBy("replicate", "g", "at").agg(F.sum("x").alias("x"))
    added = by_place.groupBy("replicate", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("total"))

    def best(batches):
        for pdf in batches:
            if len(pdf):
                c = np.stack(pdf["total"].to_numpy())
                c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
                for h, v in fixed:
                    yield pd.DataFrame({"replicate": pdf["replicate"], "h": h, "cosine": c @ v})

    return added.select("replicate", "total").mapInPandas(best, "replicate int, h int, cosine double").groupBy("replicate", "h").agg(F.max("cosine").alias("best"))


def null_thresholds(null: DataFrame) -> DataFrame:
    """95th percentile and median of the null by category."""
    return null.groupBy("h").agg(F.percentile("best", 0.95).alias("null_p95"), F.percentile("best", 0.5).alias("null_median"), F.count(F.lit(1)).alias("replicates"))


def empirical_p(null: DataFrame, observed: DataFrame, plus_one: bool = True) -> DataFrame:
    """``(h, p)``: share of the null at or above the observed value, with or without the +1 correction."""
    j = null.join(F.broadcast(observed), "h").groupBy("h").agg(F.count_if(F.col("best") >= F.col("observed")).alias("r"), F.count(F.lit(1)).alias("b"))
    return j.select("h", ((F.col("r") + 1) / (F.col("b") + 1) if plus_one else F.col("r") / F.col("b")).alias("p"))


def shuffle_null(df: DataFrame, replicates: int = 200, seed: int = 42, most_numbers: int = 4_000_000) -> DataFrame:
    """``(replicate, n_universal)``: clusters found in every session when sessions are shuffled over clustered rows.

    Only the margins matter: each replicate draws a random table with the clusters' and the
    sessions' sizes.  The sizes travel with the task and are checked; with more sessions than
    that no cluster smaller than their number can be universal, and only larger ones are drawn.
    """
    clustered = df.filter("label <> -1")
    sizes = [r["n"] for r in clustered.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()]
    n_sessions = clustered.select("session").distinct().count()
    possible = [s for s in sizes if s >= n_sessions]
    spark = df.sparkSession
    reps = spark.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    if not possible:
        return reps.withColumn("n_universal", F.lit(0))
    if n_sessions > most_numbers:
        raise ValueError(f"{n_sessions} sessions exceed {most_numbers}; group sessions before this null")
    margin = np.array([r["n"] for r in clustered.groupBy("session").agg(F.count(F.lit(1)).alias("n")).orderBy("session").collect()])

    def draw(batches):
        for pdf in batches:
            out = []
            for r in pdf["replicate"]:
                rng, left, hits = np.random.default_rng([seed, int(r)]), margin.copy(), 0
                for s in sizes:
                    got = rng.multivariate_hypergeometric(left, s)
                    left -= got
                    hits += int((got > 0).all())
                out.append(hits)
            yield pd.DataFrame({"replicate": pdf["replicate"], "n_universal": out})

    return reps.repartition(8).mapInPandas(draw, "replicate int, n_universal int")


def null_verdict(null: DataFrame, observed: int, value: str = "n_universal") -> DataFrame:
    """One row: plain (uncorrected) tail shares and the direction at .05."""
    one = null.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.avg((F.col(value) <= observed).cast("int")).alias("p_low"), F.avg((F.col(value) >= observed).cast("int")).alias("p_high"))
    return one.select(F.lit(observed).alias("observed"), r6("mean").alias("mean"), r6("sd").alias("sd"), r6("p_low").alias("p_low"), r6("p_high").alias("p_high"), F.when(F.col("p_low") <= 0.05, "fewer").when(F.col("p_high") <= 0.05, "more").otherwise("within").alias("verdict"))


def session_bootstrap(sessions: DataFrame, replicates: int = 10_000, seed: int = 42, buckets: int | None = None) -> DataFrame:
    """One row: pooled coverage and its percentile interval over resamples of sessions ``(session, hits, n)``.

    Draws are dealt to buckets by a multinomial, then to the sessions of a bucket; only sums
    by replicate leave a task.
    """
    dealt, counts = _buckets(sessions, "session", buckets)
    order = sorted(counts)
    total = sum(counts.values())
    rng = np.random.default_rng(seed)
    plan = rng.multinomial(total, [counts[b] / total for b in order], size=replicates) if total else np.zeros((replicates, 0), int)
    draws = {b: plan[:, i] for i, b in enumerate(order)}

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        pdf = pdf.sort_values("session")
        local = np.random.default_rng([seed, b])
        k, both = len(pdf), pdf[["hits", "n"]].to_numpy(float)
        out = np.empty((replicates, 2))
        for i in range(0, replicates, 500):
            part = draws[b][i : i + 500]
            out[i : i + 500] = np.stack([local.multinomial(m, np.full(k, 1 / k)) for m in part]) @ both
        return pd.DataFrame({"replicate": np.arange(replicates), "hits": out[:, 0], "n": out[:, 1]})

    reps = dealt.groupBy("bucket").applyInPandas(sums, "replicate int, hits double, n double").groupBy("replicate").agg((F.sum("hits") / F.sum("n")).alias("v"))
    point = sessions.agg(F.sum("hits").alias("h"), F.sum("n").alias("t"))
    ci = reps.agg(F.percentile("v", [0.025, 0.975]).alias("q"), F.count(F.lit(1)).alias("replicates"))
    return point.crossJoin(ci).select(r6(100 * F.col("h") / F.col("t"), 2).alias("coverage_pct"), r6(100 * F.col("q")[0], 2).alias("low"), r6(100 * F.col("q")[1], 2).alias("high"), "replicates")


def cumulative_ci(scores: DataFrame, levels: int, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """``(level, n, low, high)``: categories that at least ``level`` judges recover, with bootstrap intervals over categories.

    ``scores(n_recovered)`` is one row a category.  Resampling categories makes each count
    binomial in their number and share, so replicates need two numbers, not the categories.
    """
    at = F.explode(F.array(*[F.lit(k) for k in range(1, levels + 1)])).alias("level")
    counted = scores.select("n_recovered", at).groupBy("level").agg(F.count_if(F.col("n_recovered") >= F.col("level")).alias("n"), F.count(F.lit(1)).alias("total"))

    def draw(batches):
        for pdf in batches:
            rows = []
            for level, n, total in zip(pdf["level"], pdf["n"], pdf["total"]):
                v = np.random.default_rng([seed, int(level)]).binomial(int(total), n / total, size=replicates)
                rows.append((int(level), int(n), *np.percentile(v, [2.5, 97.5])))
            yield pd.DataFrame(rows, columns=["level", "n", "low", "high"])

    return counted.mapInPandas(draw, "level int, n long, low double, high double")


def matched_length_null(counts: DataFrame, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """Null of the primary share by event when as many sentences as the shorter register has are drawn from the longer one.

    ``counts(event, domain_n array<bigint>, n_draw bigint, observed double)``, the first part
    the primary one: only counts matter, so a draw is a hypergeometric vector.
    """

    def draw(batches):
        for pdf in batches:
            rows = []
            for event, parts, m, obs in zip(pdf["event"], pdf["domain_n"], pdf["n_draw"], pdf["observed"]):
                parts = np.array(parts, int)
                rng = np.random.default_rng([seed, abs(hash_text(event)) % (1 << 31)])
                m = min(int(m), int(parts.sum()))
                v = rng.hypergeometric(parts[0], parts[1:].sum(), m, size=replicates) / max(m, 1)
                lo, mid, hi = np.percentile(v, [2.5, 50, 97.5])
                rows.append((event, obs, v.mean(), v.std(ddof=1), lo, mid, hi, (1 + (v <= obs).sum()) / (replicates + 1), (1 + (v >= obs).sum()) / (replicates + 1), bool(obs < lo), bool(obs < lo or obs > hi)))
            yield pd.DataFrame(rows, columns=["event", "observed", "mean", "sd", "p2_5", "p50", "p97_5", "p_lower", "p_upper", "below_p2_5", "outside_central_95"])

    return counts.mapInPandas(draw, "event string, observed double, mean double, sd double, p2_5 double, p50 double, p97_5 double, p_lower double, p_upper double, below_p2_5 boolean, outside_central_95 boolean")


def hash_text(text: str) -> int:
    import zlib

    return zlib.crc32(str(text).encode())


def block_starts(rng: np.random.Generator, n: int, sizes: np.ndarray, replicates: int) -> np.ndarray | None:
    """Starts of non-overlapping blocks of ``sizes`` in ``n`` rows, a row a replicate; None where they do not fit.

    As many distinct places as blocks are drawn from ``n - sum(sizes) + len(sizes)``, sorted, and
    each is moved on by the lengths before it less one.
    """
    k, span = len(sizes), n - int(sizes.sum()) + len(sizes)
    if span < k or sizes.min() < 1:
        return None
    if span <= 8 * k * k:
        places = np.concatenate([np.argsort(rng.random((min(200, replicates - at), span)), axis=1)[:, :k] for at in range(0, replicates, 200)])
    else:
        places = rng.integers(0, span, (replicates, k))
        while True:  # draws with a place taken twice are made anew
            again = np.nonzero((np.diff(np.sort(places, axis=1), axis=1) == 0).any(axis=1))[0]
            if not len(again):
                break
            places[again] = rng.integers(0, span, (len(again), k))
    return np.sort(places, axis=1) + np.concatenate([[0], np.cumsum(sizes - 1)[:-1]])


def contiguous_null(df: DataFrame, blocks: tuple[int, ...] = (1, 5, 10, 20), share: float = 0.3, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """``(session, k, status, mean, sd, p2_5, p97_5)``: share of hits in k contiguous blocks that cover ``share`` of a session.

    ``df(session, position, hit)``.  A session is one broadcast, hours long at most, so its
    hits fit a task as a bit vector; settings with blocks shorter than one sentence are
    reported as infeasible.
    """

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        session = pdf["session"].iloc[0]
        hits = pdf.sort_values("position")["hit"].to_numpy(int)
        n, prefix = len(hits), np.concatenate([[0], np.cumsum(hits)])
        total, rows = int(n * share), []
        for k in blocks:
            sizes = np.full(k, total // k) + (np.arange(k) < total % k)
            starts = block_starts(np.random.default_rng([seed, hash_text(session) % (1 << 31), k]), n, sizes, replicates)
            if starts is None:
                rows.append((session, k, "infeasible", None, None, None, None))
                continue
            v = (prefix[starts + sizes] - prefix[starts]).sum(1) / total
            rows.append((session, k, "ok", v.mean(), v.std(ddof=1), *np.percentile(v, [2.5, 97.5])))
        return pd.DataFrame(rows, columns=["session", "k", "status", "mean", "sd", "p2_5", "p97_5"])

    return df.select("session", "position", F.col("hit").cast("int").alias("hit")).groupBy("session").applyInPandas(draw, "session string, k int, status string, mean double, sd double, p2_5 double, p97_5 double")


def label_chance(a: np.ndarray, b: np.ndarray, trials: int, measure, seed: int = 42) -> tuple[float, float, float]:
    """Observed measure of two labelings of a few items, the mean under shuffling, and the plain tail share."""
    rng = np.random.default_rng(seed)
    obs = measure(a, b)
    v = np.array([measure(a, b[rng.permutation(len(b))]) for _ in range(trials)])
    return float(obs), float(v.mean()), float((v >= obs).mean())
