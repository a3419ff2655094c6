"""Diagnostic dimensions of categories: recovery, separability, sensitivity, replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.math import r6, ratio


def recovery(scores: DataFrame, key: list[str], threshold: float = 0.30) -> DataFrame:
    """``(key..., n_judges, n_recovered, recovery, complete)`` of ``(key..., judge, jaccard)``.

    A judge without a value did not run: it leaves the denominator and ``complete`` false.
    """
    hit = (F.col("jaccard") >= threshold).cast("int")
    return scores.groupBy(*key).agg(F.count("jaccard").alias("n_judges"), F.coalesce(F.sum(hit), F.lit(0)).cast("long").alias("n_recovered"), (F.count("jaccard") == F.count(F.lit(1))).alias("complete")).withColumn("recovery", ratio(F.col("n_recovered"), F.col("n_judges")))


def leave_one_judge_out(scores: DataFrame, key: list[str], threshold: float = 0.30, majority: float = 0.5) -> DataFrame:
    """Categories a majority of the remaining judges recovers, with each judge removed in turn.

    A category's sums are taken once; removing a judge subtracts that judge's own part, so
    no judge is joined with the others.
    """
    s = scores.filter(F.col("jaccard").isNotNull()).withColumn("hit", (F.col("jaccard") >= threshold).cast("int"))
    total = s.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"))
    kept = s.join(total, key).withColumn("rest", ratio(F.col("h") - F.col("hit"), F.col("n") - 1))
    others = scores.select("judge").distinct().crossJoin(F.broadcast(total.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("h") >= majority * F.col("n")).alias("base"))))
    # a judge that did not score a category leaves that category as it was
    changed = kept.groupBy("judge").agg(F.count_if(F.coalesce(F.col("rest") >= majority, F.lit(False))).alias("own"), F.count_if(F.col("h") >= majority * F.col("n")).alias("own_base"))
    return others.join(changed, "judge", "left").select("judge", (F.col("base") - F.coalesce("own_base", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("n_majority"), F.col("base").alias("n_baseline"))


def profile(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Full outer assembly of dimension tables on their key."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key, "full")
    return out


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, r)`` for every pair of columns: all coefficients in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def legacy_verdict(df: DataFrame, dims: list[str], threshold: float = 0.5) -> DataFrame:
    """Opt-in: number of passed dimensions and the band it used to be given."""
    n = sum((F.coalesce((F.col(c) >= threshold).cast("int"), F.lit(0)) for c in dims), F.lit(0))
    band = F.when(F.col("n_pass") == len(dims), "STRONG").when(F.col("n_pass") >= len(dims) - 1, "MODERATE").when(F.col("n_pass") >= 1, "WEAK").otherwise("UNSUPPORTED")
    return df.withColumn("n_pass", n).withColumn("verdict", band)


def heldout_centroids(df: DataFrame, train: Column, least_train: int = 3, id_col: str = "id") -> DataFrame:
    """Where held-out rows go when every row joins the nearest centroid of the training rows, by category.

    ``strict``: the share routed back to their own category; ``direction``: the share of the
    most frequent destination, whichever it is; ``score`` is the smaller.  A category with
    fewer than ``least_train`` training rows has no centroid; it and one without held-out rows
    score 0.
    """
    from tessera.operators.vectors import centroids, nearest_centroid

    known = df.filter(F.col("label") != -1)
    enough = known.filter(train).groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_train).select("label")
    cents = centroids(known.filter(train).join(enough, "label", "left_semi"))
    near = nearest_centroid(known.filter(~train), cents, id_col)
    routed = near.groupBy("label", "nearest").agg(F.count(F.lit(1)).alias("n"))
    by = routed.groupBy("label").agg(F.sum("n").alias("n_test"), F.sum(F.when(F.col("nearest") == F.col("label"), F.col("n")).otherwise(0)).alias("own"), F.max(F.when(F.col("nearest").isNotNull(), F.col("n"))).alias("most"))
    every = known.select("label").distinct().join(by, "label", "left").join(enough.withColumn("kept", F.lit(True)), "label", "left")
    share = lambda c: F.when(F.col("kept"), F.coalesce(ratio(F.col(c), F.col("n_test")), F.lit(0.0))).otherwise(0.0)
    return every.select("label", F.coalesce("n_test", F.lit(0)).alias("n_test"), share("own").alias("strict"), share("most").alias("direction")).withColumn("score", F.least("strict", "direction"))


def sweep_counts(parts: DataFrame) -> DataFrame:
    """Clusters, noise share and largest cluster of each setting of ``(mcs, id, label)``, in one grouped query."""
    sizes = parts.groupBy("mcs", "label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("mcs").agg(F.count_if(F.col("label") != -1).alias("n_clusters"), F.coalesce(ratio(F.sum(F.when(F.col("label") == -1, F.col("n"))), F.sum("n")), F.lit(0.0)).alias("noise"), F.max(F.when(F.col("label") != -1, F.col("n"))).alias("largest"))


def replicate_summary(rows: DataFrame, flag_at: float = 0.5) -> DataFrame:
    """Category summary over viable replicates of ``(replicate, category, jaccard, status)``.

    The pass flag is taken on the rounded mean, the standard deviation is the sample one.
    """
    ok = rows.filter("status = 'ok'")
    s = ok.groupBy("category").agg(F.count(F.lit(1)).alias("n_viable"), F.bround(F.avg("jaccard"), 4).alias("mean"), r6(F.stddev_samp("jaccard")).alias("sd"), r6(F.percentile("jaccard", 0.5)).alias("median"), r6(F.min("jaccard")).alias("lowest"), r6(F.max("jaccard")).alias("highest"))
    return s.withColumn("passes", F.col("mean") >= flag_at)


def replicate_status(rows: DataFrame) -> DataFrame:
    """One row: replicates by status."""
    per = rows.groupBy("replicate").agg(F.min("status").alias("status"))
    return per.agg(F.count(F.lit(1)).alias("n_replicates"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("degenerate", "failed", "ok")])


def convergence(rows: DataFrame, checkpoints: list[int], flag_at: float = 0.5) -> DataFrame:
    """Statistics over the first n replicates for each checkpoint, from one pass over the rows."""
    points = F.explode(F.array(*[F.lit(c) for c in checkpoints])).alias("checkpoint")
    inside = rows.filter("status = 'ok'").select("replicate", "category", "jaccard", points).filter(F.col("replicate") < F.col("checkpoint"))
    per = inside.groupBy("checkpoint", "category").agg(F.avg("jaccard").alias("m"))
    return per.groupBy("checkpoint").agg(F.count(F.lit(1)).alias("n_categories"), r6(F.percentile("m", 0.5)).alias("median"), F.count_if(F.bround("m", 6) >= flag_at).alias("n_stable"))


def factorial_cells(runs: DataFrame) -> DataFrame:
    """Cells of the factorial over viable runs ``(cache, mcs, seed, n_pass, degenerate)``."""
    return runs.groupBy("cache", "mcs").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(~F.col("degenerate")).alias("n_viable"),
        *[r6(F.percentile(F.when(~F.col("degenerate"), F.col("n_pass")), p)).alias(n) for p, n in ((0.5, "median"), (0.25, "q1"), (0.75, "q3"))],
        r6(F.stddev_samp(F.when(~F.col("degenerate"), F.col("n_pass")))).alias("sd"),
    )


def paired_delta(runs: DataFrame, on: list[str], column: str, base: str, other: str) -> DataFrame:
    """Differences of ``n_pass`` between two levels of ``column`` for runs equal in ``on``, both viable.

    One grouped pass instead of a self join: a pair is a group that has both levels.
    """
    alive = runs.filter(~F.col("degenerate"))
    g = alive.groupBy(*on).agg(F.max(F.when(F.col(column) == base, F.col("n_pass"))).alias("a"), F.max(F.when(F.col(column) == other, F.col("n_pass"))).alias("b")).filter("a is not null and b is not null").withColumn("delta", F.col("b") - F.col("a"))
    keep = [c for c in on if c != "seed"]
    return g.groupBy(*keep).agg(F.count(F.lit(1)).alias("n_pairs"), r6(F.percentile("delta", 0.5)).alias("median_delta"), r6(F.avg("delta")).alias("mean_delta"), F.count_if(F.col("delta") < 0).alias("n_lower"), F.count_if(F.col("delta") > 0).alias("n_higher"))


def reference_location(runs: DataFrame, cache: str, mcs: int, seed: int) -> DataFrame:
    """Percentile position of one run among the viable runs of its cell (strictly smaller); null if it is degenerate."""
    cell = runs.filter((F.col("cache") == cache) & (F.col("mcs") == mcs))
    ref = cell.filter(F.col("seed") == seed).select(F.col("n_pass").alias("ref"), F.col("degenerate").alias("ref_degenerate"))
    j = cell.filter(~F.col("degenerate")).crossJoin(F.broadcast(ref))  # one row
    return j.groupBy("ref", "ref_degenerate").agg(F.avg((F.col("n_pass") < F.col("ref")).cast("int")).alias("below")).select("ref", F.when(~F.col("ref_degenerate"), r6(100 * F.col("below"))).alias("percentile"))


def stratified_sample(df: DataFrame, label: str, id_col: str, n: int, replicates: int) -> DataFrame:
    """``(replicate, label, id)``: n rows of each category for each replicate, by a portable hash order.

    Categories smaller than n are taken whole; noise is not sampled.  Replicates partition
    the window together with the label, so no partition holds more than one category.
    """
    rows = df.filter(F.col(label) != -1).select(F.col(label).alias("label"), F.col(id_col).alias("id"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    order = F.sha2(F.concat_ws("-", F.col("replicate").cast("string"), F.col("id").cast("string")), 256)
    w = Window.partitionBy("replicate", "label").orderBy("h", "id")
    return rows.withColumn("h", order).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select("replicate", "label", "id")
