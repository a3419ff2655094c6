"""Vectors keyed by id: centroids, assignment, coverage, neighbours, separation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.math import dot, euclid, l2_normalise, norm, ratio

#: Numbers a broadcast set of centroids may hold; larger sets are joined instead.
BROADCAST_NUMBERS = 4_000_000
#: Rows of a block of an all-pairs kernel: a table of products of two blocks takes 32 MB.
BUCKET_ROWS = 2000


def mean_vectors(df: DataFrame, key: str = "label", vec: str = "vec") -> DataFrame:
    """``(key, vec)``: component-wise mean in double; pre-aggregated by (key, position)."""
    parts = df.select(key, F.posexplode(vec).alias("p", "x")).groupBy(key, "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s.m).alias(vec))


def centroids(df: DataFrame, label: str = "label", vec: str = "vec") -> DataFrame:
    """Unit mean vector of each label; noise (-1) has none."""
    means = mean_vectors(df.filter(F.col(label) != -1), label, vec)
    return means.withColumn(vec, l2_normalise(F.col(vec)))


def nearest_centroid(df: DataFrame, cents: DataFrame, id_col: str = "id", label: str = "label", vec: str = "vec") -> DataFrame:
    """Adds ``nearest`` and ``cosine``; equal cosines go to the smaller label.

    Centroids travel as one broadcast array of at most ``BROADCAST_NUMBERS`` numbers, so
    assignment is a narrow projection; a larger set is taken in that many numbers at a time
    and the best so far is carried along the row.
    """
    size = cents.agg(F.count(F.lit(1)).alias("k"), F.max(F.size(vec)).alias("d")).first()
    slices = max(1, -(-(size["k"] or 0) * (size["d"] or 0) // BROADCAST_NUMBERS))
    out = df
    for part in range(slices):
        some = cents.filter(F.pmod(F.xxhash64(label), F.lit(slices)) == part) if slices > 1 else cents
        one = some.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("c_label"), F.col(vec).alias("c_vec")))).alias("__cs"))
        scored = F.array_max(F.transform("__cs", lambda x: F.struct(dot(F.col(vec), x.c_vec).alias("cosine"), (-x.c_label).alias("minus"))))
        out = out.crossJoin(F.broadcast(one)).withColumn(f"__b{part}", scored).drop("__cs")
    names = [f"__b{part}" for part in range(slices)]
    best = F.greatest(*names) if slices > 1 else F.col(names[0])
    return out.withColumn("__b", best).withColumn("nearest", -F.col("__b.minus")).withColumn("cosine", F.col("__b.cosine")).drop("__b", *names)


def assign_at(df: DataFrame, tau: float) -> DataFrame:
    """Adds ``assigned``: the nearest label if its cosine reaches tau, else -1."""
    return df.withColumn("assigned", F.when(F.col("cosine") >= tau, F.col("nearest")).otherwise(-1))


def coverage_by(df: DataFrame, group: str, tau: float) -> DataFrame:
    """Sentences, median cosine, covered count and percentage of each group (pre: nearest_centroid)."""
    hit = (F.col("cosine") >= tau).cast("long")
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.percentile("cosine", 0.5).alias("median_cosine"), F.sum(hit).alias("covered")).withColumn("coverage_pct", 100 * ratio(F.col("covered"), F.col("n")))


def tau_sweep(df: DataFrame, taus: list[float], group: list[str] | None = None) -> DataFrame:
    """Coverage at every threshold in one pass (thresholds in hundredths, so that they compare exactly)."""
    grid = F.explode(F.array(*[F.lit(round(t * 100)) for t in taus])).alias("tau_pct")
    keys = [*(group or []), "tau_pct"]
    return df.select(*(group or []), "cosine", grid).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("cosine") >= F.col("tau_pct") / 100.0).cast("long")).alias("covered")).withColumn("coverage_pct", 100 * ratio(F.col("covered"), F.col("n")))


def threshold_floor(df: DataFrame, member: F.Column, taus: list[float]) -> DataFrame:
    """Youden's J of each threshold: rate retained of members less rate admitted of others."""
    grid = F.explode(F.array(*[F.lit(round(t * 100)) for t in taus])).alias("tau_pct")
    above = F.col("cosine") >= F.col("tau_pct") / 100.0
    rates = df.select("cosine", member.alias("m"), grid).groupBy("tau_pct").agg(F.avg(F.when(F.col("m"), above.cast("double"))).alias("retain"), F.avg(F.when(~F.col("m"), above.cast("double"))).alias("admit"))
    return rates.withColumn("youden_j", F.col("retain") - F.col("admit"))


def own_cosine(df: DataFrame, cents: DataFrame, label: str = "label", vec: str = "vec") -> DataFrame:
    """Adds ``own_cosine`` to the centroid of the row's own label (noise drops out)."""
    c = cents.select(F.col(label), F.col(vec).alias("__c"))
    return df.join(c, label).withColumn("own_cosine", dot(F.col(vec), F.col("__c")) / (norm(F.col(vec)) + 1e-12)).drop("__c")


def top_by(df: DataFrame, group: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each group; ``order`` must end in a unique column."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def bucket_count(n: int) -> int:
    return max(1, -(-n // BUCKET_ROWS))


def _block_pairs(rows: DataFrame, kernel, schema: str, buckets: int | None) -> DataFrame:
    """Apply ``kernel(queries, targets)`` to every pair of buckets of ``(id, label, vec)``.

    Rows are dealt into buckets by hash; a pair of buckets is one task's matrix product.  A
    bucket has about ``BUCKET_ROWS`` rows, however many there are in all, so what a task holds
    (two buckets and their table of products) does not grow with the data.
    """
    buckets = buckets or bucket_count(rows.count())
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    queries = dealt.select("id", "label", "vec", F.col("b").alias("qb"), every.alias("tb"), F.lit(True).alias("is_query"))
    targets = dealt.select("id", "label", "vec", every.alias("qb"), F.col("b").alias("tb"), F.lit(False).alias("is_query"))

    def block(pdf):
        import numpy as np
        import pandas as pd

        q, t = pdf[pdf["is_query"]], pdf[~pdf["is_query"]]
        if not len(q) or not len(t):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return kernel(q, t, np.stack(q["vec"].to_numpy()).astype(float), np.stack(t["vec"].to_numpy()).astype(float))

    return queries.unionByName(targets).groupBy("qb", "tb").applyInPandas(block, schema)


def neighbours(df: DataFrame, k: int, id_col: str = "id", vec: str = "vec", buckets: int | None = None) -> DataFrame:
    """``(src, dst, cosine, rank)``: the k nearest others of every row, exactly; ties by id.

    The k best of each pair of buckets are kept before buckets are merged.
    """

    def kernel(q, t, x, y):
        import numpy as np
        import pandas as pd

        qi, ti = q["id"].to_numpy(), t["id"].to_numpy()
        sim = np.round(x @ y.T, 12)
        sim[qi[:, None] == ti[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(ti, sim.shape), -sim), axis=1)[:, :k]
        val = np.take_along_axis(sim, order, 1).ravel()
        ok = np.isfinite(val)
        return pd.DataFrame({"src": np.repeat(qi, order.shape[1])[ok], "dst": ti[order].ravel()[ok], "cosine": val[ok]})

    rows = df.select(F.col(id_col).alias("id"), F.lit(0).alias("label"), F.col(vec).alias("vec"))
    return top_by(_block_pairs(rows, kernel, "src bigint, dst bigint, cosine double", buckets), ["src"], [F.desc("cosine"), F.col("dst")], k)


def matrix_audit(df: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: rows, dimensions, NaN, infinite and null components, rows that are finite, extremes, mean norm."""
    inf = float("inf")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf)
    finite = ~F.exists(vec, bad)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.size(vec)).alias("min_dim"), F.max(F.size(vec)).alias("max_dim"),
        F.sum(F.size(F.filter(vec, lambda x: F.isnan(x)))).alias("n_nan"), F.sum(F.size(F.filter(vec, lambda x: F.abs(x) == inf))).alias("n_inf"),
        F.sum(finite.cast("long")).alias("finite_rows"), F.min(F.array_min(vec)).cast("double").alias("min_value"), F.max(F.array_max(vec)).cast("double").alias("max_value"), F.avg(norm(F.col(vec))).alias("mean_norm"),
    )


def silhouette(df: DataFrame, id_col: str = "id", label: str = "label", vec: str = "vec", buckets: int | None = None) -> DataFrame:
    """``(id, label, silhouette)`` with Euclidean distances over clustered rows, exact; singletons have 0.

    Pairs of buckets yield sums of distances by (row, label), never the pairs themselves.
    """

    def kernel(q, t, x, y):
        import numpy as np
        import pandas as pd

        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))
        same = q["id"].to_numpy()[:, None] == t["id"].to_numpy()[None, :]
        d[same] = 0
        labels, at = np.unique(t["label"].to_numpy(), return_inverse=True)
        hot = np.eye(len(labels))[at]
        total, n = d @ hot, (~same).astype(float) @ hot
        return pd.DataFrame({"id": np.repeat(q["id"].to_numpy(), len(labels)), "label": np.repeat(q["label"].to_numpy(), len(labels)), "label2": np.tile(labels, len(q)), "total": total.ravel(), "n": n.ravel()})

    rows = df.filter(F.col(label) != -1).select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vec).alias("vec"))
    parts = _block_pairs(rows, kernel, "id bigint, label int, label2 int, total double, n double", buckets)
    means = parts.groupBy("id", "label", "label2").agg(F.sum("total").alias("t"), F.sum("n").alias("n")).withColumn("d", F.try_divide("t", "n"))
    ab = means.groupBy("id", "label").agg(F.min(F.when(F.col("label") == F.col("label2"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("label2"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.select("id", "label", s.alias("silhouette"))


def separation_indices(df: DataFrame, label: str = "label", vec: str = "vec") -> DataFrame:
    """One row: Davies-Bouldin and Calinski-Harabasz indices of the clustered rows, from centroids only."""
    rows = df.filter(F.col(label) != -1)
    means = mean_vectors(rows, label, vec).select(F.col(label), F.col(vec).alias("mu"))
    spread = rows.join(F.broadcast(means), label).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(euclid(F.col(vec), F.col("mu"))).alias("s"), F.sum(F.pow(euclid(F.col(vec), F.col("mu")), F.lit(2))).alias("w"))
    whole = mean_vectors(rows.withColumn("__all", F.lit(0)), "__all", vec).select(F.col(vec).alias("grand"))
    stats = means.join(spread, label)
    a, b = stats.select(F.col(label).alias("i"), F.col("mu").alias("mi"), F.col("s").alias("si")), stats.select(F.col(label).alias("j"), F.col("mu").alias("mj"), F.col("s").alias("sj"))
    worst = a.crossJoin(b).filter("i <> j").groupBy("i").agg(F.max(F.try_divide(F.col("si") + F.col("sj"), euclid(F.col("mi"), F.col("mj")))).alias("r"))
    db = worst.agg(F.avg("r").alias("davies_bouldin"))
    ch = stats.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("n") * F.pow(euclid(F.col("mu"), F.col("grand")), F.lit(2))).alias("between"), F.sum("w").alias("within"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    return db.crossJoin(ch).select("davies_bouldin", ratio(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("calinski_harabasz"), "k", "n")
