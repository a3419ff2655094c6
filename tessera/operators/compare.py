"""Comparing partitions through their contingency relation, never through pairs of members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.math import ratio


def contingency(a: DataFrame, b: DataFrame, by: list[str], id_col: str = "id") -> DataFrame:
    """``(by..., la, lb, n)`` of ``a(id, la)`` and ``b(by..., id, lb)``: an equi-join and one grouped count."""
    return a.join(b, id_col).groupBy(*by, "la", "lb").agg(F.count(F.lit(1)).alias("n"))


def best_jaccard(a: DataFrame, b: DataFrame, by: list[str], id_col: str = "id") -> DataFrame:
    """For each category of ``a`` (noise aside) the most similar group of ``b``: ``(by..., la, matched, jaccard)``.

    Equal similarity goes to the smaller group label; a category that meets no group has
    similarity 0 and no match.  Noise of ``b`` is no group.
    """
    na = a.filter("la <> -1").groupBy("la").agg(F.count(F.lit(1)).alias("na"))
    nb = b.filter("lb <> -1").groupBy(*by, "lb").agg(F.count(F.lit(1)).alias("nb"))
    c = contingency(a.filter("la <> -1"), b.filter("lb <> -1"), by, id_col)
    j = c.join(nb, [*by, "lb"]).join(na, "la").withColumn("j", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    best = j.groupBy(*by, "la").agg(F.max(F.struct("j", (-F.col("lb")).alias("minus"))).alias("x")).select(*by, "la", (-F.col("x.minus")).alias("matched"), F.col("x.j").alias("jaccard"))
    full = nb.select(*by).distinct().crossJoin(F.broadcast(na.select("la"))) if by else na.select("la")
    return full.join(best, [*by, "la"], "left").withColumn("jaccard", F.coalesce("jaccard", F.lit(0.0)))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2.0


def agreement(a: DataFrame, b: DataFrame, by: list[str], id_col: str = "id") -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two partitions, noise as a class of its own.

    Columns: ``by..., n, ari, nmi``; the mutual information is normalised by the mean of the
    entropies.  Two partitions of one class each agree fully.
    """
    c = contingency(a, b, by, id_col)
    row, col = c.groupBy(*by, "la").agg(F.sum("n").alias("n")), c.groupBy(*by, "lb").agg(F.sum("n").alias("n"))

    def sums(t: DataFrame, name: str) -> DataFrame:
        x = F.col("n").cast("double")
        return t.groupBy(*by).agg(F.sum(_pairs(x)).alias(f"p_{name}"), F.sum(x * F.log(x)).alias(f"e_{name}"), F.sum("n").alias(f"n_{name}"))

    s = sums(c, "c")
    for t, name in ((row, "a"), (col, "b")):
        s = s.join(sums(t, name), by) if by else s.crossJoin(sums(t, name))
    n = F.col("n_c").cast("double")
    expected = ratio(F.col("p_a") * F.col("p_b"), _pairs(n))
    most = (F.col("p_a") + F.col("p_b")) / 2
    ari = F.when(F.coalesce(most - expected, F.lit(0.0)) == 0, 1.0).otherwise((F.col("p_c") - expected) / (most - expected))
    ha, hb, hab = (F.log(n) - F.col(f"e_{x}") / n for x in "abc")
    mean = (ha + hb) / 2
    nmi = F.when(F.abs(mean) < 1e-15, 1.0).otherwise((ha + hb - hab) / mean)
    return s.select(*by, F.col("n_c").alias("n"), ari.alias("ari"), nmi.alias("nmi"))


def validate_partition(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: rows, categories, noise, and whether category ids run 0, 1, 2 ... without a hole."""
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.when(F.col(label) != -1, F.col(label))).alias("n_categories"), F.count_if(F.col(label) == -1).alias("n_noise"), F.min(F.when(F.col(label) != -1, F.col(label))).alias("lo"), F.max(label).alias("hi"))
    return one.select("n_rows", "n_categories", "n_noise", F.coalesce((F.col("lo") == 0) & (F.col("hi") == F.col("n_categories") - 1), F.lit(False)).alias("contiguous"))


def plateau(sweep: DataFrame, chosen: int, tolerance: int = 1) -> DataFrame:
    """Widest run of adjacent settings ``(mcs, n_clusters)`` within ``tolerance`` of the chosen count; the first of equals.

    Settings are a handful, ordered in one window.
    """
    w = Window.orderBy("mcs")
    flag = F.abs(F.col("n_clusters") - chosen) <= tolerance
    islands = sweep.withColumn("rn", F.row_number().over(w)).withColumn("ok", flag).withColumn("g", F.col("rn") - F.sum(F.col("ok").cast("int")).over(w)).filter("ok")
    runs = islands.groupBy("g").agg(F.min("mcs").alias("first"), F.max("mcs").alias("last"), F.count(F.lit(1)).alias("width"))
    return runs.orderBy(F.desc("width"), "first").limit(1).select("first", "last", "width")


def granularity_core(sweep: DataFrame, share: float = 0.10, least_width: int = 3) -> DataFrame:
    """Widest window of surviving settings whose counts all lie within ``share`` of the window's median.

    ``sweep(mcs, n_clusters, degenerate, dbcv)``; adjacency is over settings that are not
    degenerate.  Without a window of ``least_width`` the setting of highest density validity
    is taken.  Gives ``first, last, width, rule``.
    """
    alive = sweep.filter(~F.col("degenerate")).withColumn("rn", F.row_number().over(Window.orderBy("mcs")))
    a, b = alive.select(F.col("rn").alias("s"), F.col("mcs").alias("first")), alive.select(F.col("rn").alias("e"), F.col("mcs").alias("last"))
    spans = a.join(b, F.col("e") >= F.col("s"))
    inner = spans.join(alive.select("rn", "n_clusters"), (F.col("rn") >= F.col("s")) & (F.col("rn") <= F.col("e"))).groupBy("s", "e", "first", "last").agg(F.percentile("n_clusters", 0.5).alias("med"), F.min("n_clusters").alias("lo"), F.max("n_clusters").alias("hi"))
    good = inner.filter((F.greatest(F.col("hi") - F.col("med"), F.col("med") - F.col("lo")) <= share * F.col("med")) & (F.col("e") - F.col("s") + 1 >= least_width))
    core = good.select("first", "last", (F.col("e") - F.col("s") + 1).alias("width"), F.lit("core").alias("rule"), F.lit(0).alias("o"), F.col("s").alias("tie"), F.lit(0.0).alias("v"))
    fall = alive.select(F.col("mcs").alias("first"), F.col("mcs").alias("last"), F.lit(1).alias("width"), F.lit("dbcv").alias("rule"), F.lit(1).alias("o"), F.col("rn").alias("tie"), (-F.col("dbcv")).alias("v"))
    return core.unionByName(fall).orderBy("o", F.desc("width"), "v", "tie").limit(1).select("first", "last", F.col("width").cast("int").alias("width"), "rule")
