"""Report tables, rater agreement, publication safety."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.math import r6, ratio

#: Words whose presence marks running prose (fixed values; a parameter).
FUNCTION_WORDS = ("the", "a", "an", "of", "to", "in", "is", "was", "and", "that", "it", "for", "on", "with", "as", "at", "by")


def prose_like(text: Column, words: tuple[str, ...] = FUNCTION_WORDS) -> Column:
    """45 characters, 8 words, not a list of short comma parts, and a function word; null is not prose."""
    tokens = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    commas = F.size(F.split(text, ","))
    listed = (commas >= 4) & (F.size(tokens) / commas <= 3)
    has = F.exists(tokens, lambda w: F.lower(w).isin(*words))
    return F.coalesce((F.length(text) >= 45) & (F.size(tokens) >= 8) & ~listed & has, F.lit(False))


def strip_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Named text columns replaced by the first 16 hex digits of their sha1 (null: empty), for publication."""
    return df.select(*[F.when(F.col(c).isNull(), "").otherwise(F.substring(F.sha1(F.col(c)), 1, 16)).alias(f"{c}_sha1") if c in columns else F.col(c) for c in df.columns])


def prose_leaks(df: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """``(column, n)`` of string columns that hold ``least`` or more prose-like values, over all rows."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")
    return df.select(rows).select("x.*").groupBy("column").agg(F.count_if(prose_like(F.col("v"))).alias("n")).filter(F.col("n") >= least)


def inventory(df: DataFrame, names: Column) -> DataFrame:
    """Categories with size, share of clustered rows, and their name."""
    sizes = df.filter("label <> -1").groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("t"))
    return sizes.crossJoin(F.broadcast(total)).select("label", names.alias("name"), "size", F.bround(ratio(F.col("size"), F.col("t")), 6).alias("share"))


def size_concentration(sizes: DataFrame) -> DataFrame:
    """One row: share of the largest and the five largest, median size, Gini coefficient.

    Categories are some dozens, ordered in one window.
    """
    up = Window.orderBy("size", "label")
    down = Window.orderBy(F.desc("size"), "label")
    r = sizes.withColumn("i", F.row_number().over(up)).withColumn("k", F.row_number().over(down))
    n, total = F.count(F.lit(1)), F.sum("size")
    return r.agg(r6(ratio(F.sum(F.when(F.col("k") == 1, F.col("size"))), total)).alias("top1"), r6(ratio(F.sum(F.when(F.col("k") <= 5, F.col("size"))), total)).alias("top5"), F.percentile("size", 0.5).alias("median_size"), F.sum(F.col("i") * F.col("size")).alias("s"), n.alias("n"), total.alias("t")).select("top1", "top5", "median_size", r6((2 * F.col("s") - (F.col("n") + 1) * F.col("t")) / (F.col("n") * F.col("t"))).alias("gini"))


def cluster_cards(sizes: DataFrame, tops: DataFrame, exemplars: DataFrame) -> DataFrame:
    """One row a category: handle by size, keywords, exemplar ids."""
    handle = F.format_string("K%02d", F.row_number().over(Window.orderBy(F.desc("size"), "label")) - 1)
    words = tops.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x.term), ", ").alias("keywords"))
    ids = exemplars.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x.id.cast("string")), ";").alias("exemplars"))
    return sizes.withColumn("handle", handle).join(words, "label", "left").join(ids, "label", "left")


def rater_accuracy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Answers, share of matches and mean confidence by ``keys``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(F.col(f"match_{t}").cast("int"))).alias(f"accuracy_{t}") for t in ("t1", "t3", "t4")], r6(F.avg("t5")).alias("mean_t5"))


def cohen_kappa(df: DataFrame, item: list[str], rater: str, value: str) -> DataFrame:
    """``(rater_a, rater_b, n, kappa)`` for pairs of raters with items in common, pairs a < b."""
    a = df.select(*item, F.col(rater).alias("rater_a"), F.col(value).alias("va"))
    b = df.select(*item, F.col(rater).alias("rater_b"), F.col(value).alias("vb"))
    t = a.join(b, item).filter("rater_a < rater_b").groupBy("rater_a", "rater_b", "va", "vb").agg(F.count(F.lit(1)).alias("n"))
    pair = ["rater_a", "rater_b"]
    total = t.groupBy(*pair).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("va") == F.col("vb"), F.col("n")).otherwise(0)).alias("same"))
    ma = t.groupBy(*pair, F.col("va").alias("v")).agg(F.sum("n").alias("na"))
    mb = t.groupBy(*pair, F.col("vb").alias("v")).agg(F.sum("n").alias("nb"))
    chance = ma.join(mb, [*pair, "v"]).groupBy(*pair).agg(F.sum(F.col("na") * F.col("nb")).alias("c"))
    j = total.join(chance, pair, "left")
    pe = ratio(F.coalesce("c", F.lit(0)), F.col("n") * F.col("n"))
    po = ratio(F.col("same"), F.col("n"))
    return j.select(*pair, "n", F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def krippendorff_alpha(df: DataFrame, item: list[str], value: str, by: list[str]) -> DataFrame:
    """Nominal alpha by group from value counts of items; no pair of answers is formed."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*by, *item, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy(*by, *item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree")).filter("m >= 2")
    used = c.join(m.select(*by, *item, "m"), [*by, *item])
    nv = used.groupBy(*by, "v").agg(F.sum("n").alias("nv"))
    tot = nv.groupBy(*by).agg(F.sum("nv").alias("n"), F.sum(F.col("nv") * (F.col("nv") - 1)).alias("same"))
    obs = m.groupBy(*by).agg(F.sum(F.col("agree") / (F.col("m") - 1)).alias("a"))
    j = tot.join(obs, by)
    do = 1 - ratio(F.col("a"), F.col("n"))
    de = 1 - ratio(F.col("same"), F.col("n") * (F.col("n") - 1))
    return j.select(*by, "n", F.when(de == 0, 1.0).otherwise(1 - do / de).alias("alpha"))


def seriation(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Order of columns by the weighted mean position of their rows: ``(col, barycentre, position)``."""
    b = df.groupBy(col).agg((F.sum(F.col(row) * F.col(value)) / F.sum(value)).alias("barycentre"))
    return b.withColumn("position", F.row_number().over(Window.orderBy(F.bround("barycentre", 9), col)) - 1)
