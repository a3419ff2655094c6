"""Roles in a weighted network with known modules, and stability along a sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.math import ratio
from tessera.operators.compare import agreement, best_jaccard


def roles(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """``(id, module, degree, strength, participation, within_z)`` of ``edges(src, dst, weight)`` and ``modules(id, module)``.

    Participation is 1 less the sum of squared shares of the strength by module; the
    within-module score standardises the own-module strength over the module (population
    deviation, 0 where it does not vary).
    """
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    to = both.join(modules.select(F.col("id").alias("dst"), F.col("module").alias("to")), "dst")
    by = to.groupBy("src", "to").agg(F.sum("weight").alias("k"), F.count(F.lit(1)).alias("m"))
    own = by.join(modules.select(F.col("id").alias("src"), "module"), "src")
    node = own.groupBy("src", "module").agg(F.sum("m").alias("degree"), F.sum("k").alias("strength"), F.sum(F.col("k") * F.col("k")).alias("sq"), F.coalesce(F.sum(F.when(F.col("to") == F.col("module"), F.col("k"))), F.lit(0.0)).alias("inside"))
    stats = node.groupBy("module").agg(F.avg("inside").alias("mu"), F.stddev_pop("inside").alias("sd"))
    z = F.when(F.coalesce("sd", F.lit(0.0)) == 0, 0.0).otherwise((F.col("inside") - F.col("mu")) / F.col("sd"))
    return node.join(F.broadcast(stats), "module").select(F.col("src").alias("id"), "module", "degree", "strength", (1 - ratio(F.col("sq"), F.col("strength") * F.col("strength"))).alias("participation"), z.alias("within_z"))


def adjacent_settings(parts: DataFrame) -> DataFrame:
    """Each setting's partition beside the next one's: ``(mcs, id, la, lb)`` of ``(mcs, id, label)``."""
    order = parts.select("mcs").distinct().withColumn("next", F.lead("mcs").over(Window.orderBy("mcs"))).filter("next is not null")  # a handful of settings
    a = parts.join(F.broadcast(order), "mcs").select("mcs", F.col("next"), "id", F.col("label").alias("la"))
    return a.join(parts.select(F.col("mcs").alias("next"), "id", F.col("label").alias("lb")), ["next", "id"]).select("mcs", "id", "la", "lb")


def neighbour_stability(parts: DataFrame) -> DataFrame:
    """``(mcs, ari, splits, merges)`` between each setting and the next.

    A split is a group of which two or more successors hold a fifth each; merges likewise seen from the next setting.
    """
    j = adjacent_settings(parts)
    wide = j.select(F.concat_ws(":", "mcs", "id").alias("key"), "mcs", "la", "lb")
    ari = agreement(wide.select(F.col("key").alias("id"), "la"), wide.select("mcs", F.col("key").alias("id"), "lb"), ["mcs"]).select("mcs", "ari")
    c = j.filter("la <> -1 and lb <> -1").groupBy("mcs", "la", "lb").agg(F.count(F.lit(1)).alias("n"))

    def forks(side: str, other: str, name: str) -> DataFrame:
        total = c.groupBy("mcs", side).agg(F.sum("n").alias("t"))
        strong = c.join(total, ["mcs", side]).filter(F.col("n") >= 0.2 * F.col("t")).groupBy("mcs", side).agg(F.count(F.lit(1)).alias("k"))
        return strong.groupBy("mcs").agg(F.count_if(F.col("k") >= 2).alias(name))

    return ari.join(forks("la", "lb", "splits"), "mcs", "left").join(forks("lb", "la", "merges"), "mcs", "left").select("mcs", "ari", F.coalesce("splits", F.lit(0)).alias("splits"), F.coalesce("merges", F.lit(0)).alias("merges"))


def noise_adjusted_survival(reference: DataFrame, judges: DataFrame, threshold: float = 0.30) -> DataFrame:
    """``(judge, n_categories, survived, noise, adjusted)``: surviving categories beside the judge's noise share."""
    best = best_jaccard(reference, judges, ["judge"])
    noise = judges.groupBy("judge").agg(F.avg((F.col("lb") == -1).cast("int")).alias("noise"))
    s = best.groupBy("judge").agg(F.count(F.lit(1)).alias("n_categories"), F.count_if(F.col("jaccard") >= threshold).alias("survived"))
    return s.join(noise, "judge").withColumn("adjusted", ratio(F.col("survived"), F.col("n_categories")) / F.greatest(1 - F.col("noise"), F.lit(1e-12)))


def map_covers(recovered: DataFrame, mapping: DataFrame, key: str = "label") -> DataFrame:
    """One row: does a configured map cover every recovered category, and how many it misses."""
    return recovered.select(key).distinct().join(mapping.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_missing")).select((F.col("n_missing") == 0).alias("applies"), "n_missing")
