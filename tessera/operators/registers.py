"""Correspondence between two registers: availability, similarity, relation classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.math import dot, r6


def availability(df: DataFrame, categories: DataFrame, events: DataFrame) -> DataFrame:
    """``(category, matched_sentences, matched_events, availability)`` over the matched events.

    WELL: 15 sentences and 5 events; SPARSE: 5 and 2; else ABSENT.
    """
    inside = df.join(events, "event", "left_semi")
    c = inside.groupBy(F.col("label").alias("category")).agg(F.count(F.lit(1)).alias("s"), F.countDistinct("event").alias("e"))
    out = categories.join(c, "category", "left").select("category", F.coalesce("s", F.lit(0)).alias("matched_sentences"), F.coalesce("e", F.lit(0)).alias("matched_events"))
    cls = F.when((F.col("matched_sentences") >= 15) & (F.col("matched_events") >= 5), "WELL").when((F.col("matched_sentences") >= 5) & (F.col("matched_events") >= 2), "SPARSE").otherwise("ABSENT")
    return out.withColumn("availability", cls)


def similarity_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(h, f, cosine)`` of two centroid sets; a rectangle of categories, of which each side has some dozens."""
    return a.select(F.col("label").alias("h"), F.col("vec").alias("va")).join(b.select(F.col("label").alias("f"), F.col("vec").alias("vb"))).select("h", "f", dot(F.col("va"), F.col("vb")).alias("cosine"))


def relations(edges: DataFrame, thresholds: DataFrame, pooled: float) -> DataFrame:
    """Relation of each primary category to the second register's clusters.

    ``edges(h, f, cosine)``, ``thresholds(h, own)``.  Above-threshold counts and SPLIT use
    the own threshold, strictly; MERGE needs the stricter of own and pooled threshold on
    both categories that share a cluster; SPLIT goes before MERGE.
    """
    j = edges.join(F.broadcast(thresholds), "h")
    above = j.filter(F.col("cosine") > F.col("own"))
    strict = j.filter(F.col("cosine") > F.greatest("own", F.lit(pooled)))
    shared = strict.groupBy("f").agg(F.count(F.lit(1)).alias("k")).filter("k >= 2")
    merges = strict.join(shared, "f", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n_merge"))
    counts = above.groupBy("h").agg(F.count(F.lit(1)).alias("n_above"))
    best = j.groupBy("h").agg(F.max(F.struct("cosine", (-F.col("f")).alias("minus"))).alias("b"))
    out = thresholds.select("h").join(best, "h", "left").join(counts, "h", "left").join(merges, "h", "left")
    n = F.coalesce("n_above", F.lit(0))
    rel = F.when(n == 0, "NON_RECOVERY").when(n >= 2, "SPLIT").when(F.coalesce("n_merge", F.lit(0)) > 0, "MERGE").otherwise("SINGLE_MATCH")
    return out.select("h", (-F.col("b.minus")).alias("best_match"), r6("b.cosine").alias("best_cosine"), n.alias("n_above"), rel.alias("relation"))


def correspondence_summary(rel: DataFrame, well: DataFrame) -> DataFrame:
    """Counts of the four relations, overall and among well available categories; absent ones are 0."""
    order = F.explode(F.array(*[F.struct(F.lit(k).alias("position"), F.lit(n).alias("relation")) for k, n in enumerate(("SINGLE_MATCH", "SPLIT", "MERGE", "NON_RECOVERY"))])).alias("o")
    names = rel.sparkSession.range(1).select(order).select("o.*")
    c = rel.join(well.withColumn("is_well", F.lit(True)), "h", "left").groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_well").alias("n_well"))
    return names.join(c, "relation", "left").select("position", "relation", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_well", F.lit(0)).alias("n_well"))


def unmatched_second(edges: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Clusters of the second register above no primary category's threshold."""
    hit = edges.join(F.broadcast(thresholds), "h").filter(F.col("cosine") > F.col("own"))
    return edges.select("f").distinct().join(hit, "f", "left_anti")


def universality(residual: DataFrame) -> DataFrame:
    """``(cluster, size, n_sessions, universal, universal_clustered)`` of residual clusters.

    ``universal`` compares with the sessions of all residual rows, noise included;
    ``universal_clustered`` with those of clustered rows only.
    """
    totals = residual.agg(F.countDistinct("session").alias("all_sessions"), F.countDistinct(F.when(F.col("label") != -1, F.col("session"))).alias("clustered_sessions"))
    per = residual.filter("label <> -1").groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("size"), F.countDistinct("session").alias("n_sessions"))
    return per.crossJoin(F.broadcast(totals)).select("cluster", "size", "n_sessions", (F.col("n_sessions") == F.col("all_sessions")).alias("universal"), (F.col("n_sessions") == F.col("clustered_sessions")).alias("universal_clustered"))


def spread_histogram(per: DataFrame) -> DataFrame:
    """Number of residual clusters by the number of sessions they spread over."""
    return per.groupBy("n_sessions").agg(F.count(F.lit(1)).alias("n_clusters"))
