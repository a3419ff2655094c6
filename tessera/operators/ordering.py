"""Ranks, running totals and positional ids without a single-partition window.

A window without PARTITION BY gathers the whole table in one task.  Here rows are range
partitioned by the order key, each partition is scanned on its own, and the partitions'
totals (one row a partition) are added as offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import Workspace


def _ranged(df: DataFrame, order: list, partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ws = Workspace(df.sparkSession, "ordered")
    return ws.write(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def positional_ids(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... in the order of ``order`` (which must be unique to be deterministic)."""
    held = _ranged(df, [F.col(c) for c in order], partitions)
    sizes = {r["__part"]: r["n"] for r in held.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    if not offsets:
        return held.drop("__part").withColumn(name, F.lit(None).cast("long"))
    shift = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part int, __shift long"))
    w = Window.partitionBy("__part").orderBy(*order)
    return held.join(shift, "__part").withColumn(name, F.row_number().over(w) - 1 + F.col("__shift")).drop("__part", "__shift")


def benjamini_hochberg(df: DataFrame, p: str, q: float, partitions: int | None = None) -> DataFrame:
    """Adds ``q_value`` and ``rejected`` for one family over all rows.

    Only the distinct p-values are ordered; equal ones share rank, decision and q-value.
    A null p-value belongs to no family and gets nulls.  A p-value of 1, as most pairs
    have, is never rejected at ``q`` below 1 and has the q-value 1, so those rows are not
    looked up: they take part in the join under keys of their own that meet nothing.
    """
    counts = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    held = _ranged(counts, [F.col("__p")], partitions)
    parts = held.groupBy("__part").agg(F.sum("__n").alias("n")).orderBy("__part").collect()
    n_all = sum(r["n"] for r in parts)
    offsets, total = [], 0
    for r in parts:
        offsets.append((r["__part"], total))
        total += r["n"]
    spark = df.sparkSession
    shift = F.broadcast(spark.createDataFrame(offsets, "__part int, __shift long"))
    up = Window.partitionBy("__part").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("__part").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = held.join(shift, "__part").withColumn("__rank", F.sum("__n").over(up) + F.col("__shift"))
    ranked = ranked.withColumn("__raw", F.col("__p") * F.lit(float(n_all)) / F.col("__rank")).withColumn("__min", F.min("__raw").over(down))
    ranked = Workspace(spark, "ordered").write(ranked, "ranked")
    edges = ranked.groupBy("__part").agg(F.min("__raw").alias("m"), F.max(F.when(F.col("__p") <= F.lit(q) * F.col("__rank") / F.lit(float(n_all)), F.col("__p"))).alias("cut")).orderBy(F.desc("__part")).collect()
    later, floor, cut = [], None, None
    for r in edges:
        later.append((r["__part"], floor))
        floor = r["m"] if floor is None else min(floor, r["m"])
        cut = r["cut"] if cut is None else cut if r["cut"] is None else max(cut, r["cut"])
    floors = F.broadcast(spark.createDataFrame(later, "__part int, __floor double"))
    table = ranked.join(floors, "__part").select("__p", F.least(F.lit(1.0), F.least("__min", F.coalesce("__floor", "__min"))).alias("q_value"), (F.col("__p") <= F.lit(-1.0 if cut is None else cut)).alias("rejected"))
    key = F.when(F.col(p) < 1, F.col(p)).otherwise(-1.0 - F.pmod(F.monotonically_increasing_id(), F.lit(1009)))
    joined = df.withColumn("__key", key).join(table, F.col("__key") == F.col("__p"), "left").drop("__p", "__key")
    sure = F.col(p) >= 1
    return joined.withColumn("q_value", F.when(sure, 1.0).otherwise(F.col("q_value"))).withColumn("rejected", F.when(sure, F.lit(q >= 1)).otherwise(F.col("rejected")))


def benjamini_hochberg_within(df: DataFrame, group: list[str], p: str, q: float) -> DataFrame:
    """As above with one family for each group; a group is one window partition."""
    by = Window.partitionBy(*group)
    n = F.count(p).over(by)
    rank = F.count(p).over(by.orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
    raw = F.col(p) * n / rank
    held = df.withColumn("__raw", raw).withColumn("__cut", F.when(F.col(p) <= F.lit(q) * rank / n, F.col(p)))
    held = held.withColumn("q_value", F.least(F.lit(1.0), F.min("__raw").over(by.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0))))
    return held.withColumn("rejected", F.coalesce(F.col(p) <= F.max("__cut").over(by), F.lit(False))).drop("__raw", "__cut")
