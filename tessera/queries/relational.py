"""The dataframe forms the pipeline uses, at the volume of the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.math import r6
from tessera.queries.base import Family
from tessera.sources.tables import table

family = Family()
add = family.add


@add("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round_even(avg(l_discount)::DOUBLE, 6) AS mean_discount, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL ORDER BY l_returnflag, l_linestatus DESC")
def grouped_summary(spark, d):
    """PRJ-03, AGG-05, SRT-01: filter pushed to the scan, partial aggregation, mixed sort."""
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), r6(F.avg("l_discount").cast("double")).alias("mean_discount"), F.count(F.lit(1)).alias("n")).orderBy("l_returnflag", F.desc("l_linestatus"))


@add("SELECT n_name, count(*)::BIGINT AS n, round_even(sum(l_extendedprice * (1 - l_discount))::DOUBLE, 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_chain(spark, d):
    """JOIN-02: inner equi chain; the optimizer orders it and broadcasts what its sizes allow."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double"), 2).alias("revenue"))


@add("SELECT c_custkey, count(o_orderkey)::BIGINT AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join_counts(spark, d):
    """JOIN-01, JOIN-04, PRJ-08."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@add("SELECT count(*)::BIGINT AS n_with, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL))::BIGINT AS n_without FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_anti(spark, d):
    """JOIN-07, JOIN-08."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    a = c.join(o, "c_custkey", "left_semi").agg(F.count(F.lit(1)).alias("n_with"))
    return a.join(c.join(o, "c_custkey", "left_anti").agg(F.count(F.lit(1)).alias("n_without")))  # one row each


@add("SELECT user_id, " + ", ".join(f"sum(value) FILTER (event_type = '{t}') IS NOT NULL AS has_{t}" for t in ("click", "view")) + ", count(*)::BIGINT AS n FROM events GROUP BY user_id")
def pivot_flags(spark, d):
    """PVT-01."""
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(*[F.max(F.when((F.col("event_type") == t) & F.col("value").isNotNull(), True).otherwise(False)).alias(f"has_{t}") for t in ("click", "view")], F.count(F.lit(1)).alias("n"))


@add("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 3")
def top_per_group(spark, d):
    """WIN-03: Spark keeps a group limit below the shuffle."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank")).filter("rank <= 3")


@add("SELECT o_orderkey, round_even(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE, 2) AS running FROM orders")
def running_total(spark, d):
    """WIN-11."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_orderkey", r6(F.sum("o_totalprice").over(w).cast("double"), 2).alias("running"))


@add("SELECT c_nationkey AS k, 'both' AS side FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT c_nationkey, 'customer only' FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def set_operations(spark, d):
    """SET-01..03."""
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customer only")))


@add("SELECT o_orderpriority, measure, round_even(value, 6) AS value FROM (SELECT o_orderpriority, avg(o_totalprice)::DOUBLE AS mean_price, max(o_totalprice)::DOUBLE AS max_price FROM orders GROUP BY o_orderpriority) UNPIVOT (value FOR measure IN (mean_price, max_price))")
def melt(spark, d):
    """PVT-04, PRJ-02."""
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").cast("double").alias("mean_price"), F.max("o_totalprice").cast("double").alias("max_price"))
    return g.unpivot("o_orderpriority", ["mean_price", "max_price"], "measure", "value").withColumn("value", r6("value"))


@add("SELECT p_brand, round_even(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY p_brand")
def normalised_counts(spark, d):
    """WIN-14."""
    c = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select("p_brand", r6(F.col("n") / F.col("t")).alias("share"))
