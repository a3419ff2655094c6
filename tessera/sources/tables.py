"""Parquet table access and logical-key de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.lineage import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one input table; filters and column selections push into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_delivery(df: DataFrame, *key: str) -> DataFrame:
    """One row per logical key.

    Repeated deliveries carry equal content, so any of them may stand for the key.
    Rows whose key is null in some part cannot be matched with another delivery and
    all stay.
    """
    odd = F.when(F.greatest(*[F.col(k).isNull() for k in key]) if len(key) > 1 else F.col(key[0]).isNull(), F.monotonically_increasing_id())
    return df.withColumn("__odd", odd).dropDuplicates([*key, "__odd"]).drop("__odd")


def single_deliveries(df: DataFrame, *key: str) -> DataFrame:
    """``one_delivery`` for wide rows: only the keys are shuffled.

    The keys that occur again are written first, so that the planner knows their size and
    broadcasts them if they are few; rows of other keys stream through, and only the rows
    of repeated keys are de-duplicated.  Rows with a null in the key all stay.
    """
    keys = df.select(*key).dropna().groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*key)
    repeated = Workspace(df.sparkSession, "repeated").write(keys, "keys")
    alone = df.join(repeated, list(key), "left_anti").select(df.columns)
    again = df.join(repeated, list(key), "left_semi").select(df.columns).dropDuplicates(list(key))
    return alone.unionByName(again)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where there are fewer partitions than cores; for costly work on small files.

    A table large enough to fill the cluster has more partitions and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
