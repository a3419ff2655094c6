"""Incremental coverage: sentences as a stream against frozen centroids (an extension, not part of parity)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.vectors import nearest_centroid


def stream_coverage(stream: DataFrame, cents: DataFrame, tau: float, event_time: str, lateness: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Running coverage by session and window; assignment is stateless, counts are bounded by the watermark.

    ``stream`` is a streaming (or batch) relation with ``session``, ``vec`` and ``event_time``.
    """
    near = nearest_centroid(stream, cents)
    w = F.window(event_time, window).alias("window")
    return near.withWatermark(event_time, lateness).groupBy("session", w).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("cosine") >= tau).cast("long")).alias("covered"))
