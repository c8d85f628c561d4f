"""Audit metrics over a stream of log rows. An extension: the batch operator is operators.audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(log: DataFrame, ts_col: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, queries, hits, events) of each window; rows later than `late` are dropped by the watermark."""
    rows = log.withColumn("at", F.col(ts_col).cast("timestamp")).withWatermark("at", late)
    counts = rows.groupBy(F.window("at", window)).agg(F.count("*").alias("queries"), F.sum((F.col("cache_status") == "hit").cast("long")).alias("hits"))
    return counts.select(F.col("window.start").alias("start"), "queries", "hits")
