"""The audit log: who asked what, what was shown, what it cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators import ranks

SHARES = {"median": 0.5, "p95": 0.95}
NEAREST = {"nearest_p95": lambda n: F.floor((n - 1) * 0.95), "upper_median": lambda n: F.floor(n / 2)}


def append(log_path: str, rows: DataFrame) -> None:
    rows.write.mode("append").parquet(log_path)


def recent(log: DataFrame, principal: str | None = None, limit: int = 50) -> DataFrame:
    rows = log if principal is None else log.filter(F.col("principal") == principal)
    return rows.orderBy(F.desc("id")).limit(limit)


def who_accessed(log: DataFrame, chunk_id: int) -> DataFrame:
    return log.filter(F.array_contains("retrieved", F.lit(chunk_id).cast("long"))).select("id", "principal", "ts").orderBy("id")


def accesses(log: DataFrame) -> DataFrame:
    """(chunk_id, principal, n) of everything shown."""
    return log.select("principal", F.explode("retrieved").alias("chunk_id")).groupBy("chunk_id", "principal").agg(F.count("*").alias("n"))


def metrics(log: DataFrame) -> DataFrame:
    """One row: queries, hit rate, cost, latency percentiles and events."""
    rows = log.agg(
        F.count("*").alias("queries"),
        F.round(F.avg((F.col("cache_status") == "hit").cast("double")), 3).alias("hit_rate"),
        F.round(F.sum("cost_usd"), 4).alias("total_cost"),
        F.round(F.avg("cost_usd"), 6).alias("avg_cost"),
        F.coalesce(F.sum(F.size("security_events").cast("long")), F.lit(0)).alias("security_events"),
    )
    latency = percentiles(log).select(F.struct(*SHARES)).scalar()
    at = lambda name, out: F.round(latency[name], 1).alias(out)
    return rows.select("queries", "hit_rate", "total_cost", "avg_cost", at("median", "p50_ms"), at("p95", "p95_ms"), "security_events")


def model_mix(log: DataFrame) -> DataFrame:
    return log.groupBy(F.coalesce("model", F.lit("none")).alias("model")).agg(F.count("*").alias("n"))


def percentiles(log: DataFrame, column: str = "latency_ms") -> DataFrame:
    """Interpolated median and 95th percentile, in one row."""
    found = ranks.percentiles(log, column, SHARES)
    return found.agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in SHARES])


def percentiles_by(log: DataFrame, by: list[str], column: str = "latency_ms") -> DataFrame:
    """(by..., name, value): interpolated and nearest-rank percentiles of every group at once."""
    return ranks.percentiles(log, column, SHARES, by).unionByName(ranks.at_ranks(log, column, NEAREST, by).select(*by, "name", "value"))


def nearest_ranks(log: DataFrame, column: str = "latency_ms") -> DataFrame:
    """(name, value) of the nearest-rank 95th percentile and the upper median."""
    return ranks.at_ranks(log, column, NEAREST).select("name", "value")
