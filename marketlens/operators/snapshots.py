"""Dated snapshots of earlier fetches: latest, fresh, what to fetch again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.urls import snapshot_key

TTL_HOURS = 24


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("cache_key", snapshot_key(F.col("cache_type"), F.col("query")))


def latest(snapshots: DataFrame) -> DataFrame:
    """One row per key, the youngest.  `max_by` combines before the shuffle."""
    rest = [c for c in snapshots.columns if c not in ("cache_type", "cache_key")]
    newest = F.max_by(F.struct(*rest), F.struct("cached_at", *[c for c in rest if c not in ("cached_at", "data")]))
    return (
        snapshots.groupBy("cache_type", "cache_key")
        .agg(newest.alias("_s"))
        .select("cache_type", "cache_key", *[F.col(f"_s.{c}").alias(c) for c in rest])
    )


def is_fresh(cached_at: Column, as_of: Column, ttl_hours: int = TTL_HOURS) -> Column:
    """Strictly before the end of its life; without a stamp never."""
    ends = cached_at + F.make_dt_interval(hours=F.lit(ttl_hours))
    return F.coalesce(as_of < ends, F.lit(False))


def fresh(snapshots: DataFrame, as_of: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Latest snapshot of each key that has not expired.

    The younger, the fresher: the test may go first, where the scan can use it, and
    only the fresh part of the history is aggregated.
    """
    return latest(snapshots.where(is_fresh(F.col("cached_at"), as_of, ttl_hours)))


def reusable(requests: DataFrame, snapshots: DataFrame, as_of: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Requests answered by a fresh snapshot."""
    return requests.join(
        fresh(snapshots, as_of, ttl_hours).select("cache_key"), "cache_key", "left_semi"
    )


def to_fetch(requests: DataFrame, snapshots: DataFrame, as_of: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Requests without one."""
    return requests.join(
        fresh(snapshots, as_of, ttl_hours).select("cache_key"), "cache_key", "left_anti"
    )


def statistics(requests: DataFrame, snapshots: DataFrame, as_of: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Hits, misses, expired and the hit rate in percent.

    An expired snapshot is dropped by the first request that meets it, so it
    counts once as expired; every request without a fresh one is a miss.
    """
    known = latest(snapshots.select("cache_type", "cache_key", "cached_at")).select("cache_key", "cached_at")
    per_key = requests.groupBy("cache_key").agg(F.count(F.lit(1)).alias("_n"))
    hit = is_fresh(F.col("cached_at"), as_of, ttl_hours)
    counts = per_key.join(known, "cache_key", "left").agg(
        F.coalesce(F.sum(F.when(hit, F.col("_n")).otherwise(0)), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(~hit, F.col("_n")).otherwise(0)), F.lit(0)).alias("misses"),
        F.count_if(~hit & F.col("cached_at").isNotNull()).alias("expired"),
    )
    rate = F.try_divide(F.col("hits") * 100.0, (F.col("hits") + F.col("misses")).cast("double"))
    return counts.withColumn("hit_rate", F.coalesce(F.round(rate, 2), F.lit(0.0)))
