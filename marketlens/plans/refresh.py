"""What to reuse and what to fetch again, from dated snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from marketlens.operators import snapshots


def plan(
    requests: DataFrame, known: DataFrame, as_of: Column, ttl_hours: int = snapshots.TTL_HOURS
) -> dict[str, DataFrame]:
    """`requests` has `cache_type` and `query`; keys are made here."""
    keyed = snapshots.with_key(requests)
    return {
        "reuse": snapshots.reusable(keyed, known, as_of, ttl_hours),
        "fetch": snapshots.to_fetch(keyed, known, as_of, ttl_hours),
        "statistics": snapshots.statistics(keyed, known, as_of, ttl_hours),
    }
