"""Seller names: canonical form and alias tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import fixed_values as fv
from marketlens.functions.text import let, normalize_seller_name, or_empty


def alias_table(
    spark: SparkSession, aliases: Mapping[str, Sequence[str]] = fv.SELLER_ALIASES
) -> DataFrame:
    """One row per normalised variation; of repeated variations the last wins."""
    rows = [(v, name, i) for i, (v, name) in enumerate(
        (v, name) for name, variations in aliases.items() for v in variations)]
    raw = spark.createDataFrame(rows, "variation string, canonical string, ord int")
    return (
        raw.select(
            normalize_seller_name(F.col("variation")).alias("variation"),
            normalize_seller_name(F.col("canonical")).alias("canonical"),
            "ord",
        )
        .groupBy("variation")
        .agg(F.max_by("canonical", "ord").alias("canonical"))
    )


def with_canonical_seller(
    offers: DataFrame, aliases: DataFrame, column: str = "seller_name_norm"
) -> DataFrame:
    """Alias lookup by join, for alias tables of any size."""
    norm = (
        offers.withColumn("variation", normalize_seller_name(F.col("seller_name")))
        .join(aliases.select("variation", F.col("canonical").alias("_canonical")), "variation", "left")
    )
    named = F.coalesce("_canonical", "variation")
    return norm.withColumn(
        column, F.when(or_empty(F.col("seller_name")) == "", fv.UNKNOWN_SELLER).otherwise(named)
    ).drop("variation", "_canonical")


def canonical_seller(
    seller_name: Column,
    aliases: Mapping[str, Sequence[str]] = fv.SELLER_ALIASES,
    norm: Column | None = None,
) -> Column:
    """Same lookup for a small fixed table, as literal arrays inside the expression.

    Variations and names are normalised by the same expression as the data and
    folded to literals; of repeated variations the last wins.  `norm` is the
    normalised name where it is a column already.
    """
    if norm is None:
        norm = normalize_seller_name(seller_name)
    pairs = [(v, name) for name, variations in aliases.items() for v in variations][::-1]
    named = norm
    if pairs:
        variations = F.array(*[normalize_seller_name(F.lit(v)) for v, _ in pairs])
        canonical = F.array(*[normalize_seller_name(F.lit(name)) for _, name in pairs])
        named = let(norm, lambda n: F.coalesce(F.get(canonical, F.array_position(variations, n) - 1), n))
    return F.when(or_empty(seller_name) == "", fv.UNKNOWN_SELLER).otherwise(named)
