"""Keeping hot keys from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1 / 1000
HOT_MIN_ROWS = 100_000
SALTS = 64


def hot_keys(
    df: DataFrame, key: str, share: float = HOT_SHARE, min_rows: int = HOT_MIN_ROWS, salts: int = SALTS
) -> DataFrame:
    """Keys holding more than `share` of all rows, and in how many `bins` they are dealt out.

    There are fewer than ``1 / share`` of them whatever the size of `df`, so the
    result may be broadcast.  A bin holds about as many rows as make a key hot, so a key
    just over the limit has two, and none has more than `salts`.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    limit = F.greatest(total * F.lit(share), F.lit(float(min_rows)))
    bins = F.least(F.lit(salts), F.ceil(F.col("_n") / limit)).cast("bigint")
    return counts.where(F.col("_n") > limit).select(key, bins.alias("bins"))


def salted_left_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_spread: Sequence[Column],
    right_spread: Sequence[Column],
    share: float = HOT_SHARE,
    min_rows: int = HOT_MIN_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Left outer join that splits hot keys of the right side.

    A sort-merge left join can only be split on its left side at run time.  Here
    the right rows of a hot key are dealt out over its bins and its left rows are
    repeated per bin, so by the key's own share and no more; left rows without a key,
    which match nothing, are dealt out as well.  A bin without right rows leaves a padded
    row, which is dropped: a hot key is known to have a match elsewhere.
    """
    hot = F.broadcast(hot_keys(right, key, share, min_rows, salts).withColumnRenamed("bins", "_hot"))
    n = F.lit(salts)
    dealt_right = (
        right.where(F.col(key).isNotNull())
        .join(hot, key, "left")
        .withColumn(
            "_salt",
            F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*right_spread), F.col("_hot"))).otherwise(F.lit(0)),
        )
        .drop("_hot")
        .withColumn("_matched", F.lit(True))
    )
    every_bin = F.sequence(F.lit(0).cast("bigint"), F.col("_hot") - 1)
    dealt_left = left.join(hot, key, "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot").isNotNull(), every_bin)
            .when(F.col(key).isNull(), F.array(F.pmod(F.xxhash64(*left_spread), n)))
            .otherwise(F.array(F.lit(0).cast("bigint")))
        ),
    )
    return (
        dealt_left.join(dealt_right, [key, "_salt"], "left")
        .where(F.col("_hot").isNull() | F.col("_matched").isNotNull())
        .drop("_hot", "_salt")
    )


def first_row(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row of each key, the first by `order`; combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(first.alias("_first")).select(
        *[F.col(f"_first.{c}").alias(c) if c != key else F.col(key) for c in df.columns]
    )
