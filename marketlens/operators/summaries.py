"""Seller and part summaries, run statistics, outlier flags.

Every summary aggregates in two steps where a group may be large: first per
(group, value), which spreads a hot group over all tasks, then per group.  No
step holds more than a bounded piece of one group at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import fixed_values as fv
from marketlens.functions.text import non_empty, or_empty
from marketlens.functions.urls import numbered_urls
from marketlens.operators.offers import export_price_toman
from marketlens.session import materialize


def _zero() -> Column:
    return F.lit(0).cast("bigint")


# --- building blocks ---------------------------------------------------------

def first_urls(df: DataFrame, keys: Sequence[str], url: Column, n: int) -> DataFrame:
    """The `n` smallest distinct urls of each group as array `urls`.

    Distinct first, then a rank limit, which Spark applies before the shuffle:
    at most `n` urls per group and task move, and at most `n` meet in an array.
    """
    distinct = df.select(*keys, non_empty(url).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    w = Window.partitionBy(*keys).orderBy("_url")
    return (
        distinct.withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= n)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_url")).alias("urls"))
    )


_DIGIT_BITS = 16


def exact_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median of non-negative integers, truncated, as column `median`."""
    valued = df.where(F.col(value).isNotNull())
    return median_of_counts(valued.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), keys)


def median_of_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`median` of each group of (keys, _v, _n): values and how often they occur.

    Radix selection, 16 bits at a time from the top.  At each level tasks count the
    values of a group by their next digit, partial histograms are merged by key, and the
    histogram, of at most 65,536 entries whatever the group, says which digit holds each
    middle rank; only values that begin with it are counted at the next level.  No level
    sorts a group or holds its values.
    """
    counts = materialize(counts, "value-counts")
    largest = counts.agg(F.max("_v")).first()[0] or 0
    levels = max(1, -(-int(largest).bit_length() // _DIGIT_BITS))
    total = F.sum("_n")
    ranks = F.array(F.expr("(_total + 1) div 2"), F.expr("_total div 2 + 1"))
    state = (
        counts.groupBy(*keys).agg(total.alias("_total"))
        .select(*keys, F.posexplode(ranks).alias("_middle", "_rank"))
        .withColumn("_prefix", F.lit(0).cast("bigint"))
    )
    for level in reversed(range(levels)):
        digits = counts.withColumn("_digit", F.shiftright("_v", _DIGIT_BITS * level))
        if level == levels - 1:  # all values begin alike
            histogram = digits.groupBy(*keys, "_digit").agg(total.alias("_n"))
            met = histogram.join(state, list(keys))
        else:
            begun = digits.withColumn("_prefix", F.shiftright("_digit", _DIGIT_BITS))
            met = begun.join(state, [*keys, "_prefix"]).groupBy(*keys, "_middle", "_rank", "_digit").agg(total.alias("_n"))
        entries = F.array_sort(F.collect_list(F.struct("_digit", "_n")))
        state = (
            met.groupBy(*keys, "_middle", "_rank")
            .agg(entries.alias("_entries"))
            .select(*keys, "_middle", _slot_of_rank(F.col("_entries"), F.col("_rank")).alias("_s"))
            .select(*keys, "_middle", F.col("_s.rank").alias("_rank"), F.col("_s.digit").alias("_prefix"))
        )
    return state.groupBy(*keys).agg(
        F.expr("min(_prefix) + (max(_prefix) - min(_prefix)) div 2").alias("median")
    )


def _slot_of_rank(entries: Column, rank: Column) -> Column:
    """The digit that holds a rank, and the rank among values with that digit."""
    start = F.struct(rank.cast("bigint").alias("rank"), F.lit(None).cast("bigint").alias("digit"))

    def step(found: Column, entry: Column) -> Column:
        here = found["digit"].isNull() & (found["rank"] <= entry["_n"])
        passed = found["digit"].isNull() & ~here
        return F.struct(
            F.when(passed, found["rank"] - entry["_n"]).otherwise(found["rank"]).alias("rank"),
            F.when(here, entry["_digit"]).otherwise(found["digit"]).alias("digit"),
        )

    return F.aggregate(entries, start, step)


def first_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Values of the earliest row of each group."""
    first = F.min_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_first")).select(
        *keys, *[F.col(f"_first.{v}").alias(v) for v in values]
    )


def _price_buffers(price: str) -> list[Column]:
    """Mergeable price aggregates; exact decimals, NULL on overflow of the squares.

    For that case there are the mean and the sum of squares around it in doubles.
    """
    p, d = F.col(price).cast("decimal(20,0)"), F.col(price).cast("double")
    return [
        F.count(F.lit(1)).alias("_rows"),
        F.count(price).alias("_n"),
        F.sum(p).alias("_sum"),
        F.try_sum(F.try_multiply(p, p)).alias("_squares"),
        F.avg(d).alias("_mean"),
        (F.var_pop(d) * F.count(price)).alias("_around"),
        F.min(price).alias("_min"),
        F.max(price).alias("_max"),
    ]


def _between() -> Column:
    """Squares of the pieces' means around the mean of all, weighted."""
    n, mean = F.col("_n").cast("double"), F.col("_mean")
    return F.sum(n * mean * mean) - F.try_divide(F.sum(n * mean) * F.sum(n * mean), F.sum(n))


def _merged_buffers() -> list[Column]:
    return [
        F.sum("_rows").alias("_rows"),
        F.sum("_n").alias("_n"),
        F.sum("_sum").alias("_sum"),
        # NULL in any piece makes the whole NULL
        F.when(F.count_if(F.col("_squares").isNull() & (F.col("_n") > 0)) == 0, F.try_sum("_squares")).alias("_squares"),
        F.try_divide(F.sum(F.col("_n") * F.col("_mean")), F.sum("_n").cast("double")).alias("_mean"),
        (F.sum("_around") + _between()).alias("_around"),
        F.min("_min").alias("_min"),
        F.max("_max").alias("_max"),
    ]


def _mean() -> Column:
    """Integer mean: exact division of the sum, no doubles."""
    n = F.col("_n").cast("decimal(20,0)")
    return F.coalesce(
        F.when(F.col("_n") > 0, F.call_function("div", F.col("_sum"), n)), _zero()
    )


def _sample_std() -> Column:
    """Truncated sample deviation, 0 for fewer than three prices.

    From exact sums; from doubles where squares pass 38 digits.
    """
    n = F.col("_n").cast("decimal(20,0)")
    spread = F.try_subtract(
        F.try_multiply(n, F.col("_squares")), F.try_multiply(F.col("_sum"), F.col("_sum"))
    ).cast("double")
    exact = F.sqrt(F.try_divide(spread, (n * (n - 1)).cast("double")))
    near = F.sqrt(F.try_divide(F.col("_around"), (F.col("_n") - 1).cast("double")))
    return F.when(F.col("_n") > 2, F.floor(F.coalesce(exact, near)).try_cast("bigint")).otherwise(_zero())


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), _zero())


def _valid_price(price: Column, missing: Column | None = None) -> Column:
    """NULL unless it counts for statistics; rows themselves always count."""
    ok = price > 0
    if missing is not None:
        ok = ok & (F.coalesce(missing, F.lit(0)) == 0)
    return F.when(ok, price)


def _seller(offers: DataFrame) -> Column:
    return F.coalesce(F.col("seller_name_norm"), F.lit(fv.UNKNOWN_SELLER))


def _priced(offers: DataFrame, two_stage: bool) -> Column:
    if two_stage:
        return _valid_price(F.col("price_toman"), F.col("price_missing"))
    return _valid_price(export_price_toman())


def price_deviation(offers: DataFrame, keys: Sequence[str], two_stage: bool = True) -> DataFrame:
    """Truncated sample deviation of the valid prices of each group."""
    rows = offers.select(*keys, _priced(offers, two_stage).alias("_price"))
    return rows.groupBy(*keys).agg(*_price_buffers("_price")).select(
        *keys, _sample_std().alias("price_std_dev")
    )


def priced_counts(offers: DataFrame, key: str, two_stage: bool = True) -> DataFrame:
    """All offers of a group, and those with a valid price."""
    named = _seller(offers) if key == "seller_name_norm" else F.col(key)
    return (
        offers.select(named.alias(key), _priced(offers, two_stage).alias("_price"))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("offers_count"), F.count("_price").alias("priced_count"))
    )


# --- sellers -----------------------------------------------------------------

def seller_statistics(offers: DataFrame, n_urls: int = 3) -> DataFrame:
    """Counts, floor mean, extremes, `n_urls` urls and distinct parts per seller."""
    rows = offers.select(
        _seller(offers).alias("seller_name_norm"),
        non_empty(F.col("part_id").cast("string")).alias("part_id"),
        F.nullif(F.col("price_raw"), _zero()).alias("_price"),
        "product_url",
    )
    per_part = rows.groupBy("seller_name_norm", "part_id").agg(*_price_buffers("_price"))
    stats = per_part.groupBy("seller_name_norm").agg(
        *_merged_buffers(),
        F.count(F.nullif(F.col("part_id"), F.lit("0"))).alias("parts_count"),
    )
    n = F.col("_n").cast("decimal(20,0)")
    floor_mean = F.call_function("div", F.col("_sum") - F.pmod(F.col("_sum"), n), n)
    urls3 = first_urls(rows, ["seller_name_norm"], F.col("product_url"), n_urls)
    return stats.join(urls3, "seller_name_norm", "left").select(
        "seller_name_norm",
        F.col("_rows").alias("offers_count"),
        F.when(F.col("_n") > 0, floor_mean).otherwise(_zero()).alias("avg_price_toman"),
        _or_zero("_min").alias("min_price_toman"),
        _or_zero("_max").alias("max_price_toman"),
        or_empty(F.array_join("urls", ", ")).alias("sample_urls"),
        "parts_count",
    )


def sellers_summary(offers: DataFrame, two_stage: bool = True, n_urls: int | None = None) -> DataFrame:
    """`n_urls`: sample urls of a seller, by default as many as the report of its job has."""
    rows = offers.select(
        _seller(offers).alias("seller_name_norm"),
        _priced(offers, two_stage).alias("_price"),
        "product_url",
    )
    stats = rows.groupBy("seller_name_norm").agg(*_price_buffers("_price"))
    found = first_urls(rows, ["seller_name_norm"], F.col("product_url"), n_urls or fv.SAMPLE_URLS[two_stage])
    out = stats.join(found, "seller_name_norm", "left").select(
        "seller_name_norm",
        F.col("_rows").alias("offers_count"),
        _mean().alias("avg_price_toman"),
        _or_zero("_min").alias("min_price_toman"),
        _or_zero("_max").alias("max_price_toman"),
        or_empty(F.array_join("urls", "\n")).alias("sample_urls"),
        *([numbered_urls(_urls(), "Product").alias("validation_urls")] if two_stage else []),
    )
    return out


def _urls() -> Column:
    return F.coalesce(F.col("urls"), F.array().cast("array<string>"))


# --- parts -------------------------------------------------------------------

def part_summary(
    offers: DataFrame, order: Sequence[str], two_stage: bool = True, keep_part_id: bool = True,
    n_urls: int | None = None,
) -> DataFrame:
    """Offers, sellers, average market price, median, extremes, deviation, urls.

    `order` names the columns that say which offer of a part came first; its
    key and display name stand for the part.
    """
    rows = offers.select(
        "part_id",
        _seller(offers).alias("_seller"),
        _priced(offers, two_stage).alias("_price"),
        "product_url",
        F.struct(
            *order,
            F.coalesce("part_key", F.lit(fv.UNKNOWN)).alias("_key"),
            or_empty(F.col("part_name_norm")).alias("_name"),
        ).alias("_offer"),
    )
    # offers are read and shuffled once; all that follows reads this table
    pieces = materialize(
        rows.groupBy("part_id", "_seller", "_price", "product_url").agg(*_price_buffers("_price"), F.min("_offer").alias("_first")),
        "part-pieces",
    )
    # apart from the numbers, whose steps would sort and carry the names
    first = pieces.groupBy("part_id").agg(F.min("_first").alias("_first")).select(
        F.col("part_id").alias("_part"), F.col("_first._key").alias("part_key"), F.col("_first._name").alias("part_name_norm")
    )
    per_seller = pieces.groupBy("part_id", "_seller").agg(*_merged_buffers())
    stats = per_seller.groupBy("part_id").agg(*_merged_buffers(), F.count(F.lit(1)).alias("seller_count"))
    found = first_urls(pieces, ["part_id"], F.col("product_url"), n_urls or fv.SAMPLE_URLS[two_stage])
    prices = pieces.where(F.col("_price").isNotNull()).groupBy("part_id", F.col("_price").alias("_v"))
    median = median_of_counts(prices.agg(F.sum("_n").alias("_n")), ["part_id"])
    out = (
        stats.join(first, F.col("part_id").eqNullSafe(F.col("_part")), "left").drop("_part")
        .join(median, "part_id", "left")
        .join(found, "part_id", "left")
        .select(
            *(["part_id"] if keep_part_id else []),
            "part_key",
            "part_name_norm",
            F.col("_rows").alias("offers_count"),
            "seller_count",
            _mean().alias("AMP_toman"),
            _or_zero("median").alias("median_price_toman"),
            _or_zero("_min").alias("min_price_toman"),
            _or_zero("_max").alias("max_price_toman"),
            _sample_std().alias("price_std_dev"),
            or_empty(F.array_join("urls", "\n")).alias("sample_urls"),
            *([numbered_urls(_urls(), "Offer").alias("validation_urls")] if two_stage else []),
        )
    )
    return out


# --- outliers ----------------------------------------------------------------

def outlier_bounds(parts: DataFrame) -> DataFrame:
    """Mean and population deviation of the positive average prices.

    One row; NULLs unless more than two parts have a price.
    """
    p = F.when(F.col("AMP_toman") > 0, F.col("AMP_toman"))
    d = p.cast("decimal(20,0)")
    sums = parts.agg(
        F.count(p).alias("priced_parts"), F.sum(d).alias("_sum"), F.try_sum(F.try_multiply(d, d)).alias("_squares"),
        F.stddev_pop(p.cast("double")).alias("_near"),
    )
    n = F.col("priced_parts").cast("decimal(20,0)")
    spread = F.try_subtract(F.try_multiply(n, F.col("_squares")), F.try_multiply(F.col("_sum"), F.col("_sum")))
    enough = F.col("priced_parts") > 2
    return sums.select(
        "priced_parts",
        F.when(enough, F.try_divide(F.col("_sum").cast("double"), F.col("priced_parts").cast("double"))).alias("mean_amp"),
        F.when(
            enough,
            F.coalesce(F.sqrt(F.try_divide(spread.cast("double"), (n * n).cast("double"))), F.col("_near")),
        ).alias("std_amp"),
    )


def with_outlier_flags(
    parts: DataFrame,
    columns: Sequence[str] = ("median_price_toman", "min_price_toman", "max_price_toman"),
) -> DataFrame:
    """Flags prices more than two deviations off the mean average price.

    The bounds are one row, read as scalar subqueries.
    """
    bounds = outlier_bounds(parts)
    mean, std = bounds.select("mean_amp").scalar(), bounds.select("std_amp").scalar()
    return parts.withColumns(
        {
            c.replace("_toman", "_outlier"): F.coalesce(
                (F.col(c) > 0) & (F.abs(F.col(c).cast("double") - mean) > std * 2.0), F.lit(False)
            )
            for c in columns
        }
    )


# --- statistics --------------------------------------------------------------

def two_stage_statistics(offers: DataFrame) -> DataFrame:
    """Counts of one run over processed offers (absent seller counts as '')."""
    rel = F.coalesce(F.col("relevance"), F.lit(0.0))
    return offers.agg(
        F.count(F.lit(1)).alias("total_offers"),
        F.count_distinct(or_empty(F.col("seller_name_norm"))).alias("unique_sellers"),
        F.coalesce(F.avg(F.when(rel != 0, rel)), F.lit(0.0)).alias("avg_relevance"),
        F.count_if(rel > 0).alias("filtered_offers"),
        F.count_if(F.coalesce(F.col("drilled_down"), F.lit(False))).alias("product_pages"),
    )


def single_stage_statistics(parts: DataFrame, found: DataFrame, kept: DataFrame) -> DataFrame:
    """Parts asked for, offers found for them, offers after deduplication, sellers."""
    counted = kept.agg(
        F.count(F.lit(1)).alias("offers_after_dedup"),
        F.count_distinct(or_empty(F.col("seller_name_norm"))).alias("unique_sellers"),
    )
    n = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    searched = found.join(parts.select("part_id").distinct(), "part_id", "left_semi")
    return counted.select(
        n(parts).alias("parts_processed"),
        n(searched).alias("total_offers_found"),
        "offers_after_dedup",
        "unique_sellers",
    )


def export_counts(offers: DataFrame) -> DataFrame:
    """Offers, and how many sellers and parts they have.

    Both distinct counts come from one table of (seller, part), so no row is expanded
    once a distinct count, and a hot seller or part is spread by the other.
    """
    seller = F.coalesce("seller_name_norm", F.lit(fv.UNKNOWN_SELLER)).alias("_seller")
    pairs = offers.groupBy(seller, "part_id").agg(F.count(F.lit(1)).alias("_n"))
    parts = pairs.select("part_id").distinct().agg(F.count("part_id").alias("n"))
    return (
        pairs.groupBy("_seller").agg(F.sum("_n").alias("_n"))
        .agg(F.coalesce(F.sum("_n"), _zero()).alias("raw_offers"), F.count(F.lit(1)).alias("sellers"))
        .withColumn("parts", parts.scalar())
    )


# --- order of the reports ----------------------------------------------------

# Ties are broken by further columns, which also lets the range partitioning of
# the sort split a price or a score that very many offers share.
_TIES = ["product_url", "seller_name_norm", "title_raw", "snapshot_ts"]


def sort_offers_single(df: DataFrame) -> DataFrame:
    return df.orderBy("part_id", "price_toman", *_TIES)


def sort_offers_two_stage(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("relevance"), "price_toman", "part_id", *_TIES)


def sort_sellers(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("offers_count"), "seller_name_norm")


def sort_parts(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("AMP_toman"), "part_id")
