"""Joins, aggregations, ranks, sorts and whole jobs (J, A, W, O, U, S, K, Q rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions import fixed_values as fv, text
from marketlens.operators import (
    audit, dedupe, offers, parts, sellers, similarity, snapshots, summaries,
)
from marketlens.plans import audit as audit_job, refresh, single_stage, two_stage
from marketlens.session import materialize, settled
from queries import duck as d
from queries.registry import query
from queries.scalars import PART_META, RELEVANT, scored_cards
from queries.views import AS_OF

c = F.col
LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
KEYS = LINE.split(", ")
# total order of offers (the four keys alone repeat in the smallest tables)
ORDER = f"{LINE}, l_quantity"
ORDER_KEYS = ORDER.split(", ")
NOW = f"TIMESTAMP '{AS_OF}'"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# --- shared oracle pieces ----------------------------------------------------

SIGNED = f"""SELECT *, {d.canonical('seller_name')} AS seller_canonical,
    {d.title('title_raw')} AS title_norm, coalesce(price_raw, 0) AS price,
    {d.score()} AS completeness FROM {{offers}}"""
# single-stage offers ready for deduplication
PREPARED = f"""SELECT {ORDER}, o.part_id, o.part_name, o.part_code, m.part_key, m.part_name_norm, title_raw,
    CASE WHEN currency_unit = 'rial' THEN price_raw // 10 ELSE price_raw END AS price_raw,
    CASE WHEN currency_unit = 'rial' THEN 'toman' ELSE currency_unit END AS currency_unit,
    {d.canonical('seller_name')} AS seller_name_norm, seller_name, product_url, seller_url, availability,
    snapshot_ts FROM {{offers}} o JOIN ({PART_META}) m ON o.part_id = m.part_id WHERE price_raw > 0"""
TOP = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part_id
    ORDER BY relevance DESC, card_ord) AS relevance_rank FROM ({RELEVANT}) WHERE trim(query) <> '')"""
DRILLED = f"""SELECT t.part_id, t.card_ord, t.part_ord, t.part_name, t.part_code, t.query, t.relevance,
    t.relevance_rank, t.part_key, t.part_name_norm, t.title_raw, t.product_url, t.snapshot_ts, g.offer_pos,
    g.product_url IS NOT NULL AS drilled_down,
    CASE WHEN g.product_url IS NULL THEN t.seller_name END AS seller_name,
    CASE WHEN g.product_url IS NOT NULL THEN {d.seller('g.seller_name')} END AS seller_name_norm,
    CASE WHEN g.product_url IS NOT NULL THEN g.price_raw ELSE t.price_raw END AS price_raw,
    CASE WHEN g.product_url IS NOT NULL THEN g.price_text ELSE t.price_text END AS price_text,
    CASE WHEN g.product_url IS NOT NULL THEN g.currency_unit ELSE t.currency_unit END AS currency_unit,
    CASE WHEN g.product_url IS NOT NULL THEN g.seller_url ELSE t.seller_url END AS seller_url,
    CASE WHEN g.product_url IS NOT NULL THEN g.availability ELSE t.availability END AS availability
    FROM ({TOP}) t LEFT JOIN {{page_offers}} g ON g.product_url = nullif(t.product_url, '')"""
PROCESSED = f"""SELECT *,
    CASE WHEN currency_unit = 'rial' AND coalesce(price_raw, 0) > 0 THEN price_raw // 10
         ELSE coalesce(price_raw, 0) END AS price_toman,
    CASE WHEN coalesce(price_raw, 0) <= 0 THEN 0 WHEN currency_unit = 'rial' THEN price_raw
         ELSE price_raw * 10 END AS price_rial,
    CASE WHEN coalesce(price_raw, 0) <= 0 THEN 1 ELSE 0 END AS price_missing FROM ({DRILLED})"""
SINGLE_PRICED = f"SELECT *, {d.export_toman()} AS pt, coalesce(seller_name_norm, 'UNKNOWN_SELLER') AS sn FROM ({PREPARED})"
TWO_PRICED = f"""SELECT *, CASE WHEN price_missing = 0 THEN price_toman ELSE 0 END AS pt,
    coalesce(seller_name_norm, 'UNKNOWN_SELLER') AS sn FROM ({PROCESSED})"""

_P = "FILTER (pt > 0)"
_MEAN = f"coalesce(CAST(sum(pt) {_P} AS HUGEINT) // count(*) {_P}, 0)::BIGINT"
_STD = f"""CASE WHEN count(*) {_P} > 2 THEN CAST(floor(sqrt(
    CAST(count(*) {_P} * sum(CAST(pt AS HUGEINT) * pt) {_P} - (sum(pt) {_P}) * (sum(pt) {_P}) AS DOUBLE)
    / CAST(count(*) {_P} * (count(*) {_P} - 1) AS DOUBLE))) AS BIGINT) ELSE 0 END"""
_MINMAX = f"coalesce(min(pt) {_P}, 0) AS min_price_toman, coalesce(max(pt) {_P}, 0) AS max_price_toman"
_MEDIAN = f"coalesce(CAST(floor(median(pt) {_P}) AS BIGINT), 0)"


def sellers_sql(src: str, n: int, two: bool) -> str:
    extra = f", {d.numbered('u', 'Product')} AS validation_urls" if two else ""
    return f"""SELECT sn AS seller_name_norm, offers_count, avg_price_toman, min_price_toman,
        max_price_toman, array_to_string(u, chr(10)) AS sample_urls{extra}
        FROM (SELECT sn, count(*) AS offers_count, {_MEAN} AS avg_price_toman, {_MINMAX},
              {d.first_urls('product_url', n)} AS u FROM ({src}) GROUP BY sn)"""


def parts_sql(src: str, n: int, two: bool, order: str) -> str:
    extra = f", {d.numbered('u', 'Offer')} AS validation_urls" if two else ""
    return f"""SELECT part_id, part_key, part_name_norm, offers_count, seller_count, "AMP_toman",
        median_price_toman, min_price_toman, max_price_toman, price_std_dev,
        array_to_string(u, chr(10)) AS sample_urls{extra}
        FROM (SELECT part_id, count(*) AS offers_count, count(DISTINCT sn) AS seller_count,
              {_MEAN} AS "AMP_toman", {_MEDIAN} AS median_price_toman, {_MINMAX},
              {_STD} AS price_std_dev, {d.first_urls('product_url', n)} AS u,
              max(part_key) FILTER (rn = 1) AS part_key,
              max(part_name_norm) FILTER (rn = 1) AS part_name_norm
              FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY {order}) AS rn FROM ({src}))
              GROUP BY part_id)"""


V2_ORDER = "part_ord, relevance_rank, offer_pos NULLS FIRST"


def prepared(t):
    known = parts.with_metadata(t("parts"))
    return materialize(
        dedupe.normalize_offers(single_stage.prepare_offers(known, t("offers"))), "prepared"
    )


def processed(t, columns=two_stage.SUMMARY_COLUMNS):
    """Written once: most summaries read it in several branches.  `columns` of cards that are read."""
    return settled(
        t.spark,
        lambda: two_stage.processed_offers(t("parts"), t("cards"), t("page_offers"), as_of(), columns),
        "processed",
    )


# --- joins -------------------------------------------------------------------


@query(
    "j01_attach_part_metadata",
    f"""SELECT {LINE}, o.part_id, m.part_key, m.part_name_norm, m.car_model FROM {{offers}} o
        JOIN ({PART_META}) m ON o.part_id = m.part_id""",
)
def _(t):
    joined = offers.attach_part_metadata(t("offers"), parts.with_metadata(t("parts")))
    return joined.select(*KEYS, "part_id", "part_key", "part_name_norm", "car_model")


@query("j02_seller_alias_join", f"SELECT {LINE}, {d.canonical('seller_name')} AS seller FROM {{offers}}")
def _(t):
    table = sellers.alias_table(t.spark)
    return sellers.with_canonical_seller(t("offers"), table, "seller").select(*KEYS, "seller")


@query(
    "j03_drill_down",
    f"""SELECT part_id, card_ord, offer_pos, drilled_down, seller_name, seller_name_norm, price_raw, price_text,
        currency_unit, product_url, seller_url, availability, relevance, part_key, title_raw, snapshot_ts
        FROM ({DRILLED})""",
)
def _(t):
    top = two_stage.relevant_cards(t("parts"), t("cards"), as_of())
    return offers.drill_down(top, t("page_offers"), as_of=as_of()).select(
        "part_id", "card_ord", "offer_pos", "drilled_down", "seller_name", "seller_name_norm",
        "price_raw", "price_text", "currency_unit", "product_url", "seller_url", "availability",
        "relevance", "part_key", "title_raw", "snapshot_ts",
    )


@query(
    "j03_drill_down_hot_keys_salted",
    f"SELECT part_id, card_ord, offer_pos, drilled_down, seller_name_norm, price_raw FROM ({DRILLED})",
)
def _(t):
    """Same result with every page of a thousandth of all rows treated as hot."""
    top = two_stage.relevant_cards(t("parts"), t("cards"), as_of())
    salted = offers.drill_down(top, t("page_offers"), as_of=as_of(), share=1 / 1000, min_rows=1, salts=8)
    return salted.select(
        "part_id", "card_ord", "offer_pos", "drilled_down", "seller_name_norm", "price_raw"
    )


_W = "list_distinct(list_filter(string_split(title_norm, ' '), lambda w: w <> ''))"
PAIRS = f"""WITH k AS (SELECT part_id, seller_canonical, title_norm, price, count(*) AS offers, {_W} AS ws
      FROM ({SIGNED}) GROUP BY ALL)
    SELECT a.part_id, a.seller_canonical, a.title_norm AS title_a, a.price AS price_a, b.title_norm AS title_b,
      b.price AS price_b, a.offers AS offers_a, b.offers AS offers_b, a.offers * b.offers AS pairs
    FROM k a JOIN k b ON a.part_id = b.part_id AND a.seller_canonical = b.seller_canonical
      AND (a.title_norm < b.title_norm OR (a.title_norm = b.title_norm AND a.price < b.price))
    WHERE (a.title_norm = '' OR b.title_norm = '' OR (
        least(length(a.title_norm), length(b.title_norm)) / CAST(greatest(length(a.title_norm), length(b.title_norm)) AS DOUBLE) >= CAST(0.7 AS DOUBLE)
        AND len(list_intersect(a.ws, b.ws)) / CAST(len(list_distinct(list_concat(a.ws, b.ws))) AS DOUBLE) >= CAST(0.6 AS DOUBLE)))
      AND (a.price <= 0 OR b.price <= 0
        OR abs(a.price - b.price) / CAST(greatest(a.price, b.price) AS DOUBLE) <= CAST(0.05 AS DOUBLE))
    UNION ALL
    SELECT part_id, seller_canonical, title_norm, price, title_norm, price, offers, offers,
      offers * (offers - 1) // 2 FROM k WHERE offers > 1"""


@query("j04_similar_pairs", PAIRS)
def _(t):
    return similarity.similar_pairs(t("offers"))


@query("j04_similar_pairs_banded", PAIRS)
def _(t):
    """Same pairs with every block joined on shared words and price bands."""
    return similarity.similar_pairs(t("offers"), small_block=0)


SIMILAR = f"""WITH k AS (SELECT part_id, seller_canonical, title_norm, price, count(*) AS offers FROM ({SIGNED}) GROUP BY ALL),
    p AS ({PAIRS}),
    s AS (SELECT part_id, seller_canonical, title_a AS t, price_a AS pr, title_b AS ot, price_b AS op, offers_b AS n FROM p
      WHERE title_a <> title_b OR price_a <> price_b
      UNION ALL SELECT part_id, seller_canonical, title_b, price_b, title_a, price_a, offers_a FROM p
      WHERE title_a <> title_b OR price_a <> price_b),
    f AS (SELECT part_id, seller_canonical, t, pr, sum(n)::BIGINT AS n, min(struct_pack(t := ot, p := op)) AS o FROM s GROUP BY ALL)
    SELECT k.part_id, k.seller_canonical, k.title_norm, k.price, k.offers,
      coalesce(f.n, 0) + k.offers - 1 AS similar_offers, f.o.t AS first_title, f.o.p AS first_price
    FROM k LEFT JOIN f ON k.part_id = f.part_id AND k.seller_canonical = f.seller_canonical
      AND k.title_norm = f.t AND k.price = f.pr"""


@query("j04_similar_offers_of_signature", SIMILAR)
def _(t):
    return similarity.similar_counts(t("offers"))


KEYED = "SELECT cache_type || '_' || md5(lower(query)) AS cache_key, cache_type, query, cached_at, value FROM {snapshots}"
LATEST = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY cached_at DESC) AS rn
    FROM ({KEYED})) WHERE rn = 1"""
FRESH = f"SELECT * FROM ({LATEST}) WHERE {NOW} < cached_at + INTERVAL 24 HOUR"
REQUESTED = "SELECT request_id, cache_type || '_' || md5(lower(trim(query))) AS cache_key FROM {requests}"


def known_snapshots(t):
    return snapshots.with_key(t("snapshots"))


@query("w01_latest_snapshot", f"SELECT cache_key, cached_at, value FROM ({LATEST})")
def _(t):
    return snapshots.latest(known_snapshots(t)).select("cache_key", "cached_at", "value")


@query("f09_fresh_snapshots", f"SELECT cache_key, cached_at FROM ({FRESH})")
def _(t):
    return snapshots.fresh(known_snapshots(t), as_of()).select("cache_key", "cached_at")


@query(
    "j05_reusable_requests",
    f"SELECT request_id, cache_key FROM ({REQUESTED}) WHERE cache_key IN (SELECT cache_key FROM ({FRESH}))",
)
def _(t):
    plan = refresh.plan(t("requests"), known_snapshots(t), as_of())
    return plan["reuse"].select("request_id", "cache_key")


@query(
    "j05_requests_to_fetch",
    f"SELECT request_id, cache_key FROM ({REQUESTED}) WHERE cache_key NOT IN (SELECT cache_key FROM ({FRESH}))",
)
def _(t):
    plan = refresh.plan(t("requests"), known_snapshots(t), as_of())
    return plan["fetch"].select("request_id", "cache_key")


@query(
    "a10_snapshot_statistics",
    f"""SELECT hits, misses, expired, coalesce(round(hits * 100.0 / (hits + misses), 2), 0)::DOUBLE AS hit_rate
        FROM (SELECT count(*) FILTER (f.cache_key IS NOT NULL) AS hits,
              count(*) FILTER (f.cache_key IS NULL) AS misses,
              count(DISTINCT r.cache_key) FILTER (f.cache_key IS NULL AND l.cache_key IS NOT NULL) AS expired
              FROM ({REQUESTED}) r LEFT JOIN ({LATEST}) l ON l.cache_key = r.cache_key
              LEFT JOIN ({FRESH}) f ON f.cache_key = r.cache_key)""",
)
def _(t):
    return refresh.plan(t("requests"), known_snapshots(t), as_of())["statistics"]


# --- aggregations ------------------------------------------------------------


@query(
    "a01_seller_statistics",
    f"""SELECT seller_name_norm, offers_count, avg_price_toman, min_price_toman, max_price_toman,
        array_to_string(u, ', ') AS sample_urls, parts_count FROM (
        SELECT seller_name_norm, count(*) AS offers_count,
          coalesce(sum(price_raw) FILTER (price_raw <> 0) // count(*) FILTER (price_raw <> 0), 0)::BIGINT AS avg_price_toman,
          coalesce(min(price_raw) FILTER (price_raw <> 0), 0) AS min_price_toman,
          coalesce(max(price_raw) FILTER (price_raw <> 0), 0) AS max_price_toman,
          {d.first_urls('product_url', 3)} AS u,
          count(DISTINCT part_id) FILTER (part_id <> '0') AS parts_count
        FROM ({PREPARED}) GROUP BY seller_name_norm)""",
)
def _(t):
    return summaries.seller_statistics(prepared(t))


@query("a02_sellers_summary_single_stage", sellers_sql(SINGLE_PRICED, 3, False))
def _(t):
    return summaries.sort_sellers(summaries.sellers_summary(prepared(t), two_stage=False))


@query("a03_sellers_summary_two_stage", sellers_sql(TWO_PRICED, 5, True))
def _(t):
    return summaries.sort_sellers(summaries.sellers_summary(processed(t)))


@query("a04_part_summary_single_stage", parts_sql(SINGLE_PRICED, 3, False, ORDER))
def _(t):
    return summaries.sort_parts(summaries.part_summary(prepared(t), ORDER_KEYS, two_stage=False))


TWO_PARTS = parts_sql(TWO_PRICED, 5, True, V2_ORDER)


@query("a05_part_summary_two_stage", TWO_PARTS)
def _(t):
    return summaries.sort_parts(summaries.part_summary(processed(t), two_stage.OFFER_ORDER))


@query(
    "a06_exact_median",
    f"""SELECT l_suppkey, CAST(floor(median(v)) AS BIGINT) AS median
        FROM (SELECT l_suppkey, CAST(floor(l_extendedprice * 100) AS BIGINT) AS v FROM {{lineitem}})
        GROUP BY l_suppkey""",
)
def _(t):
    rows = t("lineitem").select("l_suppkey", F.expr("CAST(floor(l_extendedprice * 100) AS BIGINT)").alias("v"))
    return summaries.exact_median(rows, ["l_suppkey"], "v")


@query(
    "a07_sample_deviation",
    f"SELECT part_id, {_STD} AS price_std_dev FROM ({SINGLE_PRICED}) GROUP BY part_id",
)
def _(t):
    return summaries.price_deviation(prepared(t), ["part_id"], two_stage=False)


TWO_STATISTICS = f"""SELECT (SELECT count(DISTINCT part_id) FROM ({TOP})) AS parts_processed,
        (SELECT count(*) FROM {{cards}} WHERE part_id IN (SELECT part_id FROM {{parts}} WHERE trim(keywords) <> ''))
          AS search_results,
        count(*) AS total_offers, count(DISTINCT coalesce(seller_name_norm, '')) AS unique_sellers,
        round(avg(relevance) FILTER (relevance <> 0), 6) AS avg_relevance,
        count(*) FILTER (relevance > 0) AS filtered_offers, count(*) FILTER (drilled_down) AS product_pages
        FROM ({PROCESSED})"""


@query("a08_two_stage_statistics", TWO_STATISTICS)
def _(t):
    stats = two_stage.statistics(t("parts"), t("cards"), processed(t, ["part_id", "relevance"]))
    return stats.withColumn("avg_relevance", F.round("avg_relevance", 6))


EXACT = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part_id, seller_canonical, title_norm, price
    ORDER BY completeness DESC, {ORDER}) AS rn FROM ({SIGNED})) WHERE rn = 1"""


@query(
    "a09_single_stage_statistics",
    f"""SELECT (SELECT count(*) FROM {{parts}} WHERE part_id <> '0' AND part_name <> '' AND keywords <> '')
          AS parts_processed,
        (SELECT count(*) FROM {{offers}} WHERE part_id IN (SELECT part_id FROM {{parts}}
          WHERE part_id <> '0' AND part_name <> '' AND keywords <> '')) AS total_offers_found,
        count(*) AS offers_after_dedup, count(DISTINCT seller_canonical) AS unique_sellers FROM ({EXACT})""",
)
def _(t):
    """Counters with the exact form of deduplication, which SQL can state."""
    kept = dedupe.exact_dedupe(t("offers"), ORDER_KEYS).withColumnRenamed("seller_canonical", "seller_name_norm")
    return summaries.single_stage_statistics(parts.complete_parts(t("parts")), t("offers"), kept)


_RAW_V2 = f"""SELECT part_id, part_name, part_code, query, part_key, part_name_norm, title_raw, price_raw,
    price_text, currency_unit, coalesce(seller_name, '') AS seller_name,
    coalesce(seller_name_norm, '') AS seller_name_norm, price_toman, price_rial, product_url, seller_url,
    {d.validation('product_url', 'seller_url')} AS validation_urls, relevance, snapshot_ts, price_missing,
    drilled_down FROM ({PROCESSED})"""
_AUDITED = {
    "offers_raw": (_RAW_V2, audit.REPORT_URL_COLUMNS["offers_raw"]),
    "sellers_summary": (sellers_sql(TWO_PRICED, 5, True), audit.REPORT_URL_COLUMNS["sellers_summary"]),
    "part_summary": (TWO_PARTS, audit.REPORT_URL_COLUMNS["part_summary"]),
}
AUDIT = " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{col}' AS column_name, true AS found, "
    f"count(nullif({col}, '')) AS non_empty, count(*) AS total_rows FROM ({src})"
    for table, (src, cols) in _AUDITED.items() for col in cols
)


@query(
    "a11_column_completeness",
    """SELECT 'offers' AS table_name, 'product_url' AS column_name, true AS found,
         count(nullif(product_url, '')) AS non_empty, count(*) AS total_rows FROM {offers}
       UNION ALL SELECT 'offers', 'seller_url', true, count(nullif(seller_url, '')), count(*) FROM {offers}
       UNION ALL SELECT 'offers', 'seller_name', true, count(nullif(seller_name, '')), count(*) FROM {offers}
       UNION ALL SELECT 'offers', 'price_raw', true, count(price_raw), count(*) FROM {offers}
       UNION ALL SELECT 'offers', 'validation_urls', false, NULL, NULL""",
)
def _(t):
    columns = ["product_url", "seller_url", "seller_name", "price_raw", "validation_urls"]
    return audit.completeness(t("offers"), columns, "offers")


@query(
    "a12_export_counts",
    f"""SELECT count(*) AS raw_offers, count(DISTINCT sn) AS sellers, count(DISTINCT part_id) AS parts
        FROM ({TWO_PRICED})""",
)
def _(t):
    return summaries.export_counts(processed(t))


BOUNDS = f"""SELECT priced_parts, CASE WHEN priced_parts > 2 THEN s / CAST(priced_parts AS DOUBLE) END AS mean_amp,
    CASE WHEN priced_parts > 2 THEN sqrt(CAST(priced_parts * q - CAST(s AS HUGEINT) * CAST(s AS HUGEINT) AS DOUBLE)
        / CAST(priced_parts * priced_parts AS DOUBLE)) END AS std_amp
    FROM (SELECT count(*) AS priced_parts, CAST(sum("AMP_toman") AS DOUBLE) AS s,
          sum(CAST("AMP_toman" AS HUGEINT) * "AMP_toman") AS q FROM ({TWO_PARTS}) WHERE "AMP_toman" > 0)"""


def two_stage_parts(t):
    return summaries.part_summary(processed(t), two_stage.OFFER_ORDER)


@query(
    "a13_outlier_bounds",
    f"SELECT priced_parts, round(mean_amp, 3) AS mean_amp, round(std_amp, 3) AS std_amp FROM ({BOUNDS})",
)
def _(t):
    b = summaries.outlier_bounds(two_stage_parts(t))
    return b.select("priced_parts", F.round("mean_amp", 3).alias("mean_amp"), F.round("std_amp", 3).alias("std_amp"))


# --- ranks and windows -------------------------------------------------------


@query("w02_exact_dedupe", f"SELECT {LINE}, completeness::INTEGER AS completeness FROM ({EXACT})")
def _(t):
    return dedupe.exact_dedupe(t("offers"), ORDER_KEYS).select(*KEYS, "completeness")


def _alike(a: str, b: str) -> str:
    longer = f"CAST(greatest(length({a}.t), length({b}.t)) AS DOUBLE)"
    united = f"CAST(len(list_distinct(list_concat({a}.w, {b}.w))) AS DOUBLE)"
    return f"""(({a}.t = '' OR {b}.t = '' OR (
        least(length({a}.t), length({b}.t)) / {longer} >= CAST(0.7 AS DOUBLE)
        AND len(list_intersect({a}.w, {b}.w)) / {united} >= CAST(0.6 AS DOUBLE)))
      AND ({a}.p <= 0 OR {b}.p <= 0
        OR abs({a}.p - {b}.p) / CAST(greatest({a}.p, {b}.p) AS DOUBLE) <= CAST(0.05 AS DOUBLE)))"""


def full_dedupe_sql(src: str) -> str:
    """The order-dependent rules, one recursion step per offer of a block.

    `standing` are the offers that later ones are compared with, `kept` the result.
    """
    return f"""SELECT {ORDER}, part_id, seller_canonical, title_norm, price FROM (
    WITH RECURSIVE signed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY part_id, seller_canonical
          ORDER BY {ORDER}) AS n FROM ({src})),
      offer AS MATERIALIZED (SELECT part_id, seller_canonical, n, struct_pack(n := n, t := title_norm, p := price,
          s := completeness, w := {_W}) AS o FROM signed),
      run AS (
        SELECT part_id, seller_canonical, n, [o] AS standing, [o] AS kept FROM offer WHERE n = 1
        UNION ALL
        SELECT part_id, seller_canonical, n,
          CASE WHEN twin IS NOT NULL AND o.s > twin.s
                 THEN list_transform(standing, lambda q: CASE WHEN q.t = o.t AND q.p = o.p THEN o ELSE q END)
               WHEN twin IS NOT NULL THEN standing
               WHEN near IS NULL THEN list_append(standing, o)
               WHEN o.s > near.s THEN list_append(list_filter(standing, lambda q: q.n <> near.n), o)
               ELSE standing END,
          CASE WHEN twin IS NOT NULL AND o.s > twin.s
                 THEN list_append(list_filter(kept, lambda q: NOT (q.t = o.t AND q.p = o.p)), o)
               WHEN twin IS NOT NULL THEN kept
               WHEN near IS NULL THEN list_append(kept, o)
               WHEN o.s > near.s THEN list_append(list_filter(kept, lambda q: NOT {_alike('q', 'near')}), o)
               ELSE kept END
        FROM (SELECT x.part_id, x.seller_canonical, y.n, standing, kept, o,
                list_filter(standing, lambda q: q.t = o.t AND q.p = o.p)[1] AS twin,
                list_filter(standing, lambda q: {_alike('q', 'o')})[1] AS near
              FROM run x JOIN offer y ON y.part_id = x.part_id AND y.seller_canonical = x.seller_canonical
                AND y.n = x.n + 1)),
      ended AS (SELECT part_id, seller_canonical, unnest(arg_max(kept, n)).n AS n FROM run
                GROUP BY part_id, seller_canonical)
    SELECT signed.* FROM signed JOIN ended USING (part_id, seller_canonical, n))"""


@query("w03_full_dedupe", full_dedupe_sql(SIGNED))
def _(t):
    kept = dedupe.deduplicate(t("offers"), ORDER_KEYS)
    return kept.select(*ORDER_KEYS, "part_id", "seller_canonical", "title_norm", "price")


@query(
    "w04_first_cards_per_search",
    f"""SELECT part_id, {LINE} FROM (SELECT *, row_number() OVER (PARTITION BY part_id
        ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn
        FROM (SELECT s_name AS part_id, {LINE} FROM {{sources}})) WHERE rn <= 200""",
)
def _(t):
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    rows = t("sources").select(F.col("s_name").alias("part_id"), *KEYS, order.alias("card_ord"))
    return offers.first_cards(rows, fv.MAX_CARDS_PER_SEARCH).drop("card_ord")


@query(
    "w05_most_relevant_cards",
    f"""SELECT part_id, card_ord, relevance, relevance_rank FROM (SELECT *, row_number() OVER (PARTITION BY part_id
        ORDER BY relevance DESC, card_ord) AS relevance_rank FROM ({RELEVANT})) WHERE relevance_rank <= 20""",
)
def _(t):
    top = offers.most_relevant(scored_cards(t), fv.MAX_DRILL_DOWNS)
    return top.select("part_id", "card_ord", "relevance", c("relevance_rank").cast("bigint").alias("relevance_rank"))


@query(
    "w06_first_offer_of_part",
    f"""SELECT part_id, part_key, part_name_norm FROM (SELECT *, row_number() OVER (PARTITION BY part_id
        ORDER BY {V2_ORDER}) AS rn FROM ({PROCESSED})) WHERE rn = 1""",
)
def _(t):
    return summaries.first_of_group(
        processed(t), ["part_id"], two_stage.OFFER_ORDER, ["part_key", "part_name_norm"]
    )


@query(
    "w07_first_urls",
    f"""SELECT seller_name, array_to_string({d.first_urls('product_url', 5)}, ' ') AS urls FROM {{offers}}
        GROUP BY seller_name""",
)
def _(t):
    return _seller_urls(t).select("seller_name", F.array_join("urls", " ").alias("urls"))


def _seller_urls(t):
    """Every seller with its first urls, none included."""
    found = summaries.first_urls(t("offers"), ["seller_name"], c("product_url"), 5)
    empty = F.array().cast("array<string>")
    return t("offers").select("seller_name").distinct().join(found, "seller_name", "left").withColumn(
        "urls", F.coalesce("urls", empty)
    )


_FLAGS = ", ".join(
    f"coalesce({p}_price_toman > 0 AND abs({p}_price_toman - mean_amp) > 2 * std_amp, false) AS {p}_price_outlier"
    for p in ("median", "min", "max")
)


@query("w08_outlier_flags", f"SELECT part_id, {_FLAGS} FROM ({TWO_PARTS}), ({BOUNDS})")
def _(t):
    flagged = summaries.with_outlier_flags(two_stage_parts(t))
    return flagged.select("part_id", *[f"{p}_price_outlier" for p in ("median", "min", "max")])


@query(
    "w09_numbered_offers",
    f"""SELECT seller_name, {d.numbered('u', 'Offer')} AS validation_urls FROM (
        SELECT seller_name, {d.first_urls('product_url', 5)} AS u FROM {{offers}} GROUP BY seller_name)""",
)
def _(t):
    from marketlens.functions.urls import numbered_urls

    return _seller_urls(t).select("seller_name", numbered_urls(c("urls"), "Offer").alias("validation_urls"))


@query(
    "f10_priced_offers",
    f"""SELECT sn AS seller_name_norm, count(*) AS offers_count, count(*) FILTER (pt > 0) AS priced_count
        FROM ({TWO_PRICED}) GROUP BY sn""",
)
def _(t):
    return summaries.priced_counts(processed(t), "seller_name_norm")


@query("f11_drillable_cards", "SELECT part_id, card_ord, nullif(product_url, '') IS NOT NULL AS drillable FROM {cards}")
def _(t):
    return t("cards").select(
        "part_id", "card_ord", text.non_empty(c("product_url")).isNotNull().alias("drillable")
    )


# --- projections, sorts, set operations --------------------------------------

_RAW_V1 = f"""SELECT part_id, part_name, part_code, part_key, part_name_norm, {d.clean('title_raw')} AS title_raw,
    seller_name_norm, {d.export_toman()} AS price_toman, ({d.export_toman()}) * 10 AS price_rial, product_url,
    seller_url, {d.clean('availability')} AS availability, snapshot_ts FROM ({PREPARED})"""


def placed(df):
    """Adds `position`, counted through the sorted rows as they come out."""
    kept = materialize(df.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    before = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - c("_n")).alias("_before")
    )
    return (
        kept.withColumn("_part", part)
        .join(before, "_part")
        .withColumn("position", c("_before") + c("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_part", "_before", "_at")
    )


@query(
    "o01_positions_of_offers_single_stage",
    f"SELECT row_number() OVER (ORDER BY part_id, price_toman) AS position, part_id, price_toman FROM ({_RAW_V1})",
)
def _(t):
    """Rows that tie in the sort columns of the report are alike here."""
    df = summaries.sort_offers_single(offers.offers_raw_single(prepared(t), as_of()))
    return placed(df).select("position", "part_id", "price_toman")


@query(
    "o02_positions_of_offers_two_stage",
    f"""SELECT row_number() OVER (ORDER BY relevance DESC, price_toman, part_id) AS position, relevance, price_toman,
        part_id FROM ({_RAW_V2})""",
)
def _(t):
    df = summaries.sort_offers_two_stage(offers.offers_raw_two_stage(processed(t, two_stage.REPORT_COLUMNS), as_of()))
    return placed(df).select("position", "relevance", "price_toman", "part_id")


@query("p25_o01_offers_raw_single_stage", _RAW_V1)
def _(t):
    return summaries.sort_offers_single(offers.offers_raw_single(prepared(t), as_of()))


@query("p26_o02_offers_raw_two_stage", _RAW_V2)
def _(t):
    return summaries.sort_offers_two_stage(offers.offers_raw_two_stage(processed(t, two_stage.REPORT_COLUMNS), as_of()))


@query(
    "o03_sellers_by_offers",
    f"""SELECT row_number() OVER (ORDER BY offers_count DESC, seller_name_norm) AS position, seller_name_norm,
        offers_count FROM ({sellers_sql(TWO_PRICED, 5, True)})""",
)
def _(t):
    df = summaries.sort_sellers(summaries.sellers_summary(processed(t)))
    return placed(df).select("position", "seller_name_norm", "offers_count")


@query(
    "o04_parts_by_average_price",
    f"""SELECT row_number() OVER (ORDER BY "AMP_toman" DESC, part_id) AS position, part_id, "AMP_toman"
        FROM ({TWO_PARTS})""",
)
def _(t):
    return placed(summaries.sort_parts(two_stage_parts(t))).select("position", "part_id", "AMP_toman")


@query(
    "o05_cards_by_relevance",
    f"""SELECT row_number() OVER (ORDER BY part_id, relevance DESC, card_ord) AS position, part_id, card_ord, relevance
        FROM ({RELEVANT})""",
)
def _(t):
    ordered = scored_cards(t).select("part_id", "card_ord", "relevance").orderBy(
        "part_id", F.desc("relevance"), "card_ord"
    )
    return placed(ordered)


@query(
    "u01_union_of_offers",
    """SELECT part_id, title_raw, product_url FROM {offers}
       UNION ALL SELECT part_id, title_raw, product_url FROM {cards}""",
)
def _(t):
    columns = ["part_id", "title_raw", "product_url"]
    return t("offers").select(columns).unionByName(t("cards").select(columns))


@query("u02_distinct_sellers", f"SELECT count(DISTINCT {d.canonical('seller_name')}) AS sellers FROM {{offers}}")
def _(t):
    return t("offers").agg(F.count_distinct(sellers.canonical_seller(c("seller_name"))).alias("sellers"))


@query(
    "u03_word_overlap",
    f"""SELECT {LINE}, len(list_intersect(a, b))::INTEGER AS shared,
        len(list_distinct(list_concat(a, b)))::INTEGER AS united FROM (
        SELECT {LINE}, {d.words(d.form('title_raw'))} AS a, {d.words(d.form('keywords'))} AS b FROM {{offers}})""",
)
def _(t):
    a, b = (text.words(text.matching_form(c(n))) for n in ("title_raw", "keywords"))
    return t("offers").select(
        *KEYS, F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_union(a, b)).alias("united")
    )


# --- whole jobs --------------------------------------------------------------


ASKED = PREPARED + " AND o.part_id <> '0' AND m.part_name <> '' AND m.keywords <> ''"
_ASKED_SIGNED = f"""SELECT *, seller_name_norm AS seller_canonical, {d.title('title_raw')} AS title_norm,
    price_raw AS price, {d.score()} AS completeness FROM ({ASKED})"""
KEPT = f"SELECT a.* FROM ({ASKED}) a JOIN ({full_dedupe_sql(_ASKED_SIGNED)}) k USING ({ORDER})"
KEPT_PRICED = f"""SELECT *, {d.export_toman()} AS pt, coalesce(seller_name_norm, 'UNKNOWN_SELLER') AS sn
    FROM ({KEPT})"""


def _single(t):
    return single_stage.run(t("parts"), t("offers"), ORDER_KEYS, as_of())


def _two(t):
    return two_stage.run(t("parts"), t("cards"), t("page_offers"), as_of())


@query("q01_single_stage_offers_raw", _RAW_V1.replace(PREPARED, KEPT))
def _(t):
    return _single(t)["offers_raw"]


@query("q01_single_stage_sellers_summary", sellers_sql(KEPT_PRICED, 3, False))
def _(t):
    return _single(t)["sellers_summary"]


@query("q01_single_stage_part_summary", parts_sql(KEPT_PRICED, 3, False, ORDER))
def _(t):
    return _single(t)["part_summary"]


@query(
    "q01_single_stage_statistics",
    f"""SELECT (SELECT count(*) FROM {{parts}} WHERE part_id <> '0' AND part_name <> '' AND keywords <> '')
          AS parts_processed, (SELECT count(*) FROM {{offers}} WHERE part_id IN (SELECT part_id FROM {{parts}}
          WHERE part_id <> '0' AND part_name <> '' AND keywords <> '')) AS total_offers_found,
        count(*) AS offers_after_dedup, count(DISTINCT seller_name_norm) AS unique_sellers FROM ({KEPT})""",
)
def _(t):
    return _single(t)["statistics"]


@query("q02_two_stage_offers_raw", _RAW_V2)
def _(t):
    return _two(t)["offers_raw"]


@query("q02_two_stage_sellers_summary", sellers_sql(TWO_PRICED, 5, True))
def _(t):
    return _two(t)["sellers_summary"]


@query("q02_two_stage_part_summary", f"SELECT p.*, {_FLAGS} FROM ({TWO_PARTS}) p, ({BOUNDS})")
def _(t):
    return _two(t)["part_summary"]


@query(
    "q02_two_stage_statistics",
    TWO_STATISTICS,
)
def _(t):
    return _two(t)["statistics"].withColumn("avg_relevance", F.round("avg_relevance", 6))


@query("q05_report_audit", AUDIT)
def _(t):
    from marketlens.session import scratch_path
    from marketlens.sources.reports import write_report

    path = scratch_path(t.spark, "report")
    return audit_job.audit_report(t.spark, write_report(_two(t), path))
