"""Sources, sinks and page jobs (S, K, Q3..Q4 rows, F3, F4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import urls
from marketlens.operators import snapshots
from marketlens.plans import refresh
from marketlens.session import scratch_path
from marketlens.sources import pages, parts as parts_source, reports, snapshots as snapshot_source
from queries import duck as d
from queries.registry import query
from queries.relations import (
    _RAW_V2, FRESH, KEYED, LATEST, REQUESTED, TWO_PARTS, TWO_PRICED, _two, as_of, known_snapshots, sellers_sql,
)
from queries.views import AS_OF, BASE_URL

c = F.col
LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
KEYS = LINE.split(", ")
ROW_URL = ("concat('u/', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '/', "
           "CAST(l_partkey AS STRING), '/', CAST(l_suppkey AS STRING))")

# --- parts files -------------------------------------------------------------

_RAW_PARTS = """SELECT part_ord, CASE WHEN part_ord % 50 = 3 THEN concat('x', part_id) ELSE part_id END AS part_id,
    concat('  ', part_name) AS part_name, part_code, concat(keywords, ' ') AS keywords FROM ({parts})"""


def _write_parts(t) -> str:
    """CSV files whose names follow the order of their rows."""
    path = scratch_path(t.spark, "parts-csv")
    rows = t.spark.sql(_RAW_PARTS.replace("({parts})", "{parts}"), parts=t("parts"))
    rows = rows.repartitionByRange(4, "part_ord").sortWithinPartitions("part_ord").drop("part_ord")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return path


_TRIMMED = f"""SELECT *, {d.strip('part_name')} AS n, {d.strip('keywords')} AS k,
    try_cast(part_id AS BIGINT) AS i, row_number() OVER (ORDER BY part_ord) AS r
    FROM ({_RAW_PARTS.replace('({parts})', '{parts}')})"""


@query(
    "s01_parts_csv",
    f"""SELECT CAST(i AS VARCHAR) AS part_id, r - 1 AS part_ord, n AS part_name, part_code, k AS keywords
        FROM ({_TRIMMED}) WHERE i <> 0 AND n <> '' AND k <> ''""",
)
def _(t):
    return parts_source.read_parts(t.spark, _write_parts(t))[0]


@query(
    "s01_parts_csv_rejected",
    f"""SELECT CAST(i AS VARCHAR) AS part_id, r - 1 AS part_ord, n AS part_name
        FROM ({_TRIMMED}) WHERE NOT coalesce(i <> 0 AND n <> '' AND k <> '', false)""",
)
def _(t):
    return parts_source.read_parts(t.spark, _write_parts(t))[1].select("part_id", "part_ord", "part_name")


@query(
    "s04_parts_in_memory",
    """SELECT r.part_id, part_ord, r.part_name, p_name FROM (VALUES ('1', 0, 'bumper'), ('3', 1, 'hood'), ('77', 2, ''))
       r(part_id, part_ord, part_name) JOIN {part} p ON r.part_id = CAST(p_partkey AS STRING)""",
)
def _(t):
    """A few requests held in memory, joined to the given parts."""
    rows = [
        {"part_id": 1, "part_name": "bumper", "keywords": "front bumper"},
        {"part_id": "3", "part_name": "hood", "part_code": "h"},
        {"part_id": 77},
    ]
    asked = parts_source.parts_from_rows(t.spark, rows)
    known = t("part").select(c("p_partkey").cast("string").alias("part_id"), "p_name")
    return asked.join(known, "part_id").select("part_id", "part_ord", "part_name", "p_name")


@query("s02_csv_contract", "SELECT 'keywords' AS missing, count(*) > 0 AS has_rows FROM {parts}")
def _(t):
    """A file without its keywords column is reported as such."""
    raw = parts_source.scan_csv(t.spark, _write_parts(t))
    cut = raw.drop("keywords")
    missing = ",".join(parts_source.missing_columns(cut))
    return raw.agg((F.count(F.lit(1)) > 0).alias("has_rows")).select(
        F.lit(missing).alias("missing"), "has_rows"
    )


@query(
    "s03_parts_csv_lenient",
    f"""SELECT 'part_' || r || '_run1' AS part_id, r - 1 AS part_ord, n AS part_name, part_code,
        CASE WHEN k = '' THEN n || ' automotive part' ELSE k END AS keywords FROM ({_TRIMMED})""",
)
def _(t):
    return parts_source.read_parts_lenient(t.spark, _write_parts(t), "run1")


# --- search pages ------------------------------------------------------------

# Each line becomes one archived search page with two products: as embedded
# JSON, or (linenumber 7) as markup only, or (linenumber 6) as an empty result.
_CARD_MARKUP = f"""concat('<div class="grid"><div class="cell"><a class="t" href="', web_client_absolute_url,
    '">  ', name2, ' &amp; co</a><span class="price-box">', price_text, '</span><div class="seller-name"> ',
    CASE WHEN l_suppkey % 2 = 0 THEN 'Shop  A' ELSE 'Shop 7' END,
    '<a href="/shop/', CAST(l_suppkey AS STRING), '"></a></div><p class="stock-status">', stock_status,
    '<p>more</div></div>')"""


def _search_pages(t):
    # field names as they appear in the document, empty values included
    record = F.struct(
        "name1", "name2", "price", "price_text", "web_client_absolute_url", "shop_text", "stock_status"
    )
    second = F.struct(
        F.lit("").alias("name1"), F.lit("").alias("name2"), F.col("price"), F.col("price_text"),
        F.lit("").alias("web_client_absolute_url"), F.col("shop_text"), F.col("stock_status"),
    )
    document = F.to_json(
        F.struct(F.struct(F.struct(F.array(record, second).alias("products")).alias("pageProps")).alias("props"))
    )
    embedded = F.concat(
        F.lit('<html><head><script src="a.js"></script><script id="__NEXT_DATA__" type="application/json">'),
        document, F.lit("</script></head><body></body></html>"),
    )
    markup = F.concat(
        F.lit("<html><body>"),
        F.when(c("l_linenumber") == 6, F.lit('<div class="no-results big">-</div>')).otherwise(F.lit("")),
        F.expr(_CARD_MARKUP), F.lit("</body></html>"),
    )
    return t("products").select(
        *KEYS,
        c("l_orderkey").alias("page_id"),
        F.expr(ROW_URL).alias("url"),
        F.when(c("l_linenumber") < 6, embedded).otherwise(markup).alias("html"),
    )


_JSON_CARDS = f"""SELECT {ROW_URL} AS url, 0 AS card_ord, coalesce(nullif(name1, ''), nullif(name2, ''), '') AS title_raw,
      price AS price_raw, price_text, {d.currency('price_text')} AS currency_unit,
      trim(regexp_extract(shop_text, 'در\\s+([^،]+)', 1)) AS seller_name,
      {d.absolute('web_client_absolute_url', BASE_URL)} AS product_url, '' AS seller_url,
      stock_status AS availability FROM {{products}} WHERE l_linenumber < 6
    UNION ALL
    SELECT {ROW_URL}, 1, '', price, price_text, {d.currency('price_text')},
      trim(regexp_extract(shop_text, 'در\\s+([^،]+)', 1)), '', '', stock_status
    FROM {{products}} WHERE l_linenumber < 6"""
_OK = "regexp_matches(price_text, 'تومان|ریال|[،.0-9]')"
_TITLE = "name2 || ' & co'"
_MARKUP_CARDS = f"""SELECT {ROW_URL} AS url, 0 AS card_ord, {d.clean(_TITLE)} AS title_raw,
      CASE WHEN {_OK} THEN {d.price('price_text')} END AS price_raw,
      CASE WHEN {_OK} THEN {d.clean('price_text')} ELSE price_text END AS price_text,
      CASE WHEN {_OK} THEN {d.currency('price_text')} ELSE 'unknown' END AS currency_unit,
      CASE WHEN l_suppkey % 2 = 0 THEN 'Shop A' WHEN NOT {_OK} THEN {d.clean('price_text')} ELSE '' END AS seller_name,
      {d.absolute('web_client_absolute_url', BASE_URL)} AS product_url,
      CASE WHEN l_suppkey % 2 = 0 THEN '{BASE_URL}/shop/' || l_suppkey ELSE '' END AS seller_url,
      stock_status AS availability FROM {{products}}"""
_KEEP = "title_raw <> '' OR coalesce(price_raw, 0) > 0"
_CARDS = ["url", "card_ord", *pages.CARD_FIELDS]


@query("s05_cards_from_embedded_json", f"SELECT * FROM ({_JSON_CARDS}) WHERE {_KEEP}")
def _(t):
    return pages.cards_from_json(_search_pages(t), BASE_URL).select(_CARDS)


@query(
    "s06_cards_from_markup",
    f"SELECT * FROM ({_MARKUP_CARDS} WHERE l_linenumber = 7 AND web_client_absolute_url <> '') WHERE {_KEEP}",
)
def _(t):
    """All pages: those with embedded records have no links in their markup."""
    return pages.cards_from_markup(_search_pages(t), BASE_URL).select(_CARDS)


_LINKS = f"""SELECT page_id, url, CAST(unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">')))) AS INTEGER) AS card_ord,
    replace(unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)), '&amp;', '&') AS href,
    replace(unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)), '&amp;', '&') AS txt FROM {{pages}}"""


@query(
    "s06_links_of_given_pages",
    f"""SELECT page_id, url, card_ord, {d.clean('txt')} AS title_raw, CAST(NULL AS BIGINT) AS price_raw,
        '' AS price_text, 'unknown' AS currency_unit, '' AS seller_name, {d.absolute('href', BASE_URL)} AS product_url,
        '' AS seller_url, '' AS availability FROM ({_LINKS}) WHERE length({d.strip('txt')}) > 5""",
)
def _(t):
    """The given pages hold no product links; any link stands in for one."""
    return pages.cards_from_markup(t("pages"), BASE_URL, "/").select("page_id", *_CARDS)


@query(
    "f03_kept_cards",
    f"""SELECT * FROM ({_JSON_CARDS}) WHERE {_KEEP} UNION ALL
        SELECT * FROM ({_MARKUP_CARDS} WHERE l_linenumber = 7 AND web_client_absolute_url <> '') WHERE {_KEEP}""",
)
def _(t):
    return pages.search_cards(_search_pages(t), BASE_URL).select(_CARDS)


# --- product pages -----------------------------------------------------------


def _product_pages(t):
    """One page per line with two offers; linenumber 5 uses another layout."""
    first = F.concat(
        F.lit('<li class="offer-card"><span class="shop-name"> '),
        F.expr("CASE WHEN l_linenumber = 1 THEN '' ELSE concat(s_name, '  Co') END"),
        F.lit(' </span><b class="price">'), c("price_text"), F.lit('</b><a href="/shop/'),
        c("l_suppkey").cast("string"), F.lit('">go</a>'),
    )
    second = F.concat(
        F.lit('<li class="offer-card"><b class="unit-cost">'), c("price_text"),
        F.lit('</b><a href="/about">about</a>'),
    )
    other = F.concat(
        F.lit('<div class="my-offers"><i class="shop">'), c("r_name"), F.lit("</i></div>")
    )
    return t("products").select(
        F.expr(ROW_URL).alias("url"),
        F.when(c("l_linenumber") == 5, F.concat(F.lit("<html><body>"), other, F.lit("</body></html>")))
        .otherwise(F.concat(F.lit("<html><body><ul>"), first, second, F.lit("</ul></body></html>")))
        .alias("html"),
    )


_HAS = f"{d.strip('price_text')} <> ''"
_PAGE_PRICE = f"""CASE WHEN {_HAS} THEN {d.price('price_text')} END AS price_raw,
    CASE WHEN {_HAS} THEN {d.clean('price_text')} ELSE price_text END AS price_text,
    CASE WHEN {_HAS} THEN {d.currency('price_text')} ELSE 'unknown' END AS currency_unit"""
_PAGE_OFFERS = f"""SELECT * FROM (
    SELECT {ROW_URL} AS product_url, 0 AS offer_pos,
      CASE WHEN l_linenumber = 1 THEN '' ELSE s_name || ' Co' END AS seller_name, {_PAGE_PRICE},
      '{BASE_URL}/shop/' || l_suppkey AS seller_url, '' AS availability FROM {{products}} WHERE l_linenumber <> 5
    UNION ALL SELECT {ROW_URL}, 1, '', {_PAGE_PRICE}, '', '' FROM {{products}} WHERE l_linenumber <> 5
    UNION ALL SELECT {ROW_URL}, 0, r_name, NULL, '', 'unknown', '', '' FROM {{products}} WHERE l_linenumber = 5)
    WHERE seller_name <> '' OR coalesce(price_raw, 0) > 0"""


@query("s07_f04_product_page_offers", _PAGE_OFFERS)
def _(t):
    return pages.page_offers(_product_pages(t), BASE_URL)


@query(
    "q03_offers_for_parts",
    f"""SELECT part_id, part_name, part_code, p.keywords, title_raw, price_raw, price_text, currency_unit,
        seller_name, product_url, '' AS seller_url, availability, TIMESTAMP '{AS_OF}' AS snapshot_ts
        FROM (SELECT part_id, part_name, part_code, keywords || ' ' || part_id AS keywords FROM {{parts}}) p
        JOIN ({_JSON_CARDS.replace(ROW_URL, "CAST(l_partkey AS STRING)")} UNION ALL
          {_MARKUP_CARDS.replace(ROW_URL, "CAST(l_partkey AS STRING)")}
          WHERE l_linenumber = 7 AND web_client_absolute_url <> '') q ON q.url = p.part_id WHERE {_KEEP}""",
)
def _(t):
    wanted = t("parts").withColumn("keywords", F.concat_ws(" ", "keywords", "part_id"))
    address = wanted.select(
        c("part_ord").alias("l_partkey"), urls.search_url(c("keywords"), BASE_URL).alias("address")
    )
    found = (
        _search_pages(t).join(address, "l_partkey")
        .select("page_id", c("address").alias("url"), "html")
    )
    return pages.offers_for_parts(wanted, found, BASE_URL, as_of()).drop("card_ord", "part_ord")


# --- snapshots ---------------------------------------------------------------


def _documents(t):
    """Snapshot documents with one card each."""
    stamped = t("snapshots").withColumn("cached_at", c("cached_at").cast("timestamp"))
    card = F.struct(
        c("query").alias("title_raw"), F.floor("value").cast("bigint").alias("price_raw"),
        F.lit("").alias("price_text"), F.lit("toman").alias("currency_unit"),
        F.lit("").alias("seller_name"), F.lit("").alias("product_url"),
        F.lit("").alias("seller_url"), F.lit("").alias("availability"),
        c("cached_at").alias("snapshot_ts"),
    )
    return stamped.withColumn("data", F.array(card))


@query(
    "s08_snapshot_documents",
    "SELECT cache_key, query, cached_at, CAST(floor(value) AS BIGINT) AS price "
    f"FROM ({KEYED}) WHERE CAST(floor(value) AS BIGINT) % 10 <> 3",
)
def _(t):
    """Documents written as JSON, one a line, some cut short: those come out as broken."""
    path = scratch_path(t.spark, "snapshots-json")
    whole = F.to_json(
        F.struct("cached_at", "cache_type", "query", "data"),
        {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
    )
    cut = F.expr("CAST(floor(value) AS BIGINT) % 10 = 3")
    _documents(t).select(
        F.when(cut, F.left(whole, F.length(whole) - 7)).otherwise(whole).alias("value")
    ).write.text(path)
    read, broken = snapshot_source.read_snapshots(t.spark, path, multi_line=False)
    return read.select(
        "cache_key", "query", "cached_at", F.element_at("data", 1)["price_raw"].alias("price")
    )


@query(
    "k01_snapshot_table",
    f"SELECT cache_key, cached_at, CAST(floor(value) AS BIGINT) AS price FROM ({LATEST})",
)
def _(t):
    """Appended results, each under its own stamp, read back as the latest per key."""
    path = scratch_path(t.spark, "snapshots")
    docs = _documents(t)
    snapshot_source.write_snapshots(docs, path, c("cached_at"))
    table = snapshots.latest(snapshot_source.read_snapshot_table(t.spark, path))
    return table.select("cache_key", "cached_at", F.element_at("data", 1)["price_raw"].alias("price"))


@query(
    "k01_snapshot_table_compacted",
    f"SELECT cache_key, cached_at, CAST(floor(value) AS BIGINT) AS price FROM ({LATEST})",
)
def _(t):
    """Three batches, the first two merged one after the other, the last read as it was added."""
    path = scratch_path(t.spark, "snapshots")
    docs = _documents(t)
    third = F.pmod(F.xxhash64("query", "cached_at"), F.lit(3))
    for batch in range(3):
        snapshot_source.write_snapshots(docs.where(third == batch), path, c("cached_at"))
        if batch < 2:
            snapshot_source.compact_snapshots(t.spark, path, buckets=8)
    table = snapshots.latest(snapshot_source.read_snapshot_table(t.spark, path))
    return table.select("cache_key", "cached_at", F.element_at("data", 1)["price_raw"].alias("price"))


@query(
    "q04_refresh_plan",
    f"""SELECT request_id, CASE WHEN cache_key IN (SELECT cache_key FROM ({FRESH})) THEN 'reuse' ELSE 'fetch' END
        AS action FROM ({REQUESTED})""",
)
def _(t):
    plan = refresh.plan(t("requests"), known_snapshots(t), as_of())
    return (
        plan["reuse"].select("request_id", F.lit("reuse").alias("action"))
        .unionByName(plan["fetch"].select("request_id", F.lit("fetch").alias("action")))
    )


# --- reports -----------------------------------------------------------------


def _report(t):
    path = reports.write_report(_two(t), scratch_path(t.spark, "report"))
    return reports.read_report(t.spark, path)


@query("k02_s09_report_tables", TWO_PARTS)
def _(t):
    flags = [f"{p}_price_outlier" for p in ("median", "min", "max")]
    return _report(t)["part_summary"].drop(*flags)


@query("k02_s09_report_offers", _RAW_V2)
def _(t):
    return _report(t)["offers_raw"]


@query("k02_s09_report_sellers", sellers_sql(TWO_PRICED, 5, True))
def _(t):
    return _report(t)["sellers_summary"]
