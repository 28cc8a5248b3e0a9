"""Marketplace-shaped views over the given tables.

Each view is one SELECT that Spark SQL and DuckDB both accept, so the checked
query and its oracle start from the same rows.  ``{name}`` stands for a table or
another view.  Every view grows with its table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# large ones, of which each comes as a single small file
SPREAD = {"lineitem", "part", "documents", "conversations", "pages", "events"}

AS_OF = "2024-01-30 12:00:00"
BASE_URL = "https://shop.example"


def _pick(expr: str, options: list[str]) -> str:
    """CASE over ``expr`` modulo the number of options."""
    arms = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options))
    return f"CASE ({expr}) % {len(options)} {arms} END"


_TYPES = [
    "سپر جلو", "چراغ جلو", "گلگیر جلو", "کاپوت", "جلوپنجره", "headlamp", "چراغ عقب", "front bumper",
    "آینه", "مه‌شکن", "درب", "hood", "رکاب",
]
_SIDES = ["چپ", "راست", "", "left", "RH"]
_MODELS = ["تیگو 8", "تیگو ۸", "تیگو 7", "Tiggo 5", "آریزو 6", "آریزو ۵", "arrizo6", ""]
_TRIMS = ["پرو", "پرو مکس", "کلاسیک", "", "e+", "ای پلاس"]
_EXTRAS = ["", "اصل", "LED", "یدکی  OEM", "هالوژن", "زنون", "part"]

_FA_PART = (
    "concat_ws(' ', "
    + ", ".join(
        [
            _pick("p_partkey", _TYPES),
            _pick("p_size", _SIDES),
            _pick("p_partkey + p_size", _MODELS),
            _pick("p_size", _TRIMS),
        ]
    )
    + ")"
)
_FA_CARD = (
    "concat_ws(' ', "
    + ", ".join(
        [
            _pick("p_partkey + (CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END)", _TYPES),
            _pick("p_size + l_suppkey", _SIDES),
            _pick("p_partkey + p_size", _MODELS),
            _pick("p_size + l_linenumber", _TRIMS),
            _pick("l_linenumber", _EXTRAS),
        ]
    )
    + ")"
)
_PRICE = "CAST(floor(l_extendedprice * 100) AS BIGINT)"
_GROUPED = (
    f"concat(CAST(CAST(floor({_PRICE} / 1000000) AS BIGINT) AS STRING), ',', "
    f"lpad(CAST(CAST(floor({_PRICE} / 1000) AS BIGINT) % 1000 AS STRING), 3, '0'), ',', "
    f"lpad(CAST({_PRICE} % 1000 AS STRING), 3, '0'))"
)
_PERSIAN = f"translate({_GROUPED}, '0123456789', '۰۱۲۳۴۵۶۷۸۹')"
_ARABIC = f"translate({_GROUPED}, '0123456789', '٠١٢٣٤٥٦٧٨٩')"
_PRICE_TEXT = f"""CASE l_linenumber
    WHEN 1 THEN concat('قیمت:  ', {_PERSIAN}, ' تومان')
    WHEN 2 THEN concat({_ARABIC}, '.٥٠ ریال')
    WHEN 3 THEN concat('از ', CAST({_PRICE} AS STRING), ' تا ', {_GROUPED}, ' تومن')
    WHEN 4 THEN 'تماس بگیرید'
    WHEN 5 THEN concat('Price ', CAST({_PRICE} AS STRING), '.99')
    WHEN 6 THEN CASE l_quantity WHEN 50 THEN '9,999,999,999,999,999,999' WHEN 49 THEN '12345678901234567890 ریال'
        ELSE '' END
    ELSE concat({_PERSIAN}, ' ریل') END"""
_URL = f"concat('{BASE_URL}/p/', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING))"

VIEWS = {
    "texts": f"""
        SELECT concat('d', CAST(doc_id AS STRING)) AS text_id, text FROM {{documents}}
        UNION ALL
        SELECT concat('c', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)), text
        FROM {{conversations}}
        UNION ALL
        SELECT concat('l', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
                      CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)), {_PRICE_TEXT}
        FROM {{lineitem}}""",
    "sources": """
        SELECT l.*, p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, s_name, n_regionkey, r_name
        FROM {lineitem} l JOIN {part} ON l_partkey = p_partkey
        JOIN {supplier} ON l_suppkey = s_suppkey
        JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    # requested parts; a few lack a field
    "parts": f"""
        SELECT CAST(p_partkey AS STRING) AS part_id, p_partkey AS part_ord,
               CASE WHEN p_partkey % 97 = 5 THEN '' ELSE {_FA_PART} END AS part_name,
               CASE WHEN p_size % 3 = 0 THEN '' ELSE concat(p_brand, '-', substr(p_type, 1, 2)) END
                   AS part_code,
               CASE WHEN p_partkey % 89 = 7 THEN ' '
                    ELSE concat({_FA_PART}, ' ', lower(p_type)) END AS keywords
        FROM {{part}}""",
    # single-stage offers: English titles, sellers by region, prices a few percent apart
    "offers": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
               CAST(l_partkey AS STRING) AS part_id, p_name AS part_name, p_brand AS part_code,
               lower(concat(p_type, ' ', p_name)) AS keywords,
               CASE WHEN l_quantity = 3 THEN '' ELSE concat(p_name, CASE l_linenumber
                   WHEN 1 THEN ' original part' WHEN 2 THEN '  OEM' WHEN 3 THEN ' deluxe'
                   WHEN 4 THEN ' deluxe model' ELSE '' END) END AS title_raw,
               CASE WHEN l_quantity = 1 THEN 0 WHEN l_quantity = 2 THEN NULL
                    WHEN l_quantity = 6 THEN 5
                    ELSE CAST(floor(p_retailprice * 100) AS BIGINT) + (l_suppkey % 7) * 1000 END
                   AS price_raw,
               {_PRICE_TEXT} AS price_text,
               CASE l_returnflag WHEN 'A' THEN 'toman' WHEN 'R' THEN 'rial' ELSE 'unknown' END
                   AS currency_unit,
               CASE WHEN l_quantity = 4 THEN '' ELSE concat(
                   CASE WHEN l_suppkey % 4 = 0 THEN 'فروشگاه ' ELSE '' END,
                   CASE n_regionkey WHEN 0 THEN 'partcenter' WHEN 1 THEN 'یدک‌شاپ'
                       WHEN 2 THEN 'Auto Part' ELSE r_name END,
                   CASE l_suppkey % 4 WHEN 1 THEN ' Store' WHEN 2 THEN '  shop' ELSE '' END)
                   END AS seller_name,
               CASE WHEN l_quantity = 5 THEN '' ELSE {_URL} END AS product_url,
               CASE WHEN l_linestatus = 'F' THEN ''
                    ELSE concat('{BASE_URL}/shop/', CAST(l_suppkey AS STRING)) END AS seller_url,
               CASE WHEN l_quantity < 25 THEN ' in   stock ' ELSE '' END AS availability,
               l_shipdate AS snapshot_ts
        FROM {{sources}}""",
    # two-stage search cards: one search per part, Persian and English titles
    "cards": f"""
        SELECT CAST(l_partkey AS STRING) AS part_id,
               CAST(row_number() OVER (PARTITION BY l_partkey
                    ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS INT) AS card_ord,
               {_FA_CARD} AS title_raw,
               CASE WHEN l_quantity <= 2 THEN 0 ELSE {_PRICE} END AS price_raw,
               {_PRICE_TEXT} AS price_text,
               CASE l_returnflag WHEN 'A' THEN 'toman' WHEN 'R' THEN 'rial' ELSE 'unknown' END
                   AS currency_unit,
               s_name AS seller_name,
               CASE WHEN l_quantity = 5 THEN '' ELSE {_URL} END AS product_url,
               '' AS seller_url,
               CASE WHEN l_linestatus = 'F' THEN 'موجود' ELSE '' END AS availability,
               l_shipdate AS snapshot_ts
        FROM {{sources}}""",
    # offers of a third of the lines belong to pages that no card leads to
    "page_offers": f"""
        SELECT CASE WHEN l_discount > 0.04 THEN {_URL} ELSE concat({_URL}, '/old') END AS product_url,
               CAST(row_number() OVER (PARTITION BY l_partkey, l_suppkey
                    ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS INT) AS offer_pos,
               CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'فروشگاه'
                    ELSE concat('شرکت ', s_name, ' Store') END AS seller_name,
               CASE WHEN l_quantity <= 3 THEN NULL ELSE {_PRICE} + l_linenumber END AS price_raw,
               {_PRICE_TEXT} AS price_text,
               CASE l_linestatus WHEN 'F' THEN 'rial' ELSE 'toman' END AS currency_unit,
               CASE WHEN l_linenumber < 4 THEN ''
                    ELSE concat('{BASE_URL}/shop/', CAST(l_suppkey AS STRING)) END AS seller_url,
               '' AS availability
        FROM {{sources}}""",
    "snapshots": """
        SELECT CASE WHEN event_type IN ('click', 'view') THEN 'search' ELSE 'product' END
                   AS cache_type,
               concat(event_type, ':', CAST(user_id AS STRING)) AS query,
               ts AS cached_at, value
        FROM {events}""",
    "requests": """
        SELECT event_id AS request_id,
               CASE WHEN event_type IN ('click', 'view') THEN 'search' ELSE 'product' END
                   AS cache_type,
               concat(CASE WHEN event_id % 4 = 0 THEN ' ' ELSE '' END, upper(event_type), ':',
                      CAST(user_id + (event_id % 3) * 60 AS STRING)) AS query
        FROM {events}""",
    # embedded product records as a search page carries them
    "products": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CASE WHEN l_linenumber = 2 THEN '' ELSE p_name END AS name1,
               CASE WHEN l_linenumber = 2 AND l_quantity < 10 THEN '' ELSE {_FA_CARD} END AS name2,
               CASE WHEN l_quantity < 5 THEN 0 ELSE {_PRICE} END AS price,
               {_PRICE_TEXT} AS price_text,
               CASE WHEN l_quantity = 7 THEN '' WHEN l_quantity < 25 THEN {_URL}
                    ELSE concat('/p/', CAST(l_partkey AS STRING)) END AS web_client_absolute_url,
               CASE WHEN l_linenumber = 3 THEN '' ELSE concat('در  ', s_name, ' ، تهران و در اصفهان')
                   END AS shop_text,
               CASE WHEN l_linestatus = 'F' THEN 'موجود' ELSE '' END AS stock_status,
               s_name, r_name
        FROM {{sources}}""",
}

_NAME = re.compile(r"\{([a-z_]+)\}")
_RANK = re.compile(r"row_number\(\) OVER \([^()]*\)")


def spread(table: DataFrame) -> DataFrame:
    """Deals a table that is one file, hence one split, out over the cores."""
    if len(table.inputFiles()) > 1:
        return table
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism)


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(table) if name in SPREAD else table
    return spark.sql(ranked_first(VIEWS[name]), **{d: spark_view(spark, sf_dir, d) for d in set(_NAME.findall(VIEWS[name]))})


def ranked_first(sql: str) -> str:
    """The same view, its row numbers given before its texts are made.

    Spark computes what stands beside a window below it, so that all texts would be
    shuffled and sorted with the rows.
    """
    if not (rank := _RANK.search(sql)):
        return sql
    return _NAME.sub(rf"(SELECT *, {rank[0]} AS _rank FROM {{\1}})", _RANK.sub("_rank", sql))


def duckdb_sql(sql: str) -> str:
    """Oracle text with every view it needs as a common table expression."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for dep in _NAME.findall(VIEWS[name]):
                visit(dep)
            order.append(name)

    for name in _NAME.findall(sql):
        visit(name)
    plain = lambda s: _NAME.sub(r"\1", s).strip()
    ctes = [f"{n} AS ({plain(VIEWS[n])})" for n in order]
    body = plain(sql)
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes + [body[5:]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
