"""Scalar rules over whole tables (P, F and C rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import classify, fixed_values as fv, relevance, text, urls
from marketlens.operators import offers, parts, sellers, similarity
from queries import duck as d
from queries.registry import query
from queries.views import AS_OF, BASE_URL

c = F.col


def _over_texts(name: str, expr, sql: str) -> None:
    @query(name, f"SELECT text_id, {sql} AS result FROM {{texts}}")
    def _(t):
        return t("texts").select("text_id", expr(c("text")).alias("result"))


_over_texts("p01_normalize_digits", text.normalize_digits, d.digits("text"))
_over_texts("p02_clean_whitespace", text.clean_whitespace, d.clean("text"))
_over_texts("p03_extract_price", text.extract_price, d.price("text"))
_over_texts("p04_normalize_seller_name", text.normalize_seller_name, d.seller("text"))
_over_texts("p05_normalize_part_title", text.normalize_part_title, d.title("text"))
_over_texts("p08_detect_currency", text.detect_currency_unit, d.currency("text"))
_over_texts("p11_matching_form", text.matching_form, d.form("text"))
_over_texts("f05_looks_like_price", text.looks_like_price,
            "coalesce(regexp_matches(text, 'تومان|ریال|[،.0-9]'), false)")
_over_texts("u03_word_set_size", lambda x: F.size(text.words(text.matching_form(x))).cast("bigint"),
            f"CAST(len({d.words(d.form('text'))}) AS BIGINT)")
_over_texts("f06_negative_categories",
            lambda x: F.array_join(relevance.negative_categories(x), ","),
            d.categories(d.form("text"), fv.NEGATIVE_PATTERNS))
_over_texts("f07_positive_categories",
            lambda x: F.array_join(relevance.positive_categories(x), ","),
            d.categories(d.form("text"), fv.POSITIVE_PATTERNS))

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_KEYS = _LINE.split(", ")
_AMOUNT = "CAST(floor(l_extendedprice) AS BIGINT) - 50000"


def _over_amounts(name: str, expr, sql: str) -> None:
    @query(name, f"SELECT {_LINE}, {sql} AS result FROM (SELECT *, {_AMOUNT} AS n FROM {{lineitem}})")
    def _(t):
        rows = t("lineitem").withColumn("n", F.expr(_AMOUNT))
        return rows.select(*_KEYS, expr(c("n")).alias("result"))


_over_amounts("p06_rial_to_toman", text.rial_to_toman, "CAST(floor(n / 10.0) AS BIGINT)")
_over_amounts("p07_toman_to_rial", text.toman_to_rial, "n * 10")
_over_amounts("p10_format_price_toman", lambda n: text.format_price(n, "toman"),
              "format('{:,}', n) || ' تومان'")
_over_amounts("p10_format_price_rial", lambda n: text.format_price(F.when(n > 0, n), "rial"),
              "CASE WHEN n > 0 THEN format('{:,}', n) || ' ریال' ELSE '' END")


@query(
    "p09_default_keywords",
    f"""SELECT part_id, CASE WHEN {d.strip("coalesce(keywords, '')")} = ''
        THEN {d.strip("part_name")} || ' automotive part' ELSE {d.strip("keywords")} END AS keywords
        FROM {{parts}}""",
)
def _(t):
    return parts.with_default_keywords(t("parts")).select("part_id", "keywords")


@query(
    "p12_analysis_text",
    f"""SELECT part_id, {d.clean(d.digits("concat_ws(' ', part_name, nullif(part_code, ''))"))} AS result
        FROM {{parts}}""",
)
def _(t):
    return t("parts").select("part_id", text.analysis_text(c("part_name"), c("part_code")).alias("result"))


@query(
    "p13_search_url",
    f"""SELECT part_id, CASE WHEN {d.strip('keywords')} <> '' THEN '{BASE_URL}/search/?query='
        || replace(url_encode({d.strip('keywords')}), '%2F', '/') END AS url FROM {{parts}}""",
)
def _(t):
    return t("parts").select("part_id", urls.search_url(c("keywords"), BASE_URL).alias("url"))


@query(
    "p14_absolute_url",
    f"SELECT {_LINE}, {d.absolute('web_client_absolute_url', BASE_URL)} AS url FROM {{products}}",
)
def _(t):
    return t("products").select(
        *_KEYS, urls.absolute_url(c("web_client_absolute_url"), BASE_URL).alias("url")
    )


@query(
    "p15_card_title",
    f"SELECT {_LINE}, coalesce(nullif(name1, ''), nullif(name2, ''), '') AS title FROM {{products}}",
)
def _(t):
    return t("products").select(*_KEYS, urls.card_title(c("name1"), c("name2")).alias("title"))


@query(
    "p16_card_price",
    f"SELECT {_LINE}, CASE WHEN price > 0 THEN price ELSE 0 END AS price FROM {{products}}",
)
def _(t):
    return t("products").select(*_KEYS, urls.card_price(c("price")).alias("price"))


@query(
    "p17_seller_from_shop_text",
    f"""SELECT {_LINE}, trim(regexp_extract(shop_text, 'در\\s+([^،]+)', 1)) AS seller
        FROM {{products}}""",
)
def _(t):
    return t("products").select(*_KEYS, urls.seller_from_shop_text(c("shop_text")).alias("seller"))


@query("p18_canonical_seller", f"SELECT {_LINE}, {d.canonical('seller_name')} AS seller FROM {{offers}}")
def _(t):
    return t("offers").select(*_KEYS, sellers.canonical_seller(c("seller_name")).alias("seller"))


@query(
    "p19_snapshot_key",
    "SELECT request_id, cache_type || '_' || md5(lower(trim(query))) AS cache_key FROM {requests}",
)
def _(t):
    return t("requests").select(
        "request_id", urls.snapshot_key(c("cache_type"), c("query")).alias("cache_key")
    )


_SIGNED = f"""SELECT *, {d.canonical('seller_name')} AS seller_canonical, {d.title('title_raw')} AS title_norm,
    coalesce(price_raw, 0) AS price, {d.score()} AS completeness FROM {{offers}}"""


@query(
    "p20_offer_signature",
    f"""SELECT {_LINE}, md5(part_id || ':' || seller_canonical || ':' || title_norm || ':' || price)
        AS signature FROM ({_SIGNED})""",
)
def _(t):
    return similarity.with_signature(t("offers")).select(
        *_KEYS, similarity.signature_md5().alias("signature")
    )


@query("p21_completeness_score", f"SELECT {_LINE}, CAST({d.score()} AS INTEGER) AS score FROM {{offers}}")
def _(t):
    return t("offers").select(*_KEYS, similarity.completeness_score().alias("score"))


@query(
    "p22_toman_only",
    f"""SELECT {_LINE}, CASE WHEN currency_unit = 'rial' THEN price_raw // 10 ELSE price_raw END AS price_raw,
        CASE WHEN currency_unit = 'rial' THEN 'toman' ELSE currency_unit END AS currency_unit
        FROM {{offers}} WHERE price_raw > 0""",
)
def _(t):
    return offers.toman_only(t("offers")).select(*_KEYS, "price_raw", "currency_unit")


@query(
    "p23_dual_prices",
    f"""SELECT {_LINE}, CASE WHEN currency_unit = 'rial' AND p > 0 THEN p // 10 ELSE p END AS price_toman,
        CASE WHEN currency_unit = 'rial' AND p > 0 THEN p WHEN p > 0 THEN p * 10 ELSE 0 END AS price_rial,
        CASE WHEN p <= 0 THEN 1 ELSE 0 END AS price_missing
        FROM (SELECT *, coalesce(price_raw, 0) AS p FROM {{offers}})""",
)
def _(t):
    return offers.with_dual_prices(t("offers")).select(
        *_KEYS, "price_toman", "price_rial", "price_missing"
    )


@query(
    "p24_normalize_offers",
    f"""SELECT {_LINE}, {d.canonical('seller_name')} AS seller_name_norm, {d.title('title_raw')} AS title_norm,
        {d.clean('title_raw')} AS title_raw, {d.clean('availability')} AS availability FROM {{offers}}""",
)
def _(t):
    from marketlens.operators.dedupe import normalize_offers

    return normalize_offers(t("offers")).select(
        *_KEYS, "seller_name_norm", "title_norm", "title_raw", "availability"
    )


@query(
    "p27_validation_text",
    f"SELECT {_LINE}, {d.validation('product_url', 'seller_url')} AS validation_urls FROM {{offers}}",
)
def _(t):
    return t("offers").select(
        *_KEYS, urls.validation_text(c("product_url"), c("seller_url")).alias("validation_urls")
    )


@query(
    "p28_snapshot_stamp",
    f"SELECT part_id, card_ord, query, TIMESTAMP '{AS_OF}' AS snapshot_ts "
    "FROM (SELECT c.part_id, card_ord, keywords AS query FROM {cards} c JOIN {parts} p ON c.part_id = p.part_id)",
)
def _(t):
    stamped = offers.attach_request(t("cards"), t("parts"), F.lit(AS_OF).cast("timestamp"))
    return stamped.select("part_id", "card_ord", "query", "snapshot_ts")


# --- filters -----------------------------------------------------------------


@query(
    "f01_complete_parts",
    "SELECT part_id, part_name FROM {parts} "
    "WHERE part_id <> '0' AND part_name <> '' AND keywords <> ''",
)
def _(t):
    return parts.complete_parts(t("parts")).select("part_id", "part_name")


@query(
    "f02_field_validity",
    f"""SELECT part_id, length({d.strip('part_name')}) >= 2 AS valid_name,
        part_code = '' OR length({d.strip('part_code')}) >= 2 AS valid_code,
        length({d.strip('keywords')}) >= 2 AS valid_keywords FROM {{parts}}""",
)
def _(t):
    return parts.with_field_checks(t("parts")).select(
        "part_id", "valid_name", "valid_code", "valid_keywords"
    )


@query("f12_named_parts", f"SELECT part_id FROM {{parts}} WHERE {d.strip('part_name')} <> ''")
def _(t):
    return parts.named_parts(t("parts")).select("part_id")


# --- classification ----------------------------------------------------------

_TEXT = d.clean(d.digits("concat_ws(' ', part_name, nullif(part_code, ''))"))
_FEATURES = f"""SELECT *, {", ".join(
    f"CASE WHEN part_name = '' THEN 'UNKNOWN' ELSE {d.first_match('lower(txt)', lexicon)} END AS {name}"
    for name, lexicon in classify.PART_LEXICONS.items())}
    FROM (SELECT *, {_TEXT} AS txt FROM {{parts}})"""
PART_META = f"""SELECT part_id, part_ord, part_name, part_code, keywords,
    car_model, part_type, side, variant, "trim",
    concat_ws(':', 'BODY', part_type,
        coalesce(nullif(concat_ws(':', {d.known('side')}, {d.known('variant')}), ''), 'UNKNOWN'), "trim")
        AS part_key,
    CASE WHEN part_name = '' THEN '' ELSE coalesce(nullif(concat_ws(' ',
        {d.display('car_model', fv.CAR_MODEL_TERMS)}, {d.display('part_type', fv.PART_TYPE_TERMS)},
        {d.known('side')}, {d.display('"trim"', fv.TRIM_TERMS)}, {d.known('variant')}), ''), txt) END
        AS part_name_norm
    FROM ({_FEATURES.replace('AS trim', 'AS "trim"')})"""
_META = ["car_model", "part_type", "side", "variant", "trim"]


@query(
    "c01_first_match_lexicon",
    f"""SELECT text_id, {d.first_match(d.form('text'), fv.PART_TYPE_TERMS)} AS part_type FROM {{texts}}""",
)
def _(t):
    rows = t("texts").withColumn("form", text.matching_form(c("text")))
    return rows.select("text_id", classify.first_match(c("form"), fv.PART_TYPE_TERMS).alias("part_type"))


@query("c02_part_features", f'SELECT part_id, car_model, part_type, side, variant, "trim" FROM ({PART_META})')
def _(t):
    return parts.with_metadata(t("parts")).select("part_id", *_META)


@query("c03_part_key", f"SELECT part_id, part_key FROM ({PART_META})")
def _(t):
    return parts.with_metadata(t("parts")).select("part_id", "part_key")


@query("c04_part_display_name", f"SELECT part_id, part_name_norm FROM ({PART_META})")
def _(t):
    return parts.with_metadata(t("parts")).select("part_id", "part_name_norm")


@query(
    "c05_part_metadata",
    f'SELECT part_id, part_key, part_name_norm, car_model, part_type, side, variant, "trim" FROM ({PART_META})',
)
def _(t):
    return parts.with_metadata(t("parts")).select("part_id", *offers.PART_METADATA)


_ISSUES = f"""SELECT part_id, list_filter([
    CASE WHEN part_type = 'UNKNOWN' THEN {d.q(fv.ISSUE_TEXT['part_type'])} END,
    CASE WHEN car_model = 'UNKNOWN' THEN {d.q(fv.ISSUE_TEXT['car_model'])} END,
    CASE WHEN side = 'UNKNOWN' AND part_type IN ('HEADLAMP', 'FENDER', 'MIRROR')
         THEN {d.q(fv.ISSUE_TEXT['side'])} END,
    CASE WHEN "trim" = 'UNKNOWN' THEN {d.q(fv.ISSUE_TEXT['trim'])} END], lambda i: i IS NOT NULL) AS issues
    FROM ({PART_META})"""


@query(
    "c06_extraction_check",
    f"SELECT part_id, array_to_string(issues, '; ') AS issues, len(issues) <= 2 AS extraction_valid FROM ({_ISSUES})",
)
def _(t):
    checked = parts.with_extraction_check(parts.with_metadata(t("parts")))
    return checked.select("part_id", F.array_join("issues", "; ").alias("issues"), "extraction_valid")


_ATTRS = ", ".join(
    f"{d.last_match('form', lexicon)} AS {name if name != 'trim' else '\"trim\"'}"
    for name, lexicon in classify.TITLE_LEXICONS.items()
)


@query(
    "c07_title_attributes",
    f"""SELECT part_id, card_ord, {_ATTRS} FROM (SELECT *, {d.form('title_raw')} AS form FROM {{cards}})""",
)
def _(t):
    rows = t("cards").withColumn("form", text.matching_form(c("title_raw")))
    a = classify.title_attributes(c("form"))
    return rows.select("part_id", "card_ord", *[x.alias(n) for n, x in a.items()])


def _alternation(lexicon: dict) -> str:
    return d.q("|".join(p for group in lexicon.values() for p in group))


# Cards of all parts with their request, scored; `accepted` says whether the filter lets them pass.
SCORED = f"""SELECT *, least(CAST(0.0 AS DOUBLE)
      + CASE WHEN part_type <> 'UNKNOWN' THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
      + CASE WHEN car_model <> 'UNKNOWN' THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
      + CASE WHEN side <> 'UNKNOWN' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
      + CASE WHEN "trim" <> 'UNKNOWN' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
      + CASE WHEN tech <> 'UNKNOWN' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
      + CASE WHEN len(qw) > 0 THEN CAST(len(list_intersect(tw, qw)) AS DOUBLE) / CAST(len(qw) AS DOUBLE)
             * CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, CAST(1 AS DOUBLE)) AS relevance,
    concat_ws(':', 'BODY', part_type, side, tech, "trim") AS part_key,
    coalesce(nullif(concat_ws(' ', {d.display('car_model', fv.CAR_MODEL_PATTERNS)},
        {d.display('part_type', fv.POSITIVE_PATTERNS)}, {d.known('side')},
        {d.display('"trim"', fv.TRIM_PATTERNS)}, {d.known('tech')}), ''), title_raw) AS part_name_norm
    FROM (SELECT *, NOT regexp_matches(form, {_alternation(fv.NEGATIVE_PATTERNS)})
        AND regexp_matches(form, {_alternation(fv.POSITIVE_PATTERNS)}) AS accepted, {_ATTRS}, {d.words('form')} AS tw, {d.words(d.form('query'))} AS qw
      FROM (SELECT c.* EXCLUDE (snapshot_ts), TIMESTAMP '{AS_OF}' AS snapshot_ts, part_ord, part_name, part_code,
                   keywords AS query, {d.form('title_raw')} AS form
            FROM {{cards}} c JOIN {{parts}} p ON c.part_id = p.part_id))"""
RELEVANT = f"SELECT * EXCLUDE (accepted) FROM ({SCORED}) WHERE accepted"


def scored_cards(t):
    as_of = F.lit(AS_OF).cast("timestamp")
    return offers.keep_relevant(offers.attach_request(t("cards"), t("parts"), as_of))


@query("c08_relevance_score", f"SELECT part_id, card_ord, relevance FROM ({RELEVANT})")
def _(t):
    return scored_cards(t).select("part_id", "card_ord", "relevance")


@query("c09_title_part_key", f"SELECT part_id, card_ord, part_key FROM ({RELEVANT})")
def _(t):
    return scored_cards(t).select("part_id", "card_ord", "part_key")


@query("c10_title_display_name", f"SELECT part_id, card_ord, part_name_norm FROM ({RELEVANT})")
def _(t):
    return scored_cards(t).select("part_id", "card_ord", "part_name_norm")


@query(
    "c11_filter_and_score_row",
    f"""SELECT part_id, card_ord, accepted AND relevance >= CAST(0.3 AS DOUBLE) AS kept,
        CASE WHEN accepted THEN relevance ELSE 0.0 END AS relevance FROM ({SCORED})""",
)
def _(t):
    rows = offers.attach_request(t("cards"), t("parts"))
    return offers.score_rows(rows).select("part_id", "card_ord", "kept", "relevance")


@query(
    "c12_filter_search_results",
    f"""SELECT part_id, card_ord, query, relevance, part_key, part_name_norm,
        concat_ws(',', car_model, part_type, side, "trim", tech) AS attributes FROM ({RELEVANT})""",
)
def _(t):
    kept = scored_cards(t)
    attrs = F.concat_ws(",", *[c(f"attributes.{n}") for n in classify.TITLE_LEXICONS])
    return kept.select(
        "part_id", "card_ord", "query", "relevance", "part_key", "part_name_norm",
        attrs.alias("attributes"),
    ).orderBy("part_id", F.desc("relevance"), "card_ord")


@query(
    "f08_relevance_threshold",
    f"SELECT part_id, card_ord, relevance FROM ({RELEVANT}) WHERE relevance >= CAST(0.5 AS DOUBLE)",
)
def _(t):
    kept = offers.keep_relevant(offers.attach_request(t("cards"), t("parts")), 0.5)
    return kept.select("part_id", "card_ord", "relevance")
