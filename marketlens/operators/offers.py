"""Offer rows: joins with parts, relevance, caps, page offers, prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import classify, fixed_values as fv, relevance, text, urls
from marketlens.operators import skew
from marketlens.operators.columns import with_computed

PART_METADATA = ["part_key", "part_name_norm", "car_model", "part_type", "side", "variant", "trim"]


# --- joins with the requested part -------------------------------------------

def attach_part_metadata(offers: DataFrame, parts: DataFrame) -> DataFrame:
    """Single stage: the requested part's own classification on each offer.

    No broadcast hint: the request list may be of any size, so the planner
    decides on its measured size and splits skewed parts at run time.  A repeated
    part_id counts once.
    """
    known = skew.first_row(parts.select("part_id", *PART_METADATA), "part_id", PART_METADATA)
    return offers.join(known, "part_id")


def sent_requests(parts: DataFrame) -> DataFrame:
    """Requests that are searched for: blank keywords find nothing."""
    return parts.where(text.strip(text.or_empty(F.col("keywords"))) != "")


def attach_request(
    cards: DataFrame, parts: DataFrame, as_of: Column | None = None, with_words: bool = False
) -> DataFrame:
    """Two stage: id, name, code and query of the request on each card.

    Of requests that repeat an id the first counts, so that no card is multiplied.
    `with_words` adds the query's words as `_query`, found once a request.
    """
    request = parts.select(
        "part_id", "part_ord", "part_name", "part_code", F.col("keywords").alias("query")
    )
    first = skew.first_row(request, "part_id", ["part_ord", "query"])
    if with_words:
        first = first.withColumn("_query", _query_words())
    joined = cards.join(first, "part_id")
    return joined if as_of is None else joined.withColumn("snapshot_ts", as_of)


# --- relevance ---------------------------------------------------------------

def _query_words() -> Column:
    return text.words(text.matching_form(F.col("query")))


def _scored(forms: DataFrame) -> DataFrame:
    """Attributes, relevance, key and display name of rows with `_form` (and `_query`, if it is known)."""
    a = {name: F.col(f"_{name}") for name in classify.TITLE_LEXICONS}
    form, title = F.col("_form"), F.col("title_raw")
    query = {} if "_query" in forms.columns else {"_query": _query_words()}
    return (
        forms.withColumns({f"_{name}": c for name, c in classify.title_attributes(form).items()} | query)
        .withColumns(
            {
                "relevance": relevance.relevance_score(text.words(form), F.col("_query"), a),
                "attributes": F.struct(*[c.alias(name) for name, c in a.items()]),
                "part_key": classify.title_part_key(a),
                "part_name_norm": classify.title_display_name(title, a),
            }
        )
        .drop("_query", *[f"_{name}" for name in a])
    )


def keep_relevant(cards: DataFrame, min_relevance: float = fv.MIN_RELEVANCE) -> DataFrame:
    """Rejects foreign titles, scores the rest against `query`.

    Scoring follows the filter, so only accepted titles pay for it.
    """
    return score_accepted(accepted(cards), min_relevance)


def accepted(cards: DataFrame) -> DataFrame:
    """Cards whose titles are not foreign, with the titles' `_form`."""
    forms = with_computed(cards, "_form", text.matching_form(F.col("title_raw")))
    return forms.where(relevance.accepted_form(F.col("_form")))


def score_accepted(cards: DataFrame, min_relevance: float = fv.MIN_RELEVANCE) -> DataFrame:
    """Scores accepted cards against `query`."""
    scored = _scored(cards).drop("_form")
    if min_relevance <= fv.RELEVANCE_WEIGHTS["part_type"]:
        return scored  # an accepted title has a part type, which scores that much alone
    return scored.where(F.col("relevance") >= min_relevance)


def score_rows(cards: DataFrame, min_relevance: float = fv.MIN_RELEVANCE) -> DataFrame:
    """Keeps every row and says whether it passes, as `kept`.

    A foreign title has relevance 0 and no attributes.
    """
    forms = with_computed(cards, "_form", text.matching_form(F.col("title_raw")))
    scored = _scored(forms).withColumn("_accepted", relevance.accepted_form(F.col("_form")))
    ok = F.col("_accepted")
    return scored.withColumns(
        {
            "kept": ok & (F.col("relevance") >= min_relevance),
            "relevance": F.when(ok, F.col("relevance")).otherwise(0.0),
            **{n: F.when(ok, F.col(n)) for n in ("attributes", "part_key", "part_name_norm")},
        }
    ).drop("_form", "_accepted")


def first_cards(cards: DataFrame, limit: int) -> DataFrame:
    """First cards of each search, in page order."""
    w = Window.partitionBy("part_id").orderBy("card_ord")
    return cards.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit).drop("_rank")


def most_relevant(cards: DataFrame, limit: int | None = None) -> DataFrame:
    """Cards in order of relevance (`relevance_rank`), the best `limit` of a part if given."""
    w = Window.partitionBy("part_id").orderBy(F.desc("relevance"), "card_ord")
    ranked = cards.withColumn("relevance_rank", F.row_number().over(w))
    return ranked if limit is None else ranked.where(F.col("relevance_rank") <= limit)


# --- product-page offers -----------------------------------------------------

_PAGE_FIELDS = ["seller_name", "price_raw", "price_text", "currency_unit", "seller_url", "availability"]


def drill_down(
    cards: DataFrame,
    page_offers: DataFrame,
    card_key: Sequence[str] = ("part_id", "card_ord"),
    as_of: Column | None = None,
    **salting,
) -> DataFrame:
    """Replaces each card by the offers of its product page.

    A card without url, page or page offers survives as itself.  A page offer
    has no raw seller name and no attributes, and its seller is normalised; on a
    surviving card `seller_name_norm` is absent (NULL), which is not ''.

    Cards may come without some of these columns; they are not made then.
    """
    fields = [name for name in _PAGE_FIELDS if name in cards.columns]
    own = [name for name in ("seller_name", "attributes") if name in cards.columns]
    pages = page_offers.select(
        F.col("product_url").alias("_url"),
        "offer_pos",
        *[F.col(name).alias(f"_{name}") for name in _PAGE_FIELDS],
    )
    joined = skew.salted_left_join(
        cards.withColumn("_url", text.non_empty(F.col("product_url"))),
        pages,
        "_url",
        left_spread=[F.col(c) for c in card_key],
        right_spread=[F.col("offer_pos"), F.col("_seller_name"), F.col("_price_text")],
        **salting,
    )
    page = F.col("_matched").isNotNull()

    def pick(name: str) -> Column:
        return F.when(page, F.col(f"_{name}")).otherwise(F.col(name))

    out = joined.withColumns(
        {
            "seller_name_norm": F.when(page, text.normalize_seller_name(F.col("_seller_name"))),
            **{name: F.when(~page, F.col(name)) for name in own},
            "drilled_down": page,
            **{name: pick(name) for name in fields if name != "seller_name"},
        }
    )
    if as_of is not None and "snapshot_ts" in cards.columns:
        out = out.withColumn("snapshot_ts", F.when(page, as_of).otherwise(F.col("snapshot_ts")))
    return out.drop("_url", "_matched", *[f"_{name}" for name in _PAGE_FIELDS])


# --- prices ------------------------------------------------------------------

def toman_only(offers: DataFrame) -> DataFrame:
    """Single stage: rial becomes toman in place, rows without a price go.

    The test is on the price as read, so 5 rial stays, as 0 toman.
    """
    price, unit = F.col("price_raw"), F.col("currency_unit")
    rial = unit == "rial"
    return offers.where(price > 0).withColumns(
        {
            "price_raw": F.when(rial, text.rial_to_toman(price)).otherwise(price),
            "currency_unit": F.when(rial, "toman").otherwise(unit),
        }
    )


def with_dual_prices(offers: DataFrame) -> DataFrame:
    """Two stage: toman and rial prices and the missing flag."""
    price = F.coalesce(F.col("price_raw"), F.lit(0).cast("bigint"))
    rial = F.coalesce(F.col("currency_unit") == "rial", F.lit(False)) & (price > 0)
    zero = F.lit(0).cast("bigint")
    return offers.withColumns(
        {
            "price_toman": F.when(rial, text.rial_to_toman(price)).otherwise(price),
            "price_rial": F.when(rial, price)
            .when(price > 0, text.toman_to_rial(price))
            .otherwise(zero),
            "price_missing": F.when(price <= 0, 1).otherwise(0),
        }
    )


def export_price_toman() -> Column:
    """Toman price as the single-stage export sees it (converts a rial tag again)."""
    price = F.coalesce(F.col("price_raw"), F.lit(0).cast("bigint"))
    return F.when(
        F.coalesce(F.col("currency_unit") == "rial", F.lit(False)) & (price > 0),
        text.rial_to_toman(price),
    ).otherwise(price)


# --- export projections ------------------------------------------------------

def _text_or_empty(*names: str) -> list[Column]:
    return [text.or_empty(F.col(n)).alias(n) for n in names]


def offers_raw_single(offers: DataFrame, as_of: Column) -> DataFrame:
    toman = export_price_toman()
    return offers.select(
        *_text_or_empty("part_id", "part_name", "part_code", "part_key", "part_name_norm",
                        "title_raw", "seller_name_norm"),
        toman.alias("price_toman"),
        text.toman_to_rial(toman).alias("price_rial"),
        *_text_or_empty("product_url", "seller_url", "availability"),
        F.coalesce(F.col("snapshot_ts"), as_of).alias("snapshot_ts"),
    )


def offers_raw_two_stage(offers: DataFrame, as_of: Column) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return offers.select(
        *_text_or_empty("part_id", "part_name", "part_code", "query", "part_key",
                        "part_name_norm", "title_raw"),
        "price_raw",
        *_text_or_empty("price_text", "currency_unit", "seller_name", "seller_name_norm"),
        F.coalesce("price_toman", zero).alias("price_toman"),
        F.coalesce("price_rial", zero).alias("price_rial"),
        *_text_or_empty("product_url", "seller_url"),
        urls.validation_text(F.col("product_url"), F.col("seller_url")).alias("validation_urls"),
        F.coalesce("relevance", F.lit(0.0)).alias("relevance"),
        F.coalesce(F.col("snapshot_ts"), as_of).alias("snapshot_ts"),
        F.coalesce("price_missing", F.lit(0)).alias("price_missing"),
        F.coalesce("drilled_down", F.lit(False)).alias("drilled_down"),
    )
