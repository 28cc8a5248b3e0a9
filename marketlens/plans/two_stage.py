"""Two-stage job: search cards, relevance, product pages, three reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators import offers, summaries
from marketlens.session import materialize, settled

# Order in which offers come out: by part, by rank of the card, by place on its page.
OFFER_ORDER = ["part_ord", "relevance_rank", "offer_pos"]
# What the reports and the counters read of cards; the attributes are not among it.
REPORT_COLUMNS = [
    "part_id", "part_ord", "part_name", "part_code", "query", "relevance_rank", "relevance", "part_key",
    "part_name_norm", "title_raw", "price_raw", "price_text", "currency_unit", "seller_name", "product_url",
    "seller_url", "snapshot_ts",
]
# What part and seller summaries read of them.
SUMMARY_COLUMNS = [
    "part_id", "part_ord", "relevance_rank", "part_key", "part_name_norm", "price_raw", "currency_unit", "product_url",
]
_KEYS = ["part_id", "card_ord", "product_url", "price_raw", "currency_unit"]


def relevant_cards(
    parts: DataFrame,
    cards: DataFrame,
    as_of: Column,
    max_cards: int | None = None,
    max_drill_downs: int | None = None,
) -> DataFrame:
    """Stage A: the relevant cards of each search, ranked; all of them by default.

    `max_cards` takes the first cards of a search only, `max_drill_downs` the most
    relevant of a part only.  Both limits are rank filters on the same partitioning:
    the cards are shuffled once, after a first cut inside each task, and without
    those that their title alone rejects.
    """
    first = cards if max_cards is None else offers.first_cards(cards, max_cards)
    asked = offers.sent_requests(parts)
    known = offers.attach_request(offers.accepted(first), asked, as_of, with_words=True)
    return offers.most_relevant(offers.score_accepted(known), max_drill_downs)


def processed_offers(
    parts: DataFrame, cards: DataFrame, page_offers: DataFrame, as_of: Column,
    columns: Sequence[str] | None = None, **limits,
) -> DataFrame:
    """Stages A and B and both prices.

    The cards are written once, then the offers of the pages they lead to: page offers
    are scanned (and, if they come from markup, parsed) a single time, and hot pages
    are looked for among those alone.  Of the cards only `columns` are carried on, where
    a caller names what it reads; the rows are the same.
    """
    relevant = relevant_cards(parts, cards, as_of, **limits)
    if columns is not None:
        relevant = relevant.select(*[c for c in relevant.columns if c in columns or c in _KEYS])
    top = materialize(relevant, "cards")
    led_to = top.select("product_url").where("product_url <> ''").distinct()
    wanted = materialize(page_offers.join(led_to, "product_url", "left_semi"), "page-offers")
    return offers.with_dual_prices(offers.drill_down(top, wanted, as_of=as_of))


def reports(processed: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    # written once: the flags read it again for their bounds, and the sort to sample it
    summary = settled(
        processed.sparkSession, lambda: summaries.part_summary(processed, OFFER_ORDER, two_stage=True), "parts"
    )
    return {
        "offers_raw": summaries.sort_offers_two_stage(
            offers.offers_raw_two_stage(processed, as_of)
        ),
        "sellers_summary": summaries.sort_sellers(summaries.sellers_summary(processed)),
        "part_summary": summaries.sort_parts(summaries.with_outlier_flags(summary)),
    }


def statistics(
    parts: DataFrame, cards: DataFrame, processed: DataFrame, max_cards: int | None = None
) -> DataFrame:
    """Run counters; `search_results` counts the cards of requested parts, up to the limit."""
    asked = offers.sent_requests(parts).select("part_id").distinct()
    per_search = cards.groupBy("part_id").agg(F.count(F.lit(1)).alias("n")).join(asked, "part_id")
    taken = F.col("n") if max_cards is None else F.least(F.col("n"), F.lit(max_cards))
    results = per_search.agg(F.coalesce(F.sum(taken), F.lit(0)).alias("n")).scalar()
    done = processed.agg(F.count_distinct("part_id").alias("n")).scalar()
    return summaries.two_stage_statistics(processed).select(
        done.alias("parts_processed"), results.alias("search_results"), "*"
    )


def run(
    parts: DataFrame, cards: DataFrame, page_offers: DataFrame, as_of: Column,
    max_cards: int | None = None, max_drill_downs: int | None = None,
) -> dict[str, DataFrame]:
    """Reports and statistics; processed offers are written once for all of them.

    Every card and every relevant card's page is taken unless a limit is given.
    """
    processed = settled(
        parts.sparkSession,
        lambda: processed_offers(
            parts, cards, page_offers, as_of, REPORT_COLUMNS, max_cards=max_cards, max_drill_downs=max_drill_downs
        ),
        "offers",
    )
    return reports(processed, as_of) | {
        "statistics": statistics(parts, cards, processed, max_cards)
    }
