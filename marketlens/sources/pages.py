"""Search cards and product-page offers out of a table of archived pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from marketlens import schemas
from marketlens.functions import fixed_values as fv, text, urls
from marketlens.operators.columns import with_computed
from marketlens.session import materialize, ship_package
from marketlens.sources import html

CARD_FIELDS = [
    "title_raw", "price_raw", "price_text", "currency_unit", "seller_name", "product_url",
    "seller_url", "availability",
]


def latest_pages(pages: DataFrame, stamp: str = "page_id") -> DataFrame:
    """One page per url, that of the greatest `stamp`, of an archive that has several."""
    rest = [c for c in pages.columns if c != "url"]
    last = F.max_by(F.struct(*rest), F.struct(F.col(stamp), *[c for c in rest if c != stamp]))
    return pages.groupBy("url").agg(last.alias("_p")).select(
        *[F.col("url") if c == "url" else F.col(f"_p.{c}").alias(c) for c in pages.columns]
    )


# --- embedded JSON (all native) ----------------------------------------------

def with_products(pages: DataFrame) -> DataFrame:
    """Adds `products`, the embedded product list, NULL or empty if there is none.

    A page is searched and parsed once, whatever later filters ask of the list.
    """
    marked = F.when(F.col("html").contains(fv.EMBEDDED_MARKER), F.col("html"))
    document = F.regexp_extract(marked, fv.EMBEDDED_JSON, 1)
    listed = F.get_json_object(document, fv.EMBEDDED_PRODUCTS_PATH)
    return with_computed(pages, "products", F.from_json(listed, ArrayType(schemas.PRODUCT_JSON)))


def _has_products() -> Column:
    return F.coalesce(F.size("products") > 0, F.lit(False))


def cards_from_json(pages: DataFrame, base_url: str) -> DataFrame:
    """One card per embedded product that has a title or a price."""
    return _product_cards(with_products(pages), base_url)


def _product_cards(found: DataFrame, base_url: str) -> DataFrame:
    """A product whose price no 64 bits hold is left out, not its page."""
    rows = found.select("page_id", "url", F.posexplode("products").alias("card_ord", "p"))
    price = F.col("p.price").try_cast("decimal(30,6)")
    price_text = text.or_empty(F.col("p.price_text"))
    return rows.select(
        "page_id", "url", "card_ord",
        urls.card_title(F.col("p.name1"), F.col("p.name2")).alias("title_raw"),
        urls.card_price(price).alias("price_raw"),
        price_text.alias("price_text"),
        F.when(price_text == "", "unknown").otherwise(text.detect_currency_unit(price_text)).alias("currency_unit"),
        urls.seller_from_shop_text(F.col("p.shop_text")).alias("seller_name"),
        urls.absolute_url(F.col("p.web_client_absolute_url"), base_url).alias("product_url"),
        F.lit("").alias("seller_url"),
        text.or_empty(F.col("p.stock_status")).alias("availability"),
    ).where(F.col("price_raw").isNotNull() & ((F.col("title_raw") != "") | (F.col("price_raw") > 0)))


# --- markup ------------------------------------------------------------------

_RAW_CARD = (
    "page_id bigint, url string, card_ord int, title string, price string, price_ok boolean, "
    "seller string, seller_href string, availability string, href string"
)
_RAW_OFFER = (
    "product_url string, offer_pos int, seller string, price string, price_ok boolean, href string"
)


def _looks_like_price(value: str) -> bool:
    return re.search(fv.LOOKS_LIKE_PRICE, value) is not None


def _numbered(selectors: list[str], numbers: dict[str, int]) -> list[int]:
    return [numbers.setdefault(s, len(numbers)) for s in selectors]


_CARD_NUMBERS: dict[str, int] = {}
_CARD_PRICE = _numbered(fv.CARD_PRICE_SELECTORS, _CARD_NUMBERS)
_CARD_SELLER = _numbered(fv.CARD_SELLER_SELECTORS, _CARD_NUMBERS)
_CARD_TESTS = html.Tests([html.matcher(s) for s in _CARD_NUMBERS] + [html.matcher(*fv.AVAILABILITY_SELECTORS)])
_CARD_STOCK = len(_CARD_NUMBERS)
_NO_RESULTS = html.matcher(*fv.NO_RESULTS_SELECTORS)


class _Cards(html.Watch):
    """Product links with what stands in their parent, taken when the parent closes."""

    def __init__(self, link_part: str) -> None:
        super().__init__(_CARD_TESTS)
        self.is_link = html.matcher(f"a[href*={link_part}]")
        self.links, self.empty = 0, False
        self.found: list[tuple] = []

    def opened(self, element: html.Element, attrs: dict) -> bool:
        self.empty = self.empty or _NO_RESULTS(element.tag, attrs)
        if self.is_link(element.tag, attrs):
            self.open[-1].held.append((self.links, self.record(element, attrs)))
            self.links += 1
        return True

    def closed(self, element: html.Element) -> None:
        if not element.held:
            return
        price, _, price_ok = self.first_text(element, _CARD_PRICE, _looks_like_price)
        seller, node, seller_ok = self.first_text(element, _CARD_SELLER, lambda t: not _looks_like_price(t))
        seller_href = ((node.link or {}).get("href") or "") if seller_ok else ""
        stock = element.first.get(_CARD_STOCK)
        around = price, price_ok, seller if seller_ok else "", seller_href, self.text(stock) if stock else ""
        for i, link in element.held:
            title = self.text(link)
            shown = title if len(title.strip()) > fv.MIN_CARD_TITLE else ""
            self.found.append((i, shown, *around, link.attrs.get("href") or ""))


def card_fields(source: str, link_part: str = fv.CARD_LINK_PART) -> list[tuple]:
    """(number, title, price, price_ok, seller, seller_href, availability, href) of a page's links."""
    cards = _Cards(link_part)
    cards.read(source)
    return [] if cards.empty else sorted(cards.found)


_OFFER_NUMBERS: dict[str, int] = {}
_OFFER_SELLER = _numbered(fv.OFFER_SELLER_SELECTORS, _OFFER_NUMBERS)
_OFFER_PRICE = _numbered(fv.OFFER_PRICE_SELECTORS, _OFFER_NUMBERS)
_OFFER_LINK = _numbered(fv.OFFER_LINK_SELECTORS, _OFFER_NUMBERS)
_OFFER_TESTS = html.Tests([html.matcher(s) for s in _OFFER_NUMBERS])
_OFFER_KINDS = html.Tests([html.matcher(s) for s in fv.OFFER_SELECTORS])


class _Offers(html.Watch):
    """Offer elements of the first kind that the page has, taken when they close."""

    def __init__(self) -> None:
        super().__init__(_OFFER_TESTS)
        self.kind, self.seen = len(fv.OFFER_SELECTORS), 0
        self.found: list[tuple] = []

    def opened(self, element: html.Element, attrs: dict) -> bool:
        known = _OFFER_KINDS.numbers(element.tag, attrs) if element.tag else ()
        if not known or not (kinds := [k for k in known if k <= self.kind]):
            return False
        if kinds[0] < self.kind:  # a better kind: what was found of others does not count
            self.kind, self.found = kinds[0], []
        element.held.append((kinds, self.seen))
        self.seen += 1
        return True

    def closed(self, element: html.Element) -> None:
        if not element.held or self.kind not in element.held[0][0]:
            return
        always = lambda _: True
        seller, _, seller_ok = self.first_text(element, _OFFER_SELLER, always)
        price, _, price_ok = self.first_text(element, _OFFER_PRICE, always)
        targets = [(element.first[n].attrs.get("href") or "") if n in element.first else "" for n in _OFFER_LINK]
        href = next((t for t in targets if any(word in t for word in fv.SELLER_LINK_WORDS)), "")
        self.found.append((element.held[0][1], seller if seller_ok else "", price, price_ok, href))


def offer_fields(source: str) -> list[tuple]:
    """(number, seller, price, price_ok, href) of a page's offers."""
    offers = _Offers()
    offers.read(source)
    return [(i, *o[1:]) for i, o in enumerate(sorted(offers.found))]


def _find_cards(link_part: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _RAW_CARD.split(", ")]
        for pdf in batches:
            out = []
            for page_id, url, source in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                for number, *fields in card_fields(source or "", link_part):
                    out.append((page_id, url, number, *fields))
            yield pd.DataFrame(out, columns=columns)

    return run


_ARROW_OFFER = pa.schema(
    [(c.split()[0], {"int": pa.int32(), "boolean": pa.bool_()}.get(c.split()[1], pa.string())) for c in _RAW_OFFER.split(", ")]
)


def _find_offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())
        out = [(url, *o) for url, source in pages for o in offer_fields(source or "")]
        columns = zip(*out) if out else [()] * len(_ARROW_OFFER)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW_OFFER)], schema=_ARROW_OFFER)


def _cleaned(found: DataFrame, **more: Column) -> DataFrame:
    """Adds the seller, the price's text, number and unit, and `more`: each computed once, whatever filters follow."""
    ok = F.col("price_ok")
    texts = with_computed(found, "_text", F.when(ok, text.clean_whitespace(F.col("price"))))
    cleaned = F.col("_text")
    fields = {
        "price_text": F.when(ok, cleaned).otherwise(F.col("price")),
        "price_raw": F.when(ok, text.extract_price(cleaned)),
        "currency_unit": F.when(ok, text.detect_currency_unit(cleaned)).otherwise("unknown"),
        "seller_name": text.clean_whitespace(F.col("seller")),
        **more,
    }
    rows = with_computed(texts, "_fields", F.struct(*[c.alias(name) for name, c in fields.items()]))
    return rows.withColumns({name: F.col(f"_fields.{name}") for name in fields})


def cards_from_markup(pages: DataFrame, base_url: str, link_part: str = fv.CARD_LINK_PART) -> DataFrame:
    """One card per product link; its surroundings give price, seller, stock."""
    ship_package()
    raw = pages.select("page_id", "url", "html").mapInPandas(_find_cards(link_part), _RAW_CARD)
    found = _cleaned(raw, title_raw=text.clean_whitespace(F.col("title")))
    return (
        found.withColumns(
            {
                "seller_url": urls.absolute_url(F.col("seller_href"), base_url),
                "availability": text.clean_whitespace(F.col("availability")),
                "product_url": urls.absolute_url(F.col("href"), base_url),
            }
        )
        .select("page_id", "url", "card_ord", *CARD_FIELDS)
        .where((F.col("title_raw") != "") | (F.coalesce("price_raw", F.lit(0)) > 0))
    )


def search_cards(pages: DataFrame, base_url: str) -> DataFrame:
    """Cards of search pages: embedded JSON, markup where there is none.

    Products are found once; both branches read them from the shared folder.
    """
    found = with_products(pages.select("page_id", "url", "html"))
    split = materialize(
        found.select("page_id", "url", "products", F.when(~_has_products(), F.col("html")).alias("html")),
        "search-pages",
    )
    without = split.where(~_has_products()).drop("products")
    embedded = split.where(_has_products()).drop("html")
    return _product_cards(embedded, base_url).unionByName(cards_from_markup(without, base_url))


def page_offers(pages: DataFrame, base_url: str) -> DataFrame:
    """Offers of product pages that name a seller or a price."""
    ship_package()
    found = _cleaned(pages.select("url", "html").mapInArrow(_find_offers, _RAW_OFFER))
    return (
        found.withColumns({"seller_url": urls.absolute_url(F.col("href"), base_url), "availability": F.lit("")})
        .select(*schemas.PAGE_OFFER.names)
        .where((F.col("seller_name") != "") | (F.coalesce("price_raw", F.lit(0)) > 0))
    )


def offers_for_parts(parts: DataFrame, pages: DataFrame, base_url: str, as_of: Column) -> DataFrame:
    """Single stage: cards of the page each part's keywords lead to, as offers."""
    wanted = parts.select(
        "part_id", "part_ord", "part_name", "part_code", "keywords",
        urls.search_url(F.col("keywords"), base_url).alias("url"),
    )
    asked = pages.join(wanted.select("url").where("url IS NOT NULL").distinct(), "url", "left_semi")
    cards = search_cards(asked, base_url).drop("page_id")
    return (
        cards.join(wanted, "url")
        .withColumns({"seller_url": F.lit(""), "snapshot_ts": as_of})
        .drop("url")
    )
