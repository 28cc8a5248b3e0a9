"""One-pass extraction against a whole tree, on random and on very large pages."""

import random
import tracemalloc

import plain_markup
import pytest

from marketlens.functions import fixed_values as fv
from marketlens.sources import pages

CLASSES = ["price", "product-price", "x price-tag", "seller-name", "shop-name", "store-name", "offer-card", "seller-offer",
           "my-offer", "stock-status", "availability", "cost", "a b", "ProductCard_desktop_seller__3LVVm", ""]
TEXTS = ["12,000 تومان", "Shop A", "a long title of a part", " ", "x", "&amp;", "7", "موجود"]
HREFS = ["/p/1", "/p/2?x", "/shop/3", "/seller/4", "/other", ""]


def random_page(r, depth=0):
    out = []
    for _ in range(r.randrange(1, 5)):
        kind = r.random()
        if kind < 0.3 or depth > 6:
            out.append(r.choice(TEXTS))
            continue
        tag = r.choice(["div", "span", "a", "p", "li", "td", "tr", "br", "img", "section"])
        attrs = (f' class="{r.choice(CLASSES)}"' if r.random() < 0.6 else "") + (f' href="{r.choice(HREFS)}"' if tag == "a" else "")
        if r.random() < 0.05:
            out.append(f"<{tag}{attrs}/>")
            continue
        end = "" if r.random() < 0.15 else f"</{r.choice(['div', 'zz', 'li'])}>" if r.random() < 0.1 else f"</{tag}>"
        out.append(f"<{tag}{attrs}>{random_page(r, depth + 1)}{end}")
    if depth == 0 and r.random() < 0.05:
        out.append('<div class="empty-state"></div>')
    return "".join(out)


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_whole_tree(seed):
    r = random.Random(seed)
    some = [0, 0]
    for _ in range(600):
        page = "".join(random_page(r) for _ in range(3))
        cards, offers = plain_markup.cards(page, fv.CARD_LINK_PART), plain_markup.offers(page)
        assert pages.card_fields(page) == cards, page
        assert pages.offer_fields(page) == offers, page
        some = [some[0] + len(cards), some[1] + len(offers)]
    assert min(some) > 500


def test_odd_pages():
    for page in ["", "no markup", "</div></p>", "<a href='/p/1'>", "<a href=/p/9>abcdef</a>tail", "<div" * 50, "<p>" * 20_000, "<div class='price'>" * 2_000 + "<a href='/p/1'>1234567"]:
        assert pages.card_fields(page) == plain_markup.cards(page, fv.CARD_LINK_PART)
        assert pages.offer_fields(page) == plain_markup.offers(page)


def test_one_very_large_page(spark):
    """50 MB of cards: no tree, so memory stays near the page's own size."""
    card = '<div class="card"><a href="/p/{0}">title of part {0}</a><span class="price">{0}</span><b>' + "x" * 790 + "</b></div>"
    n = 60_000
    page = "<html><body>" + "".join(card.format(i) for i in range(n)) + "</body></html>"
    assert len(page) > 48 << 20
    tracemalloc.start()
    cards = pages._Cards(fv.CARD_LINK_PART)
    cards.read(page[: 5 << 20])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * (5 << 20)
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    got = pages.cards_from_markup(df, "https://x").selectExpr("count(*)", "count(distinct title_raw)", "max(price_raw)").first()
    assert tuple(got) == (n, n, n - 1)
