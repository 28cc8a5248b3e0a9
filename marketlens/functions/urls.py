"""URL and page-field expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions import fixed_values as fv
from marketlens.functions.text import WHITE_SPACE, non_empty, or_empty, strip


def absolute_url(c: Column, base_url: str) -> Column:
    url = or_empty(c)
    return F.when((url == "") | url.startswith("http"), url).otherwise(
        F.concat(F.lit(base_url), url)
    )


def percent_encode(c: Column) -> Column:
    """RFC 3986 encoding that leaves '/' alone, from the form encoder."""
    out = F.url_encode(c)
    for form, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


def search_url(keywords: Column, base_url: str) -> Column:
    """NULL for blank keywords: such a request is never sent."""
    text = strip(or_empty(keywords))
    return F.when(
        text != "",
        F.concat(F.lit(f"{base_url}/search/?query="), percent_encode(text)),
    )


def card_title(name1: Column, name2: Column) -> Column:
    return F.coalesce(non_empty(name1), non_empty(name2), F.lit(""))


def card_price(c: Column) -> Column:
    """Whole price, 0 for none; NULL if it does not fit 64 bits."""
    zero = F.lit(0).cast("bigint")
    return F.when(c > 0, c.try_cast("bigint")).otherwise(zero)


def seller_from_shop_text(c: Column) -> Column:
    pattern = fv.SELLER_IN_SHOP_TEXT.replace(r"\s", WHITE_SPACE)
    return strip(F.regexp_extract(or_empty(c), pattern, 1))


def snapshot_key(cache_type: Column, query: Column) -> Column:
    return F.concat(cache_type, F.lit("_"), F.md5(F.lower(strip(query))))


def validation_text(product_url: Column, seller_url: Column) -> Column:
    product, seller = non_empty(product_url), non_empty(seller_url)
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Product: "), product),
        F.concat(F.lit("Seller: "), seller),
    )
    return F.coalesce(non_empty(lines), F.lit(fv.NO_URLS_TEXT))


def numbered_urls(urls: Column, label: str) -> Column:
    """`Label 1: url` lines of an array, or the no-urls text."""
    lines = F.transform(
        urls,
        lambda u, i: F.concat(F.lit(f"{label} "), (i + 1).cast("string"), F.lit(": "), u),
    )
    return F.coalesce(non_empty(F.array_join(lines, "\n")), F.lit(fv.NO_URLS_TEXT))
