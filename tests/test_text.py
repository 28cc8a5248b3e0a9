"""Golden values of the scalar rules."""

from pyspark.sql import functions as F

from marketlens.functions import text, urls


def test_digits(column):
    values = ["۱۲۳۴۵", "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩", "قیمت: ۱۲۳,۰۰۰ تومان", "hello world", ""]
    assert column(text.normalize_digits, values) == [
        "12345", "0123456789", "0123456789", "قیمت: 123,000 تومان", "hello world", "",
    ]


def test_whitespace(column):
    values = ["  hello   world  ", "hello\n\tworld", "", "   ", "a b", "a‌b", "a\x1cb", "a　 b", "a b"]
    assert column(text.clean_whitespace, values) == [
        "hello world", "hello world", "", "", "a b", "a‌b", "a b", "a b", "a b",
    ]
    # every character the reference language strips
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    assert column(text.clean_whitespace, [f"x{s}y" for s in spaces]) == ["x y"] * len(spaces)


def test_whitespace_is_idempotent(column):
    values = ["  a \n b ", "  ", "x"]
    once = column(text.clean_whitespace, values)
    assert column(text.clean_whitespace, once) == once


def test_price(column):
    values = [
        "قیمت: 123,000 تومان", "۱۲۳,۰۰۰ تومان", "123000", "تماس بگیرید", "", "قیمت نامشخص",
        "1,000.50", "Price: ٩٨٧.٦٥٤ ریال", None, "0", "12 345", "1" * 30,
    ]
    assert column(text.extract_price, values) == [
        123000, 123000, 123000, 0, 0, 0, 100050, 98765, 0, 0, 345, None,
    ]
    # numbers beyond 64 bits give no price, never a piece of them
    longer = ["12345678901234567890", "9,999,999,999,999,999,999", "5 " + "9" * 60, str(2**63 - 1)]
    assert column(text.extract_price, longer) == [None, None, None, 2**63 - 1]


def test_overflow_is_null(column):
    assert column(text.toman_to_rial, [2**62, 5], "bigint") == [None, 50]
    price = lambda c: urls.card_price(c.try_cast("decimal(30,6)"))
    assert column(price, ["1e20", "12.9", "-1", None]) == [None, 12, 0, 0]


def test_currency(column):
    values = ["123,000 تومان", "123,000 ریال", "123,000", "", None, "ریال تومان"]
    assert column(text.detect_currency_unit, values) == [
        "toman", "rial", "unknown", "unknown", "unknown", "toman",
    ]


def test_seller(column):
    values = [
        "فروشگاه پارت سنتر", "Disco Shop", "شرکت", None, "A Group Shop Store", "group", "فروشگاه شرکت X co",
        "شرکت فروشگاه X", "X store shop", "Xstore",
    ]
    assert column(text.normalize_seller_name, values) == [
        "پارت سنتر", "dis", "", "", "a", "", "x", "فروشگاه x", "x store", "x",
    ]


def test_title(column):
    values = [
        "چراغ جلو چپ تیگو ۸ پرو مکس اصل", "OEM part-original x", "party oem2 اصلی‌ها", "اصل اصلی یدکی", "x_oem oem", None,
    ]
    assert column(text.normalize_part_title, values) == [
        "چراغ جلو چپ تیگو ۸ پرو مکس", "- x", "party oem2 ‌ها", "", "x_oem", "",
    ]


def test_money(column):
    assert column(text.rial_to_toman, [105, 5, 0, -5, 2**62], "long") == [10, 0, 0, -1, 2**62 // 10]
    assert column(text.toman_to_rial, [7], "long") == [70]
    assert column(text.format_price, [1234567, None, 0], "long") == ["1,234,567 تومان", "", "0 تومان"]


def test_looks_like_price_ignores_persian_digits(column):
    assert column(text.looks_like_price, ["۱۲", "12", "a،b", "تومان", "x"]) == [
        False, True, True, True, False,
    ]


def test_keywords(spark):
    rows = spark.createDataFrame([("Lamp", " "), (" Lamp", None), ("Lamp", " k ")], "n string, k string")
    got = [r[0] for r in rows.select(text.default_keywords(F.col("k"), F.col("n"))).collect()]
    assert got == ["Lamp automotive part", "Lamp automotive part", "k"]


def test_urls(column):
    assert column(lambda c: urls.absolute_url(c, "https://b"), ["/p/1", "http://x", "", None]) == [
        "https://b/p/1", "http://x", "", "",
    ]
    assert column(lambda c: urls.search_url(c, "https://b"), [" a b/~*+é ", "  "]) == [
        "https://b/search/?query=a%20b/~%2A%2B%C3%A9", None,
    ]
    assert column(urls.seller_from_shop_text, ["در فروشگاه الف، تهران", "x", None]) == ["فروشگاه الف", "", ""]
