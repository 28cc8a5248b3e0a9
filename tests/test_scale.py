"""What the large runs asked for: work done once, and no more on disk than a step needs."""

import os
import random
import time

import plain_markup
from pyspark.sql import functions as F

from marketlens.functions import fixed_values as fv, relevance, text
from marketlens.sources import html, pages


def test_plain_pages_are_taken_apart_by_one_pattern(monkeypatch):
    def feed(*_):
        raise AssertionError("read character by character")

    r = random.Random(5)
    classes = ["offer-card", "seller-offer", "my-offer", "price", "shop-name", "unit-cost", "x y"]
    sources = []
    for _ in range(300):
        out = []
        for _ in range(r.randrange(1, 12)):
            tag = r.choice(["div", "li", "b", "a", "span", "br"])
            href = f' href="{r.choice(["/shop/1", "/seller/2", "/about", ""])}"' if tag == "a" else ""
            out.append(f'<{tag} class="{r.choice(classes)}"{href}>{r.choice(["Shop A", "12,000 > 5", " ", ""])}')
            out += [f"</{r.choice([tag, 'div'])}>"] * r.randrange(2)
        sources.append("".join(out))
    expected = [plain_markup.offers(s) for s in sources]
    assert sum(map(len, expected)) > 200
    monkeypatch.setattr(html.Watch, "feed", feed)
    assert [pages.offer_fields(s) for s in sources] == expected


def test_other_pages_are_read_in_full():
    offer = '<div class="offer-card"><b class="price">7</b></div>'
    for around in ("<!-- {} -->", "<script>{}</script>", "<title>{}</title>", "<p title='{}'>", "a &amp; {}", "<P>{}", "<p a=b>{}", "< {}"):
        page = around.format(offer)
        assert pages.offer_fields(page) == plain_markup.offers(page), page


def test_price_of_long_and_short_numbers(column):
    texts = ["", None, "x", "1234567", "1,234,567.50", "12 تومان 34", "99999999999999999999", "9" * 39, "5 " + "9" * 39, "9223372036854775807",
             "9223372036854775808", "000000000000000000007", "0", "1234,567", "۱۲،۳۴۵ ریال", "1.5", "7 and 12,000", "1,234" + ",567" * 6]
    assert column(text.extract_price, texts) == [
        0, 0, 0, 1234567, 123456750, 34, None, None, None, 9223372036854775807,
        None, 7, 0, 4567, 12345, 5, 12000, None,
    ]


def test_words_are_looked_for_in_a_form_made_once(column, spark):
    lexicon = {"plus": [r"e\+", "e plus"], "mirror": ["side mirror", "mirror"], "any": ["a.c"], "none": ["zz"]}
    texts = ["e+", "ee", "abc side mirror", "MIRROR", "", None, "zz a.c", "e  plus"]
    got = column(lambda c: F.array_join(relevance.negative_categories(c, lexicon), ","), texts)
    assert got == ["plus", "", "mirror,any", "mirror", "", "", "any,none", "plus"]
    assert text.plain_words([r"e\+", "led strip", "led"]) == ["e+", "led"]
    assert text.plain_words(["a.c"]) is None and text.plain_words(["x", ""]) is None
    said = spark.range(1).select(relevance.negative_categories(F.col("id").cast("string"), fv.NEGATIVE_PATTERNS).alias("c"))
    plan = said._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and "RLIKE" not in plan


def shuffle_files(spark) -> int:
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))


def test_a_written_table_leaves_no_shuffle_files(spark):
    from marketlens.session import materialize, settled

    before = shuffle_files(spark)
    rows = spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count()
    assert len(materialize(rows, "counts").collect()) == 7
    for _ in range(20):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.25)
    assert shuffle_files(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

    steps = []

    def build():
        steps.append(materialize(rows, "step"))
        return steps[0].where("k < 3")

    out = settled(spark, build, "end")
    assert out.count() == 3
    assert not [f for f in steps[0].inputFiles() if os.path.exists(f.removeprefix("file:"))]


def test_row_numbers_of_views_are_given_before_texts_are_made():
    from queries import views

    for name in ("cards", "page_offers"):
        sql = views.ranked_first(views.VIEWS[name])
        inner = sql[sql.index("FROM (SELECT *, row_number()") :]
        assert sql.count("row_number()") == 1 and "concat" not in inner and inner.endswith("FROM {sources})")
    assert views.ranked_first(views.VIEWS["offers"]) == views.VIEWS["offers"]


def test_cards_carry_only_what_is_read(spark):
    from marketlens.plans import two_stage

    parts = spark.createDataFrame(
        [("1", 1, "سپر جلو", "c", "سپر جلو پرو"), ("2", 2, "x", "c", " ")],
        "part_id string, part_ord long, part_name string, part_code string, keywords string",
    )
    card = ["toman", "s", "u1", "", "", None]
    cards = spark.createDataFrame(
        [("1", 1, "سپر جلو چپ", 5, "5", *card), ("1", 2, "آینه", 7, "7", *card), ("1", 3, "کاپوت", None, "", *card), ("2", 4, "کاپوت", 3, "", *card)],
        "part_id string, card_ord int, title_raw string, price_raw long, price_text string, currency_unit string, "
        "seller_name string, product_url string, seller_url string, availability string, snapshot_ts timestamp",
    )
    offers = spark.createDataFrame(
        [("u1", 0, "شرکت A", 50, "50", "rial", "", ""), ("u9", 0, "B", 1, "", "", "", "")],
        "product_url string, offer_pos int, seller_name string, price_raw long, price_text string, currency_unit string, "
        "seller_url string, availability string",
    )
    now = F.lit("2024-01-01").cast("timestamp")
    whole = two_stage.processed_offers(parts, cards, offers, now)
    for columns in (two_stage.REPORT_COLUMNS, two_stage.SUMMARY_COLUMNS, ["part_id", "relevance"]):
        some = two_stage.processed_offers(parts, cards, offers, now, columns)
        assert "attributes" not in some.columns and {"price_toman", "seller_name_norm", "drilled_down"} <= set(some.columns)
        key = lambda r: (r.card_ord, r.offer_pos)
        rows = [r.asDict() for r in sorted(some.collect(), key=key)]
        assert len(rows) == 2
        assert rows == [{c: r[c] for c in some.columns} for r in sorted(whole.collect(), key=key)]


def test_small_blocks_are_compared_in_place(spark):
    """Both ways give the same counts, and the one for small blocks shuffles each signature once."""
    from marketlens.operators import similarity
    from test_dedupe import frame, random_rows

    offers = frame(spark, random_rows(6))
    of = lambda n: sorted(map(tuple, similarity.similar_counts(offers, n).collect()), key=str)
    assert of(1 << 30) == of(0) == of(3)
    plan = similarity.similar_counts(offers, 1 << 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
