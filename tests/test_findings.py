"""Rules that odd rows bring out: repeated ids, blank keywords, NULL order, huge prices."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from marketlens import session
from marketlens.operators import dedupe, offers, summaries
from marketlens.plans import single_stage, two_stage
from marketlens.sources import pages

CARD = (
    "part_id string, card_ord int, title_raw string, price_raw long, price_text string, currency_unit string, "
    "seller_name string, product_url string, seller_url string, availability string, snapshot_ts timestamp"
)
PART = "part_id string, part_ord long, part_name string, part_code string, keywords string"


def cards(spark, n, part="1"):
    rows = [(part, i, "چراغ جلو تیگو 8", 1000 + i, "", "toman", "s", f"u{i}", "", "", None) for i in range(n)]
    return spark.createDataFrame(rows, CARD)


def as_of():
    return F.lit("2024-01-30 12:00:00").cast("timestamp")


def test_no_limits_unless_given(spark):
    parts = spark.createDataFrame([("1", 0, "x", "", "چراغ جلو")], PART)
    found = cards(spark, 260)
    assert two_stage.relevant_cards(parts, found, as_of()).count() == 260
    assert two_stage.relevant_cards(parts, found, as_of(), max_cards=200).count() == 200
    assert two_stage.relevant_cards(parts, found, as_of(), max_drill_downs=20).count() == 20


def test_repeated_and_blank_requests(spark):
    rows = [("1", 0, "x", "", "چراغ جلو"), ("1", 1, "y", "", "چراغ"), ("2", 2, "z", "", "  "), ("3", 3, "w", "", None)]
    parts = spark.createDataFrame(rows, PART)
    found = cards(spark, 3).unionByName(cards(spark, 4, "2")).unionByName(cards(spark, 5, "3")).unionByName(cards(spark, 6, "9"))
    top = two_stage.relevant_cards(parts, found, as_of())
    assert [(r.part_id, r.part_name) for r in top.collect()] == [("1", "x")] * 3
    stats = two_stage.statistics(parts, found, offers.with_dual_prices(top.withColumn("drilled_down", F.lit(False)).withColumn("seller_name_norm", F.lit("s"))))
    assert stats.first().search_results == 3


def test_statistics_count_offers_of_known_parts(spark):
    parts = spark.createDataFrame([("1", "a", "c", "k"), ("2", "", "c", "k")], "part_id string, part_name string, part_code string, keywords string")
    found = spark.createDataFrame([("1", "s"), ("2", "s")], "part_id string, seller_name_norm string")
    known = single_stage.prepare_parts(parts)
    assert tuple(summaries.single_stage_statistics(known, found, found.where("part_id = '1'")).first()) == (1, 1, 1, 1)


def test_null_in_order_keeps_the_offer(spark):
    schema = (
        "ord long, n long, part_id string, seller_name string, title_raw string, price_raw long, product_url string, "
        "seller_url string, availability string, currency_unit string"
    )
    rows = [(1, None, "1", "s", "lamp one", 100, "", "", "", ""), (2, 5, "1", "s", "door two three", 900, "", "", "", "")]
    assert dedupe.deduplicate(spark.createDataFrame(rows, schema), ["ord", "n"]).count() == 2


def test_deviation_of_huge_prices(spark):
    prices = [2**62 + i * 10**15 for i in range(50)]
    rows = [("1", f"s{i % 3}", p, 0, "u", "k", "n", i) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "part_id string, seller_name_norm string, price_toman long, price_missing int, product_url string, part_key string, part_name_norm string, o int")
    want = statistics.stdev(prices)
    assert math.isclose(summaries.price_deviation(df, ["part_id"]).first().price_std_dev, want, rel_tol=1e-6)
    assert math.isclose(summaries.part_summary(df, ["o"]).first().price_std_dev, want, rel_tol=1e-6)
    bounds = summaries.outlier_bounds(df.select(F.col("price_toman").alias("AMP_toman"))).first()
    assert math.isclose(bounds.std_amp, statistics.pstdev(prices), rel_tol=1e-6)


class _Cluster:
    """A session of a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: None)

    class sparkContext:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: _Cluster.conf)


def test_shared_folder_is_needed_on_a_cluster(spark):
    with pytest.raises(ValueError):
        session.shared_dir(_Cluster)


def test_scratch_can_be_cleared(spark):
    df = session.materialize(spark.range(5), "five")
    assert df.count() == 5
    system, where = session.file_system(spark, session.run_dir(spark))
    assert len(system.listStatus(where)) > 0
    session.clear_scratch(spark)
    assert not system.exists(where)
    assert session.materialize(spark.range(3), "three").count() == 3


def test_latest_page_of_each_url(spark):
    rows = [(1, "a", "old"), (3, "a", "new"), (2, "b", None), (None, "b", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, pages.latest_pages(df).collect())) == [(2, "b", None), (3, "a", "new")]


def test_one_huge_price_costs_one_product(spark):
    product = '{"name1":"%s","price":%s,"price_text":"","web_client_absolute_url":"/p/1","shop_text":"","stock_status":""}'
    doc = '{"props":{"pageProps":{"products":[%s,%s]}}}' % (product % ("big", "1e20"), product % ("fine", "5"))
    html = f'<script src="a"></script><script id="__NEXT_DATA__">{doc}</script>'
    df = spark.createDataFrame([(1, "u", html), (2, "v", "<p>nothing</p>")], "page_id long, url string, html string")
    assert [r.title_raw for r in pages.cards_from_json(df, "http://x").collect()] == ["fine"]
    assert [r.title_raw for r in pages.search_cards(df, "http://x").collect()] == ["fine"]
