"""Summaries, page offers, pages, files, snapshots."""

import datetime as dt
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from marketlens import schemas
from marketlens.functions import fixed_values as fv
from marketlens.operators import audit, offers, skew, snapshots, summaries
from marketlens.plans import audit as audit_job
from marketlens.sources import commits, pages, parts as parts_source, reports, snapshots as snapshot_source



def now():
    return F.lit("2024-01-02 00:00:00").cast("timestamp")


def test_median_and_deviation_equal_the_standard_library(spark):
    rng = random.Random(3)
    groups = {g: [rng.choice([1, 5, 70_000, 70_001, 10**9, rng.randrange(1, 10**7)]) for _ in range(n)]
              for g, n in enumerate([1, 2, 3, 4, 50, 501])}
    rows = [(str(g), v, "toman", "s") for g, vs in groups.items() for v in vs] + [("none", 0, "toman", "s")]
    df = spark.createDataFrame(rows, "part_id string, price_raw long, currency_unit string, seller_name_norm string")
    got = {r.part_id: r.median for r in summaries.exact_median(df, ["part_id"], "price_raw").collect()}
    std = {r.part_id: r.price_std_dev for r in summaries.price_deviation(df, ["part_id"], two_stage=False).collect()}
    for g, vs in groups.items():
        assert got[str(g)] == int(statistics.median(vs))
        assert std[str(g)] == (int(statistics.stdev(vs)) if len(vs) > 2 else 0)
    assert std["none"] == 0


def _offers(spark):
    rows = [
        (1, "1", "پارت سنتر", 1500000, "toman", "u1"), (2, "1", "یدک شاپ", 1450000, "toman", "u2"),
        (3, "2", "پارت سنتر", 2500000, "toman", "u3"),
    ]
    return spark.createDataFrame(
        rows, "ord long, part_id string, seller_name_norm string, price_raw long, currency_unit string, product_url string"
    ).withColumns({"part_key": F.concat(F.lit("k"), "ord"), "part_name_norm": F.lit("n")})


def test_part_summary_golden(spark):
    out = summaries.sort_parts(summaries.part_summary(_offers(spark), ["ord"], two_stage=False)).collect()
    assert [tuple(r) for r in out] == [
        ("2", "k3", "n", 1, 1, 2500000, 2500000, 2500000, 2500000, 0, "u3"),
        ("1", "k1", "n", 2, 2, 1475000, 1475000, 1450000, 1500000, 0, "u1\nu2"),
    ]


def test_absent_and_empty_sellers_differ(spark):
    df = spark.createDataFrame([(None, 5, 0, "a"), ("", 7, 0, ""), ("", 0, 1, None)],
                               "seller_name_norm string, price_toman long, price_missing int, product_url string")
    rows = {r.seller_name_norm: r for r in summaries.sellers_summary(df).collect()}
    assert rows["UNKNOWN_SELLER"].validation_urls == "Product 1: a"
    assert (rows[""].offers_count, rows[""].avg_price_toman) == (2, 7)
    assert rows[""].validation_urls == fv.NO_URLS_TEXT


def test_median_of_large_values_and_a_hot_part(spark):
    """Values up to 2^62, a third of all rows in one part: no task sorts or holds a part."""
    rng = random.Random(8)
    rows = [("hot" if i % 3 == 0 else str(i % 40), rng.choice([rng.randrange(1 << 62), rng.randrange(50), 7])) for i in range(6000)]
    rows += [("even", 1), ("even", 4), ("big", (1 << 62) - 1), ("big", 1 << 62), ("none", None), ("zero", 0)]
    df = spark.createDataFrame(rows, "part_id string, v long")
    found = summaries.exact_median(df, ["part_id"], "v")
    want = {}
    for p in {p for p, v in rows if v is not None}:
        vs = sorted(v for q, v in rows if q == p and v is not None)
        lo, hi = vs[(len(vs) + 1) // 2 - 1], vs[len(vs) // 2]
        want[p] = lo + (hi - lo) // 2
    assert {r.part_id: r.median for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert summaries.exact_median(df.limit(0), ["part_id"], "v").collect() == []


def test_distinct_counts_expand_no_rows(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), (None, "1"), ("b", None)], "seller_name_norm string, part_id string")
    counts = summaries.export_counts(df)
    assert [tuple(r) for r in counts.collect()] == [(4, 3, 2)]
    assert [tuple(r) for r in summaries.export_counts(df.limit(0)).collect()] == [(0, 0, 0)]
    assert "Expand" not in counts._jdf.queryExecution().executedPlan().toString()


def test_part_summary_reads_offers_once(spark):
    rows = [(str(i % 3), i, f"s{i % 4}", i * 10, 0, f"u{i % 5}", f"k{i}", f"n{i}") for i in range(30)]
    df = spark.createDataFrame(
        rows, "part_id string, ord long, seller_name_norm string, price_toman long, price_missing int, product_url string, part_key string, part_name_norm string"
    )
    out = summaries.part_summary(df, ["ord"]).orderBy("part_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "ExistingRDD" not in plan  # only the written pieces
    got = out.collect()
    assert [(r.part_key, r.part_name_norm, r.offers_count, r.seller_count) for r in got] == [
        (f"k{p}", f"n{p}", 10, 4) for p in range(3)
    ]
    for r in got:
        vs = [v[3] for v in rows if v[0] == r.part_id and v[3] > 0]
        assert (r.median_price_toman, r.min_price_toman, r.max_price_toman) == (int(statistics.median(vs)), min(vs), max(vs))


def test_outliers_need_three_priced_parts(spark):
    def flags(amps):
        df = spark.createDataFrame(
            [(str(i), a, a, a, a) for i, a in enumerate(amps)],
            "part_id string, AMP_toman long, median_price_toman long, min_price_toman long, max_price_toman long",
        )
        return [r.max_price_outlier for r in summaries.with_outlier_flags(df).orderBy(F.col("part_id").cast("int")).collect()]

    assert flags([100, 100000]) == [False, False]
    assert flags([100] * 9 + [100000]) == [False] * 9 + [True]


def _cards(spark, rows):
    return spark.createDataFrame(
        [(p, i, u, f"t{i}") for i, (p, u) in enumerate(rows)], "part_id string, card_ord int, product_url string, title_raw string"
    ).withColumns({
        "seller_name": F.lit("raw"), "price_raw": F.lit(1).cast("long"), "price_text": F.lit(""),
        "currency_unit": F.lit("toman"), "seller_url": F.lit("c"), "availability": F.lit(""),
        "attributes": F.struct(F.lit("x").alias("side")),
    })


@pytest.mark.parametrize("salting", [{}, {"share": 0.01, "min_rows": 2, "salts": 4}])
def test_drill_down_with_a_hot_page(spark, salting):
    cards = _cards(spark, [("1", "hot"), ("2", "hot"), ("3", "one"), ("4", "none"), ("5", ""), ("6", None)])
    rows = [("hot", i, f"فروشگاه s{i}", i, "x", "rial", "pu", "") for i in range(200)] + [("one", 0, None, None, "", "unknown", "", "")]
    page = spark.createDataFrame(
        rows, "product_url string, offer_pos int, seller_name string, price_raw long, price_text string, currency_unit string, seller_url string, availability string"
    )
    out = offers.drill_down(cards, page, **salting).collect()
    per_part = {p: [r for r in out if r.part_id == p] for p in "123456"}
    assert [len(per_part[p]) for p in "123456"] == [200, 200, 1, 1, 1, 1]
    assert sorted(r.offer_pos for r in per_part["1"]) == list(range(200))
    hot = per_part["1"][0]
    assert hot.drilled_down and hot.seller_name is None and hot.attributes is None and hot.seller_name_norm.startswith("s")
    assert per_part["3"][0].seller_name_norm == "" and per_part["3"][0].drilled_down
    for p in "456":
        kept = per_part[p][0]
        assert not kept.drilled_down and kept.seller_name_norm is None and kept.seller_name == "raw" and kept.attributes


def test_hot_keys_have_bins_by_their_own_size(spark):
    rows = [("third",)] * 4000 + [("warm",)] * 150 + [(f"k{i % 2000}",) for i in range(7850)] + [(None,)] * 50
    df = spark.createDataFrame(rows, "k string")
    bins = dict(skew.hot_keys(df, "k", share=0.01, min_rows=10, salts=64).collect())
    assert bins == {"third": 34, "warm": 2}
    assert dict(skew.hot_keys(df, "k", share=0.01, min_rows=10, salts=8).collect()) == {"third": 8, "warm": 2}
    left = spark.createDataFrame([("third", 1), ("warm", 2), ("k5", 3), (None, 4), ("none", 5)], "k string, l int")
    joined = skew.salted_left_join(left, df.withColumn("r", F.monotonically_increasing_id()), "k", [F.col("l")], [F.col("r")], 0.01, 10)
    got = {r.l: (r.n, r.d) for r in joined.groupBy("l").agg(F.count("*").alias("n"), F.count_distinct("r").alias("d")).collect()}
    assert got == {1: (4000, 4000), 2: (150, 150), 3: (got[3][0], got[3][0]), 4: (1, 0), 5: (1, 0)} and got[3][0] >= 3


def test_caps_are_limited_before_the_shuffle(spark):
    cards = _cards(spark, [("1", "u")] * 30)
    capped = offers.first_cards(cards, 7)
    assert sorted(r.card_ord for r in capped.collect()) == list(range(7))
    assert "WindowGroupLimit" in capped._jdf.queryExecution().executedPlan().toString()


def test_prices(spark):
    df = spark.createDataFrame([(5, "rial"), (None, "rial"), (0, "toman"), (-3, "toman"), (7, "unknown")], "price_raw long, currency_unit string")
    assert [tuple(r) for r in offers.toman_only(df).collect()] == [(0, "toman"), (7, "unknown")]
    dual = offers.with_dual_prices(df).select("price_toman", "price_rial", "price_missing").collect()
    assert [tuple(r) for r in dual] == [(0, 5, 0), (0, 0, 1), (0, 0, 1), (-3, 0, 1), (7, 70, 0)]


def _page(spark, *sources):
    return spark.createDataFrame([(i, f"u{i}", s) for i, s in enumerate(sources)], "page_id long, url string, html string")


def test_embedded_json_and_fallback(spark):
    script = '<script src="a"></script><script id="__NEXT_DATA__">%s</script>'
    good = script % '{"props":{"pageProps":{"products":[{"name1":"","name2":"T","price":12.9,"price_text":"۱ تومان","web_client_absolute_url":"/p/1","shop_text":"در الف، ب","stock_status":null},{"name1":"","price":0}]}}}'
    broken = script % '{"props":{"pageProps"}' + '<div><a href="/p/9">A long title</a><span>10 ریال</span></div>'
    empty = '<div class="empty-state"></div><a href="/p/9">A long title</a>'
    out = {r.url: r for r in pages.search_cards(_page(spark, good, broken, empty), "https://b").collect()}
    assert set(out) == {"u0", "u1"}
    assert (out["u0"].title_raw, out["u0"].price_raw, out["u0"].currency_unit, out["u0"].seller_name) == ("T", 12, "toman", "الف")
    assert out["u0"].product_url == "https://b/p/1" and out["u0"].availability == ""
    assert (out["u1"].title_raw, out["u1"].price_raw, out["u1"].currency_unit) == ("A long title", 10, "rial")


def test_product_page_cascade(spark):
    first = '<div class="seller-offer"><p class="seller-x">S<p class="cost">5,000 تومان</p><a href="/x">a</a><a href="/seller/3">b</a></div>'
    nothing = "<p>no offers</p>"
    generic = '<ul><li class="price">7<li class="price">call</ul>'
    out = pages.page_offers(_page(spark, first, nothing, generic), "https://b").orderBy("product_url", "offer_pos").collect()
    assert [(r.product_url, r.seller_name, r.price_raw, r.seller_url) for r in out] == [("u0", "S", 5000, "https://b/seller/3")]


def test_parts_csv(spark, tmp_path):
    path = tmp_path / "parts.csv"
    path.write_text('part_id,part_name,part_code,keywords\n1, Lamp ,c,kw\nx,Lamp,c,kw\n0,Lamp,c,kw\n3,"A, ""B""",,\n4,Door,,d\n', encoding="utf8")
    good, bad = parts_source.read_parts(spark, str(path))
    assert [tuple(r) for r in good.orderBy("part_ord").collect()] == [("1", 0, "Lamp", "c", "kw"), ("4", 4, "Door", "", "d")]
    assert bad.count() == 3
    lenient = parts_source.read_parts_lenient(spark, str(path), "t").orderBy("part_ord").collect()
    assert [r.part_id for r in lenient] == [f"part_{i}_t" for i in range(1, 6)]
    assert lenient[3].keywords == 'A, "B" automotive part'
    raw = parts_source.scan_csv(spark, str(path))
    assert parts_source.is_valid_input(raw) and parts_source.missing_columns(raw.drop("keywords")) == ["keywords"]
    assert not parts_source.is_valid_input(raw.limit(0))
    rows = parts_source.parts_from_rows(spark, [{"part_id": 7, "part_name": "n", "keywords": "k"}])
    assert tuple(rows.first()) == ("7", 0, "n", "", "k")


def test_row_numbers_over_many_files(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"f{i}.csv").write_text("v\n" + "".join(f"{i * 100 + j}\n" for j in range(40)))
    df = parts_source.with_row_number(parts_source.scan_csv(spark, str(tmp_path)))
    got = [int(r.v) for r in df.orderBy("row_number").collect()]
    assert got == sorted(got) and df.agg(F.max("row_number")).first()[0] == 200


def test_snapshots(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("search", "A ", t), ("search", "a", t - dt.timedelta(hours=1)), ("search", "b", t + dt.timedelta(seconds=1)), ("search", "c", None)]
    known = snapshots.with_key(spark.createDataFrame(rows, "cache_type string, query string, cached_at timestamp"))
    asked = spark.createDataFrame([("search", q) for q in ["a", " A", "b", "c", "d"]], "cache_type string, query string")
    asked = snapshots.with_key(asked)
    assert snapshots.latest(known).count() == 3
    # exactly at the end of its life a snapshot is stale
    assert [r.query for r in snapshots.reusable(asked, known, now()).collect()] == ["b"]
    assert snapshots.to_fetch(asked, known, now()).count() == 4
    assert tuple(snapshots.statistics(asked, known, now()).first()) == (1, 4, 1, 20.0)
    assert tuple(snapshots.statistics(asked.limit(0), known, now()).first()) == (0, 0, 0, 0.0)
    doc = '{"cached_at":"2024-01-01T00:00:00.123456","cache_type":"search","query":"q","data":[{"title_raw":"t"}]}'
    (tmp_path / "s.json").write_text(doc + "\n" + doc[:-9] + "\n")
    read, broken = snapshot_source.read_snapshots(spark, str(tmp_path / "s.json"), multi_line=False)
    (row,) = read.collect()
    assert row.cached_at.microsecond == 123456 and row.cache_key.startswith("search_") and broken.count() == 1
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "a.json").write_text(json.dumps(json.loads(doc), indent=2))
    (tmp_path / "whole" / "b.json").write_text(doc[:-9])
    read, broken = snapshot_source.read_snapshots(spark, str(tmp_path / "whole"))
    assert [r.query for r in read.collect()] == ["q"] and [r.document for r in broken.collect()] == [doc[:-9]]


def test_a_report_that_fails_leaves_the_one_before(spark, tmp_path):
    df = _offers(spark)
    path = str(tmp_path / "r")
    reports.write_report({n: df for n in reports.REPORT_TABLES}, path)
    broken = df.withColumn("product_url", F.expr("raise_error('lost')"))
    with pytest.raises(Exception, match="lost"):
        reports.write_report({"offers_raw": df.limit(1), "sellers_summary": df.limit(1), "part_summary": broken}, path)
    assert [t.count() for t in reports.read_report(spark, path).values()] == [3, 3, 3]
    earlier = reports.read_report(spark, path)
    for _ in range(2):
        assert earlier["offers_raw"].count() == 3  # the report before stays for its readers
        reports.write_report({n: df.limit(2) for n in reports.REPORT_TABLES}, path, csv=True)
    assert [t.count() for t in reports.read_report(spark, path).values()] == [2, 2, 2]
    assert reports.read_report(spark, path)["offers_raw"].columns == df.columns
    whole = [f for f in commits.folders(spark, path)]
    assert len(whole) == 3  # the last two reports, and what the failed run left


def test_snapshots_before_and_after_compaction(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    data = "array(named_struct('price_raw', cast({} as long))) AS data"

    def write(day, keys, price):
        rows = spark.range(*keys).selectExpr("'search' AS cache_type", "concat('q', id) AS query", data.format(price))
        empty = spark.createDataFrame([], schemas.SNAPSHOT).select("cache_type", "query", "data")
        shaped = rows.withColumn("data", F.col("data").cast("array<struct<price_raw:bigint>>"))
        full = empty.unionByName(shaped.withColumn("data", F.from_json(F.to_json("data"), empty.schema["data"].dataType)))
        return snapshot_source.write_snapshots(full, path, F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp"))

    def prices():
        rows = snapshots.latest(snapshot_source.read_snapshot_table(spark, path)).collect()
        return {r.query: r.data[0].price_raw for r in rows}

    assert snapshot_source.read_snapshot_table(spark, path).count() == 0
    assert snapshot_source.compact_snapshots(spark, path) == 0
    write(1, (0, 40), 1)
    write(2, (20, 60), 2)
    want = {f"q{i}": 1 if i < 20 else 2 for i in range(60)}
    assert prices() == want and snapshot_source.read_snapshot_table(spark, path).count() == 80
    assert snapshot_source.compact_snapshots(spark, path, buckets=4) == 2
    assert prices() == want and snapshot_source.read_snapshot_table(spark, path).count() == 60
    before = commits.current(spark, path)[1]["buckets"]
    write(3, (5, 6), 3)  # one key: one bucket is written again
    assert prices() == want | {"q5": 3} and snapshot_source.read_snapshot_table(spark, path).count() == 61
    late = write(1, (5, 6), 0)  # an older result that comes late changes nothing
    assert snapshot_source.compact_snapshots(spark, path, buckets=99) == 2
    after = commits.current(spark, path)[1]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert prices() == want | {"q5": 3} and snapshot_source.read_snapshot_table(spark, path).count() == 60
    write(4, (100, 101), 4)
    assert snapshot_source.compact_snapshots(spark, path) == 1
    assert late not in commits.folders(spark, f"{path}/delta")
    assert prices() == want | {"q5": 3, "q100": 4}


def test_two_commits_of_one_number(spark, tmp_path):
    path = str(tmp_path)
    assert commits.current(spark, path) == (0, None)
    assert commits.commit(spark, path, 0, {"a": 1}) and not commits.commit(spark, path, 0, {"a": 2})
    assert commits.current(spark, path) == (1, {"a": 1})
    (tmp_path / "_commits" / "000000000002").write_text("")  # its writer was lost
    assert commits.current(spark, path) == (2, {"a": 1})
    assert commits.commit(spark, path, 2, {"a": 3}) and commits.current(spark, path) == (3, {"a": 3})


def test_report_round_trip_and_audit(spark, tmp_path):
    df = _offers(spark)
    tables = {"offers_raw": df, "sellers_summary": df.limit(0), "part_summary": df}
    path = reports.write_report(tables, str(tmp_path / "r"))
    assert reports.read_report(spark, path)["part_summary"].count() == 3
    reports.write_report(tables | {"sellers_summary": df}, path)
    reports.write_report(tables, path)
    assert reports.read_report(spark, path)["sellers_summary"].count() == 0
    assert reports.read_report(spark, str(tmp_path / "none")) == {}
    found = {(r.table_name, r.found) for r in audit_job.audit_report(spark, str(tmp_path / "none")).collect()}
    assert found == {("offers_raw", False), ("sellers_summary", False), ("part_summary", False)}
    rows = audit.completeness(df.withColumn("e", F.lit("")), ["product_url", "e", "missing"], "t").collect()
    assert [tuple(r) for r in rows] == [("t", "product_url", True, 3, 3), ("t", "e", True, 0, 3), ("t", "missing", False, None, None)]
