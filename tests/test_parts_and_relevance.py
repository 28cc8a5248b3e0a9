"""Classification and relevance goldens."""

import pytest
from pyspark.sql import functions as F

from marketlens.operators import offers, parts, sellers

PARTS = [
    ("چراغ جلو چپ تیگو 8 پرو مکس", "T8-HL-L-PM", "BODY:HEADLAMP:LEFT:MATRIX:PRO", "Tiggo8 Headlamp LEFT Pro MATRIX"),
    ("سپر جلو تیگو 8 کلاسیک", "T8-FB-CL", "BODY:BUMPER:LEFT:CLASSIC", "Tiggo8 Bumper LEFT Classic"),
    ("گلگیر جلو راست تیگو 8 پرو", "T8-FF-R-PR", "BODY:FENDER:RIGHT:PRO", "Tiggo8 Fender RIGHT Pro"),
    ("کاپوت تیگو 8", "T8-HD", "BODY:HOOD:UNKNOWN:UNKNOWN", "Tiggo8 Hood"),
    ("جلوپنجره تیگو 8 پرو مکس", "T8-GR-PM", "BODY:GRILLE:RIGHT:MATRIX:PRO", "Tiggo8 Grille RIGHT Pro MATRIX"),
    ("", "T8", "BODY:UNKNOWN:UNKNOWN:UNKNOWN", ""),
    ("رکاب", None, "BODY:RUNNING_BOARD:UNKNOWN:UNKNOWN", "Running_Board"),
    ("  ۱  ۲ ", None, "BODY:UNKNOWN:UNKNOWN:UNKNOWN", "1 2"),
]


def test_part_metadata(spark):
    df = spark.createDataFrame([(i, p[0], p[1]) for i, p in enumerate(PARTS)], "i int, part_name string, part_code string")
    rows = parts.with_extraction_check(parts.with_metadata(df)).orderBy("i").collect()
    assert [(r.part_key, r.part_name_norm) for r in rows] == [p[2:] for p in PARTS]
    assert rows[3].issues == ["Could not identify trim level"] and rows[3].extraction_valid
    assert not rows[5].extraction_valid


RELEVANCE = [
    ("چراغ جلو راست تیگو 8 پرو", "چراغ جلو راست تیگو 8", 0.9, "BODY:HEADLAMP:FRONT:UNKNOWN:PRO"),
    ("چراغ عقب تیگو 8", "چراغ جلو تیگو 8", None, None),
    ("سپر جلو تیگو 8 کلاسیک", "سپر جلو تیگو 8", 0.9, "BODY:FRONT_BUMPER:FRONT:UNKNOWN:CLASSIC"),
    ("مه‌شکن تیگو 8", "چراغ جلو تیگو 8", None, None),
    ("گلگیر جلو چپ تیگو 8 پرو مکس", "گلگیر جلو تیگو 8", 1.0, "BODY:FRONT_FENDER:FRONT:MATRIX:PRO_MAX"),
    ("راهنما تیگو 8", "چراغ جلو تیگو 8", None, None),
    ("کاپوت", "", 0.3, "BODY:HOOD:UNKNOWN:UNKNOWN:UNKNOWN"),
]


def _cards(spark):
    rows = [(i, r[0], r[1]) for i, r in enumerate(RELEVANCE)]
    return spark.createDataFrame(rows, "card_ord int, title_raw string, query string")


def test_relevance(spark):
    got = {r.card_ord: r for r in offers.keep_relevant(_cards(spark)).collect()}
    for i, (_, _, score, key) in enumerate(RELEVANCE):
        assert (i in got) == (score is not None)
        if score is not None:
            assert got[i].relevance == pytest.approx(score, abs=1e-9)
            assert got[i].part_key == key
    assert {r.card_ord for r in offers.keep_relevant(_cards(spark), 0.95).collect()} == {4}


def test_score_rows_keeps_rejected(spark):
    got = {r.card_ord: r for r in offers.score_rows(_cards(spark)).collect()}
    assert len(got) == len(RELEVANCE)
    assert got[1].kept is False and got[1].relevance == 0.0 and got[1].attributes is None


def test_text_expression_is_evaluated_once(spark):
    plan = offers.keep_relevant(_cards(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(trim(regexp_replace(lower(title_raw") == 1


def test_field_checks_and_filters(spark):
    df = spark.createDataFrame(
        [("1", "Lamp", "", "kw"), ("0", "Lamp", "", "kw"), ("2", "L", "c", " k"), ("3", " ", "cc", "kw"), (None, "Lamp", None, "kw")],
        "part_id string, part_name string, part_code string, keywords string",
    )
    good, bad = parts.split_valid(df)
    assert {r.part_id for r in good.collect()} == {"1", "0", None}
    assert {(r.part_id, r.valid_name, r.valid_code, r.valid_keywords) for r in bad.collect()} == {
        ("2", False, False, False), ("3", False, True, True),
    }
    assert {r.part_id for r in parts.complete_parts(df).collect()} == {"1", "2", "3"}
    assert parts.named_parts(df).count() == 4


def test_aliases(spark):
    names = ["فروشگاه پارت سنتر", "PartCenter", "Yadakshop", "یدک‌شاپ", "Other Shop", "", None, "فروشگاه"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, seller_name string")
    want = ["پارت سنتر", "پارت سنتر", "یدک شاپ", "یدک شاپ", "other", "UNKNOWN_SELLER", "UNKNOWN_SELLER", ""]
    inline = df.select("i", sellers.canonical_seller(F.col("seller_name")).alias("s")).orderBy("i")
    joined = sellers.with_canonical_seller(df, sellers.alias_table(spark), "s").orderBy("i")
    assert [r.s for r in inline.collect()] == want
    assert [r.s for r in joined.collect()] == want
    last = sellers.alias_table(spark, {"a": ["x"], "b": ["x"]})
    assert [tuple(r) for r in last.collect()] == [("x", "b")]
    assert df.where("i = 1").select(
        sellers.canonical_seller(F.col("seller_name"), {"a": ["partcenter"], "b": ["partcenter"]})
    ).first()[0] == "b"
