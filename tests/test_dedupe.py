"""Deduplication against a plain replay of its rules on small random blocks."""

import random

import pytest
from pyspark.sql import functions as F

from marketlens.operators import dedupe, similarity, summaries

SCHEMA = (
    "ord long, part_id string, seller_name string, title_raw string, price_raw long, product_url string, "
    "seller_url string, availability string, currency_unit string"
)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def offer(i, title, price, filled=0, part="1", seller="s"):
    """`filled` of the four optional fields are given."""
    extra = ["u" if n < filled else "" for n in range(3)] + ["toman" if filled > 3 else "unknown"]
    return (i, part, seller, title, price, *extra)


def alike(a, b):
    ta, tb, pa, pb = a[3], b[3], a[4] or 0, b[4] or 0
    if ta and tb:
        if min(len(ta), len(tb)) / max(len(ta), len(tb)) < 0.7:
            return False
        wa, wb = set(ta.split()), set(tb.split())
        if len(wa & wb) / len(wa | wb) < 0.6:
            return False
    return not (pa > 0 and pb > 0 and abs(pa - pb) / max(pa, pb) > 0.05)


def score(o):
    return (
        2 * bool(o[3]) + 3 * bool(o[4]) + 2 * bool(o[2]) + sum(bool(x) for x in o[5:8])
        + (o[8] not in ("", "unknown"))
    )


def replay(rows):
    """One list of kept rows and one of standing rows, by the letter of the rules."""
    kept, standing = [], []
    sig = lambda o: (o[1], o[2], o[3], o[4] or 0)
    same_block = lambda a, b: a[1:3] == b[1:3]
    for row in sorted(rows):
        twin = [i for i, o in enumerate(standing) if sig(o) == sig(row)]
        if twin:
            if score(row) > score(standing[twin[0]]):
                standing[twin[0]] = row
                kept = [o for o in kept if sig(o) != sig(row)] + [row]
            continue
        near = next((o for o in standing if same_block(o, row) and alike(o, row)), None)
        if near is None:
            standing.append(row)
            kept.append(row)
        elif score(row) > score(near):
            standing.remove(near)
            standing.append(row)
            kept = [o for o in kept if not (same_block(o, near) and alike(o, near))] + [row]
    return sorted(o[0] for o in kept)


def kept_ids(spark, rows, **options):
    out = dedupe.deduplicate(frame(spark, rows).repartition(5), ["ord"], **options)
    return sorted(r.ord for r in out.select("ord").collect())


def random_rows(seed, n=900, parts=25):
    rng = random.Random(seed)
    titles = ["red plate", "red plate new", "red plate new big", "blue rod", "blue rod old", "", "plate red"]
    prices = [0, 0, 1000, 1030, 1060, 1100, 2000, 5000, None]
    return [
        offer(i, rng.choice(titles), rng.choice(prices), rng.randrange(5), str(rng.randrange(parts)), rng.choice(["s", "r"]))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_replay(spark, seed):
    rows = random_rows(seed)
    assert kept_ids(spark, rows) == replay(rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_many_copies_in_one_block(spark, seed):
    """One block, few signatures, each many times: rounds of fetched copies."""
    rows = random_rows(seed, n=400, parts=1)
    assert kept_ids(spark, rows) == replay(rows)


def test_large_blocks_are_cut_at_price_gaps(spark):
    rng = random.Random(9)
    rows = [
        offer(i, rng.choice(["red plate", "red plate new", "blue rod"]), rng.choice([100, 103, 400, 420, 900, 5000]),
              rng.randrange(5), str(rng.randrange(3)))
        for i in range(500)
    ]
    assert kept_ids(spark, rows, large_block=10) == replay(rows)


@pytest.mark.parametrize("seed", [11, 12])
def test_pieces_of_blocks_with_unpriced_and_untitled_offers(spark, seed):
    rng = random.Random(seed)
    names = [f"{a} {b} {c}" for a in ("red", "blue", "old") for b in ("rod", "plate") for c in "xyz"]
    rows = [
        offer(i, rng.choice(names + ["", "rod x"] * (seed - 11)), rng.choice([0, None, -3, 100, 104, 400, 412, 900, 5000, 5100]),
              rng.randrange(5), str(rng.randrange(2)))
        for i in range(500)
    ]
    assert kept_ids(spark, rows, large_block=10) == replay(rows)


def test_one_part_with_a_third_of_all_rows(spark):
    """Some of its offers have no price: they tie alike titles, not the whole part."""
    rng = random.Random(13)
    rows = []
    for i in range(3000):
        part = "hot" if i % 3 == 0 else str(rng.randrange(100))
        kind = rng.randrange(120)
        title = f"name{kind} kind{kind} type{kind % 7}" + rng.choice(["", " new", " old"])
        rows.append(offer(i, title, rng.choice([0, None]) if i % 30 == 0 else rng.choice([100, 102, 300, 900]) * 10, rng.randrange(5), part))
    events = dedupe._with_bucket(
        similarity.with_signature(frame(spark, rows)).withColumn("completeness", similarity.completeness_score())
    )
    pieces = dedupe._with_pieces(events, dedupe._large_blocks(events, 500))
    hot = pieces.where("part_id = 'hot'").groupBy("piece").count().collect()
    assert sum(r["count"] for r in hot) == 1000 and len(hot) > 100 and max(r["count"] for r in hot) < 40
    assert kept_ids(spark, rows, large_block=500) == replay(rows)


def test_ghost(spark):
    """A is replaced by C, which takes B out of the result; B still holds off E."""
    rows = [
        offer(1, "a b c d e f g", 1000, 0), offer(2, "a b c d e h i", 1050, 0),
        offer(3, "a b c d e f g h i", 1020, 1), offer(4, "a b c d e f g h", 1010, 2),
        offer(5, "a b c d e h j", 1100, 0),
    ]
    assert kept_ids(spark, rows) == replay(rows)


def test_worked_example(spark):
    rows = [
        (1, "1", "فروشگاه پارت سنتر", "چراغ جلو چپ تیگو 8 پرو مکس", 1500000, "p1", "", "", "unknown"),
        (2, "1", "پارت سنتر", "چراغ جلو چپ تیگو ۸ پرو مکس اصل", 1500000, "p1", "", "", "unknown"),
        (3, "1", "یدک شاپ", "چراغ جلو چپ تیگو 8 پرو مکس", 1450000, "p2", "", "", "unknown"),
        (4, "2", "فروشگاه پارت سنتر", "سپر جلو تیگو 8", 2500000, "p3", "", "", "unknown"),
    ]
    df = dedupe.normalize_offers(frame(spark, rows))
    kept = dedupe.deduplicate(df, ["ord"], F.col("seller_name_norm"), F.col("title_norm"))
    assert sorted(r.ord for r in kept.collect()) == [1, 3, 4]
    stats = {r.seller_name_norm: r for r in summaries.seller_statistics(kept).collect()}
    assert tuple(stats["پارت سنتر"])[1:] == (2, 2000000, 1500000, 2500000, "p1, p3", 2)
    assert tuple(stats["یدک شاپ"])[1:] == (1, 1450000, 1450000, 1450000, "p2", 1)


def test_exact_keeps_most_complete_then_earliest(spark):
    rows = [offer(1, "x", 10, 1), offer(2, "x", 10, 3), offer(3, "x", 10, 3), offer(4, "y", 10, 0)]
    out = dedupe.exact_dedupe(frame(spark, rows), ["ord"])
    assert sorted(r.ord for r in out.collect()) == [2, 4]


def brute_pairs(rows):
    classes = {}
    for o in rows:
        key = (o[1], o[2], o[3], o[4] or 0)
        classes[key] = classes.get(key, 0) + 1
    out = []
    keys = sorted(classes)
    for i, a in enumerate(keys):
        if classes[a] > 1:
            out.append((*a, *a[2:], classes[a] * (classes[a] - 1) // 2))
        for b in keys[i + 1:]:
            if a[:2] == b[:2] and alike((0, *a), (0, *b)):
                out.append((*a, *b[2:], classes[a] * classes[b]))
    return sorted(out)


@pytest.mark.parametrize("small_block", [0, 3, 1000])
def test_pairs_equal_brute_force(spark, small_block):
    rows = random_rows(7, n=600, parts=4)
    got = similarity.similar_pairs(frame(spark, rows), small_block=small_block)
    got = got.select("part_id", "seller_canonical", "title_a", "price_a", "title_b", "price_b", "pairs")
    assert sorted(tuple(r) for r in got.collect()) == brute_pairs(rows)


def test_banded_join_has_no_cross_product(spark):
    plan = similarity.similar_pairs(frame(spark, random_rows(1)))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
