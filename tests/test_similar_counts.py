"""Near-duplicate counts against a comparison of all signatures."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marketlens.operators import similarity
from test_dedupe import alike, frame, offer, random_rows


def plain(rows):
    counts = Counter((r[1], r[2], r[3], r[4] or 0) for r in rows)
    blocks = defaultdict(list)
    for sig in counts:
        blocks[sig[:2]].append(sig)
    out = []
    for sig, n in counts.items():
        near = [o for o in blocks[sig[:2]] if o != sig and alike((0, *sig), (0, *o))]
        first = min((o[2:] for o in near), default=(None, None))
        out.append((*sig, n, sum(counts[o] for o in near) + n - 1, *first))
    return sorted(out, key=str)


def counted(spark, rows):
    return sorted(map(tuple, similarity.similar_counts(frame(spark, rows).repartition(4)).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    assert counted(spark, random_rows(seed)) == plain(random_rows(seed))


def test_prices_at_the_limit(spark):
    """One block with runs of neighbouring prices, none, and negative ones."""
    r = random.Random(3)
    prices = [*range(1, 60), *range(995, 1060, 1), *range(99_990, 100_010), 95_000, 105_263, 105_264, 0, 0, -5, None, 2**52, 2**52 - 2**48]
    titles = ["", "red plate", "red plate new", "blue rod", "plate red x y z"]
    rows = [offer(i, r.choice(titles), r.choice(prices), part="1") for i in range(1200)]
    assert counted(spark, rows) == plain(rows)


def test_titles_at_the_limit(spark):
    r = random.Random(4)
    words = ["a", "bb", "cc", "dd", "ee", "ff", "gg"]
    rows = [offer(i, " ".join(r.sample(words, r.randrange(1, 7))), r.choice([100, 104, 0]), part="1") for i in range(500)]
    assert counted(spark, rows) == plain(rows)


def test_no_pairs_are_formed(spark):
    """Copies, near prices and missing prices of one title: rows in the plan stay linear."""
    n = 3000
    rows = [offer(i, "red plate", 100_000 + i if i % 3 else 0, part="1") for i in range(n)]
    classes = similarity.signature_classes(frame(spark, rows))
    links = spark.createDataFrame([("1", "s", "red plate", "red plate"), ("1", "s", "red plate", "")], "part_id string, seller_canonical string, title_norm string, other string")
    assert similarity._questions(classes, links).count() < 14 * n
    got = similarity.similar_counts(frame(spark, rows)).agg(F.min("similar_offers"), F.max("similar_offers")).first()
    assert tuple(got) == (n - 1, n - 1)


def test_empty_table(spark):
    assert similarity.similar_counts(frame(spark, [])).collect() == []
