"""Exact search against comparing everything."""

import math
import random

from marketlens.llm import topk


def plain(rows, k):
    good = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, tuple(math.floor(1024 * x) for x in v)))
    out = []
    for at, (q, qv) in enumerate(good):
        if q % 10:
            continue
        scored = [(-sum(a * b for a, b in zip(qv, v)), i) for n, (i, v) in enumerate(good) if n != at and len(v) == len(qv)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def search(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    return sorted(map(tuple, topk.exact_top_k(df.repartition(4), df.filter("vec_id % 10 = 0"), k=k).collect()))


def vectors(n, dim, seed, step=64):
    r = random.Random(seed)
    return [(i, [r.randrange(-step, step) / step for _ in range(dim)]) for i in range(n)]


def test_equals_plain_search(spark, monkeypatch):
    rows = vectors(300, 8, 1)
    rows += [(1000 + i, rows[0][1]) for i in range(12)]  # ties
    rows += [rows[5], rows[20], rows[20], (20, rows[7][1]), (2000, None), (2010, []), (2020, [float("nan")] * 8), (2030, [None] * 8), (None, rows[1][1])]
    rows += [(3000 + i, [0.5 * i, 0.25]) for i in range(15)] + [(4000, [0.0] * 8), (4010, [float("inf")] * 8)]
    assert search(spark, rows) == plain(rows, 5)
    for name, value in (("SEEDS", 20), ("CHUNK", 16), ("STEP", 3), ("QUERY_BYTES", 4000)):
        monkeypatch.setattr(topk, name, value)
    assert search(spark, rows) == plain(rows, 5)


def test_few_and_none(spark):
    assert search(spark, vectors(3, 4, 2)) == plain(vectors(3, 4, 2), 5)
    assert search(spark, []) == []


def test_bounds_save_work():
    import numpy as np

    r = np.random.default_rng(0)
    centres = r.integers(-900, 900, (20, 16))
    x = (centres[r.integers(0, 20, 4000)] + r.integers(-20, 20, (4000, 16))).astype(float)
    pivots = topk.spread_pivots(x[:500], 30)
    d = topk._distances(x, pivots)
    q, q_d = x[7], d[7]
    lower = np.abs(d - q_d).max(1)
    true = np.sqrt(((x - q) ** 2).sum(1))
    assert np.all(lower <= true + 1e-6)
    ids, scores = topk.search_chunk(-1, q, q_d, -np.inf, np.arange(4000), np.arange(4000), x, d, 10)
    order = np.lexsort((np.arange(4000), -(x @ q)))[:10]
    assert ids.tolist() == order.tolist() and scores.tolist() == (x @ q)[order].tolist()
