"""Raking against a plain loop."""

import hashlib
import math
import random
from collections import Counter

import pytest

from marketlens.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, probability string, topic string"


def documents():
    rows = []
    for i in range(1200):
        text = "word " * (i % 37 + 1) * (9 if i % 5 == 0 else 1)
        text = None if i % 97 == 0 else "1 2 3 4 " * 9 if i % 8 == 0 else text
        lang = None if i % 61 == 0 else ("en", "en", "de", "fr")[i % 4]
        rows.append((i if i % 83 else None, text, lang, "hot" if i % 3 == 0 else f"s{i % 5}", 1, "x", "y"))
    return rows + [(7, "again and again", "en", "rare", 1, "x", "y")] * 2


def topic(t):
    size = max(len(t), 1)
    if sum(c in "0123456789" for c in t) / size >= 0.03:
        return "figures"
    if sum(c in "#$%&*=<>{}|_" for c in t) / size >= 0.03:
        return "symbols"
    return "brief" if len(t) < 600 else "prose"


def plain(rows, targets):
    docs = [(r[0], r[3], r[2], topic(r[1] or ""), len((r[1] or "").split())) for r in rows]
    total = sum(d[4] for d in docs)
    sums = [Counter() for _ in range(3)]
    for d in docs:
        for k in range(3):
            sums[k][d[1 + k]] += d[4]
    cells = Counter()
    for d in docs:
        cells[d[1:4]] += d[4]
    w = {c: t / total for c, t in cells.items() if t}
    goal = []
    for k in range(3):
        own = Counter()
        for c, x in w.items():
            own[c[k]] += x
        raw = {v: x ** targets.exponents[k] for v, x in own.items()}
        low = {v: min(x / sum(raw.values()), own[v] * targets.boost) for v, x in raw.items()}
        goal.append({v: x / sum(low.values()) for v, x in low.items()})
    for _ in range(targets.max_rounds):
        for k in range(3):
            now = Counter()
            for c, x in w.items():
                now[c[k]] += x
            w = {c: x * goal[k][c[k]] / now[c[k]] for c, x in w.items()}
    level = 1 / max(w[c] / cells[c] for c in w) if targets.share is None else targets.share * total
    out = []
    for d in docs:
        c = d[1:4]
        p = level * w[c] / cells[c] if c in w else 1.0
        u = int(hashlib.md5(f"{'' if d[0] is None else d[0]}:{targets.seed}".encode()).hexdigest()[:13], 16) / 2**52
        out.append((str(d[0]), d[3], d[4], round(p, 6), math.floor(p + 1e-12) + (u < p - math.floor(p + 1e-12))))
    return sorted(out), goal


def reached(rows):
    """Expected share of every value of a dimension in the sample."""
    out = []
    for name in mixing.DIMENSIONS:
        now = Counter()
        for r in rows:
            now[r[name]] += r.n_tokens * r.probability
        out.append({v: x / sum(now.values()) for v, x in now.items() if x})
    return out


@pytest.mark.parametrize("options", [{}, {"boost": 1.5, "share": 0.9}])
def test_equals_plain_raking(spark, options):
    """Many cells are empty here, so rounds bring the marginals only near the targets."""
    targets = mixing.Targets(max_rounds=6, **options)
    df = spark.createDataFrame(documents(), SCHEMA)
    got = mixing.mix(df.repartition(5), targets).collect()
    want, goal = plain(documents(), targets)
    assert sorted((str(r.doc_id), r.topic, r.n_tokens, round(r.probability, 6), r.copies) for r in got) == want
    assert "share" in options or max(r.probability for r in got) <= 1
    for share, target in zip(reached(got), goal):
        assert share.keys() == target.keys() and all(abs(share[v] - x) < 0.05 for v, x in target.items())
    kept = mixing.sample(df, targets)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want for _ in range(w[4]))


def test_a_thousand_sources_and_a_hot_one(spark):
    """A third of all rows in one source, a thousand about equal ones, some very rare."""
    rows, r = [], random.Random(5)
    for i in range(12_000):
        source = "hot" if i % 3 == 0 else f"rare{i}" if i % 1000 == 1 else f"https://site{r.randrange(1000)}"
        text = "1 2 3 4 5 " * 20 if r.random() < 0.3 else "word " * r.randrange(90, 130)
        rows.append((i, text, r.choice(["en", "en", "de"]), source, 1, "x", "y"))
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    want, goal = plain(rows, mixing.Targets())
    assert len(goal[0]) > 900
    found = sorted((str(r.doc_id), r.topic, r.n_tokens, r.probability, r.copies) for r in got)
    assert [f[:3] + f[4:] for f in found] == [w[:3] + w[4:] for w in want]
    assert all(abs(f[3] - w[3]) < 2e-6 for f, w in zip(found, want))
    for share, target in zip(reached(got), goal):
        assert all(abs(share[v] - x) < 1e-6 for v, x in target.items())


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).collect() == [] and mixing.sample(df).collect() == []
    df = spark.createDataFrame([(1, None, None, None, 0, "", "")], SCHEMA)
    assert [r.kept for r in mixing.mix(df).collect()] == [True]
