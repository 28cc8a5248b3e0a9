"""Fingerprints and their classes against plain loops."""

import random
import time
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marketlens.llm import simhash
from marketlens.llm.components import connected_components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\x09\x0a\x0b\x0c\x0d":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(fps))]


def texts(n, seed):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(60)] + ["Ä", "É x", "ABC"]
    out = [None, "", " \t", "one", "one two", "One  two\nthree", "\x1cx\x85y"]
    while len(out) < n:
        base = [r.choice(words) for _ in range(r.randrange(3, 150))]
        out.append(" ".join(base))
        for _ in range(r.randrange(4)):
            copy = list(base)
            copy[r.randrange(len(copy))] = r.choice(words)
            out.append(r.choice([" ", "\n"]).join(copy))
    return out[:n]


def test_fingerprints():
    for text in texts(200, 1) + [" ".join(str(i) for i in range(70_000))]:
        assert simhash.fingerprint(text or "") == plain_fingerprint(text)


def test_hash_is_that_of_spark(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b ç")).alias("h")).first().h
    assert got % 2**64 == xxhash.xxh64_intdigest("a b ç".encode(), 42)


def labels(values, edges):
    """Number of the smallest member that edges lead to, for each value."""
    where, parent = {int(x): i for i, x in enumerate(values)}, list(range(len(values)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in edges.tolist():
        x, y = root(where[a]), root(where[b])
        parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("size", [1, 2, 500, 1024, 1025, 2500])
@pytest.mark.parametrize("spread", [14, 24, 40])
def test_links_equal_all_pairs(size, spread):
    r = np.random.default_rng(size)
    v = np.unique(np.uint64(0xABCDEF0123000000) ^ r.integers(0, 1 << spread, size).astype(np.uint64))
    edges = simhash.spanning_links(v)
    assert np.all(np.bitwise_count(edges[:, 0] ^ edges[:, 1]) <= 3) and len(edges) < len(v)
    assert labels(v, edges) == plain_classes(v.tolist())


def test_a_list_of_100_000_members():
    """Random members of one list, and clusters: under a minute, and whole by a sample against all."""
    r = np.random.default_rng(1)
    some = r.integers(0, 1 << 24, 60_000)
    near = some[:50_000] ^ (1 << r.integers(0, 24, 50_000)) ^ (1 << r.integers(0, 24, 50_000))
    v = np.unique(np.uint64(0xABCDEF0123000000) | np.concatenate([some, near]).astype(np.uint64))
    start = time.monotonic()
    edges = simhash.spanning_links(v)
    assert time.monotonic() - start < 60 and len(v) > 100_000 and len(edges) < len(v)
    assert np.all(np.bitwise_count(edges[:, 0] ^ edges[:, 1]) <= 3)
    label = np.array(labels(v, edges))
    for i in r.integers(0, len(v), 400):
        assert (label[np.bitwise_count(v ^ v[i]) <= 3] == label[i]).all()


def test_classes(spark):
    rows = [(i * 13 % 401, t) for i, t in enumerate(texts(400, 2))] + [(None, "one"), (7, "w1 w2"), (7, "w1 w2")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, root string")
    got = {}
    for r in simhash.near_duplicates(df.repartition(6)).collect():
        got.setdefault(r.doc_id, set()).add((r.fp % 2**64, r.component_id))
    fps = [plain_fingerprint(t) for _, t in rows]
    classes = plain_classes(fps)
    least = {}
    for c, (i, _) in zip(classes, rows):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = {}
    for c, f, (i, _) in zip(classes, fps, rows):
        want.setdefault(i, set()).add((f, least.get(c)))
    assert got == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(df.limit(0)).collect() == [] and simhash.keep_one(df.limit(0)).collect() == []


def test_components(spark):
    r = random.Random(5)
    nodes = list(range(0, 3000, 3))
    edges = [(a, a + 3) for a in range(0, 300, 3)] + [(r.choice(nodes), r.choice(nodes)) for _ in range(500)]
    edges += [(999, n) for n in range(1500, 2400, 3)] + [(6, 6), (9, 6), (6, 9)]
    parent = {n: n for e in edges for n in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: root(n) for n in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
