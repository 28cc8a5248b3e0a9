"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from marketlens.llm import spelling
from marketlens.llm.queries import QUERIES


def plain_words(rows, shortest=7, least=2):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_near(words):
    near = defaultdict(set)
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    for w in words:
        for v in by_length[len(w)] + by_length[len(w) + 1]:
            if one_edit(w, v):
                near[w].add(v)
                near[v].add(w)
    return near


def plain(rows, shortest=7, least=2, ratio=10):
    words = plain_words(rows, shortest, least)
    near = plain_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def random_words(n, seed, alphabet="abcé", low=7, high=12):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(low, high))) for _ in range(n)]


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.001").collect()))
    want = plain(rows)
    assert got == want
    assert sum(r[4] > 0 for r in want) > 100 and sum(r[1] is not None for r in want) >= 10


def edited(word, r, letters="abc"):
    at = r.randrange(len(word))
    return [word[:at] + word[at + 1 :], word[:at] + r.choice(letters) + word[at + 1 :], word[:at] + r.choice(letters) + word[at:], word + "a"]


@pytest.mark.parametrize("least, parts", [(0, 2000), (1, 50), (8, 100_000)])
def test_near_words_equal_all_pairs(spark, monkeypatch, least, parts):
    monkeypatch.setattr(spelling, "FREQUENT_LEAST", least)
    monkeypatch.setattr(spelling, "FREQUENT", parts)
    words = set(random_words(250, 1, "ab", 7, 11) + random_words(250, 2, "abcé", 3, 16))
    r = random.Random(3)
    words |= {v for w in list(words) for v in edited(w, r, "ab")}
    words |= {"a" * k for k in (1, 2, 20, 21, 23, 600, 601)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = [tuple(x) for x in spelling.near_words(df).collect()]
    want = {(a, b) for a, of in plain_near(words).items() for b in of if (len(a), a) < (len(b), b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_words_one_edit_apart_share_a_list():
    r = random.Random(5)
    for word in random_words(2000, 6, "ab", 1, 14):
        starts = [spelling._pieces(w)[0] for w in random_words(20, r.random(), "ab", 2, 6)]
        ends = [spelling._pieces(w)[1] for w in random_words(20, r.random(), "ab", 2, 6)]
        frequent = {h for hashes in starts + ends for h in hashes}
        for other in edited(word, r):
            assert spelling.lists_of(word, frequent) & spelling.lists_of(other, frequent), (word, other)


def test_cases(spark):
    base = "Variants variants VARIANTS éclairés ÉCLAIRÉS x×÷y" + " wonderful" * 300 + " wonderfull" * 20 + " wonderfulls wonderfulls"
    rows = [(1, base), (1, base), (None, "variants varients varients"), (2, None), (3, ""), (4, "a" * 9_000), (4, "a" * 9_000)]
    rows += [(5, "b" + "a" * 9_000)] * 2 + [(6, "no­word, abcdefg1abcdefg")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = sorted(map(tuple, spelling.variants(df).collect()))
    assert got == plain(rows)
    chain = {w: (form, root) for w, form, root, *_ in got}
    assert chain["wonderfulls"] == ("wonderfull", "wonderful")
    assert spelling.variants(df.limit(0)).collect() == []
