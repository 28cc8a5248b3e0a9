"""Planted items, and the alignment and latent space against plain versions."""

import random

import numpy as np

from marketlens.llm import decontamination as dc

R = random.Random(11)
SYLLABLES = ["ka", "lo", "mi", "tre", "un", "sto", "ber", "fi", "gan", "el"]
WORDS = ["".join(R.choice(SYLLABLES) for _ in range(R.randrange(3, 6))) for _ in range(3000)]


def prose(r, n):
    out = []
    while len(out) < n:
        s = [r.choice(WORDS) if r.random() < 0.6 else r.choice(["the", "of", "and", "in"]) for _ in range(r.randrange(6, 14))]
        out += s[:-1] + [s[-1] + "."]
    return out[:n]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def test_common_subsequence():
    r = random.Random(3)
    for _ in range(200):
        a = [r.randrange(6) for _ in range(r.randrange(1, 80))]
        b = [r.randrange(7) for _ in range(r.randrange(80))]
        assert dc.common_subsequence(np.array(a), np.array(b, int)) == plain_lcs(a, b)


def corpus():
    r = random.Random(7)
    items = [(i, " ".join(prose(r, r.randrange(14, 60)))) for i in range(60)]
    docs, planted = [], set()
    for d in range(400):
        words = prose(r, r.randrange(1, 700))
        if d % 4 == 0:
            i, text = items[r.randrange(60)]
            own = text.split()
            kind = d // 4 % 4
            if kind == 1:  # upper case and other signs
                own = [w.upper().replace(".", " !") for w in own]
            if kind == 2:  # a word put in after every seventh
                own = [x for n, w in enumerate(own) for x in ([w, r.choice(WORDS)] if n % 7 == 6 else [w])]
            if kind == 3:  # every eighth word replaced, the end kept
                own = [r.choice(WORDS) if n % 8 == 3 and n < len(own) - 8 else w for n, w in enumerate(own)]
            at = r.randrange(len(words) + 1)
            words = words[:at] + own + words[at:]
            planted.add((d, i))
        docs.append((d, " ".join(words), "x", "y"))
    return items, docs, planted


def lcs(a, b):
    numbers = {}
    code = lambda ws: np.array([numbers.setdefault(w, len(numbers)) for w in ws], int)
    return dc.common_subsequence(code(a), code(b))


def brute(items, docs, rule, common=frozenset(["the", "of", "and", "in"])):
    """Every document against every item, at every start."""
    found = set()
    for d, text, *_ in docs:
        words = dc.words_of(text or "")
        for i, item in items:
            own, answer = dc.words_of(item or ""), dc.words_of(dc.answer_of(item or ""))
            width = -(-13 * len(own) // 10)
            rare = [w for w in own if w not in common]
            if not own or len(set(rare) & set(words)) < 0.5 * len(set(rare)):
                continue
            for at in range(0, max(1, len(words) - width + 1)):
                part = words[at : at + width]
                if len(set(rare) & set(part)) < 0.5 * len(set(rare)):
                    continue
                share = min(lcs(own, part) / len(own), lcs(rare, [w for w in part if w not in common]) / len(rare))
                if share >= rule.alike or share >= rule.paraphrase and lcs(answer, part) / len(answer) >= rule.answer:
                    found.add((d, i))
                    break
    return found


def test_planted_items(spark):
    items, docs, planted = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string, words string").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(df, bench).collect()}
    assert got == planted == brute(items, docs, dc.Rule())
    kept = dc.without_leaks(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(range(400)) - {d for d, _ in planted}


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    items, docs, planted = corpus()
    monkeypatch.setattr(dc, "ITEMS_A_BLOCK", 25)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, a string, b string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.leaks(df, bench).collect()} == planted


def test_latent_space_holds_the_main_directions(spark, monkeypatch):
    monkeypatch.setattr(dc, "DIRECTIONS", 16)
    items, docs, _ = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, a string, b string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    block = next(dc.item_blocks(bench, "item_id", "text"))
    words = dc.encoded(df, block, "doc_id", "text").cache()
    idf = dc.idf_weights(words, block)
    basis = dc.latent_space(words, block, idf)
    assert basis.shape[1] == 16 and np.allclose(basis.T @ basis, np.eye(16), atol=1e-5)
    table = words.toArrow()
    document, passage, word, times = dc.passages(table.column("words").combine_chunks(), block.kind)
    a = np.zeros((len(document), len(idf)))
    a[passage, word] = (1 + np.log(times)) * idf[word]
    best = (np.linalg.svd(a, compute_uv=False)[:16] ** 2).sum()
    assert ((a @ basis) ** 2).sum() > 0.6 * best


def test_recall_of_the_candidate_search(spark):
    """Documents whose id is divisible by 20, every window aligned with every item: 0.9 of these leaks are found."""
    sf = "/root/testdata/sf0.01"
    bench, docs = spark.read.parquet(f"{sf}/benchmark.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    block = next(dc.item_blocks(bench, "item_id", "text"))
    idf = dc.idf_weights(dc.encoded(docs, block, "doc_id", "text"), block)
    assert dc.latent_space(dc.encoded(docs, block, "doc_id", "text"), block, idf).shape[1] < len(block.ids) / 2
    found = {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()}
    words = dc.encoded(docs, block, "doc_id", "text")
    content, rule, want = idf > 0, dc.Rule(), set()
    some = {d for d, _ in found}  # and all documents in which something was found
    for row in words.collect():
        if row.doc_id % 20 and row.doc_id not in some:
            continue
        text = dc.numbers_of(row.words, block.kind)
        for item, own, answer in zip(block.ids, block.words, block.answers):
            share, inside, _ = dc._aligned(own, answer, content, text, 0, len(text), rule.paraphrase)
            if share >= rule.alike or (share >= rule.paraphrase and inside >= rule.answer):
                want.add((row.doc_id, item))
    print("leaks by full alignment", len(want), "found of these", len(want & found), "found in all", len(found))
    assert len(want) > 10 and len(want & found) >= 0.9 * len(want)


def test_odd_rows(spark):
    items = [(1, None), (2, ""), (3, "!!!"), (None, "one two three four five six"), (4, "alpha beta gamma delta epsilon zeta eta"), (5, "alpha beta gamma delta epsilon zeta eta")]
    docs = [(1, None), (2, ""), (3, "alpha beta gamma delta epsilon zeta eta"), (3, "alpha beta gamma delta epsilon zeta eta"), (None, "x alpha beta gamma delta epsilon zeta eta y"), (4, "one two three four five six")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id or 0), r.item_id) for r in dc.leaks(df, bench).collect())
    assert got == [(0, 4), (0, 5), (3, 4), (3, 4), (3, 5), (3, 5)]
    assert sorted(r.doc_id for r in dc.without_leaks(df, bench).collect()) == [1, 2, 4]
    assert dc.leaks(df, bench.limit(0)).collect() == [] and dc.leaks(df.limit(0), bench).collect() == []
    assert dc.without_leaks(df, bench.limit(0)).count() == 6


def test_long_item_and_text(spark):
    r = random.Random(9)
    item = prose(r, 900)
    docs = [(1, " ".join(prose(r, 30_000) + item + prose(r, 500))), (2, " ".join(prose(r, 5000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [(x.doc_id, x.item_id) for x in dc.leaks(df, bench).collect()] == [(1, 1)]


def test_an_item_of_more_words_than_16_bits_count(spark):
    item = " ".join(f"w{i}x" for i in range(70_000))
    docs = spark.createDataFrame([(1, "a b c " + item + " d"), (2, "w1x w2x"), (3, None)], "doc_id long, text string")
    found = dc.leaks(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 9)]


def test_verbatim_runs_are_leaks(spark):
    """Cut ends, cut starts and middles; a shorter run, or one with a word put in, is none."""
    r = random.Random(21)
    items = [(i, " ".join(prose(r, n))) for i, n in enumerate([57, 59, 40, 30, 600, 45])]
    own = [t.split() for _, t in items]
    parts = {
        1: (0, own[0][:47]),
        2: (1, own[1][:46]),
        3: (2, own[2][20:]),
        4: (3, own[3][8 : 8 + dc.RUN]),
        5: (4, own[4][300:360]),
        6: (4, own[4][-dc.RUN :]),
        7: (5, own[5][10 : 10 + dc.RUN - 1]),
        8: (5, [*own[5][10:16], "between", *own[5][16:24]]),
    }
    docs = [(0, " ".join(prose(r, 300)))]
    for d, (_, part) in parts.items():
        docs.append((d, " ".join(prose(r, 25 * d) + [w.upper().replace(".", "!") for w in part] + prose(r, 200))))
    docs.append((9, " ".join(own[3][:dc.RUN])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in dc.leaks(df, bench).collect()}
    assert set(got) == {(d, i) for d, (i, _) in parts.items() if d < 7} | {(9, 3)}
    assert all(0 <= x.common <= 1 and 0 <= x.answer <= 1 and x.at_word <= len(docs[k[0]][1].split()) for k, x in got.items())
    assert {x.doc_id for x in dc.without_leaks(df, bench).collect()} == {0, 7, 8}
