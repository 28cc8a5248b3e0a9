"""Profiles against plain counting, and held-out accuracy."""

from collections import Counter

from marketlens.llm import language


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        out.update(w)
    line = " " + " ".join(words) + " " if words else ""
    out.update(line[i : i + 2] for i in range(len(line) - 1))
    out.update(line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
    return out


def pack(g):
    value = 0
    for c in g:
        value = value << 21 | ord(c)
    return value


def test_grams(monkeypatch):
    texts = ["", " ", "12 !", "Abc", "Straße à la_mode 3x é", "ab " * 500, "İ 日本 x", "a"]
    for size in (1 << 18, 40):
        monkeypatch.setattr(language, "SLICE_CHARS", size)
        for t in texts:
            ids, counts = language.grams_of(t)
            got = dict(zip(ids.tolist(), counts.tolist()))
            want = {pack(g): n for g, n in plain_grams(t).items()}
            if size > len(t):
                assert got == want, t
            else:  # a cut between words repeats only the blanks at its ends
                assert set(got) == set(want) and all(abs(got[g] - want[g]) <= len(t) for g in got)


def test_learn_and_predict(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.filter("doc_id % 4 <> 2"), docs.filter("doc_id % 4 = 2")
    known = language.learn(train)
    assert known.languages == ["de", "en", "es", "fr"]
    lang = dict(test.select("doc_id", "lang").collect())
    found = {r.doc_id: r for r in language.predict(test, known).collect()}
    right = sum(found[i].lang_pred == v for i, v in lang.items()) / len(lang)
    assert right > 0.97 and all(0 <= r.score <= 1 for r in found.values())
    rows = [(1, None), (2, ""), (3, "12 ?!"), (3, "12 ?!"), (None, "the and of ing that")]
    odd = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, lang_pred string")
    got = sorted((str(r.doc_id), r.lang_pred) for r in language.predict(odd, known).collect())
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("3", "und"), ("None", "en")]


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([(1, None, "en"), (2, "abc", None)], "doc_id long, text string, lang string")
    known = language.learn(empty)
    assert known.languages == []
    assert [r.lang_pred for r in language.predict(empty, known).collect()] == ["und", "und"]
    assert language.predict(empty.limit(0), known).collect() == []


def test_distance_is_out_of_place(spark):
    rows = [(1, "aab", "x"), (2, "ba", "y")]
    known = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    rank = {lang: [g for g, _ in sorted(plain_grams(t).items(), key=lambda kv: (-kv[1], pack(kv[0])))] for _, t, lang in rows}
    top = language.ranked(*language.grams_of("abba"))
    mine = [g for g, _ in sorted(plain_grams("abba").items(), key=lambda kv: (-kv[1], pack(kv[0])))]
    want = [
        sum(abs(rank[lang].index(g) - i) if g in rank[lang] else language.PROFILE for i, g in enumerate(mine))
        for lang in ("x", "y")
    ]
    assert known.distances(top).tolist() == want


def test_rare_languages_are_learned(spark):
    rows = [(i, "the cat and the dog and the house", "en") for i in range(30_000)]
    rows += [(30_000, "wuxu qoqo zuzu wuqu xozu", "qq"), (30_001, "bb cc bb dd cc", None)]
    rows += [(40_000 + i, f"{chr(0x4E00 + 2 * i)}{chr(0x4E01 + 2 * i)}", f"x{i:04}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    known = language.learn(df)
    assert known.languages == sorted({r[2] for r in rows if r[2]})
    asked = [r for r in rows if r[0] in (0, 30_000) or r[0] >= 42_900]
    found = language.predict(spark.createDataFrame(asked, df.schema), known).collect()
    assert {r.doc_id: r.lang_pred for r in found} == {r[0]: r[2] for r in asked}


def test_only_empty_texts_teach_nothing(spark):
    df = spark.createDataFrame([(1, "", "en"), (2, "12 ?", "de"), (3, "abc", "fr")], "doc_id long, text string, lang string")
    assert language.learn(df).languages == ["fr"]
