"""The learner against a plain loop, and held-out accuracy."""

import math
import zlib

import numpy as np

from marketlens.llm import toxicity


def plain_ftrl(rows, labels, s):
    share = min(max(sum(labels) / len(labels), 1e-3), 1 - 1e-3)
    prior = math.log(share / (1 - share))
    z, n = {}, {}

    def weight(i):
        l1 = 0 if i == "bias" else s.l1
        zi = z.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((s.beta + math.sqrt(n.get(i, 0.0))) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for ids, y in zip(rows, labels):
            at = list(ids) + ["bias"]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-(prior + sum(w)))) - y
            for i, wi in zip(at, w):
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / s.alpha * wi
                n[i] = before + g * g
    return {i: weight(i) for i in z if i != "bias" and weight(i)}, prior + weight("bias")


def test_ftrl_equals_plain_loop():
    memo = toxicity.WordHashes()
    texts = ["you idiot fool", "nice day today", "what an idiot", "a nice fool day", "", "idiot idiot"] * 4
    labels = [1, 0, 1, 0, 0, 1] * 4
    rows = [toxicity.features(t, memo) for t in texts]
    s = toxicity.Settings(alpha=0.3, l1=0.4, epochs=3)
    model = toxicity.ftrl(rows, np.array(labels, float), s)
    weights, bias = plain_ftrl([r.tolist() for r in rows], labels, s)
    assert model.ids.tolist() == sorted(weights)
    assert np.allclose(model.weights, [weights[i] for i in sorted(weights)]) and math.isclose(model.bias, bias)


def test_features_are_pairs_and_skips():
    memo = toxicity.WordHashes()
    f = lambda t: set(toxicity.features(t, memo).tolist())
    assert f("a b") - f("a") - f("b") and f("a x b") - f("a x") - f("x b")
    assert f("Idiot$$$ YOU") == f("idiot you") and f("") == set() and f("a a a") >= f("a")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = [tuple(r) for r in labels.select("doc_id", "toxic").collect()]
    train = spark.createDataFrame([r for r in known if not held_out(r[0])], "doc_id long, toxic int")
    model = toxicity.train(docs, train)
    test = {i: y for i, y in known if held_out(i)}
    scored = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    y = np.array(list(test.values()))
    s = np.array([scored[i].score for i in test])
    p = np.array([scored[i].predicted for i in test])
    auc = np.mean([(s[y == 0] < v).mean() + (s[y == 0] == v).mean() / 2 for v in s[y == 1]])
    assert auc > 0.97 and (p[y == 0] == 1).mean() < 0.01 and (p[y == 1] == 1).mean() > 0.75
    assert len(model.ids) < 5000


def test_repeated_ids_and_labels_without_documents_do_not_crowd_out_others(spark):
    docs = [(1, "bad word")] * 500 + [(i, "good word" if i % 2 else "bad thing") for i in range(2, 40)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [(i, 0 if i % 2 else 1) for i in range(2, 40)]
    settings = toxicity.Settings(l1=0.1, max_rows=45)
    plain = toxicity.train(docs.distinct(), spark.createDataFrame(rows + [(1, 1)], "doc_id long, toxic int"), settings)
    crowd = rows + [(1, 1)] + [(i, 1) for i in range(1000, 3000)]  # none of these has a document
    found = toxicity.train(docs, spark.createDataFrame(crowd, "doc_id long, toxic int"), settings)
    assert found.ids.tolist() == plain.ids.tolist() and np.allclose(found.weights, plain.weights) and len(plain.ids)


def test_odd_rows(spark):
    rows = [(1, "bad word", 1), (2, "good word", 0), (3, None, None), (3, "", None), (None, "bad", None), (1, "bad word", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, toxicity.Settings(l1=0.1))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    bad, good = ([r.score for r in got if r.doc_id == i] for i in (1, 2))
    assert min(bad) > max(good)
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).collect() == []
