"""Licence scan against plain Dice over all templates."""

import random
import re

from marketlens.llm import licences


def plain_pairs(text):
    ws = re.sub(r"[^\w]|_", " ", text.lower()).split()
    return {tuple(ws)} if len(ws) == 1 else set(zip(ws, ws[1:]))


def plain(rows, least):
    best = {}
    for i, text in rows:
        if text is None:
            continue
        units = {text, *re.split(r"\n[ \t\r]*\n", text), *text.split("\n")}
        for u in units:
            a = plain_pairs(u)
            for name, t in licences.TEMPLATES:
                b = plain_pairs(t)
                score = 2 * len(a & b) / (len(a) + len(b)) if a else 0
                if score >= least:
                    old = best.get((i, name), (0, ""))
                    if (-score, u) < (-old[0], old[1]):
                        best[i, name] = (score, u)
    return {k: (round(s, 6), u) for k, (s, u) in best.items()}


def texts():
    r = random.Random(4)
    out = [None, "", "\n\n", "licensed", "LICENSED under the mit licence", "Licensed under CC BY-NC 4.0." * 2]
    for _ in range(300):
        _, t = r.choice(licences.TEMPLATES)
        ws = t.split(" ")
        for _ in range(r.randrange(3)):
            ws[r.randrange(len(ws))] = r.choice(["x", "the", ws[0].upper() + "!"])
        broken = [w + ("\n" if r.random() < 0.05 else " ") for w in ws]
        out.append(r.choice(["", "Some words before.\n", "Para one\n \n"]) + "".join(broken) + r.choice(["", "\nmore words behind", "\n\nmore"]))
    return out


def test_equals_plain_dice(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "Released under the MIT License."), (9, "Licensed under CC BY 4.0.")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, licence string")
    for least in (0.8, 0.5):
        got = {(r.doc_id, r.licence): (round(r.score, 6), r.unit) for r in licences.scan(df.repartition(4), least).collect()}
        assert got == plain(rows, least)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert licences.scan(df).collect() == []
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert licences.scan(df, templates=[]).collect() == []
    assert licences.scan(df, templates=[("none", "!!")]).collect() == []


def plain_runs(rows, least):
    """Every run of every text against every template."""
    best = {}
    for i, text in rows:
        ws = re.sub(r"[^\w]|_", " ", (text or "").lower()).split()
        for name, t in licences.TEMPLATES:
            b = plain_pairs(t)
            most = int(len(b) * (2 - least) / least + 1e-9)
            for at in range(len(ws)):
                for n in range(2, min(most + 1, len(ws) - at) + 1):
                    a = plain_pairs(" ".join(ws[at : at + n]))
                    score = 2 * len(a & b) / (len(a) + len(b))
                    if score >= least:
                        best[i, name] = max(best.get((i, name), 0), score)
    return {k: round(v, 6) for k, v in best.items()}


PLANTED = [
    ("This project is released under the MIT License.", "MIT"),
    ("Copyright (c) 2023 Jane Doe. Released under the MIT License.", "MIT"),
    ("Copyright 2019 Example Inc. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("words before it, licensed\nunder CC\n\nBY-NC 4.0. and words behind it that go on and on", "CC-BY-NC-4.0"),
    ("x " * 300 + "This is free and unencumbered\nsoftware released into the\npublic domain. " + "y z " * 300, "Unlicense"),
]


def test_notices_within_and_across_lines(spark):
    rows = [(i, t) for i, (t, _) in enumerate(PLANTED)] + [(50, "the license of the mit, a permit under which things are"), (51, None), (52, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert not {r.doc_id for r in licences.scan(df).collect()}
    found = licences.notices(df.repartition(3)).collect()
    assert {(i, name) for i, (_, name) in enumerate(PLANTED)} <= {(r.doc_id, r.licence) for r in found}
    assert {r.doc_id for r in found} == set(range(len(PLANTED)))


def test_runs_equal_every_run(spark):
    r = random.Random(8)
    rows = [(i, t) for i, (t, _) in enumerate(PLANTED[:4])]
    for t in texts()[6:30]:
        rows.append((len(rows), " ".join(r.choice("abc") for _ in range(9)) + " " + t[:160] + " " + t[:90]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (0.8, 0.6):
        got = {(x.doc_id, x.licence): round(x.score, 6) for x in licences.runs(df, least).collect()}
        assert got == plain_runs(rows, least)
    one = [("One", "Copyleft!")]
    assert [x.licence for x in licences.runs(spark.createDataFrame([(1, "all of it copyleft here")], df.schema), 0.8, one).collect()] == ["One"]
    assert licences.notices(df, templates=[]).collect() == [] and licences.notices(df.limit(0)).collect() == []
