"""Licence scans: texts compared to templates by the Dice coefficient over word pairs.

Built-in functions only.  Whole texts, their paragraphs and their lines are normalised
to lower-case words.  Dice is 2 |A and B| / (|A| + |B|), so a template can only reach a
score s if its number of pairs lies between s / (2 - s) and (2 - s) / s times that of
the text: other templates are not compared.  It follows too that a text shares at least
s / (2 - s) of a template's pairs, so it holds certain of its words; texts and lines
without them are put aside before they are taken apart.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.columns import with_computed


LEAST = 0.8

# Notices by which works refer to public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; everything else parts them."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def pairs(ws: Column) -> Column:
    """Distinct pairs of neighbouring words; a single word is a pair with itself left out."""
    n = F.size(ws)
    both = F.zip_with(F.slice(ws, 1, F.greatest(n - 1, F.lit(0))), F.slice(ws, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(n == 1, ws).otherwise(both))


def template_table(spark, templates: list[tuple[str, str]]) -> DataFrame:
    """licence, template (number), t_pairs, t_size of every template that has a word."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    df = spark.createDataFrame(rows, "template int, licence string, text string")
    return (
        df.select("template", "licence", pairs(words(F.col("text"))).alias("t_pairs"))
        .withColumn("t_size", F.size("t_pairs"))
        .filter("t_size > 0")
    )


def needed_words(pairs_of: list[str], least: float) -> list[list[str]]:
    """Groups of words; a text that reaches `least` for a template holds a word of each.

    The text lacks at most d of the template's pairs.  Words that stand in more than d
    pairs together can't all be lacking.  Groups are made of different words, small
    groups and long words (which few other texts hold) first.
    """
    lacking = len(pairs_of) - math.ceil(least / (2 - least) * len(pairs_of) - 1e-9)
    held = {w: {p for p in pairs_of if w in p.split(" ")} for p in pairs_of for w in p.split(" ")}
    unused = sorted(held, key=lambda w: (-len(w), w))
    groups = [[w] for w in unused if len(held[w]) > lacking]
    unused = [w for w in unused if len(held[w]) <= lacking]
    while unused:
        group, covered = [], set()
        for w in unused:
            if held[w] - covered:
                group.append(w)
                covered |= held[w]
            if len(covered) > lacking:
                break
        if len(covered) <= lacking:
            break
        groups.append(group)
        unused = [w for w in unused if w not in group]
    return groups


def needed_by_template(known: DataFrame, least: float) -> dict[int, list[list[str]]]:
    return {r["template"]: needed_words(r["t_pairs"], least) for r in known.select("template", "t_pairs").collect()}


def _holds(lower: Column, groups: list[list[str]]) -> Column:
    """Whether a text has a word of each group."""
    one_of = [reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in group]) for group in groups]
    return reduce(lambda a, b: a & b, one_of, F.lit(True))


def units(text: Column) -> Column:
    """A text, its paragraphs and its lines, each once."""
    return F.array_distinct(F.concat(F.array(text), F.split(text, "\\n[ \\t\\r]*\\n"), F.split(text, "\\n")))


def scan(
    df: DataFrame,
    least: float = LEAST,
    templates: list[tuple[str, str]] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, licence, score, unit for every licence that a document's text reaches `least` for.

    The best score of an id and licence stays, with the first such unit in order of text.
    Null and empty texts hold none; repeated ids are one document; null ids are one id.
    The list of templates is a parameter of the caller and is broadcast; an empty list or table gives no rows.
    """
    known = template_table(df.sparkSession, templates)
    span = known.agg(F.min("t_size"), F.max("t_size")).first()
    low, high = (span[0] or 1) * least / (2 - least), (span[1] or 0) * (2 - least) / least
    rules = needed_by_template(known, least)

    def may_match(lower: Column) -> Column:
        return reduce(lambda a, b: a | b, [_holds(lower, groups) for groups in rules.values()], F.lit(False))

    text = F.col(text_col)
    rows = df.filter(text.isNotNull()).select(F.col(id_col).alias("doc_id"), text.alias("text"))
    some = with_computed(rows, "lower", F.lower("text")).filter(may_match(F.col("lower")))
    split = some.select("doc_id", F.explode(units(F.col("text"))).alias("unit"))
    cut = with_computed(split, "lower", F.lower("unit")).filter(may_match(F.col("lower"))).drop("lower")
    parts = (
        with_computed(cut, "ws", words(F.col("unit")))
        # a walk over n distinct words has n - 1 distinct pairs at least
        .filter((F.size("ws") > low) & (F.size(F.array_distinct("ws")) - 1 <= high))
    )
    sized = (
        with_computed(parts, "pairs", pairs(F.col("ws")))
        .withColumn("size", F.size("pairs"))
        .filter((F.col("size") >= low) & (F.col("size") <= high))
    )
    fits = (F.col("size") >= F.col("t_size") * (least / (2 - least))) & (F.col("size") <= F.col("t_size") * ((2 - least) / least))
    scored = sized.join(F.broadcast(known), fits).select(
        "doc_id",
        "licence",
        "unit",
        (2 * F.size(F.array_intersect("pairs", "t_pairs")) / (F.col("size") + F.col("t_size"))).alias("score"),
    )
    best = scored.filter(F.col("score") >= least).groupBy("doc_id", "licence")
    return best.agg(F.max("score").alias("score"), F.min_by("unit", F.struct(-F.col("score"), F.col("unit"))).alias("unit"))


def runs(
    df: DataFrame,
    least: float = LEAST,
    templates: list[tuple[str, str]] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, licence, score, unit: licences that a run of a text's words reaches `least` for.

    A run is any stretch of neighbouring words, whatever lines and sentences it crosses,
    of at most as many pairs as a match of distinct ones can have.  The best run is one
    that begins and ends with a pair of the template (others only add to the size), so
    only those are scored, and only where enough of the template's pairs stand close
    enough together.  unit: the run's words, parted by blanks; the first in order of text
    of the best.
    """
    known = template_table(df.sparkSession, templates)
    least_pairs = F.ceil(F.col("t_size") * (least / (2 - least)) - 1e-9).cast("int")
    most_pairs = F.floor(F.col("t_size") * ((2 - least) / least) + 1e-9).cast("int")
    known = known.select("*", least_pairs.alias("low"), most_pairs.alias("high"))
    text = F.col(text_col)
    rows = df.filter(text.isNotNull()).select(F.col(id_col).alias("doc_id"), text.alias("text"))
    met = F.array_compact(
        F.array(*[F.when(_holds(F.col("lower"), groups), F.lit(i)) for i, groups in needed_by_template(known, least).items()])
    ).cast("array<int>")
    some = with_computed(with_computed(rows, "lower", F.lower("text")), "met", met).filter(F.size("met") > 0)
    worded = with_computed(some.select("doc_id", "text", "met"), "ws", words(F.col("text"))).drop("text")
    one = F.lit(1)
    several = F.zip_with(F.col("ws"), F.slice("ws", 2, F.size("ws")), lambda a, b: F.concat_ws(" ", a, b))
    each = (
        with_computed(worded, "all", F.slice(several, 1, F.greatest(F.size("ws") - 1, F.lit(0))))
        .select("doc_id", "ws", "all", F.explode("met").alias("template"))
        .join(F.broadcast(known), "template")
        # a template of one word has that word for its pair
        .withColumn("all", F.when(F.contains(F.col("t_pairs")[0], F.lit(" ")), F.col("all")).otherwise(F.col("ws")))
    )
    at = F.filter(F.sequence(one, F.size("all")), lambda i: F.array_contains("t_pairs", F.element_at("all", i.cast("int"))))
    placed = with_computed(each.filter(F.size("all") > 0), "at", at)
    # k-th place of a template's pair: `low` of them stand within `high` pairs from there
    first = F.filter(
        F.sequence(one, F.size("at") - F.col("low") + 1),
        lambda k: F.element_at("at", (k + F.col("low") - 1).cast("int")) - F.element_at("at", k.cast("int")) < F.col("high"),
    )
    starts = placed.filter(F.size("at") >= F.col("low")).select("*", F.explode(first).alias("k"))
    ends = F.filter(
        F.slice("at", F.col("k") + F.col("low") - 1, F.col("high") - F.col("low") + 1),
        lambda e: e - F.element_at("at", F.col("k").cast("int")) < F.col("high"),
    )
    spans = starts.select(
        "doc_id", "licence", "ws", "all", "t_pairs", "t_size", F.element_at("at", F.col("k").cast("int")).alias("begin"), F.explode(ends).alias("end")
    )
    length = F.col("end") - F.col("begin") + 1
    run = with_computed(spans, "pairs", F.array_distinct(F.slice("all", F.col("begin"), length)))
    score = 2 * F.size(F.array_intersect("pairs", "t_pairs")) / (F.size("pairs") + F.col("t_size"))
    word_count = F.when(F.contains(F.col("t_pairs")[0], F.lit(" ")), length + 1).otherwise(length)
    scored = run.select("doc_id", "licence", F.array_join(F.slice("ws", F.col("begin"), word_count), " ").alias("unit"), score.alias("score"))
    best = scored.filter(F.col("score") >= least).groupBy("doc_id", "licence")
    return best.agg(F.max("score").alias("score"), F.min_by("unit", F.struct(-F.col("score"), F.col("unit"))).alias("unit"))


def notices(
    df: DataFrame,
    least: float = LEAST,
    templates: list[tuple[str, str]] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """What `scan` finds, and the licences that only a run within or across units reaches.

    A licence that a unit reaches keeps that unit and its score.
    """
    whole = scan(df, least, templates, id_col, text_col).withColumn("rank", F.lit(0))
    both = whole.unionByName(runs(df, least, templates, id_col, text_col).withColumn("rank", F.lit(1)))
    found = both.groupBy("doc_id", "licence").agg(F.min_by(F.struct("score", "unit"), "rank").alias("best"))
    return found.select("doc_id", "licence", "best.score", "best.unit")
