"""Spelling variants: words one edit apart, found through variable-length grams.

Grams are anchored at the beginning or the end of a word, so their place is part of them.
The dictionary is two tries (of beginnings, of ends) pruned by frequency: a piece that
many words share is extended by the next letter, a rare one is a gram.  An edit affects
the grams that hold its place; for every place an edit may be at, a word stands in the
list of a gram that the edit leaves alone, or, where it leaves only frequent pieces, in
the merged list of the beginning and the end that are left.  Two words one edit apart have
the same pieces left, so they meet in a list; pairs that meet are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.session import materialize, ship_package

RUN = "[A-Za-zÀ-ÿ]"
SHORTEST = 7  # code points of a word
TYPO = 31
GRAM_MIN, GRAM_MAX = 2, 32  # letters of a piece that may be frequent
FREQUENT = 100_000  # a piece is frequent if it is more than this part of all
FREQUENT_LEAST = 8  # and more than this many
HASH = (1 << 63) - 1
MEMO_WORDS = 200_000
MEMO_PIECES = 1_000_000
RATIO = 10


def words_in(doc_id: str, text: str, shortest: int = SHORTEST) -> Counter:
    """Words of a text and how often they occur, after the change that ids and words decide."""
    out: Counter = Counter()
    lowered = text.encode().lower().decode()  # A to Z alone
    for run, n in Counter(re.findall(f"{RUN}{{{shortest},}}", lowered)).items():
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % TYPO == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < shortest:
                continue
        out[run] += n
    return out


def word_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = 2
) -> DataFrame:
    """word, n of all words of at least `shortest` code points and `least` occurrences."""
    ship_package()

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                held.update(words_in(doc_id.as_py(), text.as_py(), shortest))
                if len(held) > MEMO_WORDS:
                    yield counted(held)
                    held = Counter()
        yield counted(held)

    def counted(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
        )

    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.col(text_col).alias("text"))
    counts = rows.filter("text IS NOT NULL").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _pieces(word: str) -> tuple[list[int], list[int]]:
    """Hashes of the word's beginnings by length, and of its ends by length (0 to all)."""
    starts, ends = [1], [2]
    for c in word:
        starts.append((starts[-1] * 1_000_003 + ord(c)) & HASH)
    for c in reversed(word):
        ends.append((ends[-1] * 999_983 + ord(c)) & HASH)
    return starts, ends


def frequent_grams(words: DataFrame) -> set[int]:
    """Hashes of the beginnings and ends that many words share: the inner nodes of the gram tries.

    A piece is frequent if it is more than 1 / FREQUENT of all pieces, so there are fewer
    than FREQUENT, whatever the number of words.
    """

    def run(batches):
        held: Counter = Counter()
        total = 0
        for batch in batches:
            for word in batch.column(0):
                word = word.as_py()
                for pieces in _pieces(word[:GRAM_MAX])[0], _pieces(word[-GRAM_MAX:])[1]:
                    held.update(pieces[GRAM_MIN:])
                    total += len(pieces) - GRAM_MIN
                if len(held) > MEMO_PIECES:
                    yield counted(held, total)
                    held, total = Counter(), 0
        yield counted(held, total)

    def counted(held, total):
        held[-1] = total
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held.keys()), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"]
        )

    found = words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = materialize(found.filter((F.col("n") > FREQUENT_LEAST) | (F.col("gram") == -1)), "gram-counts")
    total = found.filter("gram = -1").agg(F.sum("n")).first()[0] or 0
    rows = found.filter((F.col("gram") != -1) & (F.col("n") * FREQUENT > total)).select("gram").collect()
    return {r["gram"] for r in rows}


def lists_of(word: str, frequent: set[int]) -> set[int]:
    """Keys of the lists that a word stands in: for any single edit, one that the edit leaves alone.

    The word's first gram is its shortest rare beginning, its last gram its shortest rare
    end.  An edit at a place affects what holds the place.  Beyond the first gram it leaves
    that alone, before the last gram that; if both, the shorter list key is taken.  An edit
    in between leaves only frequent pieces, and their lists are merged: the key is the
    beginning up to the place and the end behind it together.
    """
    starts, ends = _pieces(word)
    n = len(word)
    first = next((e for e in range(GRAM_MIN, n + 1) if e > GRAM_MAX or starts[e] not in frequent), n + 1)
    last = next((e for e in range(GRAM_MIN, n + 1) if e > GRAM_MAX or ends[e] not in frequent), n + 1)
    out = set()
    # i letters before the edit and r behind it: n - 1 in all if a letter goes or is replaced, n if one comes
    for kept in (n - 1, n):
        for i in range(kept + 1):
            r = kept - i
            if first <= i and (first <= last or last > r):
                out.add(starts[first])
            elif last <= r:
                out.add(ends[last])
            else:
                out.add((starts[i] * 0x9E3779B97F4A7C15 ^ ends[r]) & HASH)
    return out


def near_words(words: DataFrame) -> DataFrame:
    """a, b: pairs of words (column word, distinct) that differ by exactly one edit, each once.

    `a` is the shorter word, or the smaller of equal length.  No list is cut; a list of
    many words is split over tasks by the run-time skew join, as every pair is found by
    its key alone.
    """
    ship_package()
    frequent = words.sparkSession.sparkContext.broadcast(frequent_grams(words))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = [(k, w, len(w)) for w in batch.column(0).slice(at, 2000).to_pylist() for k in lists_of(w, frequent.value)]
                columns = zip(*rows) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, kind) for v, kind in zip(columns, (pa.int64(), pa.string(), pa.int32()))],
                    names=["key", "word", "size"],
                )

    entries = materialize(words.select("word").mapInArrow(run, "key long, word string, size int"), "word-grams")
    a, b = entries.alias("a"), entries.alias("b")
    together = (
        (F.col("a.key") == F.col("b.key"))
        & (
            ((F.col("a.size") == F.col("b.size")) & (F.col("a.word") < F.col("b.word")))
            | (F.col("a.size") + 1 == F.col("b.size"))
        )
        & (F.levenshtein("a.word", "b.word", 1) == 1)
    )
    return a.join(b, together).select(F.col("a.word").alias("a"), F.col("b.word").alias("b")).distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, form, form_n, n_near: a word's near words, and the one that it is a variant of.

    The form is the near word of largest n (ties: the smallest by code points), if its n
    is at least `ratio` times the word's.
    """
    counts = words.select("word", "n")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    near = both.join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # the smallest of (-n, word) is the largest n, ties by code points
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    joined = counts.join(best, "word", "left")
    best_n = -F.col("best.col1")
    has = F.coalesce(best_n >= ratio * F.col("n"), F.lit(False))
    return joined.select(
        "word",
        "n",
        F.when(has, F.col("best.near")).alias("form"),
        F.when(has, best_n).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def with_roots(table: DataFrame) -> DataFrame:
    """Adds root: the last word that forms lead to.

    Each step multiplies n, so chains are short; every round doubles the steps taken, and
    is written, until none is left.
    """
    steps = materialize(table.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-steps")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = materialize(
            steps.join(onward, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "spelling-steps",
        )
        if doubled.filter("moved").isEmpty():
            break
        steps = doubled.select("word", "root")
    return table.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = 2, ratio: int = RATIO
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a table of texts.

    Null and empty texts have no words; a null id counts as the empty text in the change
    of words.  Rows that are repeated count again.  Words of any length are compared
    whole.  Other columns are not read.  An empty table gives no rows.
    """
    words = materialize(word_counts(df, id_col, text_col, shortest, least), "words")
    pairs = materialize(near_words(words), "near-words")
    table = materialize(forms(words, pairs, ratio), "spelling-forms")
    return with_roots(table).select("word", "form", "root", "n", "n_near", "form_n")
