"""Language identification by rank-order profiles of character n-grams.

The most frequent n-grams (1 to 3 letters, words padded with a blank) of a language
make its profile.  A text's own most frequent n-grams are compared with each profile
by the out-of-place distance: how far each one's rank is from its rank in the profile.
"""

from __future__ import annotations

import sys
import types
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F

from marketlens.session import ship_package

PROFILE = 400  # n-grams of a profile, and of a text
SLICE_CHARS = 1 << 18
BLANK = 32
UNKNOWN = "und"


def letters() -> np.ndarray:
    """Whether a code point is a letter; made once a worker process."""
    kept = sys.modules.setdefault("_marketlens_letters", types.ModuleType("_marketlens_letters"))
    if not hasattr(kept, "table"):
        kept.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return kept.table


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = np.sort(grams)
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.diff(np.r_[first, len(grams)])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counted n-grams."""
    if len(parts) == 1:
        return parts[0]
    ids, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return ids, np.bincount(at, np.concatenate([p[1] for p in parts]), len(ids)).astype(np.int64)


def _slice_grams(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    letter = table[codes]
    c = np.where(letter, codes, BLANK).astype(np.int64)
    c = c[letter | np.r_[True, letter[:-1]]]  # one blank between words
    if len(c) and c[0] != BLANK:
        c = np.r_[BLANK, c]
    if len(c) and c[-1] != BLANK:
        c = np.r_[c, BLANK]
    triples = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    return np.concatenate([c[c != BLANK], (c[:-1] << 21) | c[1:], triples[c[1:-1] != BLANK]])


def grams_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (ascending, packed code points) and counts of a whole text.

    Long texts are counted in slices cut between words where there is a blank.
    """
    table, parts, at = letters(), [], 0
    text = text.lower()
    while at < len(text):
        end = at + SLICE_CHARS
        if end < len(text):
            cut = text.find(" ", end)
            end = cut if cut >= 0 else len(text)
        part = text[at:end]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        parts.append(_counted(_slice_grams(codes, table)))
        at = end
    return merged(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def ranked(ids: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """Most frequent n-grams first, ties in order of the n-gram."""
    return ids[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """Languages (ascending), n-grams of any profile (ascending) and the languages that have each.

    Those of n-gram i stand at starts[i] to starts[i + 1] of `owners` (number of the
    language) and `ranks` (rank in its profile): as large as all profiles together.
    """

    languages: list[str]
    grams: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    ranks: np.ndarray

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language; an absent n-gram counts as the most."""
        far = np.full(len(self.languages), len(top) * PROFILE, np.int64)
        if not len(self.grams):
            return far
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        mine = np.flatnonzero(self.grams[at] == top)
        first, last = self.starts[at[mine]], self.starts[at[mine] + 1]
        held = last - first
        entry = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + np.repeat(first, held)
        off = np.abs(self.ranks[entry] - np.repeat(mine, held)) - PROFILE
        return far + np.bincount(self.owners[entry], off, len(far)).astype(np.int64)


def learn(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Profiles:
    """Profiles of every language of the rows with a language and a text, however rare.

    Counts cover all rows; a task sends one count for each language and n-gram it met.
    At most 400 n-grams a language reach the driver, as columns of numbers.  Null languages
    and texts teach nothing; without rows there is no profile.
    """
    ship_package()
    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        "lang IS NOT NULL AND text IS NOT NULL"
    )

    def count(batches):
        found: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                parts = found.setdefault(lang, [])
                parts.append(grams_of(text.as_py()))
                if len(parts) >= 256:
                    found[lang] = [merged(parts)]
        for lang, parts in found.items():
            ids, counts = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(ids)), pa.array(ids), pa.array(counts)], names=["lang", "gram", "n"]
            )

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("r", F.row_number().over(order) - 1).filter(F.col("r") < PROFILE)
    found = top.select("lang", "gram", "r").toArrow()
    named = found.column("lang").combine_chunks().dictionary_encode()
    names = named.dictionary.to_pylist()
    languages = sorted(names)
    place = {lang: i for i, lang in enumerate(languages)}
    number = np.array([place[n] for n in names], np.int32)
    owners = number[named.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, np.int32)
    every, ranks = found.column("gram").to_numpy(), found.column("r").to_numpy()
    by_gram = np.lexsort((owners, every))
    grams, starts = np.unique(every[by_gram], return_index=True)
    return Profiles(languages, grams, np.r_[starts, len(every)].astype(np.int64), owners[by_gram], ranks[by_gram].astype(np.int64))


def predict(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row.

    Texts that are null or have no letter are `und` with score 0.  Otherwise the nearest
    profile wins (ties: the first code) and score is the second distance over the sum of
    the two nearest: 0.5 for a tie, 1 for a perfect match.  Repeated rows give a row each.
    """
    ship_package()
    shared = df.sparkSession.sparkContext.broadcast(profiles)
    schema = T.StructType(
        [
            T.StructField("doc_id", df.schema[id_col].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def one(text: str | None) -> tuple[str, float]:
        known = shared.value
        top = ranked(*grams_of(text)) if text else ()
        if not len(top) or not known.languages:
            return UNKNOWN, 0.0
        d = known.distances(top)
        best = int(d.argmin())
        second = np.partition(d, 1)[1] if len(d) > 1 else len(top) * PROFILE
        return known.languages[best], float(second / (d[best] + second)) if d[best] + second else 0.5

    def run(batches):
        for batch in batches:
            found = [one(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
