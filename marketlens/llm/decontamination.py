"""Benchmark decontamination by latent semantic retrieval.

Documents become passages of 32 words over the vocabulary of a block of benchmark
items, weighted by TF-IDF with counts over all documents.  A distributed randomised
SVD of these passages gives the main directions of the corpus, the latent space; it has
fewer directions than a block has items.  Candidates are windows of two passages that
are near an item in that space; inverted lists of the items' words leave out, before any
vector is formed, those that hold too little of an item to be a leak.  Candidates are
then aligned with the item: the longest common subsequences of
all its words, of its content words (those that are not common in the corpus) and of the
words of its last sentence (the answer) decide.  Beside that, a run of RUN words of an item,
word for word, is a leak wherever it stands in the item; runs are looked up by hash in
every text, without the latent space.

A block of items reads all text once; its later passes read word numbers of 16 bits (32
for a block whose vocabulary needs them).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from marketlens.session import materialize, ship_package

WORD = re.compile(r"\w+")
NONE = -1  # a word that no item of the block has
PASSAGE = 32
ITEMS_A_BLOCK = 224
PIECE_ROWS, PIECE_BYTES = 2000, 4 << 20  # of texts worked on at a time
WORDS_A_BLOCK = 60_000
DIRECTIONS, LEAST_DIRECTIONS, OVERSAMPLE = 64, 16, 8  # a third of the items, within these
COMMON = 0.02  # words in more passages than this weigh nothing
KEEP_WORDS = 8  # but the rarest of an item always weigh
COSINE = 0.35  # of a window and an item in the latent space
LONG_ITEM = 512  # words; windows of longer items begin on a grid of a quarter of their length
RUN = 13  # words of an item in a row that are a leak in themselves
COVERED = 0.2  # of an item's latent length by a window (less for items longer than one)


@dataclass(frozen=True)
class Rule:
    """Shares of an item's words, and of its content words, that a text has in their order.

    `alike`: both reach it, a leak in itself.  `paraphrase`: both reach it, a leak if the
    answer's share reaches `answer`.
    """

    alike: float = 0.85
    paraphrase: float = 0.6
    answer: float = 0.6


@dataclass(frozen=True)
class Items:
    """A block of benchmark items: ids, words by number, words of the answers, vocabulary."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: dict[str, int]

    @property
    def kind(self) -> str:
        """Integers in which words are kept; the greatest stands for none."""
        return "<u2" if len(self.vocabulary) < 0xFFFF else "<u4"


def numbers_of(kept: bytes, kind: str) -> np.ndarray:
    """Word numbers of a text, NONE where no item has the word."""
    words = np.frombuffer(kept, kind)
    numbers = words.astype(np.int64)
    numbers[words == np.iinfo(kind).max] = NONE
    return numbers


def _pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES):
    """Runs of rows of about `limit` bytes of words at most."""
    ends = np.cumsum(pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = min(max(start + 1, int(np.searchsorted(ends, base + limit, "right"))), start + PIECE_ROWS)
        yield batch.slice(start, end - start)
        start = end


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def answer_of(text: str) -> str:
    """The last sentence that has a word."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text) if WORD.search(p)]
    return parts[-1] if parts else ""


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Blocks of items of bounded number and vocabulary, in order of id."""
    block, vocabulary = [], {}
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    for row in rows.dropDuplicates(["i", "t"]).orderBy("i", "t").toLocalIterator():
        words = words_of(row["t"])
        if not words:
            continue
        fresh = set(words) - vocabulary.keys()
        if block and (len(block) >= ITEMS_A_BLOCK or len(vocabulary) + len(fresh) > WORDS_A_BLOCK):
            yield _items(block, vocabulary)
            block, vocabulary, fresh = [], {}, set(words)
        for w in sorted(fresh):
            vocabulary[w] = len(vocabulary)
        block.append((row["i"], words, words_of(answer_of(row["t"]))))
    if block:
        yield _items(block, vocabulary)


def _items(block, vocabulary) -> Items:
    numbers = lambda words: np.array([vocabulary[w] for w in words], np.int64)
    return Items([b[0] for b in block], [numbers(b[1]) for b in block], [numbers(b[2]) for b in block], vocabulary)


def encoded(df: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, words: every word of every text as a number of 16 or 32 bits."""
    ship_package()
    kind, none = items.kind, np.iinfo(items.kind).max
    vocabulary = df.sparkSession.sparkContext.broadcast(items.vocabulary)
    schema = T.StructType(
        [
            T.StructField("doc_id", df.schema[id_col].dataType),
            T.StructField("text_hash", T.LongType()),
            T.StructField("words", T.BinaryType()),
        ]
    )

    class Numbers(dict):
        def __missing__(self, word):
            return none

    def run(batches):
        known = Numbers(vocabulary.value)
        for batch in batches:
            out = []
            for t in batch.column("text"):
                words = WORD.findall(t.as_py().lower())
                out.append(np.fromiter(map(known.__getitem__, words), kind, len(words)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(out, pa.binary())],
                names=["doc_id", "text_hash", "words"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, schema)


def passages(column, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages of a batch: document of each, and (passage, word, times) where words are known."""
    texts = [numbers_of(b.as_py(), kind) for b in column]
    lengths = np.array([len(t) for t in texts], np.int64)
    blocks = -(-lengths // PASSAGE)
    first = np.r_[0, np.cumsum(blocks)]
    document = np.repeat(np.arange(len(texts)), blocks)
    words = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    at = np.flatnonzero(words != NONE)
    ends = np.cumsum(lengths)
    owner = np.searchsorted(ends, at, "right")
    passage = first[owner] + (at - (ends - lengths)[owner]) // PASSAGE
    keys, times = np.unique((passage << 32) | words[at], return_counts=True)
    return document, keys >> 32, keys & 0xFFFFFFFF, times


def _summed(frames: DataFrame, width: int) -> np.ndarray:
    """Sum of the task's (row, values) by row; as large as the matrix, whatever the input."""
    sums = frames.groupBy("row").agg(F.array(*[F.sum(F.col("values")[i]) for i in range(width)]).alias("v")).collect()
    out = np.zeros((max((r["row"] for r in sums), default=-1) + 1, width))
    for r in sums:
        out[r["row"]] = r["v"]
    return out


def _matrix_pass(words: DataFrame, kind: str, size: int, width: int, add) -> np.ndarray:
    """`add(total, passages...)` over all batches of every task, summed by Spark."""

    def run(batches):
        total = np.zeros((size, width))
        for batch in batches:
            for part in _pieces(batch):
                add(total, *passages(part.column("words"), kind))
        rows = np.flatnonzero(total.any(1))
        values = pa.FixedSizeListArray.from_arrays(pa.array(total[rows].ravel()), width).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), values], names=["row", "values"])

    got = _summed(words.select("words").mapInArrow(run, "row int, values array<double>"), width)
    return np.concatenate([got, np.zeros((size - len(got), width))])


def idf_weights(words: DataFrame, items: Items) -> np.ndarray:
    """Weight of each word by the passages of all documents that hold it."""
    size = len(items.vocabulary)

    def add(total, document, passage, word, times):
        total[:size, 0] += np.bincount(word, minlength=size)
        total[size, 0] += len(document)

    counts = _matrix_pass(words, items.kind, size + 1, 1, add)[:, 0]
    n, df = counts[size] + len(items.ids), counts[:size] + 1
    idf = np.log1p(n / df)
    common = df > COMMON * n
    for item in items.words:
        own = np.unique(item)
        common[own[np.lexsort((own, df[own]))][:KEEP_WORDS]] = False
    idf[common] = 0.0
    return idf


def _rows(passage, word, times, idf):
    """Weighted entries that are not zero, and where each passage starts."""
    value = (1 + np.log(times)) * idf[word]
    some = value > 0
    passage, word, value = passage[some], word[some], value[some]
    starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.zeros(0, np.int64)
    return passage, word, value, starts


def _project(word, value, starts, basis):
    return np.add.reduceat(basis[word] * value[:, None].astype(basis.dtype), starts, 0)


def item_matrix(items: Items, idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(items.ids), len(idf)))
    for i, item in enumerate(items.words):
        word, times = np.unique(item, return_counts=True)
        out[i, word] = (1 + np.log(times)) * idf[word]
    return out


def latent_space(words: DataFrame, items: Items, idf: np.ndarray, seed: int = 42) -> np.ndarray:
    """Orthonormal basis of the corpus's main directions, fewer than a block has items.

    Randomised SVD: a random start, one power step A'(A start) summed over all tasks,
    and the small Gram matrix of A in that basis, whose eigenvectors are the singular
    directions.  Only matrices of the block's vocabulary reach the driver.
    """
    directions = min(DIRECTIONS, max(LEAST_DIRECTIONS, len(items.ids) // 3))
    size, width = len(idf), directions + OVERSAMPLE
    context = words.sparkSession.sparkContext

    def orthonormal(z):
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        return u[:, s > 1e-9 * s.max(initial=0)] if s.max(initial=0) > 1e-9 else u[:, :0]

    shared = context.broadcast((idf, orthonormal(np.random.default_rng(seed).standard_normal((size, width))).astype(np.float32)))
    width = shared.value[1].shape[1]
    if not width:
        return np.zeros((size, 0))

    def power(total, document, passage, word, times):
        weight, start = shared.value
        passage, word, value, starts = _rows(passage, word, times, weight)
        if not len(word):
            return
        y = _project(word, value, starts, start)
        part = np.repeat(y, np.diff(np.r_[starts, len(word)]), 0) * value[:, None].astype(np.float32)
        order = np.argsort(word, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(word[order]) != 0])
        total[word[order][first]] += np.add.reduceat(part[order], first, 0)

    basis = orthonormal(_matrix_pass(words, items.kind, size, width, power))
    rank = basis.shape[1]
    if not rank:
        return basis
    shared_basis = context.broadcast((idf, basis.astype(np.float32)))

    def gram(total, document, passage, word, times):
        weight, b = shared_basis.value
        passage, word, value, starts = _rows(passage, word, times, weight)
        if len(word):
            y = _project(word, value, starts, b)
            total += y.T @ y

    eigen = np.linalg.eigh(_matrix_pass(words, items.kind, rank, rank, gram))
    return basis @ eigen[1][:, ::-1][:, :directions]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine-wide row at a time."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        match = row & masks.get(w, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def _aligned(item, answer, content, text, low: int, high: int, least: float, seen: set | None = None):
    """Best share of the item, and of its answer there, in windows of 1.3 times its length.

    `seen`: where windows of a long item that were looked at before begin (then on a grid,
    so neighbouring candidates do not align the same stretch again).
    `content`: which word numbers are content; a share is the smaller of that of all words
    and that of content words.
    """
    m, rare = len(item), item[content[item]]
    width, step = int(np.ceil(1.3 * m)), max(1, m // 4)
    low, high = max(0, low - m), min(len(text), high + m)
    if seen is not None:
        low -= low % step
    held = Counter(rare.tolist())
    best = (0.0, 0.0, low)
    for at in range(low, max(low + 1, high - width + step), step):
        if seen is not None:
            if at in seen:
                continue
            seen.add(at)
        part = text[at : at + width]
        part = part[part != NONE]
        own = part[content[part]]
        if sum(min(n, held[w]) for w, n in Counter(own.tolist()).items() if w in held) < least * len(rare):
            continue
        share = min(common_subsequence(item, part) / m, common_subsequence(rare, own) / len(rare))
        if share > best[0]:
            inside = common_subsequence(answer, part) / len(answer) if len(answer) else 1.0
            best = (share, inside, at)
    return best


def _run_keys(words: np.ndarray) -> np.ndarray:
    """A hash of the RUN words from each place on."""
    n = len(words) - RUN + 1
    keys = np.zeros(max(n, 0), np.uint64)
    for k in range(RUN if n > 0 else 0):
        keys = (keys ^ words[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def _item_runs(items: Items):
    """Hashes of all runs (ascending), their items and places."""
    keys = [_run_keys(w) for w in items.words]
    item = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    place = np.concatenate([np.arange(len(k)) for k in keys])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    return keys[order], item[order], place[order]


def _runs_in(text: np.ndarray, known, item_words) -> dict[int, int]:
    """Items of which the text has a run, and where its first such run begins."""
    keys, items, places = known
    found: dict[int, int] = {}
    if len(text) < RUN or not len(keys):
        return found
    # only places whose RUN words are all known
    unknown = np.r_[0, np.cumsum(text == NONE)]
    at = np.flatnonzero(unknown[RUN:] == unknown[:-RUN])
    if not len(at):
        return found
    mine = _run_keys(text)[at]
    low, high = np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right")
    for j in np.flatnonzero(high > low).tolist():
        for k in range(low[j], high[j]):
            i, place, start = int(items[k]), int(places[k]), int(at[j])
            if i not in found and (text[start : start + RUN] == item_words[i][place : place + RUN]).all():
                found[i] = start
    return found


def _lists(items: Items, idf: np.ndarray):
    """Inverted lists: where a word's items start, the items, what each word covers of them
    for a unit of its weight; and how much of each item a window has to cover.

    Coverage is the window's coordinate along an item over the item's length.
    """
    m = item_matrix(items, idf)
    word, item = np.nonzero(m.T)
    shares = m[item, word] / np.maximum((m * m).sum(1), 1e-12)[item]
    lengths = np.array([len(w) for w in items.words])
    needed = COVERED * np.minimum(1.0, 1.5 * PASSAGE / lengths)
    return np.searchsorted(word, np.arange(len(idf) + 1)), item, shares, needed


def leaks_in_block(words: DataFrame, items: Items, id_type, rule: Rule) -> DataFrame:
    idf = idf_weights(words, items)
    basis = latent_space(words, items, idf).astype(np.float32)
    latent = (item_matrix(items, idf) @ basis).astype(np.float32)
    norms = np.linalg.norm(latent, axis=1)
    latent = latent / np.maximum(norms, 1e-12)[:, None]
    context, kind = words.sparkSession.sparkContext, items.kind
    shared = context.broadcast((idf, basis, latent, items.words, items.answers, items.ids))
    by_word = context.broadcast(_lists(items, idf))
    by_run = context.broadcast(_item_runs(items))
    schema = T.StructType(
        [
            T.StructField("doc_id", words.schema["doc_id"].dataType),
            T.StructField("text_hash", T.LongType()),
            T.StructField("item_id", id_type),
            T.StructField("cosine", T.DoubleType()),
            T.StructField("common", T.DoubleType()),
            T.StructField("answer", T.DoubleType()),
            T.StructField("at_word", T.LongType()),
        ]
    )

    def candidates(column, runs):
        """(document, first passage within it, item, cosine) of windows near an item or with a run of it."""
        weight, b, unit, *_ = shared.value
        starts_of, items_of, shares_of, needed = by_word.value
        document, passage, word, times = passages(column, kind)
        passage, word, value, starts = _rows(passage, word, times, weight)
        # a passage counts for the window that it begins and for the one before
        held = starts_of[word + 1] - starts_of[word]
        entry = np.repeat(np.arange(len(word)), held)
        at = np.arange(len(entry)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(starts_of[word], held)
        item, share, own = items_of[at], shares_of[at] * value[entry], passage[entry]
        second = np.flatnonzero((own > 0) & (document[own - 1] == document[own]))
        keys, where = np.unique(
            np.concatenate([own, own[second] - 1]) * len(needed) + np.concatenate([item, item[second]]), return_inverse=True
        )
        covered = np.bincount(where, np.concatenate([share, share[second]]), len(keys))
        keys = keys[covered >= needed[keys % len(needed)]]
        begins = np.searchsorted(document, np.arange(len(column)))
        sure = np.array([(begins[d] + at // PASSAGE) * len(needed) + i for (d, i), at in runs.items()], np.int64)
        keys = np.union1d(keys, sure)
        window, item = keys // len(needed), keys % len(needed)
        vectors = np.zeros((len(window), b.shape[1]), np.float32)
        low, high = np.searchsorted(passage, window), np.searchsorted(passage, window + 2)
        for i in range(len(window)):
            inner = slice(low[i], high[i])
            mine = document[passage[inner]] == document[window[i]]
            vectors[i] = (b[word[inner][mine]] * value[inner][mine][:, None].astype(np.float32)).sum(0)
        near = (vectors * unit[item]).sum(1) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
        some = (near >= COSINE) | np.isin(keys, sure)
        first = np.searchsorted(document, document[window])
        return document[window][some], (window - first)[some], item[some], near[some]

    def run(batches):
        weight, _, _, item_words, answers, ids = shared.value
        content = weight > 0
        least = min(rule.alike, rule.paraphrase)
        for batch in batches:
            for part in _pieces(batch):
                found: dict[tuple[int, int], tuple] = {}
                texts: dict[int, np.ndarray] = {}
                runs: dict[tuple[int, int], int] = {}
                seen: dict[tuple[int, int], set] = {}
                for d, b in enumerate(part.column("words")):
                    text = numbers_of(b.as_py(), kind)
                    runs |= {(d, i): where for i, where in _runs_in(text, by_run.value, item_words).items()}
                for d, p, i, c in zip(*(x.tolist() for x in candidates(part.column("words"), runs))):
                    if d not in texts:
                        texts[d] = numbers_of(part.column("words")[d].as_py(), kind)
                    share, inside, where = _aligned(
                        item_words[i], answers[i], content, texts[d], p * PASSAGE, (p + 2) * PASSAGE,
                        0.0 if (d, i) in runs else least,
                        seen.setdefault((d, i), set()) if len(item_words[i]) > LONG_ITEM else None,
                    )
                    alike = share >= rule.alike or (share >= rule.paraphrase and inside >= rule.answer)
                    if (d, i) in runs and not alike:
                        where = runs[d, i]
                    if alike or (d, i) in runs:
                        if (d, i) not in found or (share, inside) > found[d, i][0]:
                            found[d, i] = ((share, inside), c, where)
                keys = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array([d for d, _ in keys], pa.int64())),
                        part.column("text_hash").take(pa.array([d for d, _ in keys], pa.int64())),
                        pa.array([ids[i] for _, i in keys], _arrow(id_type)),
                        pa.array([float(found[k][1]) for k in keys], pa.float64()),
                        pa.array([found[k][0][0] for k in keys], pa.float64()),
                        pa.array([found[k][0][1] for k in keys], pa.float64()),
                        pa.array([found[k][2] for k in keys], pa.int64()),
                    ],
                    names=[f.name for f in schema],
                )

    return words.mapInArrow(run, schema)


def _arrow(kind):
    return pa.string() if isinstance(kind, T.StringType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.int64()


def leaks(
    docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, text_hash, item_id, cosine, common, answer, at_word: items found in documents.

    Null and empty texts hold no item; items that are null or have no word are never
    found.  Repeated rows of either table are found again (equal items once).  Of a leak by its run alone,
    common and answer are the shares that the text has, at_word is where the run begins.  An empty
    table gives no rows.  Blocks of items are taken one after another, each against all
    documents.
    """
    id_type = benchmark.schema[item_col].dataType
    found = None
    for items in item_blocks(benchmark, item_col, item_text_col):
        words = materialize(encoded(docs, items, id_col, text_col), "numbered-words")
        some = leaks_in_block(words, items, id_type, rule)
        found = some if found is None else found.union(some)
    if found is None:
        kind = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [],
            f"doc_id {kind}, text_hash long, item_id {id_type.simpleString()}, cosine double, common double, answer double, at_word long",
        )
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text"):
    """Rows of docs in which no item is found, all columns as they are."""
    bad = (
        materialize(leaks(docs, benchmark, rule, id_col, text_col), "leaks")
        .select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash"))
        .distinct()
    )
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad_id"]) & (text == bad["_bad_hash"]), "left_anti")
