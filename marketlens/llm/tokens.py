"""Token counts and token-id files with a public tokenizer.

Texts go to the tokenizer as pieces between blanks and line feeds, which is exact
for tokenizers that drop white space: no token, normalisation or special string
reaches across a blank.  Whether one does is read from its file; others get whole
texts.  The distinct pieces of many texts are found by Arrow; a worker remembers the ids
of those it has met, so most of a text is looked up instead of encoded.  The memory is
bounded and never decides a result.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F

from marketlens.session import materialize, ship_package

SLICE_CHARS = 1 << 20  # longer texts are cut at a blank
GROUP_BYTES = 8 << 20  # text whose distinct pieces are found at a time
BATCH_BYTES = 1 << 20  # pieces that go to the tokenizer at a time
MEMO_PIECES = 600_000  # pieces in a worker's memory, two Arrow columns
LONG_PIECE = 64  # longer pieces are not remembered
TAIL = ".,;:!?"
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ÿ"  # the letters below U+0100: neither NFC nor lower case joins or parts them
WORD_END = "</w>"  # how a vocabulary marks tokens that end a word
WORDS_A_TEXT = 4096


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """Parts of a text, cut only at blanks or line feeds."""
    at, n = 0, len(text)
    while n - at > size:
        ends = [p for p in (text.find(" ", at + size), text.find("\n", at + size)) if p >= 0]
        if not ends:
            break
        yield text[at : min(ends)]
        at = min(ends)
    yield text[at:] if at else text


def _drops_white_space(tokenizer: dict) -> bool:
    """Whether no token, normalisation or special string of a tokenizer file reaches across a blank.

    So it is if white space is at most turned into blanks, and a first split keeps
    matches without white space alone.
    """
    step = tokenizer.get("normalizer") or {}
    steps = step.get("normalizers", [step] if step else [])
    for step in steps:
        blank = step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "
        if not blank and step["type"] not in ("NFC", "NFD", "Lowercase"):
            return False
    split = tokenizer.get("pre_tokenizer") or {}
    split = split.get("pretokenizers", [split])[0]
    if split.get("type") != "Split" or split["behavior"] != "Removed" or not split["invert"] or "Regex" not in split["pattern"]:
        return False
    matches = regex.findall(split["pattern"]["Regex"], _PROBE)
    return not any(c.isspace() for m in matches for c in m) and not any(
        c.isspace() for token in tokenizer["added_tokens"] for c in token["content"]
    )


_BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u2003\u2028\u3000"
_PROBE = "".join(a + w + b for w in [*_BLANKS, "  ", " \n", "\r\n"] for a in ("ab", "7", "'s", "é", ".!", "日") for b in ("cd", "8", "'t", "-"))


def _letters_apart(tokenizer: dict) -> bool:
    """Whether a tokenizer file keeps a run of letters whole, with signs behind it apart.

    Its first split must do so, the next only spells the parts in bytes.
    """
    split, *rest = (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    pattern = split.get("pattern", {}).get("Regex", "")
    first, letters, then = pattern.partition("[\\p{L}]+|")
    contractions = first.removesuffix("|").split("|") if first else []  # start at an apostrophe, so take no letter from a run
    return (
        bool(letters)
        and '"NFD"' not in json.dumps(tokenizer.get("normalizer"))  # which takes accents off their letters
        and all(re.fullmatch("'[a-z]+", c) for c in contractions)
        and set(then.split("|")) <= {"[\\p{N}]", "[\\p{N}]+", "[^\\s\\p{L}\\p{N}]+"}
        and [{k: r.get(k) for k in ("type", "add_prefix_space", "use_regex")} for r in rest]
        == [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
    )


class PieceEncoder:
    """Ids of texts as little-endian unsigned integers, of 16 bits if all ids fit, else 32.

    `white_space_dropped` says whether texts may be cut at blanks; by default it is read
    from the tokenizer file, and texts of other tokenizers are encoded whole.
    """

    def __init__(self, path: str, white_space_dropped: bool | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as lines:
            described = json.load(lines)
        self.tokenizer = Tokenizer.from_file(path)
        self.split = _drops_white_space(described) if white_space_dropped is None else white_space_dropped
        self.letters_apart = _drops_white_space(described) and _letters_apart(described)
        self.lower = "Lowercase" in json.dumps(described.get("normalizer"))
        self.added = "|".join(re.escape(t["content"].lower()) for t in described["added_tokens"])
        # the same model behind a plain split: enough for Latin words in the form the tokenizer gives them
        self.words_only = Tokenizer(self.tokenizer.model)
        self.words_only.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        largest = max(vocabulary.values(), default=0)
        self.kind = np.dtype("<u2" if largest < 1 << 16 else "<u4")
        self.ends_word = np.zeros(largest + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith(WORD_END)]] = True
        self.pieces, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.met, self.tick = np.zeros(0, np.int64), 0

    @property
    def memo(self) -> list[str]:
        """The remembered pieces."""
        return self.pieces.to_pylist()

    def _encode(self, pieces: list[str]) -> Iterator[bytes]:
        """Batches of about equal bytes."""
        batch, size = [], 0
        for i, piece in enumerate(pieces):
            batch.append(piece)
            size += len(piece) + 8
            if size >= BATCH_BYTES or i + 1 == len(pieces):
                for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False):
                    yield np.array(e.ids, dtype=self.kind).tobytes()
                batch, size = [], 0

    def _encode_words(self, words: list[str]) -> pa.Array:
        """Plain words, many in one text: each ends at a token that ends a word."""
        width = self.kind.itemsize
        found = [pa.array([], pa.large_binary())]
        for at in range(0, len(words), WORDS_A_TEXT):
            part = words[at : at + WORDS_A_TEXT]
            (encoded,) = self.words_only.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(encoded.ids, dtype=self.kind)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                found.append(pa.array(self._encode(part), pa.large_binary()))
                continue
            offsets = pa.py_buffer(np.concatenate(([0], width * ends)).astype(np.int64))
            found.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, offsets, pa.py_buffer(ids)]))
        return pa.concat_arrays(found)

    def _plain(self, pieces: pa.Array, words: pa.Array) -> pa.Array:
        """Whether words, parts of pieces, are of Latin letters and no special string is in their pieces."""
        if not self.letters_apart:
            return pa.repeat(False, len(pieces))
        plain = pc.match_substring_regex(words, f"^[{LATIN}]+$")
        if self.added:
            plain = pc.and_not(plain, pc.match_substring_regex(pc.utf8_lower(pieces), self.added))
        return plain

    def _learned(self, pieces: pa.Array) -> pa.Array:
        """Ids of pieces that are not remembered."""
        plain = self._plain(pieces, pieces)
        words, others = pieces.filter(plain), pieces.filter(pc.invert(plain))
        ids = pa.concat_arrays([self._encode_words(words.to_pylist()), pa.array(self._encode(others.to_pylist()), pa.large_binary())])
        plain = plain.to_numpy(zero_copy_only=False)
        places = np.where(plain, np.cumsum(plain), len(words) + np.cumsum(~plain)) - 1
        return ids.take(pa.array(places))

    def _remember(self, pieces: pa.Array, ids: pa.Array) -> None:
        """Beyond the bound the half met last stays."""
        short = pc.less_equal(pc.utf8_length(pieces), LONG_PIECE)
        self.pieces = pa.concat_arrays([self.pieces, pieces.filter(short)])
        self.ids = pa.concat_arrays([self.ids, ids.filter(short)])
        self.met = np.append(self.met, np.full(len(self.pieces) - len(self.met), self.tick))
        if len(self.pieces) > MEMO_PIECES:
            kept = np.sort(np.argsort(-self.met, kind="stable")[: MEMO_PIECES // 2])
            self.pieces, self.ids, self.met = self.pieces.take(pa.array(kept)), self.ids.take(pa.array(kept)), self.met[kept]

    def _ids(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces; a remembered one is looked up."""
        self.tick += 1
        places = pc.index_in(pieces, value_set=self.pieces)
        missing = pieces.filter(pc.is_null(places))
        learned = self._learned(missing)
        places = places.to_numpy(zero_copy_only=False)
        new = np.isnan(places) if len(missing) else np.zeros(len(pieces), bool)
        self.met[places[~new].astype(np.int64)] = self.tick
        places = np.where(new, len(self.pieces) + np.cumsum(new) - 1, places).astype(np.int64)
        ids = pa.concat_arrays([self.ids, learned]).take(pa.array(places))
        self._remember(missing, learned)
        return ids

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Like `columns`, of texts that are not long: a Latin word with punctuation behind it is the word and the punctuation."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.values.dictionary_encode()
        pieces = coded.dictionary
        words = pc.ascii_rtrim(pieces, TAIL)
        plain = self._plain(pieces, words)
        words = pc.if_else(plain, pc.utf8_lower(words) if self.lower else words, pieces)
        tailed = pc.not_equal(pc.binary_length(words), pc.binary_length(pieces))
        tails = pc.extract_regex(pieces.filter(tailed), f"(?P<tail>[{TAIL}]+)$").field("tail")
        keys = pa.concat_arrays([words, tails, pa.array([""])]).dictionary_encode()
        places = keys.indices.to_numpy()
        behind = np.full(len(pieces), places[-1])
        behind[tailed.to_numpy(zero_copy_only=False)] = places[len(pieces) : -1]
        ids = self._ids(keys.dictionary)
        ids = pc.binary_join_element_wise(ids.take(pa.array(places[: len(pieces)])), ids.take(pa.array(behind)), pa.scalar(b"", pa.large_binary()))
        found = ids.take(coded.indices)
        ends = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1][lists.offsets.to_numpy()]
        return np.diff(ends) // self.kind.itemsize, np.frombuffer(found.buffers()[2] or b"", self.kind, ends[-1] // self.kind.itemsize)

    def columns(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all texts."""
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, self.kind)
        if not self.split:
            rows = list(self._encode(texts.to_pylist()))
            return np.array([len(b) // self.kind.itemsize for b in rows]), np.frombuffer(b"".join(rows), self.kind)
        if _byte_lengths(texts).max() <= SLICE_CHARS:
            return self._cut(texts)
        cut = [list(slices(text)) for text in texts.to_pylist()]
        parts = pa.RecordBatch.from_arrays([pa.array([part for row in cut for part in row], pa.string())], names=["text"])
        lengths, ids = zip(*(self._cut(some.column("text")) for some in _small(parts)))
        firsts = np.cumsum([0] + [len(row) for row in cut[:-1]])
        return np.add.reduceat(np.concatenate(lengths), firsts), np.concatenate(ids)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        lengths, ids = self.columns(pa.array(texts, pa.string()))
        at = 0
        for end in np.cumsum(lengths).tolist():
            yield ids[at:end].tobytes()
            at = end


def encoder(path: str, white_space_dropped: bool | None) -> PieceEncoder:
    """One encoder for a worker process and tokenizer, kept from task to task."""
    kept = sys.modules.setdefault("_marketlens_encoders", types.ModuleType("_marketlens_encoders"))
    key = f"{path}|{white_space_dropped}"
    if key not in kept.__dict__:
        kept.__dict__[key] = PieceEncoder(path, white_space_dropped)
    return kept.__dict__[key]


def _small(batch: pa.RecordBatch, limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `limit` bytes of text at most."""
    ends = np.cumsum(_byte_lengths(batch.column("text")))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def _byte_lengths(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def _input(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def count_tokens(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", white_space_dropped: bool | None = None
) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row; only lengths leave the workers.

    A null text counts as empty (0 tokens).  Repeated rows and null ids give a row
    each.  Other columns are not read.  An empty table gives no rows.
    """
    ship_package()
    schema = T.StructType(
        [
            T.StructField("doc_id", df.schema[id_col].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def run(batches):
        encode = encoder(tokenizer_path, white_space_dropped)
        for whole in batches:
            for batch in _small(whole):
                counts, _ = encode.columns(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(_byte_lengths(batch.column("text"))),
                        pa.array(counts, pa.int64()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    return _input(df, id_col, text_col).mapInArrow(run, schema)


def write_token_ids(
    df: DataFrame,
    tokenizer_path: str,
    path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    white_space_dropped: bool | None = None,
) -> str:
    """Writes an ORC row (seq, doc_id, ids) for each document, in ascending order of id.

    Rows are dealt by ranges of the id, so file k holds smaller ids than file k + 1,
    and each task writes its own files: integers are run-length encoded, every 10,000
    rows have an index entry, and a Bloom filter of doc_id lets a reader skip whole
    stripes.  seq rises through all files in order (partition << 33 | row).  Null ids
    come first, a null text has only the end id, equal ids are in order of the hash of
    their texts.
    """
    ship_package()
    schema = T.StructType(
        [T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )

    def run(batches):
        encode = encoder(tokenizer_path, white_space_dropped)
        for whole in batches:
            for batch in _small(whole):
                counts, found = encode.columns(batch.column("text"))
                offsets = np.concatenate(([0], np.cumsum(counts + 1))).astype(np.int32)
                values = np.full(offsets[-1], end_id, np.int32)
                inner = np.ones(len(values), bool)
                inner[offsets[1:] - 1] = False
                values[inner] = found
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=schema.names)

    rows = _input(df, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    spread = rows.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text")
    (
        spread.select("doc_id", "text").mapInArrow(run, schema)
        .select(F.monotonically_increasing_id().alias("seq"), "doc_id", "ids")
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", str(32 << 20))
        .option("orc.row.index.stride", "10000")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )
    return path


def read_token_ids(spark, path: str) -> DataFrame:
    """Rows of the files: seq, doc_id, ids.  Filters on doc_id prune stripes."""
    return spark.read.orc(path)


def token_offsets(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the rows that `read_token_ids` gives.

    Files are summed apart; only one total a file meets in one task.
    """
    ship_package()
    schema = T.StructType(
        [
            T.StructField("seq", T.LongType()),
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).view(np.uint8)
            crcs = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("seq"),
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array(crcs, pa.int64()),
                ],
                names=["seq", "doc_id", "n_tokens", "ids_crc32"],
            )

    thin = materialize(
        rows.select("seq", "doc_id", "ids").mapInArrow(run, schema).withColumn("part", F.shiftright("seq", 33)),
        "token-lengths",
    )
    totals = thin.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select(
        "part",
        (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"),
    )
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    # one row a file: bounded by the number of files
    return thin.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("before") + within).alias("start"), "n_tokens", "ids_crc32"
    )
