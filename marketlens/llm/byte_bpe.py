"""Byte-level BPE by overlapping chunks.

Short texts are pre-tokenised and encoded whole.  Long texts are cut into chunks that
overlap, and every chunk is pre-tokenised on its own, by any task.  A chunk may begin
amid a pre-token, so its first boundaries can be wrong; but the pre-tokens after a
boundary depend on the text after it alone, so from the first boundary that a chunk
shares with the one before, both agree.  That boundary is where the two are stitched.
Where an overlap has no shared boundary (one pre-token fills it), the chunks are joined
and scanned as one.  Then the pieces of each chunk's own part are encoded, in parallel.

Only positions take part in the stitching; ids travel as 32-bit integers, part by part,
so no task holds the ids of a whole long text.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F

from marketlens.session import materialize, ship_package

CHUNK = 1 << 16  # characters from one chunk's start to the next's
OVERLAP = 1 << 12
LOOKAHEAD = 3  # characters that a match reads beyond the run of its last class
MEMO_PIECES = 500_000  # pieces remembered by a worker before it starts anew
LONG_PIECE = 64  # longer pieces are not remembered


class ByteBpe:
    """Ids of pieces and bytes of ids, by a file of ranks."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.ranks = ranks
        # the pattern of the encoding is not used: pieces are handed over one by one
        self.core = tiktoken.Encoding("ranks", pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.memo: dict[str, bytes] = {}

    def encode(self, pieces: list[str]) -> bytes:
        """Ids of the pieces, each encoded separately, as little-endian 32-bit integers."""
        unknown = set(pieces).difference(self.memo)
        if unknown and len(self.memo) + len(unknown) > MEMO_PIECES:
            self.memo.clear()
            unknown = set(pieces)
        for piece in unknown:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            ids = [rank] if rank is not None else self.core.encode_single_piece(raw)
            self.memo[piece] = np.array(ids, "<u4").tobytes()
        out = b"".join(map(self.memo.__getitem__, pieces))
        for piece in unknown:
            if len(piece) > LONG_PIECE:
                del self.memo[piece]
        return out

    def decode(self, ids: bytes) -> bytes:
        """Raw bytes of the ids, one after another; an id without a rank is refused."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def vocabulary(path: str) -> ByteBpe:
    """One vocabulary for a worker process and file, kept from task to task."""
    kept = sys.modules.setdefault("_marketlens_byte_bpe", types.ModuleType("_marketlens_byte_bpe"))
    if path not in kept.__dict__:
        kept.__dict__[path] = ByteBpe(path)
    return kept.__dict__[path]


def spans(pattern, text: str, first: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches from `first` on that begin before `end`."""
    starts, ends = [], []
    for match in pattern.finditer(text, first):
        start, stop = match.span()
        if end is not None and start >= end:
            break
        starts.append(start)
        ends.append(stop)
    return np.array(starts, np.int32), np.array(ends, np.int32)


def sure_until(text: str) -> int:
    """Matches that end here or before would be the same whatever follows the text.

    A match reads no further than the run of characters of one class that it ends in
    (for white space: the whole run) and LOOKAHEAD characters.
    """
    return min(len(text.rstrip()) if text[-1:].isspace() else len(text), len(text) - LOOKAHEAD)


def chunks(text: str) -> Iterable[tuple[int, int, str, bool]]:
    """Number, start and text of each chunk, and whether it reaches the end."""
    for number, at in enumerate(range(0, max(len(text), 1), CHUNK)):
        yield number, at, text[at : at + CHUNK + OVERLAP], at + CHUNK + OVERLAP >= len(text)
        if at + CHUNK >= len(text):
            return


def _chunk_rows(df: DataFrame) -> DataFrame:
    """row, doc_id, chunk, start, text of the chunks of (doc_id, text)."""
    names = ["row", "doc_id", "chunk", "start", "last", "text"]
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            df.schema["doc_id"],
            T.StructField("chunk", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("last", T.BooleanType()),
            T.StructField("text", T.StringType()),
        ]
    )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held = [[], [], [], []]
                for found in chunks(batch.column("text")[i].as_py()):
                    for kept, value in zip(held, (found[0], found[1], found[3], found[2])):
                        kept.append(value)
                    if len(held[0]) == 16:
                        yield record(batch, i, held)
                        held = [[], [], [], []]
                if held[0]:
                    yield record(batch, i, held)

    def record(batch, i, held):
        same = pa.array([i] * len(held[0]))
        kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column("row").take(same), batch.column("doc_id").take(same), *map(pa.array, held, kinds)], names=names
        )

    return df.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").mapInArrow(run, schema)


def _pre_tokenised(rows: DataFrame, pattern: str) -> DataFrame:
    """Chunks with the spans of their pre-tokens and the sure boundaries of both overlaps."""
    fields = [
        T.StructField("starts", T.BinaryType()),
        T.StructField("ends", T.BinaryType()),
        T.StructField("head", T.ArrayType(T.LongType())),
        T.StructField("tail", T.ArrayType(T.LongType())),
    ]
    schema = T.StructType([*rows.schema.fields, *fields])

    def run(batches):
        scan = regex.compile(pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                text, base = batch.column("text")[i].as_py(), batch.column("start")[i].as_py()
                starts, ends = spans(scan, text)
                sure = ends if batch.column("last")[i].as_py() else ends[ends <= sure_until(text)]
                head = np.r_[0, sure[sure <= OVERLAP]].astype(np.int64) + base
                tail = sure[sure >= CHUNK].astype(np.int64) + base
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *one.columns,
                        pa.array([starts.tobytes()], pa.binary()),
                        pa.array([ends.tobytes()], pa.binary()),
                        pa.array([head], pa.list_(pa.int64())),
                        pa.array([tail], pa.list_(pa.int64())),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def _stitched(rows: DataFrame) -> DataFrame:
    """row, chunk, run, own_start, own_end: each chunk's own part; chunks of a run are one scan.

    A run begins at the first boundary that its first chunk shares with the chunk before.
    """
    by = Window.partitionBy("row").orderBy("chunk")
    shared = F.array_min(F.array_intersect("head", F.lag("tail").over(by)))
    met = rows.select("row", "chunk", "start", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(shared).alias("met"))
    own = met.select(
        "row",
        "chunk",
        F.sum(F.col("met").isNotNull().cast("int")).over(by).alias("run"),
        F.coalesce("met", "start").alias("own_start"),
        F.lead(F.coalesce("met", "start")).over(by).alias("own_end"),
    )
    alone = F.count("*").over(Window.partitionBy("row", "run")) == 1
    return own.withColumn("alone", alone)


def _encoded_long(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """row, doc_id, part, ids of long texts."""
    rows = materialize(_pre_tokenised(_chunk_rows(df), pattern), "pre-tokens")
    stitched = rows.join(_stitched(rows.select("row", "chunk", "start", "head", "tail")), ["row", "chunk"])
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            df.schema["doc_id"],
            T.StructField("part", T.IntegerType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def record(batch, i, ids):
        one = batch.slice(i, 1)
        return pa.RecordBatch.from_arrays(
            [one.column("row"), one.column("doc_id"), one.column("run"), pa.array([ids], pa.binary())], names=schema.names
        )

    def encode_chunks(batches):
        bpe = vocabulary(path)
        for batch in batches:
            for i in range(batch.num_rows):
                of = {c: batch.column(c)[i].as_py() for c in ("text", "start", "own_start", "own_end", "starts", "ends")}
                starts, ends = np.frombuffer(of["starts"], np.int32), np.frombuffer(of["ends"], np.int32)
                own = starts >= of["own_start"] - of["start"]
                if of["own_end"] is not None:
                    own &= starts < of["own_end"] - of["start"]
                pieces = [of["text"][a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist())]
                yield record(batch, i, bpe.encode(pieces))

    def encode_joined(batches):
        bpe, scan = vocabulary(path), regex.compile(pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column("parts")[i].as_py()
                first, last = parts[0], parts[-1]
                text = "".join([p["text"][:CHUNK] for p in parts[:-1]] + [last["text"]])
                end = None if last["own_end"] is None else last["own_end"] - first["start"]
                starts, ends = spans(scan, text, first["own_start"] - first["start"], end)
                yield record(batch, i, bpe.encode([text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]))

    single = stitched.filter("alone").select(
        "row", "doc_id", F.col("run").cast("int").alias("run"), "text", "start", "own_start", "own_end", "starts", "ends"
    )
    # as many chunks as one pre-token or run without a shared boundary is long
    joined = (
        stitched.filter("NOT alone")
        .groupBy("row", "doc_id", F.col("run").cast("int").alias("run"))
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "start", "own_start", "own_end", "text"))).alias("parts"))
    )
    return single.mapInArrow(encode_chunks, schema).union(joined.mapInArrow(encode_joined, schema))


def encode_parts(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """row, doc_id, part, whole, ids (binary: little-endian 32-bit integers) of every text.

    A short text is one whole part and has no row number; the parts of a long text share a row
    number and are in order of part.  Null texts are empty and have no ids.  Repeated rows
    and null ids stay rows of their own.  Other columns are not read.  An empty table
    gives no rows.  Matches of the pattern must not be empty.
    """
    ship_package()
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.BinaryType())])

    def run(batches):
        bpe, scan = vocabulary(ranks_path), regex.compile(pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [bpe.encode(scan.findall(t.as_py())) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=schema.names)

    long = F.octet_length("text") > CHUNK
    short = (
        rows.filter(~long)
        .mapInArrow(run, schema)
        .select(F.lit(None).cast("long").alias("row"), "doc_id", F.lit(0).alias("part"), F.lit(True).alias("whole"), "ids")
    )
    stitched = _encoded_long(rows.filter(long), ranks_path, pattern)
    # whole is a literal on both sides, so a filter on it leaves one side of the union unread
    return short.union(stitched.select("row", "doc_id", "part", F.lit(False).alias("whole"), "ids"))


def decode_parts(parts: DataFrame, ranks_path: str) -> DataFrame:
    """row, doc_id, part, whole, bytes of rows that `encode_parts` gives; parts in order make the text."""
    ship_package()
    fields = [f for f in parts.schema if f.name != "ids"]
    schema = T.StructType([*fields, T.StructField("bytes", T.BinaryType())])

    def run(batches):
        bpe = vocabulary(ranks_path)
        for batch in batches:
            raw = pa.array([bpe.decode(b.as_py()) for b in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), raw], names=schema.names)

    return parts.mapInArrow(run, schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), a row a text; a text whose ids fit no row needs `encode_parts`."""
    parts = encode_parts(df, ranks_path, pattern, id_col, text_col)
    schema = T.StructType([parts.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in row.as_py()), "<u4").astype(np.int32) for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=schema.names)

    listed = F.struct("part", "ids")
    short = parts.filter("whole").select("doc_id", F.array(listed).alias("p"))
    long = parts.filter("NOT whole").groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(listed)).alias("p"))
    return short.union(long.select("doc_id", "p")).mapInArrow(run, schema)


def digests(parts: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the texts that `encode_parts` gives.

    Bytes are decoded from the ids.  The parts of a long text run through one task in
    order, one part in memory at a time, as its hash demands.
    """
    ship_package()
    schema = T.StructType(
        [
            parts.schema["doc_id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def whole(batches):
        bpe = vocabulary(ranks_path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            yield record(
                batch.column("doc_id"),
                [(len(b) // 4, hashlib.sha256(b).hexdigest(), hashlib.sha256(bpe.decode(b)).hexdigest()) for b in ids],
            )

    def in_order(batches):
        bpe, now, doc, state = vocabulary(ranks_path), None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row, ids = batch.column("row")[i].as_py(), batch.column("ids")[i].as_py()
                if row != now:
                    if state:
                        yield record(doc, [finished(state)])
                    now, doc, state = row, batch.column("doc_id").slice(i, 1), [0, hashlib.sha256(), hashlib.sha256()]
                state[0] += len(ids) // 4
                state[1].update(ids)
                state[2].update(bpe.decode(ids))
        if state:
            yield record(doc, [finished(state)])

    def finished(state):
        return state[0], state[1].hexdigest(), state[2].hexdigest()

    def record(docs, rows):
        kinds = (pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays(
            [docs, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=schema.names
        )

    short = parts.filter("whole").select("doc_id", "ids").mapInArrow(whole, schema)
    long = parts.filter("NOT whole").repartition("row").sortWithinPartitions("row", "part")
    return short.union(long.select("row", "doc_id", "ids").mapInArrow(in_order, schema))
