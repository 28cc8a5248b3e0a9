"""Byte-level BPE against the library that the ranks are made for."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from marketlens.llm import byte_bpe
from marketlens.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [
    None, "", " ", "\n\n  \t", "Hello, world. It's we'll 've 'LL don''t", "a  b\tc\r\nd   ", "x" * 500, " " * 300 + "y",
    "Straße ÀÉÎ µm² ½ ΟΔΟΣ", "<|endoftext|>", "日本語 テキスト 한국어", "a b\u0085c\u001cd e", "😀👩‍👩‍👧 ﷺ́",
    "1,000.50 (a)[b]{c}", "'" * 40 + "ll" * 30, "ab" * 200 + " \n" * 100,
]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 40)
    monkeypatch.setattr(byte_bpe, "OVERLAP", 16)


def random_texts(n, seed, length=400):
    r = random.Random(seed)
    alphabet = "abé日12 '\n\t.!<sdmtlrv  "
    return ["".join(r.choice(alphabet) * r.choice((1, 1, 1, 2, 9)) for _ in range(r.randrange(length))) for _ in range(n)]


def want(library, rows):
    out = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        out.append(
            (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        )
    return sorted(out, key=str)


def test_query_equals_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, QUERIES["op12_byte_bpe"](spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == want(library, docs)


def test_stitched_chunks_equal_library(spark, library, small_chunks):
    rows = [(i, t) for i, t in enumerate(TEXTS + random_texts(300, 1))] + [(None, "a b" * 50), (3, "again " * 40), (3, "again " * 40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, row int").repartition(5)
    parts = byte_bpe.encode_parts(df, PATH, PATTERN)
    assert sorted(map(tuple, byte_bpe.digests(parts, PATH).collect()), key=str) == want(library, rows)
    some = parts.filter("row IS NOT NULL").groupBy("row").count().collect()
    assert max(r["count"] for r in some) > 5  # texts are stitched from many parts
    texts = {}
    for r in byte_bpe.decode_parts(parts, PATH).orderBy("row", "part").collect():
        texts.setdefault((r.doc_id, r.row), []).append(bytes(r.bytes))
    assert sorted((str(i), b"".join(b).decode()) for (i, row), b in texts.items() if row is not None) == sorted(
        (str(i), t) for i, t in rows if len((t or "").encode()) > 40
    )
    got = sorted((str(r.doc_id), list(r.ids)) for r in byte_bpe.encode(df, PATH, PATTERN).collect())
    assert got == sorted((str(i), library.encode_ordinary(t or "")) for i, t in rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert byte_bpe.digests(byte_bpe.encode_parts(df, PATH, PATTERN), PATH).collect() == []


def test_full_memory(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 20)
    bpe = byte_bpe.ByteBpe(PATH)
    most = 20
    for t in random_texts(200, 2):
        pieces = byte_bpe.regex.findall(PATTERN, t)
        most = max(most, len(set(pieces)))
        assert np.frombuffer(bpe.encode(pieces), "<u4").tolist() == library.encode_ordinary(t)
        assert len(bpe.memo) <= most


def test_sure_boundaries_hold_whatever_follows():
    r = random.Random(4)
    scan = byte_bpe.regex.compile(PATTERN)
    for text in random_texts(300, 5, 30):
        cut = r.randrange(len(text) + 1)
        whole = set(byte_bpe.spans(scan, text)[1].tolist())
        begun = byte_bpe.spans(scan, text[:cut])[1]
        assert {e for e in begun.tolist() if e <= byte_bpe.sure_until(text[:cut])} <= whole
