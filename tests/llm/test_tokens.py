"""Token counts and files against the tokenizer itself."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from marketlens.llm import tokens
from marketlens.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n\n", "Hello, world.", "a  b\tc\r\nd", "don't I'LL 's ...", "x" * 5000, "Straße ÀÉÎ µm² ½ İstanbul ΟΔΟΣ ΣΑΣ.",
    "<|endoftext|> in <|startoftext|>text", "é café ́x", "日本語 テキスト 한국어", "a b\u0085c\u001cd e",
    "42 x1,000.50 (a)[b]{c}", "word. word, word; Word! WORD?", "..", ".,.", "퟿ 😀😀 👩‍👩‍👧", "fi ﬁ Å Å",
]


def reference():
    return Tokenizer.from_file(PATH)


def random_texts(n, seed):
    r = random.Random(seed)
    alphabet = "abcdefgéßA Z  .,;:!?'\n\t012-_日İΣ́<|endoftext|>"
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(80))) for _ in range(n)]


def test_pieces_are_exact():
    encode = tokens.PieceEncoder(PATH)
    texts = [t for t in TEXTS if t is not None] + random_texts(3000, 1)
    plain = reference()
    for text, got in zip(texts, encode(texts)):
        assert np.frombuffer(got, encode.kind).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_slices_end_at_blanks():
    text = " ".join(random_texts(400, 2))
    parts = list(tokens.slices(text, 100))
    assert "".join(parts) == text and len(parts) > 10
    assert all(p[0] in " \n" for p in parts[1:])


def test_long_text_and_full_memory(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 50)
    monkeypatch.setattr(tokens, "SLICE_CHARS", 200)
    texts = [" ".join(random_texts(200, 3)), "one two"] * 2
    encode, plain = tokens.PieceEncoder(PATH), reference()
    for text, got in zip(texts, encode(texts)):
        assert np.frombuffer(got, encode.kind).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_long_pieces_are_not_remembered():
    encode = tokens.PieceEncoder(PATH)
    list(encode(["A" * 500 + " " + "b" * 500 + ", x"]))
    assert max(map(len, encode.memo)) <= tokens.LONG_PIECE


def test_special_strings_keep_their_case():
    encode, plain = tokens.PieceEncoder(PATH), reference()
    for text in ["<|ENDOFTEXT|> a", "<|endoftext|> A", "X<|EndOfText|>", "É<|startoftext|>ß"]:
        assert np.frombuffer(next(encode([text])), encode.kind).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts(tmp_path):
    cased = public_tokenizers.path("byte_bpe_50k.json")
    encode, plain = tokens.PieceEncoder(cased), Tokenizer.from_file(cased)
    assert not encode.split and not encode.lower
    assert tokens.PieceEncoder(PATH).split and tokens.PieceEncoder(PATH).lower
    for text in ["Hello  World A b", "  two  blanks\n\n", "ÀB ß"]:
        assert np.frombuffer(next(encode([text])), encode.kind).tolist() == plain.encode(text, add_special_tokens=False).ids
    described = json.loads(open(PATH, encoding="utf-8").read())
    described["normalizer"]["normalizers"].pop()  # the same without lower case
    path = str(tmp_path / "cased.json")
    with open(path, "w", encoding="utf-8") as out:
        json.dump(described, out)
    encode, plain = tokens.PieceEncoder(path), Tokenizer.from_file(path)
    assert encode.split and not encode.lower
    for text in TEXTS[1:] + random_texts(300, 4):
        assert np.frombuffer(next(encode([text])), encode.kind).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_counts(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "a b", "x"), (3, "\n\n", "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    plain = reference()
    got = sorted(map(tuple, tokens.count_tokens(df, PATH).collect()), key=str)
    want = [(i, len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert tokens.count_tokens(df.limit(0), PATH).collect() == []


def test_files_round_trip(spark):
    rows = [(i * 7 % 19, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (3, "b"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = tokens.write_token_ids(df, PATH, scratch_path(spark, "ids"), end_id=2)
    stored = tokens.read_token_ids(spark, path)
    plain = reference()
    by_order = [r for r in stored.orderBy("seq").collect()]
    assert [r.doc_id for r in by_order] == sorted([r[0] for r in rows], key=lambda i: (i is not None, i or 0))
    found = sorted((str(r.doc_id), list(r.ids)) for r in by_order)
    assert found == sorted((str(i), plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    starts, at = {}, 0
    for r in by_order:
        crc = zlib.crc32(np.array(r.ids, "<u4").tobytes())
        starts.setdefault(r.doc_id, []).append((at, len(r.ids), crc))
        at += len(r.ids)
    for r in tokens.token_offsets(stored).collect():
        assert (r.start, r.n_tokens, r.ids_crc32) in starts[r.doc_id]
    assert stored.filter("doc_id = 14").count() == 1
    wide = tokens.read_token_ids(spark, tokens.write_token_ids(df, PATH, scratch_path(spark, "ids"), end_id=70_000))
    assert sorted((str(r.doc_id), list(r.ids)[:-1], r.ids[-1]) for r in wide.collect()) == [(i, v[:-1], 70_000) for i, v in found]
    assert tokens.token_offsets(tokens.read_token_ids(spark, path).limit(0)).collect() == []


def test_rare_words_of_many_texts_are_encoded_together():
    encode, plain, calls = tokens.PieceEncoder(PATH), reference(), []
    for name in ("_encode", "_encode_words"):
        kept = getattr(encode, name)
        setattr(encode, name, lambda part, kept=kept: (calls.append(len(part)), kept(part))[1])
    r = random.Random(5)
    words = ["".join(r.choice("aeinorstéÈ") for _ in range(9)) for _ in range(1000)]
    texts = [f"{words[2 * i]} {words[2 * i + 1]}, {words[i]}." for i in range(500)]
    for _ in range(2):
        got = [np.frombuffer(b, encode.kind).tolist() for b in encode(texts)]
        assert got == [e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
    assert len(calls) <= 4 and sum(calls) <= 1004


def test_memory_drops_what_was_met_longest_ago(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 40)
    encode, plain = tokens.PieceEncoder(PATH), reference()
    for i, text in enumerate(random_texts(300, 6)):
        text += " kept, always."
        assert np.frombuffer(next(encode([text])), encode.kind).tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(encode.memo) <= 40 and {"kept", "always", ",", "."} <= set(encode.memo)


def test_long_texts_among_short_ones(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_CHARS", 100)
    texts = ["", *random_texts(50, 7), " ".join(random_texts(100, 8)), "", "y" * 1000, "a\nb", ""]
    encode, plain = tokens.PieceEncoder(PATH), reference()
    column = pa.array(["out", *texts, "side"]).slice(1, len(texts))
    lengths, ids = encode.columns(column)
    want = [e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
    assert lengths.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def edited(path, change):
    described = json.loads(open(PATH, encoding="utf-8").read())
    change(described)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(described, out)
    return str(path)


def test_special_strings_of_letters_and_signs(tmp_path):
    def change(described):
        for i, content in enumerate(["abc", "end."]):
            described["added_tokens"].append({**described["added_tokens"][0], "id": 49408 + i, "content": content})

    path = edited(tmp_path / "special.json", change)
    encode, plain = tokens.PieceEncoder(path), Tokenizer.from_file(path)
    assert encode.letters_apart
    for text in ["xabcx ABC abc, Abc!", "the end. END. end end.. bend.x", "dabce.,"]:
        assert np.frombuffer(next(encode([text])), encode.kind).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_words_split_otherwise_are_encoded_as_they_are(tmp_path):
    for i, pattern in enumerate([r"[^\s]+", r"[^\s\p{L}\p{N}]?[\p{L}]+|[^\s\p{L}]+", r"[\p{L}]+[.]|[\p{L}]+|[^\s\p{L}]+"]):
        def change(described):
            described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = pattern

        path = edited(tmp_path / f"split{i}.json", change)
        encode, plain = tokens.PieceEncoder(path), Tokenizer.from_file(path)
        assert encode.split and not encode.letters_apart
        for text in ["word, word. WORD", "(a) b.c é, it's", *random_texts(100, 9)]:
            assert np.frombuffer(next(encode([text])), encode.kind).tolist() == plain.encode(text, add_special_tokens=False).ids, pattern


def test_accents_taken_off_by_the_tokenizer(tmp_path):
    def change(described):
        described["normalizer"]["normalizers"][0]["type"] = "NFD"

    path = edited(tmp_path / "nfd.json", change)
    encode, plain = tokens.PieceEncoder(path), Tokenizer.from_file(path)
    for text in ["Été, à côté. plain", *random_texts(100, 10)]:
        assert np.frombuffer(next(encode([text])), encode.kind).tolist() == plain.encode(text, add_special_tokens=False).ids
