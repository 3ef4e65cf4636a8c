"""Encoding and decoding against the vocabulary's own library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from trackwell.llm import byte_pairs, queries


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(byte_pairs.vocabulary_path())


@pytest.fixture(scope="module")
def codec():
    with open(byte_pairs.vocabulary_path(), encoding="utf-8") as file:
        return byte_pairs.Codec(file.read())


PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "1", "9", "é", "日本", "语", "!", ",", ".", "<|endoftext|>", "<|endof", " ", "　", "\x1c", "\x85", "😀", "ing", " the", "\x00", " \n"]


def test_texts_of_odd_parts(library, codec):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(14))) for _ in range(6000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in codec.encode_all(texts)] == want
    assert [codec.decode(np.array(i, int)) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_every_code_point(library, codec):
    """Pieces begin and end where the library's do, whatever the character."""
    cut = library.pre_tokenizer.pre_tokenize_str
    wrong = []
    for start in range(0, 0x110000, 256):
        text = "".join(f"a{c}1{c}{c} .{c}  {c}b" for c in map(chr, range(start, start + 256)) if not 0xD800 <= ord(c) < 0xE000)
        at, spans = 0, []
        for piece in codec.split(text):
            spans.append((at, at + len(piece)))
            at += len(piece)
        if spans != [s for _, s in cut(text)]:
            wrong.append(hex(start))
    assert not wrong


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 50_000, "日本" * 20_000, " " * 5000, "x!" * 9000, "z" * 65 + " " + "é" * 33])
def test_long_pieces(library, codec, text):
    assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_that_are_no_text(library, codec):
    rnd = random.Random(6)
    for _ in range(50):
        ids = [rnd.randrange(50257) for _ in range(40)]
        assert codec.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)
    assert codec.decode(np.array([-1, 10**6])) == ""


def test_memory_is_bounded_and_changes_nothing(library, codec, monkeypatch):
    monkeypatch.setattr(byte_pairs, "REMEMBERED", 50)
    rnd = random.Random(7)
    texts = [" ".join("".join(rnd.choice("abcdef") for _ in range(rnd.randrange(1, 50))) for _ in range(40)) for _ in range(30)]
    for text in texts * 2:
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(codec.known) <= 50 + 40 and not any(len(w) > byte_pairs.KEPT_CHARS for w in codec.known)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        byte_pairs.Codec('{"model": {"type": "WordPiece", "vocab": {}}, "added_tokens": []}')


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "Hello there", 5), (3, "Hello there", 5), (None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = byte_pairs.decode(byte_pairs.encode(docs), ids="ids_")
    assert out.columns == ["doc_id", "text", "ids", "ids_", "decoded"]
    got = sorted(((r.doc_id, r.text, r.ids, r.decoded, len(r.ids_)) for r in out.collect()), key=repr)
    assert got == sorted([(1, None, 5, "", 0), (2, "", 5, "", 0), (3, "Hello there", 5, "Hello there", 2), (3, "Hello there", 5, "Hello there", 2), (None, "x", None, "x", 1)], key=repr)
    assert byte_pairs.encode(docs.where("false")).collect() == []
    both = byte_pairs.encode(docs, decoded="text")
    assert both.columns == ["doc_id", "text", "ids", "ids_", "text_"]
    assert sorted(((r.doc_id, r.text, r.ids, r.text_, len(r.ids_)) for r in both.collect()), key=repr) == got


def test_query_against_library(spark, library):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_byte_pairs(spark, sf).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
