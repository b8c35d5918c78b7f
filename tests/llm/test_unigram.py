"""Unigram segmentation against every segmentation of short texts, and round trips."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import queries, unigram

PATH = queries.tokenizer_file("piece_bpe_32k.model")
MODEL = unigram.UnigramModel.load(PATH, "rank")
CODER = unigram.Unigram(MODEL)
PIECES = {p: i for i, (p, _, kind) in enumerate(MODEL.pieces) if kind == unigram.NORMAL}


def best_score(s):
    """The highest total score of a segmentation, by trying every piece at every place."""
    best = [0.0] + [None] * len(s)
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            k = PIECES.get(s[i:j].encode())
            x = MODEL.pieces[k][1] if k is not None else MODEL.unknown_score if j == i + 1 else None
            if x is not None and (best[j] is None or best[i] + x > best[j]):
                best[j] = best[i] + x
    return best[-1]


def score_of(ids):
    return sum(MODEL.pieces[i][1] for i in ids)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aetnrs thé.", max_size=24))
def test_segmentation_is_the_best(text):
    ids = np.frombuffer(CODER.encode(text), "<u4").tolist()
    assert score_of(ids) == pytest.approx(best_score("▁" + text.replace(" ", "▁")) if text else 0)
    assert CODER.decode(CODER.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="▁"), max_size=60))
def test_any_text_comes_back(text):
    assert CODER.decode(CODER.encode(text)) == text


def test_bytes_and_marks():
    assert [MODEL.pieces[i][0] for i in np.frombuffer(CODER.encode("𠀀"), "<u4")] == ["▁".encode(), b"<0xF0>", b"<0xA0>", b"<0x80>", b"<0x80>"]
    assert CODER.decode(CODER.encode("x▁y")) == "x y"  # the marker itself is a blank to the format
    assert CODER.decode(CODER.encode("  a  b ")) == "  a  b "
    assert CODER.encode("") == b""


def test_double_array_holds_its_keys():
    keys = {b"a": 0, b"ab": 1, b"b\xff": 2, b"\x00": 3, b"abc": 4}
    trie = unigram.DoubleArray(keys)

    def look(key):
        state = 0
        for c in key:
            t = trie.base[state] + c + 1
            if t >= len(trie.check) or trie.check[t] != state:
                return -1
            state = t
        return trie.value[state]

    assert {k: look(k) for k in keys} == keys and look(b"b") == -1 and look(b"c") == -1 and look(b"abcd") == -1


def test_operator(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "no id"), (-1, None), (-2, ""), (-3, "wort " * 20000), (-3, "wort " * 20000)], "doc_id long, text string")
    rows = docs.union(odd).collect()
    got = unigram.decode(unigram.encode(docs.union(odd), PATH, "rank"), PATH, "rank").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows) == sorted((r.doc_id is None, r.doc_id or 0, r.decoded) for r in got)
    whole = unigram.round_trip(docs.union(odd), PATH, "rank").collect()
    assert sorted((str(r.doc_id), r.n_tokens, zlib.crc32(r.ids)) for r in got) == sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in whole)
    assert unigram.encode(odd.limit(0), PATH, "rank").count() == 0
    clash = odd.selectExpr("doc_id", "text", "1 as ids", "2 as n_tokens", "3 as decoded")
    assert unigram.encode(clash, PATH, "rank").count() == 5


def message(*fields):
    """A protocol buffer message of (number, value): bytes, whole numbers or floats."""
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            n, size = len(value), b""
            while n > 127:
                size, n = size + bytes([n & 127 | 128]), n >> 7
            out += bytes([number << 3 | 2]) + size + bytes([n]) + value
        else:
            out += bytes([number << 3 | 5]) + struct.pack("<f", value) if isinstance(value, float) else bytes([number << 3, value])
    return out


def model_file(path, kind, normalizer=((3, 1), (4, 0))):
    pieces = [(b"<unk>", 0.0, 2), ("▁".encode(), -3.0, 1), ("▁a".encode(), -2.0, 1), (b"a", -2.5, 1), (b"b", -3.0, 1), (b"ab", -4.0, 1)]
    path.write_bytes(b"".join(message((1, message((1, p), (2, s), (3, k)))) for p, s, k in pieces) + message((2, message((3, kind)))) + message((3, message(*normalizer))))
    return str(path)


def test_scores_of_a_unigram_file_are_taken_and_others_refused(tmp_path):
    model = unigram.UnigramModel.load(model_file(tmp_path / "u", 1))
    assert [p[1] for p in model.pieces] == [0.0, -3.0, -2.0, -2.5, -3.0, -4.0]
    ids = np.frombuffer(unigram.Unigram(model).encode("ab"), "<u4").tolist()
    assert [model.pieces[i][0].decode() for i in ids] == ["▁a", "b"]
    for path in (model_file(tmp_path / "b", 2), model_file(tmp_path / "n", 1, ((2, b"map"), (3, 1), (4, 0))), model_file(tmp_path / "w", 1, ((3, 1), (4, 1)))):
        with pytest.raises(ValueError):
            unigram.UnigramModel.load(path)
    assert sum(np.exp(s) for _, s, kind in MODEL.pieces if kind == unigram.NORMAL) == pytest.approx(1)


def test_long_text_without_blanks():
    text = "aé" * 150_000
    coder = unigram.Unigram(MODEL)
    assert coder.decode(coder.encode(text)) == text and not coder.words
