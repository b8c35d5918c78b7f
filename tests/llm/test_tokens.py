"""Record files and packing: exact ids against the library, round trips, odd inputs."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import packing, queries, records, shared
from quillon.llm.word_tokens import WordEncoder

PATH = queries.tokenizer_file()
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = WordEncoder(PATH, most_words=50)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["", None, " ", "  x", "don't WON'T 'S", "á é.", "<|endoftext|>x <|startoftext|>", "İstanbul ﬁ Ⅷ ² 12345", "\x85a\x1cb\x1f", "日本語。テスト", "x" * 3000, "!!?? ...", "Ünï,cödé!", "́a", "𝔘𝔫𝔦 👩‍👩‍👧"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aB'stre d.,!\n\t 19́İß "), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_word_encoder_gives_the_library_ids(texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts)]
    assert got == [ids_of(t) for t in texts]


def test_word_encoder_on_odd_texts():
    assert ENCODER.by_chunk
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(ODD)] == [ids_of(t) for t in ODD]


MARKED = ["Hİ", "ANTALYADAKİ", "İ", "क\u0958", "\u095f", "ড\u09dc", "ΟΔΟΣ", "é", "e\u0301", "\ufb4c", "שׁ", "ñandú", "Straße", "a\u0958b"]


@pytest.mark.parametrize("end", ["", ",", ".", "!?", "...", ":x", ";"])
def test_word_encoder_where_a_word_ends_in_a_mark(end):
    texts = [f"{a}{end}" for a in MARKED] + [f"x {a}{end} {b}{end} y" for a in MARKED for b in MARKED]
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts)] == [ids_of(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aİÉ\u0958\u095f\u09dc\u0a36\ufb2aΣ .,;:!?"), st.characters(codec="utf-8", categories=["L"])), max_size=30), max_size=4))
def test_word_encoder_on_letters_and_ends(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts)] == [ids_of(t) for t in texts]


def test_other_vocabularies_are_encoded_whole():
    e = WordEncoder(queries.tokenizer_file("byte_bpe_50k.json"))
    assert not e.by_chunk
    other = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    assert np.frombuffer(next(iter(e.encode(["a  b"]))), "<u4").tolist() == other.encode("a  b", add_special_tokens=False).ids


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, start string, length int")


@pytest.mark.parametrize("rows", [[], [(3, None), (1, "b a"), (None, "null id"), (1, "b a"), (2, ""), (9, "w " * 5000), *((100 + i, t) for i, t in enumerate(ODD))]])
def test_records(spark, rows):
    folder = shared.new_folder(spark, "test")
    manifest = records.write_token_records(docs_of(spark, rows), folder, PATH, end_id=2)
    got = records.read_token_records(spark, folder, manifest).collect()
    expected = sorted(((i, [*ids_of(t), 2]) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in expected]
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x), crc(x)) for _, x in expected]
    assert [r.start for r in got] == np.cumsum([0, *(len(x) for _, x in expected)])[:-1].tolist() if rows else got == []
    for f in {r.file for r in got}:
        own = [r for r in got if r.file == f]
        index = records.read_index(f"{folder}/{f}")
        assert [x[1] for x in index] == [r.offset for r in own] and [x[2] for x in index] == [r.n_tokens for r in own]
        back = list(records.read_at(f"{folder}/{f}", [r.offset for r in own[::-1]]))
        assert [(i, zlib.crc32(x)) for i, x in back] == [(r.doc_id, r.ids_crc32) for r in own[::-1]]


def test_torn_records_are_errors(tmp_path):
    path = tmp_path / "x.rec"
    for data in (records.frame(1, np.array([1], np.uint32)), records.frame(None, np.array([65536] * 3, np.uint32))):
        path.write_bytes(data)
        assert len(list(records.read_records(str(path)))) == 1
        for torn in (data[:-1], data[:9], bytes([data[0] ^ 1]) + data[1:], data[:-6] + bytes([data[-6] ^ 4]) + data[-5:]):
            path.write_bytes(torn)
            with pytest.raises(ValueError):
                list(records.read_records(str(path)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_capacity_tree_is_best_fit(lengths):
    tree, rooms = packing.CapacityTree(64), []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        got = tree.take(n)
        if not fits:
            assert got is None
            room = 64
        else:
            room = min(fits)
            assert got[0] == room
            rooms.remove(room)
        if room > n:
            rooms.append(room - n)
            tree.put(room - n, 0)


def test_packing(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = docs_of(spark, [(None, "no id"), (-1, None), (-2, ""), (-3, "w " * 5000), (-4, "a"), (-4, "a")]).select("doc_id", "text")
    rows = table.union(odd).collect()
    got = packing.pack_documents(table.union(odd), PATH, end_id=1, window=256, with_ids=True).collect()
    expected = {}
    for r in rows:
        expected.setdefault(r.doc_id, []).append([*ids_of(r.text), 1])
    pieces, sequences = {}, {}
    for r in got:
        assert r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids) and 0 < r.length <= 256
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == expected.keys()
    for i, own in pieces.items():
        if len(expected[i]) == 1:
            assert [x for r in sorted(own, key=lambda r: r.start) for x in np.frombuffer(r.ids, "<u4")] == expected[i][0]
            assert {r.doc_tokens for r in own} == {len(expected[i][0])}
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) <= 256
    assert sum(r.length for r in got) > 0.95 * 256 * len(sequences)
    assert packing.pack_documents(docs_of(spark, []), PATH).collect() == []
    assert packing.pack_documents(docs_of(spark, [(1, "a b")]), PATH).count() == 1


def test_packing_holds_a_run_of_texts_and_loads_leanly(monkeypatch):
    """Texts are encoded two megabytes at a time, and what reading the tokenizer took is given back first."""
    from quillon.llm import packing, word_tokens
    from quillon.llm.queries import tokenizer_file

    freed = []
    monkeypatch.setattr(word_tokens, "release_memory", lambda: freed.append(True), raising=False)
    monkeypatch.setattr(packing, "encoder", lambda path: word_tokens._loaded(path))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": ["red ring " * 11_000] * 60})
    runs = list(packing._cut(iter([batch]), tokenizer_file(), 1, 2048, True))
    assert freed and len(runs) >= 3 and sum(x for r in runs for x in r.column("length").to_pylist()) == 60 * 22_001
