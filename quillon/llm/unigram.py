"""SentencePiece encoding and decoding with a unigram model.

The pieces and log scores of a ``.model`` file stand in a double-array trie over UTF-8 bytes; Viterbi finds the
segmentation of highest total score. A character that no piece covers is encoded as byte pieces. Blanks are
written as the marker, one more stands before the text, and decoding undoes both.

The scores of a unigram file are log probabilities and are taken as they are. A file of another type keeps its pieces'
merge ranks there, which are no likelihoods: it is refused, unless ``scores="rank"`` asks to read them as a frequency
order, where the piece of rank r has the probability 1 / r over the sum of all (Zipf's law). No piece is learned here.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .shared import as_batch, lean

MARK = "▁".encode()
ENCODED = "doc_id long, ids binary, n_tokens long, n_bytes long"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
#: Fixed values of the file format: piece types, and what an unknown character costs below the least score.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
UNIGRAM = 1
#: Words of more bytes are segmented each time: a text without blanks is no word to keep.
KEPT_BYTES = 256


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message; four- and eight-byte values stay bytes."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind in (1, 2, 5):
            n, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(raw, at)
            value, at = raw[at : at + n], at + n
        else:
            raise ValueError("not a SentencePiece model")
        yield tag >> 3, value


def read_model(path: str) -> tuple[list[tuple[bytes, float, int]], int]:
    """(piece, score, type) of each id of a SentencePiece model file, and the model's type.

    A file whose texts are normalised, stripped of blanks or marked otherwise than by a marker before words is refused.
    """
    with open(path, "rb") as f:
        raw = f.read()
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b""), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24):
        raise ValueError(f"{path}: its texts are normalised in a way that is not built here")
    return pieces, trainer.get(3, UNIGRAM)


def _by_rank(pieces: list[tuple[bytes, float, int]]) -> list[tuple[bytes, float, int]]:
    """Log probabilities by Zipf's law for normal pieces in their order of score."""
    order = sorted((i for i, (_, _, kind) in enumerate(pieces) if kind == NORMAL), key=lambda i: (-pieces[i][1], i))
    total = log(sum(1 / r for r in range(1, len(order) + 1)))
    out = list(pieces)
    for r, i in enumerate(order, 1):
        out[i] = (pieces[i][0], -log(r) - total, NORMAL)
    return out


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


class DoubleArray:
    """A trie in two arrays: from state s, byte c leads to t = base[s] + c + 1 if check[t] is s."""

    def __init__(self, keys: dict[bytes, int]):
        self.base, self.check, self.value = [0], [-1], [-1]
        used, free = bytearray(1), 257  # so that any byte may lead to the lowest hole
        todo = [(0, 0, sorted(keys))]
        while todo:
            state, depth, own = todo.pop()
            if own and len(own[0]) == depth:
                self.value[state] = keys[own[0]]
                own = own[1:]
            if not own:
                continue
            children: dict[int, list[bytes]] = {}
            for k in own:
                children.setdefault(k[depth], []).append(k)
            codes = list(children)
            # A single child fills the lowest hole; more children are set near the end, where there is room.
            low = free if len(codes) == 1 else max(free, len(used) - 48)
            while low < len(used) and used[low]:
                low += 1
            if len(codes) == 1:
                free = low
            at = max(low - codes[0] - 1, 0)
            while any(at + c + 1 < len(used) and used[at + c + 1] for c in codes):
                at += 1
            self._grow(at + codes[-1] + 2, used)
            self.base[state] = at
            for c in codes:
                t = at + c + 1
                used[t], self.check[t] = 1, state
                todo.append((t, depth + 1, children[c]))

    def _grow(self, n: int, used: bytearray) -> None:
        if (more := n - len(used)) > 0:
            used.extend(bytes(more))
            self.base.extend([0] * more)
            self.check.extend([-1] * more)
            self.value.extend([-1] * more)


@dataclass
class UnigramModel:
    """Everything encoding needs; made once and broadcast."""

    pieces: list[tuple[bytes, float, int]]
    trie: DoubleArray
    byte_ids: list[int]
    unknown_id: int
    unknown_score: float

    @staticmethod
    def load(path: str, scores: str = "log") -> UnigramModel:
        pieces, kind = read_model(path)
        if scores == "rank":
            pieces = _by_rank(pieces)
        elif kind != UNIGRAM:
            raise ValueError(f"{path}: a model of type {kind} has merge ranks, not log probabilities")
        keys = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        if any(MARK in p.lstrip(MARK) for p in keys if not _all_marks(p)):
            raise ValueError("a piece goes over the end of a word")
        normal = [s for _, s, kind in pieces if kind == NORMAL]
        most, least = max(normal), min(normal)
        scored = [(p, (len(p.decode()) * most - 0.1) if kind == USER_DEFINED else s, kind) for p, s, kind in pieces]
        of = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        byte_ids = [of.get(b"<0x%02X>" % b, -1) for b in range(256)]
        unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        return UnigramModel(scored, DoubleArray(keys), byte_ids, unknown, least - UNKNOWN_PENALTY)


def _all_marks(p: bytes) -> bool:
    return p == MARK * (len(p) // len(MARK))


class Unigram:
    """Encodes and decodes texts; keeps what it found for words, up to ``most_words`` of them."""

    def __init__(self, model: UnigramModel, most_words: int = 500_000):
        self.model, self.most_words = model, most_words
        self.words: dict[bytes, bytes] = {}
        self.scores = [s for _, s, _ in model.pieces]
        self.usable = [kind != UNUSED for _, _, kind in model.pieces]
        self.as_bytes = [bytes([model.byte_ids.index(i)]) if kind == BYTE else b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARK, b" ") for i, (p, _, kind) in enumerate(model.pieces)]

    def segment(self, s: bytes) -> list[int]:
        """Ids of the best segmentation of ``s``, which has markers for blanks. The earliest start wins a tie."""
        trie, scores, usable = self.model.trie, self.scores, self.usable
        base, check, value, size = trie.base, trie.check, trie.value, len(trie.check)
        n, unknown, unknown_score = len(s), self.model.unknown_id, self.model.unknown_score
        best, start, piece = [0.0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        at = 0
        while at < n:
            lead = s[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, state, single, i = best[at], 0, False, at
            while i < n:
                t = base[state] + s[i] + 1
                if t >= size or check[t] != state:
                    break
                state = t
                i += 1
                k = value[t]
                if k >= 0 and usable[k]:
                    total = here + scores[k]
                    if start[i] < 0 or total > best[i]:
                        best[i], start[i], piece[i] = total, at, k
                    single = single or i == at + width
            if not single:
                i, total = at + width, here + unknown_score
                if start[i] < 0 or total > best[i]:
                    best[i], start[i], piece[i] = total, at, unknown
            at += width
        out: list[int] = []
        i = n
        while i:
            k, j = piece[i], start[i]
            if k == unknown and self.model.byte_ids[0] >= 0:
                out.extend(self.model.byte_ids[b] for b in reversed(s[j:i]))
            else:
                out.append(k)
            i = j
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self.words) > self.most_words:
            self.words.clear()
        words, out = self.words, []
        # No piece goes over the end of a word, so the best segmentation of a text is that of its words.
        for w in _WORD.findall(b" " + text.encode()):
            ids = words.get(w)
            if ids is None:
                ids = np.array(self.segment(w.replace(b" ", MARK)), "<u4").tobytes()
                if len(w) <= KEPT_BYTES:
                    words[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: markers become blanks, byte pieces their bytes, and the blank before the text goes."""
        raw = b"".join(map(self.as_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_WORD = re.compile(rb" +[^ ]*|[^ ]+")


def share_model(spark: SparkSession, path: str, scores: str = "log") -> Broadcast:
    """The model of a file for the executors; its size is the vocabulary's, whatever the corpus."""
    return spark.sparkContext.broadcast(UnigramModel.load(path, scores))


_coders: dict[tuple[str, str], Unigram] = {}


def _coder(path: tuple[str, str], shared: Broadcast) -> Unigram:
    """This worker's coder of the file and scores: the words it has met outlive a task."""
    if path not in _coders:
        _coders[path] = Unigram(shared.value)
    return _coders[path]


def _encode(batches: Iterator[pa.RecordBatch], path: tuple[str, str], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    coder = _coder(path, shared)
    is_byte = np.zeros(len(coder.model.pieces), bool)
    is_byte[[i for i in coder.model.byte_ids if i >= 0]] = True
    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        texts = batch.column("text")
        for a in range(0, len(doc_ids), 500):
            ids = [coder.encode(t or "") for t in texts.slice(a, 500).to_pylist()]
            n_bytes = [int(is_byte[np.frombuffer(x, "<u4")].sum()) for x in ids]
            yield as_batch(_ENCODED, {"doc_id": doc_ids[a : a + 500], "ids": ids, "n_tokens": [len(x) // 4 for x in ids], "n_bytes": n_bytes})


def encode(docs: DataFrame, model_path: str, scores: str = "log") -> DataFrame:
    """doc_id, ids (unsigned 32-bit little-endian bytes), n_tokens, n_bytes (byte pieces among them) of each row.

    A null or empty text has no ids. Rows with a null or repeated doc_id are encoded like any other. Other
    columns are not read. Each text is encoded whole.
    """
    shared = share_model(docs.sparkSession, model_path, scores)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(lean(partial(_encode, path=(model_path, scores), shared=shared)), ENCODED)


def _decode(batches: Iterator[pa.RecordBatch], path: tuple[str, str], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    coder = _coder(path, shared)
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            texts = [None if x is None else coder.decode(x) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])


def decode(encoded: DataFrame, model_path: str, scores: str = "log") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``; null ids give null. A column of that name is replaced."""
    rest = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(lean(partial(_decode, path=(model_path, scores), shared=share_model(encoded.sparkSession, model_path, scores))), f"{schema}, decoded string")


def _round_trip(batches: Iterator[pa.RecordBatch], path: tuple[str, str], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    coder = _coder(path, shared)
    for encoded in _encode(batches, path, shared):
        ids = encoded.column("ids").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [*(encoded.column(c) for c in ("doc_id", "n_tokens", "n_bytes")), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([coder.decode(x) for x in ids], pa.string())],
            names=["doc_id", "n_tokens", "n_bytes", "ids_crc32", "decoded"],
        )


def round_trip(docs: DataFrame, model_path: str, scores: str = "log") -> DataFrame:
    """doc_id, n_tokens, n_bytes, ids_crc32 and decoded of each row: ``encode`` and ``decode`` in one pass, without
    the ids on the way out. Nulls as there; a null text comes back empty."""
    shared = share_model(docs.sparkSession, model_path, scores)
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return rows.mapInArrow(lean(partial(_round_trip, path=(model_path, scores), shared=shared)), "doc_id long, n_tokens long, n_bytes long, ids_crc32 long, decoded string")
