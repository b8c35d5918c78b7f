"""Packing of token sequences into windows of a fixed size by best-fit decreasing.

A document longer than a window is first cut into full windows; each such piece fills a sequence of its own.
What is left of each document is packed in order of falling length: a segment tree over remaining capacities
finds the tightest open window that still takes the piece.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_batch, lean
from .word_tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
#: Bytes of texts that are encoded at a time: what a worker holds besides its words grows with it.
RUN_BYTES = 2_000_000
#: Sequence ids of a task start at its number times this, and full windows count from the upper half.
_STRIDE = 1 << 36


class CapacityTree:
    """Open windows by remaining capacity; ``take(n)`` gives the tightest that still holds n tokens.

    A leaf stands for a capacity and holds the windows that have it left; an inner node tells whether any leaf
    below it holds one. Both operations climb and descend once, so they take the logarithm of the window size.
    """

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()  # leaves 0 to window
        self.some = bytearray(2 * self.size)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def put(self, room: int, sequence: tuple[int, int]) -> None:
        self.open[room].append(sequence)
        node = room + self.size
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, length: int) -> tuple[int, tuple[int, int]] | None:
        """(remaining capacity, window) with the least capacity of at least ``length``, taken out."""
        node, some, size = length + self.size, self.some, self.size
        if length >= len(self.open):
            return None
        while not some[node]:
            while node & 1:  # the right child: what lies to the right of its parent comes next
                node >>= 1
            if not node:  # nothing lies to the right
                return None
            node += 1
        while node < size:
            node = 2 * node if some[2 * node] else 2 * node + 1
        room = node - size
        found = self.open[room].pop()
        if not self.open[room]:
            some[node] = 0
            node >>= 1
            while node and not some[2 * node] and not some[2 * node + 1]:
                some[node] = 0
                node >>= 1
        return room, found


def _cut(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int, window: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoded, end = encoder(tokenizer_path).encode_runs, struct.pack("<I", end_id)
    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        for a, b, ids, ends in encoded(batch.column("text"), RUN_BYTES):
            raw, rows = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), []
            for doc_id, x, y in zip(doc_ids[a:b], ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                for at in range(0, y - x + 1, window):
                    last = at + window > y - x
                    piece = raw[4 * (x + at) : 4 * min(x + at + window, y)]
                    crc = zlib.crc32(end, zlib.crc32(piece)) if last else zlib.crc32(piece)
                    rows.append((doc_id, at, len(piece) // 4 + last, crc, y - x + 1, (bytes(piece) + end if last else bytes(piece)) if with_ids else None))
            if rows:
                yield as_batch(_PIECES, dict(zip(_PIECES.names, zip(*rows, strict=True), strict=True)))


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, window: int, with_ids: bool = False) -> DataFrame:
    """The documents' ids (end id last) cut into full windows and a rest; each id lies in one piece."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lean(partial(_cut, tokenizer_path=tokenizer_path, end_id=end_id, window=window, with_ids=with_ids)), PIECES)


def _fit(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() * _STRIDE
    tree, opened, full = CapacityTree(window), 0, _STRIDE // 2
    for batch in batches:
        lengths = batch.column("length").to_pylist()
        sequence, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for i, n in enumerate(lengths):
            if n == window:
                sequence[i] = base + full
                full += 1
                continue
            room, number = tree.take(n) or (window, None)
            if number is None:
                number, opened = opened, opened + 1
            sequence[i], offset[i] = base + number, window - room
            if room > n:
                tree.put(room - n, number)
        columns = [*batch.columns, pa.array(sequence), pa.array(offset)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "sequence_id", "offset"])


def best_fit_decreasing(pieces: DataFrame, window: int, parts: int | None = None) -> DataFrame:
    """Give each row of ``pieces`` (length up to ``window``, and whatever else) a sequence_id and an offset.

    Rows are dealt by a hash of all their keys to ``parts`` tasks (``spark.sql.shuffle.partitions`` if None), so
    no document, source or copy group meets in one; each task packs its own rows in falling length, which
    Spark's external sort brings, and holds no more than the windows still open. A task leaves about half a
    window unfilled in all beyond what one packing of everything would, so padding falls as tasks grow.
    Ties in length go by doc_id and start: a repeated attempt packs alike.
    """
    keys = ["doc_id", "start", "ids_crc32"]
    dealt = pieces.repartition(parts, *keys) if parts else pieces.repartition(*keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    in_order = dealt.sortWithinPartitions(F.desc("length"), *keys)
    return in_order.mapInArrow(lean(partial(_fit, window=window)), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = 2048, with_ids: bool = False, parts: int | None = None) -> DataFrame:
    """Pack all of ``docs`` (doc_id, text): a row per piece with its place.

    doc_id, start, length, ids_crc32, doc_tokens, ids (unsigned 32-bit little-endian bytes; null unless
    ``with_ids``), sequence_id, offset. A null or empty text is a piece of the end id alone. Rows with a null or
    repeated doc_id are packed like any other. Other columns are not read. An empty table gives no rows.
    """
    return best_fit_decreasing(token_pieces(docs, tokenizer_path, end_id, window, with_ids), window, parts)
