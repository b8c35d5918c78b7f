"""Token ids in length-delimited binary records, with a separate index of offsets.

A record file is a row of frames::

    length      u64  bytes of the payload
    length_crc  u32  masked CRC-32 of the eight length bytes
    payload          i64 document id, u8 flags (1: id is null, 2: ids have 32 bits, else 16), ids
    payload_crc u32  masked CRC-32 of the payload

all little-endian. The mask turns the sum by 15 bits and adds a constant, so that a checksum of bytes that
hold checksums stays telling. Beside each record file, ``.idx`` holds an i64 document id, a u64 offset and a
u32 token count for each record: a reader that shuffles needs nothing else to go to any record.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import as_batch, cut, filesystem, lean
from .word_tokens import encoder

_MASK = 0xA282EAD8
_HEAD, _SUM, _PAYLOAD, _ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qB"), struct.Struct("<qQI")
_NULL_ID, _WIDE = 1, 2
MANIFEST = "part int, file string, records long, tokens long, bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, file string, offset long"
_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """A record of ``ids`` (unsigned 32-bit); ids below 65,536 take two bytes in the file."""
    narrow = not len(ids) or ids.max() < 65536
    flags = (_NULL_ID if doc_id is None else 0) | (0 if narrow else _WIDE)
    payload = _PAYLOAD.pack(doc_id or 0, flags) + ids.astype("<u2" if narrow else "<u4").tobytes()
    head = _HEAD.pack(len(payload))
    return head + _SUM.pack(masked_crc(head)) + payload + _SUM.pack(masked_crc(payload))


def _unframe(read, where: str) -> tuple[int | None, bytes, int] | None:
    """The next record: document id, ids as 32-bit bytes, bytes it took. None at the end; an error if torn."""
    head = read(_HEAD.size + _SUM.size)
    if not head:
        return None
    if len(head) < 12 or _SUM.unpack_from(head, 8)[0] != masked_crc(head[:8]):
        raise ValueError(f"{where}: a length is torn")
    n = _HEAD.unpack_from(head)[0]
    body = read(n + _SUM.size)
    if len(body) < n + 4 or _SUM.unpack_from(body, n)[0] != masked_crc(body[:n]):
        raise ValueError(f"{where}: a payload is torn")
    doc_id, flags = _PAYLOAD.unpack_from(body)
    ids = body[_PAYLOAD.size : n]
    ids = ids if flags & _WIDE else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
    return None if flags & _NULL_ID else doc_id, ids, n + 16


def read_records(uri: str) -> Iterator[tuple[int | None, bytes, int]]:
    """Each record of a file in order: document id, ids (32-bit bytes), offset of its frame."""
    store, path = filesystem(uri)
    with store.open_input_stream(path, buffer_size=1 << 20) as f:
        at = 0
        while (got := _unframe(f.read, f"{uri} at {at}")) is not None:
            yield got[0], got[1], at
            at += got[2]


def read_index(uri: str) -> list[tuple[int, int, int]]:
    """(document id, offset, tokens) of each record of the record file ``uri``."""
    store, path = filesystem(uri + ".idx")
    with store.open_input_stream(path) as f:
        return list(_ENTRY.iter_unpack(f.read()))


def read_at(uri: str, offsets: list[int]) -> Iterator[tuple[int | None, bytes]]:
    """The records at ``offsets``, in that order: what a shuffled reader calls."""
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        for at in offsets:
            f.seek(at)
            yield _unframe(f.read, f"{uri} at {at}")[:2]


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer_path: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    store, root = filesystem(folder)
    encoded, end = encoder(tokenizer_path).encode_runs, [] if end_id is None else [end_id]
    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.rec"  # no two attempts share a file
    records = tokens = at = 0
    out = index = None
    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        if doc_ids and out is None:
            store.create_dir(root, recursive=True)
            out, index = store.open_output_stream(f"{root}/{name}", buffer_size=1 << 20), store.open_output_stream(f"{root}/{name}.idx", buffer_size=1 << 16)
        for a, b, run, ends in encoded(batch.column("text")):
            for doc_id, x, y in zip(doc_ids[a:b], ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                ids = np.append(run[x:y], end).astype("<u4") if end else run[x:y]
                out.write(data := frame(doc_id, ids))
                index.write(_ENTRY.pack(doc_id or 0, at, len(ids)))
                records, tokens, at = records + 1, tokens + len(ids), at + len(data)
    if out is not None:
        out.close()
        index.close()
        yield as_batch(_MANIFEST, {"part": [task.partitionId()], "file": [name], "records": [records], "tokens": [tokens], "bytes": [at]})


def write_token_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = None) -> DataFrame:
    """Write the ids of every text of ``docs`` (doc_id, text) to ``folder`` in ascending doc_id order.

    Returns the manifest: a row per file with its records, tokens and bytes, files in order of ``part``. Rows
    go to files by ranges of doc_id and are sorted in each, so file after file is in ascending order. Files
    that lost or repeated task attempts leave are in no manifest and are never read.

    Null ids come first; rows that repeat an id stay, in an order fixed by their text. A null text is empty and
    holds the end id alone. Columns other than doc_id and text are not read. An empty table gives an empty
    manifest.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sorted_rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    write = partial(_write, folder=folder, tokenizer_path=tokenizer_path, end_id=end_id)
    return cut(sorted_rows.mapInArrow(lean(write), MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            rows: list[tuple] = []
            for doc_id, ids, at in read_records(f"{folder}/{name}"):
                rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), name, at))
                start += len(ids) // 4
                if len(rows) == 10_000:
                    yield as_batch(_READ, dict(zip(_READ.names, zip(*rows, strict=True), strict=True)))
                    rows = []
            if rows:
                yield as_batch(_READ, dict(zip(_READ.names, zip(*rows, strict=True), strict=True)))


def read_token_records(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's files: doc_id, start (ids before it over all files), n_tokens,
    ids_crc32, file, offset. Checks both sums of each frame. The driver holds one row per file."""
    at, files = 0, []
    for r in manifest.orderBy("part").select("file", "tokens").toLocalIterator():
        files.append((r.file, at))
        at += r.tokens
    if not files:
        return spark.createDataFrame([], READ)
    todo = spark.createDataFrame(files, "file string, start long").repartition(len(files))
    return todo.mapInArrow(lean(partial(_read, folder=folder)), READ)
