"""Ground shared by the operators of this subpackage: the shared folder, lineage cuts, streams of groups."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Set where spark.checkpoint.dir is unset (tests, notebooks): one folder a process.
_own_folder: str | None = None


#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def workdir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session that names none gets a temporary folder of this process; on a cluster that is an error, since
    executors would write to disks of their own.
    """
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return _own_folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{workdir(spark)}/quillon-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages survive lost executors and
    never repeat what made it."""
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of ``uri`` as Python sees it, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def as_batch(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def text_runs(column: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``most_bytes``; a longer text is a range of its own."""
    offsets = np.frombuffer(column.buffers()[1], "<i4", column.offset + len(column) + 1)[column.offset :]
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to
        at = to


def plain_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string array with 32-bit offsets, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def text_bytes(column: pa.Array, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows start to stop, and the offset of each row in them (one more than rows)."""
    offsets = np.frombuffer(column.buffers()[1], "<i4", column.offset + len(column) + 1)[column.offset :]
    data = column.buffers()[2]
    low, high = int(offsets[start]), int(offsets[stop])
    raw = np.frombuffer(data, np.uint8, high)[low:] if data is not None and high > low else np.zeros(0, np.uint8)
    return raw, offsets[start : stop + 1].astype(np.int64) - low


def groups_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of equal ``keys`` in a stream sorted by them; memory holds one group and one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield _joined(held)
            held = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield _joined(held)
                held = []
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


class Rows:
    """Collects rows of columns and gives batches of a bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 20_000):
        self.schema, self.most = schema, most
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, *columns: object) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.parts.append(columns)
            self.n += len(columns[0])
        if self.n >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            joined = [np.concatenate([np.asarray(p[i]) for p in self.parts]) for i in range(len(self.schema))]
            self.parts, self.n = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(joined, self.schema, strict=True)], schema=self.schema)


def release_memory() -> None:
    """Gives what this process has freed back to the system: a reused worker keeps no more than it holds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


class _Lean:
    def __init__(self, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        self.work = work

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from self.work(batches)
        finally:
            release_memory()


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> _Lean:
    """``work`` on a task's batches in little memory, for ``mapInArrow``.

    Batches are bounded by BATCH_BYTES where the session leaves Spark's default, which lets each task hold 64 MB on
    either side of the pipe; and after a task the worker gives its free memory back.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH_BYTES, None) in ("64MB", "64m", "67108864b", "67108864"):
        spark.conf.set(_BATCH_BYTES, BATCH_BYTES)
    return _Lean(work)


def per_worker(make: Callable[[], object], _held: dict = {}) -> object:  # noqa: B006  held for the worker's life
    """``make()``, once in each Python worker for each function of a module and its arguments."""
    key = (make.func.__module__, make.func.__qualname__, make.args)
    if key not in _held:
        _held[key] = make()
    return _held[key]
