"""Helpers shared by the operators: scratch tables in the cluster's shared folder, folds of ids, and byte-level numpy."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a temporary folder of our own only where that setting is absent."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="ledgerlens-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/ledgerlens-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage is cut and any executor may be lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Set the session's largest Arrow batch: a task holds a few of them, in the JVM and in Python, whatever the rows' length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def tidied(task: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task``, after whose last batch the worker gives the memory that is free again back to the system: workers live on
    into other tasks and stages, and two of them share an executor with its heap."""

    @functools.wraps(task)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return run


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ragged(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays of different lengths as one Arrow list column."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64, a bijection whose bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_chunks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose text holds about ``most_bytes``, one row at least."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


#: Bytes that are hashed at once; a longer word is hashed whole.
PIECE = 1 << 18


def hashed_words(items: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit fingerprints of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, in a row; where each word begins in the joined bytes;
    and the number of words before each text and, last, in all. With ``lower``, A-Z count as a-z.

    A word's fingerprint is a polynomial of its bytes, taken from one running sum, so no word is touched in Python. The bytes are
    hashed in pieces that end at white space, so beside them a text of any length costs 16 bytes a word.
    """
    data = np.frombuffer(b"\n".join(items) + b"\n", np.uint8)
    found, starts, at = [], [], 0
    while at < len(data):
        stop = min(at + PIECE, len(data))
        while not (ends := np.flatnonzero(_SPACE[data[at:stop]])).size:
            stop = min(stop + (stop - at), len(data))
        stop = at + int(ends[-1]) + 1
        own, begin = _hashed_piece(data[at:stop], lower)
        found.append(own)
        starts.append(begin + at)
        at = stop
    text_starts = np.cumsum([0, *(len(x) + 1 for x in items)])
    begin = np.concatenate(starts)
    return np.concatenate(found), begin, np.searchsorted(begin, text_starts)


def _hashed_piece(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and places of the words of bytes that end with white space."""
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[_LOWER[data] if lower else data] * up[: len(data)], out=sums[1:])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = ~_SPACE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return mixed((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64)), starts


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """A fingerprint of every run of ``width`` words; of the whole sequence if it is shorter."""
    width = min(width, len(words))
    if not width:
        return words
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(_BASE) + words[k : len(words) - width + 1 + k])
    return out


def labelled(docs: DataFrame, labels: DataFrame, most_broadcast: int = 4_000_000) -> DataFrame:
    """``docs`` joined with labels of one row per doc_id: broadcast up to a counted number of rows, a plain join beyond it."""
    few = labels.limit(most_broadcast + 1).count() <= most_broadcast
    return docs.join(F.broadcast(labels) if few else labels, "doc_id")
