"""Tiled logs: bundles of 256 entries in files named by ``tile_path``, beside a signed ``checkpoint``.

Batch reads go through Spark's binary file reader, so a log may lie in any store that Spark reads; only the files of the range asked for
are listed and opened. The data source, whose streaming offset is the tree size, and the writers reach files from the tasks through Arrow's
file systems: local or mounted paths, and the URIs that Arrow knows (file, s3, gs, hdfs). Writers make one file a bundle.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ledgerlens.functions.codec import TILE, framed, tile_path
from ledgerlens.functions.notes import Ed25519Verifier, parse_checkpoint, parse_unverified

SCHEMA = "idx long, leaf binary"
ENTRIES = "tile/entries"


def unbundled(data: bytes) -> list[bytes]:
    """Records after their two-byte lengths; a cut-off last record ends the list."""
    out, at = [], 0
    while at + 2 <= len(data):
        (n,) = struct.unpack_from(">H", data, at)
        if at + 2 + n > len(data):
            break
        out.append(data[at + 2 : at + 2 + n])
        at += 2 + n
    return out


def certificate_leaves(data: bytes) -> list[bytes]:
    """Merkle tree leaves out of a data tile of a static certificate log: each record is a timestamped entry, then, for a
    pre-certificate, the certificate itself, then fingerprints of the chain; the leaf is two zero bytes and the entry."""
    out, at = [], 0

    def after(start: int, width: int) -> int:
        end = start + width + int.from_bytes(data[start : start + width], "big")
        if start + width > len(data) or end > len(data):
            raise ValueError("cut off entry")
        return end

    while at < len(data):
        kind = int.from_bytes(data[at + 8 : at + 10], "big")
        if kind > 1 or at + 10 > len(data):
            raise ValueError("unknown entry type or cut off entry")
        end = after(at + 10 + 32 * kind, 3)  # the certificate, or the issuer's key hash and the signed part
        end = after(end, 2)  # extensions
        out.append(b"\0\0" + data[at:end])
        at = after(after(end, 3) if kind else end, 2)
    return out


#: How the files of a log are split into leaves, and where they lie.
FORMATS = {"bundles": (unbundled, ENTRIES), "static_ct": (certificate_leaves, "tile/data")}


def path_of(index: int, partial: int = 0) -> str:
    """The driver-side form of ``tile_path``."""
    groups = [f"{index % 1000:03d}"]
    while index := index // 1000:
        groups.append(f"x{index % 1000:03d}")
    return "/".join(reversed(groups)) + (f".p/{partial}" if partial else "")


def _tile_number(path: Column, folder: str) -> Column:
    """The tile of a file's path."""
    name = F.regexp_extract(path, rf"{folder}/((?:x\d+/)*\d+)(?:\.p/\d+)?$", 1)
    return F.aggregate(F.split(F.replace(name, F.lit("x"), F.lit("")), "/"), F.lit(0).cast("long"), lambda a, x: a * 1000 + x.cast("long"))


def _records(batches: Iterator[pa.RecordBatch], split) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tile, content in zip(batch["tile"].to_pylist(), batch["content"].to_pylist(), strict=True):
            leaves = split(content)
            yield pa.RecordBatch.from_arrays([pa.array(range(tile * TILE, tile * TILE + len(leaves)), pa.int64()), pa.array(leaves, pa.binary())], ["idx", "leaf"])


def _patterns(first: int, last: int) -> list[str]:
    """Globs of the tiles from ``first`` to ``last``, whole and partial, by thousands: no file of another tile matches."""
    out = []
    for group in range(first // 1000, last // 1000 + 1):
        own = [f"{t % 1000:03d}" for t in range(max(first, group * 1000), min(last, group * 1000 + 999) + 1)]
        names = "[0-9][0-9][0-9]" if len(own) == 1000 else "{" + ",".join(own) + "}"
        prefix, rest = "", group
        while rest:
            prefix, rest = f"x{rest % 1000:03d}/{prefix}", rest // 1000
        out += [f"{prefix}{names}", f"{prefix}{names}.p/*"]
    return out


def read_tiles(spark: SparkSession, path: str, start: int, end: int, form: str = "bundles") -> DataFrame:
    """(idx, leaf) of positions from ``start`` up to ``end``. Partial bundles are read where no full one covers their range."""
    split, folder = FORMATS[form]
    first, last = start // TILE, max(start, end - 1) // TILE
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    globs = [f"{path}/{folder}/{p}" for p in _patterns(first, last)]
    globs = [g for g in globs if len(store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(g)) or [])]
    if not globs:
        return spark.createDataFrame([], SCHEMA)
    found = spark.read.format("binaryFile").load(globs).select("content", _tile_number(F.col("path"), folder).alias("tile"))
    leaves = found.select("tile", "content").mapInArrow(lambda it: _records(it, split), SCHEMA).where((F.col("idx") >= start) & (F.col("idx") < end))
    return leaves.groupBy("idx").agg(F.min("leaf").alias("leaf")) if end % TILE else leaves


def read_checkpoint(spark: SparkSession, path: str) -> bytes:
    """The log's signed checkpoint."""
    return bytes(spark.read.format("binaryFile").load(f"{path}/checkpoint").select("content").first()[0])


def bundles(log: DataFrame) -> DataFrame:
    """(tile, n, path, content): the log (idx, leaf) as bundle files. A tile is at most 256 leaves."""
    rows = log.groupBy(F.shiftright("idx", 8).alias("tile")).agg(F.array_sort(F.collect_list(F.struct("idx", "leaf"))).alias("rows"))
    n = F.size("rows")
    return rows.select("tile", n.alias("n"), tile_path(F.col("tile"), F.when(n < TILE, n).otherwise(0)).alias("path"), framed(F.col("rows.leaf")).alias("content"))


def _store(folder: str) -> tuple[files.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return files.FileSystem.from_uri(folder) if "://" in folder else (files.LocalFileSystem(), folder)


def _put(folder: str, name: str, content: bytes) -> None:
    """One file, written under another name and renamed."""
    store, base = _store(folder)
    target = f"{base}/{name}"
    store.create_dir(target.rpartition("/")[0], recursive=True)
    with store.open_output_stream(temp := f"{target}.{uuid.uuid4().hex}.tmp") as f:
        f.write(content)
    store.move(temp, target)


def write_tiles(log: DataFrame, folder: str) -> None:
    """One file a bundle under a folder, or URI, that all executors share."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                _put(folder, f"{ENTRIES}/{path}", content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    bundles(log).select("path", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def write_checkpoint(folder: str, checkpoint: bytes) -> None:
    """The signed checkpoint beside the tiles; written last, it shows what stands there."""
    _put(folder, "checkpoint", checkpoint)


class _Range(InputPartition):
    def __init__(self, tile: int, start: int, end: int, size: int):
        self.tile, self.start, self.end, self.size = tile, start, end, size


def _ranges(start: int, end: int, size: int) -> list[_Range]:
    return [_Range(t, max(start, t * TILE), min(end, t * TILE + TILE), size) for t in range(start // TILE, -(-end // TILE))] if end > start else []


def _read_range(folder: str, form: str, part: _Range) -> Iterator[pa.RecordBatch]:
    """A full bundle, or the partial one of that size, or any longer one."""
    split, entries = FORMATS[form]
    want, (store, root) = part.end - part.tile * TILE, _store(folder)
    base = f"{root}/{entries}/{path_of(part.tile)}"
    beside = store.get_file_info(files.FileSelector(f"{base}.p", allow_not_found=True))
    partials = sorted((int(i.base_name) for i in beside if i.base_name.isdigit() and int(i.base_name) >= want), reverse=True)
    for name in [base, *(f"{base}.p/{n}" for n in partials)]:
        if store.get_file_info(name).type == files.FileType.File:
            with store.open_input_stream(name) as f:
                leaves = split(f.read())
            if len(leaves) >= want:
                lo = part.start - part.tile * TILE
                yield pa.RecordBatch.from_arrays([pa.array(range(part.start, part.end), pa.int64()), pa.array(leaves[lo:want], pa.binary())], ["idx", "leaf"])
                return
    raise FileNotFoundError(f"no bundle for entries {part.start} to {part.end}")


class _Options:
    """Options of the source: path; form (``bundles`` or ``static_ct``); vkey, with which the checkpoint must be signed; origin, which it
    must name (the key's name, if not given); start and end."""

    def __init__(self, options: dict):
        self.folder, self.form = options["path"], options.get("form", "bundles")
        self.vkey, self.origin = options.get("vkey"), options.get("origin")
        if self.form not in FORMATS:
            raise ValueError(f"unknown form {self.form!r}")

    def size(self) -> int:
        """The size of the tree; an error if the checkpoint is not signed as asked."""
        store, root = _store(self.folder)
        with store.open_input_stream(f"{root}/checkpoint") as f:
            raw = f.read()
        if self.vkey:
            return parse_checkpoint(raw, Ed25519Verifier.parse(self.vkey), self.origin).size
        found = parse_unverified(raw)
        if self.origin is not None and found.origin != self.origin:
            raise ValueError(f"unexpected origin {found.origin!r}")
        return found.size


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, size = _Options(options), _Options(options).size()
        self.start, self.end, self.tree = int(options.get("start", 0)), min(int(options.get("end", size)), size), size

    def partitions(self) -> list[InputPartition]:
        return _ranges(self.start, self.end, self.tree)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _read_range(self.options.folder, self.options.form, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are tree sizes, so every batch ends at a signed checkpoint and can be checked against it."""

    def __init__(self, options: dict):
        self.options, self.first = _Options(options), int(options.get("start", 0))

    def initialOffset(self) -> dict:
        return {"size": self.first}

    def latestOffset(self) -> dict:
        return {"size": self.options.size()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _ranges(start["size"], end["size"], end["size"])

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _read_range(self.options.folder, self.options.form, partition)

    def commit(self, end: dict) -> None:
        pass


class TiledLog(DataSource):
    """``spark.read`` / ``spark.readStream`` ``.format("tlog_tiles").option("path", folder)`` after ``register``."""

    @classmethod
    def name(cls) -> str:
        return "tlog_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TiledLog)
