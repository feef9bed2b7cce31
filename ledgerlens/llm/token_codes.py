"""Token-ID output as directly addressable codes (operator 2).

An id is split into 8-bit chunks, the lowest first. Level k holds the k-th chunk of every id that has one, and a bitmap that
says which of them continue on level k + 1; a rank directory over the bitmap gives the place there. Any one id is read
by following its chunks, without decoding its neighbours.

The files are Parquet tables of segments, so that Spark's committers make the output whole when executors are lost and
any store that Spark writes to will do. A segment holds whole documents:

    shard int           number of the range of ids that the file covers, ascending
    first long          ids of the same shard before this segment
    stop long           the same with this segment
    n_tokens long       ids in the segment
    doc_ids array<long>, doc_tokens array<long>
    codes binary        the directly addressable codes of the segment's ids

A ``manifest`` table beside them has, per shard, the ids of all shards before it. Layout of ``codes`` (little-endian):
``DAC1``, uint32 number of levels, uint32 entries of each level; then for each level its chunks (uint8), and for each but the
last its bitmap (bit i is bit i % 8 of byte i // 8) and its directory (uint32 of set bits before every 512th bit).

Defined results: a null text is empty and gives only the end id; a very long text is a segment of its own; rows with equal ids stay apart, ordered by a hash of
their text; a null id sorts first; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import in_chunks, ragged, tidied, utf8
from ledgerlens.llm.tokens import END_ID, encoder

MAGIC = b"DAC1"
BLOCK = 512
#: A segment is closed when it holds so many ids; a longer document is a segment of its own.
SEGMENT_TOKENS = 1 << 16
#: Places nearer to each other than so many ids are looked for as one range.
NEAR = 1 << 20
SEGMENTS = "shard int, first long, stop long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, codes binary"
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def encode_codes(ids: np.ndarray) -> bytes:
    """Directly addressable codes of uint32 ids."""
    rest, sizes, parts = np.asarray(ids, np.uint32), [], []
    while True:
        sizes.append(len(rest))
        parts.append((rest & 0xFF).astype(np.uint8).tobytes())
        rest = rest >> np.uint32(8)
        more = rest > 0
        if not more.any():
            break
        bits = np.packbits(more, bitorder="little")
        blocks = np.zeros(-(-len(bits) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        blocks[: len(bits)] = _POPCOUNT[bits]
        counts = blocks.reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        parts += [bits.tobytes(), (np.cumsum(counts, dtype=np.uint32) - counts).tobytes()]
        rest = rest[more]
    return MAGIC + np.array([len(sizes), *sizes], "<u4").tobytes() + b"".join(parts)


def _levels(codes: bytes) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Views of each level's chunks, bitmap and rank directory."""
    if codes[:4] != MAGIC:
        raise ValueError("not a segment of directly addressable codes")
    n = int(np.frombuffer(codes, "<u4", 1, 4)[0])
    sizes, at, out = np.frombuffer(codes, "<u4", n, 8), 8 + 4 * n, []
    for k, size in enumerate(map(int, sizes)):
        chunks, at = np.frombuffer(codes, np.uint8, size, at), at + size
        bits = ranks = None
        if k + 1 < n:
            n_bits = -(-size // 8)
            bits, at = np.frombuffer(codes, np.uint8, n_bits, at), at + n_bits
            n_ranks = -(-size // BLOCK)
            ranks, at = np.frombuffer(codes, "<u4", n_ranks, at), at + 4 * n_ranks
        out.append((chunks, bits, ranks))
    return out


def decode_codes(codes: bytes) -> np.ndarray:
    """All ids of a segment."""
    value = None
    for chunks, bits, _ in reversed(_levels(codes)):
        own = chunks.astype(np.uint32)
        if bits is not None:
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)
            own[more] |= value << np.uint32(8)
        value = own
    return value


def access(codes: bytes, i: int) -> int:
    """The i-th id of a segment: one chunk, one bit and one rank a level."""
    value = 0
    for k, (chunks, bits, ranks) in enumerate(_levels(codes)):
        value |= int(chunks[i]) << (8 * k)
        if bits is None or not bits[i >> 3] >> (i & 7) & 1:
            break
        block = i // BLOCK
        before = bits[block * (BLOCK // 8) : i >> 3]
        i = int(ranks[block]) + int(_POPCOUNT[before].sum()) + int(_POPCOUNT[bits[i >> 3] & ((1 << (i & 7)) - 1)])
    return value


def _segments(batches: Iterable[pa.RecordBatch], tokenizer: str, by_word: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one shard, already in order, as segments."""
    encode = encoder(tokenizer, by_word).encode
    end = np.array([END_ID], "<u4").tobytes()
    shard, first, doc_ids, parts, total = 0, 0, [], [], 0

    def closed() -> pa.RecordBatch:
        lengths = np.array([len(x) // 4 for x in parts], np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()),
                pa.array([first], pa.int64()),
                pa.array([first + total], pa.int64()),
                pa.array([total], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())),
                ragged([lengths], pa.int64()),
                pa.array([encode_codes(np.frombuffer(b"".join(parts), "<u4"))], pa.binary()),
            ],
            ["shard", "first", "stop", "n_tokens", "doc_ids", "doc_tokens", "codes"],
        )

    for batch in in_chunks(iter(batches), "text", 2 << 20):
        shard = batch["shard"][0].as_py()
        for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(utf8(batch["text"])), strict=True):
            ids += end
            if parts and total + len(ids) // 4 > SEGMENT_TOKENS:
                yield closed()
                first, doc_ids, parts, total = first + total, [], [], 0
            doc_ids.append(doc_id)
            parts.append(ids)
            total += len(ids) // 4
    if parts:
        yield closed()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, shards: int | None = None, by_word: bool = True) -> None:
    """Encode ``docs`` (doc_id long, text string) into token files under ``path``, in ascending doc_id order.

    Documents are dealt to ``shards`` ranges of ids (the session's shuffle partitions if not given), so the one shuffle moves
    the texts and no task holds more than its range; inside a range only a segment is held at once.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first())
        .withColumn("_tie", F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie")
        .select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    )
    ordered.mapInArrow(tidied(lambda it: _segments(it, tokenizer, by_word)), SEGMENTS).write.option("compression", "zstd").parquet(f"{path}/segments")
    sums = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").groupBy("shard").agg(F.sum("n_tokens")).collect()  # a row a shard
    base, rows = 0, []
    for shard, total in sorted(sums):
        rows.append((shard, base, total))
        base += total
    spark.createDataFrame(rows, "shard int, base long, n_tokens long").coalesce(1).write.parquet(f"{path}/manifest")


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_codes(row["codes"]).astype("<u4").tobytes()
            lengths = np.array(row["doc_tokens"], np.int64)
            stops = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["base"] + row["first"] + stops - lengths),
                    pa.array(lengths),
                    pa.array([ids[4 * (b - n) : 4 * b] for n, b in zip(lengths, stops, strict=True)], pa.binary()),
                ],
                ["doc_id", "start", "n_tokens", "ids"],
            )


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard int, base long, n_tokens long").parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32)."""
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    located = segments.join(F.broadcast(_manifest(spark, path).select("shard", "base")), "shard")  # a row a shard: as many as were asked for
    return located.mapInArrow(tidied(_documents), "doc_id long, start long, n_tokens long, ids binary")


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """(position, id) for a stated list of positions, without those beyond the end.

    The manifest, a row a shard, tells the shard of each; literal bounds on shard, first and stop reach the Parquet reader, which skips the files
    and row groups of all others, and of the segments read no other id is decoded.
    """
    shards = [(r.base, r.base + r.n_tokens, r.shard) for r in _manifest(spark, path).orderBy("base").collect()]
    wanted: dict[int, list[int]] = {}
    for p in sorted(set(positions)):
        for base, end, shard in shards[max(0, bisect.bisect_right(shards, (p, float("inf"))) - 1) :]:
            if base <= p < end:
                wanted.setdefault(shard, []).append(p - base)
            break
    bases = {shard: base for base, _, shard in shards}
    hit = F.lit(False)
    for shard, own in wanted.items():
        inside = F.lit(False)
        cuts = [0, *(i for i in range(1, len(own)) if own[i] - own[i - 1] > NEAR), len(own)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            inside = inside | ((F.col("first") <= own[b - 1]) & (F.col("stop") > own[a]))
        hit = hit | ((F.col("shard") == shard) & inside)

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                every = wanted[row["shard"]]
                own = every[bisect.bisect_left(every, row["first"]) : bisect.bisect_left(every, row["stop"])]
                found = [access(row["codes"], p - row["first"]) for p in own]
                yield pa.RecordBatch.from_arrays([pa.array([bases[row["shard"]] + p for p in own], pa.int64()), pa.array(found, pa.int64())], ["position", "id"])

    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").where(hit)
    return segments.select("shard", "first", "stop", "codes").mapInArrow(tidied(look), "position long, id long")
