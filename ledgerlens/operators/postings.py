"""The inverted index: postings, posting lists and their commitments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.hashing import sha256, value_hash
from ledgerlens.functions.mapfns import MapFn, key_hashes

#: A chunk of a posting list holds the positions that agree above their last 16 bits.
CHUNK_BITS = 16


def postings(log: DataFrame, map_fn: MapFn) -> DataFrame:
    """(key_hash, idx, ord) for every key of every leaf; a leaf without keys gives no row. One narrow stage."""
    return log.select("idx", F.posexplode(key_hashes(map_fn(F.col("leaf")))).alias("ord", "key_hash")).select("key_hash", "idx", "ord")


def posting_chunks(rows: DataFrame) -> DataFrame:
    """(key_hash, chunk, idx array, n): lists in runs of at most 65,536 positions (repeats aside), so that no group grows with a hot key."""
    by = rows.groupBy("key_hash", F.shiftright("idx", CHUNK_BITS).alias("chunk"))
    return by.agg(F.array_sort(F.collect_list("idx")).alias("idx")).withColumn("n", F.size("idx").cast("long"))


def posting_lists(rows: DataFrame) -> DataFrame:
    """(key_hash, idx): each key's positions in order, repeats kept. A list is one row: for lists beyond a row use the chunks."""
    chunks = posting_chunks(rows).groupBy("key_hash").agg(F.array_sort(F.collect_list(F.struct("chunk", "idx"))).alias("c"))
    return chunks.select("key_hash", F.flatten(F.col("c.idx")).alias("idx"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key_hash, n, value_hash) of rows (key_hash, idx) in order; a key's rows may go on in the next batch."""
    key, n, running = None, 0, hashlib.sha256()
    names = ["key_hash", "n", "value_hash"]
    for batch in batches:
        if not batch.num_rows:
            continue
        words = np.frombuffer(b"".join(batch["key_hash"].to_pylist()), ">u8").reshape(batch.num_rows, 4)
        data = np.asarray(batch["idx"]).astype(">i8").tobytes()
        starts = [0, *(np.flatnonzero((words[1:] != words[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        done: tuple[list, list, list] = ([], [], [])
        for a, b in zip(starts, starts[1:], strict=False):
            own = words[a].tobytes()
            if own != key:
                if key is not None:
                    for column, value in zip(done, (key, n, running.digest()), strict=True):
                        column.append(value)
                key, n, running = own, 0, hashlib.sha256()
            running.update(data[8 * a : 8 * b])
            n += b - a
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, (pa.binary(), pa.int64(), pa.binary()), strict=True)], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([n], pa.int64()), pa.array([running.digest()], pa.binary())], names)


def value_hashes(rows: DataFrame) -> DataFrame:
    """(key_hash, n, value_hash): the commitment to each whole list.

    The rows of a key go through one running hash in the order of their positions, as the format asks, so no list is ever in
    memory: a hot key costs its task the time to hash it, 8 bytes a position.

    The rows are dealt by a hash of the key: dealt by the key itself, Spark would take a join on it below as dealt already, and that join may
    later be read where it lies (as a broadcast join, or split for skew), with a key's rows in many tasks.
    """
    ordered = rows.select("key_hash", "idx").repartition(F.xxhash64("key_hash")).sortWithinPartitions("key_hash", "idx")
    return ordered.mapInArrow(_streamed, "key_hash binary, n long, value_hash binary")


def chunked_value_hashes(rows: DataFrame) -> DataFrame:
    """(key_hash, n, value_hash) with the hash over the hashes of the chunks: for keys with too many positions for one row.

    An appended position changes one chunk's hash, so a hot key costs a chunk instead of its whole list.
    """
    chunks = posting_chunks(rows).select("key_hash", "chunk", "n", value_hash(F.col("idx")).alias("h"))
    both = chunks.groupBy("key_hash").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("chunk", "h"))).alias("c"))
    return both.select("key_hash", "n", sha256(F.unhex(F.array_join(F.transform("c", lambda x: F.concat(F.lpad(F.hex(x["chunk"]), 16, "0"), F.hex(x["h"]))), ""))).alias("value_hash"))


def touched_value_hashes(old: DataFrame, rows: DataFrame, new: DataFrame) -> DataFrame:
    """Commitments after ``new`` postings: keys without new postings keep their ``old`` row (key_hash, n, value_hash)."""
    touched = new.select("key_hash").distinct()
    fresh = value_hashes(rows.unionByName(new).join(touched, "key_hash", "left_semi"))
    return old.join(touched, "key_hash", "left_anti").unionByName(fresh)


def below(positions: Column, size: Column | int) -> Column:
    """The positions that a revision of that size serves."""
    return F.filter(positions, lambda x: x < size)


def from_index(positions: Column, least: Column | int) -> Column:
    return F.filter(positions, lambda x: x >= least)


def delta(positions: Column, seen: Column | int) -> Column:
    """The list without its first ``seen`` positions: what a reader who has them still needs."""
    return F.slice(positions, F.lit(1) + seen, F.size(positions)) if not isinstance(seen, int) else F.slice(positions, F.lit(seen + 1), F.size(positions))
