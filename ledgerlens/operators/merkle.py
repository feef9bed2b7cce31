"""RFC 6962 trees over logs as DataFrames.

A log is ``idx long, leaf binary`` with positions 0 to n - 1. Eight levels at a time, 256 nodes are gathered in one row and hashed
together, a batch of rows at once in Arrow, so a tree of n leaves takes log256(n) shuffles of hashes, each a 256th of the one before. The
complete nodes are kept as a table (level, pos, hash); the root, the peaks of a size and audit paths are read off it.

Proofs go the same way down: a tile's path to its peak is found once, and its leaves get theirs where its 256 hashes are. What is claimed of the
leaves is dealt to their tiles and checked there, so no proof has to be moved.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.codec import TILE
from ledgerlens.functions.hashing import leaf_hash, node_hash

NODES = "level int, pos long, hash binary"
#: Tiles that are Python objects at once.
TILES_AT_ONCE = 64
#: The position and leaf hash that a proof of (position, leaf hash) is tried for.
Claim = Callable[[int, bytes], tuple[int, bytes]]


def hash_nodes(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def fold(hashes: list[bytes]) -> bytes:
    """The root of consecutive nodes; an odd last node moves up unchanged."""
    while len(hashes) > 1:
        pairs = zip(hashes[::2], hashes[1::2], strict=False)
        hashes = [*(hash_nodes(a, b) for a, b in pairs), *hashes[len(hashes) & ~1 :]]
    return hashes[0]


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ``TILES_AT_ONCE`` at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, TILES_AT_ONCE):
            yield batch.slice(a, TILES_AT_ONCE)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tile, n, root) of rows (tile, first, hashes)."""
    for batch in _few(batches):
        tiles = batch["hashes"].to_pylist()
        roots = pa.array([fold(t) for t in tiles], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["tile"], pa.array([len(t) for t in tiles], pa.int32()), roots], ["tile", "n", "root"])


def _above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(up, pos, hash) of the complete nodes on the eight levels above rows (tile, first, hashes)."""
    for batch in _few(batches):
        ups, places, out = [], [], []
        for tile, first, hashes in zip(batch["tile"].to_pylist(), batch["first"].to_pylist(), batch["hashes"].to_pylist(), strict=True):
            start = tile * TILE + first
            for up in range(1, 9):
                hashes = hashes[start & 1 :]  # a left part before the range is not there
                start = start + 1 >> 1
                hashes = [hash_nodes(a, b) for a, b in zip(hashes[::2], hashes[1::2], strict=False)]
                ups += [up] * len(hashes)
                places += range(start, start + len(hashes))
                out += hashes
        yield pa.RecordBatch.from_arrays([pa.array(ups, pa.int32()), pa.array(places, pa.int64()), pa.array(out, pa.binary())], ["up", "pos", "hash"])


def leaf_hashes(log: DataFrame) -> DataFrame:
    """(idx, hash) of (idx, leaf)."""
    return log.select("idx", leaf_hash(F.col("leaf")).alias("hash"))


def _tiles(nodes: DataFrame) -> DataFrame:
    """(pos, hash) gathered by 256: tile, the place of the first one that is there, hashes in order."""
    rows = nodes.groupBy(F.shiftright("pos", 8).alias("tile")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("rows"))
    return rows.select("tile", (F.get("rows", F.lit(0))["pos"] % TILE).cast("int").alias("first"), F.col("rows.hash").alias("hashes"))


def tile_roots(hashes: DataFrame) -> DataFrame:
    """(tile, n, root) of each tile of 256 leaf hashes (idx, hash); the last may be partial."""
    return _tiles(hashes.select(F.col("idx").alias("pos"), "hash")).mapInArrow(_folded, "tile long, n int, root binary")


def complete_nodes(hashes: DataFrame, size: int, path: str | None = None) -> DataFrame:
    """All complete nodes (level, pos, hash) over (idx, hash), a gapless range of a log's positions up to ``size``: those whose leaves are
    all there, so none that reach over the start of the range.

    With a ``path``, each eight levels are written there and the next start from them, so nothing is hashed twice however
    often the nodes are read; without, the result is one lazy plan.
    """
    spark = hashes.sparkSession
    current = hashes.select(F.col("idx").alias("pos"), "hash")
    if path:
        current.write.parquet(f"{path}/leaves")
        current = spark.read.schema("pos long, hash binary").parquet(f"{path}/leaves")
    out = current.select(F.lit(0).alias("level"), "pos", "hash")
    level, n = 0, size
    while n > 1:
        nodes = _tiles(current).mapInArrow(_above, "up int, pos long, hash binary").select((F.col("up") + level).alias("level"), "pos", "hash")
        if path:
            nodes.write.parquet(f"{path}/above={level}")
            nodes = spark.read.schema(NODES).parquet(f"{path}/above={level}")
        out = out.unionByName(nodes)
        level, n = level + 8, n >> 8
        current = nodes.where(F.col("level") == level).select("pos", "hash")
    return out


def peak_places(size: int) -> list[tuple[int, int]]:
    """(level, pos) of the complete trees that a size decomposes into, the largest first."""
    out, start = [], 0
    for level in range(size.bit_length() - 1, -1, -1):
        if size >> level & 1:
            out.append((level, start >> level))
            start += 1 << level
    return out


def peaks(nodes: DataFrame, size: int) -> list[bytes]:
    """Hashes of the peaks, the largest first: at most 63 rows come to the driver."""
    places = peak_places(size)
    if not places:
        return []
    found = {(r.level, r.pos): bytes(r.hash) for r in nodes.where(F.struct("level", "pos").isin([F.struct(F.lit(a), F.lit(b).cast("long")) for a, b in places])).collect()}
    return [found[p] for p in places]


def joined(hashes: list[bytes]) -> bytes:
    """The root over peaks; the hash of nothing for an empty tree."""
    if not hashes:
        return hashlib.sha256(b"").digest()
    out = hashes[-1]
    for h in reversed(hashes[:-1]):
        out = hash_nodes(h, out)
    return out


def root(hashes: DataFrame, size: int) -> bytes:
    """The root of (idx, hash): tiles folded to one hash each, then their roots, until one is left."""
    if not size:
        return joined([])
    current = hashes.select(F.col("idx").alias("pos"), "hash")
    n = size
    while True:
        current = _tiles(current).mapInArrow(_folded, "tile long, n int, root binary").select(F.col("tile").alias("pos"), F.col("root").alias("hash"))
        n = -(-n // TILE)
        if n == 1:
            return bytes(current.first().hash)


def appended(before: list[bytes], size: int, nodes: DataFrame, new_size: int) -> list[bytes]:
    """Peaks of the grown tree from the old peaks and the complete nodes of the new leaves (in log positions).

    An old peak is a node of the new tree; what lies between is hashed here, at most two hashes a level.
    """
    known = dict(zip(peak_places(size), before, strict=True))
    wanted: set[tuple[int, int]] = set()

    def need(level: int, pos: int) -> None:
        if (level, pos) in known or level < 0:
            return
        if pos << level >= size:
            wanted.add((level, pos))
        else:
            need(level - 1, 2 * pos)
            need(level - 1, 2 * pos + 1)

    for p in peak_places(new_size):
        need(*p)
    if wanted:
        rows = nodes.where(F.struct("level", "pos").isin([F.struct(F.lit(a), F.lit(b).cast("long")) for a, b in sorted(wanted)])).collect()
        known |= {(r.level, r.pos): bytes(r.hash) for r in rows}

    def of(level: int, pos: int) -> bytes:
        if level < 0:
            raise ValueError("a leaf of the new range is missing")
        return known[level, pos] if (level, pos) in known else hash_nodes(of(level - 1, 2 * pos), of(level - 1, 2 * pos + 1))

    return [of(*p) for p in peak_places(new_size)]


def _inner(hashes: list[bytes]) -> list[list[bytes]]:
    """The complete nodes over a tile's hashes, level by level from these."""
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([hash_nodes(a, b) for a, b in zip(out[-1][::2], out[-1][1::2], strict=False)])
    return out


def _path(levels: list[list[bytes]], i: int) -> list[bytes]:
    """Siblings from the i-th hash of a tile up to the root of the complete tree, within the tile, that it lies in."""
    out = []
    for own, parents in zip(levels, levels[1:], strict=False):
        if i >> 1 >= len(parents):
            break
        out.append(own[i ^ 1])
        i >>= 1
    return out


def _paths_of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pos, path) of all nodes of rows (tile, hashes, above)."""
    for batch in _few(batches):
        places, out = [], []
        for tile, hashes, above in zip(batch["tile"].to_pylist(), batch["hashes"].to_pylist(), batch["above"].to_pylist(), strict=True):
            levels = _inner(hashes)
            places += range(tile * TILE, tile * TILE + len(hashes))
            out += [_path(levels, i) + above for i in range(len(hashes))]
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(out, pa.list_(pa.binary()))], ["pos", "path"])


def _tiles_with_paths(nodes: DataFrame, size: int) -> DataFrame:
    """(tile, hashes, above) of every tile of leaves; ``above`` goes from the tile to its peak, and is empty for a tile that is not full."""
    level = (max(size, 1).bit_length() - 1) // 8 * 8
    paths = None
    while True:
        tiles = _tiles(nodes.where(F.col("level") == level).select("pos", "hash")).select("tile", "hashes")
        if paths is not None:
            tiles = tiles.join(paths.withColumnsRenamed({"pos": "tile", "path": "above"}), "tile", "left")
        else:
            tiles = tiles.withColumn("above", F.lit(None).cast("array<binary>"))
        tiles = tiles.select("tile", "hashes", F.coalesce("above", F.array().cast("array<binary>")).alias("above"))
        if level == 0:
            return tiles
        paths = tiles.mapInArrow(_paths_of_all, "pos long, path array<binary>")
        level -= 8


def _from_peaks(nodes: DataFrame, size: int) -> Callable[[int], list[bytes]]:
    """What leads from the peak over a position to the root."""
    places, tops = peak_places(size), peaks(nodes, size)
    stops, stop = [], 0
    for level, _ in places:  # at most 63
        stop += 1 << level
        stops.append(stop)
    rest = [([joined(tops[j + 1 :])] if j + 1 < len(tops) else []) + tops[:j][::-1] for j in range(len(tops))]
    return lambda idx: rest[bisect.bisect_right(stops, idx)]


def _at_tiles(rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(tile, hashes, above, own) of tiles with the ``rows`` (idx, ...) below ``size`` that belong to them."""
    own = rows.where((F.col("idx") >= 0) & (F.col("idx") < size)).groupBy(F.shiftright("idx", 8).alias("tile")).agg(F.collect_set(F.struct(*rows.columns)).alias("own"))
    return own.join(_tiles_with_paths(nodes, size), "tile").select("tile", "hashes", "above", "own")


def _with_proofs(batches: Iterator[pa.RecordBatch], last: Callable[[int], list[bytes]]) -> Iterator[list[tuple[dict, list[bytes]]]]:
    """For each tile, its rows with the proofs of their positions."""
    for batch in _few(batches):
        for row in batch.to_pylist():
            levels = _inner(row["hashes"])
            own = {tuple(r.values()): r for r in row["own"]}.values()  # rows with hashes may come twice
            yield [(r, _path(levels, r["idx"] % TILE) + row["above"] + last(r["idx"])) for r in own]


def inclusion_proofs(indices: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(idx, proof) for each of ``indices`` (idx) below ``size``, from complete nodes."""
    last = _from_peaks(nodes, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _with_proofs(batches, last):
            yield pa.RecordBatch.from_arrays([pa.array([r["idx"] for r, _ in tile], pa.int64()), pa.array([p for _, p in tile], pa.list_(pa.binary()))], ["idx", "proof"])

    return _at_tiles(indices.select(F.col("idx").cast("long").alias("idx")), nodes, size).mapInArrow(run, "idx long, proof array<binary>")


def checked(hashes: DataFrame, nodes: DataFrame, size: int, root_hash: bytes, claims: dict[str, Claim] | None = None) -> DataFrame:
    """(idx, verified) for leaf hashes (idx, hash) below ``size``: whether the proof of the position, from complete nodes, leads from that hash
    to the root. Each of ``claims`` adds a column: whether that same proof holds for another position or hash."""
    last, columns = _from_peaks(nodes, size), {"verified": lambda idx, leaf: (idx, leaf)} | (claims or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _with_proofs(batches, last):
            found = [pa.array([verify_inclusion(at, size, leaf, p, root_hash) for r, p in tile for at, leaf in [claim(r["idx"], r["hash"])]], pa.bool_()) for claim in columns.values()]
            yield pa.RecordBatch.from_arrays([pa.array([r["idx"] for r, _ in tile], pa.int64()), *found], ["idx", *columns])

    rows = hashes.select(F.col("idx").cast("long").alias("idx"), "hash")
    return _at_tiles(rows, nodes, size).mapInArrow(run, ", ".join(["idx long", *(f"{c} boolean" for c in columns)]))


def verify_inclusion(idx: int, size: int, leaf: bytes, proof: list[bytes], root: bytes) -> bool:
    """Whether a proof leads from a leaf hash to a root."""
    fn, sn, r = idx, size - 1, leaf
    if idx >= size or leaf is None:
        return False
    for p in proof:
        if sn == 0:
            return False
        if fn & 1 or fn == sn:
            r = hash_nodes(p, r)
            while fn and not fn & 1:
                fn, sn = fn >> 1, sn >> 1
        else:
            r = hash_nodes(r, p)
        fn, sn = fn >> 1, sn >> 1
    return sn == 0 and r == root


def inclusion_verified(idx: Column, size: Column, hash_: Column, proof: Column, root_hash: Column) -> Column:
    """Whether a proof leads from a leaf hash to a root (the check of RFC 9162, section 2.1.3.2)."""

    def step(a: Column, p: Column) -> Column:
        fn, sn, r = a["fn"], a["sn"], a["r"]
        right = (fn % 2 == 1) | (fn == sn)
        skip = F.when(right & (fn % 2 == 0) & (fn > 0), F.bit_count(fn.bitwiseAND(-fn) - 1)).otherwise(0) + 1
        shrink = lambda x: F.floor(x / F.pow(F.lit(2), skip)).cast("long")
        return F.struct(
            F.when(right & (fn == 0), F.lit(0).cast("long")).otherwise(shrink(fn)).alias("fn"),
            F.when(right & (fn == 0), F.lit(0).cast("long")).otherwise(shrink(sn)).alias("sn"),
            F.when(right, node_hash(p, r)).otherwise(node_hash(r, p)).alias("r"),
            (a["ok"] & (sn > 0)).alias("ok"),
        )

    start = F.struct(idx.cast("long").alias("fn"), (size.cast("long") - 1).alias("sn"), hash_.alias("r"), (idx < size).alias("ok"))
    return F.coalesce(F.aggregate(proof, start, step, lambda a: a["ok"] & (a["sn"] == 0) & (a["r"] == root_hash)), F.lit(False))
