"""The committed dictionary: a compressed binary trie over 32-byte keys with one root.

    leaf(key, value)        SHA-256(10 key value)
    branch(depth, l, r)     SHA-256(11 depth as two bytes l r), depth being the first bit in which the two sides differ
    empty                   32 zero bytes

A node depends on nothing but its keys and values, so the root does not depend on the order of insertion and parts compose. Keys are
hashes and so fall evenly on buckets of their first bits; each bucket is built by itself, in a group of about
``BUCKET`` keys, and the roots of the buckets (2**16 at most) are folded on the driver. A bucket is rebuilt only if a key in it changed.

A proof is the list of (depth, sibling) from the leaf up, in falling depth. It shows a key present, or, with the other key that
stands where the asked one would, absent; the way is taken by the bits of the asked key, so no key has both.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = bytes(32)
#: Keys of one bucket, about.
BUCKET = 20_000
MOST_BITS = 16
ROOTS = "bucket int, key binary, root binary"
PROOF = "found boolean, other_key binary, other_value binary, depths array<int>, siblings array<binary>"


def leaf_node(key: bytes, value: bytes) -> bytes:
    return hashlib.sha256(b"\x10" + key + value).digest()


def branch_node(depth: int, left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x11" + depth.to_bytes(2, "big") + left + right).digest()


def first_difference(a: bytes, b: bytes) -> int:
    """The first bit in which two keys differ."""
    return len(a) * 8 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length()


def bit(key: bytes, depth: int) -> int:
    return key[depth >> 3] >> (7 - (depth & 7)) & 1


class Trie:
    """A trie over sorted (key, node) pairs: its branches as (depth, left, right, hash) by number, leaves as numbers below zero."""

    def __init__(self, keys: list[bytes], leaves: list[bytes]):
        self.keys, self.leaves = keys, leaves
        self.branches: list[tuple[int, int, int, bytes]] = []
        # a stack of open subtrees from left to right, split at falling depths
        stack: list[tuple[int, int]] = []  # (depth of the split after it, node)
        for i in range(len(keys)):
            node, depth = -1 - i, first_difference(keys[i], keys[i + 1]) if i + 1 < len(keys) else -1
            while stack and stack[-1][0] > depth:
                at, left = stack.pop()
                self.branches.append((at, left, node, branch_node(at, self.hash(left), self.hash(node))))
                node = len(self.branches) - 1
            stack.append((depth, node))
        self.top = stack[0][1] if stack else None

    def hash(self, node: int) -> bytes:
        return self.leaves[-1 - node] if node < 0 else self.branches[node][3]

    def root(self) -> bytes:
        return EMPTY if self.top is None else self.hash(self.top)

    def path(self, key: bytes) -> tuple[int, list[tuple[int, bytes]]]:
        """The leaf that the bits of ``key`` lead to, and (depth, sibling) from it up."""
        node, out = self.top, []
        while node >= 0:
            depth, left, right, _ = self.branches[node]
            node, other = (right, left) if bit(key, depth) else (left, right)
            out.append((depth, self.hash(other)))
        return -1 - node, out[::-1]


def bits_for(keys: int) -> int:
    """First bits of the buckets for so many keys."""
    return min(MOST_BITS, max(0, math.ceil(math.log2(max(1, keys / BUCKET)))))


def _bucket(key: Column, bits: int) -> Column:
    return F.floor(F.conv(F.hex(F.substring(key, 1, 2)), 16, 10).cast("long") / (1 << (MOST_BITS - bits))).cast("int").alias("bucket")


def bucket_range(key: bytes, bits: int) -> tuple[bytes, bytes | None]:
    """The first key of the bucket of ``key``, and the first after it (None for the last bucket): a range that a scan can skip by."""
    width = MOST_BITS - bits
    first = int.from_bytes(key[:2], "big") >> width << width
    after = first + (1 << width)
    return first.to_bytes(2, "big") + bytes(30), after.to_bytes(2, "big") + bytes(30) if after < 1 << MOST_BITS else None


def bucket_roots(entries: DataFrame, bits: int) -> DataFrame:
    """(bucket, key, root) of the buckets of ``entries`` (key_hash, value_hash); ``key`` is any key of the bucket."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key_hash")
        keys, values = table["key_hash"].to_pylist(), table["value_hash"].to_pylist()
        trie = Trie(keys, [leaf_node(k, v) for k, v in zip(keys, values, strict=True)])
        return pa.table({"bucket": table["bucket"].slice(0, 1), "key": pa.array(keys[:1], pa.binary()), "root": pa.array([trie.root()], pa.binary())})

    return entries.select(_bucket(F.col("key_hash"), bits), "key_hash", "value_hash").groupBy("bucket").applyInArrow(run, ROOTS)


def top_trie(roots: DataFrame) -> Trie:
    """The trie over the buckets: at most 2**16 rows come to the driver."""
    rows = sorted((bytes(r.key), bytes(r.root)) for r in roots.select("key", "root").collect())
    return Trie([r[0] for r in rows], [r[1] for r in rows])


def map_root(entries: DataFrame, bits: int | None = None) -> bytes:
    """The root over all entries (key_hash, value_hash)."""
    return top_trie(bucket_roots(entries, bits_for(entries.count()) if bits is None else bits)).root()


def updated_roots(old: DataFrame, entries: DataFrame, touched: DataFrame, bits: int) -> DataFrame:
    """Bucket roots after a change: only buckets of ``touched`` keys (key_hash) are built anew from ``entries``."""
    changed = F.broadcast(touched.select(_bucket(F.col("key_hash"), bits)).distinct())  # 2**16 rows at most
    rows = entries.withColumn("bucket", _bucket(F.col("key_hash"), bits)).join(changed, "bucket", "left_semi")
    return old.join(changed, "bucket", "left_anti").unionByName(bucket_roots(rows, bits))


def proofs(entries: DataFrame, asked: DataFrame, roots: DataFrame, bits: int) -> DataFrame:
    """For each of ``asked`` (key_hash): found, the entry its bits lead to, and the path. One job for any number of keys.

    A key whose bucket is empty is answered by the bucket that the trie over the buckets leads to.
    """
    top = top_trie(roots)
    shared = asked.sparkSession.sparkContext.broadcast(top)  # 2**16 roots at most
    if top.top is None:
        return asked.select("key_hash", F.lit(False).alias("found"), *(F.lit(None).cast("binary").alias(c) for c in ("other_key", "other_value")), F.array().cast("array<int>").alias("depths"), F.array().cast("array<binary>").alias("siblings"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = [shared.value.keys[shared.value.path(k)[0]] for k in batch["key_hash"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key_hash"], pa.array(to, pa.binary())], ["key_hash", "to"])

    routed = asked.select("key_hash").distinct().mapInArrow(route, "key_hash binary, to binary").select(_bucket(F.col("to"), bits), "key_hash")
    hit = F.broadcast(routed.select("bucket").distinct())  # 2**16 rows at most
    own = entries.select(_bucket(F.col("key_hash"), bits), "key_hash", "value_hash").join(hit, "bucket", "left_semi")

    def run(key: tuple, table: pa.Table, wanted: pa.Table) -> pa.Table:
        keys, values = table.sort_by("key_hash")["key_hash"].to_pylist(), table.sort_by("key_hash")["value_hash"].to_pylist()
        trie = Trie(keys, [leaf_node(k, v) for k, v in zip(keys, values, strict=True)]) if wanted.num_rows else None
        out = []
        for k in wanted["key_hash"].to_pylist():
            i, path = trie.path(k)
            path += shared.value.path(k)[1]
            out.append((k, keys[i] == k, keys[i], values[i], [d for d, _ in path], [h for _, h in path]))
        kinds = [pa.binary(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary())]
        names = ["key_hash", "found", "other_key", "other_value", "depths", "siblings"]
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return own.groupBy("bucket").cogroup(routed.groupBy("bucket")).applyInArrow(run, f"key_hash binary, {PROOF}")


def verified(root: bytes, key: bytes, value: bytes | None, found: bool, other_key: bytes | None, other_value: bytes | None, depths: list[int], siblings: list[bytes]) -> bool:
    """Whether a proof shows that ``key`` has ``value`` (found), or that it is absent."""
    if other_key is None:
        return not found and root == EMPTY and not depths
    if found != (other_key == key) or (found and value != other_value) or len(depths) != len(siblings):
        return False
    if any(a <= b for a, b in zip(depths, depths[1:], strict=False)) or any(not 0 <= d < 256 or (bit(key, d) != bit(other_key, d)) for d in depths):
        return False
    node = leaf_node(other_key, other_value)
    for d, s in zip(depths, siblings, strict=True):
        node = branch_node(d, s, node) if bit(key, d) else branch_node(d, node, s)
    return node == root
