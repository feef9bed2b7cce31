"""A searchable, provable index of a log, kept as tables.

    postings    key_hash, idx, ord                  the keys of the leaves that each revision added
    values      key_hash, n, value_hash, epoch      commitments of the keys that it touched
    roots       bucket, key, root                   roots of the dictionary's buckets
    output      out_idx, leaf, map_root, in_cp      the output log
    manifests   size, peaks, checkpoints, roots, and the folders of the tables: the only thing that makes a revision visible

An update stages the new leaves in parts of bounded size, checks that they are gapless and that the grown tree has the checkpoint's root, and only then
writes. A reader takes one manifest, its folders and its size, so it sees one revision whatever is being written. Each revision adds a folder
to a table; ``compact`` makes one of them again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.hashing import value_hash
from ledgerlens.functions.mapfns import REGISTRY, MapFn, fingerprint
from ledgerlens.functions.notes import Checkpoint, Ed25519Signer, Verifier, parse_checkpoint, parse_unverified, sign_checkpoint
from ledgerlens.operators import dictionary, merkle
from ledgerlens.operators.merkle import verify_inclusion
from ledgerlens.operators.postings import postings, posting_lists, value_hashes
from ledgerlens.plans import manifest as manifests
from ledgerlens.plans.manifest import Manifest
from ledgerlens.scratch import scratch_path
from ledgerlens.sources.tiles import write_checkpoint, write_tiles

#: A log: positions from start up to end as (idx, leaf).
Leaves = Callable[[int, int], DataFrame]


@dataclass
class UpdateResult:
    size: int
    map_root: bytes
    out_idx: int


class LogError(Exception):
    """The log contradicts its checkpoint, or itself."""


#: Leaves that an update reads from the log at once; a batch of any size is staged in such parts and committed as a whole.
MOST_LEAVES = 50_000_000
_SCHEMAS = {
    "postings": "key_hash binary, idx long, ord int",
    "values": "key_hash binary, n long, value_hash binary, epoch int",
    "roots": dictionary.ROOTS,
    "output": "out_idx long, leaf binary, map_root binary, in_cp binary",
}


class LogIndex:
    """Open with ``LogIndex(spark, root, map_fn=name, signer=..., verifier=..., origin=...)``; a context manager."""

    def __init__(self, spark: SparkSession, root: str, map_fn: str, signer: Ed25519Signer, verifier: Verifier, origin: str | None = None, functions: dict[str, MapFn] | None = None):
        self.spark, self.root, self.name = spark, root.rstrip("/"), map_fn
        self.map_fn = (functions or REGISTRY)[map_fn]
        self.signer, self.verifier, self.origin = signer, verifier, origin
        self.function = fingerprint(spark, self.map_fn)
        if (m := self.manifest()) and (m.map_fn, m.function) != (map_fn, self.function):
            raise ValueError(f"this index was built with {m.map_fn}, {m.function[:12]}")

    def __enter__(self) -> LogIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open; tables and manifests are all there is."""

    def manifest(self, epoch: int | None = None) -> Manifest | None:
        return manifests.load(self.spark, self.root, epoch)

    def _table(self, name: str, m: Manifest) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(*(f"{self.root}/{p}" for p in m.tables[name]))

    def _stored(self, df: DataFrame, name: str, m: Manifest) -> str:
        """``df`` written into a folder of this run."""
        path = f"{name}/{m.epoch:012d}-{m.generation:06d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        return path

    def postings(self, m: Manifest) -> DataFrame:
        return self._table("postings", m).where(F.col("idx") < m.size)

    def values(self, m: Manifest) -> DataFrame:
        """The newest commitment of each key."""
        rows = self._table("values", m)
        if len(m.tables["values"]) == 1:  # one revision, or compacted: a row a key
            return rows.drop("epoch")
        return rows.groupBy("key_hash").agg(F.max_by(F.struct("n", "value_hash"), "epoch").alias("v")).select("key_hash", "v.n", "v.value_hash")

    def roots(self, m: Manifest) -> DataFrame:
        return self._table("roots", m)

    def output_log(self, m: Manifest | None = None) -> DataFrame:
        return self._table("output", m or self.manifest())

    def update(self, checkpoint: bytes, leaves: Leaves, batch_id: int = -1) -> UpdateResult | None:
        """Take the log up to a signed checkpoint into a new revision; None if it has nothing new, as when a batch
        that was committed before a failure comes again. ``batch_id`` is noted in the manifest.
        """
        seen = self.manifest() or Manifest(0, 0, self.name)
        cp = parse_checkpoint(checkpoint, self.verifier, self.origin)
        if cp.size < seen.size:
            raise LogError(f"the log shrank from {seen.size} to {cp.size}")
        if cp.size == seen.size:
            return None
        new = self._staged(leaves, seen.size, cp.size)
        peaks = self._checked(new, seen, cp)
        ahead = Manifest(seen.epoch + 1, cp.size, self.name, tables={k: list(v) for k, v in seen.tables.items()})

        def store(df: DataFrame, name: str) -> DataFrame:
            path = self._stored(df, name, ahead)
            ahead.tables[name] = [*([] if name == "roots" else ahead.tables.get(name, [])), path]
            return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.root}/{path}")

        added = store(_sorted(postings(new, self.map_fn)), "postings")
        touched = added.select("key_hash").distinct()
        fresh = value_hashes(self.postings(ahead).join(touched, "key_hash", "left_semi")).withColumn("epoch", F.lit(ahead.epoch))
        store(fresh.repartitionByRange("key_hash").sortWithinPartitions("key_hash"), "values")
        entries = self.values(ahead).select("key_hash", "value_hash")
        keys = entries.count()
        bits = dictionary.bits_for(keys)
        if seen.epoch and bits == seen.bits:
            store(dictionary.updated_roots(self.roots(seen), entries, touched, bits), "roots")
        else:
            store(dictionary.bucket_roots(entries, bits), "roots")
        map_root = dictionary.top_trie(self.roots(ahead)).root()

        leaf = map_root.hex().encode() + b"\n" + checkpoint
        out_idx = seen.epoch
        store(self.spark.createDataFrame([(out_idx, leaf, map_root, checkpoint)], _SCHEMAS["output"]).coalesce(1), "output")
        out_peaks = _grown([bytes.fromhex(p) for p in seen.output_peaks], out_idx, hashlib.sha256(b"\x00" + leaf).digest())
        out_cp = sign_checkpoint(self.signer, self.signer.name, out_idx + 1, merkle.joined(out_peaks))
        done = replace(
            ahead, peaks=[p.hex() for p in peaks], checkpoint=checkpoint.decode(), map_root=map_root.hex(), bits=bits, keys=keys,
            output_peaks=[p.hex() for p in out_peaks], output_checkpoint=out_cp.decode(), batch_id=batch_id, function=self.function,
        )
        manifests.commit(self.spark, self.root, done)
        return UpdateResult(cp.size, map_root, out_idx)

    def compact(self) -> Manifest:
        """The newest revision with one folder a table; what it shows does not change, and readers of older manifests keep theirs."""
        m = self.manifest()
        if m is None:
            raise LookupError("the index is empty")
        ahead = replace(m, generation=m.generation + 1, tables=dict(m.tables))
        newest = self.values(m).withColumn("epoch", F.lit(m.epoch)).repartitionByRange("key_hash").sortWithinPartitions("key_hash")
        for name, df in (("postings", _sorted(self.postings(m))), ("values", newest), ("output", self.output_log(m).coalesce(1))):
            if len(m.tables[name]) > 1:
                ahead.tables[name] = [self._stored(df, name, ahead)]
        manifests.commit(self.spark, self.root, ahead)
        return ahead

    def _staged(self, leaves: Leaves, start: int, end: int) -> DataFrame:
        """The log's positions from ``start`` up to ``end``, read once, ``MOST_LEAVES`` at a time."""
        path = scratch_path(self.spark, "leaves")
        for a in range(start, end, MOST_LEAVES):
            leaves(a, min(a + MOST_LEAVES, end)).select(F.col("idx").cast("long"), F.col("leaf").cast("binary")).write.mode("append").parquet(path)
        return self.spark.read.schema("idx long, leaf binary").parquet(path)

    def _checked(self, new: DataFrame, seen: Manifest, cp: Checkpoint) -> list[bytes]:
        """The peaks of the grown tree, if the new leaves are exactly the missing positions and lead to the checkpoint's root. Number and ends
        are counted; with a position missing and another twice they may be right, but then the root is not."""
        r = new.agg(F.count("*").alias("n"), F.min("idx").alias("a"), F.max("idx").alias("b")).first()
        if (r.n, r.a, r.b) != (cp.size - seen.size, seen.size, cp.size - 1):
            raise LogError(f"leaves from {seen.size} to {cp.size} expected, found {r.n} from {r.a} to {r.b}")
        nodes = merkle.complete_nodes(merkle.leaf_hashes(new), cp.size, scratch_path(self.spark, "nodes"))
        try:
            peaks = merkle.peaks(nodes, cp.size) if seen.size == 0 else merkle.appended([bytes.fromhex(p) for p in seen.peaks], seen.size, nodes, cp.size)
        except (KeyError, ValueError) as e:
            raise LogError("a position is missing") from e
        if merkle.joined(peaks) != cp.hash:
            raise LogError("the leaves do not have the checkpoint's root")
        return peaks

    def lookup_many(self, keys: DataFrame | list[bytes], epoch: int | None = None, proofs: bool = True) -> DataFrame:
        """For each of ``keys`` (key_hash, or a short list): idx (its positions, empty if absent) and, if asked for, the proof of that.

        A list becomes filters on the key, which the sorted files can be skipped by; a DataFrame of any size is joined.
        """
        m = self.manifest(epoch)
        if m is None:
            raise LookupError("the index is empty")
        rows, values = self.postings(m), self.values(m).select("key_hash", "value_hash")
        if isinstance(keys, list):
            asked = self.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key_hash binary")
            rows = rows.where(F.col("key_hash").isin([F.lit(k) for k in keys]))
            if proofs:
                values = values.where(self._in_buckets(keys, m))
        else:
            asked = keys.select("key_hash").distinct()
            rows = rows.join(asked, "key_hash", "left_semi")
        found = asked.join(posting_lists(rows), "key_hash", "left").withColumn("idx", F.coalesce("idx", F.array().cast("array<long>")))
        return found.join(dictionary.proofs(values, asked, self.roots(m), m.bits), "key_hash") if proofs else found

    def export_output(self, folder: str) -> None:
        """The output log as tile files with its signed checkpoint, for readers of tiled logs."""
        m = self.manifest()
        write_tiles(self.output_log(m).select(F.col("out_idx").alias("idx"), "leaf"), folder)
        write_checkpoint(folder, m.output_checkpoint.encode())

    def _in_buckets(self, keys: list[bytes], m: Manifest) -> Column:
        """Whether a key is in a bucket that the answer to one of ``keys`` needs."""
        top, out = dictionary.top_trie(self.roots(m)), F.lit(False)
        for k in keys if top.keys else []:
            first, after = dictionary.bucket_range(top.keys[top.path(k)[0]], m.bits)
            own = F.col("key_hash") >= F.lit(first)
            out = out | (own if after is None else own & (F.col("key_hash") < F.lit(after)))
        return out

    def lookup(self, key: str | bytes, epoch: int | None = None) -> LookupResponse:
        """The response for one key (a string, or its 32-byte hash)."""
        key_hash = hashlib.sha256(key.encode()).digest() if isinstance(key, str) else key
        if len(key_hash) != 32:
            raise ValueError("a key hash has 32 bytes")
        m = self.manifest(epoch)
        if m is None:
            raise LookupError("the index is empty")
        r = self.lookup_many([key_hash], m.epoch).first()
        nodes = merkle.complete_nodes(merkle.leaf_hashes(self.output_log(m).select(F.col("out_idx").alias("idx"), "leaf")), m.epoch)
        last = self.spark.createDataFrame([(m.epoch - 1,)], "idx long")
        proof = [bytes(p) for p in merkle.inclusion_proofs(last, nodes, m.epoch).first().proof]
        leaf = bytes(self.output_log(m).where(F.col("out_idx") == m.epoch - 1).first().leaf)
        own = DictionaryProof(r.found, _b(r.other_key), _b(r.other_value), list(r.depths), [bytes(s) for s in r.siblings])
        return LookupResponse(m.output_checkpoint.encode(), leaf, proof, list(r.idx), own)


def _sorted(rows: DataFrame) -> DataFrame:
    """By key, so that lookups skip files and row groups; by position too, so that a hot key is spread."""
    return rows.repartitionByRange("key_hash", "idx").sortWithinPartitions("key_hash", "idx")


def _b(x) -> bytes | None:
    return None if x is None else bytes(x)


def _grown(peaks: list[bytes], size: int, leaf: bytes) -> list[bytes]:
    """Peaks after one more leaf."""
    out, node = list(peaks), leaf
    while size & 1:
        node, size = merkle.hash_nodes(out.pop(), node), size >> 1
    return [*out, node]


@dataclass
class DictionaryProof:
    found: bool
    other_key: bytes | None
    other_value: bytes | None
    depths: list[int]
    siblings: list[bytes]


@dataclass
class LookupResponse:
    output_log_cp: bytes
    output_log_leaf: bytes
    output_log_proof: list[bytes]
    index_value: list[int]
    index_proof: DictionaryProof

    def to_json(self) -> str:
        """Bytes as base64; lists of hashes as lists of numbers, and an empty list as null."""
        from base64 import b64encode

        p = self.index_proof
        proof = json.dumps({"found": p.found, "other_key": p.other_key.hex() if p.other_key else None, "other_value": p.other_value.hex() if p.other_value else None, "depths": p.depths, "siblings": [s.hex() for s in p.siblings]})
        return json.dumps({
            "output_log_cp": b64encode(self.output_log_cp).decode(), "output_log_leaf": b64encode(self.output_log_leaf).decode(),
            "output_log_proof": [list(h) for h in self.output_log_proof] or None, "index_value": self.index_value or None, "index_proof": b64encode(proof.encode()).decode(),
        })


def verify_lookup_response(key_hash: bytes, response: LookupResponse, output_verifier: Verifier, input_verifier: Verifier, origin: str | None = None) -> Checkpoint:
    """The input checkpoint that the response holds for; a ``LogError`` if any of its seven checks fails."""
    out = parse_checkpoint(response.output_log_cp, output_verifier)
    node = hashlib.sha256(b"\x00" + response.output_log_leaf).digest()
    if not verify_inclusion(out.size - 1, out.size, node, response.output_log_proof, out.hash):
        raise LogError("the output leaf is not in the output log")
    if len(response.output_log_leaf) < 65 or response.output_log_leaf[64:65] != b"\n":
        raise LogError("malformed output leaf")
    map_root, raw = bytes.fromhex(response.output_log_leaf[:64].decode()), response.output_log_leaf[65:]
    cp = parse_checkpoint(raw, input_verifier, origin)
    positions = response.index_value
    if any(a > b for a, b in zip(positions, positions[1:], strict=False)) or any(not 0 <= x < cp.size for x in positions):
        raise LogError("positions out of order or range")
    value = hashlib.sha256(b"".join(x.to_bytes(8, "big") for x in positions)).digest() if positions else None
    p = response.index_proof
    if p.found != (value is not None) or not dictionary.verified(map_root, key_hash, value, p.found, p.other_key, p.other_value, p.depths, p.siblings):
        raise LogError("the dictionary's proof does not hold")
    return cp


def dereference(log: DataFrame, positions: DataFrame, checkpoint: bytes) -> DataFrame:
    """(idx, leaf, verified) for ``positions`` (idx): each leaf with the check of its inclusion in the log's checkpoint.

    A position at or above the size, or one that the log lacks, is an error.
    """
    cp = parse_unverified(checkpoint)
    hashes = merkle.leaf_hashes(log.where(F.col("idx") < cp.size))
    nodes = merkle.complete_nodes(hashes, cp.size, scratch_path(log.sparkSession, "nodes"))
    guarded = positions.select(F.when(F.col("idx") < cp.size, F.col("idx")).otherwise(F.raise_error(F.concat(F.lit("position beyond the log: "), F.col("idx"))).cast("long")).alias("idx"))
    leaf = F.when(F.col("leaf").isNotNull(), F.col("leaf")).otherwise(F.raise_error(F.concat(F.lit("no leaf at "), F.col("idx"))).cast("binary"))
    rows = guarded.join(log, "idx", "left").select("idx", leaf.alias("leaf"))
    return rows.join(merkle.checked(merkle.leaf_hashes(rows), nodes, cp.size, cp.hash), "idx").select("idx", "leaf", "verified")


def lookup_value_hash(positions: DataFrame) -> DataFrame:
    """(key_hash, value_hash) recomputed from looked-up lists, to hold against the dictionary."""
    return positions.select("key_hash", F.when(F.size("idx") > 0, value_hash(F.col("idx"))).alias("value_hash"))
