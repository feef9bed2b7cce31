"""Queries that run the whole index: updates, revisions, the stream, verified lookups, certificate leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import certificates, hashing, mapfns
from ledgerlens.functions.notes import Ed25519Signer, parse_unverified, sign_checkpoint
from ledgerlens.operators import merkle
from ledgerlens.operators.audit import map_audit
from ledgerlens.plans.index import LogIndex, verify_lookup_response
from ledgerlens.scratch import scratch_path
from ledgerlens.sources import tables
from ledgerlens.sources.tiles import read_tiles, write_tiles

#: Keys for the demonstration only, from a published seed.
SIGNER = Ed25519Signer("demo-log", hashlib.sha256(b"demonstration key, not secret").digest())
ORIGIN = "demo-log"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return tables.table_log(events, F.concat("event_type", F.lit(": "), F.col("event_id").cast("string")), F.col("event_id"))


def signed_at(log: DataFrame, size: int) -> bytes:
    """A checkpoint of the log's first ``size`` leaves."""
    hashes = merkle.leaf_hashes(log.where(F.col("idx") < size))
    return sign_checkpoint(SIGNER, ORIGIN, size, merkle.root(hashes, size))


def built(spark: SparkSession, sf_dir: str, shares: tuple[float, ...] = (0.4, 0.75, 1.0)) -> tuple[LogIndex, DataFrame]:
    """An index of the events, taken in as several revisions, and the log."""
    log = _events(spark, sf_dir)
    n = log.count()
    index = LogIndex(spark, scratch_path(spark, "events"), "before_colon", SIGNER, SIGNER.verifier(), ORIGIN)
    for share in shares:
        size = int(n * share)
        index.update(signed_at(log, size), lambda a, b: log.where((F.col("idx") >= a) & (F.col("idx") < b)))
    return index, log


_indexes: dict[tuple[str, str], LogIndex] = {}


def events_index(spark: SparkSession, sf_dir: str) -> LogIndex:
    """The index of the events, built once in a session, as lookups find it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = built(spark, sf_dir, (1.0,))[0]
    return _indexes[key]


def _shown(log: DataFrame) -> DataFrame:
    return log.select("out_idx", hashing.hex_lower(F.col("map_root")).alias("map_root"), F.split_part(F.decode("in_cp", "UTF-8"), F.lit("\n"), F.lit(2)).cast("long").alias("size"))


def output_log_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(built(spark, sf_dir)[0].output_log())


def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and size of the newest revision."""
    rows = _shown(built(spark, sf_dir)[0].output_log())
    return rows.select("out_idx", "size").orderBy(F.desc("out_idx")).limit(1)


def verified_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A present and an absent key, each response checked as a client does."""
    index, _ = built(spark, sf_dir)
    rows = []
    for key in ("click", "banana"):
        r = index.lookup(key)
        cp = verify_lookup_response(hashlib.sha256(key.encode()).digest(), r, SIGNER.verifier(), SIGNER.verifier(), ORIGIN)
        rows.append((key, len(r.index_value), cp.size))
    return spark.createDataFrame(rows, "key string, n long, size long")


def revision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recorded revision against a rebuild from the log; a last one with a wrong root must be told."""
    index, log = built(spark, sf_dir)
    recorded = [(parse_unverified(bytes(r.in_cp)).size, bytes(r.map_root)) for r in index.output_log().orderBy("out_idx").collect()]
    recorded.append((recorded[-1][0], bytes(32)))
    return spark.createDataFrame(map_audit(log, index.map_fn, recorded), "size long, same boolean")


def stream_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after a stream of the events has been drained: its commitments equal those of a batch build."""
    from ledgerlens.streaming.update import update_stream

    log = _events(spark, sf_dir)
    index = LogIndex(spark, scratch_path(spark, "streamed"), "before_colon", SIGNER, SIGNER.verifier(), ORIGIN)
    landing, offsets = scratch_path(spark, "landing"), scratch_path(spark, "offsets")
    n = log.count()
    for k in range(2):  # two halves in the order of the log, a run of the query after each
        part = log.where((F.col("idx") >= n * k // 2) & (F.col("idx") < n * (k + 1) // 2))
        part.repartitionByRange("idx").write.mode("append").parquet(landing)
        leaves = spark.readStream.schema("idx long, leaf binary").parquet(landing)
        update_stream(leaves, index, lambda size: signed_at(log, size), offsets).awaitTermination()
    m = index.manifest()
    return index.values(m).select(hashing.hex_lower(F.col("key_hash")).alias("key_hash"), "n", hashing.hex_lower(F.col("value_hash")).alias("value_hash"))


def der(tag: int, *parts: bytes) -> bytes:
    """A DER element."""
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def signed_part(names: list[str]) -> bytes:
    """The signed part of a small certificate with these DNS names."""
    alternative = der(0x30, *(der(0x82, n.encode()) for n in names))
    extension = der(0x30, certificates.ALTERNATIVE_NAMES, der(0x04, alternative))
    return der(0x30, der(0x02, b"\x01"), der(0x30), der(0xA3, der(0x30, extension)))


def log_leaf(names: list[str], pre: bool = False) -> bytes:
    """A certificate log leaf, of a certificate or of a pre-certificate."""
    body = signed_part(names) if pre else der(0x30, signed_part(names), der(0x30), der(0x03, b"\x00"))
    head = b"\x00\x00" + (12345678).to_bytes(8, "big") + (b"\x00\x01" + bytes(32) if pre else b"\x00\x00")
    return head + len(body).to_bytes(3, "big") + body


def _certificates(spark: SparkSession, sf_dir: str, leaf_of) -> DataFrame:
    """A log with a leaf for every page: ``leaf_of`` makes it of the page's number and its host, and a wildcard of that, as names."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")).alias("host"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [leaf_of(i, [h, f"*.{h}"]) for i, h in zip(batch["page_id"].to_pylist(), batch["host"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(out, pa.binary())], ["idx", "leaf"])

    return pages.mapInArrow(leaves, "idx long, leaf binary")


def _keys(log: DataFrame, map_fn) -> DataFrame:
    return log.select("idx", F.array_join(map_fn(F.col("leaf")), ",").alias("keys"))


def ct_dns_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a certificate log: certificates, pre-certificates (every third leaf) and cut-off ones (every tenth)."""
    leaf = lambda i, names: log_leaf(names, pre=i % 3 == 0)[: 40 if i % 10 == 9 else None]
    return _keys(_certificates(spark, sf_dir, leaf), mapfns.certificate_names)


def mtc_dns_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a Merkle tree certificate log: entries, entries of another type (every third) and malformed ones (every tenth)."""
    leaf = lambda i, names: b"\x00\x01invalid" if i % 10 == 9 else bytes([0, int(i % 3 != 0)]) + signed_part(names) + b"\x00"
    return _keys(_certificates(spark, sf_dir, leaf), mapfns.tree_certificate_names)


def _tiles_again(log: DataFrame, start: int, end: int) -> DataFrame:
    """The whole log written as tile files, and a range of it read again."""
    folder = scratch_path(log.sparkSession, "tiles")
    write_tiles(log, folder)
    again = read_tiles(log.sparkSession, folder, start, end)
    return again.select("idx", mapfns.text_of(F.col("leaf")).alias("leaf"))


def tiles_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written as tile files and read again, all of them, with the partial last bundle."""
    log = _events(spark, sf_dir)
    return _tiles_again(log, 0, log.count())


def sumdb_from_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module keys of a checksum log that is read from its tiles, through the proxy's form of their content."""
    from ledgerlens.operators.postings import posting_lists, postings
    from ledgerlens.queries import modules_log

    log = modules_log(spark, sf_dir)
    first, last = log.agg(F.min("idx"), F.max("idx")).first()
    folder = scratch_path(spark, "sumdb")
    write_tiles(log.select((F.col("idx") - first).alias("idx"), "leaf"), folder)
    again = read_tiles(spark, folder, 0, last - first + 1)
    lists = posting_lists(postings(again, mapfns.module_line))
    return lists.select(hashing.hex_lower(F.col("key_hash")).alias("key_hash"), F.size("idx").cast("long").alias("n"), F.array_join(F.transform("idx", lambda x: (x + first).cast("string")), ",").alias("idx"))


QUERIES = {
    f.__name__: f for f in (output_log_history, latest_revision, verified_lookup, revision_audit, stream_update, ct_dns_names, mtc_dns_names, tiles_roundtrip, sumdb_from_tiles)
}
