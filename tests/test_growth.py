"""Faults that only larger tables, or other plans than the small ones get, bring out."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import mapfns
from ledgerlens.operators import audit, merkle
from ledgerlens.operators import postings as index


@pytest.fixture
def joins_turn_broadcast(spark):
    """Joins that are planned with a shuffle of both sides and become broadcast joins as they run, as on tables of some size."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_one_commitment_a_key_above_a_join(spark, joins_turn_broadcast, tmp_path):
    key = lambda i: hashlib.sha256(bytes([i % 3])).digest()
    spark.createDataFrame([(key(i), i) for i in range(600)], "key_hash binary, idx long").repartition(4).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    found = index.value_hashes(rows.join(rows.where("idx >= 500").select("key_hash").distinct(), "key_hash", "left_semi")).collect()
    expected = {key(i): (200, hashlib.sha256(b"".join(x.to_bytes(8, "big") for x in range(i, 600, 3))).digest()) for i in range(3)}
    assert len(found) == 3 and {bytes(r.key_hash): (r.n, bytes(r.value_hash)) for r in found} == expected


def test_claims_are_checked_at_their_tiles(spark):
    """The same answers as from proofs that are moved, for repeated, absent and wrong claims, and in a plan that makes no row a level."""
    n = 256 * 3 + 77
    hashes = merkle.leaf_hashes(spark.range(n).select(F.col("id").alias("idx"), F.encode(F.col("id").cast("string"), "UTF-8").alias("leaf"))).cache()
    nodes = merkle.complete_nodes(hashes, n).cache()
    root = merkle.joined(merkle.peaks(nodes, n))
    asked = hashes.union(hashes.where("idx = 5")).union(hashes.where("idx = 700").select(F.lit(n + 3), "hash")).withColumn("hash", F.when(F.col("idx") == 9, F.lit(bytes(32))).otherwise(F.col("hash")))
    checked = merkle.checked(asked, nodes, n, root, {"moved": lambda idx, leaf: (idx ^ 1, leaf)})
    assert sorted(map(tuple, checked.collect())) == [(i, i != 9, False) for i in range(n)]
    assert "Generate" not in checked._jdf.queryExecution().toString()
    proofs = {r.idx: [bytes(p) for p in r.proof] for r in merkle.inclusion_proofs(hashes.where("idx % 5 = 0"), nodes, n).collect()}
    own = {r.idx: bytes(r.hash) for r in hashes.collect()}
    assert sorted(proofs) == list(range(0, n, 5)) and all(merkle.verify_inclusion(i, n, own[i], p, root) for i, p in proofs.items())


def test_a_batch_of_many_tiles_is_worked_on_in_parts():
    """10,000 tiles come in one Arrow batch; what they give leaves in batches of 64."""
    batch = pa.RecordBatch.from_pydict({"tile": list(range(200)), "first": [0] * 200, "hashes": [[bytes(32)] * 256] * 200})
    found = list(merkle._above(iter([batch])))
    assert [b.num_rows for b in found] == [64 * 255] * 3 + [8 * 255]


def test_an_audit_rebuilds_a_size_once(spark, monkeypatch):
    log = spark.range(40).select(F.col("id").alias("idx"), F.encode(F.concat((F.col("id") % 3).cast("string"), F.lit(": x")), "UTF-8").alias("leaf"))
    calls, real = [], audit.map_root
    monkeypatch.setattr(audit, "map_root", lambda entries: calls.append(1) or real(entries))
    (_, _), (_, _) = audit.map_audit(log, mapfns.before_colon, [(40, bytes(32)), (40, bytes(31) + b"x")])
    assert len(calls) == 1
    root = real(index.value_hashes(index.postings(log, mapfns.before_colon)).select("key_hash", "value_hash"))
    assert audit.map_audit(log, mapfns.before_colon, [(40, root), (40, bytes(32)), (20, root)]) == [(40, True), (40, False), (20, False)]
