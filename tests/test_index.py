import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import mapfns
from ledgerlens.functions.notes import Ed25519Signer, parse_checkpoint, parse_unverified
from ledgerlens.operators import audit, dictionary, merkle, metrics
from ledgerlens.operators import postings as index
from ledgerlens.plans import index as plans
from ledgerlens.plans import manifest as manifests
from ledgerlens.plans.demo import ORIGIN, SIGNER, log_leaf, signed_at
from ledgerlens.plans.index import LogError, LogIndex, verify_lookup_response
from ledgerlens.sources import tables, tiles


def naive(leaves):
    """The root by the recursive definition."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    if len(leaves) == 1:
        return hashlib.sha256(b"\0" + leaves[0]).digest()
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return merkle.hash_nodes(naive(leaves[:k]), naive(leaves[k:]))


def log_of(spark, leaves):
    return spark.createDataFrame(list(enumerate(leaves)), "idx long, leaf binary")


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 513, 700])
def test_root_and_proofs(spark, n):
    leaves = [f"leaf {i}".encode() for i in range(n)]
    hashes = merkle.leaf_hashes(log_of(spark, leaves)).cache()
    nodes = merkle.complete_nodes(hashes, n).cache()
    root = merkle.joined(merkle.peaks(nodes, n))
    assert root == naive(leaves)
    rows = hashes.join(merkle.inclusion_proofs(hashes, nodes, n), "idx").cache()
    ok = lambda r: merkle.inclusion_verified(F.col("idx"), F.lit(n), F.col("hash"), F.col("proof"), F.lit(r))
    assert rows.where(ok(root)).count() == n and rows.where(ok(bytes(32))).count() == 0
    for r in rows.collect()[:: max(1, n // 20)]:
        proof = [bytes(p) for p in r.proof]
        assert plans.verify_inclusion(r.idx, n, bytes(r.hash), proof, root)
        assert not plans.verify_inclusion(r.idx, n, bytes(r.hash), [*proof, bytes(32)], root)


@pytest.mark.parametrize(("a", "b"), [(1, 2), (100, 300), (256, 511), (255, 258), (300, 900)])
def test_appended_peaks(spark, a, b):
    leaves = [str(i).encode() for i in range(b)]
    hashes = merkle.leaf_hashes(log_of(spark, leaves))
    old = merkle.peaks(merkle.complete_nodes(hashes.where(F.col("idx") < a), a), a)
    grown = merkle.appended(old, a, merkle.complete_nodes(hashes.where(F.col("idx") >= a), b), b)
    assert merkle.joined(grown) == naive(leaves)


def test_empty_tree():
    assert merkle.joined([]) == hashlib.sha256(b"").digest()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 300])
def test_dictionary(spark, n):
    key = lambda i: hashlib.sha256(str(i).encode()).digest()
    entries = spark.createDataFrame([(key(i), hashlib.sha256(b"v" + key(i)).digest()) for i in range(n)], "key_hash binary, value_hash binary")
    roots = dictionary.bucket_roots(entries, 3)
    root = dictionary.top_trie(roots).root()
    whole = sorted((bytes(r.key_hash), bytes(r.value_hash)) for r in entries.collect())
    assert root == dictionary.Trie([k for k, _ in whole], [dictionary.leaf_node(k, v) for k, v in whole]).root()
    asked = spark.createDataFrame([(key(i),) for i in range(n + 20)], "key_hash binary")
    values = dict(whole)
    for r in dictionary.proofs(entries, asked, roots, 3).collect():
        k = bytes(r.key_hash)
        proof = (r.found, r.other_key and bytes(r.other_key), r.other_value and bytes(r.other_value), list(r.depths), [bytes(s) for s in r.siblings])
        assert r.found == (k in values) and dictionary.verified(root, k, values.get(k), *proof)
        assert not dictionary.verified(bytes([root[0] ^ 1]) + root[1:], k, values.get(k), *proof)
        if r.found:
            assert not dictionary.verified(root, k, bytes(32), *proof) and not dictionary.verified(root, k, None, False, *proof[1:])


def test_postings_keep_repeats(spark):
    log = log_of(spark, [b"a,a,b: 1", b"empty: 2", b"b: 3"])
    rows = index.postings(log, mapfns.comma_list)
    lists = {bytes(r.key_hash): r.idx for r in index.posting_lists(rows).collect()}
    assert lists == {hashlib.sha256(b"a").digest(): [0, 0], hashlib.sha256(b"b").digest(): [0, 2]}


def filled(spark, path, leaves, cuts):
    log = log_of(spark, leaves)
    idx = LogIndex(spark, path, "before_colon", SIGNER, SIGNER.verifier(), ORIGIN)
    for n in cuts:
        idx.update(signed_at(log, n), lambda a, b: log.where((F.col("idx") >= a) & (F.col("idx") < b)))
    return idx, log


def response_for(idx, key):
    r = idx.lookup(key)
    return r, lambda x=r: verify_lookup_response(hashlib.sha256(key.encode()).digest(), x, SIGNER.verifier(), SIGNER.verifier(), ORIGIN)


def test_colon_log(spark, tmp_path):
    idx, log = filled(spark, str(tmp_path), [b"foo: 2", b"bar: 5", b"bar: 10", b"foo: 8"], [1, 4])
    for key, want in (("foo", [0, 3]), ("bar", [1, 2]), ("banana", [])):
        r, check = response_for(idx, key)
        assert r.index_value == want and check().size == 4
        with pytest.raises(LogError):
            verify_lookup_response(bytes(32), r, SIGNER.verifier(), SIGNER.verifier(), ORIGIN)
    r, check = response_for(idx, "foo")
    r.index_value = [0]
    with pytest.raises(LogError):
        check()
    assert '"index_value": [0]' in r.to_json()
    found = plans.dereference(log, spark.createDataFrame([(0,), (3,)], "idx long"), signed_at(log, 4)).orderBy("idx").collect()
    assert [(x.idx, bytes(x.leaf), x.verified) for x in found] == [(0, b"foo: 2", True), (3, b"foo: 8", True)]
    with pytest.raises(Exception):  # noqa: B017
        plans.dereference(log, spark.createDataFrame([(4,)], "idx long"), signed_at(log, 4)).collect()
    assert [x.out_idx for x in idx.output_log().orderBy("out_idx").collect()] == [0, 1]
    history = [(parse_unverified(bytes(x.in_cp)).size, bytes(x.map_root)) for x in idx.output_log().collect()]
    assert all(ok for _, ok in audit.map_audit(log, idx.map_fn, history))


def test_batches_do_not_matter(spark, tmp_path):
    rng = random.Random(3)
    leaves = [f"k{rng.randrange(40)}: {i}".encode() for i in range(600)]
    a, _ = filled(spark, str(tmp_path / "a"), leaves, [600])
    b, _ = filled(spark, str(tmp_path / "b"), leaves, [7, 256, 599, 600])
    assert a.manifest().map_root == b.manifest().map_root and b.manifest().epoch == 4
    # a reader of an earlier revision sees it unchanged
    assert [len(r.idx) for r in b.lookup_many(spark.createDataFrame([(hashlib.sha256(b"k1").digest(),)], "key_hash binary"), 2, proofs=False).collect()] == [sum(x.startswith(b"k1:") for x in leaves[:256])]


def test_lists_and_tables_of_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dictionary, "BUCKET", 8)
    idx, _ = filled(spark, str(tmp_path), [f"k{i % 60}: {i}".encode() for i in range(300)], [200, 300])
    m = idx.manifest()
    assert m.bits == 3 and m.keys == 60
    keys = [hashlib.sha256(k.encode()).digest() for k in ("k1", "k59", "none", "k1")]
    table = spark.createDataFrame([(k,) for k in keys], "key_hash binary")
    shown = lambda df: sorted((bytes(r.key_hash), r.idx, r.found, list(map(bytes, r.siblings))) for r in df.collect())
    found = shown(idx.lookup_many(keys))
    assert found == shown(idx.lookup_many(table)) and len(found) == 3
    assert {len(r[1]) for r in found} == {5, 0} and [bool(r[1]) for r in found] == [r[2] for r in found]
    for k in keys:
        first, after = dictionary.bucket_range(k, 3)
        assert first <= k and (after is None or k < after)
    for key in ("k1", "none"):
        assert response_for(idx, key)[1]().size == 300


def test_refusals(spark, tmp_path):
    leaves = [f"a: {i}".encode() for i in range(6)]
    idx, log = filled(spark, str(tmp_path), leaves, [4])
    between = lambda a, b: log.where((F.col("idx") >= a) & (F.col("idx") < b))
    assert idx.update(signed_at(log, 4), between) is None
    other = log_of(spark, [b"x: 1", *leaves[1:]])
    for cp, source in (
        (signed_at(log, 3), between),  # shrunk
        (signed_at(log, 6), lambda a, b: between(a, b - 1)),  # gap
        (signed_at(log, 6), lambda a, b: between(a, b).union(between(a, b))),  # repeated
        (signed_at(other, 6), between),  # another log
    ):
        with pytest.raises(LogError):
            idx.update(cp, source)
        assert idx.manifest().epoch == 1
    with pytest.raises(ValueError, match="built with"):
        LogIndex(spark, str(tmp_path), "comma_list", SIGNER, SIGNER.verifier(), ORIGIN)


def test_leftovers_of_a_failed_update(spark, tmp_path, monkeypatch):
    leaves = [f"a: {i}".encode() for i in range(6)]
    idx, log = filled(spark, str(tmp_path), leaves, [3])
    between = lambda a, b: log.where((F.col("idx") >= a) & (F.col("idx") < b))
    with monkeypatch.context() as m:
        m.setattr(manifests, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            idx.update(signed_at(log, 5), between)
    assert response_for(idx, "a")[0].index_value == [0, 1, 2]
    assert idx.update(signed_at(log, 6), between, batch_id=4).size == 6
    assert idx.update(signed_at(log, 6), between, batch_id=4) is None
    assert response_for(idx, "a")[0].index_value == list(range(6))


def test_tiles(spark, tmp_path):
    log = tables.synthetic_log(spark, 700)
    folder = tmp_path / "log"
    tiles.write_tiles(log, str(folder))
    (folder / "checkpoint").write_bytes(signed_at(log, 700))
    assert (folder / "tile/entries/002.p/188").exists()
    want = {r.idx: bytes(r.leaf) for r in log.collect()}
    found = {r.idx: bytes(r.leaf) for r in tiles.read_tiles(spark, f"file://{folder}", 200, 699).collect()}
    assert found == {i: want[i] for i in range(200, 699)}
    assert tiles.read_checkpoint(spark, f"file://{folder}") == (folder / "checkpoint").read_bytes()
    tiles.register(spark)
    source = spark.read.format("tlog_tiles").option("path", str(folder))
    assert {r.idx: bytes(r.leaf) for r in source.load().collect()} == want
    assert source.option("start", 10).option("end", 300).load().count() == 290
    assert tiles.unbundled(b"\0\1a\0\2b") == [b"a"]


def test_other_tiles_are_never_opened(spark, tmp_path):
    """A tile beside the range, longer than the reader takes, is no trouble; nor is one a thousand tiles on."""
    leaves = [b"a" * 40] * 256 + [b"b" * 4000] * 256
    tiles.write_tiles(log_of(spark, leaves), str(tmp_path))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100_000)
    try:
        assert tiles.read_tiles(spark, f"file://{tmp_path}", 0, 10).count() == 10
        with pytest.raises(Exception, match="maxLength|exceeds"):
            tiles.read_tiles(spark, f"file://{tmp_path}", 250, 260).count()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert tiles.read_tiles(spark, f"file://{tmp_path}", 5000, 6000).count() == 0
    assert tiles._patterns(998, 1001) == ["{998,999}", "{998,999}.p/*", "x001/{000,001}", "x001/{000,001}.p/*"]
    assert tiles._patterns(1_000_000, 1_000_999) == ["x001/x000/[0-9][0-9][0-9]", "x001/x000/[0-9][0-9][0-9].p/*"]


def test_source_options(spark, tmp_path):
    log, folder = tables.synthetic_log(spark, 300), str(tmp_path)
    tiles.write_tiles(log, f"file://{folder}")
    tiles.write_checkpoint(f"file://{folder}", signed_at(log, 300))
    tiles.register(spark)
    own = SIGNER.verifier()
    vkey = f"{own.name}+{own.key_hash.hex()}+{base64.b64encode(bytes([1]) + own.public).decode()}"
    source = lambda **options: spark.read.format("tlog_tiles").options(path=f"file://{folder}", **options).load()
    assert source(vkey=vkey).count() == source(vkey=vkey, origin=ORIGIN).count() == source(origin=ORIGIN).count() == 300
    other = Ed25519Signer("demo-log", bytes(32)).verifier()
    wrong = f"{other.name}+{other.key_hash.hex()}+{base64.b64encode(bytes([1]) + other.public).decode()}"
    for options in ({"vkey": wrong}, {"origin": "x"}, {"vkey": vkey, "origin": "x"}, {"form": "x"}):
        with pytest.raises(Exception, match="no valid signature|unexpected origin|unknown form"):
            source(**options).count()


def test_static_certificate_tiles_as_a_source(spark, tmp_path):
    """Data tiles of a static certificate log, in batch and as a stream."""
    leaves = [log_leaf([f"a{i}.example.org"]) for i in range(3)]
    records = b"".join(leaf[2:] + b"\0\0" + b"\0\0" for leaf in leaves)  # no extensions, no chain
    tiles._put(str(tmp_path), "tile/data/000.p/3", records)
    want = tiles.certificate_leaves(records)
    tiles.write_checkpoint(str(tmp_path), signed_at(log_of(spark, want), 3))
    tiles.register(spark)
    rows = spark.read.format("tlog_tiles").options(path=str(tmp_path), form="static_ct").load().orderBy("idx").collect()
    assert [bytes(r.leaf) for r in rows] == want
    stream = spark.readStream.format("tlog_tiles").options(path=str(tmp_path), form="static_ct").load()
    query = stream.writeStream.format("memory").queryName("certificates").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "offsets")).start()
    query.awaitTermination()
    assert spark.table("certificates").count() == 3


def test_compaction(spark, tmp_path):
    idx, log = filled(spark, str(tmp_path), [f"k{i % 9}: {i}".encode() for i in range(90)], [20, 50, 90])
    before, many = idx.manifest(), spark.createDataFrame([(hashlib.sha256(f"k{i}".encode()).digest(),) for i in range(10)], "key_hash binary")
    shown = lambda m: sorted((bytes(r.key_hash), r.idx) for r in idx.lookup_many(many, m and m.epoch, proofs=False).collect())
    want, values = shown(None), sorted(map(tuple, idx.values(before).collect()))
    after = idx.compact()
    assert [len(after.tables[t]) for t in ("postings", "values", "output")] == [1, 1, 1] and len(before.tables["postings"]) == 3
    assert idx.manifest() == after and shown(None) == want == shown(before) and sorted(map(tuple, idx.values(after).collect())) == values == sorted(map(tuple, idx.values(before).collect()))
    assert response_for(idx, "k3")[1]().size == 90
    assert idx.update(signed_at(log, 90), lambda a, b: log) is None


def test_two_writers(spark, tmp_path, monkeypatch):
    """Of two updates from one revision the first to commit counts, whole; the other is refused."""
    leaves = [f"a: {i}".encode() for i in range(8)]
    idx, log = filled(spark, str(tmp_path), leaves, [2])
    between = lambda a, b: log.where((F.col("idx") >= a) & (F.col("idx") < b))
    commit = manifests.commit

    def late(session, root, m):
        monkeypatch.setattr(manifests, "commit", commit)
        filled(session, root, leaves, [5])  # the other writer is done first
        commit(session, root, m)

    monkeypatch.setattr(manifests, "commit", late)
    with pytest.raises(RuntimeError, match="committed already"):
        idx.update(signed_at(log, 8), between)
    assert idx.manifest().size == 5 and response_for(idx, "a")[0].index_value == list(range(5))
    assert idx.update(signed_at(log, 8), between).size == 8 and response_for(idx, "a")[0].index_value == list(range(8))


def test_leaves_are_staged_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans, "MOST_LEAVES", 7)
    log, asked = log_of(spark, [f"a: {i}".encode() for i in range(20)]), []

    def leaves(a, b):
        asked.append((a, b))
        return log.where((F.col("idx") >= a) & (F.col("idx") < b))

    idx = LogIndex(spark, str(tmp_path), "before_colon", SIGNER, SIGNER.verifier(), ORIGIN)
    idx.update(signed_at(log, 20), leaves)
    assert asked == [(0, 7), (7, 14), (14, 20)] and idx.manifest().epoch == 1 and response_for(idx, "a")[0].index_value == list(range(20))


def test_functions_are_told_apart(spark, tmp_path):
    """An index refuses another function under the name of its own."""
    filled(spark, str(tmp_path), [b"a: 1"], [1])
    with pytest.raises(ValueError, match="built with"):
        LogIndex(spark, str(tmp_path), "before_colon", SIGNER, SIGNER.verifier(), ORIGIN, {"before_colon": mapfns.comma_list})
    for fn in mapfns.REGISTRY.values():
        assert mapfns.fingerprint(spark, fn) == mapfns.fingerprint(spark, fn)


def test_output_log_as_tiles(spark, tmp_path):
    idx, _ = filled(spark, str(tmp_path / "index"), [f"a: {i}".encode() for i in range(9)], [3, 6, 9])
    idx.export_output(str(tmp_path / "out"))
    cp = parse_checkpoint(tiles.read_checkpoint(spark, f"file://{tmp_path}/out"), SIGNER.verifier())
    rows = tiles.read_tiles(spark, f"file://{tmp_path}/out", 0, cp.size)
    assert cp.size == 3 and merkle.root(merkle.leaf_hashes(rows), 3) == cp.hash
    assert [bytes(r.leaf) for r in rows.orderBy("idx").collect()] == [bytes(r.leaf) for r in idx.output_log().orderBy("out_idx").collect()]


def test_hot_keys_are_hashed_as_they_stream(spark):
    """A list far longer than an Arrow batch, among short ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        log = spark.range(5000).select("id", F.when(F.col("id") % 50 == 0, F.concat(F.lit("k"), "id")).otherwise("hot").alias("k"))
        rows = log.select(F.unhex(F.sha2("k", 256)).alias("key_hash"), F.col("id").alias("idx"))
        found = {bytes(r.key_hash): (r.n, bytes(r.value_hash)) for r in index.value_hashes(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    digest = lambda ids: (len(ids), hashlib.sha256(b"".join(i.to_bytes(8, "big") for i in ids)).digest())
    want = {hashlib.sha256(f"k{i}".encode()).digest(): digest([i]) for i in range(0, 5000, 50)}
    assert found == want | {hashlib.sha256(b"hot").digest(): digest([i for i in range(5000) if i % 50])}


def test_duration_histograms(spark):
    reports = [{"durations": {"addBatch": 25, "walCommit": 5}}, {"durations": {"addBatch": 700_000}}]
    rows = metrics.duration_histograms(spark, reports).where("n > 0").collect()
    assert {(r.phase, r.upper): r.n for r in rows} == {("addBatch", 40): 1, ("addBatch", None): 1, ("walCommit", 10): 1}
    assert metrics.duration_histograms(spark, []).count() == 0


def test_stream_of_tiles(spark, tmp_path):
    from ledgerlens.streaming.update import update_stream

    log = tables.synthetic_log(spark, 600)
    folder = tmp_path / "log"
    tiles.register(spark)
    idx = LogIndex(spark, str(tmp_path / "index"), "before_colon", SIGNER, SIGNER.verifier(), ORIGIN)
    for n in (300, 600):
        tiles.write_tiles(log.where(F.col("idx") < n), str(folder))
        (folder / "checkpoint").write_bytes(signed_at(log, n))
        leaves = spark.readStream.format("tlog_tiles").option("path", str(folder)).load()
        update_stream(leaves, idx, lambda size: signed_at(log, size), str(tmp_path / "offsets")).awaitTermination()
        assert idx.manifest().size == n
    # a stream that lost its offsets starts from 0 and finds nothing new
    leaves = spark.readStream.format("tlog_tiles").option("path", str(folder)).load()
    update_stream(leaves, idx, lambda size: signed_at(log, size), str(tmp_path / "other")).awaitTermination()
    assert idx.manifest().epoch == 2
    both, _ = filled(spark, str(tmp_path / "batch"), [bytes(r.leaf) for r in log.orderBy("idx").collect()], [600])
    assert both.manifest().map_root == idx.manifest().map_root


def test_histogram(spark):
    counts = spark.createDataFrame([(1,), (2,), (0,)], "n long")
    assert [r.n for r in metrics.histogram(counts, F.col("n")).orderBy("bucket").collect()] == [1, 1, 1] + [0] * 10


def test_numbered_log(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    found = tables.numbered_log(df, F.col("k").cast("string"), ["k"]).orderBy("idx").collect()
    assert [(r.idx, bytes(r.leaf)) for r in found] == [(i, str(i).encode()) for i in range(1000)]


@pytest.mark.parametrize(("content", "size", "want"), [("", 0, []), ("0\n1\n2\n", 2, ["0", "1"]), ("0\n2\n5 xxab", 3, ["0", "2"]), ("1\n2 fdfxx", 9, ["1"]), ("1\n2\n\n", 9, None), ("1\n2\n3", 9, ["1", "2"])])
def test_repaired_text(spark, content, size, want):
    parts = content.split("\n")
    rows = [(i, p, i + 1 < len(parts)) for i, p in enumerate(parts) if p or i + 1 < len(parts)]
    df = tables.repaired_text(spark.createDataFrame(rows, "line long, value string, ended boolean"), size)
    if want is None:
        with pytest.raises(Exception):  # noqa: B017
            df.collect()
    else:
        assert [r.value for r in df.orderBy("line").collect()] == want


def test_report(spark):
    versions = spark.createDataFrame([("v1.0.0", 1, "m", "z"), ("v1.1.0", 2, "m", "z"), ("v1.2.0", 3, "m", "z"), ("v1.3.0", 4, "m", "z")], "version string, idx long, mod_hash string, zip_hash string")
    tags = spark.createDataFrame([("v1.0.0", "m", "z"), ("v1.1.0", "m", "y"), ("v1.2.0", "", "z"), ("v2.0.0", "m", "z")], "version string, tag_mod_hash string, tag_zip_hash string")
    rows = {r.version: (r.found, r.mod, r.zip) for r in audit.version_report(versions, tags).collect()}
    assert rows == {"v1.0.0": ("✅", "✅", "✅"), "v1.1.0": ("✅", "✅", "❌"), "v1.2.0": ("✅", "⚠️", "⚠️"), "v1.3.0": ("❌", "⚠️", "⚠️")}
    assert {r.version: r.errors for r in audit.version_errors(audit.version_report(versions, tags)).collect()} == {"v1.1.0": ["archive differs"], "v1.3.0": ["no tag"]}
    assert [r.version for r in audit.tags_missing_from_log(versions, tags).collect()] == ["v2.0.0"]
    assert audit.duplicate_versions(versions.union(versions.limit(1))).count() == 1


def test_directory_hash(spark):
    files = spark.createDataFrame([("m", "b", b"2"), ("m", "a", b"1")], "dir string, name string, content binary")
    text = "".join(f"{hashlib.sha256(c).hexdigest()}  {n}\n" for n, c in (("a", b"1"), ("b", b"2")))
    want = "h1:" + base64.b64encode(hashlib.sha256(text.encode()).digest()).decode()
    assert audit.directory_hash(files).first().hash == want
