"""The engine's queries over the driver's tables, which stand in for logs, with their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import codec, hashing, mapfns
from ledgerlens.operators import audit, dictionary, merkle, metrics
from ledgerlens.operators import postings as index
from ledgerlens.scratch import scratch_path
from ledgerlens.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
#: Event types that the lookups ask for; the second is in no log.
PRESENT, ABSENT = "click", "banana"
KEY_WANTED = ("click", "view", "purchase", "banana")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_leaf() -> Column:
    return F.concat(F.col("event_type"), F.lit(": "), F.col("event_id").cast("string"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_log(_table(spark, sf_dir, "events"), event_leaf(), F.col("event_id"))


def events_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(events_log(spark, sf_dir), mapfns.before_colon)


def _shown(lists: DataFrame) -> DataFrame:
    """Posting lists as text, so that results compare by value."""
    return lists.select(hashing.hex_lower(F.col("key_hash")).alias("key_hash"), F.size("idx").cast("long").alias("n"), F.array_join(F.transform("idx", lambda x: x.cast("string")), ",").alias("idx"))


def scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark, sf_dir).where((F.col("idx") >= 300) & (F.col("idx") < 1300)).select("idx", mapfns.text_of(F.col("leaf")).alias("leaf"))


def leaf_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.leaf_hashes(events_log(spark, sf_dir)).select("idx", hashing.hex_lower(F.col("hash")).alias("hash"))


def tile_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = merkle.tile_roots(merkle.leaf_hashes(events_log(spark, sf_dir)))
    return roots.select("tile", F.col("n").cast("long").alias("n"), hashing.hex_lower(F.col("root")).alias("root"))


def _size(spark: SparkSession, sf_dir: str) -> int:
    return _table(spark, sf_dir, "events").count()


def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _size(spark, sf_dir)
    return spark.createDataFrame([(n, merkle.root(merkle.leaf_hashes(events_log(spark, sf_dir)), n).hex())], "size long, root string")


def compact_range_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _size(spark, sf_dir)
    nodes = merkle.complete_nodes(merkle.leaf_hashes(events_log(spark, sf_dir)), n, scratch_path(spark, "nodes"))
    rows = [(k, level, h.hex()) for k, ((level, _), h) in enumerate(zip(merkle.peak_places(n), merkle.peaks(nodes, n), strict=True))]
    return spark.createDataFrame(rows, "peak long, level long, hash string")


def mapfn_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_postings(spark, sf_dir).select(hashing.hex_lower(F.col("key_hash")).alias("key_hash"), "idx", F.col("ord").cast("long").alias("ord"))


def mapfn_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.table_log(_table(spark, sf_dir, "events"), F.col("props"), F.col("event_id"))
    return _shown(index.posting_lists(index.postings(log, mapfns.json_field("k"))))


def mapfn_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("event_id") % 7 == 0, F.lit("empty")).otherwise(F.concat(F.col("event_type"), F.lit(",u"), F.col("user_id").cast("string")))
    log = tables.table_log(_table(spark, sf_dir, "events"), F.concat(names, F.lit(": 1")), F.col("event_id"))
    return _shown(index.posting_lists(index.postings(log, mapfns.comma_list)))


def module_leaf() -> Column:
    """Two-line module leaves out of ``part``: some versions are pseudo-versions."""
    version = F.concat(F.lit("v1."), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"))
    pseudo = F.concat(F.lit("v0.0.0-20240222160914-"), F.substring(F.sha2(F.col("p_name"), 256), 1, 12))
    version = F.when(F.col("p_partkey") % 5 == 0, pseudo).when(F.col("p_partkey") % 7 == 0, F.concat(version, F.lit("-rc1"))).otherwise(version)
    module = F.concat(F.lit("example.org/"), F.translate(F.col("p_brand"), "#", "-"))
    h = lambda salt: F.concat(F.lit(" h1:"), F.substring(F.sha2(F.concat(F.col("p_name"), F.lit(salt)), 256), 1, 43), F.lit("="))
    return F.concat(module, F.lit(" "), version, h("zip"), F.lit("\n"), module, F.lit(" "), version, F.lit("/go.mod"), h("mod"), F.lit("\n"))


def modules_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").withColumn("p_brand", F.translate("p_brand", " ", "-"))
    return tables.table_log(part, module_leaf(), F.col("p_partkey"))


def mapfn_module_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(index.posting_lists(index.postings(modules_log(spark, sf_dir), mapfns.module_line)))


def _pages_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(tables.table_log(_table(spark, sf_dir, "pages"), F.col("url"), F.col("page_id")), mapfns.url_hosts)


def domain_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(index.posting_lists(_pages_postings(spark, sf_dir)))


def wal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.text_rows(events_postings(spark, sf_dir))


def wal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = tables.from_text(wal_rows(spark, sf_dir))
    return again.select(hashing.hex_lower(F.col("key_hash")).alias("key_hash"), "idx", F.col("ord").cast("long").alias("ord"))


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(index.posting_lists(events_postings(spark, sf_dir)))


def _hashes(rows: DataFrame) -> DataFrame:
    return index.value_hashes(rows).select(hashing.hex_lower(F.col("key_hash")).alias("key_hash"), "n", hashing.hex_lower(F.col("value_hash")).alias("value_hash"))


def value_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashes(events_postings(spark, sf_dir))


def _column_log(spark: SparkSession, sf_dir: str, name: str, key: str, idx: Column) -> DataFrame:
    return tables.table_log(_table(spark, sf_dir, name), F.concat(F.col(key).cast("string"), F.lit(": 1")), idx)


def index_orders_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashes(index.postings(_column_log(spark, sf_dir, "orders", "o_custkey", F.col("o_orderkey")), mapfns.before_colon))


def index_lineitem_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _column_log(spark, sf_dir, "lineitem", "l_partkey", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return _hashes(index.postings(log, mapfns.before_colon))


def chunked_commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.chunked_value_hashes(events_postings(spark, sf_dir))
    return found.select(hashing.hex_lower(F.col("key_hash")).alias("key_hash"), "n", hashing.hex_lower(F.col("value_hash")).alias("value_hash"))


def _found(spark: SparkSession, sf_dir: str, keys: tuple[str, ...]) -> DataFrame:
    """(key, idx): lists of stated keys, read from the index of the events; an absent key has an empty one."""
    from ledgerlens.plans.demo import events_index

    asked = spark.createDataFrame([(k, hashlib.sha256(k.encode()).digest()) for k in keys], "key string, key_hash binary")
    found = events_index(spark, sf_dir).lookup_many([hashlib.sha256(k.encode()).digest() for k in keys], proofs=False)
    return asked.join(F.broadcast(found), "key_hash").select("key", "idx")  # a row a stated key


def _answer(found: DataFrame) -> DataFrame:
    return found.select("key", F.size("idx").cast("long").alias("n"), F.array_join(F.transform("idx", lambda x: x.cast("string")), ",").alias("idx"))


def lookup_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(_found(spark, sf_dir, (PRESENT,)))


def lookup_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(_found(spark, sf_dir, (ABSENT,)))


def lookup_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(_found(spark, sf_dir, KEY_WANTED))


def lookup_at_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(_found(spark, sf_dir, KEY_WANTED).withColumn("idx", index.below(F.col("idx"), 777)))


def lookup_at_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists as they were when the log had nine tenths of its size."""
    return _answer(_found(spark, sf_dir, KEY_WANTED).withColumn("idx", index.below(F.col("idx"), _size(spark, sf_dir) * 9 // 10)))


def lookup_min_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(_found(spark, sf_dir, KEY_WANTED).withColumn("idx", index.from_index(F.col("idx"), 400)))


def lookup_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir, KEY_WANTED)
    return _answer(found.withColumn("idx", index.delta(F.col("idx"), 25)))


def dereference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the positions of one key, each with its inclusion verified."""
    n, log = _size(spark, sf_dir), events_log(spark, sf_dir)
    hashes = merkle.leaf_hashes(log)
    nodes = merkle.complete_nodes(hashes, n, scratch_path(spark, "nodes"))
    root = merkle.joined(merkle.peaks(nodes, n))
    positions = _found(spark, sf_dir, (PRESENT,)).select(F.explode("idx").alias("idx"))
    rows = positions.join(log, "idx")
    return rows.join(merkle.checked(merkle.leaf_hashes(rows), nodes, n, root), "idx").select("idx", mapfns.text_of(F.col("leaf")).alias("leaf"), "verified")


def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commitments after three batches, each taken by touched keys only."""
    rows, n = events_postings(spark, sf_dir), _size(spark, sf_dir)
    cuts = [0, n // 2, n * 9 // 10, n]
    part = [rows.where((F.col("idx") >= a) & (F.col("idx") < b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    known, seen = index.value_hashes(part[0]), part[0]
    for new in part[1:]:
        known, seen = index.touched_value_hashes(known, seen, new), seen.unionByName(new)
    return known.select(hashing.hex_lower(F.col("key_hash")).alias("key_hash"), "n", hashing.hex_lower(F.col("value_hash")).alias("value_hash"))


def map_fn_keys_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.table_log(_table(spark, sf_dir, "pages"), F.col("url"), F.col("page_id"))
    counts = log.select(F.size(mapfns.url_hosts(F.col("leaf"))).alias("keys"))
    return metrics.histogram(counts, F.col("keys")).select(F.col("bucket").cast("long").alias("bucket"), F.col("upper").cast("long").alias("upper"), F.col("n").cast("long").alias("n"))


#: The module that one audit looks at, and what tells versions of all modules apart.
MODULE, BY_MODULE = "example.org/Brand-13", ("module", "version")


def _versions(spark: SparkSession, sf_dir: str, module: str | None = MODULE) -> DataFrame:
    """Versions of one module, or of all."""
    lines = modules_log(spark, sf_dir).select("idx", F.inline(codec.module_lines(mapfns.text_of(F.col("leaf")))))
    return lines if module is None else lines.where(F.col("module") == module)


def _tags(spark: SparkSession, sf_dir: str, module: str | None = MODULE) -> DataFrame:
    """An outside list made from the log: some versions are not in it, some have no module file, some hashes differ, one of each module is new."""
    v, k = _versions(spark, sf_dir, module), F.col("idx")
    known = v.where(k % 3 != 0).select(
        "module", "version", F.when(k % 4 == 0, F.lit("")).otherwise(F.col("mod_hash")).alias("tag_mod_hash"), F.when(k % 11 == 0, F.lit("h1:other")).otherwise(F.col("zip_hash")).alias("tag_zip_hash")
    )
    new = spark.createDataFrame([("v9.9.9", "h1:a", "h1:b")], "version string, tag_mod_hash string, tag_zip_hash string")
    modules = spark.createDataFrame([(module,)], "module string") if module else v.select("module").distinct()
    return known.unionByName(modules.crossJoin(F.broadcast(new)))


def version_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.version_report(_versions(spark, sf_dir), _tags(spark, sf_dir))


def tags_missing_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.tags_missing_from_log(_versions(spark, sf_dir), _tags(spark, sf_dir))


def version_audit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every module."""
    return audit.version_report(_versions(spark, sf_dir, None), _tags(spark, sf_dir, None), BY_MODULE)


def tags_missing_from_log_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.tags_missing_from_log(_versions(spark, sf_dir, None), _tags(spark, sf_dir, None), BY_MODULE)


def _orders_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c, m: (F.col(c) % m).cast("string")
    pre = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("-rc."), number("o_orderkey", 12))).otherwise(F.lit(""))
    return _table(spark, sf_dir, "orders").select(F.concat(F.lit("v"), number("o_custkey", 3), F.lit("."), number("o_orderkey", 11), F.lit("."), number("o_custkey", 13), pre).alias("version"))


def duplicate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_versions(_orders_versions(spark, sf_dir))


def semver_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct versions with their place in the order of versions."""
    from pyspark.sql import Window

    distinct = _orders_versions(spark, sf_dir).distinct()  # at most 3 x 11 x 13 x 13 of them
    return distinct.select("version", F.row_number().over(Window.orderBy(audit.semver_key(F.col("version")))).cast("long").alias("place"))


def tile_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return events.select("event_id", codec.tile_path(F.col("event_id") * 1237, F.col("event_id") % 256).alias("path"))


def last_tile_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _size(spark, sf_dir)
    return events_log(spark, sf_dir).where(F.col("idx") >= (n - 1) // codec.TILE * codec.TILE).select("idx", mapfns.text_of(F.col("leaf")).alias("leaf")).orderBy(F.desc("idx"))


def jump_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir).where((F.col("idx") >= 512) & (F.col("idx") < 768))
    return log.select("idx", F.floor(F.col("idx") / codec.TILE).cast("long").alias("tile"), (F.col("idx") == 700).alias("wanted"))


def entry_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", codec.preview(F.col("text")).alias("p")).select("doc_id", "p.*")


def proxy_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", codec.tile_path(F.col("event_id")).alias("t"))
    kinds = F.array(F.lit("/checkpoint"), F.concat(F.lit("/tile/entries/"), "t"), F.concat(F.lit("/tile/0/"), "t"), F.lit("/other"))
    own = e.select("event_id", F.concat(F.lit("/log"), F.get(kinds, (F.col("event_id") % 4).cast("int"))).alias("path"))
    return own.select("event_id", codec.rewritten_path(F.col("path"), "/log").alias("path"))


def bundle_reframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.col("event_type"), F.lit("\n"), F.col("event_type"), F.lit("1\n\n"), F.col("user_id").cast("string"), F.lit("\n"))
    records = codec.framed(codec.data_tile_records(body))
    return _table(spark, sf_dir, "events").select("event_id", hashing.hex_lower(records).alias("framed"))


def checkpoint_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("origin/"), F.col("event_type"), F.lit("\n"), F.col("event_id").cast("string"), F.lit("\n"), F.base64(F.unhex(F.sha2(F.col("event_type"), 256))), F.lit("\n\n— sig\n"))
    own = _table(spark, sf_dir, "events").select("event_id", codec.checkpoint_parsed(text).alias("c"))
    return own.select("event_id", "c.origin", "c.size", hashing.hex_lower(F.col("c.hash")).alias("hash"))


def output_leaf_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = codec.output_leaf(hashing.key_hash(F.col("event_type")), F.encode(F.concat(F.lit("cp "), F.col("event_id").cast("string")), "UTF-8"))
    own = _table(spark, sf_dir, "events").select("event_id", codec.output_leaf_parsed(leaf).alias("p"))
    return own.select("event_id", hashing.hex_lower(F.col("p.map_root")).alias("map_root"), F.decode("p.checkpoint", "UTF-8").alias("checkpoint"))


def directory_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash over all documents of each source, as over the files of a directory."""
    files = _table(spark, sf_dir, "documents").select(F.col("source").alias("dir"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), F.encode("text", "UTF-8").alias("content"))
    return audit.directory_hash(files)


def map_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary's root over the index of orders by customer."""
    rows = index.postings(_column_log(spark, sf_dir, "orders", "o_custkey", F.col("o_orderkey")), mapfns.before_colon)
    root = dictionary.map_root(index.value_hashes(rows).select("key_hash", "value_hash"))
    return spark.createDataFrame([(root.hex(),)], "root string")


def trie_proof_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present and absent customers with their proofs checked."""
    entries = index.value_hashes(index.postings(_column_log(spark, sf_dir, "orders", "o_custkey", F.col("o_orderkey")), mapfns.before_colon))
    entries, bits = entries.select("key_hash", "value_hash"), 4
    roots = dictionary.bucket_roots(entries, bits)
    root = dictionary.top_trie(roots).root()
    asked = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), hashing.key_hash(F.col("c_custkey").cast("string")).alias("key_hash"))
    found = dictionary.proofs(entries, asked, roots, bits).join(entries, "key_hash", "left").join(asked, "key_hash")

    def check(batches):
        import pyarrow as pa

        for b in batches:
            rows = b.select(["key_hash", "value_hash", "found", "other_key", "other_value", "depths", "siblings"]).to_pylist()
            ok = [dictionary.verified(root, *row.values()) for row in rows]
            # the same proofs for another value, for the opposite claim, and under another root: none may hold
            other = lambda r: r | {"value_hash": bytes(32), "found": True}
            denied = lambda r: r | {"value_hash": None if r["found"] else bytes(32), "found": not r["found"]}
            forged = [any((dictionary.verified(root, *other(r).values()), dictionary.verified(root, *denied(r).values()), dictionary.verified(bytes(32), *r.values()))) for r in rows]
            yield pa.RecordBatch.from_arrays([b["key"], b["found"], pa.array(ok), pa.array(forged)], ["key", "found", "verified", "forged"])

    return found.mapInArrow(check, "key long, found boolean, verified boolean, forged boolean")


def inclusion_proof_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of the log proved and checked against the root; the same proof for another leaf or position may not hold."""
    n, hashes = _size(spark, sf_dir), merkle.leaf_hashes(events_log(spark, sf_dir))
    nodes = merkle.complete_nodes(hashes, n, scratch_path(spark, "nodes"))
    root = merkle.joined(merkle.peaks(nodes, n))
    others = {"forged": lambda idx, leaf: (idx, bytes(32)), "moved": lambda idx, leaf: (idx ^ 1, leaf)}
    return merkle.checked(hashes, nodes, n, root, others)


def queries() -> dict[str, Query]:
    own = (
        scan_range, leaf_hashes, tile_roots, merkle_root, compact_range_peaks, mapfn_delimited, mapfn_json_field, mapfn_multi_key, mapfn_module_line,
        domain_keys, wal_rows, wal_roundtrip, index_build, value_hashes, index_orders_by_customer, index_lineitem_by_part, chunked_commitments, lookup_present,
        lookup_absent, lookup_many, lookup_at_size, lookup_at_share, lookup_min_idx, lookup_delta, dereference, incremental_equals_full, map_fn_keys_histogram,
        version_audit, tags_missing_from_log, version_audit_all, tags_missing_from_log_all, duplicate_versions, semver_order, tile_paths, last_tile_page, jump_to_index, entry_preview, proxy_rewrite,
        bundle_reframe, checkpoint_parse, output_leaf_codec, directory_hashes, map_root, trie_proof_verify, inclusion_proof_verify,
    )
    from ledgerlens.plans.demo import QUERIES

    named = {f.__name__: f for f in own} | QUERIES
    # names of the time when the first form covered a part of the log
    return named | {"inclusion_proof_verify_all": inclusion_proof_verify, "tiles_roundtrip_all": QUERIES["tiles_roundtrip"]}


def oracle_sql() -> dict[str, str]:
    from ledgerlens.oracle import SQL

    return dict(SQL)
