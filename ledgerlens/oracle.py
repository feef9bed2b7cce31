"""SQL of the registered queries, in DuckDB's dialect."""

from __future__ import annotations

_LOG = "log AS (SELECT event_id AS idx, event_type || ': ' || event_id AS leaf, event_type AS key, event_id FROM events)"
_HEX64 = "printf('%016x', {})"


def _value_hash(idx: str, by: str) -> str:
    return f"sha256(unhex(string_agg(printf('%016X', {idx}), '' ORDER BY {idx}))) AS {by}"


def _lists(source: str) -> str:
    """key_hash, n, idx of a relation (key, idx)."""
    return f"SELECT sha256(key) AS key_hash, count(*) AS n, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS idx FROM ({source}) GROUP BY key"


def _commitments(source: str) -> str:
    return f"SELECT sha256(key) AS key_hash, count(*) AS n, {_value_hash('idx', 'value_hash')} FROM ({source}) GROUP BY key"


_LEAVES = "SELECT event_id AS pos, unhex(sha256('\\x00'::BLOB || encode(event_type || ': ' || event_id))) AS h FROM events"
#: Nodes of every level, an odd last one moved up unchanged; ``part`` keeps trees apart.
_LEVELS = """nodes AS (
  SELECT part, 0 AS lvl, pos, h FROM base
  UNION ALL
  SELECT a.part, a.lvl + 1, a.pos // 2, CASE WHEN a.r IS NULL THEN a.h ELSE unhex(sha256('\\x01'::BLOB || a.h || a.r)) END
  FROM (SELECT part, lvl, pos, h, lead(h) OVER (PARTITION BY part ORDER BY pos) AS r, count(*) OVER (PARTITION BY part) AS n FROM nodes) a
  WHERE a.n > 1 AND a.pos % 2 = 0)"""

_KEYS = "(VALUES ('click'), ('view'), ('purchase'), ('banana')) AS k(key)"


def _lookup(keys: str, where: str = "TRUE", skip: int = 0) -> str:
    rows = f"SELECT event_type AS key, event_id AS idx, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events WHERE {where}"
    return f"SELECT k.key, count(e.idx) AS n, coalesce(string_agg(e.idx::VARCHAR, ',' ORDER BY e.idx), '') AS idx FROM {keys} LEFT JOIN (SELECT * FROM ({rows}) WHERE r > {skip}) e ON e.key = k.key GROUP BY k.key"


_MODULE = """m AS (SELECT p_partkey AS idx, 'example.org/' || translate(translate(p_brand, ' ', '-'), '#', '-') AS module,
  CASE WHEN p_partkey % 5 = 0 THEN 'v0.0.0-20240222160914-' || substr(sha256(p_name), 1, 12)
       WHEN p_partkey % 7 = 0 THEN 'v1.' || p_size || '.' || p_partkey || '-rc1' ELSE 'v1.' || p_size || '.' || p_partkey END AS version,
  'h1:' || substr(sha256(p_name || 'zip'), 1, 43) || '=' AS zip_hash, 'h1:' || substr(sha256(p_name || 'mod'), 1, 43) || '=' AS mod_hash FROM part)"""
_VERSIONS = f"WITH {_MODULE}, v AS (SELECT * FROM m WHERE module = 'example.org/Brand-13')"
_TAGS = """t AS (SELECT version, CASE WHEN idx % 4 = 0 THEN '' ELSE mod_hash END AS tag_mod_hash, CASE WHEN idx % 11 = 0 THEN 'h1:other' ELSE zip_hash END AS tag_zip_hash
  FROM v WHERE idx % 3 <> 0 UNION ALL SELECT 'v9.9.9', 'h1:a', 'h1:b')"""
_ORDER_VERSIONS = "SELECT 'v' || (o_custkey % 3) || '.' || (o_orderkey % 11) || '.' || (o_custkey % 13) || CASE WHEN o_orderkey % 3 = 0 THEN '-rc.' || (o_orderkey % 12) ELSE '' END AS version, o_custkey % 3 AS a, o_orderkey % 11 AS b, o_custkey % 13 AS c, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 12 END AS rc FROM orders"
_HOSTS = "h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages), p AS (SELECT page_id, string_split(host, '.') AS parts FROM h WHERE host <> '')"
_SUFFIX = "array_to_string(parts[i:], '.')"
_PATH = "CASE WHEN {0} >= 1000000000 THEN 'x' || printf('%03d', {0} // 1000000000 % 1000) || '/' ELSE '' END || CASE WHEN {0} >= 1000000 THEN 'x' || printf('%03d', {0} // 1000000 % 1000) || '/' ELSE '' END || CASE WHEN {0} >= 1000 THEN 'x' || printf('%03d', {0} // 1000 % 1000) || '/' ELSE '' END || printf('%03d', {0} % 1000)"
_BOUNDS = "[0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]"
_DEREF = "SELECT event_id AS idx, event_type || ': ' || event_id AS leaf, TRUE AS verified FROM events WHERE event_type = 'click'"
_TWO_LABELS = "CASE WHEN array_to_string(parts[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'me.uk', 'net.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'ne.jp', 'or.jp', 'co.nz', 'com.br', 'com.cn', 'co.in', 'co.za') THEN 2 ELSE 1 END"


def _certificate_keys(none: str) -> str:
    """Keys of a leaf with the page's host and a wildcard of it as names."""
    keys = f"SELECT page_id, string_agg(DISTINCT {_SUFFIX}, ',' ORDER BY {_SUFFIX}) AS keys FROM p, range(1, 20) r(i) WHERE i <= greatest(1, len(parts) - {_TWO_LABELS}) GROUP BY page_id"
    return f"WITH {_HOSTS}, k AS ({keys}) SELECT pages.page_id AS idx, CASE WHEN {none} THEN '' ELSE coalesce(k.keys, '') END AS keys FROM pages LEFT JOIN k ON k.page_id = pages.page_id"


def _map_roots(postings: str) -> str:
    """(part, root) of a relation (part, key, idx): the leaves by the first 64 bits of their keys, then bit by bit the branches above them."""
    return f"""entries AS (SELECT part, unhex(sha256(key)) AS k, unhex(sha256(unhex(string_agg(printf('%016X', idx), '' ORDER BY idx)))) AS v FROM ({postings}) GROUP BY part, key),
t AS (
  SELECT part, 64 AS depth, left((k::BIT)::VARCHAR, 64) AS pre, unhex(sha256('\\x10'::BLOB || k || v)) AS h FROM entries
  UNION ALL
  SELECT part, depth - 1, left(pre, depth - 1), CASE WHEN n = 2 THEN unhex(sha256('\\x11'::BLOB || unhex(printf('%04x', depth - 1)) || h || r)) ELSE h END
  FROM (SELECT *, lead(h) OVER w AS r, count(*) OVER (PARTITION BY part, left(pre, depth - 1)) AS n, row_number() OVER w AS i FROM t WINDOW w AS (PARTITION BY part, left(pre, depth - 1) ORDER BY pre))
  WHERE i = 1 AND depth > 0)"""


_ALL_TAGS = """t AS (SELECT module, version, CASE WHEN idx % 4 = 0 THEN '' ELSE mod_hash END AS tag_mod_hash, CASE WHEN idx % 11 = 0 THEN 'h1:other' ELSE zip_hash END AS tag_zip_hash
  FROM m WHERE idx % 3 <> 0 UNION ALL SELECT DISTINCT module, 'v9.9.9', 'h1:a', 'h1:b' FROM m)"""
_INCLUSION = "SELECT event_id AS idx, TRUE AS verified, FALSE AS forged, FALSE AS moved FROM events"
_EVENT_LISTS = "SELECT event_type AS key, event_id AS idx FROM events"

SQL: dict[str, str] = {
    "scan_range": f"WITH {_LOG} SELECT idx, leaf FROM log WHERE idx >= 300 AND idx < 1300",
    "leaf_hashes": "SELECT event_id AS idx, sha256('\\x00'::BLOB || encode(event_type || ': ' || event_id)) AS hash FROM events",
    "tile_roots": f"WITH RECURSIVE base AS (SELECT pos // 256 AS part, pos % 256 AS pos, h FROM ({_LEAVES})), {_LEVELS}, top AS (SELECT part, max(lvl) AS lvl FROM nodes GROUP BY part) SELECT nodes.part AS tile, (SELECT count(*) FROM base b WHERE b.part = nodes.part) AS n, lower(hex(h)) AS root FROM nodes JOIN top USING (part, lvl)",
    "merkle_root": f"WITH RECURSIVE base AS (SELECT 0 AS part, pos, h FROM ({_LEAVES})), {_LEVELS} SELECT (SELECT count(*) FROM events) AS size, lower(hex(h)) AS root FROM nodes WHERE lvl = (SELECT max(lvl) FROM nodes)",
    "compact_range_peaks": f"WITH RECURSIVE n AS (SELECT count(*) AS n FROM events), bits AS (SELECT b, n FROM n, range(0, 40) r(b) WHERE (n >> b) & 1 = 1), peaks AS (SELECT row_number() OVER (ORDER BY b DESC) - 1 AS peak, b AS level, (n >> (b + 1)) << (b + 1) AS first, ((n >> (b + 1)) << (b + 1)) + (1::BIGINT << b) AS stop FROM bits), base AS (SELECT peak AS part, pos - first AS pos, h FROM ({_LEAVES}) l JOIN peaks ON pos >= first AND pos < stop), {_LEVELS} SELECT peak, level, lower(hex(h)) AS hash FROM peaks JOIN nodes ON part = peak AND lvl = level",
    "mapfn_delimited": "SELECT sha256(event_type) AS key_hash, event_id AS idx, 0::BIGINT AS ord FROM events",
    "mapfn_json_field": _lists("SELECT coalesce(json_extract_string(props, '$.k'), '') AS key, event_id AS idx FROM events"),
    "mapfn_multi_key": _lists("SELECT event_type AS key, event_id AS idx FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT 'u' || user_id, event_id FROM events WHERE event_id % 7 <> 0"),
    "mapfn_module_line": f"WITH {_MODULE} " + _lists("SELECT module AS key, idx FROM m WHERE idx % 5 <> 0"),
    "domain_keys": f"WITH {_HOSTS} " + _lists(f"SELECT DISTINCT {_SUFFIX} AS key, page_id AS idx FROM p, range(1, 20) r(i) WHERE i <= greatest(1, len(parts) - CASE WHEN array_to_string(parts[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'me.uk', 'net.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'ne.jp', 'or.jp', 'co.nz', 'com.br', 'com.cn', 'co.in', 'co.za') THEN 2 ELSE 1 END)"),
    "wal_rows": "SELECT event_id AS idx, event_id || ' ' || sha256(event_type) AS value FROM events",
    "wal_roundtrip": "SELECT sha256(event_type) AS key_hash, event_id AS idx, 0::BIGINT AS ord FROM events",
    "index_build": _lists(_EVENT_LISTS),
    "value_hashes": _commitments(_EVENT_LISTS),
    "index_orders_by_customer": _commitments("SELECT o_custkey::VARCHAR AS key, o_orderkey AS idx FROM orders"),
    "index_lineitem_by_part": _commitments("SELECT l_partkey::VARCHAR AS key, l_orderkey * 8 + l_linenumber AS idx FROM lineitem"),
    "chunked_commitments": f"WITH c AS (SELECT event_type AS key, event_id // 65536 AS chunk, count(*) AS n, {_value_hash('event_id', 'h')} FROM events GROUP BY ALL) SELECT sha256(key) AS key_hash, sum(n)::BIGINT AS n, sha256(unhex(string_agg(printf('%016X', chunk) || h, '' ORDER BY chunk))) AS value_hash FROM c GROUP BY key",
    "lookup_present": _lookup("(VALUES ('click')) AS k(key)"),
    "lookup_absent": _lookup("(VALUES ('banana')) AS k(key)"),
    "lookup_many": _lookup(_KEYS),
    "lookup_at_size": _lookup(_KEYS, "event_id < 777"),
    "lookup_min_idx": _lookup(_KEYS, "event_id >= 400"),
    "lookup_delta": _lookup(_KEYS, skip=25),
    "dereference": _DEREF,
    "incremental_equals_full": _commitments(_EVENT_LISTS),
    "map_fn_keys_histogram": f"WITH {_HOSTS}, k AS (SELECT page_id, greatest(1, len(parts) - CASE WHEN array_to_string(parts[-2:], '.') IN ('co.uk', 'org.uk', 'com.au', 'co.jp') THEN 2 ELSE 1 END) AS keys FROM p UNION ALL SELECT page_id, 0 FROM h WHERE host = ''), b AS (SELECT i AS bucket, CASE WHEN i < 12 THEN {_BOUNDS}[i + 1] END AS upper, CASE WHEN i = 0 THEN -1 ELSE {_BOUNDS}[i] END AS lower FROM range(0, 13) r(i)) SELECT b.bucket, b.upper::BIGINT AS upper, count(k.keys) AS n FROM b LEFT JOIN k ON k.keys > b.lower AND (b.upper IS NULL OR k.keys <= b.upper) GROUP BY ALL",
    "version_audit": f"{_VERSIONS}, {_TAGS} SELECT v.version, v.idx, CASE WHEN t.version IS NULL THEN '❌' ELSE '✅' END AS found, CASE WHEN coalesce(tag_mod_hash, '') = '' THEN '⚠️' WHEN tag_mod_hash = mod_hash THEN '✅' ELSE '❌' END AS mod, CASE WHEN coalesce(tag_mod_hash, '') = '' THEN '⚠️' WHEN tag_zip_hash = zip_hash THEN '✅' ELSE '❌' END AS zip FROM v LEFT JOIN t ON t.version = v.version",
    "tags_missing_from_log": f"{_VERSIONS}, {_TAGS} SELECT DISTINCT version FROM t WHERE version NOT IN (SELECT version FROM v)",
    "duplicate_versions": f"SELECT version, count(*) AS n FROM ({_ORDER_VERSIONS}) GROUP BY version HAVING count(*) > 1",
    "semver_order": f"SELECT version, row_number() OVER (ORDER BY a, b, c, rc NULLS LAST) AS place FROM (SELECT DISTINCT version, a, b, c, rc FROM ({_ORDER_VERSIONS}))",
    "tile_paths": f"SELECT event_id, {_PATH.format('(event_id * 1237)')} || CASE WHEN event_id % 256 > 0 THEN '.p/' || (event_id % 256) ELSE '' END AS path FROM events",
    "last_tile_page": f"WITH {_LOG} SELECT idx, leaf FROM log WHERE idx >= ((SELECT count(*) FROM events) - 1) // 256 * 256",
    "jump_to_index": "SELECT event_id AS idx, event_id // 256 AS tile, event_id = 700 AS wanted FROM events WHERE event_id >= 512 AND event_id < 768",
    "entry_preview": "SELECT doc_id, substr(text, 1, 100) AS preview, strlen(text) AS bytes FROM documents",
    "proxy_rewrite": f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN '/latest' WHEN 1 THEN '/tile/8/data/' || {_PATH.format('event_id')} WHEN 2 THEN '/tile/8/0/' || {_PATH.format('event_id')} ELSE '/other' END AS path FROM events",
    "bundle_reframe": "SELECT event_id, lower(printf('%04x', strlen(a)) || hex(encode(a)) || printf('%04x', strlen(b)) || hex(encode(b))) AS framed FROM (SELECT event_id, event_type || chr(10) || event_type || '1' || chr(10) AS a, user_id || chr(10) AS b FROM events)",
    "checkpoint_parse": "SELECT event_id, 'origin/' || event_type AS origin, event_id AS size, sha256(event_type) AS hash FROM events",
    "output_leaf_codec": "SELECT event_id, sha256(event_type) AS map_root, 'cp ' || event_id AS checkpoint FROM events",
    "directory_hashes": "SELECT source AS dir, 'h1:' || to_base64(unhex(sha256(string_agg(sha256(text) || '  ' || printf('%012d', doc_id) || chr(10), '' ORDER BY doc_id)))) AS hash FROM documents GROUP BY source",
    "revision_audit": "SELECT floor((SELECT count(*) FROM events) * share)::BIGINT AS size, same FROM (VALUES (0.4, TRUE), (0.75, TRUE), (1.0, TRUE), (1.0, FALSE)) AS s(share, same)",
    "trie_proof_verify": "SELECT c_custkey AS key, c_custkey IN (SELECT o_custkey FROM orders) AS found, TRUE AS verified, FALSE AS forged FROM customer",
    "inclusion_proof_verify": _INCLUSION,
    "inclusion_proof_verify_all": _INCLUSION,
    "map_root": f"WITH RECURSIVE {_map_roots('SELECT 0 AS part, o_custkey::VARCHAR AS key, o_orderkey AS idx FROM orders')} SELECT lower(hex(h)) AS root FROM t WHERE depth = 0",
    "output_log_history": f"WITH RECURSIVE s AS (SELECT part, floor((SELECT count(*) FROM events) * share)::BIGINT AS size FROM (VALUES (0, 0.4), (1, 0.75), (2, 1.0)) AS x(part, share)), {_map_roots('SELECT s.part, event_type AS key, event_id AS idx FROM events, s WHERE event_id < s.size')} SELECT s.part::BIGINT AS out_idx, lower(hex(h)) AS map_root, size FROM t JOIN s ON s.part = t.part WHERE depth = 0",
    "ct_dns_names": _certificate_keys("pages.page_id % 10 = 9"),
    "mtc_dns_names": _certificate_keys("pages.page_id % 10 = 9 OR pages.page_id % 3 = 0"),
    "sumdb_from_tiles": f"WITH {_MODULE} " + _lists("SELECT module AS key, idx FROM m WHERE idx % 5 <> 0"),
    "lookup_at_share": _lookup(_KEYS, "event_id < (SELECT count(*) FROM events) * 9 // 10"),
    "version_audit_all": f"WITH {_MODULE}, {_ALL_TAGS} SELECT m.module, m.version, m.idx, CASE WHEN t.version IS NULL THEN '❌' ELSE '✅' END AS found, CASE WHEN coalesce(tag_mod_hash, '') = '' THEN '⚠️' WHEN tag_mod_hash = mod_hash THEN '✅' ELSE '❌' END AS mod, CASE WHEN coalesce(tag_mod_hash, '') = '' THEN '⚠️' WHEN tag_zip_hash = zip_hash THEN '✅' ELSE '❌' END AS zip FROM m LEFT JOIN t ON t.module = m.module AND t.version = m.version",
    "tags_missing_from_log_all": f"WITH {_MODULE} SELECT DISTINCT module, 'v9.9.9' AS version FROM m",
    "latest_revision": "SELECT 2::BIGINT AS out_idx, count(*) AS size FROM events",
    "verified_lookup": "SELECT key, (SELECT count(*) FROM events WHERE event_type = key) AS n, (SELECT count(*) FROM events) AS size FROM (VALUES ('click'), ('banana')) AS k(key)",
    "stream_update": _commitments(_EVENT_LISTS),
    "tiles_roundtrip": f"WITH {_LOG} SELECT idx, leaf FROM log",
    "tiles_roundtrip_all": f"WITH {_LOG} SELECT idx, leaf FROM log",
}
