import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import certificates, codec, domains, hashing, mapfns, notes
from ledgerlens.plans.demo import log_leaf, signed_part

NAMES = (["*.example.com", "example.com", "a.example.com"], ["x.y.example.co.uk"], ["A.EXAMPLE.COM"], ["localhost", "*.co.uk"])


def one(spark, column, **values):
    """The column over one row of values."""
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def failed(spark, column, **values):
    with pytest.raises(Exception):  # noqa: B017
        one(spark, column, **values)


def test_hashes(spark):
    leaf = one(spark, hashing.leaf_hash(F.encode("a", "UTF-8")), a="x")
    assert bytes(leaf) == hashlib.sha256(b"\x00x").digest()
    assert bytes(one(spark, hashing.be64(F.col("a")), a=258)) == (258).to_bytes(8, "big")
    assert one(spark, hashing.from_be64(hashing.be64(F.col("a"))), a=2**40 + 3) == 2**40 + 3
    want = hashlib.sha256(b"".join(i.to_bytes(8, "big") for i in (0, 3, 2**33))).digest()
    assert bytes(one(spark, hashing.value_hash(F.col("a")), a=[0, 3, 2**33])) == want


@pytest.mark.parametrize("bad", ["abc", "zz" * 32, "00" * 31, "00" * 33])
def test_strict_hash(spark, bad):
    failed(spark, hashing.strict_hash(F.col("a")), a=bad)


def test_text_rows(spark):
    h = hashlib.sha256(b"1a").hexdigest()
    assert one(spark, codec.wal_row(F.col("a"), F.array(F.unhex(F.col("b")))), a=1, b=h) == f"1 {h}"
    r = one(spark, codec.wal_parsed(F.col("a")), a=f"1 {h} {h}")
    assert r.idx == 1 and [bytes(x).hex() for x in r.hashes] == [h, h]
    assert one(spark, codec.wal_parsed(F.col("a")), a="1").hashes == []
    for bad in ("1 deadbeef feed01xxx", "", "x", "1 ", f"1 {h}\0"):
        failed(spark, codec.wal_parsed(F.col("a")), a=bad)


def test_checkpoint(spark):
    root = base64.b64encode(bytes(32)).decode()
    r = one(spark, codec.checkpoint_parsed(F.col("a")), a=f"o\n7\n{root}\n\n— s AAAA\n")
    assert (r.origin, r.size, bytes(r.hash)) == ("o", 7, bytes(32))
    assert one(spark, codec.signature_lines(F.col("a")), a="o\n7\nh\n\n— s AAAA\n") == ["— s AAAA"]
    for bad in ("o\n7", f"o\nx\n{root}\n", "o\n7\nAAAA\n"):
        failed(spark, codec.checkpoint_parsed(F.col("a")), a=bad)


def test_output_leaf(spark):
    root, cp = hashlib.sha256(b"test123").digest(), b"example.com/test\n123\ndeadbeef"
    leaf = bytes(one(spark, codec.output_leaf(F.col("a"), F.col("b")), a=root, b=cp))
    assert leaf == root.hex().encode() + b"\n" + cp
    r = one(spark, codec.output_leaf_parsed(F.col("a")), a=leaf)
    assert (bytes(r.map_root), bytes(r.checkpoint)) == (root, cp)
    for bad in (leaf[:64], leaf[:64] + b"x" + cp):
        failed(spark, codec.output_leaf_parsed(F.col("a")), a=bad)


@pytest.mark.parametrize(("index", "partial", "path"), [(0, 0, "000"), (999, 0, "999"), (1000, 0, "x001/000"), (1234067, 0, "x001/x234/067"), (5, 7, "005.p/7")])
def test_tile_path(spark, index, partial, path):
    from ledgerlens.sources.tiles import path_of

    assert one(spark, codec.tile_path(F.col("a"), F.col("b")), a=index, b=partial) == path == path_of(index, partial)


@pytest.mark.parametrize(("prefix", "path", "want"), [
    ("", "/checkpoint", "/latest"), ("/p", "/p/checkpoint", "/latest"), ("", "/tile/entries/000", "/tile/8/data/000"),
    ("/p", "/p/tile/entries/000", "/tile/8/data/000"), ("", "/tile/0/000", "/tile/8/0/000"), ("/p", "/p/tile/0/000", "/tile/8/0/000"),
])
def test_rewritten_path(spark, prefix, path, want):
    assert one(spark, codec.rewritten_path(F.col("a"), prefix), a=path) == want


def test_framed(spark):
    body = "foo\nfoo1\n\nmoose\nmoose1\n"
    assert bytes(one(spark, codec.framed(codec.data_tile_records(F.col("a"))), a=body)) == b"\0\x09foo\nfoo1\n\0\x0dmoose\nmoose1\n"
    failed(spark, codec.framed(F.array("a")), a="x" * 65536)


def test_module_lines(spark):
    leaf = "example.org/m v1.0.0 h1:a=\nexample.org/m v1.0.0/go.mod h1:b=\n"
    assert [tuple(r) for r in one(spark, codec.module_lines(F.col("a")), a=leaf)] == [("example.org/m", "v1.0.0", "h1:a=", "h1:b=")]
    for bad in ("x", leaf.replace("v1.0.0/", "v1.0.1/"), leaf.splitlines()[0]):
        failed(spark, codec.module_lines(F.col("a")), a=bad)


@pytest.mark.parametrize(("leaf", "keys"), [
    ("example.net/x/text v0.3.0 h1:a", ["example.net/x/text"]), ("example.org/m v0.0.0-20240222160914-411202e8d356 h1:a", []),
    ("example.org/m v1.7.0-rc1 h1:a", ["example.org/m"]), ("example.org/m v1.2.4-0.20191109021931-daa7c04131f5 h1:a", []),
])
def test_module_keys(spark, leaf, keys):
    assert one(spark, mapfns.module_line(F.encode("a", "UTF-8")), a=leaf) == keys


def test_other_keys(spark):
    b = F.encode("a", "UTF-8")
    assert one(spark, mapfns.before_colon(b), a="foo: 2") == ["foo"]
    assert [one(spark, mapfns.comma_list(b), a=x) for x in ("foo: 2", "bar,baz: 5", "empty:", ": 1")] == [["foo"], ["bar", "baz"], [], []]
    assert one(spark, mapfns.json_field("module")(b), a='{"module": "m"}') == ["m"]
    assert one(spark, mapfns.json_field("module")(b), a="{}") == [""]
    for fn, bad in ((mapfns.before_colon, "x"), (mapfns.json_field("module"), "{"), (mapfns.json_field("module"), "[1]"), (mapfns.module_line, "a b")):
        failed(spark, fn(b), a=bad)


@pytest.mark.parametrize(("names", "keys"), [
    (["*.example.net", "example.net", "a.example.net"], ["a.example.net", "example.net"]), (["x.y.example.co.uk"], ["example.co.uk", "x.y.example.co.uk", "y.example.co.uk"]),
    (["A.EXAMPLE.NET"], ["a.example.net", "example.net"]), (["localhost", "*.co.uk"], ["co.uk", "localhost"]), (["*", ""], []),
])
def test_parents(spark, names, keys):
    assert one(spark, domains.with_parents(F.col("a")), a=names) == keys


@pytest.mark.parametrize(("name", "keys"), [
    ("a.b.example.ck", ["a.b.example.ck", "b.example.ck"]), ("example.ck", ["example.ck"]), ("a.www.ck", ["a.www.ck", "www.ck"]), ("www.ck", ["www.ck"]), ("ck", ["ck"]),
    ("a.b.city.test.jp", ["a.b.city.test.jp", "b.city.test.jp", "city.test.jp"]), ("x.y.test.jp", ["x.y.test.jp"]), ("a.example.com", ["a.example.com", "example.com"]), ("a.b.xn--55qx5d.cn", ["a.b.xn--55qx5d.cn", "b.xn--55qx5d.cn"]),
])
def test_suffix_rules(spark, name, keys):
    text = "// a comment\ncom\n*.ck\n!www.ck\njp\n*.test.jp after a blank\n!city.test.jp\n\ncn\n公司.cn\n"
    rules = domains.SuffixRules.parse(text)
    assert one(spark, domains.with_parents(F.array("a"), rules), a=name) == keys
    assert rules.version == domains.SuffixRules.parse("\n".join(reversed(text.splitlines()))).version != domains.DEFAULT.version


def test_certificate_leaves():
    for n in NAMES:
        assert certificates.names_of_log_leaf(log_leaf(n)) == n == certificates.names_of_log_leaf(log_leaf(n, pre=True))
        assert certificates.names_of_tree_entry(b"\0\1" + signed_part(n) + b"\0") == n
    for bad in (None, b"", bytes(11), bytes(10) + b"\0\x63", log_leaf(NAMES[0])[:-3], bytes(10) + b"\0\1" + bytes(32) + b"\0\0\x64hello"):
        assert certificates.names_of_log_leaf(bad) == []
    for bad in (None, b"\0", b"\0\0" + signed_part(NAMES[0]), b"\0\1invalid der"):
        assert certificates.names_of_tree_entry(bad) == []


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80))
def test_certificate_walk_never_fails(data):
    assert isinstance(certificates.names_of_log_leaf(bytes(10) + b"\0\0" + len(data).to_bytes(3, "big") + data), list)
    assert isinstance(certificates.names_of_tree_entry(b"\0\1" + data), list)


def test_ed25519_vector():
    # the second test of RFC 8032, section 7.1
    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    public = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    assert notes.ed25519_public(seed) == public
    s = notes.ed25519_sign(seed, b"\x72")
    assert s.hex().startswith("92a009a9f0d4cab8720e820b5f642540") and notes.ed25519_verify(public, b"\x72", s)
    assert not notes.ed25519_verify(public, b"\x73", s) and not notes.ed25519_verify(public, b"\x72", s[:-1] + b"\xff")


def test_signed_checkpoint():
    signer = notes.Ed25519Signer("log", bytes(range(32)))
    raw = notes.sign_checkpoint(signer, "origin", 5, bytes(32))
    assert notes.parse_checkpoint(raw, signer.verifier(), "origin").size == 5
    other = notes.Ed25519Signer("log", bytes(32)).verifier()
    for args in ((raw, signer.verifier(), "else"), (raw, other, "origin"), (raw.replace(b"\n5\n", b"\n6\n"), signer.verifier(), "origin")):
        with pytest.raises(ValueError, match="origin|signature"):
            notes.parse_checkpoint(*args)
    v = signer.verifier()
    shown = f"log+{v.key_hash.hex()}+" + base64.b64encode(b"\x01" + v.public).decode()
    assert notes.Ed25519Verifier.parse(shown) == v


def test_tree_certificate_key_hash():
    v = notes.TreeCertificateVerifier("oid/1.3.6.1.4.1.44363.47.1.44363.48.8", bytes(32), "44363.48.9", "44363.48.8")
    assert v.key_hash.hex() == "8e6a3b1a"
    assert notes.relative_oid("44363.48.8").hex() == "82da4b3008" and notes.relative_oid("0").hex() == "00"
    assert not v.verify(b"o\n1\n" + base64.b64encode(bytes(32)) + b"\n", bytes(64))


def test_p256_rejects():
    assert not notes.p256_verify(bytes(65), b"m", b"\x30\x06\x02\x01\x01\x02\x01\x01")


def test_semver(spark):
    from ledgerlens.operators.audit import semver_key

    want = ["bad", "v0.1.0-alpha", "v0.1.0-rc.2", "v0.1.0-rc.10", "v0.1.0", "v0.1.2", "v0.10.0", "v1.0.0-1", "v1.0.0-a", "v1.0.0-a.1", "v1.0.0"]
    df = spark.createDataFrame([(v,) for v in reversed(want)], "v string")
    assert [r.v for r in df.orderBy(semver_key(F.col("v"))).collect()] == want


@pytest.mark.parametrize(("leaf", "want"), [(b"plain", "plain"), (b'{"b": 1, "a": "x"}', '{"a":"x","b":1}'), (b"\xff\x00", "ff00"), (b"", "")])
def test_rendered(spark, leaf, want):
    assert one(spark, codec.rendered(F.col("a")), a=leaf) == want


def test_static_certificate_tiles(spark, tmp_path):
    from ledgerlens.sources.tiles import certificate_leaves, read_tiles

    leaves = [log_leaf(n, pre=i % 2 == 1) + b"\0\0" for i, n in enumerate(NAMES)]  # with empty extensions
    chain = (64).to_bytes(2, "big") + bytes(64)
    body = b"".join(x[2:] + ((5).to_bytes(3, "big") + b"certi" if i % 2 else b"") + chain for i, x in enumerate(leaves))
    assert certificate_leaves(body) == leaves
    for bad in (body[:-1], body[:40], bytes(9) + b"\2"):
        with pytest.raises(ValueError, match="entry"):
            certificate_leaves(bad)
    (tmp_path / "tile/data").mkdir(parents=True)
    (tmp_path / "tile/data/000.p").mkdir()
    (tmp_path / "tile/data/000.p/4").write_bytes(body)
    rows = read_tiles(spark, f"file://{tmp_path}", 1, 4, "static_ct").select("idx", mapfns.certificate_names(F.col("leaf")).alias("k")).orderBy("idx").collect()
    assert [r.idx for r in rows] == [1, 2, 3] and rows[0].k == ["example.co.uk", "x.y.example.co.uk", "y.example.co.uk"]


def test_certificate_log_key():
    der = bytes.fromhex("3059301306072a8648ce3d020106082a8648ce3d030107034200") + b"\x04" + bytes(range(64))
    text = base64.b64encode(der).decode()
    found = notes.CertificateLogVerifier.parse("log.example.org/2026", text)
    assert found == notes.CertificateLogVerifier.parse("log.example.org/2026", f"-----BEGIN PUBLIC KEY-----\n{text[:64]}\n{text[64:]}\n-----END PUBLIC KEY-----\n")
    name, shown, data = found.vkey().split("+", 2)
    key = base64.b64decode(data)
    assert name == "log.example.org/2026" and key == b"\x05" + hashlib.sha256(der).digest()
    assert shown == hashlib.sha256(name.encode() + b"\n" + key).digest()[:4].hex() == found.key_hash.hex()
    for origin, bad in (("", text), ("a b", text), ("a+b", text), ("a", text[:-4]), ("a", "!!")):
        with pytest.raises(ValueError):
            notes.CertificateLogVerifier.parse(origin, bad)


def test_load_key(tmp_path, monkeypatch):
    (tmp_path / "key").write_text("from a file\n")
    monkeypatch.setenv("A_KEY_FOR_TESTS", " from outside ")
    assert notes.load_key(str(tmp_path / "key"), "A_KEY_FOR_TESTS") == "from a file" and notes.load_key(None, "A_KEY_FOR_TESTS") == "from outside"
    monkeypatch.delenv("A_KEY_FOR_TESTS")
    with pytest.raises(ValueError, match="not set"):
        notes.load_key(None, "A_KEY_FOR_TESTS")
