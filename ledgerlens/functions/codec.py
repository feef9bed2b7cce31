"""Text and byte forms of the log formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.hashing import hex_lower, strict_hash

#: Entries in a tile or bundle.
TILE = 256


def wal_row(idx: Column, hashes: Column) -> Column:
    """``<position>( <64 hex digits>)*``"""
    return F.concat_ws(" ", idx.cast("string"), F.transform(hashes, hex_lower))


def wal_parsed(row: Column) -> Column:
    """STRUCT<idx, hashes> of a row; an error if it is malformed."""
    parts = F.split(row, " ")
    idx = F.get(parts, F.lit(0)).try_cast("long")
    ok = row.rlike("^[0-9]+( [0-9a-fA-F]{64})*$") & idx.isNotNull()
    bad = F.raise_error(F.concat(F.lit("malformed row: "), row))
    return F.when(ok, F.struct(idx.alias("idx"), F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), strict_hash).alias("hashes"))).otherwise(
        bad.cast("struct<idx:bigint,hashes:array<binary>>")
    )


def checkpoint_parsed(text: Column) -> Column:
    """STRUCT<origin, size, hash> of a checkpoint's text, signatures not checked; an error if lines are missing."""
    parts = F.split(text, "\n", 4)
    size, root = F.get(parts, F.lit(1)).try_cast("long"), F.try_to_binary(F.get(parts, F.lit(2)), F.lit("base64"))
    ok = (F.size(parts) == 4) & (size >= 0) & (F.octet_length(root) == 32)
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(F.get(parts, F.lit(0)).alias("origin"), size.alias("size"), root.alias("hash"))).otherwise(
        F.raise_error(F.concat(F.lit("malformed checkpoint: "), text)).cast("struct<origin:string,size:bigint,hash:binary>")
    )


def signature_lines(text: Column) -> Column:
    """The signature lines of a signed checkpoint."""
    return F.filter(F.split(text, "\n"), lambda x: x.startswith("— "))


def output_leaf(map_root: Column, checkpoint: Column) -> Column:
    """A leaf of the output log: the dictionary's root in hex, a line end, the input checkpoint."""
    return F.concat(F.encode(hex_lower(map_root), "UTF-8"), F.lit(b"\n"), checkpoint)


def output_leaf_parsed(leaf: Column) -> Column:
    """STRUCT<map_root, checkpoint>; at least 65 bytes with the line end in its place are required."""
    root = F.decode(F.substring(leaf, 1, 64), "UTF-8")
    ok = (F.octet_length(leaf) >= 65) & (F.substring(leaf, 65, 1) == F.lit(b"\n")) & root.rlike("^[0-9a-f]{64}$")
    return F.when(ok, F.struct(F.unhex(root).alias("map_root"), F.substring(leaf, F.lit(66), F.octet_length(leaf)).alias("checkpoint"))).otherwise(
        F.raise_error(F.lit("malformed output leaf")).cast("struct<map_root:binary,checkpoint:binary>")
    )


def tile_path(index: Column, partial: Column | None = None) -> Column:
    """Base-1000 groups of three digits, all but the last with an ``x``; ``.p/<n>`` for a partial tile."""
    groups = F.transform(F.sequence(F.lit(6), F.lit(0), F.lit(-1)), lambda k: F.floor(index / F.pow(F.lit(1000), k)).cast("long"))
    shown = F.filter(F.transform(groups, lambda g, i: F.when((g > 0) | (i == 6), F.concat(F.when(i == 6, "").otherwise("x"), F.lpad((g % 1000).cast("string"), 3, "0")))), lambda x: x.isNotNull())
    path = F.array_join(shown, "/")
    return path if partial is None else F.when(partial > 0, F.concat(path, F.lit(".p/"), partial.cast("string"))).otherwise(path)


def rewritten_path(path: Column, prefix: str = "") -> Column:
    """A request for a tiled log as one for a module checksum log: the latest checkpoint, data tiles, hash tiles of height 8."""
    own = F.substring(path, F.lit(len(prefix) + 1), F.length(path)) if prefix else path
    return (
        F.when(own == "/checkpoint", F.lit("/latest"))
        .when(own.startswith("/tile/entries/"), F.concat(F.lit("/tile/8/data/"), F.substring(own, F.lit(len("/tile/entries/") + 1), F.length(own))))
        .when(own.startswith("/tile/"), F.concat(F.lit("/tile/8/"), F.substring(own, F.lit(len("/tile/") + 1), F.length(own))))
        .otherwise(own)
    )


def data_tile_records(body: Column) -> Column:
    """The records of a text data tile: parts between blank lines, each with one line end."""
    return F.transform(F.split(body, "\n\n"), lambda x: F.concat(F.btrim(x, F.lit("\n \t\r")), F.lit("\n")))


def framed(records: Column) -> Column:
    """Records with two-byte big-endian lengths before them; an error above 65,535 bytes."""
    def one(r: Column) -> Column:
        n = F.octet_length(r)
        return F.when(n > 65535, F.raise_error(F.lit("a record is longer than 65535 bytes")).cast("string")).otherwise(F.concat(F.lpad(F.hex(n), 4, "0"), F.hex(r)))

    return F.unhex(F.array_join(F.transform(records, one), ""))


#: Fixed pattern: a module leaf names a module and version, then the same with its module file.
_MODULE_LEAF = r"^([^ \n]+) ([^ \n]+) h1:[^ \n]+\n\1 \2/go\.mod h1:[^ \n]+\n?$"


def module_lines(leaf: Column) -> Column:
    """ARRAY<STRUCT<module, version, zip_hash, mod_hash>> with the one row of a two-line module leaf, for ``inline``; an error unless the lines agree."""
    checked = F.when(leaf.rlike(_MODULE_LEAF), leaf).otherwise(F.raise_error(F.concat(F.lit("malformed module leaf: "), leaf)).cast("string"))
    part = lambda p, k: F.get(p, F.lit(k))
    return F.transform(
        F.array(F.split(checked, r"[ \n]")),
        lambda p: F.struct(part(p, 0).alias("module"), part(p, 1).alias("version"), part(p, 2).alias("zip_hash"), part(p, 5).alias("mod_hash")),
    )


def preview(text: Column) -> Column:
    """STRUCT<preview, bytes>: the first 100 characters and the length in bytes."""
    return F.struct(F.substring(text, 1, 100).alias("preview"), F.octet_length(text).cast("long").alias("bytes"))


def rendered(leaf: Column) -> Column:
    """A leaf for people: a JSON object with its fields in order, else its text, else (with bytes that are no text) hex."""
    text = F.try_validate_utf8(leaf.cast("string"))
    parsed = F.try_parse_json(text)
    return F.when(text.isNull(), hex_lower(leaf)).when(F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), F.to_json(parsed)).otherwise(text)
