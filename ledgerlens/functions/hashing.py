"""Hashes and byte codes as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(data: Column) -> Column:
    """SHA-256 as binary."""
    return F.unhex(F.sha2(data, 256))


def key_hash(key: Column) -> Column:
    """The index key of a string: SHA-256 of its UTF-8 bytes."""
    return sha256(F.encode(key, "UTF-8"))


def leaf_hash(leaf: Column) -> Column:
    """RFC 6962 leaf hash."""
    return sha256(F.concat(F.lit(b"\x00"), leaf))


def node_hash(left: Column, right: Column) -> Column:
    """RFC 6962 hash of an inner node."""
    return sha256(F.concat(F.lit(b"\x01"), left, right))


def be64(x: Column) -> Column:
    """A position as eight big-endian bytes."""
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def from_be64(data: Column) -> Column:
    return F.conv(F.hex(data), 16, 10).cast("long")


def value_hash(positions: Column) -> Column:
    """The commitment to a posting list: SHA-256 of its positions as big-endian 64-bit integers, in order."""
    return sha256(F.unhex(F.array_join(F.transform(positions, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def strict_hash(text: Column) -> Column:
    """A 32-byte hash from 64 hex digits; an error for anything else (plain unhex would pad or give null)."""
    ok = text.rlike("^[0-9a-fA-F]{64}$")
    return F.when(ok, F.unhex(text)).when(text.isNull(), F.lit(None).cast("binary")).otherwise(F.raise_error(F.concat(F.lit("not a 32-byte hash in hex: "), text)).cast("binary"))
