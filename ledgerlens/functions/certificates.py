"""DNS names out of certificate leaves: a small DER walk, applied by Arrow batches.

The walk takes only what the index needs, the subject alternative names of type DNS, and treats anything malformed as no names. A
certificate is a sequence whose first element is the part that is signed; extensions are sequences of an object id, an
optional flag and an octet string. The names lie in the one with object id 2.5.29.17, as context tag 2.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the DER form of object id 2.5.29.17.
ALTERNATIVE_NAMES = bytes.fromhex("0603551d11")
_SEQUENCE, _OCTETS, _DNS = 0x30, 0x04, 0x82


def elements(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(tag, whole element, content) of a row of DER elements; an error if one is cut off."""
    at = 0
    while at < len(data):
        tag, size, head = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            size, head = int.from_bytes(data[head : head + n], "big"), head + n
        if head + size > len(data) or tag & 0x1F == 0x1F:
            raise ValueError("cut off or unsupported element")
        yield tag, data[at : head + size], data[head : head + size]
        at = head + size


def names_in(signed: bytes) -> list[str]:
    """DNS names in the extensions of a signed part (the content of its sequence)."""
    out = []
    for tag, _, content in elements(signed):
        # extensions stand bare or within context tag 3
        blocks = [content] if tag == _SEQUENCE else [c for t, _, c in elements(content) if t == _SEQUENCE] if tag == 0xA3 else []
        for block in blocks:
            try:
                items = list(elements(block))
            except (ValueError, IndexError):
                continue
            for t, _, extension in items:
                try:
                    fields = list(elements(extension)) if t == _SEQUENCE else []
                    if fields and fields[0][1] == ALTERNATIVE_NAMES and fields[-1][0] == _OCTETS:
                        out += [c.decode() for _, _, names in elements(fields[-1][2]) for k, _, c in elements(names) if k == _DNS]
                except (ValueError, IndexError):
                    continue
    return out


def names_of_log_leaf(leaf: bytes | None) -> list[str]:
    """Names of a certificate log leaf: version, leaf type, 8 bytes of time, 2 of entry type, then the entry."""
    try:
        kind = int.from_bytes(leaf[10:12], "big")
        if len(leaf) < 12 or kind > 1:
            return []
        at = 12 if kind == 0 else 44  # a pre-certificate has its issuer's key hash first
        size = int.from_bytes(leaf[at : at + 3], "big")
        body = leaf[at + 3 : at + 3 + size]
        if len(body) < size or not size:
            return []
        content = next(elements(body))[2]
        return names_in(next(elements(content))[2] if kind == 0 else content)
    except (ValueError, IndexError, StopIteration, TypeError):
        return []


def names_of_tree_entry(leaf: bytes | None) -> list[str]:
    """Names of a Merkle tree certificate entry: 2 bytes of type, which must be 1, then the signed part; bytes after it are let be."""
    try:
        if len(leaf) < 2 or int.from_bytes(leaf[:2], "big") != 1:
            return []
        return names_in(next(elements(leaf[2:]))[2])
    except (ValueError, IndexError, StopIteration, TypeError):
        return []


def _by_batch(names: Callable[[bytes | None], list[str]]) -> Callable[[Column], Column]:
    """The function over Arrow batches of leaves."""

    def run(leaves: pd.Series) -> pd.Series:
        return leaves.map(names)

    return F.pandas_udf(run, "array<string>")


def log_leaf_names(leaf: Column) -> Column:
    return _by_batch(names_of_log_leaf)(leaf)


def tree_entry_names(leaf: Column) -> Column:
    """Other entry types are told apart before Python sees them."""
    return F.when(F.hex(F.substring(leaf, 1, 2)) == "0001", _by_batch(names_of_tree_entry)(leaf)).otherwise(F.array().cast("array<string>"))
