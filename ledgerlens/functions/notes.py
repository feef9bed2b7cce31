"""Signed checkpoints: parsing, and the signature schemes that logs use. Driver-side; a checkpoint is one short text.

Ed25519 follows RFC 8032 and ECDSA over P-256 follows FIPS 186, both in plain integers, so that no key leaves Python and no
library is needed.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from dataclasses import dataclass
from typing import Protocol

# Ed25519: the field, the curve's constant, the group's order, the base point (fixed values of RFC 8032)
_P = 2**255 - 19
_D = -121665 * pow(121666, -1, _P) % _P
_L = 2**252 + 27742317777372353535851937790883648493
_BY = 4 * pow(5, -1, _P) % _P


def _x_of(y: int, odd: int) -> int:
    square = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(square, (_P + 3) // 8, _P)
    if x * x % _P != square:
        x = x * pow(2, (_P - 1) // 4, _P) % _P
    if x * x % _P != square or (x == 0 and odd):
        raise ValueError("not a point of the curve")
    return _P - x if x & 1 != odd else x


Point = tuple[int, int, int, int]
_BASE: Point = (_x_of(_BY, 0), _BY, 1, _x_of(_BY, 0) * _BY % _P)


def _add(p: Point, q: Point) -> Point:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % _P, (p[1] + p[0]) * (q[1] + q[0]) % _P
    c, d = 2 * p[3] * q[3] * _D % _P, 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(k: int, p: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while k:
        if k & 1:
            out = _add(out, p)
        p, k = _add(p, p), k >> 1
    return out


def _packed(p: Point) -> bytes:
    z = pow(p[2], -1, _P)
    return (p[1] * z % _P | (p[0] * z % _P & 1) << 255).to_bytes(32, "little")


def _unpacked(data: bytes) -> Point:
    y = int.from_bytes(data, "little")
    odd, y = y >> 255, y & (1 << 255) - 1
    if y >= _P:
        raise ValueError("not a point of the curve")
    x = _x_of(y, odd)
    return x, y, 1, x * y % _P


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, h[32:]


def ed25519_public(seed: bytes) -> bytes:
    return _packed(_times(_secret(seed)[0], _BASE))


def ed25519_sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    public = _packed(_times(a, _BASE))
    r = _number(prefix, message) % _L
    at = _packed(_times(r, _BASE))
    return at + ((r + _number(at, public, message) * a) % _L).to_bytes(32, "little")


def ed25519_verify(public: bytes, message: bytes, signature: bytes) -> bool:
    try:
        if len(public) != 32 or len(signature) != 64:
            return False
        key, at, s = _unpacked(public), _unpacked(signature[:32]), int.from_bytes(signature[32:], "little")
    except ValueError:
        return False
    if s >= _L:
        return False
    return _packed(_times(s, _BASE)) == _packed(_add(at, _times(_number(signature[:32], public, message), key)))


# P-256: fixed values of the curve
_Q = 2**256 - 2**224 + 2**192 + 2**96 - 1
_N = 0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551
_B = 0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B
_G = (0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296, 0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5)


def _p256_add(p: tuple[int, int] | None, q: tuple[int, int] | None) -> tuple[int, int] | None:
    if p is None or q is None:
        return q if p is None else p
    if p[0] == q[0]:
        if (p[1] + q[1]) % _Q == 0:
            return None
        slope = (3 * p[0] * p[0] - 3) * pow(2 * p[1], -1, _Q)
    else:
        slope = (q[1] - p[1]) * pow(q[0] - p[0], -1, _Q)
    x = (slope * slope - p[0] - q[0]) % _Q
    return x, (slope * (p[0] - x) - p[1]) % _Q


def _p256_times(k: int, p: tuple[int, int]) -> tuple[int, int] | None:
    out = None
    while k:
        if k & 1:
            out = _p256_add(out, p)
        p, k = _p256_add(p, p), k >> 1
    return out


def p256_verify(public: bytes, message: bytes, signature: bytes) -> bool:
    """``public`` as a DER key or an uncompressed point, ``signature`` as DER of two integers, over SHA-256 of the message."""
    from ledgerlens.functions.certificates import elements

    try:
        x, y = int.from_bytes(public[-64:-32], "big"), int.from_bytes(public[-32:], "big")
        (_, _, body), *_ = elements(signature)
        r, s = (int.from_bytes(c, "big") for _, _, c in elements(body))
    except (ValueError, IndexError):
        return False
    if (y * y - x * x * x + 3 * x - _B) % _Q or not (0 < r < _N and 0 < s < _N):
        return False
    e, w = int.from_bytes(hashlib.sha256(message).digest(), "big"), pow(s, -1, _N)
    point = _p256_add(_p256_times(e * w % _N, _G), _p256_times(r * w % _N, (x, y)))
    return point is not None and point[0] % _N == r


def relative_oid(dotted: str) -> bytes:
    """Components in base 128, the high bit on all but the last byte of each."""
    out = bytearray()
    for part in map(int, dotted.split(".")):
        if not 0 <= part < 1 << 32:
            raise ValueError("component out of range")
        groups = [part & 0x7F]
        while part := part >> 7:
            groups.append(part & 0x7F | 0x80)
        out += bytes(reversed(groups))
    return bytes(out)


class Verifier(Protocol):
    name: str
    key_hash: bytes

    def verify(self, message: bytes, signature: bytes) -> bool: ...


@dataclass
class Ed25519Verifier:
    """From ``name+hash+base64(01 key)``."""

    name: str
    key_hash: bytes
    public: bytes

    @classmethod
    def parse(cls, vkey: str) -> Ed25519Verifier:
        name, shown, data = vkey.split("+", 2)
        key = base64.b64decode(data, validate=True)
        found = hashlib.sha256(name.encode() + b"\n" + key).digest()[:4]
        if key[:1] != b"\x01" or len(key) != 33 or found.hex() != shown:
            raise ValueError("malformed verifier key")
        return cls(name, found, key[1:])

    def verify(self, message: bytes, signature: bytes) -> bool:
        return ed25519_verify(self.public, message, signature)


@dataclass
class Ed25519Signer:
    """From ``PRIVATE+KEY+name+hash+base64(01 seed)``; stays on the driver."""

    name: str
    seed: bytes

    @classmethod
    def parse(cls, skey: str) -> Ed25519Signer:
        a, b, name, shown, data = skey.split("+", 4)
        key = base64.b64decode(data, validate=True)
        signer = cls(name, key[1:])
        if (a, b) != ("PRIVATE", "KEY") or key[:1] != b"\x01" or signer.verifier().key_hash.hex() != shown:
            raise ValueError("malformed signer key")
        return signer

    def verifier(self) -> Ed25519Verifier:
        public = ed25519_public(self.seed)
        return Ed25519Verifier(self.name, hashlib.sha256(self.name.encode() + b"\n\x01" + public).digest()[:4], public)

    def sign(self, message: bytes) -> bytes:
        return ed25519_sign(self.seed, message)


@dataclass
class CertificateLogVerifier:
    """The checkpoint signature of a certificate log with a P-256 key: over the RFC 6962 tree head, its time in front of it.

    As text it is ``name+hash+base64(05 SHA-256(key))``, which names the key but does not hold it.
    """

    name: str
    public_der: bytes

    @classmethod
    def parse(cls, origin: str, key: str) -> CertificateLogVerifier:
        """From the log's origin and its public key in DER, as base64 or in a PEM block."""
        body = "".join(line for line in key.splitlines() if not line.startswith("-----"))
        der = base64.b64decode(body, validate=True)
        if not origin or "+" in origin or any(c.isspace() for c in origin) or der[:1] != b"\x30" or len(der) != 91:
            raise ValueError("an origin and a P-256 key in DER are needed")
        return cls(origin, der)

    def vkey(self) -> str:
        return f"{self.name}+{self.key_hash.hex()}+{base64.b64encode(bytes([5]) + hashlib.sha256(self.public_der).digest()).decode()}"

    @property
    def key_hash(self) -> bytes:
        return hashlib.sha256(self.name.encode() + b"\n\x05" + hashlib.sha256(self.public_der).digest()).digest()[:4]

    def verify(self, message: bytes, signature: bytes) -> bool:
        parts = message.decode("utf-8", "replace").split("\n")
        if len(parts) < 3 or len(signature) < 12 or not parts[1].isdigit():
            return False
        when, scheme, size = signature[:8], signature[8:10], int.from_bytes(signature[10:12], "big")
        head = b"\x00\x01" + when + int(parts[1]).to_bytes(8, "big") + base64.b64decode(parts[2])
        return scheme == b"\x04\x03" and len(signature) == 12 + size and p256_verify(self.public_der, head, signature[12:])


@dataclass
class TreeCertificateVerifier:
    """A cosigner of a Merkle tree certificate log: the signature covers the two ids, the size and the hash, not the origin."""

    name: str
    public: bytes
    cosigner_id: str
    log_id: str

    @property
    def key_hash(self) -> bytes:
        return hashlib.sha256(self.name.encode() + b"\n\xffmtc-checkpoint/v1").digest()[:4]

    def verify(self, message: bytes, signature: bytes) -> bool:
        try:
            _, size, root = message.decode().split("\n")[:3]
            root_hash, ids = base64.b64decode(root, validate=True), [relative_oid(self.cosigner_id), relative_oid(self.log_id)]
            if len(root_hash) != 32 or not size.isdigit() or max(map(len, ids)) > 255:
                return False
            signed = b"mtc-subtree/v1\n\x00" + b"".join(bytes([len(x)]) + x for x in ids) + struct.pack(">QQ", 0, int(size)) + root_hash
        except (ValueError, struct.error):
            return False
        return ed25519_verify(self.public, signed, signature)


@dataclass
class Checkpoint:
    origin: str
    size: int
    hash: bytes
    raw: bytes


def parse_unverified(raw: bytes) -> Checkpoint:
    """Origin, size and hash; for texts that come from our own tables."""
    parts = raw.decode().split("\n", 3)
    if len(parts) < 4 or not parts[1].isdigit():
        raise ValueError("malformed checkpoint")
    root = base64.b64decode(parts[2], validate=True)
    return Checkpoint(parts[0], int(parts[1]), root, raw)


def signatures(raw: bytes) -> list[tuple[str, bytes, bytes]]:
    """(name, key hash, signature) of each signature line."""
    out = []
    for line in raw.decode().partition("\n\n")[2].splitlines():
        if line.startswith("— "):
            name, _, data = line[2:].partition(" ")
            found = base64.b64decode(data, validate=True)
            out.append((name, found[:4], found[4:]))
    return out


def parse_checkpoint(raw: bytes, verifier: Verifier, origin: str | None = None) -> Checkpoint:
    """The checkpoint, if the verifier's signature and the origin (its name, if not given) hold; an error otherwise."""
    text = raw.decode().partition("\n\n")[0] + "\n"
    found = parse_unverified(raw)
    if found.origin != (verifier.name if origin is None else origin):
        raise ValueError(f"unexpected origin {found.origin!r}")
    own = [s for name, key, s in signatures(raw) if name == verifier.name and key == verifier.key_hash]
    if not any(verifier.verify(text.encode(), s) for s in own):
        raise ValueError("no valid signature")
    return found


def sign_checkpoint(signer: Ed25519Signer, origin: str, size: int, root: bytes) -> bytes:
    text = f"{origin}\n{size}\n{base64.b64encode(root).decode()}\n"
    signature = base64.b64encode(signer.verifier().key_hash + signer.sign(text.encode())).decode()
    return f"{text}\n— {signer.name} {signature}\n".encode()


def load_key(path: str | None, variable: str) -> str:
    """A key from a file, or else from an environment variable; an error if there is neither."""
    if path:
        with open(path) as f:
            return f.read().strip()
    if key := os.environ.get(variable):
        return key.strip()
    raise ValueError(f"no key file given and {variable} is not set")
