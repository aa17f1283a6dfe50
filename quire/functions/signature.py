"""Checking signatures over byte ranges: PKCS#7 (RFC 5652) with RSA (PKCS#1 and PSS, RFC 8017) or ECDSA (FIPS 186), in plain Python."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

# Object identifiers.
HASHES = {"1.3.14.3.2.26": "sha1", "2.16.840.1.101.3.4.2.1": "sha256", "2.16.840.1.101.3.4.2.2": "sha384", "2.16.840.1.101.3.4.2.3": "sha512"}
DIGEST, RSA, PSS, TIME, COMMON_NAME = "1.2.840.113549.1.9.4", "1.2.840.113549.1.1.1", "1.2.840.113549.1.1.10", "1.2.840.113549.1.9.5", "2.5.4.3"
_PREFIX = {"sha1": "3021300906052b0e03021a05000414", "sha256": "3031300d060960864801650304020105000420", "sha384": "3041300d060960864801650304020205000430", "sha512": "3051300d060960864801650304020305000440"}


EC_KEY = "1.2.840.10045.2.1"


class Curve(NamedTuple):
    """y² = x³ - 3x + b over the integers modulo p; (x, y) has order n."""

    p: int
    b: int
    x: int
    y: int
    n: int


# The curves P-256, P-384 and P-521.
CURVES = {
    "1.2.840.10045.3.1.7": Curve(
        2**256 - 2**224 + 2**192 + 2**96 - 1,
        0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B,
        0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296,
        0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5,
        0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551,
    ),
    "1.3.132.0.34": Curve(
        2**384 - 2**128 - 2**96 + 2**32 - 1,
        0xB3312FA7E23EE7E4988E056BE3F82D19181D9C6EFE8141120314088F5013875AC656398D8A2ED19D2A85C8EDD3EC2AEF,
        0xAA87CA22BE8B05378EB1C71EF320AD746E1D3B628BA79B9859F741E082542A385502F25DBF55296C3A545E3872760AB7,
        0x3617DE4A96262C6F5D9E98BF9292DC29F8F41DBD289A147CE9DA3113B5F0B8C00A60B1CE1D7E819D7A431D7C90EA0E5F,
        0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFC7634D81F4372DDF581A0DB248B0A77AECEC196ACCC52973,
    ),
    "1.3.132.0.35": Curve(
        2**521 - 1,
        0x0051953EB9618E1C9A1F929A21A0B68540EEA2DA725B99B315F3B8B489918EF109E156193951EC7E937B1652C0BD3BB1BF073573DF883D2C34F1EF451FD46B503F00,
        0xC6858E06B70404E9CD9E3ECB662395B4429C648139053FB521F828AF606B4D3DBAA14B5E77EFE75928FE1DC127A2FFA8DE3348B3C1856A429BF97E7E31C2E5BD66,
        0x11839296A789A3BC0045C8A5FB42C7D1BD998F54449579B446817AFBD17273E662C97EE72995EF42640C550B9013FAD0761353C7086A272C24088BE94769FD16650,
        2**521 - 0x5AE79787C40D069948033FEB708F65A2FC44A36477663B851449048E16EC79BF7,
    ),
}
Point = tuple[int, int] | None


def added(c: Curve, a: Point, b: Point) -> Point:
    if a is None or b is None:
        return b if a is None else a
    if a[0] == b[0]:
        if (a[1] + b[1]) % c.p == 0:
            return None
        slope = 3 * (a[0] * a[0] - 1) * pow(2 * a[1], -1, c.p)
    else:
        slope = (b[1] - a[1]) * pow(b[0] - a[0], -1, c.p)
    x = (slope * slope - a[0] - b[0]) % c.p
    return x, (slope * (a[0] - x) - a[1]) % c.p


def multiplied(c: Curve, k: int, a: Point) -> Point:
    out: Point = None
    while k:
        if k & 1:
            out = added(c, out, a)
        a, k = added(c, a, a), k >> 1
    return out


def ecdsa(c: Curve, point: bytes, digest: bytes, value: bytes) -> bool:
    """Whether value (r and s) signs the digest by the key at this uncompressed point."""
    size = (c.p.bit_length() + 7) // 8
    if len(point) != 2 * size + 1 or point[0] != 4:
        raise ValueError("the point is not uncompressed")
    x, y = int.from_bytes(point[1 : size + 1], "big"), int.from_bytes(point[size + 1 :], "big")
    if (y * y - x * x * x + 3 * x - c.b) % c.p:
        raise ValueError("the point is not on the curve")
    r, s = (int.from_bytes(k.body, "big") for k in read_all(value)[0].kids()[:2])
    if not (0 < r < c.n and 0 < s < c.n):
        return False
    bits = c.n.bit_length()
    z = int.from_bytes(digest, "big") >> max(0, 8 * len(digest) - bits)
    w = pow(s, -1, c.n)
    got = added(c, multiplied(c, z * w % c.n, (c.x, c.y)), multiplied(c, r * w % c.n, (x, y)))
    return got is not None and got[0] % c.n == r


def mask(seed: bytes, size: int, name: str) -> bytes:
    """MGF1."""
    out, k = b"", 0
    while len(out) < size:
        out, k = out + hashlib.new(name, seed + k.to_bytes(4, "big")).digest(), k + 1
    return out[:size]


def pss(m: bytes, bits: int, digest: bytes, name: str, mask_name: str, salt: int) -> bool:
    """Whether the opened signature m holds the digest, for a key of so many bits."""
    size, h = (bits + 6) // 8, len(digest)
    m = m[-size:]
    if size < h + salt + 2 or m[-1] != 0xBC:
        return False
    low = 8 * size - bits + 1
    hidden, tail = m[: size - h - 1], m[size - h - 1 : -1]
    if hidden[0] >> (8 - low) if low else 0:
        return False
    plain = bytearray(a ^ b for a, b in zip(hidden, mask(tail, len(hidden), mask_name), strict=True))
    plain[0] &= 0xFF >> low
    if any(plain[: -salt - 1] if salt else plain[:-1]) or plain[len(plain) - salt - 1] != 1:
        return False
    return hashlib.new(name, bytes(8) + digest + bytes(plain[len(plain) - salt :])).digest() == tail


def _pss_of(algorithm: Tlv, name: str) -> tuple[str, str, int]:
    """Hash, the mask's hash and the salt's length that an algorithm names."""
    hashed, masked, salt = "sha1", "sha1", 20
    for k in algorithm.kids()[1].kids() if len(algorithm.kids()) > 1 else []:
        if k.tag == 0xA0:
            hashed = HASHES[oid(k.kids()[0].kids()[0].body)]
        elif k.tag == 0xA1:
            masked = HASHES[oid(k.kids()[0].kids()[1].kids()[0].body)]
        elif k.tag == 0xA2:
            salt = int.from_bytes(k.kids()[0].body, "big")
    return hashed, masked, salt


class Tlv(NamedTuple):
    tag: int
    body: bytes
    raw: bytes

    def kids(self) -> list[Tlv]:
        return read_all(self.body)


def read_all(b: bytes) -> list[Tlv]:
    out, i = [], 0
    while i + 2 <= len(b):
        tag, n, j = b[i], b[i + 1], i + 2
        if tag == 0 and n == 0:
            break
        if n & 0x80:
            size = n & 0x7F
            if not 0 < size <= 4:
                raise ValueError("length")
            n, j = int.from_bytes(b[j : j + size], "big"), j + size
        if j + n > len(b):
            raise ValueError("cut short")
        out.append(Tlv(tag, b[j : j + n], b[i : j + n]))
        i = j + n
    return out


def oid(b: bytes) -> str:
    out, n = [b[0] // 40, b[0] % 40], 0
    for c in b[1:]:
        n = n << 7 | c & 0x7F
        if not c & 0x80:
            out.append(n)
            n = 0
    return ".".join(map(str, out))


def _find(t: Tlv, want: str) -> Tlv | None:
    """What follows the identifier want anywhere in t."""
    kids = t.kids() if t.tag & 0x20 else []
    for i, k in enumerate(kids):
        if k.tag == 6 and oid(k.body) == want:
            return kids[i + 1] if i + 1 < len(kids) else None
        if (x := _find(k, want)) is not None:
            return x
    return None


def check(der: bytes, signed: bytes) -> dict:
    """intact (the digest is that of signed; null if unread), verified (by the signer's key; null if unread), hash, signer."""
    out = {"intact": None, "verified": None, "hash": "", "signer": "", "reason": ""}
    try:
        data = read_all(der)[0].kids()[1].kids()[0].kids()
        certs = [c for k in data if k.tag == 0xA0 for c in k.kids()]
        info = next(k for k in reversed(data) if k.tag == 0x31).kids()[0].kids()
        i = 2
        name = HASHES.get(oid(info[i].kids()[0].body), "")
        out["hash"] = name
        attrs = next((k for k in info if k.tag == 0xA0), None)
        digest = hashlib.new(name, signed).digest()
        if attrs is not None:
            said = _find(attrs, DIGEST)
            out["intact"] = said is not None and said.kids()[0].body == digest
            signed = b"\x31" + attrs.raw[1:]
            digest = hashlib.new(name, signed).digest()
        rest = info[(info.index(attrs) if attrs is not None else i) + 1 :]
        method, value = oid(rest[0].kids()[0].body), rest[1].body
        serial = info[1].kids()[1].body
        cert = next((c for c in certs if _serial(c) == serial), certs[0] if certs else None)
        if cert is None:
            return out | {"reason": "no certificate"}
        subject = _subject(cert)
        cn = _find(subject, COMMON_NAME)
        out["signer"] = cn.body.decode("utf-8", "replace") if cn is not None else ""
        point = _key(cert)
        curve = _curve(cert)
        if curve is not None and point is not None:
            out["verified"] = ecdsa(curve, point, digest, value)
        elif _find(cert, RSA) is None and _find(cert, PSS) is None or point is None:
            return out | {"reason": "no key of a kind that is read"}
        else:
            n, e = (int.from_bytes(k.body, "big") for k in read_all(point)[0].kids())
            size = (n.bit_length() + 7) // 8
            m = pow(int.from_bytes(value, "big"), e, n).to_bytes(size, "big")
            if method == PSS:
                hashed, masked, salt = _pss_of(rest[0], name)
                out["verified"] = pss(m, n.bit_length(), hashlib.new(hashed, signed).digest(), hashed, masked, salt)
            else:
                want = bytes.fromhex(_PREFIX[name]) + digest
                out["verified"] = m == b"\0\1" + b"\xff" * (size - len(want) - 3) + b"\0" + want
        if attrs is None:
            out["intact"] = out["verified"]
    except (ValueError, IndexError, StopIteration, KeyError, TypeError) as x:
        out["reason"] = f"{type(x).__name__}: {x}"
    return out


def _tbs(cert: Tlv) -> list[Tlv]:
    k = cert.kids()[0].kids()
    return k[1:] if k[0].tag == 0xA0 else k


def _serial(cert: Tlv) -> bytes:
    return _tbs(cert)[0].body


def _subject(cert: Tlv) -> Tlv:
    return _tbs(cert)[4]


def _key(cert: Tlv) -> bytes | None:
    bits = [k for k in _tbs(cert)[5].kids() if k.tag == 3]
    return bits[0].body[1:] if bits else None


def _curve(cert: Tlv) -> Curve | None:
    """The curve of a certificate's key; None if the key is of another kind, an error if the curve is another."""
    algorithm = _tbs(cert)[5].kids()[0].kids()
    if oid(algorithm[0].body) != EC_KEY:
        return None
    if oid(algorithm[1].body) not in CURVES:
        raise ValueError("a curve that is not read")
    return CURVES[oid(algorithm[1].body)]
