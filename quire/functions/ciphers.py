"""RC4, AES and the standard security handler's keys, from their published descriptions."""

from __future__ import annotations

import hashlib
import struct
import threading
from functools import lru_cache

_PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def content_key(data: bytes) -> str:
    """A key of bytes for caches: their number, and FNV-1a over their little-endian words and what is left, in base 36."""
    whole, h, digits = len(data) // 4 * 4, 2166136261, ""
    for w in (*struct.unpack(f"<{whole // 4}I", data[:whole]), *data[whole:]):
        h = (h ^ w) * 16777619 & 0xFFFFFFFF
    while h or not digits:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return f"{len(data)}-{digits}"


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _box() -> tuple[list[int], list[int]]:
    """Inverse in GF(256), then the affine map; and its inverse."""
    box = [0] * 256
    for x in range(256):
        inv = next((y for y in range(256) if _times(x, y) == 1), 0)
        v = inv
        for k in range(1, 5):
            v ^= (inv << k | inv >> (8 - k)) & 255
        box[x] = v ^ 0x63
    back = [0] * 256
    for x, v in enumerate(box):
        back[v] = x
    return box, back


_TABLES: dict = {}


def _tables() -> dict:
    if not _TABLES:
        _TABLES["box"], _TABLES["back"] = _box()
        for k in (2, 3, 9, 11, 13, 14):
            _TABLES[k] = [_times(x, k) for x in range(256)]
    return _TABLES


def _round_keys(key: bytes) -> list[bytes]:
    box, n = _tables()["box"], len(key) // 4
    w, con = [key[i : i + 4] for i in range(0, len(key), 4)], 1
    for i in range(n, 4 * (n + 7)):
        t = w[-1]
        if i % n == 0:
            t = bytes(box[b] for b in t[1:] + t[:1])
            t = bytes([t[0] ^ con]) + t[1:]
            con = _times(con, 2)
        elif n > 6 and i % n == 4:
            t = bytes(box[b] for b in t)
        w.append(bytes(a ^ b for a, b in zip(w[i - n], t)))
    return [b"".join(w[i : i + 4]) for i in range(0, len(w), 4)]


_ROWS = [(i + 4 * (i % 4)) % 16 for i in range(16)]
_ROWS_BACK = [(i - 4 * (i % 4)) % 16 for i in range(16)]


def _encrypt_block(keys: list[bytes], block: bytes) -> bytes:
    t = _tables()
    box, m2, m3 = t["box"], t[2], t[3]
    s = [a ^ b for a, b in zip(block, keys[0])]
    for r, k in enumerate(keys[1:], 1):
        s = [box[s[i]] for i in _ROWS]
        if r < len(keys) - 1:
            s = [v for c in range(0, 16, 4) for v in _mixed(s[c : c + 4], m2, m3)]
        s = [a ^ b for a, b in zip(s, k)]
    return bytes(s)


def _mixed(c: list[int], m2: list[int], m3: list[int]) -> list[int]:
    return [m2[c[i]] ^ m3[c[(i + 1) % 4]] ^ c[(i + 2) % 4] ^ c[(i + 3) % 4] for i in range(4)]


def _decrypt_block(keys: list[bytes], block: bytes) -> bytes:
    t = _tables()
    back, e, b_, d, n = t["back"], t[14], t[11], t[13], t[9]
    s = [x ^ y for x, y in zip(block, keys[-1])]
    for r in range(len(keys) - 2, -1, -1):
        s = [back[s[i]] for i in _ROWS_BACK]
        s = [x ^ y for x, y in zip(s, keys[r])]
        if r:
            s = [e[c[i]] ^ b_[c[(i + 1) % 4]] ^ d[c[(i + 2) % 4]] ^ n[c[(i + 3) % 4]] for c in (s[0:4], s[4:8], s[8:12], s[12:16]) for i in range(4)]
    return bytes(s)


@lru_cache(maxsize=1)
def _native():
    """The cipher functions of the system's libcrypto, which hashlib uses, too; None where there is none or they disagree."""
    import ctypes
    import ctypes.util

    name = ctypes.util.find_library("crypto")
    if not name:
        return None
    try:
        lib = ctypes.CDLL(name)
        for f in (lib.EVP_CIPHER_CTX_new, lib.EVP_aes_128_cbc, lib.EVP_aes_256_cbc):
            f.restype = ctypes.c_void_p
        lib.EVP_CipherInit_ex.argtypes = [ctypes.c_void_p] * 3 + [ctypes.c_char_p] * 2 + [ctypes.c_int]
        lib.EVP_CipherUpdate.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_void_p, ctypes.c_char_p, ctypes.c_int]
        lib.EVP_CIPHER_CTX_set_padding.argtypes = [ctypes.c_void_p, ctypes.c_int]
        lib.EVP_CIPHER_CTX_free.argtypes = [ctypes.c_void_p]
    except (OSError, AttributeError):
        return None

    own = threading.local()

    class Context:
        """A cipher at work, of one thread; it and its place for results stay, as many strings are short."""

        def __init__(self, kind: int):
            self.at, self.kind, self.n, self.out = lib.EVP_CIPHER_CTX_new(), kind, ctypes.c_int(0), ctypes.create_string_buffer(1 << 14)
            self.byref = ctypes.byref(self.n)

        def __del__(self):
            lib.EVP_CIPHER_CTX_free(self.at)

    def cbc(key: bytes, iv: bytes, data: bytes, encrypt: bool) -> bytes:
        """Whole blocks, no padding."""
        name, size = (len(key), encrypt), len(data)
        c = own.__dict__.get(name)
        if c is None:
            c = own.__dict__[name] = Context(lib.EVP_aes_128_cbc() if len(key) == 16 else lib.EVP_aes_256_cbc())
        out = c.out if size + 32 <= len(c.out) else ctypes.create_string_buffer(size + 32)
        # The kind is named once: to name it again is to look it up again.
        good = lib.EVP_CipherInit_ex(c.at, c.kind, None, key, iv, int(encrypt)) and lib.EVP_CIPHER_CTX_set_padding(c.at, 0)
        good = good and lib.EVP_CipherUpdate(c.at, out, c.byref, data, size)
        if not good or c.n.value != size:
            own.__dict__.pop(name)
            raise ValueError("the cipher failed")
        c.kind = None
        return ctypes.string_at(out, size)

    probe = bytes(range(64))
    for key in (probe[:16], probe[:32]):
        if cbc(key, probe[16:32], probe, True) != _plain_encrypt(key, probe[16:32], probe) or cbc(key, probe[16:32], probe, False) != _plain_decrypt(key, probe[16:32], probe):
            return None
    return cbc


def _plain_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    keys, out = _round_keys(key), []
    for i in range(0, len(data), 16):
        iv = _encrypt_block(keys, bytes(a ^ b for a, b in zip(data[i : i + 16], iv)))
        out.append(iv)
    return b"".join(out)


def _plain_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    keys, out = _round_keys(key), []
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        out.append(bytes(a ^ b for a, b in zip(_decrypt_block(keys, block), iv)))
        iv = block
    return b"".join(out)


def aes_cbc_encrypt(key: bytes, iv: bytes, data: bytes, pad: bool = True) -> bytes:
    if pad:
        data += bytes([16 - len(data) % 16]) * (16 - len(data) % 16)
    native = _native() if len(key) in (16, 32) else None
    return native(key, iv, data, True) if native and data else _plain_encrypt(key, iv, data)


def aes_cbc_decrypt(key: bytes, iv: bytes, data: bytes, pad: bool = True) -> bytes:
    native, data = _native() if len(key) in (16, 32) and len(iv) == 16 else None, data[: len(data) // 16 * 16]
    plain = native(key, iv, data, False) if native and data else _plain_decrypt(key, iv, data)
    return plain[: -plain[-1]] if pad and plain and 1 <= plain[-1] <= 16 else plain


@lru_cache(maxsize=64)
def hash_2b(password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    """Revision 6's iterated hash, which is slow on purpose; files sealed together have the same salts, so the last ones are kept."""
    k, i = hashlib.sha256(password + salt + extra).digest(), 0
    while True:
        e = aes_cbc_encrypt(k[:16], k[16:32], (password + k + extra) * 64, pad=False)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


def _padded(password: bytes) -> bytes:
    return (password[:32] + _PAD)[:32]


def file_key(d: dict, first_id: bytes, password: bytes) -> bytes | None:
    """The file's key by the user's or the owner's password; None if it is neither."""
    v, r = int(d.get("V", 0)), int(d.get("R", 2))
    o, u, p = d.get("O", b""), d.get("U", b""), int(d.get("P", 0)) & 0xFFFFFFFF
    if v >= 5:
        pw = password[:127]
        for hashed, wrapped, extra in ((u, d.get("UE", b""), b""), (o, d.get("OE", b""), u[:48])):
            h = hash_2b if r >= 6 else lambda a, b, c=b"": hashlib.sha256(a + b + c).digest()
            if h(pw, hashed[32:40], extra) == hashed[:32]:
                return aes_cbc_decrypt(h(pw, hashed[40:48], extra), bytes(16), wrapped[:32], pad=False)
        return None
    n = int(d.get("Length", 40)) // 8 if r >= 3 else 5
    n = 16 if v == 4 else n
    meta = d.get("EncryptMetadata", True)

    def user(pw: bytes) -> bytes | None:
        k = hashlib.md5(_padded(pw) + o[:32] + p.to_bytes(4, "little") + first_id + (b"\xff\xff\xff\xff" if r >= 4 and not meta else b"")).digest()
        for _ in range(50 if r >= 3 else 0):
            k = hashlib.md5(k[:n]).digest()
        k = k[:n]
        if r == 2:
            return k if rc4(k, _PAD) == u[:32] else None
        x = rc4(k, hashlib.md5(_PAD + first_id).digest())
        for i in range(1, 20):
            x = rc4(bytes(b ^ i for b in k), x)
        return k if x[:16] == u[:16] else None

    k = hashlib.md5(_padded(password)).digest()
    for _ in range(50 if r >= 3 else 0):
        k = hashlib.md5(k).digest()
    inner = o[:32]
    for i in range(19 if r >= 3 else 0, -1, -1):
        inner = rc4(bytes(b ^ i for b in k[:n]), inner)
    return user(password) or user(inner)


def object_key(key: bytes, num: int, gen: int, aes: bool) -> bytes:
    k = hashlib.md5(key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if aes else b"")).digest()
    return k[: min(16, len(key) + 5)]
