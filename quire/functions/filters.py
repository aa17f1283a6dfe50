"""Stream filters: bytes to bytes, from the published PDF specification (ISO 32000)."""

from __future__ import annotations

import re
import zlib

import numpy as np

MOST_FILTERS = 4
NAMES = {"Fl": "FlateDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode", "LZW": "LZWDecode"}
IMAGES = {"DCTDecode", "DCT", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode", "CCF"}


def flate(data: bytes) -> bytes:
    """Inflated as far as it goes: damaged tails are dropped."""
    for window in (15, -15):
        d, out = zlib.decompressobj(window), []
        try:
            out.append(d.decompress(data))
            out.append(d.flush())
            return b"".join(out)
        except zlib.error:
            got = _inflate_what_goes(data, window)
            if got:
                return got
    return b""


def _inflate_what_goes(data: bytes, window: int) -> bytes:
    d, out = zlib.decompressobj(window), []
    try:
        for i in range(0, len(data), 256):
            out.append(d.decompress(data[i : i + 256]))
    except zlib.error:
        pass
    return b"".join(out)


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~")[0]:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += _base85(group, 4)
                group = []
    if len(group) > 1:
        out += _base85(group + [84] * (5 - len(group)), len(group) - 1)
    return bytes(out)


def _base85(group: list[int], keep: int) -> bytes:
    n = 0
    for d in group:
        n = n * 85 + d
    return (n & 0xFFFFFFFF).to_bytes(4, "big")[:keep]


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    out, width, bits, have, last = bytearray(), 9, 0, 0, None
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table = list(start)
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        while have >= width:
            code = bits >> (have - width) & ((1 << width) - 1)
            have -= width
            bits &= (1 << have) - 1
            if code == 256:
                table, width, last = list(start), 9, None
                continue
            if code == 257:
                return bytes(out)
            if code < len(table):
                entry = table[code]
            elif last is not None and code == len(table):
                entry = last + last[:1]
            else:
                return bytes(out)
            out += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
            n = len(table) + early
            width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    return bytes(out)


def predict(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    """PNG predictors (10 and up; each row names its own) and TIFF's (2, 8 bits a component)."""
    step, size = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if predictor == 2 and bits == 8:
        rows = np.frombuffer(data[: len(data) // size * size], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    if predictor < 10:
        return data
    out, above = bytearray(), np.zeros(size, np.uint8)
    for i in range(0, len(data), size + 1):
        kind, row = data[i], np.frombuffer(data[i + 1 : i + 1 + size], np.uint8)
        if len(row) < size:
            row = np.pad(row, (0, size - len(row)))
        if kind == 1:
            pad = np.pad(row, (0, -size % step)).reshape(-1, step)
            row = np.cumsum(pad, axis=0, dtype=np.uint8).reshape(-1)[:size]
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            row = _by_pixel(kind, row.tolist(), above.tolist(), step)
        out += row.tobytes()
        above = row
    return bytes(out)


def _by_pixel(kind: int, row: list[int], above: list[int], step: int) -> np.ndarray:
    for k in range(len(row)):
        left, up = row[k - step] if k >= step else 0, above[k]
        if kind == 3:
            guess = (left + up) // 2
        else:
            corner = above[k - step] if k >= step else 0
            p = left + up - corner
            guess = min((left, up, corner), key=lambda v: abs(p - v))
        row[k] = (row[k] + guess) & 255
    return np.array(row, np.uint8)


def decoded(data: bytes, names: list[str], parms: list[dict]) -> tuple[bytes, str]:
    """data through at most MOST_FILTERS filters; the name of an image filter that it stopped at, or ''."""
    for i, name in enumerate(names[:MOST_FILTERS]):
        name, p = NAMES.get(name, name), parms[i] if i < len(parms) and isinstance(parms[i], dict) else {}
        if name in IMAGES:
            return data, name
        if name == "FlateDecode":
            data = flate(data)
        elif name == "LZWDecode":
            data = lzw(data, int(p.get("EarlyChange", 1)))
        elif name == "ASCIIHexDecode":
            data = ascii_hex(data)
        elif name == "ASCII85Decode":
            data = ascii85(data)
        elif name == "RunLengthDecode":
            data = run_length(data)
        if name in ("FlateDecode", "LZWDecode") and int(p.get("Predictor", 1)) > 1:
            data = predict(data, int(p["Predictor"]), int(p.get("Colors", 1)), int(p.get("BitsPerComponent", 8)), int(p.get("Columns", 1)))
    return data, ""
