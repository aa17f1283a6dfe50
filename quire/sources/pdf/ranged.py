"""Reading a file in parts: its head, what its first page needs, and its tail; the rest when it is asked for."""

from __future__ import annotations

import re
from collections.abc import Callable

CHUNK = 256 << 10
#: Read beyond the end of the first page's part, for the objects that it shares.
MORE = 4096

Read = Callable[[int, int], bytes]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(s for s in spans if s[1] > s[0]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def missing(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """What of [0, size) no span covers."""
    out, at = [], 0
    for a, b in merged(spans):
        if a > at:
            out.append((at, min(a, size)))
        at = max(at, b)
    return [*out, (at, size)] if at < size else out


def first_page_end(head: bytes) -> int:
    """Where a linearised file says that its first page ends; 0 if it is none."""
    m = re.search(rb"/Linearized\b.{0,400}?/E\s+(\d+)", head[:2048], re.S)
    return int(m[1]) if m else 0


class Ranged:
    """A file of a known size behind read(offset, length); holes are zero bytes until complete()."""

    def __init__(self, read: Read, size: int):
        self.read, self.size = read, size
        self.data, self.have = bytearray(size), []
        if size <= 2 * CHUNK:
            self._take(0, size)
            return
        self._take(0, CHUNK)
        end = first_page_end(bytes(self.data[:2048]))
        if end > CHUNK:
            self._take(CHUNK, min(size, end + MORE))
        self._take(size - CHUNK, size)

    def _take(self, a: int, b: int) -> None:
        part = self.read(a, b - a)
        self.data[a : a + len(part)] = part
        self.have = merged([*self.have, (a, a + len(part))])

    @property
    def whole(self) -> bool:
        return not missing(self.have, self.size)

    def complete(self) -> bytes:
        for a, b in missing(self.have, self.size):
            self._take(a, b)
        return bytes(self.data)
