"""Vectorised word lexer over the UTF-8 bytes of Arrow string columns.

Words are maximal runs of kept bytes. All separators used here are ASCII, so byte
runs and code-point runs are the same words. Each word gets a 64-bit hash from
prefix sums over the bytes; texts are lexed in slices of about ``SLICE`` bytes, so
memory is bounded by a slice and by the words of the largest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


class Lexer:
    """``kept``: 256 booleans; ``fold``: lower-case A-Z before hashing."""

    def __init__(self, kept: np.ndarray, fold: bool):
        self.kept = kept
        self.value = _BYTE.copy()
        if fold:
            self.value[65:91] = _BYTE[97:123]
        self.value[~kept] = 0
        self._up = np.ones(0, np.uint64)
        self._down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n + 1:
            n = max(n + 1, 1 << 16)
            for name, base in (("_up", _BASE), ("_down", _INV)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def words(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word starts, ends and hashes of the texts ``data[offs[i]:offs[i+1]]``, and the words' offsets per text."""
        lo, hi = int(offs[0]), int(offs[-1])
        part = data[lo:hi]
        n = len(part)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
        kept = self.kept[part]
        bound = np.zeros(n + 1, bool)
        bound[offs[:-1] - lo] = True
        bound[n] = True
        first, last = kept.copy(), kept.copy()
        first[1:] &= ~kept[:-1] | bound[1:n]
        last[:-1] &= ~kept[1:] | bound[1:n]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes = np.empty(len(starts), np.uint64)
        w = 0
        while w < len(starts):
            a = int(starts[w])
            v = max(w + 1, int(np.searchsorted(ends, a + SLICE, "right")))
            b = int(ends[v - 1])
            self._powers(b - a)
            sums = np.empty(b - a + 1, np.uint64)
            sums[0] = 0
            np.cumsum(self.value[part[a:b]] * self._up[: b - a], out=sums[1:])
            s, e = starts[w:v] - a, ends[w:v] - a
            hashes[w:v] = mix((sums[e] - sums[s]) * self._down[s])
            w = v
        starts, ends = starts + lo, ends + lo
        return starts, ends, hashes, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on; the last ``k - 1`` places have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix(out)


def inside(woff: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of the ``n - k + 1`` places with ``k`` words, those whose words are all of one text."""
    ok = np.ones(max(n - k + 1, 0), bool)
    if len(ok):
        for j in range(1, k):
            at = woff[1:-1] - j
            at = at[(at >= 0) & (at < len(ok))]
            ok[at] = False
    return ok


def _kept(separators: bytes) -> np.ndarray:
    kept = np.ones(256, bool)
    kept[list(separators)] = False
    return kept


def space_lexer() -> Lexer:
    """Words are runs of anything but white space, compared unchanged."""
    return Lexer(_kept(b" \t\n\x0b\x0c\r"), fold=False)


def alnum_lexer() -> Lexer:
    """Words of digits, Latin letters and non-ASCII code points; A-Z count as a-z."""
    kept = np.zeros(256, bool)
    kept[48:58] = kept[65:91] = kept[97:123] = kept[128:] = True
    return Lexer(kept, fold=True)


def text_parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo`` to ``hi`` of a string column with their bytes and offsets, about ``SLICE`` bytes at a time.

    What batches before have left in Arrow's pool is handed back first.
    """
    pa.default_memory_pool().release_unused()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data, offs[lo : hi + 1]
        lo = hi
