"""Vectorised text kernels over Arrow string columns.

Texts are handled as UTF-8 bytes: a chunk of rows is one uint8 buffer with
row offsets, and words, lines and byte windows are found and hashed with numpy
over the whole buffer, never one Python object per word. Chunks are bounded by
bytes (``CHUNK_BYTES``), so memory does not depend on Arrow's batch size; a
longer text is a chunk of its own and is processed whole.

Hashes are 64-bit: a random table value per byte under a polynomial modulo
2**64, finished by a mixer. Such a polynomial alone can't tell some long
sequences of two letters apart (from 512 bytes), so spans of more than ``BLOCK``
bytes are hashed block by block and the blocks' mixed hashes are combined.
A null text counts as empty everywhere here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
BLOCK = 64

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_pow = np.ones(1, _U)
_inv = np.ones(1, _U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow))
        p, q = np.full(size, _BASE, _U), np.full(size, _BASE_INV, _U)
        p[0] = q[0] = 1
        _pow, _inv = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher: every input bit reaches every output bit."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash takes the hash of any span."""
    _, inv = _powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, _U)
    np.cumsum(codes * inv[: len(codes)], out=out[1:])
    return out


def _poly(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, _ = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * power[start] + (end - start).astype(_U) * _U(0xC2B2AE3D27D4EB4F))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end], the same wherever the span stands."""
    size = end - start
    long = np.flatnonzero(size > BLOCK)
    if not len(long):
        return _poly(prefix, start, end)
    out = np.empty(len(start), _U)
    short = np.flatnonzero(size <= BLOCK)
    out[short] = _poly(prefix, start[short], end[short])
    for part in np.array_split(long, max(1, int(size[long].sum()) // (BLOCK << 17))):
        n = -(-size[part] // BLOCK)
        first = np.cumsum(n) - n
        nth = np.arange(n.sum()) - np.repeat(first, n)
        a = np.repeat(start[part], n) + nth * BLOCK
        h = _poly(prefix, a, np.minimum(a + BLOCK, np.repeat(end[part], n)))
        h = mix(h ^ mix(nth.astype(_U) + _U(0x2545F4914F6CDD1D)))
        out[part] = mix(np.add.reduceat(h, first) + size[part].astype(_U) * _U(0x9FB21C651E98DF25))
    return out


def lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of words: all but ASCII white space, and ASCII letters, digits and all beyond ASCII.
SPACE_WORD = ~lut(SPACES)
ALNUM_WORD = lut(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True where a code point begins.
LEADS = (np.arange(256) & 0xC0) != 0x80


class Chunk:
    """Some rows' texts as one byte buffer; offs[i]:offs[i+1] is row i."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, first: int):
        self.buf, self.offs, self.first = buf, offs, first
        self.n = len(offs) - 1

    def per_row(self, flags: np.ndarray, offs: np.ndarray | None = None) -> np.ndarray:
        """Sums of flags over each row (over other offsets, if given)."""
        return span_sums(flags, self.offs if offs is None else offs)

    def words(self, table: np.ndarray, lower: bool) -> Words:
        m = table[self.buf]
        s, e = m.copy(), m.copy()
        s[1:] &= ~m[:-1]
        e[:-1] &= ~m[1:]
        inner = self.offs[1:-1]
        at = inner[inner < len(m)]
        s[at] = m[at]
        at = inner[inner > 0] - 1
        e[at] = m[at]
        start, end = np.flatnonzero(s), np.flatnonzero(e) + 1
        offs = np.searchsorted(start, self.offs)
        low = LOWER[self.buf] if lower else self.buf
        return Words(span_hash(prefix_hash(BYTE_CODE[low]), start, end), start, end, offs)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every \\n-split line, and each row's first line; an empty text has one empty line."""
        cut = np.flatnonzero(self.buf == 10)
        start = np.sort(np.concatenate([self.offs[:-1], cut + 1]), kind="stable")
        end = np.sort(np.concatenate([self.offs[1:], cut]), kind="stable")
        offs = np.arange(self.n + 1) + np.searchsorted(cut, self.offs)
        return start, end, offs


class Words:
    """Words of a chunk: 64-bit hash, byte span, and each row's first word."""

    def __init__(self, key: np.ndarray, start: np.ndarray, end: np.ndarray, offs: np.ndarray):
        self.key, self.start, self.end, self.offs = key, start, end, offs
        self.count = np.diff(offs)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every n consecutive words of one row."""
        total = len(self.key)
        if total < n:
            return np.empty(0, _U), np.empty(0, np.int64)
        ok = np.ones(total, bool)
        for back in range(1, n):
            at = self.offs[1:] - back
            ok[at[at >= self.offs[:-1]]] = False
        at = np.flatnonzero(ok)
        at = at[at + n <= total]
        return gram_hash([self.key[at + j] for j in range(n)]), at


def gram_hash(parts: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(parts[0]), _U)
    for p in parts:
        h = (h + p) * _U(_BASE)
    return mix(h)


def span_sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def covered(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of total places lie in [s, s + width) of any start."""
    d = np.zeros(total + width + 1, np.int32)
    d[starts] += 1  # starts are distinct
    d[starts + width] -= 1
    return np.cumsum(d[:total]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def chunks(text: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Rows in order, as many at a time as limit bytes hold, one at least."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text, b"" if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type) else "")
    if not len(text):
        return
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    offs = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield Chunk(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i)
        i = j


def texts(chunk: Chunk, spans: list[tuple[int, int]]) -> list[str]:
    return [chunk.buf[a:b].tobytes().decode() for a, b in spans]
