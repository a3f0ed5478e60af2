"""Words of whole texts as 64-bit hashes, by array operations on the UTF-8 bytes.

A word is a run of bytes other than space and tab to carriage return. The hash of a span is a
polynomial over a random table of byte values, mixed at the end; it depends on the bytes alone.
Texts are worked through in pieces of a few MB that end at white space, so memory beyond the
input is one number per word, however long a text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every input bit over the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of the texts in them; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, grown on demand and kept for the next piece."""

    up = np.zeros(0, np.uint64)
    down = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(n, int(BASE)), _powers(n, pow(int(BASE), -1, 2**64))
        return cls.up, cls.down


def _span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    up, down = _Powers.of(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _pieces(data: np.ndarray, gaps: np.ndarray):
    """Ranges of about PIECE bytes that end at the end or after a byte of ``gaps``."""
    a, n = 0, len(data)
    while a < n:
        b = min(a + PIECE, n)
        while b < n and not gaps[data[b - 1]]:
            step = data[b:b + 65536]
            hit = np.flatnonzero(gaps[step])
            b += int(hit[0]) + 1 if len(hit) else len(step)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and end position of every word, and the index of each text's first word (n + 1 values).

    ``gaps`` marks the byte values that lie between words.
    """
    hashes, ends = [], []
    inner = offsets[1:-1]
    for a, b in _pieces(data, gaps):
        part = data[a:b]
        full = ~gaps[part]
        begin, end = full.copy(), full.copy()
        begin[1:] &= ~full[:-1]
        end[:-1] &= ~full[1:]
        edge = inner[(inner > a) & (inner < b)] - a
        begin[edge] |= full[edge]
        end[edge - 1] |= full[edge - 1]
        begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        hashes.append(_span_hashes(part, begin, end, _LOWER if lower else _TABLE))
        ends.append(end + a)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    e = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return h, e, np.searchsorted(e, offsets, side="right")


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``words`` with every byte in exactly one unit: the white space before a word and the word.

    White space after a text's last word is a unit of its own. Case counts.
    """
    _, ends, first = words(data, offsets, lower=False)
    last = offsets[1:][offsets[1:] > offsets[:-1]]
    last = last[_SPACE[data[last - 1]]]
    if len(last):
        ends = np.insert(ends, np.searchsorted(ends, last), last)
    first = np.searchsorted(ends, offsets, side="right")
    hashes, done = [], 0
    while done < len(ends):
        a = int(ends[done - 1]) if done else 0
        upto = max(int(np.searchsorted(ends, a + PIECE, side="right")), done + 1)
        end = ends[done:upto] - a
        begin = np.concatenate([[0], end[:-1]])
        hashes.append(_span_hashes(data[a:a + int(end[-1])], begin, end, _TABLE))
        done = upto
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), ends, first


def chained(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values, by the place of its first one."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out * BASE + hashes[i:n + i])
    return out
