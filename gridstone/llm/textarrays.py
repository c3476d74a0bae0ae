"""Words and shingles of whole Arrow string columns as numpy arrays, without a Python object for each word.

Texts are read from Arrow's own buffers, in blocks of a few MB (a longer text is a block of its own). A word's hash takes in
eight bytes at a time, each followed by a bijective mixing of the whole state; words over LONG bytes are hashed by BLAKE2b.
Equal words have equal hashes; two different ones, repetitive ones too, meet with a probability of about 2^-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
#: Bytes of words between ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of letters and digits; all bytes beyond ASCII count as letters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Bytes of a span from which on its hash is BLAKE2b's.
LONG = 128
#: The lowest 0 to 8 bytes of a 64-bit value.
_LOWEST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of runs of rows; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def spans(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of maximal runs of member bytes inside each text, and the first run of each text (n + 1 values)."""
    m = member[data]
    if not len(m):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    opens, closes = m.copy(), m.copy()
    opens[1:] &= ~m[:-1]
    closes[:-1] &= ~m[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(m))]
    opens[inner] = m[inner]
    closes[inner - 1] = m[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    n = ends - starts
    h = mix(n.astype(np.uint64) * _U(BASE))
    live = np.flatnonzero((n > 0) & (n <= LONG))
    for at in range(0, LONG, 8):
        if not len(live):
            break
        h[live] = mix(h[live] ^ (eight[starts[live] + at] & _LOWEST[np.minimum(n[live] - at, 8)]))
        live = live[n[live] > at + 8]
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]], digest_size=8).digest(), "little")
    return h


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` lower-cased (A-Z) words; of all its words if they are fewer."""
    for _, _, data, offs in blocks(texts):
        starts, ends, first = spans(data, offs, NOT_SPACE)
        h = span_hashes(LOWER[data], starts, ends)
        run = h.copy()
        for k in range(1, width):
            run[:len(h) - k] = mix(run[:len(h) - k] * _U(BASE) + h[k:])
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= width:
                yield np.unique(run[a:b - width + 1])
            elif b > a:
                x = h[a]
                for y in h[a + 1:b]:
                    x = mix(np.array([x], np.uint64) * _U(BASE) + np.array([y], np.uint64))[0]
                yield np.array([mix(np.array([x], np.uint64) + _U(int(b - a)))[0]], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
