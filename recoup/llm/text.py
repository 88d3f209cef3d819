"""Words, hashes and word n-grams of a batch of texts, as flat numpy arrays.

A batch is cut into pieces of about a megabyte before any array is built, so the memory of a
task is bounded by the longest single text, not by the number of rows in an Arrow batch.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

#: A-Z to a-z, every other byte unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWER = np.frombuffer(LOWER, np.uint8)
#: Bytes of words: digits, letters, and every byte of a character outside ASCII.
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])

_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
#: Masks of the first k of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2^64 for i below n (at least)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE_BYTES + 256)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = out[0], out[1]
        if size <= 2 * PIECE_BYTES:  # tables for a single huge text are not kept
            _POWERS[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(batches: Iterable[pa.RecordBatch], column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``limit`` bytes; one row at least."""
    for batch in batches:
        col = batch.column(column)
        if not len(col):
            continue
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < len(col):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the offsets of its rows; null is empty."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """The words of a piece: hash and row of each, and the first word of each row (and the end)."""

    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray


def spans(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every run of member bytes; a run never crosses a row."""
    inside = np.frombuffer(raw.tobytes().translate(member.tobytes()), bool)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end


def count_words(col: pa.Array) -> np.ndarray:
    """Number of words of each row."""
    raw, offsets = flat(col)
    start, _ = spans(_LOWER[raw], offsets, _WORD)
    return np.diff(np.searchsorted(start, offsets))


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    p, inverse = powers(_P, len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:len(raw)], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def short_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, other than ``span_hash``: eight bytes at a time, which is quicker
    where most spans are short; those of over 64 bytes take the other way."""
    size = end - start
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:len(raw)] = raw
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    out = mix((eight[start] & _FIRST[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * np.uint64(_P)))
    long = np.flatnonzero(size > 64)
    if len(long):
        out[long] = span_hash(raw, start[long], end[long])
    more = np.flatnonzero((size > 8) & (size <= 64))
    for k in range(8, 64, 8):
        if not len(more):
            break
        out[more] = mix(out[more] * np.uint64(_Q) + (eight[start[more] + k] & _FIRST[np.minimum(size[more] - k, 8)]))
        more = more[size[more] > k + 8]
    return out


def words(col: pa.Array, hashed: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = span_hash) -> Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the rows, A-Z lower-cased."""
    raw, offsets = flat(col)
    raw = np.frombuffer(raw.tobytes().translate(LOWER), np.uint8)
    start, end = spans(raw, offsets, _WORD)
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return Words(hashed(raw, start, end), row, first, start, end)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes, rows ignored; shorter than the input by k - 1."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    q, inverse = powers(_Q, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * q[:len(h)], dtype=np.uint64, out=total[1:])
    n = len(h) - k + 1
    return mix((total[k:] - total[:n]) * inverse[:n] + np.uint64(k))


def held_out(key: object) -> bool:
    """Whether the key's row is held out of all training: crc32 of its text modulo 4 is 2."""
    return key is not None and zlib.crc32(str(key).encode()) % 4 == 2
