"""Vectorised word and shingle hashing over Arrow string buffers (runs inside tasks).

A column is cut into blocks of whole texts of about ``BLOCK`` bytes, so the
scratch arrays stay small however many rows a batch has.  All arithmetic is on
unsigned 64-bit integers and wraps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random 64-bit weight per byte value, the same in every process.
WEIGHT = np.random.Generator(np.random.PCG64(20240117)).integers(1, 1 << 64, 256, dtype=np.uint64)

_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_powers["up"]) <= n:
        size = max(n + 1, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            step = np.full(size, base, _U)
            step[0] = 1
            _powers[name] = np.cumprod(step, dtype=_U)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the word."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary array; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts add up to about ``limit`` bytes (a longer text alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of weighted bytes; ``span_hash`` turns two of them into the hash of a span."""
    up, _ = _power(len(values))
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(WEIGHT[values] * up[:len(values)], out=out[1:])
    return out


def inverse_powers(n: int) -> np.ndarray:
    """Factors that turn differences of prefix sums at 0..n-1 into span hashes."""
    return _power(n)[1][:n]


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _power(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


@dataclass
class Words:
    """Words of the texts ``first``.. of a block: ``row`` is relative to ``first``, spans to ``raw``."""

    first: int
    rows: int
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray       # rows + 1 positions into the word arrays
    hash: np.ndarray


def word_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(span_hash(prefix_hash(buf), start, end) + (end - start).astype(_U))


def block_words(offsets: np.ndarray, raw: np.ndarray, i: int, j: int, lower: bool = True, hashed: bool = True) -> Words:
    """Words (runs of bytes other than ASCII white space) of texts i..j-1, with their hashes if asked for."""
    buf = raw[offsets[i]:offsets[j]]
    offs = offsets[i:j + 1] - offsets[i]
    if lower:
        buf = LOWER[buf]
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.empty(len(buf), bool)
    after = np.empty(len(buf), bool)
    if len(buf):
        before[0] = False
        before[1:] = solid[:-1]
        after[-1] = False
        after[:-1] = solid[1:]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    bounds = np.searchsorted(start, offs, "left")
    h = word_hash(buf, start, end) if hashed else np.zeros(0, _U)
    return Words(i, j - i, buf, start, end, bounds, h)


def shingle_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes (empty when there are fewer)."""
    if len(words) < n:
        return np.zeros(0, _U)
    out = np.zeros(len(words) - n + 1, _U)
    for k in range(n):
        out = out * _U(0x2545F4914F6CDD1D) + words[k:len(words) - n + 1 + k]
    return mix(out)
