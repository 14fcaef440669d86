"""Wavelet matrix over token ids: one self-contained compressed blob per shard.

The matrix holds one bit plane per bit of the vocabulary, highest bit first.
Plane ``l`` lists bit ``l`` of the tokens after they were stably parted by all
higher planes (zeros first).  A plane is cut into chunks of ``CHUNK`` bytes;
each chunk is compressed on its own and the directory keeps the number of ones
before it, so access, rank and select touch one chunk per plane.

Blob layout (little endian): magic ``WVMX``, version, bits, reserved u16,
n_tokens u64, n_docs u32, n_chunks u32; document ids i64, document ends u64;
zeros per plane u64; per plane and chunk: ones before u32, byte offset u64,
byte length u32 (top bit set: stored raw); then the chunk bytes.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"WVMX"
CHUNK = 1 << 15
_HEAD = struct.Struct("<4sBBHQII")
_RAW = 1 << 31
#: Written for a document without an id.
NULL_ID = -(1 << 63)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def encode(tokens: np.ndarray, doc_ids: np.ndarray, doc_ends: np.ndarray, bits: int) -> bytes:
    """Blob of one shard; ``doc_ends[k]`` is the position after document k's last token."""
    n = len(tokens)
    n_chunks = -(-n // (8 * CHUNK))
    zeros = np.zeros(bits, "<u8")
    ones = np.zeros((bits, n_chunks), "<u4")
    offset = np.zeros((bits, n_chunks), "<u8")
    length = np.zeros((bits, n_chunks), "<u4")
    body, at = [], 0
    packer = zstandard.ZstdCompressor(level=1)
    x = tokens
    for l in range(bits):
        one = (x & x.dtype.type(1 << (bits - 1 - l))) != 0
        plane = np.packbits(one)
        seen = 0
        for c in range(n_chunks):
            raw = plane[c * CHUNK:(c + 1) * CHUNK].tobytes()
            ones[l, c] = seen
            seen += int(np.bitwise_count(np.frombuffer(raw, np.uint8)).sum())
            packed = packer.compress(raw)
            keep = raw if len(packed) >= len(raw) else packed
            offset[l, c], length[l, c] = at, len(keep) | (_RAW if keep is raw else 0)
            body.append(keep)
            at += len(keep)
        left = x[~one]
        zeros[l] = len(left)
        x = np.concatenate((left, x[one]))
    head = _HEAD.pack(MAGIC, 1, bits, 0, n, len(doc_ids), n_chunks)
    return b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), np.asarray(doc_ends, "<u8").tobytes(), zeros.tobytes(),
                     ones.tobytes(), offset.tobytes(), length.tobytes(), *body])


class WaveletMatrix:
    """Token access, counting and occurrence lookup over one blob."""

    def __init__(self, blob: bytes):
        magic, version, self.bits, _, self.n, n_docs, self.n_chunks = _HEAD.unpack_from(blob)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out
        self.doc_ids = take("<i8", n_docs)
        self.doc_ends = take("<u8", n_docs).astype(np.int64)
        self.zeros = take("<u8", self.bits).astype(np.int64)
        grid = (self.bits, self.n_chunks)
        self._ones = take("<u4", self.bits * self.n_chunks).reshape(grid)
        self._offset = take("<u8", self.bits * self.n_chunks).reshape(grid)
        self._length = take("<u4", self.bits * self.n_chunks).reshape(grid)
        self._body, self._blob = at, blob
        self._unpacker = zstandard.ZstdDecompressor()
        self._chunk = lru_cache(maxsize=64)(self._load)

    def _load(self, plane: int, chunk: int) -> np.ndarray:
        start, size = self._body + int(self._offset[plane, chunk]), int(self._length[plane, chunk])
        raw = self._blob[start:start + (size & ~_RAW)]
        if not size & _RAW:
            raw = self._unpacker.decompress(raw, max_output_size=CHUNK)
        return np.frombuffer(raw, np.uint8)

    def _bit(self, plane: int, i: int) -> int:
        chunk, inside = divmod(i, 8 * CHUNK)
        return int(self._chunk(plane, chunk)[inside >> 3]) >> (7 - (inside & 7)) & 1

    def _ones_before(self, plane: int, i: int) -> int:
        if i == 0:
            return 0
        chunk, inside = divmod(i - 1, 8 * CHUNK)
        data, inside = self._chunk(plane, chunk), inside + 1
        n = int(self._ones[plane, chunk]) + int(np.bitwise_count(data[:inside >> 3]).sum())
        if inside & 7:
            n += (int(data[inside >> 3]) >> (8 - (inside & 7))).bit_count()
        return n

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        starts = self._ones[plane].astype(np.int64)
        if not bit:
            starts = np.arange(self.n_chunks, dtype=np.int64) * 8 * CHUNK - starts
        chunk = int(np.searchsorted(starts, k, "right")) - 1
        count = min(self.n - chunk * 8 * CHUNK, 8 * CHUNK)
        bits = np.unpackbits(self._chunk(plane, chunk), count=count)
        return chunk * 8 * CHUNK + int(np.flatnonzero(bits == bit)[k - int(starts[chunk])])

    def access(self, i: int) -> int:
        """The token at position i."""
        value = 0
        for l in range(self.bits):
            bit = self._bit(l, i)
            value = value << 1 | bit
            ones = self._ones_before(l, i)
            i = int(self.zeros[l]) + ones if bit else i - ones
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for l in range(self.bits):
            a, b = self._ones_before(l, start), self._ones_before(l, end)
            if token >> (self.bits - 1 - l) & 1:
                start, end = int(self.zeros[l]) + a, int(self.zeros[l]) + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in positions start..end-1."""
        end = self.n if end is None else end
        if token >> self.bits or end <= start:
            return 0
        a, b = self._range(token, start, end)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token; -1 when there are fewer."""
        if token >> self.bits:
            return -1
        a, b = self._range(token, 0, self.n)
        if k >= b - a:
            return -1
        i = a + k
        for l in range(self.bits - 1, -1, -1):
            if token >> (self.bits - 1 - l) & 1:
                i = self._select_bit(l, 1, i - int(self.zeros[l]))
            else:
                i = self._select_bit(l, 0, i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens in order (planes undone from the lowest up)."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        y = np.zeros(self.n, kind)
        for l in range(self.bits - 1, -1, -1):
            plane = [self._load(l, c) for c in range(self.n_chunks)]
            one = np.unpackbits(np.concatenate(plane), count=self.n).view(bool) if plane else np.zeros(0, bool)
            z = int(self.zeros[l])
            out = np.empty_like(y)
            out[~one] = y[:z]
            y[z:] |= kind(1 << (self.bits - 1 - l))
            out[one] = y[z:]
            y = out
        return y

    def document(self, k: int) -> np.ndarray:
        """Tokens of the k-th document of the shard, by access."""
        start = int(self.doc_ends[k - 1]) if k else 0
        return np.array([self.access(i) for i in range(start, int(self.doc_ends[k]))], np.uint32)
