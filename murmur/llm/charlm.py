"""Character n-grams of text blocks and the hash-array language model (runs inside tasks).

A character is its code point (ASCII capitals folded, every ASCII digit 0, every
white space a blank).  An n-gram of up to six characters is a pair of numbers
(hi, lo), three code points of 21 bits in each, the last character lowest; a
text starts after order - 1 pads (0).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 21
PAD = 0
MOST_ORDER = 6
_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_FOLD[48:58] = 48
_FOLD[[0, 9, 10, 11, 12, 13, 160]] = 32


def classes(raw: np.ndarray) -> np.ndarray:
    """Folded code point per character of UTF-8 bytes."""
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp < 256, _FOLD[np.minimum(cp, 255)], cp).astype(_U)


def char_pieces(offsets: np.ndarray, raw: np.ndarray, limit: int, keep: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, classes, row per class) for pieces of about ``limit`` bytes.

    Every text is preceded by ``keep`` pads.  A text above the limit comes in
    several pieces, each led by the last ``keep`` classes of the one before;
    lead-in positions carry row -1.
    """
    from murmur.llm.grams import blocks
    for i, j in blocks(offsets, limit):
        buf = raw[offsets[i]:offsets[j]]
        if j == i + 1 and len(buf) > 2 * limit:
            lead, at = np.full(keep, PAD, np.uint64), 0
            while at < len(buf):
                end = min(at + limit, len(buf))
                while end < len(buf) and (buf[end] & 0xC0) == 0x80:
                    end += 1
                part = np.concatenate((lead, classes(buf[at:end])))
                row = np.zeros(len(part), np.int64)
                row[:keep] = -1
                yield i, 1, part, row
                lead, at = part[len(part) - keep:], end
            continue
        chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[offsets[i:j + 1] - offsets[i]]
        flat, size = classes(buf), np.diff(chars)
        if len(flat) != chars[-1]:                      # damaged UTF-8: text by text
            each = [classes(raw[offsets[k]:offsets[k + 1]]) for k in range(i, j)]
            flat, size = np.concatenate(each), np.array([len(x) for x in each])
        row = np.repeat(np.arange(j - i), size + keep)
        part = np.full(len(row), PAD, np.uint64)
        head = np.cumsum(size + keep) - size - keep
        body = np.ones(len(row), bool)
        body[(head[:, None] + np.arange(keep)).ravel()] = False
        part[body] = flat
        row[~body] = -1
        yield i, j - i, part, row


def grams_at(part: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of the n-gram that ends at each place (places before a full window hold shorter ones)."""
    out = [np.zeros(len(part), _U), np.zeros(len(part), _U)]
    for k in range(order):
        half = out[1 - k // 3]
        half[k:] |= part[:len(part) - k] << _U(BITS * (k % 3))
    return out[0], out[1]


def masks(order: int) -> tuple[int, int]:
    """Bits of (hi, lo) that an n-gram of ``order`` characters takes."""
    return (1 << BITS * max(order - 3, 0)) - 1, (1 << BITS * min(order, 3)) - 1


def without_last(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hi >> _U(BITS), lo >> _U(BITS) | (hi & _U((1 << BITS) - 1)) << _U(2 * BITS)


def hashed(hi: np.ndarray, lo: np.ndarray, order: int, salt: np.ndarray | int, weight: bool) -> np.ndarray:
    """Hash of an n-gram's probability, or of its back-off weight."""
    from murmur.llm.grams import mix
    return np.maximum(mix(mix(hi * _U(16) + _U(2 * order + weight) + salt) + lo), _U(1))


def parts_of(before: np.ndarray, last: np.ndarray, parts: int) -> np.ndarray:
    """Part of the model that knows what follows the two characters."""
    from murmur.llm.grams import mix
    return (mix(before << _U(BITS) | last) % _U(parts)).astype(np.int32)


def language_salt(lang: str) -> int:
    import zlib
    name = lang.encode()
    return (zlib.crc32(name) | zlib.crc32(name + b"#") << 32) & ~15


class HashModel:
    """Sorted 64-bit hashes with one number each, spread over an open-addressing table."""

    #: Keys that are placed at a time.
    STEP = 1 << 18

    def __init__(self, order: int, keys: np.ndarray, values: np.ndarray, unknown: int):
        """``keys`` are sorted: each goes to the slot of its top bits or the next one that is free, so slots stay in order as well."""
        self.order, self.unknown = order, unknown
        self.bits = max(10, (len(keys) * 5 // 4).bit_length())
        cuts = range(0, len(keys), self.STEP)                  # in steps: memory is little more than that of the table
        ahead = [int((self._slot(keys[a:a + self.STEP]) - np.arange(a, min(a + self.STEP, len(keys)))).max()) for a in cuts]
        size = max(1 << self.bits, max(ahead, default=0) + len(keys)) + 1           # the last slot stays free
        self.key = np.zeros(size, _U)
        self.value = np.zeros(size, np.int32)
        most = 0
        for a in cuts:
            at = np.arange(a, min(a + self.STEP, len(keys)))
            place = self._slot(keys[a:a + self.STEP]) - at
            place[0] = max(place[0], most)
            np.maximum.accumulate(place, out=place)
            most = int(place[-1])
            place += at
            self.key[place] = keys[a:a + self.STEP]
            self.value[place] = values[a:a + self.STEP]

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it is unknown."""
        slot = self._slot(h)
        k = self.key[slot]
        out = np.where(k == h, slot, -1)
        left = np.flatnonzero((k < h) & (k != 0))       # a larger one in its place: it is not there
        slot = slot[left]
        while len(left):
            slot = slot + 1
            k, own = self.key[slot], h[left]
            same = k == own
            out[left[same]] = slot[same]
            go = (k < own) & (k != 0)
            left, slot = left[go], slot[go]
        return out

    def logp(self, part: np.ndarray, salt: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Log-probability (as stored whole numbers) of the characters at ``places``, given the order - 1 before them."""
        out = np.zeros(len(places), np.int64)
        hi, lo = (x[places] for x in grams_at(part, self.order))
        salt, todo = salt[places], np.arange(len(places))
        for order in range(self.order, 0, -1):
            a, b = masks(order)
            hi, lo = hi & _U(a), lo & _U(b)
            at = self.find(hashed(hi, lo, order, salt, False))
            hit = at >= 0
            out[todo[hit]] += self.value[at[hit]]
            todo, hi, lo, salt = (x[~hit] for x in (todo, hi, lo, salt))
            if not len(todo):
                return out
            # weight of the context, if it was ever seen
            at = self.find(hashed(*without_last(hi, lo), order - 1, salt, True))
            out[todo] += np.where(at >= 0, self.value[at], 0)
        out[todo] += self.unknown
        return out
