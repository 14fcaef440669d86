"""Two-stage suffix sorting of a block of byte strings (runs inside tasks).

A suffix smaller than its successor is type S, any other type L.  Only the
type-S suffixes are sorted directly, by their first ``depth`` symbols; the
type-L suffixes are induced: buckets of equal first symbol are scanned in
ascending order, and every suffix met puts its type-L predecessor at the next
free place at the front of the predecessor's bucket.  Whole runs of a bucket
are induced at once.
"""

from __future__ import annotations

import numpy as np

#: Symbols per packed key: 9 bits each (0 ends a string, byte b is b + 1).
PACK = 7


def join(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, start of each string); every string is followed by symbol 0."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    start = np.cumsum(size + 1) - size - 1
    text = np.zeros(int(size.sum()) + len(strings), np.uint16)
    body = np.ones(len(text), bool)
    body[start + size] = False
    text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    return text, start


class Keys:
    """Keys of the ``PACK`` symbols at an offset from each position; what lies beyond the string's end reads as 0."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.n, self.depth = n, depth
        wide = np.zeros(n + depth + 2 * PACK, np.uint64)
        wide[:n] = text
        self.key = np.zeros(len(wide) - PACK, np.uint64)
        open_ = np.ones(len(self.key), np.uint64)       # 0 once the end of a string has been read
        for k in range(PACK):
            part = wide[k:k + len(self.key)]
            self.key = self.key << np.uint64(9) | part * open_
            open_ = open_ & (part != 0)
        self.end = np.minimum.accumulate(np.where(text == 0, np.arange(n), n)[::-1])[::-1]

    def digest(self, pos: np.ndarray) -> np.ndarray:
        """64-bit hash of the ``depth`` symbols from each position on."""
        out = np.zeros(len(pos), np.uint64)
        for c in _columns(self.depth):
            out = (out ^ self.at(pos, c)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def at(self, pos: np.ndarray, offset: int) -> np.ndarray:
        if offset == 0:
            return self.key[pos]
        return np.where(pos + offset <= self.end[pos], self.key[pos + offset], np.uint64(0))


def _columns(depth: int) -> list[int]:
    """Offsets of keys that together cover ``depth`` symbols exactly."""
    cols = list(range(0, depth - PACK + 1, PACK))
    return cols if cols[-1] + PACK == depth else cols + [depth - PACK]


def sort_directly(keys: Keys, at: np.ndarray) -> np.ndarray:
    """Positions ``at`` in order of their first ``depth`` symbols (up to the end of their string).

    After the first key, only groups of equal keys in which the digests of
    neighbours still differ are sorted by the next key.
    """
    at = at[np.argsort(keys.at(at, 0), kind="stable")]
    if len(at) == 0:
        return at
    k = keys.at(at, 0)
    first = np.append(True, k[1:] != k[:-1])
    todo = np.flatnonzero(~first | np.append(~first[1:], False))
    first = first[todo]
    digest = keys.digest(at[todo]) if len(todo) else None
    for c in _columns(keys.depth)[1:]:
        if not len(todo):
            break
        h = digest
        differ = np.append(False, h[1:] != h[:-1]) & ~first
        starts = np.flatnonzero(first)
        keep = np.repeat(np.logical_or.reduceat(differ, starts), np.diff(np.append(starts, len(todo))))
        todo, first, digest = todo[keep], first[keep], digest[keep]
        if not len(todo):
            break
        here, group = at[todo], np.cumsum(first)
        k = keys.at(here, c)
        order = np.lexsort((k, group))
        at[todo], k, digest = here[order], k[order], digest[order]
        first = first | np.append(True, k[1:] != k[:-1])
    return at


def suffix_order(text: np.ndarray, keys: Keys, wanted: np.ndarray | None = None) -> np.ndarray:
    """Positions in order of their suffixes, compared on ``depth`` symbols at least (up to the end of their string).

    With ``wanted`` (a flag per position) only these are ordered, and the few
    after them from which type-L ones are induced.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.zeros(n, np.int8)                         # sign of successor's first symbol minus own
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    step[-1] = -1
    where = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(where[::-1])[::-1]
    small = step[nearest] > 0                           # type S
    need = np.ones(n, bool) if wanted is None else wanted.copy()
    while wanted is not None:
        more = np.zeros(n, bool)
        more[1:] = need[:-1] & ~small[:-1]
        if not (more & ~need).any():
            break
        need |= more
    count = np.bincount(text[need], minlength=257)
    begin = np.concatenate(([0], np.cumsum(count)))
    s_at = sort_directly(keys, np.flatnonzero(small & need))
    out = np.full(int(count.sum()), -1, np.int64)
    s_count = np.bincount(text[s_at], minlength=257)
    s_begin = begin[1:] - s_count
    within = np.arange(len(s_at)) - np.repeat(np.cumsum(s_count) - s_count, s_count)
    out[np.repeat(s_begin, s_count) + within] = s_at
    head = begin[:-1].copy()

    def induce(met: np.ndarray) -> None:
        prev = met[met > 0] - 1
        prev = prev[~small[prev] & need[prev]]
        if not len(prev):
            return
        sym = text[prev]
        order = np.argsort(sym, kind="stable")
        prev, sym = prev[order], sym[order]
        first = np.flatnonzero(np.append(True, sym[1:] != sym[:-1]))
        size = np.diff(np.append(first, len(sym)))
        out[head[sym] + np.arange(len(sym)) - np.repeat(first, size)] = prev
        head[sym[first]] += size
    induce(np.array([n]))                               # the end of the text comes before all
    for c in np.flatnonzero(count):
        done = begin[c]
        while done < head[c]:
            stop = head[c]
            induce(out[done:stop])
            done = stop
        if s_count[c]:
            induce(out[s_begin[c]:begin[c + 1]])
    return out


def equal_neighbours(keys: Keys, order: np.ndarray) -> np.ndarray:
    """For each entry of ``order``, whether its common prefix with the entry before is ``depth`` symbols or more."""
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        same[1:] = True
        for c in _columns(keys.depth):
            k = keys.at(order, c)
            same[1:] &= k[1:] == k[:-1]
    return same
