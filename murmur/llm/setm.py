"""Phrase collocations by relational mining (SETM): sorted occurrence relations, merge-joined and counted length by length.

Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words.  A
word is the hash of its bytes and its language, a phrase the hash of its two
halves: all words but the last, all words but the first.

*Relations.*  The occurrences of the frequent phrases of k words are kept per
block of texts, sorted by piece and position, as runs: a run of r words stands
for its r - k + 1 windows, each a frequent phrase.  Pieces never leave their
block, so joining two neighbouring occurrences of k words into one of k + 1 is
a merge inside the block, without a shuffle.  Every relation is written to the
shared folder and read by the two steps that follow it.

*One length.*  The windows of k + 1 words of a relation are counted (each task
sends on every distinct phrase once, Spark sums them) and groups below
``least`` go.  The occurrences of what is left form the next relation; they are
picked by a filter of two bits a phrase, of at most 2**``FILTER_BITS`` bits
whatever the corpus.  The filter passes every occurrence of a frequent phrase,
so counts are exact; the few it passes in error fail the next count.

*Scores.*  A phrase row carries the counts of all its beginnings and endings,
taken over from its halves by joins.  Scores are whole numbers in 38 digits.

Defined cases: a null text is empty; a null language is ``und`` and shares its
counts with documents that say so; repeated rows count again; a long text is
read in parts cut at piece ends; ties are ordered by phrase; columns other
than the two named ones are not read; an empty table, or one without frequent
phrases, gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm import grams
from murmur.llm.common import written

LEAST, LONGEST, TOP, COVER_PERCENT = 100, 5, 2000, 100
NO_LANG = "und"
#: Text bytes of a block of a relation.
TEXT_BLOCK = 1 << 20
#: Distinct groups a counting task holds before it sends them on.
HELD = 1 << 20
#: Bound of the broadcast filter: 2**28 bits are 32 MB.
FILTER_BITS = 28

_U = np.uint64
#: Kind of a byte: 0 part of a word, 1 blank, 2 end of a piece.
KIND = np.zeros(256, np.uint8)
KIND[[9, 32]] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


# ---------------------------------------------------------------- words

def _parts(offsets: np.ndarray, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, text bounds) of about ``TEXT_BLOCK`` bytes; a long text is cut where a piece ends."""
    for i, j in grams.blocks(offsets, TEXT_BLOCK):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * TEXT_BLOCK:
            yield raw[a:b], offsets[i:j + 1] - a
            continue
        while a < b:
            end = min(a + TEXT_BLOCK, b)
            while end < b:
                near = np.flatnonzero(KIND[raw[end:min(end + TEXT_BLOCK, b)]] == 2)
                if len(near):
                    end += int(near[0]) + 1
                    break
                end = min(end + TEXT_BLOCK, b)
            yield raw[a:end], np.array([0, end - a])
            a = end


def words(buf: np.ndarray, bounds: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end, key, piece) of every word; the piece numbers grow."""
    buf = grams.LOWER[buf]
    kind = KIND[buf]
    solid = np.concatenate(([False], kind == 0, [False]))
    edge = np.zeros(len(buf) + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    piece = np.cumsum(kind == 2)[start] + np.searchsorted(bounds, start, "right") if len(buf) else start
    name = lang.encode()
    salt = _U(zlib.crc32(name) << 32 | zlib.crc32(name + b"#"))
    return buf, start, end, grams.mix(grams.word_hash(buf, start, end) ^ salt), piece


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, bytes, bounds) of the parts of each language's texts."""
    for batch in batches:
        langs = batch.column(0).fill_null(NO_LANG).dictionary_encode()
        for c, lang in enumerate(langs.dictionary.to_pylist()):
            own = batch.column(1).take(pa.array(np.flatnonzero(langs.indices.to_numpy() == c)))
            for buf, bounds in _parts(*grams.string_buffers(own)):
                yield lang, buf, bounds


def _strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offs = np.concatenate(([0], np.cumsum(size)))
    data = buf[np.repeat(start - offs[:-1], size) + np.arange(offs[-1])]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, key, n) of this task's distinct words; the row without a word holds the number of all words."""
    held: dict[str, list] = {}

    def merged(lang: str) -> pa.RecordBatch:
        keys, counts, texts = (list(x) for x in zip(*held.pop(lang)))
        key, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        n = np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)
        return pa.record_batch({"lang": pa.array([lang] * len(key), pa.string()), "word": pa.concat_arrays(texts).take(pa.array(first)),
                                "key": pa.array(key.view(np.int64)), "n": pa.array(n)})
    total: dict[str, int] = {}
    for lang, buf, bounds in _texts(batches):
        buf, start, end, key, _ = words(buf, bounds, lang)
        total[lang] = total.get(lang, 0) + len(key)
        key, first, n = np.unique(key, return_index=True, return_counts=True)
        held.setdefault(lang, []).append((key, n, _strings(buf, start[first], end[first])))
        if sum(len(x[0]) for x in held[lang]) > HELD:
            yield merged(lang)
    for lang in list(held):
        yield merged(lang)
    yield pa.record_batch({"lang": pa.array(list(total), pa.string()), "word": pa.nulls(len(total), pa.string()),
                           "key": pa.array([0] * len(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})


# ---------------------------------------------------------------- filter

class KeyFilter:
    """Two bits a key; tells every key that was put in, and few others."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    @staticmethod
    def places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        shift = _U(64 - bits)
        return key >> shift, (key * _U(0x9E3779B97F4A7C15)) >> shift

    def has(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), bool)
        for p in self.places(key, self.bits):
            out &= (self.table[(p >> _U(6)).astype(np.int64)] >> (p & _U(63)) & _U(1)).astype(bool)
        return out


def _filter_rows(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = np.concatenate(KeyFilter.places(batch.column(0).to_numpy().view(_U), bits))
        yield pa.record_batch({"slot": pa.array((p >> _U(6)).astype(np.int64)), "mask": pa.array((_U(1) << (p & _U(63))).view(np.int64))})


def key_filter(keys: DataFrame, n: int):
    """A broadcast filter of the column ``key``: 16 bits a key, 2**``FILTER_BITS`` at most."""
    bits = min(max(13, (16 * n).bit_length()), FILTER_BITS)
    rows = keys.select("key").mapInArrow(partial(_filter_rows, bits), "slot long, mask long") \
               .groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(1 << bits - 6, _U)
    table[rows.column("slot").to_numpy()] = rows.column("mask").to_numpy().view(_U)
    return keys.sparkSession.sparkContext.broadcast(KeyFilter(bits, table))


# ---------------------------------------------------------------- relations

RELATION = "words binary, codes binary, wide boolean"


def _runs(key: np.ndarray, code: np.ndarray, hit: np.ndarray, k: int, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(keys, codes) of the runs of two or more windows of ``k`` words that hit; ``joined`` tells which window follows on the one before.

    ``code`` numbers words in ``key``.  Codes of the result number its own keys from 1; 0 ends a run.
    """
    at = np.flatnonzero(hit)
    if len(at) < 2:
        return None
    new = np.append(True, (np.diff(at) > 1) | ~joined[at[1:]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    first, size = at[first[size > 1]], size[size > 1] + k          # words of the run, and the 0 after it
    if not len(first):
        return None
    offs = np.concatenate(([0], np.cumsum(size)))
    place = np.repeat(first - offs[:-1], size) + np.arange(offs[-1])
    ends = offs[1:] - 1
    place[ends] = 0
    own = code[place]
    used, own = np.unique(own, return_inverse=True)
    own = own + 1
    own[ends] = 0
    return key[used], own


def _row(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for key, code in runs:
        wide = len(key) > 65535
        yield pa.record_batch({"words": pa.array([key.tobytes()], pa.binary()), "codes": pa.array([code.astype(np.uint32 if wide else np.uint16).tobytes()], pa.binary()),
                               "wide": pa.array([wide])})


def _first_relation(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of frequent words."""
    for lang, buf, bounds in _texts(batches):
        _, _, _, key, piece = words(buf, bounds, lang)
        if not len(key):
            continue
        key, code = np.unique(key, return_inverse=True)
        runs = _runs(key, code, shared.value.has(key)[code], 1, np.append(False, piece[1:] == piece[:-1]))
        yield from _row([runs] if runs else [])


def pair_key(pre: np.ndarray, suf: np.ndarray) -> np.ndarray:
    """Key of a phrase from those of its words but the last and but the first."""
    return grams.mix(pre * _U(0x2545F4914F6CDD1D) + suf)


def _windows(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, codes, key, whole) of each block: the key of the k words from each place on, and whether they are of one run."""
    for batch in batches:
        for vocabulary, codes, wide in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
            vocabulary = np.frombuffer(vocabulary.as_buffer(), _U)
            code = np.frombuffer(codes.as_buffer(), np.uint32 if wide else np.uint16).astype(np.int64)
            key, whole = vocabulary[np.maximum(code, 1) - 1], code > 0
            for _ in range(k - 1):
                key, whole = pair_key(key[:-1], key[1:]), whole[:-1] & whole[1:]
            yield vocabulary, code, key, whole


def _count(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pre, suf, n): this task's windows of k words."""
    held: list[tuple] = []

    def merged() -> pa.RecordBatch:
        key, pre, suf, n = (np.concatenate(x) for x in zip(*held))
        held.clear()
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        return pa.record_batch({"pre": pa.array(pre[first].view(np.int64)), "suf": pa.array(suf[first].view(np.int64)),
                                "n": pa.array(np.bincount(at, n, len(first)).astype(np.int64))})
    for _, _, part, whole in _windows(k - 1, batches):
        at = np.flatnonzero(whole[:-1] & whole[1:])
        key = pair_key(part[at], part[at + 1])
        key, first, n = np.unique(key, return_index=True, return_counts=True)
        held.append((key, part[at[first]], part[at[first] + 1], n))
        if sum(len(x[0]) for x in held) > HELD:
            yield merged()
    if held:
        yield merged()


def _next_relation(k: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of frequent phrases of k words."""
    for vocabulary, code, key, whole in _windows(k, batches):
        hit = np.zeros(len(key), bool)
        at = np.flatnonzero(whole)
        hit[at] = shared.value.has(key[at])
        runs = _runs(vocabulary, np.maximum(code, 1) - 1, hit, k, np.ones(len(key), bool))
        yield from _row([runs] if runs else [])


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = pair_key(batch.column(0).to_numpy().view(_U), batch.column(1).to_numpy().view(_U))
        yield pa.record_batch({"key": pa.array(key.view(np.int64)), "pre": batch.column(0), "suf": batch.column(1), "n": batch.column(2)})


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> list[DataFrame]:
    """Tables of frequent phrases: words (lang, word, key, n) first, then (key, pre, suf, n) for each length.

    The rows without a word hold each language's number of words.
    """
    texts = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    levels = [written(texts.mapInArrow(_count_words, "lang string, word string, key long, n long")
                      .groupBy("lang", "word", "key").agg(F.sum("n").alias("n")).where(f"word is null or n >= {least}"), "setm-words")]
    keys = levels[0].where("word is not null")
    relation = None
    for k in range(2, longest + 1):
        n = keys.count()
        if not n:
            break
        shared = key_filter(keys, n)
        relation = written(texts.mapInArrow(partial(_first_relation, shared), RELATION) if k == 2 else
                           relation.mapInArrow(partial(_next_relation, k - 1, shared), RELATION), "setm-relation")
        shared.unpersist()
        counts = relation.mapInArrow(partial(_count, k), "pre long, suf long, n long").groupBy("pre", "suf").agg(F.sum("n").alias("n"))
        keys = written(counts.where(f"n >= {least}").mapInArrow(_with_key, "key long, pre long, suf long, n long"), "setm-phrases")
        levels.append(keys)
    return levels


# ---------------------------------------------------------------- scores

def phrase_rows(levels: list[DataFrame]) -> DataFrame:
    """(lang, key, phrase, a, begin, rest): begin[i] and rest[i] count the first and the last i + 1 words."""
    rows = levels[0].where("word is not null").selectExpr("lang", "key", "word as phrase", "word as last", "n as a", "cast(array() as array<long>) as begin",
                                                          "cast(array() as array<long>) as rest")
    out = [rows.where("false")]
    for level in levels[1:]:
        p, s = rows.alias("p"), rows.select("key", "last", "a", "rest").alias("s")
        rows = level.alias("f").join(p, F.expr("f.pre = p.key")).join(s, F.expr("f.suf = s.key")).selectExpr(
            "p.lang", "f.key", "concat(p.phrase, ' ', s.last) as phrase", "s.last", "f.n as a", "concat(p.begin, array(p.a)) as begin",
            "concat(s.rest, array(s.a)) as rest")
        rows = written(rows, "setm-rows")
        out.append(rows)
    return reduce(DataFrame.unionByName, out)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = COVER_PERCENT, text: str = "text",
                 lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language."""
    levels = frequent_phrases(docs, least, longest, text, lang)
    rows = phrase_rows(levels)
    total = levels[0].where("word is null").select("lang", "n")
    # a phrase inside a longer one lies in one that is longer by a single word and at least as frequent
    halves = [level.select(F.col(c).alias("key"), "n") for level in levels[2:] for c in ("pre", "suf")]
    if halves:
        cover = reduce(DataFrame.union, halves).groupBy("key").agg(F.max("n").alias("longer"))
        rows = rows.join(cover, "key", "left").where(f"longer is null or 100 * longer < {percent} * a")
    cut = """array_min(transform(sequence(1, size(begin)), k -> struct(
        (cast(a as decimal(38,0)) * cast(n as decimal(38,0)) * 1000) div (cast(begin[k - 1] as decimal(38,0)) * cast(rest[size(begin) - k] as decimal(38,0))) as score,
        k, begin[k - 1] as l, rest[size(begin) - k] as r)))"""
    scored = rows.join(total, "lang").selectExpr("lang", "phrase", "a", "n", f"{cut} as cut") \
                 .selectExpr("lang", "phrase", "a", "cut.l as l", "cut.r as r", "n", "cut.score as score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
