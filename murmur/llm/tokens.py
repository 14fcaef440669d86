"""Token-id output: documents → token shards (wavelet matrices) → read back.

Documents are range-partitioned and sorted by id; each task tokenizes its
range and cuts it into shards of about ``SHARD_TOKENS`` tokens, one table row
per shard.  The shard files are a parquet table whose rows carry one
self-contained blob each, so Spark's commit protocol covers lost executors and
any file system.

A text is tokenized word by word: the tokenizer replaces white space by one
blank and drops it, so words are independent, and a table of the words met so
far (bounded, kept by the Python worker until it runs another step) saves most calls.  Words of plain
letters go to the library's model directly; every other word goes through the
whole tokenizer.

Defined cases: null text → only the end id; a null id sorts first and is kept;
repeated ids are separate documents in text order; a text longer than a shard
gets a shard of its own; an empty table gives no shard.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm import grams, wavelet
from murmur.llm.common import kept, small_batches, tidied
from murmur.session import scratch_path

SHARD_TOKENS = 1 << 20
SHARD_SCHEMA = "part int, seq int, n_docs int, n_tokens long, shard binary"
#: Words a worker remembers before it starts anew.
KNOWN_WORDS = 2_500_000


_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def split_tails(w: grams.Words) -> grams.Words:
    """Make the ASCII marks that end a word a word of their own where a letter a-z, A-Z or à-ÿ comes before them.

    The tokenizer cuts there too: its run of other characters starts after a
    letter and goes on to the white space.
    """
    solid = np.where(_MARK[w.raw], -1, np.arange(len(w.raw)))
    solid = np.maximum.accumulate(solid) + 1 if len(solid) else solid
    core = np.maximum(solid[w.end - 1], w.start)
    tail = np.flatnonzero((core < w.end) & (core > w.start))
    last = w.raw[core[tail] - 1]
    lead = w.raw[np.maximum(core[tail] - 2, w.start[tail])]
    folded = last | 32
    tail = tail[((folded >= 97) & (folded <= 122) & (last < 128)) | ((lead == 0xC3) & (last != 0x97) & (last != 0xB7) & (last >= 128))]
    start, end = np.insert(w.start, tail + 1, core[tail]), w.end.copy()
    end[tail] = core[tail]
    end = np.insert(end, tail + 1, w.end[tail])
    bounds = w.bounds + np.searchsorted(tail, w.bounds, "left")
    return grams.Words(w.first, w.rows, w.raw, start, end, bounds, grams.word_hash(w.raw, start, end))


class WordTokens:
    """Word hash → token ids, an open-addressing table over one pool of ids."""

    SLOT_BITS = 22

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        # Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.alphabet = "".join(self.alphabet[b] for b in range(256))
        self.kind = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(1 << self.SLOT_BITS, np.uint64)
        self.entry = np.zeros(1 << self.SLOT_BITS, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, self.kind)
        self.known = self.used = 0

    def encode_word(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "ɐ" and "İ" not in text and unicodedata.is_normalized("NFC", text):
            return [t.id for t in self.model.tokenize(text.lower().encode().decode("latin-1").translate(self.alphabet))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        slot = (h >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            k = self.key[slot]
            same = k == h[left]
            out[left[same]] = self.entry[slot[same]]
            go = ~same & (k != 0)
            left, slot = left[go], (slot[go] + 1) & ((1 << self.SLOT_BITS) - 1)
        return out

    def _insert(self, h: np.ndarray, ids: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        while len(h):
            free = self.key[slot] == 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.key[slot[put]], self.entry[slot[put]] = h[put], ids[put]
            rest = np.ones(len(h), bool)
            rest[put] = False
            h, ids, slot = h[rest], ids[rest], (slot[rest] + 1) & ((1 << self.SLOT_BITS) - 1)

    def learn(self, h: np.ndarray, words: list[bytes], lowered: bool) -> None:
        model = self.model.tokenize
        ids = [[t.id for t in model(w.decode())] if lowered and w.isalpha() else self.encode_word(w) for w in words]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((t for x in ids for t in x), self.kind, int(sizes.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while self.known + len(ids) > len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
            self.size = np.concatenate((self.size, np.zeros_like(self.size)))
        new = slice(self.known, self.known + len(ids))
        self.pool[self.used:self.used + len(flat)] = flat
        self.size[new] = sizes
        self.start[new] = self.used + np.cumsum(sizes) - sizes
        self._insert(h, np.arange(self.known, self.known + len(ids), dtype=np.int32))
        self.known += len(ids)
        self.used += len(flat)

    def encode(self, offsets: np.ndarray, raw: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(token ids, tokens per text) of texts i..j-1."""
        lowered = b"<|" not in raw[offsets[i]:offsets[j]].tobytes()   # special tokens are matched as written
        w = grams.block_words(offsets, raw, i, j, lowered, hashed=not lowered)
        w = split_tails(w) if lowered else w
        h = np.maximum(w.hash ^ np.uint64(0 if lowered else 0x5555555555555555), np.uint64(1))
        entry = self.find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            if self.known > KNOWN_WORDS:
                self.clear()
                new = np.arange(len(h))
            hashes, first = np.unique(h[new], return_index=True)
            spans = zip(w.start[new[first]].tolist(), w.end[new[first]].tolist())
            text = w.raw.tobytes()
            self.learn(hashes, [text[a:b] for a, b in spans], lowered)
            entry[new] = self.find(h[new])
        size = self.size[entry].astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.start[entry] - upto[:-1], size) + np.arange(upto[-1])
        return self.pool[at], np.diff(upto[w.bounds])


def _shard_writer(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(path, partial(WordTokens, path))
        bits = wavelet.bits_for(max(table.vocabulary, end_id + 1))
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            counts = np.concatenate(sizes)
            blob = wavelet.encode(np.concatenate(tokens), np.concatenate(ids), np.cumsum(counts), bits)
            row = pa.record_batch({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                                   "n_docs": pa.array([len(counts)], pa.int32()), "n_tokens": pa.array([held], pa.int64()),
                                   "shard": pa.array([blob], pa.binary())})
            seq, held = seq + 1, 0
            ids.clear(), sizes.clear(), tokens.clear()
            return row
        for batch in batches:
            offsets, raw = grams.string_buffers(batch.column(1))
            keys = batch.column(0).cast(pa.int64()).fill_null(wavelet.NULL_ID).to_numpy()
            for i, j in grams.blocks(offsets, min(grams.BLOCK, shard_tokens)):
                flat, size = table.encode(offsets, raw, i, j)
                ends = np.cumsum(size + 1)
                out = np.full(len(flat) + len(size), end_id, table.kind)
                body = np.ones(len(out), bool)
                body[ends - 1] = False
                out[body] = flat
                ids.append(keys[i:j]), sizes.append(size + 1), tokens.append(out)
                held += len(out)
                if held >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()
    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
                 shard_tokens: int = SHARD_TOKENS) -> None:
    """Tokenize ``docs`` in ascending id order and write the shard table to ``path``."""
    ordered = (docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
               .repartitionByRange("key").sortWithinPartitions("key", "text"))
    with small_batches(docs.sparkSession):
        (ordered.mapInArrow(partial(tidied, _shard_writer(tokenizer, end_id, shard_tokens), keep=tokenizer), SHARD_SCHEMA)
         .write.option("compression", "uncompressed").option("parquet.block.size", str(16 << 20)).parquet(path))


def _shard_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            shard = wavelet.WaveletMatrix(blob.as_py())
            tokens = shard.tokens().astype("<u4")
            ends = shard.doc_ends
            starts = np.concatenate(([0], ends[:-1]))
            crc = [zlib.crc32(tokens[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            keys = pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == wavelet.NULL_ID)
            yield pa.record_batch({"part": pa.array([part] * len(ends), pa.int32()), "seq": pa.array([seq] * len(ends), pa.int32()),
                                   "key": keys, "inside": pa.array(starts, pa.int64()),
                                   "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, decoded from the shards.

    ``start`` adds up three levels: shards before it in other tasks' ranges
    (one row per task), earlier shards of its task, and its place in the shard.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("part", (F.sum("n").over(before) - F.col("n")).alias("before_part"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    starts = (shards.select("part", "seq", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("before_shard"))
              .join(sums, "part"))
    rows = shards.select("part", "seq", "shard").mapInArrow(
        partial(tidied, _shard_reader), "part int, seq int, key long, inside long, n_tokens long, ids_crc32 long")
    return (rows.join(starts, ["part", "seq"])
            .select(F.col("key").alias(key), (F.col("before_part") + F.col("before_shard") + F.col("inside")).alias("start"),
                    "n_tokens", "ids_crc32"))


def token_table(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards to a fresh folder of the shared checkpoint folder and read every document back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-shards")
    write_shards(docs, path, tokenizer, end_id, key, text)
    return read_documents(spark, path, key)
