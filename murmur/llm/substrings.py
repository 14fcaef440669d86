"""Removal of byte strings that an earlier document already has, by suffix sorting.

Every byte covered by a ``LENGTH``-byte string that also starts in a document
with a smaller id goes; strings never cross documents and are judged on the
input.

1. *Anchors.*  In each run of ``LENGTH`` bytes the ``GRAM``-byte substring with
   the smallest hash is its anchor, so equal runs have equal anchors.  Anchors
   that only one text has are dropped; the rest name the places worth sorting.
2. *Strings.*  Around each such anchor a text yields the bytes of all runs that
   chose it (at most 2 * LENGTH - GRAM).  Equal strings are collapsed to one row
   with the smallest document id, first inside the task.
3. *Suffix sort.*  Strings are dealt out by anchor.  A block of whole anchors
   gets a suffix order by two-stage sorting (``suffixes``); neighbours whose
   common prefix reaches ``LENGTH`` are equal runs, and the smallest id of such
   a class decides for all of them.  An anchor with a single distinct string has
   no neighbours and is left out.
4. *Spans.*  Every string of a document with a larger id than the string's
   smallest goes whole; the document with the smallest loses the runs whose
   class has a smaller id.  Spans are joined per document and cut from the text.

A text equal to that of a smaller id is removed whole without sorting.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` stay whole;
a null id is compared with nothing and its row stays whole; rows that repeat an
id do not remove from each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm import grams, suffixes
from murmur.llm.common import release, written

LENGTH, GRAM = 50, 16
RUNS = LENGTH - GRAM + 1                                # grams of a run, and the most runs one anchor can have
#: Anchors a task gathers before it sends them on, bytes of a suffix block.
FLUSH, BLOCK = 1 << 20, 1 << 21
#: Bytes of texts whose anchors are found at once.
PIECE = 1 << 18
#: Bits of an anchor that travel.
TOKEN = np.uint64((1 << 48) - 1)
_U = np.uint64
_NONE = np.uint32(0xFFFFFFFF)


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``w`` neighbours, by doubling."""
    n, have = len(x) - w + 1, 1
    while have < w:
        step = min(have, w - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x[:n]


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, anchor, chosen) of the anchors of texts laid end to end in ``buf``.

    ``offs`` has the bounds of the texts.  ``chosen`` has the smallest order key
    of each run, shifted by RUNS - 1 and 0 where a run would cross texts.
    """
    if len(buf) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.uint32)
    prefix = grams.prefix_hash(buf)
    n = len(buf) - GRAM + 1
    h = (prefix[GRAM:] - prefix[:n]) * grams.inverse_powers(n)
    h = grams.mix(h)
    order = (h >> _U(32)).astype(np.uint32)
    order[order == _NONE] -= 1
    order[order == 0] = 1
    room = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(buf))    # bytes left in the text
    order[room[:n] < GRAM] = _NONE
    low = _slide(order, RUNS, np.minimum)
    low[room[:len(low)] < LENGTH] = 0
    chosen = np.zeros(len(low) + 2 * (RUNS - 1), np.uint32)
    chosen[RUNS - 1:RUNS - 1 + len(low)] = low
    pos = np.flatnonzero((_slide(chosen, RUNS, np.maximum) == order) & (order != _NONE))
    return pos, h[pos], chosen


def run_extent(pos: np.ndarray, h: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first run, runs) that chose each anchor; they lie side by side."""
    order = (h >> _U(32)).astype(np.uint32)
    order[order == _NONE] -= 1
    order[order == 0] = 1
    first, runs = np.full(len(pos), -1), np.zeros(len(pos), np.int64)
    for t in range(RUNS):
        mine = chosen[pos + t] == order
        first = np.where(mine & (first < 0), t, first)
        runs += mine
    return pos - (RUNS - 1) + first, runs


def _by_text(offsets: np.ndarray, raw: np.ndarray) -> Iterator[tuple]:
    """(first row, rows, block bytes, bounds, row of each anchor, position, anchor, chosen) per block."""
    for i, j in grams.blocks(offsets, PIECE):
        buf, offs = raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        pos, token, chosen = anchors(buf, offs)
        row = np.searchsorted(offs, pos, "right") - 1
        yield i, j - i, buf, offs, row, pos, token, chosen


def _anchor_rows(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, tokens, texts, counts): anchors of each text once, dealt out by anchor.

    Bytes per bucket: tokens grouped by text, the texts' ids, tokens per text.
    An anchor that several texts of this task have is known to be shared; it
    goes on once under text 0, and is told to its own texts through a row whose
    bucket follows the text (marked by a negative number).
    """
    tokens, texts, held = [], [], 0

    def pack(bucket: np.ndarray, tok: np.ndarray, text: np.ndarray, sign: int) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((text, bucket))
        bucket, tok, text = bucket[order], tok[order], text[order]
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else [0]
        out = {"bucket": [], "tokens": [], "texts": [], "counts": []}
        for a, b in zip(edge[:-1], edge[1:]):
            name, size = np.unique(text[a:b], return_counts=True)
            out["bucket"].append(int(bucket[a]) if sign > 0 else -1 - int(bucket[a]))
            out["tokens"].append(tok[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            out["texts"].append(name.tobytes()), out["counts"].append(size.astype("<u4").tobytes())
        yield pa.record_batch({"bucket": pa.array(out["bucket"], pa.int32()),
                               **{c: pa.array(out[c], pa.binary()) for c in ("tokens", "texts", "counts")}})

    def flush() -> Iterator[pa.RecordBatch]:
        tok, text = np.concatenate(tokens), np.concatenate(texts)
        order = np.lexsort((text, tok))
        tok, text = tok[order], text[order]
        fresh = np.append(True, (tok[1:] != tok[:-1]) | (text[1:] != text[:-1]))
        tok, text = tok[fresh], text[fresh]
        first = np.append(True, tok[1:] != tok[:-1])
        size = np.diff(np.append(np.flatnonzero(first), len(tok)))
        alone = np.repeat(size == 1, size)
        known = tok[first][size > 1]
        every = np.concatenate((tok[alone], known))
        yield from pack((every % _U(parts)).astype(np.int64), every, np.concatenate((text[alone], np.zeros(len(known), np.int64))), 1)
        yield from pack((text[~alone].view(_U) % _U(parts)).astype(np.int64), tok[~alone], text[~alone], -1)
    for batch in batches:
        ids = batch.column(0).to_numpy()
        offsets, raw = grams.string_buffers(batch.column(1))
        for i, _, _, _, row, _, token, _ in _by_text(offsets, raw):
            tokens.append(token & TOKEN), texts.append(ids[i + row])
            held += len(token)
            if held >= FLUSH:
                yield from flush()
                tokens, texts, held = [], [], 0
    if held:
        yield from flush()


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, token): the anchors of a text that another text has too, from one partition's buckets."""
    toks, texts, told = [], [], []
    for batch in batches:
        for bucket, tok, text, count in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
            raw = np.frombuffer(tok.as_buffer(), np.uint8).reshape(-1, 6)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :6] = raw
            toks.append(wide.view("<u8").ravel())
            texts.append(np.repeat(np.frombuffer(text.as_buffer(), np.int64), np.frombuffer(count.as_buffer(), "<u4")))
            told.append(np.full(len(raw), bucket < 0))
    if not toks:
        return
    tok, text, told = np.concatenate(toks), np.concatenate(texts), np.concatenate(told)
    order = np.lexsort((text, tok))
    tok, text, told = tok[order], text[order], told[order]
    plain = ~told
    t, x = tok[plain], text[plain]
    first = np.append(True, t[1:] != t[:-1]) if len(t) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    several = np.zeros(len(starts), bool)
    if len(starts):                                     # two texts, or the mark of a task that met two
        several = (np.minimum.reduceat(x, starts) != np.maximum.reduceat(x, starts)) | np.logical_or.reduceat(x == 0, starts)
    keep = np.repeat(several, np.diff(np.append(starts, len(t)))) & (x != 0)
    tok, text = np.concatenate((t[keep], tok[told])), np.concatenate((x[keep], text[told]))
    for k in range(0, len(tok), 1 << 16):
        yield pa.record_batch({"cls": pa.array(text[k:k + (1 << 16)]), "token": pa.array(tok[k:k + (1 << 16)].view(np.int64))})


def _zip_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [packer.compress(x.as_buffer()) for x in batch.column(2)]
        yield pa.record_batch({"doc": batch.column(0), "cls": batch.column(1), "packed": pa.array(packed, pa.binary())})


def _unzip(col: pa.Array) -> pa.Array:
    opener = zstandard.ZstdDecompressor()
    return pa.array([opener.decompress(x.as_buffer()) for x in col], pa.binary())


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, cls, first, runs, token, string, bytes): strings around shared anchors.

    The bytes go along with the first row of a string in this task, under the
    smallest id met so far; a later, smaller id brings them again.
    """
    met: dict[int, int] = {}
    for batch in batches:
        docs, classes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        wanted = batch.column(3)
        for k in range(0, len(docs), 256):
            offsets, raw = grams.string_buffers(_unzip(batch.column(2).slice(k, 256)))
            for i, n, buf, offs, row, pos, anchor, chosen in _by_text(offsets, raw):
                token = anchor & TOKEN
                keep = np.zeros(len(token), bool)
                edge = np.searchsorted(row, np.arange(n + 1), "left")
                for r in range(n):
                    a, b = edge[r], edge[r + 1]
                    shared = np.sort(wanted[k + i + r].values.to_numpy().view(_U))
                    at = np.minimum(np.searchsorted(shared, token[a:b]), len(shared) - 1)
                    keep[a:b] = shared[at] == token[a:b]
                row, token = row[keep], token[keep]
                if not len(row):
                    continue
                first, runs = run_extent(pos[keep], anchor[keep], chosen)
                end = first + runs + LENGTH - 1
                h = grams.mix(grams.span_hash(grams.prefix_hash(buf), first, end) + runs.astype(_U)).view(np.int64)
                doc = docs[k + i + row]
                text = buf.tobytes()
                body = []
                for d, x, a, b in zip(doc.tolist(), h.tolist(), first.tolist(), end.tolist()):
                    if met.get(x, d + 1) > d:
                        met[x] = d
                        body.append(text[a:b])
                    else:
                        body.append(None)
                if len(met) > FLUSH:
                    met.clear()
                yield pa.record_batch({"doc": pa.array(doc), "cls": pa.array(classes[k + i + row]),
                                       "first": pa.array((first - offs[row]).astype(np.int64)), "runs": pa.array(runs.astype(np.int64)),
                                       "token": pa.array(token.view(np.int64)), "string": pa.array(h), "body": pa.array(body, pa.binary())})


def _sort_block(strings: list[bytes], low: np.ndarray) -> np.ndarray:
    """Per string, bit k set when its run k equals a run of a string with a smaller id."""
    text, start = suffixes.join(strings)
    keys = suffixes.Keys(text, LENGTH)
    whole = keys.end - np.arange(len(text)) >= LENGTH
    order = suffixes.suffix_order(text, keys, whole)
    order = order[whole[order]]
    same = suffixes.equal_neighbours(keys, order)
    owner = np.searchsorted(start, order, "right") - 1
    heads = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(low[owner], heads), np.diff(np.append(heads, len(order)))) if len(order) else low[:0]
    hit = least < low[owner]
    out = np.zeros(len(strings), np.int64)
    np.bitwise_or.at(out, owner[hit], np.int64(1) << (order[hit] - start[owner[hit]]))
    return out


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(string, low, cut) of every distinct string; rows come in order of (token, string, doc)."""
    names, lows, bodies, tokens, size = [], [], [], [], 0

    def flush() -> pa.RecordBatch:
        low, token = np.array(lows, np.int64), np.array(tokens, np.int64)
        first = np.append(True, token[1:] != token[:-1])
        count = np.diff(np.append(np.flatnonzero(first), len(token)))
        partner = np.flatnonzero(np.repeat(count > 1, count))
        cut = np.zeros(len(low), np.int64)
        if len(partner):
            cut[partner] = _sort_block([bodies[k] for k in partner.tolist()], low[partner])
        return pa.record_batch({"string": pa.array(names, pa.int64()), "low": pa.array(low), "cut": pa.array(cut)})
    for batch in batches:
        body = batch.column(3)
        for k, (t, s, d) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if tokens and t == tokens[-1] and s == names[-1]:
                continue                                # a larger id of the same string
            if size >= BLOCK and t != tokens[-1]:
                yield flush()
                names, lows, bodies, tokens, size = [], [], [], [], 0
            x = body[k].as_py()
            names.append(s), lows.append(d), bodies.append(x), tokens.append(t)
            size += len(x) + 1
    if names:
        yield flush()


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        texts = _unzip(batch.column(2))
        for text, spans in zip(texts, batch.column(3)):
            raw = np.frombuffer(text.as_buffer(), np.uint8)
            first, cut = (np.array(x.to_pylist(), np.int64) for x in spans.values.flatten()[:2])
            runs = np.zeros(len(raw) + 1, np.int8)
            for t in range(RUNS):
                runs[first[(cut >> t) & 1 == 1] + t] = 1
            gone = np.cumsum(runs, dtype=np.int64)
            gone[LENGTH:] -= gone[:-LENGTH].copy()
            gone = gone[:len(raw)] > 0
            edges = np.diff(gone.astype(np.int8), prepend=0) == 1
            rows.append((int(gone.sum()), int(edges.sum()), raw[~gone].tobytes()))
        yield pa.record_batch({"doc": batch.column(0), "cls": batch.column(1), "n_removed": pa.array([r[0] for r in rows], pa.int64()),
                               "n_spans": pa.array([r[1] for r in rows], pa.int64()), "kept": pa.array([r[2] for r in rows], pa.binary())})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut_texts(batches):
        yield pa.record_batch({**{c: batch.column(c) for c in ("doc", "cls", "n_removed", "n_spans")},
                               "sha": pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("kept")], pa.string())})


def _plan(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with class keys, leaders, leaders' packed texts with their spans)."""
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b"")).alias("body"))
    base = base.withColumn("cls", F.xxhash64("body")).withColumn("cls", F.when(F.col("cls") == 0, F.lit(1)).otherwise(F.col("cls")))
    rows = written(base.select("doc", "cls", F.xxhash64("body", F.lit(7)).alias("cls2"), F.octet_length("body").cast("long").alias("n_bytes"),
                               F.sha2("body", 256).alias("sha")), "substrings-rows")
    leaders = written(rows.where(F.col("doc").isNotNull() & (F.col("n_bytes") >= LENGTH)).groupBy("cls", "cls2", "n_bytes")
                      .agg(F.min("doc").alias("doc")), "substrings-leaders")
    long_enough = base.where(F.col("doc").isNotNull() & (F.octet_length("body") >= LENGTH))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packets = long_enough.select("cls", "body").mapInArrow(partial(_anchor_rows, 4 * parts),
                                                           "bucket int, tokens binary, texts binary, counts binary")
    shared = packets.repartition(parts, "bucket").mapInArrow(_shared_anchors, "cls long, token long")
    shared = shared.groupBy("cls").agg(F.collect_list("token").alias("tokens"))
    wanted = written(leaders.select("doc", "cls").join(shared, "cls"), "substrings-anchors")
    release(spark)

    packed = long_enough.select("doc", "cls", "body").mapInArrow(_zip_texts, "doc long, cls long, packed binary")
    texts = wanted.hint("shuffle_hash").join(packed, ["doc", "cls"]).select("doc", "cls", "packed", "tokens")
    found = written(texts.mapInArrow(_strings, "doc long, cls long, first long, runs long, token long, string long, body binary"),
                    "substrings-strings")
    release(spark)
    order = (found.where("body is not null").select("token", "string", "doc", "body")
             .repartition(parts, "token").sortWithinPartitions("token", "string", "doc"))
    verdict = written(order.mapInArrow(_verdicts, "string long, low long, cut long"), "substrings-verdicts")
    release(spark)
    hits = found.select("doc", "cls", "first", "runs", "string").join(verdict, "string") \
                .withColumn("cut", F.when(F.col("doc") > F.col("low"), F.expr("shiftleft(1L, cast(runs as int)) - 1")).otherwise(F.col("cut")))
    spans = hits.where("cut <> 0").groupBy("doc", "cls").agg(F.collect_list(F.struct("first", "cut")).alias("spans"))
    cut = spans.hint("shuffle_hash").join(packed, ["doc", "cls"]).select("doc", "cls", "packed", "spans")
    return rows, leaders, cut


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows, leaders, cut = _plan(docs, key, text)
    done = written(cut.mapInArrow(_digests, "doc long, cls long, n_removed long, n_spans long, sha string"), "substrings-cuts")
    lead = leaders.withColumnRenamed("doc", "lead")
    out = rows.alias("r").join(lead, ["cls", "cls2", "n_bytes"], "left") \
              .join(done.distinct().alias("c"), F.expr("r.doc = c.doc and r.cls = c.cls"), "left")
    copy = F.expr("r.doc > lead")
    pick = lambda whole, part, plain: F.when(copy, whole).otherwise(F.coalesce(part, plain))
    return out.select(F.col("r.doc").alias(key), "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).alias("n_removed"),
                      pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
                      pick(F.sha2(F.lit(""), 256), F.col("c.sha"), F.col("r.sha")).alias("kept_sha256"))


def kept_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kept): the remaining bytes of every row whose text loses some but not all; others keep or lose it whole."""
    _, _, cut = _plan(docs, key, text)
    return cut.mapInArrow(_cut_texts, "doc long, cls long, n_removed long, n_spans long, kept binary") \
              .select(F.col("doc").alias(key), "n_removed", "n_spans", "kept")
