"""Quality rules with a language-model verdict.

Base counts come from the words and lines of a text.  The verdict is the
perplexity under a modified Kneser-Ney model of character n-grams, one per
language, counted by Spark over every document; a document is kept when its
log-perplexity lies in the band of its language.  The log-probability of a text
is shared out among its characters other than symbols: runs of symbols are easy
to foresee once junk is part of the corpus, and would else look like good text.

*Model.*  Tasks count n-grams of ``ORDER`` characters per block and send each
distinct one on once; Spark sums them, derives the lower orders' continuation
counts, the discounts (from counts of counts) and the back-off weights with
joins and aggregates.  N-grams of four characters or more that were seen once
are not stored and their share goes to the back-off weight, so a text is not
judged by what it alone brought into the model.  Six characters reach across a
blank into the word before, so word order counts.

The model is a table of (part, hash, number) sorted by hash; numbers are
millionths, so sums are exact.  A part holds what follows certain pairs of
characters, and what every part needs (single characters and pairs) lies in a
part of its own.  Blocks of parts of about ``BLOCK_ROWS`` rows are broadcast one after the
other; each pass over the texts scores the characters whose two predecessors
belong to the block.  The order is the same at every size and the verdicts do
not depend on the number of blocks.

*Bands.*  Per language, the median of the log-perplexity over documents that
pass the base rules, less ``BELOW`` and plus ``ABOVE`` robust deviations (1.4826
times the median absolute deviation), at least ``LEAST`` either way.  Medians are exact over
bins of ``BIN``, found by aggregates, so reruns agree.

Defined cases: a null or empty text has no words and fails the base rules; a
null language is a language of its own; repeated rows are judged one by one and
alike; a text of any length is read in pieces; further columns, whatever their
names, are carried along by ``keep`` and not read otherwise; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm import charlm, grams
from murmur.llm.common import release, tidied, written

ORDER = 6
#: Order from which on n-grams seen once are not stored.
CUT_FROM = 4
#: Model rows (12 bytes each) that are broadcast at a time, and the parts that blocks are made of.
BLOCK_ROWS, PARTS = 6_500_000, 512
COMMON = -1
MILLION = 1_000_000
#: Robust deviations below and above the median that are kept (copies lie low, foreign and shuffled texts high), at least ``LEAST``.
BELOW, ABOVE, LEAST, BIN = 12.0, 3.0, 0.1, 0.002
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Characters that count as symbols (fixed value).
SYMBOLS = b"#*$%&|<>"
#: Distinct n-grams a counting task holds before it sends them on.
HELD = 1 << 21
#: Bytes of a piece that is counted, and of one that is scored.
PIECE, SCORED = 1 << 19, 1 << 16

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


# ---------------------------------------------------------------- counting

def _merge(hi: list[np.ndarray], lo: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hi, lo, n = np.concatenate(hi), np.concatenate(lo), np.concatenate(counts)
    order = np.lexsort((lo, hi))
    hi, lo, n = hi[order], lo[order], n[order]
    first = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))) if len(hi) else np.zeros(0, np.int64)
    return hi[first], lo[first], np.add.reduceat(n, first) if len(first) else n


def _distinct(part: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, n) of the n-grams that end at the places where ``ends`` is set.

    A piece of text has few different characters: numbered among themselves an
    n-gram is one number, and numbers are sorted without an index.
    """
    seen = np.zeros(1 << charlm.BITS, bool)
    seen[part] = True
    letters = np.flatnonzero(seen).astype(np.uint64)
    bits = max(int(len(letters) - 1).bit_length(), 1)
    if bits * order > 64:                               # a script of very many characters
        hi, lo = (x[ends] for x in charlm.grams_at(part, order))
        _, first, n = np.unique(grams.mix(grams.mix(hi) + lo), return_index=True, return_counts=True)
        return hi[first], lo[first], n
    number = np.zeros(1 << charlm.BITS, np.uint64)
    number[letters.astype(np.int64)] = np.arange(len(letters), dtype=np.uint64)
    code = number[part]
    key = code.copy()
    for k in range(1, order):
        key[k:] |= code[:-k] << np.uint64(bits * k)
    key = np.sort(key[ends])
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    key = key[first]
    halves = [np.zeros(len(key), np.uint64), np.zeros(len(key), np.uint64)]
    for k in range(order):
        own = letters[(key >> np.uint64(bits * k) & np.uint64((1 << bits) - 1)).astype(np.int64)]
        halves[1 - k // 3] |= own << np.uint64(charlm.BITS * (k % 3))
    return halves[0], halves[1], n


def _packed(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted n-grams and their counts, character by character in as few bytes as each needs: neighbours are alike, so this compresses well."""
    one = np.uint64((1 << charlm.BITS) - 1)
    cols = [half >> np.uint64(charlm.BITS * k) & one for half in (hi, lo) for k in (2, 1, 0)] + [n.astype(np.uint64)]
    kinds = [next(w for w in (1, 2, 4, 8) if w == 8 or int(c.max()) < 1 << 8 * w) for c in cols]
    return bytes(kinds) + b"".join(c.astype(f"<u{w}").tobytes() for c, w in zip(cols, kinds))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = list(blob[:7])
    size, at, cols = (len(blob) - 7) // sum(kinds), 7, []
    for w in kinds:
        cols.append(np.frombuffer(blob, f"<u{w}", size, at).astype(np.uint64))
        at += w * size
    a, b = np.uint64(charlm.BITS), np.uint64(2 * charlm.BITS)
    return cols[0] << b | cols[1] << a | cols[2], cols[3] << b | cols[4] << a | cols[5], cols[6].astype(np.int64)


def _count(order: int, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, grams): n-grams of the highest order in this task's texts with their counts, dealt out by hash."""
    held: dict[str | None, tuple[list, list, list]] = {}

    def flush():
        for lang, box in held.items():
            if not box[0]:
                continue
            hi, lo, n = _merge(*box)
            own = (grams.mix(grams.mix(hi) + lo) % np.uint64(buckets)).astype(np.int64)
            order_of = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order_of], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cuts)).tolist()
            each = [order_of[cuts[b]:cuts[b + 1]] for b in used]
            yield pa.record_batch({"lang": pa.array([lang] * len(used), pa.string()), "bucket": pa.array(used, pa.int32()),
                                   "grams": pa.array([_packed(hi[x], lo[x], n[x]) for x in each], pa.binary())})
        held.clear()
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        code = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False)
        for c, lang in enumerate(names.dictionary.to_pylist() + [None]):
            mine = np.flatnonzero(code == c)
            if not len(mine):
                continue
            box = held.setdefault(lang, ([], [], []))
            offsets, raw = grams.string_buffers(batch.column(1).take(pa.array(mine)))
            for _, _, part, row in charlm.char_pieces(offsets, raw, PIECE, order - 1):
                for have, new in zip(box, _distinct(part, row >= 0, order)):
                    have.append(new)
                if sum(map(len, box[0])) > HELD // 2:
                    for have, new in zip(box, _merge(*box)):
                        have[:] = [new]
        if sum(len(k) for box in held.values() for k in box[0]) > HELD:
            yield from flush()
    yield from flush()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, hi, lo, n): the sums of each (lang, bucket), which come one after the other."""
    now, held = None, ([], [], [])

    def done() -> pa.RecordBatch:
        hi, lo, n = _merge(*held)
        for have in held:
            have.clear()
        return pa.record_batch({"lang": pa.array([now[0]], pa.string()).take(pa.array(np.zeros(len(hi), np.int64))), "hi": pa.array(hi.view(np.int64)),
                                "lo": pa.array(lo.view(np.int64)), "n": pa.array(n)})
    for batch in batches:
        for lang, bucket, blob in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if now != (lang, bucket) and held[0]:
                yield done()
            now = lang, bucket
            for have, new in zip(held, _unpacked(blob)):
                have.append(new)
            if sum(map(len, held[0])) > HELD and len(held[0]) > 8:
                for have, new in zip(held, _merge(*held)):
                    have[:] = [new]
    if held[0]:
        yield done()


def ngram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(lang, hi, lo, n) over all documents; a bucket of n-grams is one of as many as the session has shuffle partitions, 64 at least."""
    buckets = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.mapInArrow(partial(tidied, partial(_count, order, buckets)), "lang string, bucket int, grams binary")
    return rows.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(partial(tidied, _added), "lang string, hi long, lo long, n long")


def kneser_ney(counts: DataFrame, order: int, cut_from: int = CUT_FROM) -> DataFrame:
    """(lang, order, hi, lo, weight, value): log-probability of every n-gram that is stored, and back-off weight of every context."""
    bits, low = charlm.BITS, (1 << charlm.BITS) - 1
    level = {order: counts.selectExpr("lang", "hi", "lo", "n as c")}
    for k in range(order - 1, 0, -1):                   # continuation counts: kinds of characters before it
        a, b = charlm.masks(k)
        level[k] = level[k + 1].selectExpr("lang", f"hi & {a}L as hi", f"lo & {b}L as lo").groupBy("lang", "hi", "lo").agg(F.count("*").alias("c"))
    every = None
    for k, rows in level.items():
        rows = rows.selectExpr("lang", f"{k} as order", "hi", "lo", "c")
        every = rows if every is None else every.union(rows)
    every = written(every, "quality-counts")
    release(every.sparkSession)
    every = every.selectExpr("*", f"shiftright(hi, {bits}) as chi", f"shiftright(lo, {bits}) | shiftleft(hi & {low}L, {2 * bits}) as clo")
    tally = every.groupBy("lang", "order").agg(*[F.sum((F.col("c") == r).cast("double")).alias(f"n{r}") for r in (1, 2, 3, 4)])
    y = "n1 / (n1 + 2 * n2)"
    tally = tally.selectExpr("lang", "order", *[
        f"case when n1 > 0 and n{r} > 0 then greatest(least({r} - {r + 1} * {y} * n{r + 1} / n{r}, {r}), 0.1D) else {r} * 0.5D end as d{r}"
        for r in (1, 2, 3)])
    disc = every.join(F.broadcast(tally), ["lang", "order"]) \
                .selectExpr("lang", "order", "hi", "lo", "chi", "clo", "c", "case c when 1 then d1 when 2 then d2 else d3 end as d",
                            f"order < {cut_from} or c > 1 as stored")
    context = disc.groupBy("lang", "order", "chi", "clo").agg(F.sum("c").alias("total"), F.sum(F.expr("if(stored, d, c)")).alias("held"))
    parts = disc.alias("g").join(context.alias("x"), ["lang", "order", "chi", "clo"]) \
        .selectExpr("lang", "order", "hi", "lo", "stored", "if(stored, (c - d) / total, 0D) as own", "held / total as share")
    parts = written(parts, "quality-parts")
    release(every.sparkSession)
    lower = parts.where("order = 1").selectExpr("lang", "hi", "lo", "stored", f"own + share / {1 << bits} as p")
    out = lower.selectExpr("lang", "1 as order", "hi", "lo", "stored", "p")
    for k in range(2, order + 1):
        a, b = charlm.masks(k - 1)
        lower = parts.where(F.col("order") == k).alias("g").join(lower.alias("s"), F.expr(f"g.lang = s.lang and (g.hi & {a}L) = s.hi and (g.lo & {b}L) = s.lo")) \
                     .selectExpr("g.lang", "g.hi", "g.lo", "g.stored", "own + share * p as p")
        lower = written(lower, "quality-level")         # else the next levels would join it again
        out = out.union(lower.selectExpr("lang", f"{k} as order", "hi", "lo", "stored", "p"))
    grams_ = out.where("stored").selectExpr("lang", "order", "hi", "lo", "false as weight", "ln(p) as value")
    weights = context.selectExpr("lang", "order - 1 as order", "chi as hi", "clo as lo", "true as weight", "ln(held / total) as value").where("value < 0")
    return grams_.union(weights)


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        salt = np.array([charlm.language_salt(x) for x in batch.column(0).to_pylist()], np.uint64)
        order = batch.column(1).to_numpy()
        hi, lo = (batch.column(c).to_numpy().view(np.uint64) for c in (2, 3))
        weight = batch.column(4).to_numpy(zero_copy_only=False)
        h, part = np.zeros(len(hi), np.uint64), np.full(len(hi), COMMON, np.int32)
        for k in np.unique(order).tolist():
            for w in (False, True):
                at = np.flatnonzero((order == k) & (weight == w))
                h[at] = charlm.hashed(hi[at], lo[at], k, salt[at], w)
                if k + w > 2:                           # two characters known before the one foreseen
                    own = (hi[at], lo[at]) if w else charlm.without_last(hi[at], lo[at])
                    one = np.uint64((1 << charlm.BITS) - 1)
                    part[at] = charlm.parts_of(own[1] >> np.uint64(charlm.BITS) & one, own[1] & one, PARTS)
        yield pa.record_batch({"part": pa.array(part), "hash": pa.array(h.view(np.int64)), "value": batch.column(5)})


def fit(docs: DataFrame, order: int = ORDER, cut_from: int = CUT_FROM) -> DataFrame:
    """(part, hash, value): the model, sorted by part and hash."""
    counts = written(ngram_counts(docs, order), "quality-ngrams")
    release(docs.sparkSession)                          # the shuffles of one step are gone before the next one writes its own
    rows = kneser_ney(counts, order, cut_from).selectExpr("lang", "cast(order as int) as order", "hi", "lo", "weight",
                                                          f"cast(round(value * {MILLION}) as int) as value")
    rows = rows.mapInArrow(partial(tidied, _hash_rows), "part int, hash long, value int").repartitionByRange("part", "hash").sortWithinPartitions("part", "hash")
    table = written(rows, "quality-model")
    release(docs.sparkSession)
    return table


def blocks(table: DataFrame, most_rows: int = BLOCK_ROWS) -> list[list[int]]:
    """Parts of the model dealt out to blocks of about ``most_rows`` rows with the common part; one row per part reaches the driver."""
    size = {r.part: r.n for r in table.groupBy("part").agg(F.count("*").alias("n")).collect()}
    room = max(most_rows - size.pop(COMMON, 0), 1)
    out, held = [[]], 0
    for part in range(PARTS):
        n = size.get(part, 0)
        if out[-1] and held + n > room:
            out.append([])
            held = 0
        out[-1].append(part)
        held += n
    return out


# ---------------------------------------------------------------- scoring

def base_counts(offsets: np.ndarray, raw: np.ndarray, i: int, j: int) -> dict[str, np.ndarray]:
    """Word, symbol, line and repeat counts of texts i..j-1."""
    w = grams.block_words(offsets, raw, i, j, lower=False)
    offs = offsets[i:j + 1] - offsets[i]
    n_words = np.diff(w.bounds)
    solid = ~grams.SPACE[w.raw] & ((w.raw & 0xC0) != 0x80)
    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[offs])
    repeat = np.zeros(j - i, np.int64)
    h, row = w.hash, np.repeat(np.arange(j - i), n_words)
    if len(h) >= 3:
        tri = grams.shingle_hash(h, 3)
        inside = row[2:] == row[:-2]
        at = np.flatnonzero(inside)
        both = grams.mix(tri[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros(len(h), bool)
        for k in range(3):
            hit[at[twice] + k] = True
        repeat = np.bincount(row[hit], minlength=j - i)
    dup = np.zeros(j - i, np.int64)
    text = w.raw.tobytes()
    for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        if text.find(b"\n", a, b) >= 0:
            lines = [x for x in text[a:b].split(b"\n") if x.strip()]
            dup[k] = len(lines) - len(set(lines))
    return {"n_words": n_words, "word_chars": per_text(solid), "n_symbols": per_text(_SYMBOL[w.raw]), "n_dup_lines": dup,
            "n_repeat_words": repeat}


class _Block:
    """A block of the model on its way to the workers: it travels as sorted hashes and numbers, and arrives as (table, flags of its parts)."""

    def __init__(self, order: int, keys: np.ndarray, values: np.ndarray, own: list[int]):
        self.content = order, keys, values, own

    def __reduce__(self):
        return _arrived, self.content


def _arrived(order: int, keys: np.ndarray, values: np.ndarray, own: list[int]) -> tuple[charlm.HashModel, np.ndarray]:
    """What a worker keeps of a block: the sorted arrays go once the table holds them."""
    flags = np.zeros(PARTS, bool)
    flags[own] = True
    return charlm.HashModel(order, keys, values, -round(np.log(1 << charlm.BITS) * MILLION)), flags


def _block(order: int, rows: pa.Table, own: list[int]) -> _Block:
    """The rows (hash, value) sorted by hash, one of each; takes little more memory than the rows do."""
    keys, values = rows.column("hash").to_numpy().view(np.uint64), rows.column("value").to_numpy()
    at = np.argsort(keys, kind="stable")
    keys, values = keys[at], values[at]
    del at
    first = np.append(True, keys[1:] != keys[:-1])[:len(keys)]
    return _Block(order, keys, values, own) if first.all() else _Block(order, keys[first], values[first], own)


def _totals(order: int, shared, langs: list[str], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of the block's characters, number of characters) of each text."""
    model, own_part = shared.value
    offsets, raw = grams.string_buffers(texts)
    salts = {x: charlm.language_salt(x) for x in set(langs)}
    salt = np.array([salts[x] for x in langs], np.uint64)
    total, chars = np.zeros(len(langs), np.int64), np.zeros(len(langs), np.int64)
    for i, n, part, row in charlm.char_pieces(offsets, raw, SCORED, order - 1):
        body = row >= 0
        chars[i:i + n] += np.bincount(row[body], minlength=n)
        if not own_part.all():
            body[2:] &= own_part[charlm.parts_of(part[:-2], part[1:-1], PARTS)]
        places = np.flatnonzero(body)
        p = model.logp(part, salt[i + np.maximum(row, 0)], places)
        order_of = np.concatenate(([0], np.cumsum(p)))
        edge = np.searchsorted(row[places], np.arange(n + 1))
        total[i:i + n] += order_of[edge[1:]] - order_of[edge[:-1]]
    return total, chars


def _score(order: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with base counts, their hash, and what the first block knows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total, chars = _totals(order, shared, batch.column(1).to_pylist(), batch.column(2))
        offsets, raw = grams.string_buffers(batch.column(2))
        cols = [base_counts(offsets, raw, i, j) for i, j in grams.blocks(offsets)]
        merged = {c: np.concatenate([x[c] for x in cols]) for c in cols[0]}
        plain = np.maximum(chars - merged["n_symbols"], 1)
        yield pa.record_batch({"row": batch.column(0), "lang": batch.column(1), **{c: pa.array(v.astype(np.int64)) for c, v in merged.items()},
                               "plain": pa.array(plain), "total": pa.array(total), "mark": batch.column(3)})


def _more(order: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, lang, more): what another block knows."""
    for batch in batches:
        total, _ = _totals(order, shared, batch.column(0).to_pylist(), batch.column(1))
        yield pa.record_batch({"mark": batch.column(2), "lang": batch.column(0), "more": pa.array(total)})


def scores(docs: DataFrame, table: DataFrame, order: int, most_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, lang, base counts, log_ppl) of every document; docs has (row, lang, text), and ``row`` is carried along."""
    sc = docs.sparkSession.sparkContext
    dealt = blocks(table, most_rows)
    mark = F.coalesce(F.sha2("text", 256), F.lit("")) if len(dealt) > 1 else F.lit("")
    docs = docs.select("row", "lang", "text", mark.alias("mark"))
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, plain long, total long"
    schema = T.StructType([docs.schema["row"], *T.StructType.fromDDL(f"lang string, {counts}, mark string").fields])
    out, more = None, []
    for own in dealt:
        shared = sc.broadcast(_block(order, table.where(F.col("part").isin(COMMON, *own)).select("hash", "value").toArrow(), own))
        release(docs.sparkSession)                      # the block is on its way: the driver need not keep the room that collecting it took
        if out is None:
            out = written(docs.mapInArrow(partial(tidied, partial(_score, order, shared)), schema), "quality-scores")
        else:
            each = docs.select("lang", "text", "mark").mapInArrow(partial(tidied, partial(_more, order, shared)), "mark string, lang string, more long")
            more.append(written(each.groupBy("mark", "lang").agg(F.max("more").alias("more")), "quality-more"))    # equal texts score alike
        shared.destroy()                                # the driver's copy too: what was scored is written
    if more:
        rest = reduce(DataFrame.union, more).groupBy("mark", "lang").agg(F.sum("more").alias("more"))
        out = out.join(rest, ["mark", "lang"]).withColumn("total", F.col("total") + F.col("more"))
    return out.select("row", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      (-F.col("total") / MILLION / F.col("plain")).alias("log_ppl"))


def _median(rows: DataFrame, value: str) -> DataFrame:
    """(lang, value): the bin that holds the middle document."""
    bins = rows.groupBy("lang", value).agg(F.count("*").alias("n"))
    run = Window.partitionBy("lang").orderBy(value)
    whole = Window.partitionBy("lang")
    return (bins.withColumn("upto", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("all", F.sum("n").over(whole)).where("2 * upto >= all")
            .groupBy("lang").agg(F.min(value).alias(value)))


def bands(scored: DataFrame, below: float = BELOW, above: float = ABOVE, least: float = LEAST) -> DataFrame:
    """(lang, low, high): log-perplexity band of each language."""
    good = scored.where("not base_failed").selectExpr("lang", f"cast(round(log_ppl / {BIN}) as long) as bin")
    mid = _median(good, "bin").withColumnRenamed("bin", "mid")
    away = good.join(F.broadcast(mid), "lang").select("lang", F.abs(F.col("bin") - F.col("mid")).alias("away"))
    mad = _median(away, "away")
    centre, spread = F.col("mid") * BIN, F.col("away") * (1.4826 * BIN)
    return mid.join(mad, "lang").select("lang", (centre - F.greatest(below * spread, F.lit(least))).alias("low"),
                                        (centre + F.greatest(above * spread, F.lit(least))).alias("high"))


def judged(docs: DataFrame, text: str, lang: str, carried: list[str], order: int = ORDER, most_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, base counts, base_failed, log_ppl, kept): ``row`` is a struct of the carried columns."""
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("none")).alias("lang"),
                       F.col(text).alias("text"))
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    scored = scores(docs, fit(docs.select("lang", "text"), order), order, most_rows).withColumn("base_failed", failed)
    band = bands(scored)
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return scored.join(F.broadcast(band), "lang", "left").withColumn("kept", ~F.col("base_failed") & inside)       # one row per language


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, most_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, base counts, base_failed, log_ppl, kept) of every document."""
    rows = judged(docs, text, lang, [key], order, most_rows)
    return rows.select(F.col("row")[key].alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ppl", "kept")


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, most_rows: int = BLOCK_ROWS) -> DataFrame:
    """The documents that are kept, with all their columns; they pass through the scoring as they are, so no text is shuffled."""
    return judged(docs, text, lang, docs.columns, order, most_rows).where("kept") \
        .select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
