"""Benchmark decontamination (DataFrame functions only).

Test items are cut into windows of ``N`` words (a shorter item is one window).
The set of normalised windows is hashed and broadcast, in blocks of at most
``BLOCK_WINDOWS`` rows, and every document's word windows are looked up in it
during the scan; each hit is verified by comparing the words themselves.  Only
hits leave the scan.

Words are runs of ASCII letters, digits and non-ASCII characters after A-Z are
lower-cased.  A document word inside an occurrence of any window is hit; a
document is contaminated when ``PERCENT`` % of its words or more are hit.

Defined cases: a null text has no words and no hits; items without words have
no window; items with equal windows all count; a null item id is not counted;
repeated rows are judged one by one; without documents the result is empty,
without items nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import packed, unpacked, written

N = 13
PERCENT = 5
#: Most windows in one broadcast (about 150 bytes each).
BLOCK_WINDOWS = 500_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INSIDE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Normalised words of a text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), BETWEEN), "")


def _hashes(size: int) -> str:
    """Hash of each window of ``size`` words, from the array ``wh`` of word hashes."""
    return (f"if(size(wh) >= {size}, transform(sequence(1, size(wh) - {size} + 1), i -> xxhash64(slice(wh, i, {size}), {size})),"
            " cast(array() as array<bigint>))")


def benchmark_windows(items: DataFrame, n: int = N, key: str = "item_id", text: str = "text") -> DataFrame:
    """(hash, size, window, items): distinct windows with the ids (as strings) of the items that have them."""
    w = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    w = w.withColumn("size", F.least(F.size("w"), F.lit(n))).withColumn("wh", F.expr("transform(w, x -> xxhash64(x))"))
    rows = w.select("item", "size", F.explode(F.expr(
        "transform(sequence(1, size(w) - size + 1), i -> struct(xxhash64(slice(wh, i, size), size) as hash,"
        " array_join(slice(w, i, size), ' ') as window))")).alias("x"))
    return rows.groupBy("x.hash", "size", "x.window").agg(F.collect_set("item").alias("items"))


def hit_rows(docs: DataFrame, items: DataFrame, n: int = N, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark, n_words, place, size, items): one row without place per document, and one per verified hit.

    ``place`` counts words from 0; ``mark`` tells rows that repeat a key apart.
    """
    windows = written(benchmark_windows(items, n), "windows")
    sizes = sorted(r[0] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect())   # at most n numbers
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    # a column of its own keeps the split from being repeated per use
    base = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), words(F.col(text)).alias("w"))
    base = base.withColumn("wh", F.expr("transform(w, x -> xxhash64(x))"))
    every = F.expr("concat(" + ", ".join(_hashes(s) for s in sizes) + ")") if sizes else F.expr("cast(array() as array<bigint>)")
    scan = base.select("key", "mark", "w", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(every).alias("k", "hash"))
    # windows of smaller sizes come first: a window's place follows those of all sizes before its own
    counts = [f"greatest(n_words - {s - 1}, 0L)" for s in sizes]
    aheads = ", ".join(" + ".join(["0L", *counts[:k]]) for k in range(max(1, len(sizes))))
    place = F.expr(f"k - array_max(filter(array({aheads}), a -> a <= k))")
    out = None
    for b in range(blocks):
        block = windows if blocks == 1 else windows.where(F.expr(f"pmod(hash, {blocks}) = {b}"))
        met = scan.join(F.broadcast(block.withColumnRenamed("size", "w_size")), "hash", "left")
        first = F.expr("k is null or k = 0") if b == 0 else F.lit(False)
        met = met.where(F.col("window").isNotNull() | first)
        met = met.select("key", "mark", "n_words", place.cast("long").alias("place"), "w_size", "window", "items", "w", first.alias("first"))
        ok = F.expr("window is not null and array_join(slice(w, cast(place as int) + 1, w_size), ' ') = window")
        hit = F.when(ok, F.struct(F.col("place").cast("long").alias("place"), F.col("w_size").alias("size"), F.col("items")))
        rows = met.select("key", "mark", "n_words", F.explode(F.array_compact(F.array(
            F.when(F.col("first"), F.struct(F.lit(None).cast("long").alias("place"), F.lit(None).cast("int").alias("size"),
                                            F.lit(None).cast("array<string>").alias("items"))), hit))).alias("h"))
        rows = written(rows.select("key", "mark", "n_words", "h.*"), "hits")
        out = rows if out is None else out.union(rows)
    return out


#: Words covered by the sorted spans (place, size), each counted once.
_COVERED = ("aggregate(sort_array(spans), named_struct('n', 0L, 'upto', 0L), (a, s) -> named_struct("
            "'n', a.n + greatest(s.place + s.size - greatest(s.place, a.upto), 0L), 'upto', greatest(a.upto, s.place + s.size)), a -> a.n)")


def contamination(docs: DataFrame, items: DataFrame, n: int = N, percent: int = PERCENT, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated, mark, spans) of every document."""
    rows = hit_rows(docs, items, n, key, text)
    hits = rows.where("place is not null").select("key", "mark", F.struct("place", "size").alias("span"), F.explode_outer("items").alias("item"))
    hits = hits.groupBy("key", "mark").agg(F.collect_set("span").alias("spans"), F.collect_set("item").alias("items"))
    each = rows.where("place is null").alias("d").join(hits.alias("h"), F.expr("d.key <=> h.key and d.mark = h.mark"), "left")
    each = each.select("d.key", "d.mark", "d.n_words", F.expr(f"coalesce({_COVERED}, 0L)").alias("n_hit"), "spans",
                       F.coalesce("h.items", F.expr("cast(array() as array<string>)")).alias("items"))
    return each.select(F.col("key").alias(key), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
                       F.expr(f"n_hit > 0 and 100 * n_hit >= {percent} * n_words").alias("contaminated"), "mark", "spans")


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = N, percent: int = PERCENT, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs, items, n, percent, key, text).where("contaminated").select(F.col(key).alias("bad_key"), F.col("mark").alias("bad_mark"))
    rows = docs.select(packed(docs), F.col(key).alias("key"), F.xxhash64(text).alias("mark"))
    return unpacked(rows.join(bad.distinct().hint("shuffle_hash"), F.expr("key <=> bad_key and mark = bad_mark"), "left_anti"), docs)


def remove_spans(docs: DataFrame, items: DataFrame, n: int = N, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents with the hit words and what follows them up to the next word cut from the text."""
    found = contamination(docs, items, n, 0, key, text).where("n_hit > 0") \
        .select(F.col(key).alias("hit_key"), F.col("mark").alias("hit_mark"),
                F.expr("array_distinct(flatten(transform(spans, s -> sequence(s.place + 1, s.place + s.size))))").alias("gone")) \
        .dropDuplicates(["hit_key", "hit_mark"])
    rows = docs.select(packed(docs), F.col(key).alias("key"), F.xxhash64(text).alias("mark"))
    got = rows.join(found, F.expr("key <=> hit_key and mark = hit_mark"), "left")
    whole = F.col("doc").getField(text)
    got = got.withColumn("hit_words", F.array_remove(F.split(whole, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")) \
             .withColumn("hit_gaps", F.split(whole, INSIDE, -1))
    cut = F.expr("concat(hit_gaps[0], array_join(transform(sequence(1L, cast(size(hit_words) as bigint)), i -> if(array_contains(gone, i), '',"
                 " concat(element_at(hit_words, cast(i as int)), element_at(hit_gaps, cast(i as int) + 1)))), ''))")
    return unpacked(got.withColumn("doc", F.col("doc").withField(f"`{text}`", F.when(F.col("gone").isNull(), whole).otherwise(cut))), docs)
