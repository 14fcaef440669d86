"""Stored tables that are read in part: key lookup and paging (P1, P4) and substring search.

*Clustered tables.*  Rows are range-partitioned and sorted by their key, one
file per range, with a Parquet Bloom filter on the key.  A list of the files'
key ranges is kept beside the table (one row per file), so a lookup opens only
the files whose range holds the key, and a page only those it needs; inside a
file row groups are pruned by the pushed predicate and the Bloom filter.

*Trigram index.*  Texts are stored in blocks; a posting table tells for every
trigram which blocks hold it.  A search reads only the blocks that hold all
trigrams of its term and checks the texts there, so the result is that of a
full scan.  Every position of a text starts a trigram (two pads follow its end), so a term
of one or two letters is the beginning of some.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Follows the end of a text in its last two trigrams.
PAD = "\u0000"
#: Characters that are cut into trigrams at a time, and the distinct trigrams a task holds before it sends them on.
PIECE, HELD = 1 << 20, 1 << 21
#: Bits of a code point.
BITS = 21


# ---------------------------------------------------------------- clustered tables

def save_clustered(df: DataFrame, path: str, key: str = "id", files: int = 16) -> None:
    """Write ``df`` sorted by ``key`` in files of disjoint ranges, and the list of ranges under ``path``-ranges."""
    spark = df.sparkSession
    (df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite")
       .option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path))
    stored = spark.read.schema(df.schema).parquet(path)
    ranges = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n"))
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}-ranges")


def _files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    whole = spark.read.parquet(path)
    return spark.read.schema(whole.schema).parquet(*names) if names else whole.where("false")


def lookup(spark: SparkSession, path: str, value, key: str = "id") -> DataFrame:
    """The rows of one key; opens the files whose range holds it."""
    ranges = spark.read.parquet(f"{path}-ranges").where((F.col("lo") <= F.lit(value)) & (F.col("hi") >= F.lit(value)))
    return _files(spark, path, [r.file for r in ranges.select("file").collect()]).where(F.col(key) == F.lit(value))


def has_key(spark: SparkSession, path: str, value, key: str = "id") -> DataFrame:
    """P1 existence: one row if the key is stored, none otherwise."""
    return lookup(spark, path, value, key).select(key).limit(1)


def page_after(spark: SparkSession, path: str, last, size: int = 100, key: str = "id") -> DataFrame:
    """The ``size`` rows after ``last`` in key order; opens the files that can hold them."""
    ranges = spark.read.parquet(f"{path}-ranges").where(F.col("hi") > F.lit(last))
    names, held = [], 0
    for r in ranges.orderBy("lo").limit(size + 1).collect():         # a file holds a row at least
        names.append(r.file)
        held += r.n if r.lo > last else 0                             # the file that holds ``last`` may have one row after it
        if held >= size:
            break
    return _files(spark, path, names).where(F.col(key) > F.lit(last)).orderBy(key).limit(size)


# ---------------------------------------------------------------- trigram index

def _pieces(texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    """Texts of about ``PIECE`` characters together, and where a trigram starts; a longer text comes in pieces that share two characters."""
    held, size = [], 0

    def done() -> tuple[str, np.ndarray]:
        ends = np.cumsum([len(t) for t in held])
        starts = np.ones(ends[-1], bool)
        starts[np.concatenate((ends - 1, ends - 2))] = False
        return "".join(held), starts
    for text in texts:
        text += PAD * 2
        for at in range(0, len(text) - 2, PIECE):
            held.append(text[at:at + PIECE + 2])
            size += len(held[-1])
            if size >= PIECE:
                yield done()
                held, size = [], 0
    if held:
        yield done()


def _trigrams(texts: list[str]) -> np.ndarray:
    """Distinct trigrams that start at each character of the texts, as numbers."""
    out = []
    for text, starts in _pieces(texts):
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        whole = c[:-2] << np.uint64(2 * BITS) | c[1:-1] << np.uint64(BITS) | c[2:]
        out.append(np.unique(whole[starts[:-2]]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram): trigrams of the lower-cased texts of this task, once per block and task unless they are very many."""
    held: dict[int, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for block, found in held.items():
            letters = np.stack([found >> np.uint64(BITS * k) & np.uint64((1 << BITS) - 1) for k in (2, 1, 0)], 1).astype("<u4")
            text = letters.tobytes().decode("utf-32-le")
            yield pa.record_batch({"block": pa.array([block] * len(found), pa.int32()),
                                   "gram": pa.array([text[i:i + 3] for i in range(0, len(text), 3)], pa.string())})
        held.clear()
    for batch in batches:
        own = batch.column(0).to_numpy()
        for block in np.unique(own).tolist():
            found = _trigrams(batch.column(1).filter(pa.array(own == block)).to_pylist())
            held[block] = np.union1d(held[block], found) if block in held else found
        if sum(map(len, held.values())) > HELD:
            yield from flush()
    yield from flush()


def save_searchable(rows: DataFrame, path: str, column: str, key: str = "id", blocks: int = 64) -> None:
    """Write ``rows`` in blocks of neighbouring keys, and the postings (trigram, block) under ``path``-grams."""
    spark = rows.sparkSession
    block = F.spark_partition_id().alias("block")
    rows.repartitionByRange(blocks, key).select("*", block).write.mode("overwrite").partitionBy("block").parquet(path)
    stored = spark.read.parquet(path)
    texts = stored.where(F.col(column).isNotNull()).select(F.col("block").cast("int").alias("block"), F.lower(column).alias("text"))
    grams = texts.mapInArrow(_gram_rows, "block int, gram string").distinct()
    grams.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite") \
         .option("parquet.bloom.filter.enabled#gram", "true").parquet(f"{path}-grams")


def blocks_with(spark: SparkSession, path: str, term: str) -> list[int]:
    """The blocks that hold every trigram of ``term``, or a trigram that begins with a shorter one."""
    term = term.lower()
    grams = spark.read.parquet(f"{path}-grams")
    if len(term) < 3:
        found = grams.where(F.col("gram").startswith(term)).select("block").distinct()
    else:
        own = sorted({term[i:i + 3] for i in range(len(term) - 2)})
        found = grams.where(F.col("gram").isin(own)).groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(own))
    return sorted(r.block for r in found.select("block").collect())


def search_stored(spark: SparkSession, path: str, column: str, term: str) -> DataFrame:
    """The rows whose ``column`` contains ``term`` in any case; reads the candidate blocks only."""
    rows = spark.read.parquet(path)
    if term:
        found = blocks_with(spark, path, term)
        folders = [f"{path}/block={b}" for b in found]
        rows = spark.read.schema(rows.schema).option("basePath", path).parquet(*folders) if found else rows.where("false")
    return rows.where(F.lower(F.col(column)).contains(term.lower())).drop("block")
