"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source gets a share of the budget by its weight; a target above
``copies`` times the source's size is cut there and the excess is shared again
by weight among the others until none is above.  Documents are shuffled inside
their source (md5 of the id), each copy of a document gets a virtual finish
time - words of its source up to and including it, over the source's target -
and the copies are taken in global order of finish time until the budget is
used up.

No task ever holds a whole source: the running sum inside a source is split
into hash-range buckets whose totals give each bucket its offset, and the cut
of the global order is found by three narrowing aggregates (whole units of
finish time, fine slots of the one unit that is cut, rows of the one slot).

Defined cases: null text or no words → size 0, never taken; a null source is a
source of its own, last in order; repeated ids are separate rows; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import n_words, packed, unpacked, written

#: Slots one unit of finish time is divided into when the cut is searched.
SLOTS = 16384
#: Hex digits of the shuffle hash that name a bucket of a source.
BUCKET_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), copies: int = 3,
                   budget: int | None = None) -> DataFrame:
    """(source, source_size, target): one row per source.

    ``sizes`` has (source, size).  Sources in code-point order, null last,
    take the weights in turn.  The windows below have no partition key; they
    run over one row per distinct source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("rn", F.row_number().over(by_name))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("rn") - 1) % len(weights) + 1).cast("long")
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * copies)
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rn"))
    total = F.lit(budget).cast("long") if budget is not None else F.sum("source_size").over(every)
    per = (per.withColumn("left", total - F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, 0)) + F.col("cap"))
              .withColumn("w_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("level", F.col("left").cast("double") / F.col("w_left").cast("double"))
              .withColumn("open", F.col("cap").cast("double") > F.col("weight") * F.col("level"))
              .withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True)
                          .over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
              .withColumn("target", F.when(F.col("open"), F.col("weight") * F.col("level"))
                          .otherwise(F.col("cap").cast("double"))))
    return per.select("source", "source_size", "target")


def _queue(docs: DataFrame, weights, copies, budget, key, text, source) -> DataFrame:
    """One row per document: key, size, source_size, target, hash, cum (words of its source up to it)."""
    sized = written(docs.select(F.col(key).alias("key"), F.xxhash64(text, source).alias("mark"), F.col(source).alias("source"),
                                n_words(F.col(text)).alias("size"),
                                F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("hash")), "mix-sizes")
    targets = source_targets(sized, weights, copies, budget)
    rows = (sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
            .select("d.key", "d.mark", "d.size", "d.hash", "t.source_size", "t.target",
                    F.coalesce(F.concat(F.lit("="), F.col("d.source")), F.lit("null")).alias("queue"),
                    F.substring("d.hash", 1, BUCKET_DIGITS).alias("bucket")))
    sums = rows.groupBy("queue", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sums.withColumn("offset", F.sum("n").over(before) - F.col("n")).drop("n")
    inside = (Window.partitionBy("queue", "bucket").orderBy("hash", "key", "size")
              .rowsBetween(Window.unboundedPreceding, 0))
    return (rows.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["queue", "bucket"])
            .withColumn("cum", F.col("offset") + F.col("upto")).drop("queue", "bucket", "offset", "upto"))


def _finish(epoch: Column) -> Column:
    return (F.col("cum") + epoch * F.col("source_size")).cast("double") / F.col("target")


def _taken(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), copies: int = 3, budget: int | None = None,
        key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``mix`` with a mark of text and source that tells rows of one id apart."""
    docs_q = written(_queue(docs, weights, copies, budget, key, text, source), "mix-queue")
    live = docs_q.where("size > 0 and target > 0")
    turns = live.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))) \
                .withColumn("finish", _finish(F.col("epoch")))
    if budget is None:
        budget = docs_q.agg(F.sum("size")).first()[0] or 0

    def cut(level: DataFrame, at: str, used: int):
        """The first group of ``level`` whose words pass the budget, and the words before it."""
        run = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        sums = level.groupBy(at).agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(run) + used)
        hit = sums.where(F.col("upto") > budget).orderBy(at).limit(1).select(at, F.col("upto") - F.col("n")).first()
        return (None, used) if hit is None else (hit[0], hit[1])

    turns = turns.withColumn("unit", F.floor("finish")) \
                 .withColumn("slot", F.floor((F.col("finish") - F.floor("finish")) * SLOTS))
    unit, used = cut(turns, "unit", 0)
    if unit is None:                                   # the budget holds every copy
        taken = F.lit(copies)
    else:
        slot, used = cut(turns.where(F.col("unit") == unit), "slot", used)
        order = ["finish", "hash", "key", "size", "epoch"]
        run = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        last = (turns.where((F.col("unit") == unit) & (F.col("slot") == slot))
                .withColumn("upto", F.sum("size").over(run) + used).where(F.col("upto") <= budget)
                .orderBy(F.desc("upto")).select(*order).first())
        taken = F.lit(0)
        for e in range(copies):
            f = _finish(F.lit(e))
            u, s = F.floor(f), F.floor((f - F.floor(f)) * SLOTS)
            ahead = (u < unit) | ((u == unit) & (s < slot))
            if last is not None:
                row = F.struct(f.alias("finish"), "hash", "key", "size", F.lit(e).alias("epoch"))
                end = F.struct(*[F.lit(last[c]).cast(t).alias(c) for c, t in
                                 zip(order, ("double", "string", dict(docs_q.dtypes)["key"], "long", "int"))])
                ahead = ahead | ((u == unit) & (s == slot) & (row <= end))
            taken = taken + ahead.cast("int")
    done = F.when(F.expr("size > 0 and target > 0"), F.col("size") * taken).otherwise(F.lit(0)).cast("long")
    return docs_q.select("key", "mark", "size", "source_size", "target", done.alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), copies: int = 3, budget: int | None = None,
        key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken): words the mix takes of each document, repeats counted.

    ``budget`` is the size of the mix in words (default: all words of the input).
    """
    return _taken(docs, weights, copies, budget, key, text, source).drop("mark").withColumnRenamed("key", key)


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), copies: int = 3, budget: int | None = None,
                    key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    rows = _taken(docs, weights, copies, budget, key, text, source)
    turns = written(rows.where("taken > 0").select("key", "mark", F.expr("taken div size").alias("turns"))
                    .groupBy("key", "mark").agg(F.sum("turns").alias("mix_turns"), F.count("*").alias("mix_rows"))
                    .withColumnsRenamed({"key": "mix_key", "mark": "mix_mark"}), "mix-turns")
    got = docs.select(packed(docs), F.col(key).alias("key"), F.xxhash64(text, source).alias("mark"))
    got = got.join(turns.hint("shuffle_hash"), F.expr("key <=> mix_key and mark = mix_mark"))
    if turns.where("mix_rows > 1").limit(1).count():    # equal rows share what they were taken together
        place = F.row_number().over(Window.partitionBy("mix_key", "mix_mark").orderBy("mix_mark"))
        got = got.withColumn("mix_turns", F.expr("mix_turns div mix_rows") + (place <= F.expr("mix_turns % mix_rows")).cast("int"))
    got = got.where("mix_turns > 0").withColumn("mix_turn", F.explode(F.expr("sequence(1, cast(mix_turns as int))")))
    return unpacked(got, docs)
