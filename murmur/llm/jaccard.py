"""N-gram Jaccard self-join by grouped prefixes: documents that link, as connected components.

Two documents link when the Jaccard similarity of their word-shingle sets is
at least ``num / den``.  With n shingles a document can miss at most
``d = n - ceil(n * num / den)`` of a partner's.

1. *Signature prefix.*  The ``d + l(n)`` smallest shingle hashes of a document,
   l(n) = 1 + ``RATIO`` % of n.  Linked documents have at least
   min(l(n1), l(n2)) hashes common to their prefixes, so at least
   m(n) = l(ceil(n * num / den)).
2. *Groups.*  Documents with equal prefix and size form one group; documents
   with equal sets are one class.  A group whose prefix has fewer than m(n)
   hashes in common with any other group links with none and is done, unless
   it has several classes.  This drops most of the corpus before any full set
   is looked at.
3. *Class pairs.*  Members of a group need not have more than the prefix in
   common, so from here on every class stands for itself.  The same count over
   the full sets of what is left drops the classes that share fewer than
   ceil(n * num / den) hashes with all others together.  Then hashes are
   ordered rarest first; the first (shared - ceil(n * num / den) + 1) of a
   class's shared hashes index it.  Classes that meet under a hash are
   candidates when their sizes fit and the places of the hash in their orders
   (hashes of their own come first) leave room for the overlap their sizes ask
   for; the first common hash of a linked pair always does.
4. *Verify.*  The full sets of candidates are compared.  Only components are
   asked for, so pairs inside a component need no check: two rounds compare the
   classes met under a hash with one leader, and a last round takes every
   remaining pair that lies in two components and whose sizes leave room for
   the overlap.  Large groups of near copies thus cost their size, not its
   square, and no link is lost.

Defined cases: a document without words has an empty set and its own
component; fewer words than a shingle make one shingle of them all; rows with
a null id link with nothing (component null); rows that repeat an id are
judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm import grams
from murmur.llm.common import WORD, packed, release, tidied, unpacked, written
from murmur.llm.components import contracted, labels

#: Percent of a set that its prefix holds beyond what may differ.
RATIO = 6
#: Tokens after which a task sends on what it has gathered; hashes met twice by then need no answer.
FLUSH = 1 << 19
_U = np.uint64


class Rule:
    """Bounds of a similarity threshold num/den over n-word shingles."""

    def __init__(self, n: int = 4, num: int = 85, den: int = 100):
        self.n, self.num, self.den = n, num, den

    def least(self, size: int) -> int:
        return -(-size * self.num // self.den)

    def prefix(self, size: int) -> int:
        return size - self.least(size) + 1 + size * RATIO // 100

    def least_sql(self, size: str) -> str:
        return f"((({size}) * {self.num} + {self.den - 1}) div {self.den})"

    def meet_sql(self, size: str) -> str:
        """m(n): prefix hashes a linked partner has in common at least."""
        return f"(1 + {self.least_sql(size)} * {RATIO} div 100)"

    def fits_sql(self, a: str, b: str) -> str:
        """Sizes fit, and enough hashes follow the common one at its positions in both groups."""
        common = f"((({a}.n + {b}.n) * {self.num} + {self.num + self.den - 1}) div {self.num + self.den})"
        return (f"least({a}.n, {b}.n) * {self.den} >= greatest({a}.n, {b}.n) * {self.num}"
                f" and least({a}.n - {a}.pos, {b}.n - {b}.pos) + 1 >= {common}")

    def linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        common = int((y[at] == x).sum()) if len(y) else 0
        return len(x) > 0 and self.den * common >= self.num * (len(x) + len(y) - common)


def text_sets(rule: Rule, col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a column."""
    offsets, raw = grams.string_buffers(col)
    for i, j in grams.blocks(offsets):
        w = grams.block_words(offsets, raw, i, j)
        b = w.bounds.tolist()
        for k in range(w.rows):
            words = w.hash[b[k]:b[k + 1]]
            yield i + k, np.unique(grams.shingle_hash(words, min(rule.n, len(words)))) if len(words) else words


def _key(x: np.ndarray, salt: int) -> int:
    """Order-free 64-bit hash of a set of hashes."""
    with np.errstate(over="ignore"):
        return int(grams.mix(np.array([grams.mix(x ^ _U(salt)).sum(dtype=_U) + _U(len(x)) * _U(salt | 1)], _U)).view(np.int64)[0])


def _group(rule: Rule, x: np.ndarray) -> int:
    head = x[:rule.prefix(len(x))]
    return _key(np.append(head, _U(len(x))), 0x51ED270B)


def _keys(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, h1, h2, g = [], [], [], []
        for _, x in text_sets(rule, batch.column(1)):
            n.append(len(x))
            h1.append(_key(x, 0x1B873593)), h2.append(_key(x, 0x85EBCA6B))
            g.append(_group(rule, x))
        yield pa.record_batch({"doc_id": batch.column(0), "mark": batch.column(2), "n": pa.array(n, pa.int64()), "h1": pa.array(h1, pa.int64()),
                               "h2": pa.array(h2, pa.int64()), "grp": pa.array(g, pa.int64())})


def _heads(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for _, x in text_sets(rule, batch.column(0)):
            if len(x):
                yield _group(rule, x), x[:rule.prefix(len(x))]


def _whole(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for grp, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield grp, np.frombuffer(raw.as_buffer(), _U)


def _token_rows(rule: Rule, source, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tok, grp, credit): the hashes of each group once.

    A hash that several groups of this task hold is known to be shared: it goes
    on once, without a group, and its groups are credited at once (credit > 0).
    """
    def flush() -> pa.RecordBatch:
        tok, grp = np.concatenate(toks), np.repeat(np.array(groups, np.int64), [len(t) for t in toks])
        order = np.argsort(tok)
        tok, grp = tok[order], grp[order]
        first = np.append(True, tok[1:] != tok[:-1])
        size = np.diff(np.append(np.flatnonzero(first), len(tok)))
        alone = np.repeat(size == 1, size)
        known = tok[first][size > 1]
        owner, credit = np.unique(grp[~alone], return_counts=True)
        out_tok = np.concatenate((tok[alone].view(np.int64), known.view(np.int64), owner))
        out_grp = np.concatenate((grp[alone], np.zeros(len(known), np.int64), owner))
        none = np.zeros(len(out_tok), bool)
        none[alone.sum():alone.sum() + len(known)] = True
        out_credit = np.concatenate((np.zeros(alone.sum() + len(known), np.int64), credit))
        return pa.record_batch({"tok": pa.array(out_tok), "grp": pa.array(out_grp, mask=none), "credit": pa.array(out_credit)})
    toks, groups, seen, held = [], [], set(), 0
    for g, x in source(rule, batches):
        if g in seen:
            continue
        seen.add(g)
        toks.append(x), groups.append(g)
        held += len(x)
        if held >= FLUSH:
            yield flush()
            toks, groups, seen, held = [], [], set(), 0
    if toks:
        yield flush()


def _sets(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        expect = batch.column(2).to_pylist()
        rows, sets = [], []
        for k, x in text_sets(rule, batch.column(1)):
            if _key(x, 0x1B873593) == expect[k]:        # else another row of a repeated id
                rows.append(k), sets.append(x.tobytes())
        yield pa.record_batch({"cls": batch.column(2).take(pa.array(rows, pa.int64())), "members": pa.array(sets, pa.binary())})


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cls, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(raw.as_buffer(), np.int64)
            yield pa.record_batch({"cls": pa.array(np.full(len(x), cls)), "n": pa.array(np.full(len(x), len(x))), "tok": pa.array(x)})


def _verify(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [rule.linked(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U))
                for x, y in zip(batch.column(2), batch.column(3))]
        yield pa.record_batch({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(keep, pa.bool_()))


def _open(rows: DataFrame, groups: DataFrame, need: str) -> DataFrame:
    """The groups (grp, n, size) that share ``need`` hashes or more with others, or have several classes."""
    rows = rows.selectExpr("*", "min(grp) over (partition by tok) <> max(grp) over (partition by tok)"
                           " or count(grp) over (partition by tok) < count(*) over (partition by tok) as shared")
    met = rows.where("grp is not null and (credit > 0 or shared)").groupBy("grp").agg(F.sum(F.greatest("credit", F.lit(1))).alias("met"))
    return groups.join(met, "grp", "left").where(F.expr(f"size > 1 or met >= {need}")).select("grp", "n", "size")


def _candidate_index(rule: Rule, sets: DataFrame, members: DataFrame) -> DataFrame:
    """(tok, cls, n, pos, rep): the index hashes of every class, rarest first."""
    tokens = written(sets.join(members.select("cls"), "cls").select("cls", "members")
                     .mapInArrow(partial(tidied, _explode), "cls long, n long, tok long"), "jaccard-tokens")
    common = tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(common, "tok").selectExpr(
        "tok", "cls", "n", "count(*) over (partition by cls) as shared",
        "row_number() over (partition by cls order by df, tok) as place")
    index = ranked.where(F.expr(f"place <= shared - {rule.least_sql('n')} + 1")).withColumn("pos", F.expr("n - shared + place"))
    return index.join(members.select("cls", "rep"), "cls").select("tok", "cls", "n", "pos", "rep")


def _by_size(rule: Rule, entry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two sides of a join on (tok, step): each entry with the sizes that smaller partners can have, and at its own size.

    With r = n - pos + 1 hashes left from the common one on, a partner has at
    most r * (num + den) / num - n of them.  Classes that share too little are
    out of each other's range, so thousands of them under one hash, a template
    that all of them hold, make no row.  Steps of 2 % narrow the range.
    """
    step = lambda x: f"cast(floor(ln({x}) / {math.log(1.02)!r}D) as int)"
    entry = entry.withColumn("most", F.expr(f"(n - pos + 1) * {rule.num + rule.den} div {rule.num} - n"))
    entry = entry.withColumn("low", F.expr(rule.least_sql("n"))).withColumn("high", F.least("n", "most"))
    small = entry.where("high >= low").withColumn("step", F.explode(F.expr(f"sequence({step('low')}, {step('high')})")))
    return small, entry.withColumn("step", F.expr(step("n")))


def _check(rule: Rule, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets link."""
    left = sets.select(F.col("cls").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("members").alias("y"))
    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
                   .mapInArrow(partial(tidied, partial(_verify, rule)), "a long, b long"), "jaccard-links")


def _links(rule: Rule, sets: DataFrame, members: DataFrame) -> DataFrame:
    """(node, label): components of the linked classes."""
    index = written(_candidate_index(rule, sets, members), "jaccard-index")
    links = tried = None
    label = members.select(F.col("cls").alias("node"), F.col("cls").alias("label"))
    for turn in range(3):
        entry = index.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        open_tok = entry.groupBy("tok").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("tok")
        entry = entry.join(open_tok, "tok")
        a, b = entry.alias("a"), entry.alias("b")
        apart = "a.label <> b.label"
        if turn < 2:                                    # the leader of a hash against all others
            order = "rep" if turn == 0 else f"xxhash64(rep, {turn})"
            heads = entry.groupBy("tok").agg(F.expr(f"min_by(struct(cls, n, pos, label), struct({order}, cls))").alias("s")).select("tok", "s.*")
            met = heads.alias("a").join(b, "tok")
        else:                                           # every pair left whose sizes fit
            a, b = _by_size(rule, entry)
            met = a.alias("a").join(b.alias("b"), ["tok", "step"])
            apart += " and b.n between a.low and a.high and a.n <= b.most and (a.n > b.n or a.cls < b.cls)"
        pairs = met.where(F.expr(f"{apart} and {rule.fits_sql('a', 'b')}")) \
                   .select(F.least("a.cls", "b.cls").alias("a"), F.greatest("a.cls", "b.cls").alias("b")).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        tried = pairs if tried is None else tried.union(pairs)
        found = _check(rule, pairs, sets)
        tree = found if links is None else found.union(links)
        links = contracted(tree, rounds=3 if turn < 2 else None)    # all edges: a label of three rounds holds one of several
        label = labels(links)
        release(sets.sparkSession)                      # plans and task records of a turn would else add up in the driver
    return label


def jaccard_components(docs: DataFrame, rule: Rule | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, class_id): class_id is the smallest id with an equal set."""
    return _components(docs, rule, key, text).drop("mark", "label")


def keep_one(docs: DataFrame, rule: Rule | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest (id, hash of the text), with all its columns.

    Rows without an id or without words link with nothing and all stay.
    """
    rows = written(_components(docs, rule, key, text).where("n_shingles > 0").where(F.col(key).isNotNull()), "jaccard-rows")
    kept = rows.groupBy("label").agg(F.min(F.struct(F.col(key).alias("kept_key"), F.col("mark").alias("kept_mark"))).alias("kept")).select("kept.*")
    open_ = F.col(key).isNotNull() & F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    some = docs.where(open_).select(packed(docs), F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("mark"))
    some = some.join(kept.hint("shuffle_hash"), F.expr("key = kept_key and mark = kept_mark"), "left_semi")
    if rows.groupBy(key, "mark").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        some = some.dropDuplicates(["key", "mark"])     # rows that are repeated as they are
    return unpacked(some, docs).unionByName(docs.where(~open_))


def _components(docs: DataFrame, rule: Rule | None, key: str, text: str) -> DataFrame:
    """``jaccard_components`` with a mark of the text that tells rows of one id apart, and a label of the component."""
    rule = rule or Rule()
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    keys = written(marked.mapInArrow(partial(tidied, partial(_keys, rule)), "doc_id long, mark long, n long, h1 long, h2 long, grp long"), "jaccard-keys")
    classes = keys.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2", "grp").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "jaccard-classes")

    rows = docs.where("doc_id is not null").select("text").mapInArrow(partial(tidied, partial(_token_rows, rule, _heads)), "tok long, grp long, credit long")
    groups = classes.groupBy("grp").agg(F.max("n").alias("n"), F.count("*").alias("size"))
    groups = written(_open(rows, groups, rule.meet_sql("n")), "jaccard-groups")
    release(docs.sparkSession)
    members = classes.join(groups.select("grp"), "grp").select("rep", F.col("h1").alias("cls"), "n")
    texts = members.select(F.col("rep").alias("doc_id"), "cls").hint("shuffle_hash").join(docs, "doc_id") \
                   .select("doc_id", "text", "cls")
    sets = written(texts.mapInArrow(partial(tidied, partial(_sets, rule)), "cls long, members binary"), "jaccard-sets")
    rows = sets.mapInArrow(partial(tidied, partial(_token_rows, rule, _whole)), "tok long, grp long, credit long")
    alone = members.select(F.col("cls").alias("grp"), "n", F.lit(1).alias("size"))
    linked = _open(rows, alone, rule.least_sql("n")).select(F.col("grp").alias("cls"))
    members = written(members.join(linked, "cls"), "jaccard-members")
    release(docs.sparkSession)
    label = _links(rule, sets, members)
    label = written(label.union(label.select(F.col("label").alias("node"), "label").distinct()), "jaccard-labels")
    first = label.join(members.select(F.col("cls").alias("node"), "rep"), "node").groupBy("label").agg(F.min("rep").alias("component"))
    label = label.join(first, "label")

    named = classes.join(label, classes.h1 == label.node, "left") \
                   .select("n", "h1", "h2", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("label", "h1").alias("label"))
    out = keys.join(named, ["n", "h1", "h2"], "left")
    single = F.expr("n = 0 or doc_id is null")
    return out.select(F.col("doc_id").alias(key), "mark", F.col("n").alias("n_shingles"),
                      F.when(single, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
                      F.when(single, F.col("doc_id")).otherwise(F.col("rep")).alias("class_id"), "label")
