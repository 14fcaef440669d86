"""K2 by vectors: what is shuffled, and the same results however its Arrow batches are cut."""

import collections
import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from murmur.operators import emotion_keywords as ek
from murmur.operators import word_vectors as wv
from tests.conftest import SF_SMALL
from tests.test_vector_keywords import SCHEMA, corpus

EMOTIONS = ["fear", "joy"]


def test_no_vector_is_dealt_by_term(spark):
    df = E.queries()["emotion_keywords_by_vector"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [x for x in plan.splitlines() if "hashpartitioning(" in x]
    assert dealt and not [x for x in dealt if "term" in x]
    assert "partial_sum(" not in plan and "array<double>" not in plan


def notes(rows, dims, size):
    """Notes of ``rows`` in batches of ``size``, in the order in which Spark deals them."""
    hashed = lambda w: sum(map(ord, w)) * 2654435761 >> 3
    near = [[hashed(w) % dims * 2 + (hashed(w) >> 9 & 1) for w in r[4]] for r in rows]
    kind = pa.schema([("date", pa.date32()), ("language", pa.string()), ("emotion", pa.string()), ("lemmas", pa.list_(pa.string())), ("near", pa.list_(pa.int32()))])
    table = pa.table([[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[4] for r in rows], near], schema=kind)
    out = list(wv.note_words(iter(table.to_batches(max_chunksize=size)), dims, 2, EMOTIONS))
    terms = collections.defaultdict(set)
    for day, language, e, _, words in rows:
        for n in (1, 2, 3):
            for k in range(len(words) - n + 1):
                terms[day, language, " ".join(words[k:k + n])].add(EMOTIONS.index(e))
    cut = pa.record_batch({"date": [k[0] for k in sorted(terms)], "language": [k[1] for k in sorted(terms)], "term": [k[2] for k in sorted(terms)],
                           "emotions": pa.array([sorted(terms[k]) for k in sorted(terms)], pa.list_(pa.int32()))})
    packed = [b for k in range(0, cut.num_rows, size) for b in wv.pack_terms(iter([cut.slice(k, size)]))]
    out += list(wv.ask_words(iter(packed)))
    return pa.Table.from_batches(out).sort_by([("language", "ascending"), ("word", "ascending")]), pa.Table.from_batches(packed)


def scored(rows, dims, size):
    noted, packed = notes(rows, dims, size)
    parts = pa.Table.from_batches(list(wv.answer(iter(noted.to_batches(max_chunksize=size)), dims, len(EMOTIONS))))
    out = []
    for day, language in sorted({(r[0], r[1]) for r in rows}):
        mine = lambda t: t.filter(pc.and_(pc.equal(t["date"], day), pc.equal(t["language"], language)))
        out += wv.score(mine(packed), mine(parts), dims, EMOTIONS, 10**6, 9, ek.KEYWORDS).to_pylist()
    return {(r["date"], r["language"], r["emotion"], r["keyword"]): r["confidence"] for r in out}


def test_batches_do_not_change_the_cosines(monkeypatch):
    rows = [*corpus(), (dt.date(1960, 5, 1), "lv", "joy", 99, ["sun"] * 40 + ["sea", "sun"])]
    want = scored(rows, 16, 10**6)
    assert {k[0] for k in want} == {r[0] for r in rows}
    for name, value in {"TOKENS": 30, "CELLS": 40, "ROWS": 3, "ENTRIES": 2, "FEW": 0, "SHIFT": 2}.items():
        monkeypatch.setattr(wv, name, value)
        got = scored(rows, 16, 7)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-8 for k in want), name


@pytest.mark.parametrize("dims", [64, 1000])
def test_large_counts_keep_their_value(dims):
    rows = [(dt.date(2024, 1, 1), "lv", "joy", 0, ["aa", "bb"] * 70_000)]
    noted, _ = notes(rows, dims, 10)
    batch = noted.combine_chunks().to_batches()[0]
    first = wv._starts(batch, ("language", "word"))
    counts = wv._counts(batch, wv._spread(first, batch.num_rows), 2, dims)
    # the other word stands to its left and right, the word itself two words on
    assert np.abs(counts).max(axis=1).tolist() == [139_999, 139_999] and np.abs(counts).sum(axis=1).tolist() == [279_997, 279_997]
    x = np.array([5, -5, 2**33, -2**33, 0])
    of, d, got = wv._pieces(np.arange(5), np.arange(5), x, dims)
    back = np.zeros(5, np.int64)
    np.add.at(back, of, got)
    assert (back == x).all() and (d == of).all() and (np.abs(got * dims + d) < 2**31).all()


def test_packed_lemmas_come_back(spark):
    texts = [["a b", 'c"d', "e,f", "\\", "\n", "é", ""], [], ["]"]]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "comment_id long, lemmas array<string>")
    held = ek.packed(docs)
    assert dict(held.dtypes)["lemmas"] == "string"
    assert [r.x for r in held.orderBy("comment_id").select(ek.lemma_list(held).alias("x")).collect()] == texts


def test_word_vectors_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.language, r.word): r.vector.toArray() for r in ek.word_vectors(docs, 16).collect()}
    hashes = {r.w: r.h for r in docs.select(F.explode("lemmas").alias("w")).distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    want = collections.defaultdict(lambda: np.zeros(16))
    for _, language, _, _, ws in rows:
        for i in range(len(ws)):
            for j in range(len(ws)):
                if 0 < abs(i - j) <= 2:
                    want[language, ws[i]][hashes[ws[j]] % 16] += 1 if hashes[ws[j]] >> 40 & 1 else -1
    want = {k: v / np.linalg.norm(v) for k, v in want.items() if np.linalg.norm(v) > 0}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_packed_and_stored_documents_give_the_same(spark):
    r = random.Random(3)
    rows = [(*x[:4], [*x[4], r.choice(["a b", "ž"])]) for x in corpus()]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stored = ek.stored_documents(ek.packed(docs))
    a, b = (sorted(ek.vector_keywords(d, ek.candidate_terms(d, None), EMOTIONS, top_n=9, dimensions=16).collect()) for d in (docs, stored))
    assert a == b and a
    assert not ek.vector_keywords(docs, ek.candidate_terms(docs, None), [], dimensions=16).collect()
