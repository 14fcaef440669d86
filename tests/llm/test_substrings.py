import hashlib
import random

import numpy as np
import pytest

from murmur.llm import queries, substrings, suffixes
from tests.llm.util import SF, frame


def brute(rows, length=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    low = {}
    for i, b in texts:
        if i is not None:
            for k in range(len(b) - length + 1):
                s = b[k:k + length]
                low[s] = min(low.get(s, i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - length + 1):
                if low[b[k:k + length]] < i:
                    gone[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df).collect()), key=str)


@pytest.mark.parametrize("depth", [8, 10, 14, 20])
def test_suffix_order(depth):
    r = random.Random(depth)
    for trial in range(60):
        letters = r.choice([b"ab", b"abc", bytes(range(256)), b"a"])
        strings = [bytes(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(r.randrange(1, 12))]
        strings += strings[:3] if trial % 3 == 0 else []
        text, _ = suffixes.join(strings)
        keys = suffixes.Keys(text, depth)
        order = suffixes.suffix_order(text, keys)
        assert sorted(order.tolist()) == list(range(len(text)))
        ends = text.tolist()
        seen = [(ends[p:ends.index(0, p)] + [0] * depth)[:depth] for p in order]
        assert seen == sorted(seen)
        same = suffixes.equal_neighbours(keys, order)
        assert same.tolist() == [k > 0 and seen[k] == seen[k - 1] for k in range(len(seen))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    words = ["the", "of", "straße", "日本", "alpha", "x", "é"] + [f"w{k}" for k in range(400)]
    def text(n):
        return " ".join(r.choice(words) for _ in range(n))
    shared = [text(r.choice([9, 12, 30, 90])) for _ in range(12)]
    rows = []
    for k in range(250):
        parts = [text(r.randrange(0, 25)) for _ in range(3)]
        parts[1:1] = [r.choice(shared)[r.randrange(3):] for _ in range(r.choice([0, 1, 1, 2]))]
        rows.append((k * 7 % 251, r.choice(["", " ", "\n"]).join(parts)))
    rows += [(1000 + k, rows[k][1]) for k in range(0, 60, 2)] + [(2000 + k, rows[k][1][5:-7]) for k in range(30)]
    rows += [(3000, "a" * 300), (3001, "b" + "a" * 120), (3002, "ab" * 200), (3003, "a" * 49), (3004, "a" * 50), (900, "ab" * 40 + "c")]
    assert run(frame(spark, [(i, t, "s") for i, t in rows]).repartition(3)) == brute(rows)


def test_odd_rows(spark):
    long = "".join(chr(97 + k * k % 23) + str(k) for k in range(40000))
    same = "the same text of more than fifty bytes, twice under one id."
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, same), (5, same), (6, same + " tail"), (None, same), (None, same),
            (7, long), (8, long[1000:90000]), (9, "x" + same + "\x00" + same)]
    df = frame(spark, [(i, t, "s") for i, t in rows]).selectExpr("*", "1 as cls", "'q' as sha", "2 as n_bytes")
    assert run(df) == brute(rows)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_kept_texts(spark):
    a, b = "first half of a passage that is long enough to count " * 2, "own words only, long enough as well to be looked at, yes"
    got = substrings.kept_texts(frame(spark, [(1, a, "s"), (2, b + a, "s")])).collect()
    assert [(r.doc_id, bytes(r.kept).decode()) for r in got] == [(2, b)]


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op6_suffix_dedup(spark, SF).collect()]
    assert sorted(got, key=str) == brute(docs)
