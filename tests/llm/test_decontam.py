import hashlib
import random
import re

import pytest

from murmur.llm import decontam
from tests.llm.util import frame

ITEMS = "item_id long, text string"


def norm(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n=13):
    wins = {}
    for i, t in items:
        w = norm(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            wins.setdefault(tuple(w[k:k + size]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, who = norm(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k:k + size])) in wins:
                    hit.update(range(k, k + size))
                    who |= wins[x]
        ids = ",".join(sorted(str(x) for x in who if x is not None))
        out.append((d, len(w), len(hit), len(who - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items):
    df = decontam.contamination(frame(spark, [(i, t, "s") for i, t in docs]).selectExpr("*", "1 as w", "2 as items", "3 as hash"),
                                frame(spark, items, ITEMS))
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


@pytest.fixture
def tables():
    r = random.Random(4)
    vocab = ["the", "of", "É", "x1", "and"] + [f"w{k}" for k in range(40)]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", ".\n", "-", "\x00"]) for _ in range(n))
    items = [(k, text(r.choice([1, 3, 12, 13, 14, 40]))) for k in range(12)] + [(50, None), (51, " .,"), (52, "same words here"), (53, "Same, words HERE"),
                                                                               (None, text(20))]
    docs = []
    for k in range(120):
        parts = [text(r.randrange(0, 60)) for _ in range(2)]
        t = r.choice(items)[1] or ""
        parts.insert(1, t.upper() if r.random() < .3 else t[r.randrange(5):])
        docs.append((k, "".join(parts) if r.random() < .7 else " ".join(parts)))
    docs += [(500, None), (501, ""), (502, "..."), (7, docs[7][1]), (7, "another text " + items[5][1]), (None, items[4][1]), (503, items[5][1] + text(30000))]
    return docs, items


def test_against_brute_force(spark, tables):
    assert run(spark, *tables) == brute(*tables)


def test_window_blocks_give_the_same(spark, tables, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 20)
    assert run(spark, *tables) == brute(*tables)


def test_empty_tables(spark, tables):
    docs, items = tables
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []


def test_dropping_and_cutting(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [(1, "Before it: " + item.title() + "! After."), (2, "clean text"), (3, "word " * 2000 + item), (4, None)]
    df, it = frame(spark, [(i, t, "s") for i, t in docs]), frame(spark, [(1, item)], ITEMS)
    kept = decontam.drop_contaminated(df, it)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    cut = {r.doc_id: r.text for r in decontam.remove_spans(df, it).collect()}
    assert cut == {1: "Before it: After.", 2: "clean text", 3: "word " * 2000, 4: None}


def test_no_python_in_the_plan(spark, tables):
    docs, items = tables
    plan = decontam.contamination(frame(spark, [(i, t, "s") for i, t in docs]), frame(spark, items, ITEMS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_plan_grows_with_the_sizes_not_their_subsets(spark):
    """Items of 1 to 13 words: thirteen window sizes."""
    items = spark.createDataFrame([(f"i{n}", " ".join(f"q{n}x{k}" for k in range(n))) for n in range(1, 14)], "item_id string, text string")
    docs = spark.createDataFrame([(n, "pre " * n + " ".join(f"q{n}x{k}" for k in range(n)) + " end") for n in range(1, 14)], "doc_id long, text string")
    seen = []
    written = decontam.written
    try:
        decontam.written = lambda df, name: (seen.append(len(df._jdf.queryExecution().analyzed().toString())), written(df, name))[1]
        rows = decontam.hit_rows(docs, items).where("place is not null").collect()
    finally:
        decontam.written = written
    assert {(r.key, r.place, r["size"]) for r in rows} == {(n, n, n) for n in range(1, 14)}
    assert max(seen) < 60_000
