import random
import re

import pyarrow as pa
import pytest

from murmur.llm import jaccard, queries
from tests.llm.util import SF, frame


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n=4, num=85, den=100):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    index = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    for k, (_, s) in enumerate(sets):
        near = {j for x in s for j in index[x] if j < k}
        for j in near:
            o = len(s & sets[j][1])
            if den * o >= num * (len(s) + len(sets[j][1]) - o):
                parent[find(k)] = find(j)
    low = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        low[r] = min(low.get(r, i), i)
    return {i: (len(s), low[find(k)]) for k, (i, s) in enumerate(sets)}


def run(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}


def varied(seed, n):
    """Near copies of changing strength, chains, templates, short texts, shared passages."""
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    stop = ["the", "of", "and", "in"]
    base = [[r.choice(stop if r.random() < .4 else vocab) for _ in range(r.choice([3, 5, 8, 20, 60, 200]))] for _ in range(n // 6)]
    passage = [r.choice(vocab) for _ in range(70)]
    out = []
    for k in range(n):
        w = list(r.choice(base))
        for _ in range(int(len(w) * r.choice([0, 0, .01, .02, .04, .1]))):
            p = r.randrange(len(w))
            w[p:p + 1] = r.choice([[], [r.choice(vocab)], [w[p], r.choice(vocab)]])
        if r.random() < .3:
            w = w + passage
        out.append((k * 3 % (n * 3), " ".join(w).title() if r.random() < .2 else "\n".join([" ".join(w[:7]), " ".join(w[7:])])))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = varied(seed, 400)
    assert run(frame(spark, [(i, t, "s") for i, t in rows])) == brute(rows)


def test_chain_and_hub(spark):
    """A chain whose ends do not link, and near copies of one text that do not link with each other."""
    words = [f"c{k}" for k in range(120)]
    chain = [" ".join(words[2 * k:100 + 2 * k - 60]) for k in range(10)] + [" ".join(f"d{i + j}" for i in range(100)) for j in range(40)]
    hub = [" ".join(f"h{i}" for i in range(200))]
    for k in range(60):
        w = [f"h{i}" for i in range(200)]
        for p in (3 * k, 3 * k + 9, 3 * k + 18):
            w[p % 200] = f"x{k}"
        hub.append(" ".join(w))
    rows = list(enumerate(hub + chain))
    assert run(frame(spark, [(i, t, "s") for i, t in rows])) == brute(rows)


def test_groups_of_several_classes(spark):
    """Short texts around one passage: equal prefix and size, little else in common, each with a near copy of its own."""
    r = random.Random(5)
    rows = []
    for k in range(150):
        w = [f"p{i}" for i in range(9)] + [f"t{k}x{i}" for i in range(6)]
        rows += [" ".join(w), " ".join([*w, f"end{k}"])]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    groups = {}
    for (i, _), (_, x) in zip(rows, jaccard.text_sets(jaccard.Rule(), pa.array([t for _, t in rows]))):
        groups.setdefault(jaccard._group(jaccard.Rule(), x), []).append(i)
    assert max(map(len, groups.values())) > 10
    assert run(frame(spark, [(i, t, "s") for i, t in rows])) == brute(rows)


def test_edge_rows(spark):
    rows = [(5, None, "s"), (6, "", "s"), (7, " \n", "s"), (8, "one two", "s"), (9, "ONE two", "s"), (10, "one two three", "s"),
            (None, "one two", "s"), (12, "a b c d " * 5000, "s"), (4, "a b c d " * 4000, "s")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got == {5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (1, 8), 9: (1, 8), 10: (1, 10), None: (1, None), 12: (4, 4), 4: (4, 4)}
    assert jaccard.jaccard_components(frame(spark, rows).limit(0)).count() == 0


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_ngram_jaccard(spark, SF).collect()}
    assert got == brute(docs)


def test_a_template_makes_no_pairs_of_classes_that_cannot_link(spark):
    """5,000 classes share 88 of 100 shingles: under each hash of the template none is in another's range."""
    rule = jaccard.Rule()
    entry = spark.range(5000).selectExpr("7L as tok", "id as cls", "100L as n", "13L + id % 3 as pos", "id as rep", "id as label")
    a, b = jaccard._by_size(rule, entry)
    assert a.join(b, ["tok", "step"]).count() == 0
    mixed = spark.range(3000).selectExpr("7L as tok", "id as cls", "60L + id % 50 as n", "5L + id % 7 as pos", "id as rep", "id as label")
    pairs = mixed.alias("a").join(mixed.alias("b"), "tok").where(f"a.cls < b.cls and {rule.fits_sql('a', 'b')}").selectExpr("a.cls", "b.cls").count()
    a, b = jaccard._by_size(rule, mixed)
    met = a.alias("a").join(b.alias("b"), ["tok", "step"])
    found = met.where("b.n between a.low and a.high and a.n <= b.most and (a.n > b.n or a.cls < b.cls)").where(rule.fits_sql("a", "b"))
    assert found.selectExpr("least(a.cls, b.cls) as x", "greatest(a.cls, b.cls) as y").where("x <> y").distinct().count() == pairs


def test_template_corpus(spark):
    r = random.Random(9)
    head = " ".join(f"t{k}" for k in range(91))
    rows = [(k, head + " " + " ".join(f"o{r.randrange(10**6)}" for _ in range(12))) for k in range(400)]
    assert run(frame(spark, [(k, t, "s") for k, t in rows])) == brute(rows)


def test_rows_of_one_id_stay_apart(spark):
    text = {x: " ".join(f"{x}{k}" for k in range(80)) for x in "ab"}
    rows = [(5, text["a"], "s"), (5, text["b"], "s"), (6, text["b"] + " more", "s"), (7, None, "s"), (7, "", "s"), (8, text["a"], "s"), (8, text["a"], "s")]
    got = sorted((r.doc_id, r.text or "") for r in jaccard.keep_one(frame(spark, rows)).collect())
    assert got == [(5, text["a"]), (5, text["b"]), (7, ""), (7, "")]


def test_chain_of_links_all_found_at_once(spark):
    """A template with a passage before it and one after it that only one neighbour has: the contraction between the rounds must lose no link."""
    part = lambda k: " ".join(f"p{k}x{i}" for i in range(4))
    body = " ".join(f"t{i}" for i in range(63))
    rows = [(k, " ".join([part(k + k % 2), body, part(k + 1 - k % 2)]), "s") for k in range(400)]
    assert {c for _, c in run(frame(spark, rows)).values()} == {0}
