import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from murmur.llm import charlm, grams, quality, queries
from tests.llm.util import SF, frame

SCHEMA = "doc_id long, text string, lang string, source string"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(tri)
    hit = {i + k for i, t in enumerate(tri) if seen[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def symbols(text):
    return [c + 32 if 65 <= c <= 90 else 48 if 48 <= c < 58 else 32 if c in (0, 9, 10, 11, 12, 13, 160) else c for c in map(ord, text)]


def kneser_ney(texts, order, cut_from=4):
    """Probabilities by textbook dictionaries; from ``cut_from`` on n-grams seen once give their share to the back-off."""
    counts = {order: Counter()}
    for t in texts:
        s = [0] * (order - 1) + symbols(t)
        counts[order].update(tuple(s[i:i + order]) for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc, ctx = {}, {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        disc[k] = [max(min(r - (r + 1) * y * n[r + 1] / n[r], r), .1) if n[1] and n[r] else r * .5 for r in (1, 2, 3)]
        ctx[k] = defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            ctx[k][g[:-1]][0] += v
            ctx[k][g[:-1]][1] += v if k >= cut_from and v == 1 else disc[k][min(v, 3) - 1]

    def p(g):
        k = len(g)
        low = 1 / 2 ** 21 if k == 1 else p(g[1:])
        if g[:-1] not in ctx[k]:
            return low
        total, held = ctx[k][g[:-1]]
        v = counts[k][g]
        v = 0 if k >= cut_from and v == 1 else v
        return ((v - disc[k][min(v, 3) - 1]) / total if v else 0) + held / total * low
    return p


def log_ppl(rows, order):
    """log-perplexity of every (text, lang) under its language's model."""
    own = defaultdict(list)
    for t, lang in rows:
        own[lang].append(t or "")
    models = {lang: kneser_ney(ts, order) for lang, ts in own.items()}
    out = []
    for t, lang in rows:
        s = [0] * (order - 1) + symbols(t or "")
        total = sum(math.log(models[lang](tuple(s[i:i + order]))) for i in range(len(s) - order + 1))
        out.append(-total / max(len(t or "") - len(re.findall(r"[#*$%&|<>]", t or "")), 1))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 64])
def test_base_counts(limit):
    r = random.Random(1)
    texts = [None, "", "a", "é | <b>\n\n é | <b>\né | <b>"] + [
        "".join(r.choice(["a ", "b ", "c\n", "é#", "\n", "x y z ", "\t", "%", "x y z\n", "日 "]) for _ in range(r.randrange(80))) for _ in range(300)]
    offsets, raw = grams.string_buffers(pa.array(texts))
    got = []
    for i, j in grams.blocks(offsets, limit):
        c = quality.base_counts(offsets, raw, i, j)
        got += list(zip(*(c[x].tolist() for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [base(t) for t in texts]


def chain(r, n_texts, lang="en", vocabulary=400, follow=4):
    """Texts whose words follow on each other: each word has a few successors."""
    syl = ["th", "er", "on", "an", "re", "he", "in", "ed", "or", "ou"]
    words = ["".join(r.choice(syl) for _ in range(r.randrange(1, 5))) for _ in range(vocabulary)]
    after = [[r.randrange(vocabulary) for _ in range(follow)] for _ in words]
    out = []
    for _ in range(n_texts):
        at, text = r.randrange(vocabulary), []
        for _ in range(r.randrange(80, 160)):
            text.append(words[at])
            at = r.choice(after[at])
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("order", [3, 6])
def test_perplexity_against_dictionaries(spark, order):
    r = random.Random(2)
    rows = [("".join(r.choice("abc d") for _ in range(r.randrange(60))), "a") for _ in range(60)]
    rows += [("".join(r.choice("xyé日本語 7#") for _ in range(r.randrange(40))), "b") for _ in range(40)]
    rows += [(None, "a"), ("", "b"), ("한국어 " * 30, "c"), rows[3], rows[3]] + [(t, "d") for t in chain(r, 5)]
    want = log_ppl(rows, order)
    docs = frame(spark, [(k, t, lang, "s") for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    for most in (quality.BLOCK_ROWS, 300):
        got = {x.doc_id: x.log_ppl for x in quality.quality(docs, order=order, most_rows=most).collect()}
        assert np.allclose([got[k] for k in range(len(rows))], want, atol=1e-4)


def test_model_is_sorted_hash_arrays(spark):
    docs = frame(spark, [(k, t, "=en", "s") for k, t in enumerate(chain(random.Random(1), 30))], SCHEMA)
    t = quality.fit(docs.select("lang", "text")).toPandas()
    assert all(own["hash"].is_monotonic_increasing for _, own in t.groupby("part"))
    model = charlm.HashModel(6, np.sort(t["hash"].to_numpy().view(np.uint64)), np.arange(len(t), dtype=np.int32), 0)
    assert (model.find(t["hash"].to_numpy().view(np.uint64)) >= 0).all()
    assert (model.find(t["hash"].to_numpy().view(np.uint64) + np.uint64(1)) >= 0).mean() < 0.01


def test_a_block_arrives_as_its_table_alone():
    import pickle
    import tracemalloc
    r = np.random.default_rng(4)
    keys, values = r.integers(1, 1 << 63, 1_500_000).astype(np.uint64) * np.uint64(2), r.integers(-9, 0, 1_500_000).astype(np.int32)
    block = quality._block(6, pa.table({"hash": keys.view(np.int64), "value": values}), [0, 5])
    sent = pickle.dumps(block, 5)
    tracemalloc.start()
    model, flags = pickle.loads(sent)
    left, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    table = model.key.nbytes + model.value.nbytes
    assert left < 1.05 * table and peak < table + 12 * len(keys) + (30 << 20)
    at = model.find(keys)
    assert (at >= 0).all() and np.flatnonzero(flags).tolist() == [0, 5]
    first = dict(zip(keys[::-1].tolist(), values[::-1].tolist()))         # of equal hashes the first counts
    assert model.value[at].tolist() == [first[k] for k in keys.tolist()]


#: Counts n-grams of many texts, then prints by how many MB the process has grown since.
COUNTING = """
import random, re
from functools import partial
import pyarrow as pa
from murmur.llm import quality
from murmur.llm.common import tidied
r = random.Random(3)
words = ["".join(r.choices("abcdefghijklmnoprstuvwy", k=r.randint(3, 11))) for _ in range(40000)]
texts = [" ".join(r.choices(words, k=600)) for _ in range(4000)]
def batches():
    for k in range(0, len(texts), 500):
        yield pa.record_batch({"lang": pa.array([f"={j % 4}" for j in range(500)]), "text": pa.array(texts[k:k + 500])})
def now():
    return int(re.search(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
before, n = now(), 0
for out in tidied(partial(quality._count, 6, 64), batches()):
    n += out.num_rows
del out
assert n
print(now() - before)
"""


def test_a_worker_that_has_counted_is_small_again():
    import subprocess
    import sys
    from pathlib import Path
    grown = subprocess.run([sys.executable, "-c", COUNTING], cwd=Path(quality.__file__).parents[2], capture_output=True, text=True, check=True).stdout
    assert int(grown) < 60


def test_any_number_of_blocks_gives_the_same_rows(spark):
    rows = corpus(5) + [(2000 + k, t, "fr", "s") for k, t in enumerate(chain(random.Random(6), 60))]
    docs = frame(spark, rows, SCHEMA).repartition(3)
    whole = quality.quality(docs)
    table = quality.fit(docs.selectExpr("concat('=', lang) as lang", "text"))
    assert len(quality.blocks(table, 10**9)) == 1 and len(quality.blocks(table, 4000)) >= 3
    key = lambda df: sorted(map(str, df.collect()))
    want = key(whole)
    assert key(quality.quality(docs, most_rows=4000)) == want
    assert key(quality.keep(docs, most_rows=4000)) == key(quality.keep(docs))


def test_word_order_counts(spark):
    """A corpus whose words follow on each other: texts of shuffled words, shuffled letters and other languages go, the rest stays."""
    r = random.Random(11)
    good = [("en", t) for t in chain(r, 700)] + [("de", t) for t in chain(r, 500)]
    bad = []
    for lang, t in good[:60]:
        words = t.split()
        r.shuffle(words)
        bad.append((lang, " ".join(words)))
    for lang, t in good[60:90]:
        letters = list(t)
        r.shuffle(letters)
        bad.append((lang, "".join(letters)))
    bad += [("en", t) for _, t in good[-30:]]
    rows = [(k, t, lang, "s") for k, (lang, t) in enumerate(good[:-30] + bad)]
    kept = {x.doc_id: x.kept for x in quality.quality(frame(spark, rows, SCHEMA).repartition(4)).collect()}
    n = len(good) - 30
    assert sum(kept[k] for k in range(n)) >= 0.99 * n
    assert sum(kept[k] for k in range(n, n + 60)) <= 6
    assert not any(kept[k] for k in range(n + 60, len(rows)))


def test_verdicts_against_the_labels(spark):
    """Held against labels.quality, which the model never reads."""
    sf = SF.replace("0.001", "0.1")
    rows = queries.op5_quality_perplexity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(x.quality == 0 for x in rows) > 500
    assert sum(x.kept for x in rows if x.quality == 0) <= 49
    assert sum(not x.kept and not x.base_failed for x in rows if x.quality == 1) <= 6


def test_pieces_of_long_texts_agree(spark):
    texts = ["héllo wörld " * 200, "", "x", "日本 " * 500, None, "tail"]
    offsets, raw = grams.string_buffers(pa.array(texts))
    whole = Counter()
    for k, t in enumerate(texts):
        s = [0] * 3 + symbols(t or "")
        whole.update((k, *s[i:i + 4]) for i in range(len(s) - 3))
    for limit in (50, 333, 1 << 20):
        got = Counter()
        for i, n, part, row in charlm.char_pieces(offsets, raw, limit, 3):
            hi, lo = charlm.grams_at(part, 4)
            got.update((i + int(w), int(a), *(int(q) >> 21 * s & 0x1FFFFF for s in (2, 1, 0))) for a, q, w in zip(hi, lo, row) if w >= 0)
        assert got == whole


def corpus(seed=3):
    r = random.Random(seed)
    syl = ["th", "er", "on", "an", "re", "he", "in", "ed"]
    def text(n):
        return " ".join("".join(r.choice(syl) for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows = [(k, text(r.randrange(60, 200)), "en", "s") for k in range(300)]
    rows += [(1000, text(80).replace(" ", "### ") + "###", "en", "s"), (1001, " ".join("%x%$q|" for _ in range(90)), "en", "s"),
             (1002, "short text", "en", "s"), (1003, "one two three " * 40, "en", "s"), (1004, None, None, "s"), (1005, "", "en", "s"),
             (None, text(80), "en", "s"), (7, text(70), "en", "s"), (1006, text(80), None, "s"), (1007, text(60000), "en", "s")]
    return rows


def test_verdicts_and_odd_rows(spark):
    rows = corpus()
    df = frame(spark, rows, SCHEMA).selectExpr("*", "1 as kept", "2 as n_words", "3 as low", "4 as row", "5 as quality_mark", "6 as mark", "7 as total")
    got = quality.quality(df).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got if r.doc_id != 7}
    assert all(kept[k] for k in range(300) if k != 7) and kept[None] and kept[1007] and kept[1006]
    assert not any(kept[k] for k in (1000, 1001, 1002, 1003, 1004, 1005))
    assert quality.quality(df.limit(0)).count() == 0
    stay = quality.keep(df)
    assert stay.columns == df.columns
    assert sorted(map(str, stay.collect())) == sorted(str(r) for r in df.collect() if r.doc_id is None or kept.get(r.doc_id, True))


def test_query_base_counts_and_clean_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op5_quality_perplexity(spark, SF).collect():
        b = base(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r.base_failed and r.kept)
