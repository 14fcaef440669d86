import random
import zlib

from murmur.llm import queries, toxicity
from tests.llm.util import frame

LABELS = "doc_id long, quality int, toxic int"


def world(seed=1, n=3000):
    r = random.Random(seed)
    bad = ["grumble", "snarlish", "vexo", "quark"]
    words = [f"{a}{b}" for a in ("lo", "me", "ri", "ta", "grum", "sn", "vi") for b in ("ka", "lin", "sor", "pe", "ut", "ar")]
    docs, labels = [], []
    for k in range(n):
        w = [r.choice(words) for _ in range(r.randrange(20, 120))]
        toxic = r.random() < .2
        if toxic:
            for _ in range(r.randrange(2, 5)):
                t = r.choice(bad)
                t = t + r.choice(["", "en", "ung"]) if t == "vexo" else t
                w.insert(r.randrange(len(w)), r.choice([t, t.title()]))
        elif r.random() < .05:
            w.insert(5, "quark cheese")
        docs.append((k, " ".join(w), "s"))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_folding():
    assert toxicity.fold("ІdіОt") == "idiot" and toxicity.fold("1d10t $tup1d") == "idiot stupid"
    assert toxicity.fold("c1own ｌ") == toxicity.fold("CLOWN l")
    assert toxicity.fold("ｉｄｉｏｔ i​diot é") == "idiot idiot é" and toxicity.fold(None) == ""


def test_lexicon_scores_and_exceptions(spark):
    docs, labels = world()
    d, lab = frame(spark, docs), frame(spark, labels, LABELS)
    terms, phrases, rates = toxicity.fit(d, lab)
    assert {toxicity.fold(t) for t in ("grumble", "snarlish", "vexo")} <= set(terms)
    assert any(t.startswith("quark") for t in terms) and "quark cheese" in phrases
    assert all(a[1] <= b[1] for a, b in zip(rates, rates[1:]))
    truth = dict((k, t) for k, _, t in labels)
    got = toxicity.toxicity(d, lab).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and held
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > .97
    probes = frame(spark, [(1, "you gruмb1e, said the snar1ish one", "s"), (2, "some lolin quark cheese tauta", "s"), (3, None, "s"), (4, "", "s"),
                           (None, "ta me ri", "s"), (5, "ungrumbled words " * 10, "s"), (6, "rika " * 50000 + "grumble " * 9000, "s"), (6, "ta", "s")])
    out = [(r.doc_id, r.score >= .5, r.n_hits) for r in toxicity.score(probes, (terms, phrases, rates)).collect()]
    assert sorted(out, key=str) == sorted([(1, True, 2), (2, False, 0), (3, False, 0), (4, False, 0), (None, False, 0), (5, False, 0), (6, True, 9000),
                                           (6, False, 0)], key=str)


def test_terms_that_clean_texts_have_too():
    """A word in 30 % of the toxic and 3 % of the clean documents (log-odds 2.6) is a term."""
    terms = toxicity.choose_terms({"grumbie": (300, 300), "even": (100, 1000)}, 1000, 10000)
    assert set(terms) == {"grumbie"} and 2 < terms["grumbie"] < 3


def test_common_words_of_longer_or_shorter_texts_are_no_terms():
    counts = {"grumbie": (300, 300), "the\n": (990, 7000), "and\n": (990, 9900)}
    assert set(toxicity.choose_terms(counts, 1000, 10000)) == {"grumbie", "the\n"}
    for words in ((2_000_000, 10_000_000), (200_000, 4_000_000)):
        assert set(toxicity.choose_terms(counts, 1000, 10000, words)) == {"grumbie"} | ({"the\n"} if words[0] < 10**6 else set())


def test_held_out_labels_are_not_used(spark):
    docs, labels = world(2, 600)
    flipped = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    d = frame(spark, docs)
    assert toxicity.fit(d, frame(spark, labels, LABELS)) == toxicity.fit(d, frame(spark, flipped, LABELS))


def test_tables_without_labels_or_rows(spark):
    d = frame(spark, [(1, "a b", "s"), (None, None, None)]).selectExpr("*", "1 as score", "2 as toxic")
    none = frame(spark, [(None, 1, 1), (1, 1, None), (77, 1, 1)], LABELS)
    assert {r.score for r in toxicity.toxicity(d, none).collect()} == {0.0}
    assert toxicity.toxicity(d.limit(0), none).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.op8_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert all(0 <= r.score <= 1 for r in held)
    hit = sum(r.predicted and truth[r.doc_id] for r in held)
    assert hit / sum(r.predicted for r in held) > .9 and hit / sum(truth[r.doc_id] for r in held) > .9


def test_short_words_and_scripts_without_blanks(spark):
    """Toxic words of two and three letters, matched as whole words, and of two characters inside Chinese and Thai clauses."""
    r = random.Random(4)
    words = [f"{a}{b}" for a in ("lo", "me", "ri", "ta", "zu", "zuf", "qa") for b in ("ka", "lin", "sor", "pe", "ut", "ar")] + ["of", "it", "the", "zug"]
    han = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏"
    thai = "กขคงจฉชซ"
    docs, labels = [], []
    for k in range(2400):
        toxic = r.random() < .2
        if k % 3 < 2:
            w = [r.choice(words) for _ in range(r.randrange(20, 80))]
            if toxic:
                for _ in range(r.randrange(2, 4)):
                    w.insert(r.randrange(len(w)), r.choice(["zu", "qaf", "Zu", "qaf"]))
            text = " ".join(w)
        else:
            letters = han if k % 2 else thai
            w = ["".join(r.choice(letters) for _ in range(r.randrange(10, 30))) for _ in range(6)]
            if toxic:
                for i in range(2):
                    w[i] = w[i][:4] + ("犬賊" if k % 2 else "ฬฮ") + w[i][4:]
            text = "。".join(w) if k % 2 else " ".join(w)
        docs.append((k, text, "s"))
        labels.append((k, 1, int(toxic)))
    d = frame(spark, docs)
    model = toxicity.fit(d, frame(spark, labels, LABELS))
    assert {"zu\n", "qaf\n", "\t犬賊", "\tฬฮ"} <= set(model[0])
    held = [x for x in toxicity.toxicity(d, frame(spark, labels, LABELS)).collect() if x.held_out]
    truth = {k: t for k, _, t in labels}
    toxic = [x.predicted for x in held if truth[x.doc_id]]
    assert len(toxic) > 60 and sum(toxic) >= .95 * len(toxic)
    assert sum(x.predicted for x in held if not truth[x.doc_id]) <= .02 * len(held)
    probes = frame(spark, [(1, "zug zuflin qaka the zur", "s"), (2, "Zu!", "s")])
    assert {x.doc_id: x.n_hits for x in toxicity.score(probes, model).collect()} == {1: 0, 2: 1}
