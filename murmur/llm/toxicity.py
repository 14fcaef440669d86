"""Toxicity by a weighted lexicon.

*Folding.*  Texts are lower-cased, look-alike letters of other scripts and full
width forms become plain letters, zero-width characters go, and digits and
signs that stand for letters become those letters; l and i are one letter, as 1
stands for either.

*Lexicon.*  Word beginnings of ``STEM`` letters, whole words of any length and,
in scripts that set no blanks, runs of ``GRAMS`` characters are counted in
toxic and other training documents; those whose association with the toxic
label passes a likelihood-ratio test at the number of candidates tried, per
document and per word of text, enter
with their log-odds as weight, the longest of beginnings that occur in the same
documents standing for all.  Two-word phrases around a term that come up in
several clean training documents and no toxic one become exception phrases.

*Scoring.*  One Aho-Corasick automaton finds terms and exception phrases in the
folded text; a term counts where a word starts (a short word also has to end
there, a run of characters counts anywhere) and no exception phrase covers it.  The weighted sum over the number of words is mapped to a score by the
monotone toxic rate that training documents of that density have.

Training uses at most ``TRAIN_ROWS`` labelled documents, those with the
smallest hash of the id among rows that are not held out; every document is
scored in full.  Labels, language, source and id are no inputs of a score.

Defined cases: a null or empty text has no hits and gets the score of such
texts; labels that are null or name no document are skipped, contradicting
labels of one id count as toxic; without training rows every score is 0;
repeated rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import n_words, written

TRAIN_ROWS = 40_000
STEM = range(4, 9)
GRAMS = range(2, 5)
#: First character of a term that counts anywhere, last one of a term that is a whole word.
ANYWHERE, WHOLE = "\t", "\n"
#: Least toxic training documents of a term, and least clean ones of an exception phrase.
SUPPORT, EXCEPTION_SUPPORT = 4, 5
#: Density classes per doubling.
STEPS = 2

#: Letters that look like a Latin letter.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ҽ": "e", "ѐ": "e", "ё": "e", "ɡ": "g", "һ": "h", "і": "i", "ї": "i", "ı": "i",
              "ј": "j", "к": "k", "ӏ": "l", "ⅼ": "l", "м": "m", "н": "h", "п": "n", "о": "o", "օ": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s",
              "т": "t", "ս": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "ᴢ": "z", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
              "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "σ": "o"}
#: Digits and signs that stand for a letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_INVISIBLE = dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_TABLE = {ord(k): v for k, v in HOMOGLYPHS.items()} | _INVISIBLE
_WORD = re.compile(r"[^\W_]+")
#: Runs of scripts that set no blanks: Thai, Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")


def fold(text: str | None) -> str:
    if not text:
        return ""
    t = text.lower()
    if not t.isascii():
        try:
            t.encode("latin-1")
        except UnicodeEncodeError:
            t = unicodedata.normalize("NFKC", t).translate(_TABLE)
        if "\xad" in t:
            t = t.replace("\xad", "")
    for k, v in SUBSTITUTES.items():
        if k in t:
            t = t.replace(k, v)
    return t.replace("l", "i")


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def _terms(words: set[str]) -> set[str]:
    out = {w if len(w) >= STEM[0] else w + WHOLE for w in words}
    for n in STEM:
        out.update([w[:n] for w in words if len(w) > n])
    for w in words:
        if not w.isascii():
            for run in _UNSPACED.findall(w):
                out.update(ANYWHERE + run[i:i + n] for n in GRAMS for i in range(len(run) - n + 1))
    return out


def _toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(_terms(set(_WORD.findall(fold(text)))))
    if seen:
        yield pa.record_batch({"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def _clean_terms(wanted, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = wanted.value
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(_terms(set(_WORD.findall(fold(text)))) & names)
    if seen:
        yield pa.record_batch({"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def likelihood_ratio(a: int, b: int, toxic: int, clean: int) -> float:
    """G statistic of a term found in a of the toxic and b of the clean documents."""
    def part(k, n, p):
        return (k * math.log(k / n / p) if k else 0.0) + ((n - k) * math.log((n - k) / n / (1 - p)) if n > k else 0.0)
    p = (a + b) / (toxic + clean)
    return 2 * (part(a, toxic, p) + part(b, clean, p)) if 0 < p < 1 else 0.0


def choose_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int, words: tuple[int, int] = (0, 0)) -> dict[str, float]:
    """term → weight for the terms that pass the test, without those a beginning of theirs makes needless.

    ``words`` are the numbers of words of the toxic and the clean documents.
    With them a term has to pass the test per word as well: in longer documents
    every common word is commoner per document, in shorter ones per word.
    """
    least = 2 * math.log(max(len(counts), 1)) + 6

    def passes(a: int, b: int, m: int, n: int) -> bool:
        return a * n > b * m and likelihood_ratio(a, b, m, n) >= least
    good = {t: math.log((a + .5) / (toxic - a + .5)) - math.log((b + .5) / (clean - b + .5)) for t, (a, b) in counts.items()
            if passes(a, b, toxic, clean) and (not all(words) or passes(a, b, *words))}
    weaker = set()                                      # beginnings that a longer term explains
    for t in good:
        for n in range(STEM[0], len(t)):
            short = t[:n]
            if short in good and counts[t][0] >= .9 * counts[short][0] and (counts[t] == counts[short] or good[t] > good[short]):
                weaker.add(short)
    keep: dict[str, float] = {}
    for t in sorted(good.keys() - weaker, key=lambda t: (len(t), t)):
        if not any(keep.get(t[:n], -math.inf) >= good[t] - math.log(4) for n in range(STEM[0], len(t))):
            keep[t] = good[t]
    return keep


class Matcher:
    """Aho-Corasick automaton over terms and exception phrases."""

    def __init__(self, terms: dict[str, float], phrases: list[str]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        own: dict[str, dict[str, float | None]] = {}    # a string can be a beginning, a whole word and a phrase
        for t, w in terms.items():
            own.setdefault(t.strip(ANYWHERE + WHOLE), {})[ANYWHERE if t[0] == ANYWHERE else WHOLE if t[-1] == WHOLE else ""] = w
        for p in phrases:
            own.setdefault(p, {})["phrase"] = None
        for t, kinds in own.items():
            self.automaton.add_word(t, (len(t), kinds))
        self.empty = not (terms or phrases)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, tuple[int, float]]:
        """start → (end, weight) of the heaviest term that counts at each place."""
        found: dict[int, tuple[int, float]] = {}
        if self.empty:
            return found
        spans = []
        for last, (size, kinds) in self.automaton.iter(folded):
            start = last - size + 1
            begins = not start or not folded[start - 1].isalnum()
            ends = last + 1 == len(folded) or not folded[last + 1].isalnum()
            if "phrase" in kinds and begins and ends:
                spans.append((start, last + 1))
            weight = max((w for k, w in kinds.items() if k == ANYWHERE or (k != "phrase" and begins and (ends or k != WHOLE))), default=None)
            if weight is not None and (start not in found or found[start][1] < weight):
                found[start] = (last + 1, weight)
        if spans and found:
            found = {s: x for s, x in found.items() if not any(a <= s and x[0] <= b for a, b in spans)}
        return found

    def density(self, text: str | None) -> tuple[float, int, int]:
        """(weighted hits per word, hits, words)."""
        folded = fold(text)
        hits = self.hits(folded)
        n = len(folded.split())
        return (sum(w for _, w in hits.values()) / max(n, 1) if hits else 0.0), len(hits), n


_loaded: list = [None, None]


def _matcher(shared) -> Matcher:
    if _loaded[0] is not shared:
        _loaded[:] = [shared, Matcher(*shared.value[:2])]
    return _loaded[1]


def _phrases(shared, rare, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(phrase, toxic, n): two-word phrases around the terms of each document.

    ``rare`` has the terms of fewer clean documents than an exception needs: no phrase around them can be one.
    """
    matcher = _matcher(shared)
    seen: Counter = Counter()
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            folded = fold(text)
            here = set()
            for start, (end, _) in matcher.hits(folded).items():
                if folded[start:end] in rare.value:
                    continue
                word = _WORD.match(folded, start)
                after = re.match(r" [^\W_]+", folded[word.end():word.end() + 60]) if word else None
                before = re.search(r"(?<![^\W_])[^\W_]+ $", folded[max(0, start - 60):start])
                if after:
                    here.add(folded[start:word.end()] + after[0])
                if before and word:
                    here.add(before[0] + folded[start:word.end()])
            seen.update((p, toxic) for p in here)
    if seen:
        yield pa.record_batch({"phrase": pa.array([p for p, _ in seen], pa.string()), "toxic": pa.array([t for _, t in seen], pa.int32()),
                               "n": pa.array(list(seen.values()), pa.int64())})


def density_class(density: float) -> int:
    """0 without hits, else the class of the density on a logarithmic scale."""
    return 0 if density <= 0 else max(1, 60 + math.floor(STEPS * math.log2(density)))


def _classes(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matcher = _matcher(shared)
    for batch in batches:
        yield pa.record_batch({"density": pa.array([density_class(matcher.density(t)[0]) for t in batch.column(0).to_pylist()], pa.int32()),
                               "toxic": batch.column(1)})


def monotone_rates(counts: dict[int, tuple[int, int]]) -> list[tuple[int, float]]:
    """(least class, rate) steps: pooled so that the toxic rate never falls with the density."""
    pools: list[list] = []
    for c in sorted(counts):
        toxic, n = counts[c]
        pools.append([c, toxic, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, t, n = pools.pop()
            pools[-1][1] += t
            pools[-1][2] += n
    return [(c, t / n) for c, t, n in pools]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS):
    """(terms, exception phrases, rates) from the rows that are not held out."""
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)) \
                  .groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(rows)
    train = written(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
                    .select("text", "toxic"), "toxicity-train")
    size = {r.toxic > 0: (r.n, r.words) for r in train.groupBy((F.col("toxic") > 0).cast("int").alias("toxic"))
            .agg(F.count("*").alias("n"), F.sum(n_words(F.col("text"))).alias("words")).collect()}
    (toxic, toxic_words), (clean, clean_words) = size.get(True, (0, 0)), size.get(False, (0, 0))
    if not toxic or not clean:
        return {}, [], [(0, 1.0 if toxic else 0.0)]
    found = train.where("toxic > 0").select("text").mapInArrow(_toxic_terms, "term string, n long") \
                 .groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= max(SUPPORT, toxic // 1000))
    a = {r.term: r.n for r in found.collect()}
    wanted = spark.sparkContext.broadcast(frozenset(a))
    b = {r.term: r.n for r in train.where("toxic <= 0").select("text").mapInArrow(partial(_clean_terms, wanted), "term string, n long")
         .groupBy("term").agg(F.sum("n").alias("n")).collect()}
    terms = choose_terms({t: (n, b.get(t, 0)) for t, n in a.items()}, toxic, clean, (toxic_words, clean_words))
    shared = spark.sparkContext.broadcast((terms, []))
    often = {t.strip(ANYWHERE + WHOLE) for t in terms if b.get(t, 0) >= EXCEPTION_SUPPORT}
    rare = spark.sparkContext.broadcast(frozenset(t.strip(ANYWHERE + WHOLE) for t in terms) - often)
    phrases = train.mapInArrow(partial(_phrases, shared, rare), "phrase string, toxic int, n long").groupBy("phrase") \
        .agg(F.sum(F.when(F.col("toxic") > 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") <= 0, F.col("n")).otherwise(0)).alias("b")) \
        .where(f"a = 0 and b >= {EXCEPTION_SUPPORT}").select("phrase")
    phrases = sorted(r.phrase for r in phrases.collect())
    shared = spark.sparkContext.broadcast((terms, phrases))
    counts = train.mapInArrow(partial(_classes, shared), "density int, toxic int").groupBy("density") \
        .agg(F.sum((F.col("toxic") > 0).cast("long")).alias("t"), F.count("*").alias("n")).collect()
    return terms, phrases, monotone_rates({r.density: (r.t, r.n) for r in counts})


def _score(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matcher, rates = _matcher(shared), shared.value[2]
    for batch in batches:
        got = [matcher.density(t) for t in batch.column(1).to_pylist()]
        score = [next((r for c, r in reversed(rates) if density_class(d) >= c), rates[0][1]) for d, _, _ in got]
        yield pa.record_batch({"key": batch.column(0), "score": pa.array(score, pa.float64()), "n_hits": pa.array([h for _, h, _ in got], pa.int64())})


def score(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, n_hits) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")) \
               .mapInArrow(partial(_score, shared), f"key {kind}, score double, n_hits long").withColumnRenamed("key", key)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted, n_hits) of every document."""
    scored = score(docs, fit(docs, labels, key, text), key, text)
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")
