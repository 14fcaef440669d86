import random
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from murmur.llm import grams, queries, tokens, wavelet
from murmur.llm.common import tidied
from tests.llm.util import SF, frame

TEXTS = ["The cat, the CAT. don't we've 12th x²", None, "", "  \t\n", "a<|endoftext|>b <|ENDOFTEXT|>", "Élan vital, İstanbul ΣΑΣ",
         "été   \x1c z", "word " * 3000, "%%%, ###. 3,4", "x" * 5000, "naïve line", "the\x0bend \x00"]


def plain(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [queries.END_ID] for x in texts]


def check(rows, ids):
    start = 0
    for r, want in zip(rows, ids, strict=True):
        assert (r.start, r.n_tokens) == (start, len(want)), r
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)


def test_wavelet_matrix_answers():
    x = np.random.default_rng(0).integers(0, 700, 600_000).astype(np.uint16)
    m = wavelet.WaveletMatrix(wavelet.encode(x, np.array([5]), np.array([len(x)]), 10))
    assert (m.tokens() == x).all()
    for i in (0, 7, 262143, 262144, 599_999):
        assert m.access(i) == x[i]
        t = int(x[i])
        where = np.flatnonzero(x == t)
        assert m.count(t) == len(where) and m.count(t, 100, i) == ((where >= 100) & (where < i)).sum()
        assert m.occurrence(t, len(where) // 2) == where[len(where) // 2] and m.occurrence(t, len(where)) == -1
    assert m.count(1023) == 0 and m.count(5000) == 0


def test_odd_texts(spark):
    df = frame(spark, [(k, t, "s") for k, t in enumerate(TEXTS)])
    rows = tokens.token_table(df, queries.tokenizer_path(), queries.END_ID).orderBy("start").collect()
    check(rows, plain(TEXTS))
    assert [r.doc_id for r in rows] == list(range(len(TEXTS)))


PARTS = ("a B é È × ÷ ß ÿ ž İ Σ ñ é ' 's 'LL don't . , ! ### %%% _ — “ 7 ½ ² Å K \x1c - = <|endoftext|> <| ﬁ 日本 한 а ̸ 🙂"
         " &amp;").split(" ") + ["\u00a0", "\u2003"]


def test_random_words_match_the_library():
    r = random.Random(5)
    texts = [" ".join("".join(r.choice(PARTS) for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(6)))
             + r.choice(["", "\n", " ", "\t\x0b"]) for _ in range(3000)]
    want = plain(texts)
    table = tokens.WordTokens(queries.tokenizer_path())
    offsets, raw = grams.string_buffers(pa.array(texts))
    for limit in (1 << 20, 40):
        for i, j in grams.blocks(offsets, limit):
            flat, size = table.encode(offsets, raw, i, j)
            ends = np.cumsum(size)
            assert [flat[e - s:e].tolist() + [queries.END_ID] for s, e in zip(size, ends)] == want[i:j]


def test_repeated_and_null_ids_and_empty_table(spark):
    df = frame(spark, [(3, "b", "s"), (3, "a", "s"), (None, "n", "s")])
    rows = tokens.token_table(df, queries.tokenizer_path(), queries.END_ID).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 3, 3]
    check(rows, plain(["n", "a", "b"]))
    assert tokens.token_table(df.limit(0), queries.tokenizer_path(), queries.END_ID).count() == 0


def test_shard_access_after_reading_the_files(spark, tmp_path):
    df = frame(spark, [(k, t, "s") for k, t in enumerate(TEXTS)])
    tokens.write_shards(df, str(tmp_path / "s"), queries.tokenizer_path(), queries.END_ID, shard_tokens=50)
    shards = spark.read.parquet(str(tmp_path / "s")).orderBy("part", "seq").collect()
    assert len(shards) > 1
    got = [m.document(k).tolist() for s in shards for m in [wavelet.WaveletMatrix(bytes(s.shard))]
           for k in range(len(m.doc_ids)) if m.doc_ends[k] - (m.doc_ends[k - 1] if k else 0) < 500]
    assert got == [x for x in plain(TEXTS) if len(x) < 500]


@pytest.mark.parametrize("sf", [SF])
def test_query_against_the_library(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op1_token_shards(spark, sf).orderBy("start").collect()
    check(rows, plain([t for _, t in docs]))


def test_a_worker_lets_go_of_the_token_table_when_another_step_runs(spark):
    def held(batches):
        import gc
        for _ in batches:
            yield pa.record_batch({"n": pa.array([sum(type(x).__name__ == "WordTokens" for x in gc.get_objects())], pa.int64())})
    docs = frame(spark, [(k, t, "s") for k, t in enumerate(TEXTS)]).repartition(4)
    assert tokens.token_table(docs, queries.tokenizer_path(), queries.END_ID).count() == len(TEXTS)
    left = spark.range(0, 64, 1, 8).mapInArrow(partial(tidied, held), "n long").collect()
    assert left and not any(r.n for r in left)
