"""Hand-made rows for language detection, tokens, word counts and scoring."""

from pyspark.sql import functions as F

from murmur.functions.text import detect_language, tokens, word_count, word_language
from murmur.operators.lexicon import score_comments
from murmur.operators.text import lemmatize


def _detect(spark, rows):
    df = spark.createDataFrame(rows, "text string, region string")
    return [r[0] for r in df.select(detect_language("text", "region")).collect()]


def test_detect_language_branches(spark):
    cyr = "Привет мир"
    rows = [
        (cyr, None),                  # all Cyrillic, no region → ru
        ("hello world", "rus"),       # Latin text from a rus region stays ru (T7)
        ("hello world", "lat"),       # → lv
        ("hello", None),              # → default lv
        ("12345", "rus"), ("12345", "lat"), ("12345", None),   # digits only → region / default
        ("ééé", "rus"), ("ééé", None),                         # é is not in the Latin class (T7)
        (None, "rus"),                # NULL text → region
    ]
    assert _detect(spark, rows) == ["ru", "ru", "lv", "lv", "ru", "lv", "lv", "ru", "lv", "ru"]


def test_detect_language_threshold_is_strict(spark):
    # 85 Cyrillic + 15 Latin = exactly 0.85 → not promoted; 86 + 14 → ru
    at = "д" * 85 + "a" * 15
    above = "д" * 86 + "a" * 14
    assert _detect(spark, [(at, "lat"), (above, "lat")]) == ["lv", "ru"]


def test_word_language(spark):
    df = spark.createDataFrame([("ёлка",), ("āboli",), ("Дом",)], "w string")
    assert [r[0] for r in df.select(word_language("w")).collect()] == ["ru", "lv", "ru"]


def test_tokens_mixed_text(spark):
    df = spark.createDataFrame([("Hello, WORLD! 42 times-x ÄÖ",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tokens("t")).collect()]
    assert got == [["hello", "world", "times", "x", "äö"], [], []]


def test_word_count_python_split(spark):
    df = spark.createDataFrame([("  a b\tc\n d  ",), ("",), (None,), ("x y",)], "t string")
    assert [r[0] for r in df.select(word_count("t")).collect()] == [4, 0, 0, 2]


def test_lemmatize_with_table_keeps_order_and_missing_forms(spark):
    comments = spark.createDataFrame([(1, "Cats ran home", "en"), (2, "", "en"), (3, None, "en")],
                                     "id long, comment_text string, comment_lang string")
    table = spark.createDataFrame([("en", "cats", "Cat"), ("en", "ran", "run")],
                                  "language string, form string, lemma string")
    out = {r.comment_id: r for r in lemmatize(comments, table, lemma_rows_bound=2).collect()}
    assert out[1].lemmas == ["cat", "run", "home"]
    assert out[1].words == ["cats", "ran", "home"]
    assert out[1].lemma_count == 3
    assert out[2].lemma_count == 0 and out[3].lemma_count == 0


def test_score_repeats_and_no_hits(spark):
    lm = spark.createDataFrame([(1, ["bad", "x", "bad"]), (2, ["good"]), (3, [])],
                               "comment_id long, lemmas array<string>").withColumn("lemma_count", F.size("lemmas"))
    lex = spark.createDataFrame([("bad", "en", 0.5)], "word string, language string, weight double")
    got = {r.comment_id: (r.aggressive_word_count, r.aggressive_word_weight_sum)
           for r in score_comments(lm, lex, lexicon_rows=1).collect()}
    assert got == {1: (2, 1.0), 2: (0, 0.0), 3: (0, 0.0)}
