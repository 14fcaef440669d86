"""Tokenise and lemmatize (X2, X3), n-gram candidates (X4), word counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.text import detect_language, tokens, word_count
from murmur.operators.joins import broadcast_checked
from murmur.operators.layout import spread
from murmur.params import Params

LEMMATIZED_SCHEMA = T.StructType([
    T.StructField("comment_id", T.LongType(), False),
    T.StructField("lemmas", T.ArrayType(T.StringType(), False), False),
    T.StructField("words", T.ArrayType(T.StringType(), False), False),
    T.StructField("lemma_count", T.IntegerType(), False),
])


def with_language(comments: DataFrame, text: str = "comment_text", region: str = "region",
                  out: str = "detected_lang", params: Params = Params()) -> DataFrame:
    """X1 as a column on any frame of texts."""
    return comments.withColumn(out, detect_language(text, region, params))


def with_word_length(df: DataFrame, text: str = "text", out: str = "length") -> DataFrame:
    """X6 as a column."""
    return df.withColumn(out, word_count(text))


def lemmatize(comments: DataFrame, lemma_table: DataFrame | None = None,
              id_col: str = "id", text_col: str = "comment_text", lang_col: str = "comment_lang",
              keep: tuple[str, ...] = (), lemma_rows_bound: int | None = None) -> DataFrame:
    """Tokens of each comment, lower-cased letter runs, with lemmas.

    Without a lemma table the lemma is the form itself.  With a
    (language, form, lemma) table each token is looked up; a form missing
    from the table keeps itself as lemma.  Output keeps ``keep`` columns
    plus comment_id, lemmas, words (parallel arrays) and lemma_count.
    """
    src = spread(comments, id_col)          # the regex pass is the expensive step
    if lemma_table is None:
        out = src.select(F.col(id_col).alias("comment_id"), *keep, tokens(text_col).alias("words")).withColumn("lemmas", F.col("words"))
        return out.withColumn("lemma_count", F.size("lemmas")).select("comment_id", *keep, "words", "lemmas", "lemma_count")
    # a form with several lemmas takes the first in order; what keeps itself needs no row
    lt = broadcast_checked(
        lemma_table.groupBy(F.col("language").alias("_lang"), F.col("form").alias("_form"))
        .agg(F.min(F.lower("lemma")).alias("_lemma")).where("_lemma <> _form"),
        known_rows=lemma_rows_bound)
    # only forms that change leave the scan, once per comment; the texts are dealt by id once
    forms = src.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.explode(F.array_distinct(tokens(text_col))).alias("_form"))
    changed = forms.join(lt, ["_lang", "_form"]).groupBy("_id", "_lang") \
                   .agg(F.map_from_entries(F.collect_set(F.struct("_form", "_lemma"))).alias("_changed"))
    base = comments.select(F.col(id_col).alias("comment_id"), F.col(lang_col).alias("_l"), *keep, F.col(text_col).alias("_text"))
    out = base.join(changed.hint("shuffle_hash"), F.expr("comment_id <=> _id and _l = _lang"), "left")
    out = out.select("comment_id", *keep, tokens("_text").alias("words"), "_changed")
    lemmas = F.when(F.col("_changed").isNull(), F.col("words")) \
              .otherwise(F.transform("words", lambda w: F.coalesce(F.try_element_at(F.col("_changed"), w), w)))
    return out.select("comment_id", *keep, "words", lemmas.alias("lemmas"), F.size("words").alias("lemma_count"))


#: Characters of text and rows that a plug-in gets at once.
SLICE_CHARS, SLICE_ROWS = 1 << 20, 1_000


def text_slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``chars`` bytes of text (a longer text alone) and ``rows`` rows, without a copy."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first = held = 0
    for k, size in enumerate(sizes):
        if k > first and (held + size > chars or k - first >= rows):
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def lemmatize_with(comments: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame],
                   id_col: str = "id", text_col: str = "comment_text",
                   lang_col: str = "comment_lang") -> DataFrame:
    """X3 plug-in: a per-batch pandas lemmatizer (model loaded once per task).

    ``fn`` receives columns comment_id, text, language and returns
    comment_id, lemmas, words.  Counts are added here.  A call gets a bounded
    amount of text, whatever the size of an Arrow batch.
    """
    src = comments.select(F.col(id_col).alias("comment_id"), F.col(text_col).alias("text"),
                          F.col(lang_col).alias("language"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.list_(pa.string())
        for batch in batches:
            for part in text_slices(batch, "text"):
                res = fn(part.to_pandas())
                yield pa.record_batch({"comment_id": pa.array(res["comment_id"], pa.int64()), "lemmas": pa.array(res["lemmas"], words),
                                       "words": pa.array(res["words"], words), "lemma_count": pa.array(res["lemmas"].map(len), pa.int32())})

    return src.mapInArrow(run, LEMMATIZED_SCHEMA)


def explode_ngrams(df: DataFrame, tokens_col: str, keep: tuple[str, ...] = (), out: str = "term",
                   n_max: int = 3) -> DataFrame:
    """One row per 1..n_max-gram of an array column (terms joined by a space).

    The array is zipped with its shifted copies (arrays_zip pads with NULL),
    exploded once, and each position emits its 1-, 2-, 3-gram; all built-in
    expressions, so the stage stays in generated code.
    """
    a = F.col(tokens_col)
    shifted = [a.alias("t0")] + [F.slice(a, k + 1, F.size(a)).alias(f"t{k}") for k in range(1, n_max)]
    # the outer form: else Catalyst adds a filter on the array's size, which repeats the tokenisation
    z = df.select(*keep, F.explode_outer(F.arrays_zip(*shifted)).alias("_z"))
    grams = []
    for n in range(1, n_max + 1):
        parts = [F.col(f"_z.t{k}") for k in range(n)]
        g = parts[0] if n == 1 else F.when(parts[-1].isNotNull(), F.concat_ws(" ", *parts))
        grams.append(g)
    return (z.select(*keep, F.explode(F.array(*grams)).alias(out))
            .where(F.col(out).isNotNull()))


def regex_lemmatizer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Default X3 plug-in: lower-cased letter runs as words and lemmas (same rule as X2)."""
    import regex
    pat = regex.compile(r"\p{L}+")
    words = [pat.findall(t.lower()) if isinstance(t, str) else [] for t in pdf["text"]]
    return pd.DataFrame({"comment_id": pdf["comment_id"], "lemmas": words, "words": words})


# ---------------------------------------------------------------- learned endings

#: Longest ending a rule looks at, and least number of pairs behind a rule.
MAX_ENDING, MIN_PAIRS = 5, 2


def learn_endings(pairs: DataFrame, max_ending: int = MAX_ENDING, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Edit rules (language, ending, cut, add) from (language, form, lemma) pairs.

    What a pair tells is how many letters go from the end of the form and which
    come instead.  Every ending of the form that holds the letters that go, up
    to ``max_ending`` letters, votes for that edit; an ending's rule is the edit
    with most votes (then the one that cuts less, then the smaller text), if it
    has ``min_pairs`` of them.
    """
    p = pairs.select("language", "form", F.lower("lemma").alias("lemma")).where("length(form) > 0").distinct()
    common = F.expr("aggregate(sequence(1, least(length(form), length(lemma))), 0, (n, i) -> if(n = i - 1 and substr(form, i, 1) = substr(lemma, i, 1), i, n))")
    p = p.withColumn("_n", F.when(F.length("lemma") > 0, common).otherwise(F.lit(0)))
    p = p.select("language", "form", (F.length("form") - F.col("_n")).alias("cut"), F.expr("substr(lemma, _n + 1)").alias("add"))
    ends = F.expr(f"sequence(greatest(cut, 1), least(length(form), {max_ending}))")
    votes = p.where(f"greatest(cut, 1) <= least(length(form), {max_ending})") \
             .select("language", F.explode(ends).alias("_s"), "form", "cut", "add") \
             .groupBy("language", F.expr("right(form, _s)").alias("ending"), "cut", "add").agg(F.count(F.lit(1)).alias("n")) \
             .where(F.col("n") >= min_pairs)
    best = votes.groupBy("language", "ending").agg(F.min(F.struct((-F.col("n")).alias("m"), "cut", "add")).alias("r"))
    return best.select("language", "ending", F.col("r.cut").alias("cut"), F.col("r.add").alias("add"))


def lemmatize_tokens(comments: DataFrame, lemma_table: DataFrame | None = None, endings: DataFrame | None = None, id_col: str = "id",
                     text_col: str = "comment_text", lang_col: str = "comment_lang", keep: tuple[str, ...] = (),
                     max_ending: int = MAX_ENDING) -> DataFrame:
    """X2/X3 in long form: (comment_id, language, keep, pos, form, lemma), one row per token.

    The lemma comes from the table, else from the rule of the form's longest
    known ending, else it is the form.  Tokens are exploded once and looked up
    by joins on size-checked broadcasts; nothing is shuffled and no comment is put
    together again, so rollups and hits follow from these rows as they are.
    """
    src = spread(comments, id_col)
    t = src.select(F.col(id_col).alias("comment_id"), F.col(lang_col).alias("language"), *keep, F.posexplode(tokens(text_col)).alias("pos", "form"))
    lemma = F.lit(None).cast("string")
    if lemma_table is not None:
        table = lemma_table.groupBy("language", "form").agg(F.min(F.lower("lemma")).alias("_lemma"))
        t = t.join(broadcast_checked(table), ["language", "form"], "left")
        lemma = F.col("_lemma")
    if endings is not None:
        for s in range(max_ending, 0, -1):
            own = endings.where(F.length("ending") == s).select("language", F.col("ending").alias(f"_end{s}"), F.struct("cut", "add").alias(f"_rule{s}"))
            t = t.withColumn(f"_end{s}", F.expr(f"if(length(form) >= {s}, right(form, {s}), null)"))
            t = t.join(broadcast_checked(own), ["language", f"_end{s}"], "left")
        rule = F.coalesce(*[F.col(f"_rule{s}") for s in range(max_ending, 0, -1)])
        t = t.withColumn("_rule", rule)
        edited = F.expr("concat(left(form, length(form) - _rule.cut), _rule.add)")
        lemma = F.coalesce(lemma, F.when(F.col("_rule").isNotNull() & (edited != ""), edited))
    return t.select("comment_id", "language", *keep, "pos", "form", F.coalesce(lemma, F.col("form")).alias("lemma"))
