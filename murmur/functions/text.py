"""Text column functions: language detection (X1), tokens (X2), word count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.params import Params

# Fixed values that must equal the reference's detection rule:
#   Cyrillic letters: U+0400 .. U+04FF
#   Latin letters: A-Z, a-z, U+0100 .. U+017E
#   share of Cyrillic above which a text is Russian: 0.85 (strict)
#   word-level Cyrillic test for lexicon words: а-я, ё, А-Я, Ё
CYRILLIC_CLASS = "[Ѐ-ӿ]"
LATIN_CLASS = "[A-Za-zĀ-ž]"
RU_THRESHOLD = 0.85
WORD_CYRILLIC_CLASS = "[а-яёА-ЯЁ]"

# Letter-run tokens; equals "keep lemma when all letters" of the reference.
TOKEN_PATTERN = r"(\p{L}+)"
# White space as Python's str.split() sees it (Java and RE2 both read \x{..}).
WHITESPACE_RUN = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                  r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def region_language(region, params: Params = Params()) -> Column:
    """Region code → language, default when unknown or NULL."""
    region = _c(region)
    expr = None
    for code, lang in params.region_lang:
        expr = (F.when(region == code, F.lit(lang)) if expr is None
                else expr.when(region == code, F.lit(lang)))
    return expr.otherwise(F.lit(params.default_lang)) if expr is not None else F.lit(params.default_lang)


def cyrillic_count(text) -> Column:
    return F.coalesce(F.regexp_count(_c(text), F.lit(CYRILLIC_CLASS)), F.lit(0))


def latin_count(text) -> Column:
    return F.coalesce(F.regexp_count(_c(text), F.lit(LATIN_CLASS)), F.lit(0))


def detect_language(text, region, params: Params = Params(),
                    ru: str = "ru") -> Column:
    """Script ratio promotes to Russian; otherwise the region decides.

    Latin text from a ``rus`` region stays Russian (ratio only promotes).
    NULL text counts as no letters.
    """
    cyr = cyrillic_count(text)
    lat = latin_count(text)
    total = cyr + lat
    fallback = region_language(region, params)
    return (F.when((total > 0) & ((cyr / total) > F.lit(RU_THRESHOLD)), F.lit(ru))
            .otherwise(fallback))


def word_language(word, ru: str = "ru", other: str = "lv") -> Column:
    """A10: a lexicon word with any Cyrillic letter is Russian, else Latvian."""
    return F.when(_c(word).rlike(WORD_CYRILLIC_CLASS), F.lit(ru)).otherwise(F.lit(other))


def tokens(text) -> Column:
    """X2 tokeniser: lower-cased letter runs, in text order; NULL text → []."""
    return F.coalesce(F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 1),
                      F.array().cast("array<string>"))


def word_count(text) -> Column:
    """Number of white-space separated words (Python ``len(s.split())``)."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), WHITESPACE_RUN)
    return F.size(F.filter(parts, lambda p: p != F.lit("")))
