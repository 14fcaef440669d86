"""Selectors and small scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.params import Params

# Bucket edges (right-closed) and labels of the sampling study.
CONFIDENCE_BINS = (0.0, 0.33, 0.66, 1.0)
CONFIDENCE_LABELS = ("low", "medium", "high")
LENGTH_BINS = (0, 20, 50, 100, 200)
LENGTH_LABELS = ("short", "medium", "long", "very_long")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lang_selector(col, lang: str | None, params: Params = Params()) -> Column:
    """A supported language → equality; anything else (all, '', None) → all supported."""
    col = _c(col)
    if lang and lang != params.all_scope and lang in params.languages:
        return col == F.lit(lang)
    return col.isin(list(params.languages))


def percent_2dp(score) -> Column:
    """Score → percent with half-even rounding at 2 decimals (T4)."""
    return F.bround(_c(score) * F.lit(100.0), 2)


def bucketize(value, bins, labels) -> Column:
    """Right-closed buckets (a, b]; outside → NULL (pandas.cut)."""
    value = _c(value)
    expr = None
    for lo, hi, label in zip(bins[:-1], bins[1:], labels):
        cond = (value > F.lit(lo)) & (value <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def confidence_bucket(value) -> Column:
    return bucketize(value, CONFIDENCE_BINS, CONFIDENCE_LABELS)


def length_bucket(value) -> Column:
    return bucketize(value, LENGTH_BINS, LENGTH_LABELS)


def mix_hash(x, seed: int = 42) -> Column:
    """Deterministic order key in [0, 2^32): multiplicative hash of a bigint.

    Plain integer arithmetic so that DuckDB oracles compute the same value.
    """
    folded = _c(x).cast("bigint") % F.lit(2147483647)          # keeps the product in range
    return ((folded + F.lit(seed)) * F.lit(2654435761)) % F.lit(4294967296)
