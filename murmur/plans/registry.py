"""Registry of named queries and their oracle SQL, plus the per-call context."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.operators.text import lemmatize
from murmur.sources import fixtures as fx
from murmur.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def flat(df: DataFrame) -> DataFrame:
    """Output edge: dates and timestamps as ISO strings (compared as text)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


class Ctx:
    """Lazily built fixture frames for one (session, data directory)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)
        self.params = fx.FIXTURE_PARAMS
        self.pparams = fx.PREDICTION_PARAMS
        self.lexicon_rows = len(fx.LEXICON_ROWS)

    @cached_property
    def comments(self) -> DataFrame:
        return fx.comments(self.t)

    @cached_property
    def lexicon(self) -> DataFrame:
        return fx.lexicon(self.spark)

    @cached_property
    def lemmatized(self) -> DataFrame:
        return lemmatize(self.comments, keep=("article_id", "website", "day", "comment_lang"))

    @cached_property
    def articles(self) -> DataFrame:
        return fx.articles(self.t)

    @cached_property
    def predictions(self) -> DataFrame:
        return fx.predictions(self.t)
