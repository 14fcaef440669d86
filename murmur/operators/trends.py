"""Trend series: moving averages (W1, W2), side-by-side export (B4), overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.params import SMA_WIDTH


def sma_width(grain: str) -> int:
    """7 for day, 4 for week, 3 otherwise."""
    return SMA_WIDTH.get(grain, 3)


def with_sma(series: DataFrame, value_cols, width: int, partition=(), order: str = "period",
             suffix: str = "_sma") -> DataFrame:
    """Trailing mean over the last ``width`` rows (partial at the start).

    A row frame, not a calendar range: gaps in the series are skipped, as the
    chart does.  Series are per language (or per language and site), so each
    window partition holds one series of periods.
    """
    w = (Window.partitionBy(*partition).orderBy(order)
         .rowsBetween(-(width - 1), Window.currentRow))
    out = series
    for c in ([value_cols] if isinstance(value_cols, str) else value_cols):
        out = out.withColumn(c + suffix, F.avg(c).over(w))
    return out


def side_by_side(trend: DataFrame, primary: str, secondary: str, key: str = "period",
                 cols=("unweighted_aggressiveness_pct", "unweighted_aggressiveness_pct_sma",
                       "weighted_aggressiveness_pct_sma")) -> DataFrame:
    """Primary language rows, with the secondary's columns by date (NULL when absent)."""
    a = trend.where(F.col("language") == primary).select(
        key, *[F.col(c).alias(f"primary_{c}") for c in cols])
    b = trend.where(F.col("language") == secondary).select(
        key, *[F.col(c).alias(f"secondary_{c}") for c in cols])
    return a.join(b, key, "left")


def intervals_from_months(events: DataFrame, name: str = "event", start: str = "start_month",
                          end: str = "end_month") -> DataFrame:
    """J11 bands: from the first of the start month to day 28 of the end month."""
    return events.select(
        F.col(name).alias("event"),
        F.to_date(F.concat(F.col(start), F.lit("-01"))).alias("start_day"),
        F.to_date(F.concat(F.col(end), F.lit("-28"))).alias("end_day"))


def overlay(series: DataFrame, bands: DataFrame, date_col: str = "date") -> DataFrame:
    """Range join of a period series with named bands (start <= d <= end).

    Written as an equi-join on month buckets: each band is exploded into the
    months it touches (a handful of rows, broadcast after a size check), each
    series row probes its month, and the exact range is a filter.  No
    nested-loop join, and the series side is never shuffled.
    """
    from murmur.operators.joins import broadcast_checked
    months = bands.select("event", "start_day", "end_day",
                          F.explode(F.sequence(F.trunc("start_day", "month"), F.trunc("end_day", "month"),
                                               F.expr("interval 1 month"))).alias("_m"))
    s = series.withColumn("_m", F.trunc(F.col(date_col), "month"))
    j = s.join(broadcast_checked(months), "_m", "inner")
    return j.where((F.col(date_col) >= F.col("start_day")) & (F.col(date_col) <= F.col("end_day"))).drop("_m")
