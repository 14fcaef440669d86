"""Site resolvers from article URLs.  The two reference rules differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Resolver order and defaults as the reference states them.
EXPORT_PORTALS = ("delfi", "tvnet", "apollo")        # case-sensitive, default 'other'
EXPORT_DEFAULT = "other"
BACKFILL_PORTALS = ("tvnet", "apollo", "delfi")      # case-insensitive, default 'tvnet'
BACKFILL_DEFAULT = "tvnet"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def resolve_portal(url) -> Column:
    """Export resolver, case-sensitive substring test."""
    url = _c(url)
    expr = F.when(url.contains(EXPORT_PORTALS[0]), F.lit(EXPORT_PORTALS[0]))
    for p in EXPORT_PORTALS[1:]:
        expr = expr.when(url.contains(p), F.lit(p))
    return expr.otherwise(F.lit(EXPORT_DEFAULT))


def resolve_site(url) -> Column:
    """Backfill resolver, case-insensitive (ILIKE '%x%')."""
    low = F.lower(_c(url))
    expr = F.when(low.contains(BACKFILL_PORTALS[0]), F.lit(BACKFILL_PORTALS[0]))
    for p in BACKFILL_PORTALS[1:]:
        expr = expr.when(low.contains(p), F.lit(p))
    return expr.otherwise(F.lit(BACKFILL_DEFAULT))
