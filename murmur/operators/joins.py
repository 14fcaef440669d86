"""Join helpers: size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows above which a dimension is joined by shuffle instead of broadcast.
DEFAULT_BROADCAST_ROWS = 2_000_000


def broadcast_checked(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      known_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven small.

    ``known_rows`` is the bound when the caller built the table from a
    literal list; otherwise one count job checks it.  Above the bound the
    frame is returned as is and Spark plans a shuffle join (AQE may still
    switch to broadcast at run time from real sizes).
    """
    n = known_rows if known_rows is not None else df.count()
    return F.broadcast(df) if n <= max_rows else df
