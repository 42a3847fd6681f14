"""Size checks, and joins with derived tables whose size is not known beforehand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 20_000

# Rows that one window partition may hold, unless the session sets ``plumbline.windowRows``.
WINDOW_ROWS = 4_000_000


def window_limit(df: DataFrame, given: int | None) -> int:
    """The number given, that of the session, or the default."""
    return given if given is not None else int(df.sparkSession.conf.get("plumbline.windowRows", str(WINDOW_ROWS)))


def large_groups(
    df: DataFrame, keys: Sequence[str], window_rows: int | None = None, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame | None:
    """The keys with more rows than one window partition may hold; None if there are none.

    The table is marked for broadcast if it is short enough. Most tables are so small as a
    whole that counting the rows answers the question, and for a written table that only
    reads file footers.
    """
    window_rows = window_limit(df, window_rows)
    if df.count() <= window_rows:
        return None
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size")).where(F.col("_size") > window_rows).drop("_size")
    rows = sizes.limit(broadcast_rows + 1).collect()
    if not rows:
        return None
    if len(rows) > broadcast_rows or not keys:
        return sizes
    return F.broadcast(df.sparkSession.createDataFrame(rows, sizes.schema))


def attach(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join facts with a lookup table that has one row per key.

    The lookup is read up to a limit. Within the limit its rows are broadcast, so the facts,
    however skewed their keys, are not shuffled. Beyond it the join is shuffled, and AQE
    splits hot keys.
    """
    rows = lookup.limit(broadcast_rows + 1).collect()
    if len(rows) <= broadcast_rows:
        small = facts.sparkSession.createDataFrame(rows, lookup.schema)
        return facts.join(F.broadcast(small), list(on), how)
    return facts.join(lookup, list(on), how)
