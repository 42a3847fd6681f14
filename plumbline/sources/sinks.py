"""Report sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), compression: str | None = None) -> str:
    """Write a report table (Parquet, or CSV with a header) and return its path.

    ``compression`` is a codec of that format, the session's own if not given.
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError("format must be 'parquet' or 'csv'")
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        # Spaces at either end belong to the text; the writer would cut them off.
        spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(header=True, quote='"', escape='"', **spaces).csv(path)
    else:
        writer.parquet(path)
    return path
