"""What several operators of this package share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The ASCII letters and the six ASCII white-space characters of the contracts.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]"

# A derived table of at most so many bytes may be broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20


def travels(module: str) -> None:
    """Send the module's functions to the workers by value, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def is_small(df: DataFrame, bytes_per_row: Column, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the measured size of a written table is within the limit."""
    return df.agg(F.coalesce(F.sum(bytes_per_row), F.lit(0)).alias("b")).first().b <= limit


def small_side(df: DataFrame, bytes_per_row: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if its measured size is within the limit."""
    return F.broadcast(df) if is_small(df, bytes_per_row, limit) else df


# Bytes of text that a task turns into numbers at a time; a longer text goes alone.
SLICE_BYTES = 2 << 20


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with ``limit`` bytes of text or one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(int(np.searchsorted(ends, before + limit, side="right")), begin + 1)
        yield begin, end
        begin = end


def give_back() -> None:
    """Return to the system what earlier tasks of this worker have freed: workers are used again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not every C library has it


def in_slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut up by the size of one column."""
    give_back()
    for batch in batches:
        for begin, end in slices(batch.column(column), limit):
            yield batch.slice(begin, end - begin)
    # A worker that waits for its next task keeps no more than it needs.
    batch = None
    give_back()


travels(__name__)
