"""Exact quantiles of any number of rows, without gathering the values in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here values
are counted first, and a small table is ranked by one window per key. A large table is cut
into ordered buckets: one count per bucket tells which buckets hold the wanted ranks, and
only the values of those buckets are looked at again. Buckets are narrow relative to the
value and are cut a second time, so that no window sees more than a bounded number of rows,
however the values are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scalars import to_number
from plumbline.operators.lookup import window_limit

# Buckets per doubling of the value, for the first cut and within one bucket of it.
COARSE, FINE = 256, 65536


def _position(value: Column) -> Column:
    """A non-decreasing function of the value that spreads magnitudes evenly."""
    return F.signum(value) * F.log2(F.abs(value) + F.lit(1.0)) * F.lit(float(COARSE))


def _needed_ranks(total: Column, probs: Sequence[float]) -> Column:
    """Zero-based ranks from which the quantiles are interpolated."""
    ranks = []
    for p in probs:
        place = (total - 1) * F.lit(float(p))
        ranks += [F.floor(place), F.ceil(place)]
    return F.array_distinct(F.array(*ranks))


def _lookup(ranks: Column, values: Column, total: Column, p: float) -> Column:
    place = (total - 1) * F.lit(float(p))
    low = F.element_at(values, F.array_position(ranks, F.floor(place)).cast("int"))
    high = F.element_at(values, F.array_position(ranks, F.ceil(place)).cast("int"))
    return low + (high - low) * (place - F.floor(place))


def _ranked_in_one_window(base: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """The wanted ranks with their values, by one window over the counted values of each key."""
    per_key = W.partitionBy(*keys)
    values = base.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    ordered = values.select(
        "*",
        F.sum("_c").over(per_key).alias("n"),
        (F.sum("_c").over(per_key.orderBy("_v")) - F.col("_c")).alias("_before"),
    )
    last = F.col("_before") + F.col("_c")
    mine = F.filter(_needed_ranks(F.col("n"), probs), lambda r: (r >= F.col("_before")) & (r < last))
    return ordered.select(*keys, "n", "_v", F.explode(mine).alias("_rank"))


def _ranked_in_buckets(base: DataFrame, keys: list[str], probs: Sequence[float], few: bool) -> DataFrame:
    """The same from counts per bucket, then per value of the buckets that hold wanted ranks."""
    spot = _position(F.col("_v"))
    base = base.withColumn("_b", F.floor(spot))

    # Count per bucket, and the buckets in which the wanted ranks lie.
    per_key = W.partitionBy(*keys)
    buckets = base.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    buckets = buckets.select(
        "*",
        F.sum("_c").over(per_key).alias("n"),
        (F.sum("_c").over(per_key.orderBy("_b")) - F.col("_c")).alias("_before"),
    )
    wanted = (
        buckets.withColumn("_rank", F.explode(_needed_ranks(F.col("n"), probs)))
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
        .select(*keys, "n", "_b", "_rank", (F.col("_rank") - F.col("_before")).alias("_at"))
    )

    # Distinct values of those buckets with their counts.
    spots = wanted.select(*keys, "_b").distinct()
    inside = base.join(F.broadcast(spots), [*keys, "_b"], "left_semi") if few else base
    slice_ = F.floor((spot - F.col("_b")) * F.lit(float(FINE)))
    values = inside.groupBy(*keys, "_b", "_v").agg(F.count("*").alias("_c")).withColumn("_s", slice_)

    # Cut each bucket into slices, then look at the values of one slice only.
    in_bucket = W.partitionBy(*keys, "_b")
    slices = values.groupBy(*keys, "_b", "_s").agg(F.sum("_c").alias("_sc"))
    slices = slices.withColumn("_sbefore", F.sum("_sc").over(in_bucket.orderBy("_s")) - F.col("_sc"))
    hit = slices.join(wanted, [*keys, "_b"]).where(
        (F.col("_at") >= F.col("_sbefore")) & (F.col("_at") < F.col("_sbefore") + F.col("_sc"))
    )
    hit = hit.select(*keys, "n", "_b", "_s", "_rank", (F.col("_at") - F.col("_sbefore")).alias("_in"))
    in_slice = W.partitionBy(*keys, "_b", "_s")
    ordered = values.withColumn("_vbefore", F.sum("_c").over(in_slice.orderBy("_v")) - F.col("_c"))
    return ordered.join(hit, [*keys, "_b", "_s"]).where(
        (F.col("_in") >= F.col("_vbefore")) & (F.col("_in") < F.col("_vbefore") + F.col("_c"))
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: Sequence[float],
    few_keys: bool | None = None,
    window_rows: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per key: columns ``keys``, ``n``, ``quantiles`` (array).

    A table of at most ``window_rows`` rows takes one pass, a larger one two. Set ``few_keys``
    where the number of keys is fixed by the caller (column names, say): the wanted buckets
    are then few, and are broadcast so that only matching rows move. Otherwise all values are
    counted by (key, value), which splits a hot key over many tasks. Missing values and NaN
    are ignored; keys must not be NULL.
    """
    keys = list(keys)
    few = not keys if few_keys is None else few_keys
    base = df.select(*keys, to_number(value).alias("_v")).where(F.col("_v").isNotNull())
    if df.count() <= window_limit(df, window_rows):
        found = _ranked_in_one_window(base, keys, probs)
    else:
        found = _ranked_in_buckets(base, keys, probs, few)

    # At most two ranks per quantile and key are gathered here.
    pairs = found.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("_rank", "_v"))).alias("_p"))
    ranks, at = F.col("_p._rank"), F.col("_p._v")
    result = F.array(*[_lookup(ranks, at, F.col("n"), p) for p in probs])
    return pairs.select(*keys, "n", result.alias("quantiles"))


def approx_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: Sequence[float],
    accuracy: int = 10_000,
) -> DataFrame:
    """The same columns from one sketch per key: one pass, values near the exact ones."""
    number = to_number(value)
    return df.groupBy(*keys).agg(
        F.count(number).alias("n"),
        F.percentile_approx(number, [float(p) for p in probs], accuracy).alias("quantiles"),
    )


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], approx: bool = False) -> DataFrame:
    """Quantiles of several numeric columns: one row per column name."""
    numbers = df.select(*[to_number(F.col(c)).alias(c) for c in columns])
    long = numbers.unpivot([], list(columns), "column", "value")
    if approx:
        return approx_quantiles(long, ["column"], F.col("value"), probs)
    return quantiles(long, ["column"], F.col("value"), probs, few_keys=True)
