"""Drift between a training and a test part, and training windows over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.grids import evenly_spaced
from plumbline.functions.scalars import null_group, to_number
from plumbline.operators.prepare import TARGET
from plumbline.operators.profile import top_values
from plumbline.operators.quantiles import column_quantiles

# Smallest share in the stability index, and values listed per side.
SMALLEST_SHARE = 1e-6
TOP_PER_SIDE = 20
INITIAL_PERIODS = 3
SLIDING_PERIODS = 2


def _long_numbers(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    numbers = [to_number(F.col(c)).alias(c) for c in columns]
    return df.select(F.col(split).alias("split"), *numbers).unpivot(["split"], list(columns), "column", "value")


def stability_index(
    df: DataFrame, columns: Sequence[str], split: str = "split", bins: int = 10, approx: bool = False
) -> DataFrame:
    """Population stability index of each column between the ``train`` and ``test`` rows.

    Bin edges are the distinct training quantiles; values outside them are ignored. NULL with
    fewer than three edges or without values on one side.
    """
    train = df.where(F.col(split) == "train")
    probs = evenly_spaced(0.0, 1.0, bins + 1)
    edges = column_quantiles(train, columns, probs, approx).select(
        "column", F.array_sort(F.array_distinct("quantiles")).alias("edges")
    )
    by_column = edges.agg(F.map_from_entries(F.collect_list(F.struct("column", "edges"))).alias("m")).scalar()
    long = _long_numbers(df, columns, split).withColumn("edges", F.try_element_at(by_column, F.col("column")))
    value, limits = F.col("value"), F.col("edges")
    inside = (value >= F.element_at(limits, 1)) & (value <= F.element_at(limits, -1))
    reached = F.size(F.filter(limits, lambda e: e <= value))
    place = F.when(inside, F.least(reached, F.size(limits) - 1)).otherwise(F.lit(0))
    side = F.col("split")
    binned = (
        long.where(value.isNotNull())
        .groupBy("column", F.size(limits).alias("_edges"), place.alias("_bin"))
        .agg(F.count_if(side == "train").alias("_e"), F.count_if(side == "test").alias("_a"))
    )
    # At most bins + 1 rows per column from here on.
    per_column = W.partitionBy("column")

    def share(name: str) -> Column:
        in_range = F.sum(F.when(F.col("_bin") > 0, F.col(name)).otherwise(0)).over(per_column)
        return F.greatest(F.col(name) / F.greatest(in_range, F.lit(1).cast("long")), F.lit(SMALLEST_SHARE))

    shares = binned.withColumns({"_es": share("_e"), "_as": share("_a")})
    part = (F.col("_as") - F.col("_es")) * F.ln(F.col("_as") / F.col("_es"))
    sums = shares.groupBy("column", "_edges").agg(
        F.sum("_e").alias("_en"), F.sum("_a").alias("_an"), F.sum(F.when(F.col("_bin") > 0, part)).alias("_psi")
    )
    known = (F.col("_edges") >= 3) & (F.col("_en") > 0) & (F.col("_an") > 0)
    return sums.select("column", F.when(known, F.coalesce("_psi", F.lit(0.0))).alias("psi"))


def mean_shift(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """Mean of each column on both sides of a split, and the difference."""
    side = F.col("split")
    means = _long_numbers(df, columns, split).groupBy("column").agg(
        F.avg(F.when(side == "train", F.col("value"))).alias("train_mean"),
        F.avg(F.when(side == "test", F.col("value"))).alias("test_mean"),
    )
    return means.withColumn("delta_mean", F.col("test_mean") - F.col("train_mean"))


def numeric_shift(df: DataFrame, columns: Sequence[str], split: str = "split", approx: bool = False) -> DataFrame:
    named = [c for c in columns if c in df.columns]
    return mean_shift(df, named, split).join(stability_index(df, named, split, approx=approx), "column", "left")


def category_rates(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """Share of each value of each column on both sides of a split; 0 where it does not occur."""
    named = [c for c in columns if c in df.columns]
    filled = df.select(F.col(split).alias("split"), *[null_group(F.col(c)).alias(c) for c in named])
    side = F.col("split")
    totals = df.agg(
        F.struct(
            F.count_if(F.col(split) == "train").cast("double").alias("train"),
            F.count_if(F.col(split) == "test").cast("double").alias("test"),
        ).alias("t")
    ).scalar()
    counts = filled.unpivot(["split"], named, "column", "value").groupBy("column", "value").agg(
        F.count_if(side == "train").alias("train_count"), F.count_if(side == "test").alias("test_count")
    )
    with_totals = counts.withColumn("_t", totals)
    return with_totals.select(
        "column",
        "value",
        "train_count",
        "test_count",
        F.coalesce(F.try_divide("train_count", "_t.train"), F.lit(0.0)).alias("train_rate"),
        F.coalesce(F.try_divide("test_count", "_t.test"), F.lit(0.0)).alias("test_rate"),
    )


def category_shift(
    df: DataFrame, columns: Sequence[str], split: str = "split", top: int = TOP_PER_SIDE
) -> DataFrame:
    """Change of share for the values that are among the most frequent on either side."""
    rates = category_rates(df, columns, split)
    train = top_values(rates.where("train_count > 0"), top, count="train_count")
    test = top_values(rates.where("test_count > 0"), top, count="test_count")
    delta = F.col("test_rate") - F.col("train_rate")
    return (
        train.union(test)
        .distinct()
        .select(
            "column",
            "value",
            "train_rate",
            "test_rate",
            delta.alias("delta_rate"),
            F.abs(delta).alias("abs_delta_rate"),
        )
        .orderBy("column", F.col("abs_delta_rate").desc(), "value")
    )


def outer_rates(train: DataFrame, test: DataFrame) -> DataFrame:
    """Two rate tables (column, value, rate) side by side; a missing side counts as 0."""
    left = train.withColumnRenamed("rate", "train_rate")
    right = test.withColumnRenamed("rate", "test_rate")
    return left.join(right, ["column", "value"], "full_outer").na.fill(0.0, ["train_rate", "test_rate"])


def period_summary(df: DataFrame, period: str, target: str = TARGET) -> DataFrame:
    return df.groupBy(period).agg(
        F.count("*").alias("rows"),
        F.min("created").alias("start"),
        F.max("created").alias("end"),
        F.avg(target).alias("positive_rate"),
    )


def date_ranges(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.min("created").alias("start"), F.max("created").alias("end")
    )


def training_windows(periods: int = 5, initial: int = INITIAL_PERIODS, sliding: int = SLIDING_PERIODS) -> list[tuple]:
    """(strategy, test period, first and last training period) of each retraining run."""
    windows = []
    for test in range(initial + 1, periods + 1):
        windows += [
            ("static_initial_train", test, 1, initial),
            ("cumulative_retraining", test, 1, test - 1),
            ("sliding_window_2_periods", test, max(1, test - sliding), test - 1),
        ]
    return windows


def training_rows(binned: DataFrame, windows: Sequence[tuple]) -> DataFrame:
    """Each row once per run that trains on its period: ``strategy`` and ``test_period`` are added.

    A row learns its runs from its own period number, so nothing is joined or shuffled.
    """
    runs = F.array(
        *[
            F.struct(
                F.lit(strategy).alias("strategy"),
                F.lit(test).alias("test_period"),
                F.lit(first).alias("first"),
                F.lit(last).alias("last"),
            )
            for strategy, test, first, last in windows
        ]
    )
    mine = F.filter(runs, lambda r: (F.col("period") >= r["first"]) & (F.col("period") <= r["last"]))
    spread = binned.select("*", F.inline(mine))
    return spread.drop("first", "last")
