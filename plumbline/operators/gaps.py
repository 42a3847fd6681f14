"""Comparisons between groups, runs and a reference run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import finite
from plumbline.operators.metrics import QUALITY_METRICS

TIE_DIGITS = 12

# The metrics of each comparison.
GAP_METRICS = ["positive_rate", "precision", "recall", "f1", "pr_auc", "brier_score", "ece"]
DISPARITY_METRICS = ["precision", "recall", "f1", "fpr", "fnr", "ece", "brier_score"]
FAIRNESS_METRICS = [
    "precision",
    "recall",
    "f1",
    "fpr",
    "fnr",
    "positive_rate_predicted",
    "brier_score",
    "ece",
    "roc_auc",
    "pr_auc",
]


def subgroup_gaps(
    subgroups: DataFrame,
    overall: DataFrame,
    metrics: Sequence[str] = GAP_METRICS,
    min_rows: int = 30,
    on: str = "model",
) -> DataFrame:
    """Each subgroup metric beside the overall one, with gap and absolute gap.

    Subgroups of a run without overall metrics are dropped.
    """
    shared = [m for m in metrics if m in subgroups.columns and m in overall.columns]
    whole = overall.select(on, *[F.col(m).alias(f"{m}_overall") for m in shared])
    joined = subgroups.where(F.col("rows") >= min_rows).join(whole, on, "inner")
    columns: list[Column] = []
    for m in shared:
        gap = F.col(m) - F.col(f"{m}_overall")
        columns += [
            F.col(m).alias(f"{m}_subgroup"),
            F.col(f"{m}_overall"),
            gap.alias(f"{m}_gap"),
            F.abs(gap).alias(f"{m}_abs_gap"),
        ]
    return joined.select(on, "subgroup_feature", "subgroup_value", "rows", *columns)


def gap_summary(gaps: DataFrame, metrics: Sequence[str] = GAP_METRICS, on: str = "model") -> DataFrame:
    """Largest and mean absolute gap per run and group column."""
    aggregates = [F.count("*").alias("subgroups")]
    for m in metrics:
        if f"{m}_abs_gap" in gaps.columns:
            gap = finite(F.col(f"{m}_abs_gap"))
            aggregates += [F.max(gap).alias(f"max_abs_{m}_gap"), F.avg(gap).alias(f"mean_abs_{m}_gap")]
    return gaps.groupBy(on, "subgroup_feature").agg(*aggregates)


def long_metrics(table: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    numbers = [F.col(m).cast("double").alias(m) for m in metrics]
    return table.select(*ids, *numbers).unpivot(list(ids), list(metrics), "metric", "value")


def disparity(groups: DataFrame, run: str, metrics: Sequence[str] = DISPARITY_METRICS) -> DataFrame:
    """Spread of each metric over the groups of a run."""
    stats = long_metrics(groups, [run], metrics).groupBy(run, "metric").agg(
        (F.max("value") - F.min("value")).alias("absolute_gap"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )
    return stats.where(F.col("max_value").isNotNull())


def fairness_disparity(
    groups: DataFrame,
    metrics: Sequence[str] = FAIRNESS_METRICS,
    min_rows: int = 30,
    lower_is_better: Sequence[str] = (),
) -> DataFrame:
    """Spread, ratio, and the groups with the extreme values, per model and group column.

    The lowest value counts as worst for every metric not named in ``lower_is_better``; ties,
    up to the noise of summation order, go to the group that sorts first.
    """
    eligible = groups.where(F.col("rows") >= min_rows)
    long = long_metrics(eligible, ["model", "group_feature", "group_value"], metrics)
    group, value = F.col("group_value"), F.col("value")
    known, level = value.isNotNull(), F.round(value, TIE_DIGITS)
    lowest = F.min_by(F.when(known, group), F.when(known, F.struct(level, group)))
    highest = F.min_by(F.when(known, group), F.when(known, F.struct(-level, group)))
    stats = long.groupBy("model", "group_feature", "metric").agg(
        F.count("*").alias("groups_considered"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        lowest.alias("_low"),
        highest.alias("_high"),
    )
    flipped = F.col("metric").isin(*lower_is_better) if lower_is_better else F.lit(False)
    return stats.where(F.col("max_value").isNotNull()).select(
        "model",
        "group_feature",
        "metric",
        "groups_considered",
        "min_value",
        "max_value",
        (F.col("max_value") - F.col("min_value")).alias("absolute_gap"),
        F.try_divide("min_value", "max_value").alias("min_max_ratio"),
        F.when(flipped, F.col("_high")).otherwise(F.col("_low")).alias("worst_group"),
        F.when(flipped, F.col("_low")).otherwise(F.col("_high")).alias("best_group"),
    )


def deltas_to_run(
    table: DataFrame,
    reference: Column,
    metrics: Sequence[str] = QUALITY_METRICS,
    pattern: str = "delta_{}",
) -> DataFrame:
    """Differences to the one row that ``reference`` selects, read as a scalar."""
    base = table.where(reference).agg(*[F.first(m).alias(m) for m in metrics])
    row = base.select(F.struct(*metrics).alias("r")).scalar()
    with_base = table.withColumn("_base", row)
    named = {pattern.format(m): F.col(m) - F.col(f"_base.{m}") for m in metrics}
    return with_base.withColumns(named).drop("_base")


def versus_static(
    metrics_table: DataFrame, static: str = "static_initial_train", metrics: Sequence[str] = QUALITY_METRICS
) -> DataFrame:
    """Strategy metrics beside those of the static strategy for the same test period."""
    fixed = metrics_table.where(F.col("strategy") == static)
    fixed = fixed.select("test_period", *[F.col(m).alias(f"static_{m}") for m in metrics])
    joined = metrics_table.join(fixed, "test_period", "left")
    return joined.withColumns({f"delta_vs_static_{m}": F.col(m) - F.col(f"static_{m}") for m in metrics})


def strategy_summary(
    metrics_table: DataFrame, static: str = "static_initial_train", metrics: Sequence[str] = QUALITY_METRICS
) -> DataFrame:
    """Mean metrics per strategy and their difference to the static one."""
    means = metrics_table.groupBy("strategy").agg(
        F.count_distinct("test_period").alias("periods"),
        *[F.avg(m).alias(f"avg_{m}") for m in metrics],
    )
    averages = [f"avg_{m}" for m in metrics]
    compared = deltas_to_run(means, F.col("strategy") == static, averages, "delta_{}_vs_static")
    return compared


def disparity_tradeoffs(disparities: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Each strategy's gap beside the baseline's gap for the same metric."""
    base = disparities.where(F.col("strategy") == baseline).select("metric", F.col("absolute_gap").alias("baseline_gap"))
    joined = disparities.join(base, "metric", "left")
    return joined.withColumn("delta_gap_vs_baseline", F.col("absolute_gap") - F.col("baseline_gap"))


def seed_spread(seed_metrics: DataFrame, metrics: Sequence[str] = QUALITY_METRICS) -> DataFrame:
    """Mean, deviation, range and variation of each metric over the runs."""
    long = long_metrics(seed_metrics, [], metrics)
    stats = long.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return stats.withColumns(
        {
            "range": F.col("max") - F.col("min"),
            "coefficient_of_variation": F.try_divide("std", "mean"),
        }
    )
