"""Row weights and per-group thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grids import MITIGATION_THRESHOLDS, TUNED_THRESHOLD
from plumbline.functions.scalars import null_group, predicted, safe_ratio
from plumbline.operators.lookup import attach
from plumbline.operators.metrics import best_by_f1, confusion_counts, threshold_counts, with_confusion_ratios
from plumbline.operators.prepare import TARGET

TARGET_RECALL = 0.65
LEAST_ROWS = 30


def _inverse_frequency(df: DataFrame, keys: dict[str, Column], name: str) -> DataFrame:
    """n / (k * n_key) for each of the k keys that occur."""
    keyed = df.withColumns(keys)
    counts = keyed.groupBy(*keys).agg(F.count("*").cast("double").alias("_c"))
    totals = counts.agg(F.struct(F.sum("_c").alias("n"), F.count("*").alias("k")).alias("t")).scalar()
    weights = counts.withColumn("_t", totals).select(*keys, (F.col("_t.n") / (F.col("_t.k") * F.col("_c"))).alias(name))
    return attach(keyed, weights, list(keys)).drop(*keys)


def group_weights(df: DataFrame, group: str, name: str = "weight") -> DataFrame:
    """Every group gets the same total weight."""
    return _inverse_frequency(df, {"_g": null_group(F.col(group))}, name)


def group_class_weights(df: DataFrame, group: str, target: str = TARGET, name: str = "weight") -> DataFrame:
    """Every combination of group and class gets the same total weight."""
    return _inverse_frequency(df, {"_g": null_group(F.col(group)), "_y": F.col(target)}, name)


def class_weights(df: DataFrame, target: str = TARGET, name: str = "weight") -> DataFrame:
    """Both classes get the same total weight: n / (2 * n_class)."""
    counts = df.agg(
        F.struct(
            F.count_if(F.col(target) == 1).cast("double").alias("pos"),
            F.count_if(F.col(target) == 0).cast("double").alias("neg"),
        ).alias("c")
    ).scalar()
    with_counts = df.withColumn("_c", counts)
    own = F.when(F.col(target) == 1, F.col("_c.pos")).otherwise(F.col("_c.neg"))
    return with_counts.withColumn(name, (F.col("_c.pos") + F.col("_c.neg")) / (own * 2.0)).drop("_c")


def best_global_threshold(
    scored: DataFrame, keys: Sequence[str] = (), thresholds: Sequence[float] = tuple(MITIGATION_THRESHOLDS)
) -> DataFrame:
    """The threshold with the best F1 per key, the lowest on ties."""
    sweep = with_confusion_ratios(threshold_counts(scored, keys, thresholds))
    return best_by_f1(sweep, keys).select(*keys, "threshold", "precision", "recall", "f1")


def group_thresholds(
    scored: DataFrame,
    group: str,
    target_recall: float = TARGET_RECALL,
    min_rows: int = LEAST_ROWS,
    thresholds: Sequence[float] = tuple(MITIGATION_THRESHOLDS),
    keys: Sequence[str] = (),
) -> DataFrame:
    """The highest threshold per group (and ``keys``) that still reaches a recall.

    0.25 for groups that are small, have one class only, or never reach it.
    """
    every = [*keys, "group_value"]
    named = scored.select(*keys, null_group(F.col(group)).alias("group_value"), "y_true", "y_prob")
    counts = threshold_counts(named, every, thresholds)
    positives = F.col("true_positive") + F.col("false_negative")
    reached = safe_ratio(F.col("true_positive"), positives) >= target_recall
    usable = (F.col("rows") >= min_rows) & (positives > 0) & (positives < F.col("rows"))
    best = F.max(F.when(usable & reached, F.col("threshold")))
    return counts.groupBy(*every).agg(F.coalesce(best, F.lit(TUNED_THRESHOLD)).alias("threshold"))


def with_group_threshold(scored: DataFrame, group: str, thresholds: DataFrame) -> DataFrame:
    """Each row with the threshold of its group (0.25 for unknown groups) and the prediction."""
    named = scored.withColumn("group_value", null_group(F.col(group)))
    joined = attach(named, thresholds, ["group_value"])
    limit = F.coalesce("threshold", F.lit(TUNED_THRESHOLD))
    return joined.withColumn("threshold", limit).withColumn("y_pred", predicted(F.col("y_prob"), F.col("threshold")))


def confusion_of_predictions(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics of given 0/1 predictions."""
    return with_confusion_ratios(confusion_counts(predictions, keys, F.col("y_pred")))
