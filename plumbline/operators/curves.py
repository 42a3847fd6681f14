"""Exact average precision and ROC-AUC for any number of groups, rows and distinct scores.

Both need running totals of positives and negatives in order of the score, over counts per
(group, score). For groups of moderate size that is one window. For larger groups a window
would put a whole group into one task; there totals are run at three levels: over the coarse
slices of a group, over the fine slices of one coarse slice, and over the distinct scores of
one fine slice. A window of the first two levels holds at most ``SLICES`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICES = 65536


def _run_totals(df: DataFrame, within: Sequence[str], order: str, name: str) -> DataFrame:
    """Positives and negatives before each row, in descending order."""
    w = W.partitionBy(*within).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return df.withColumns(
        {
            f"{name}_pos": F.coalesce(F.sum("_pos").over(w), zero),
            f"{name}_neg": F.coalesce(F.sum("_neg").over(w), zero),
        }
    )


def with_running_totals(counts: DataFrame, keys: Sequence[str], score: str, pos: str, neg: str) -> DataFrame:
    """Parts of the two areas per row: ``_ap``, ``_area`` and the group totals ``_np``, ``_nn``."""
    group = W.partitionBy(*keys)
    down = group.orderBy(F.col(score).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = counts.withColumns(
        {
            "_np": F.sum(pos).over(group),
            "_nn": F.sum(neg).over(group),
            "_tp": F.sum(pos).over(down),
            "_fp": F.sum(neg).over(down),
        }
    )
    gain, area = _parts(F.col(pos), F.col(neg), F.col("_tp"), F.col("_fp"), F.col("_np"))
    return totals.withColumns({"_ap": gain, "_area": area}).drop("_tp", "_fp")


def _parts(pos: Column, neg: Column, tp: Column, fp: Column, positives: Column) -> tuple[Column, Column]:
    """What one score adds to the average precision and to the area under the ROC curve."""
    gain = pos.cast("double") / F.nullif(positives, F.lit(0)) * (tp / (tp + fp))
    return gain, neg.cast("double") * (tp - pos / 2.0)


def areas(gain: Column, area: Column, positives: Column, negatives: Column) -> dict[str, Column]:
    """Aggregates that turn the parts into the two areas."""
    pairs = F.max(positives.cast("double") * negatives)
    return {"pr_auc": F.sum(gain), "roc_auc": F.try_divide(F.sum(area), pairs)}


def ranking_curves(counts: DataFrame, keys: Sequence[str], score: str, pos: str, neg: str) -> DataFrame:
    """``pr_auc`` (average precision) and ``roc_auc`` per key, from counts per (key, score).

    Scores lie in [0, 1]; keys must not be NULL. ``pr_auc`` is NULL without positives and
    ``roc_auc`` NULL where a class is missing.
    """
    keys = list(keys)
    position = F.col(score) * F.lit(float(SLICES))
    coarse = F.floor(position)
    leaves = counts.select(
        *keys,
        F.col(score).alias("_score"),
        F.col(pos).alias("_pos"),
        F.col(neg).alias("_neg"),
        coarse.alias("_coarse"),
        F.floor((position - coarse) * F.lit(float(SLICES))).alias("_fine"),
    )

    def totals(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*keys, *by).agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))

    fine = totals(leaves, "_coarse", "_fine")
    per_key = W.partitionBy(*keys)
    top = _run_totals(totals(fine, "_coarse"), keys, "_coarse", "_a").select(
        *keys,
        "_coarse",
        "_a_pos",
        "_a_neg",
        F.sum("_pos").over(per_key).alias("_np"),
        F.sum("_neg").over(per_key).alias("_nn"),
    )
    middle = _run_totals(fine, [*keys, "_coarse"], "_fine", "_b").drop("_pos", "_neg")
    bottom = _run_totals(leaves, [*keys, "_coarse", "_fine"], "_score", "_c")
    joined = bottom.join(middle.join(top, [*keys, "_coarse"]), [*keys, "_coarse", "_fine"])

    tp = F.col("_a_pos") + F.col("_b_pos") + F.col("_c_pos") + F.col("_pos")
    fp = F.col("_a_neg") + F.col("_b_neg") + F.col("_c_neg") + F.col("_neg")
    gain, area = _parts(F.col("_pos"), F.col("_neg"), tp, fp, F.col("_np"))
    result = areas(gain, area, F.col("_np"), F.col("_nn"))
    return joined.groupBy(*keys).agg(*[c.alias(n) for n, c in result.items()])
