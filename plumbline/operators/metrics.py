"""Classification metrics of scored tables, for any grouping.

A scored table has one row per (run, record) with a 0/1 label, a probability and the group
columns. It is reduced once to counts per (keys, score); every metric follows from these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.grids import (
    DEFAULT_THRESHOLDS,
    FALLBACK_THRESHOLD,
    SWEEP_THRESHOLDS,
    TUNED_THRESHOLD,
    bin_edges,
    calibration_bin,
)
from plumbline.functions.scalars import absolute_error, count_reached, null_group, predicted, safe_ratio, zero_ratio
from plumbline.operators.curves import areas, ranking_curves, with_running_totals
from plumbline.operators.lookup import attach, large_groups, window_limit
from plumbline.session import stage

METRIC_COLUMNS = [
    "rows",
    "true_positive",
    "true_negative",
    "false_positive",
    "false_negative",
    "positive_rate_true",
    "positive_rate_predicted",
    "accuracy",
    "error_rate",
    "precision",
    "recall",
    "specificity",
    "false_positive_rate",
    "false_negative_rate",
    "negative_predictive_value",
    "f1",
    "balanced_accuracy",
    "pr_auc",
    "brier_score",
    "ece",
    "roc_auc",
]

# The metrics that comparisons and spreads are computed for.
QUALITY_METRICS = ["precision", "recall", "f1", "pr_auc", "brier_score", "ece", "roc_auc"]


def score_counts(scored: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Positives and negatives per (keys, score). A score that many rows share becomes one row."""
    label = F.col(y)
    return scored.groupBy(*keys, F.col(p).alias("_score")).agg(
        F.count_if(label == 1).alias("_pos"), F.count_if(label == 0).alias("_neg")
    )


def subgroup_counts(
    scored: DataFrame, features: Sequence[str], runs: Sequence[str], y: str = "y_true", p: str = "y_prob"
) -> DataFrame:
    """The ``score_counts`` of every value of every group column, for all runs.

    One row per run, group column (``subgroup_feature``), value (``subgroup_value``) and score. Group
    columns the table lacks are skipped; NULL is a group of its own. Rows are counted once per cell of all group columns and score. The cells, not the rows, are then
    spread to single columns, as their counts add up.
    """
    features = [f for f in features if f in scored.columns]
    cells = scored.groupBy(*runs, *[null_group(F.col(f)).alias(f"_g_{f}") for f in features], F.col(p).alias("_score"))
    cells = cells.agg(F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg"))
    named = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"_g_{f}").alias("v")) for f in features])
    long = cells.select(*runs, "_score", "_pos", "_neg", F.inline(named).alias("subgroup_feature", "subgroup_value"))
    keys = [*runs, "subgroup_feature", "subgroup_value", "_score"]
    return long.groupBy(*keys).agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))


def confusion_ratios(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Every ratio of the four confusion counts.

    Precision, recall and F1 are 0 where undefined, the others NULL. Balanced accuracy is the
    mean over the classes that occur.
    """
    rows = tp + tn + fp + fn
    recall, specificity = safe_ratio(tp, tp + fn), safe_ratio(tn, tn + fp)
    accuracy = safe_ratio(tp + tn, rows)
    return {
        "positive_rate_true": safe_ratio(tp + fn, rows),
        "positive_rate_predicted": safe_ratio(tp + fp, rows),
        "accuracy": accuracy,
        "error_rate": F.lit(1.0) - accuracy,
        "precision": zero_ratio(tp, tp + fp),
        "recall": zero_ratio(tp, tp + fn),
        "specificity": specificity,
        "false_positive_rate": safe_ratio(fp, fp + tn),
        "false_negative_rate": safe_ratio(fn, fn + tp),
        "negative_predictive_value": safe_ratio(tn, tn + fn),
        "f1": zero_ratio(tp * 2, tp * 2 + fp + fn),
        "balanced_accuracy": F.coalesce((recall + specificity) / 2.0, recall, specificity),
    }


def confusion_counts(
    scored: DataFrame, keys: Sequence[str], guess: Column, y: str = "y_true"
) -> DataFrame:
    """Counts of right and wrong predictions per key."""
    truth = F.col(y)
    return scored.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_if((guess == 1) & (truth == 1)).alias("true_positive"),
        F.count_if((guess == 0) & (truth == 0)).alias("true_negative"),
        F.count_if((guess == 1) & (truth == 0)).alias("false_positive"),
        F.count_if((guess == 0) & (truth == 1)).alias("false_negative"),
    )


def with_confusion_ratios(counts: DataFrame) -> DataFrame:
    names = ["true_positive", "true_negative", "false_positive", "false_negative"]
    return counts.withColumns(confusion_ratios(*[F.col(n) for n in names]))


def _sums(counts: DataFrame, keys: Sequence[str], guess: Column, bins: int, edges: str, curves: bool) -> DataFrame:
    """Per key: confusion counts, calibration and, from running totals if present, the areas."""
    pos, neg, score = F.col("_pos"), F.col("_neg"), F.col("_score")
    parts = [
        F.sum(pos + neg).alias("_n"),
        F.sum(pos).alias("_y"),
        F.sum((pos + neg) * score).alias("_p"),
        F.sum(pos * (1.0 - score) * (1.0 - score) + neg * score * score).alias("_sq"),
        F.sum(F.when(guess == 1, pos).otherwise(0)).alias("_tp"),
        F.sum(F.when(guess == 1, neg).otherwise(0)).alias("_fp"),
    ]
    if curves:
        parts += [F.sum("_ap").alias("_ap"), F.sum("_area").alias("_area")]
        parts += [F.max("_np").alias("_np"), F.max("_nn").alias("_nn")]
    binned = counts.groupBy(*keys, calibration_bin(score, bins, edges).alias("_bin")).agg(*parts)
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("_y") - F.col("_p")))
    totals = {
        "rows": F.sum("_n"),
        "true_positive": F.sum("_tp"),
        "true_negative": F.sum("_n") - F.sum("_y") - F.sum("_fp"),
        "false_positive": F.sum("_fp"),
        "false_negative": F.sum("_y") - F.sum("_tp"),
        "brier_score": F.try_divide(F.sum("_sq"), F.sum("_n")),
        "ece": F.try_divide(F.coalesce(F.sum(gap), F.lit(0.0)), F.sum("_n")),
    }
    if curves:
        totals.update(areas(F.col("_ap"), F.col("_area"), F.col("_np"), F.col("_nn")))
    return binned.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])


def evaluate(
    scored: DataFrame,
    keys: Sequence[str],
    threshold: Column | float = TUNED_THRESHOLD,
    edges: str = "closed0",
    bins: int = 10,
    min_rows: int = 0,
    curves: bool = True,
    one_class_ap: float | None = 0.0,
    y: str = "y_true",
    p: str = "y_prob",
    window_rows: int | None = None,
) -> DataFrame:
    """All metrics per key: ``keys`` + ``METRIC_COLUMNS`` (without the curves if so asked).

    ``threshold`` is a number or an expression of the keys. ``edges`` is the rule for bin
    edges in the calibration error. ``min_rows`` leaves out smaller groups. Average precision
    without positives is ``one_class_ap``; with ``None`` it is NULL whenever a class is missing.

    Groups of up to ``window_rows`` rows take one pass: one shuffle of the counts by (key,
    score), one by key. Larger groups get their areas from running totals over score slices.
    """
    counts = score_counts(scored, keys, y, p)
    return evaluate_counts(counts, scored, keys, threshold, edges, bins, min_rows, curves, one_class_ap, window_rows)


def evaluate_counts(
    counts: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    threshold: Column | float = TUNED_THRESHOLD,
    edges: str = "closed0",
    bins: int = 10,
    min_rows: int = 0,
    curves: bool = True,
    one_class_ap: float | None = 0.0,
    window_rows: int | None = None,
) -> DataFrame:
    """``evaluate`` for counts per (key, score) of a table ``source``.

    No group has more rows than ``source``, so a short one needs no look at the groups.
    """
    keys = list(keys)
    guess = predicted(F.col("_score"), threshold)
    names = [m for m in METRIC_COLUMNS if curves or m not in ("pr_auc", "roc_auc")]

    def one_pass(part: DataFrame) -> DataFrame:
        if curves:
            part = with_running_totals(part, keys, "_score", "_pos", "_neg")
        return _sums(part, keys, guess, bins, edges, curves)

    def in_slices(part: DataFrame) -> DataFrame:
        sums = _sums(part, keys, guess, bins, edges, False)
        ranked = ranking_curves(part, keys, "_score", "_pos", "_neg")
        if keys:
            return sums.join(ranked, keys)
        pair = ranked.select(F.struct("pr_auc", "roc_auc").alias("c")).scalar()
        return sums.withColumn("_c", pair).select("*", "_c.pr_auc", "_c.roc_auc").drop("_c")

    large = None
    if curves and source.count() > window_limit(source, window_rows):
        # The counts are read several times from here on. A window holds them, not the rows.
        counts = stage(counts, "score-counts")
        large = large_groups(counts, keys, window_rows)
    if large is None:
        sums = one_pass(counts)
    elif not keys:
        sums = in_slices(counts)
    else:
        small_part = one_pass(counts.join(large, keys, "left_anti"))
        sums = small_part.unionByName(in_slices(counts.join(large, keys, "left_semi")))
    if min_rows > 0:
        sums = sums.where(F.col("rows") >= min_rows)
    result = with_confusion_ratios(sums)
    if curves:
        if one_class_ap is None:
            ap = F.when(F.col("roc_auc").isNotNull(), F.col("pr_auc"))
        else:
            ap = F.coalesce(F.col("pr_auc"), F.lit(one_class_ap))
        result = result.withColumn("pr_auc", ap)
    return result.select(*keys, *names)


def subgroup_metrics(
    scored: DataFrame,
    features: Sequence[str],
    runs: Sequence[str] = ("model",),
    threshold: Column | float = 0.5,
    min_rows: int = 30,
    **options,
) -> DataFrame:
    """Metrics of every value of every group column, for all runs in one plan."""
    keys = [*runs, "subgroup_feature", "subgroup_value"]
    counts = subgroup_counts(scored, features, runs, options.pop("y", "y_true"), options.pop("p", "y_prob"))
    return evaluate_counts(counts, scored, keys, threshold=threshold, min_rows=min_rows, **options)


def expected_calibration_error(
    scored: DataFrame, keys: Sequence[str], bins: int = 10, edges: str = "closed0", y: str = "y_true", p: str = "y_prob"
) -> DataFrame:
    """Calibration error per key: mean over rows of the gap between label rate and score per bin."""
    per_bin = scored.groupBy(*keys, calibration_bin(F.col(p), bins, edges).alias("_bin")).agg(
        F.count("*").alias("_n"), F.sum(y).alias("_y"), F.sum(p).alias("_p")
    )
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("_y") - F.col("_p")))
    return per_bin.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), (F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("_n")).alias("ece")
    )


def brier(scored: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_prob") -> DataFrame:
    error = F.col(p) - F.col(y)
    return scored.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(error * error).alias("brier_score"))


def calibration_table(
    scored: DataFrame, keys: Sequence[str], bins: int = 10, y: str = "y_true", p: str = "y_prob"
) -> DataFrame:
    """One row per key and probability bin, empty bins included."""
    keys = list(keys)
    per_bin = scored.groupBy(*keys, calibration_bin(F.col(p), bins, "closed0").alias("bin")).agg(
        F.count("*").alias("_n"), F.avg(p).alias("_mp"), F.avg(y).alias("_my")
    )
    # One bounded array per key lets the empty bins be filled in without a join.
    found = F.map_from_entries(F.collect_list(F.struct("bin", F.struct("_n", "_mp", "_my"))))
    per_key = per_bin.groupBy(*keys).agg(F.sum("_n").alias("_total"), found.alias("_found"))
    limits = bin_edges(bins)
    frame = F.array(
        *[
            F.struct(F.lit(i + 1).alias("bin"), F.lit(limits[i]).alias("bin_lower"), F.lit(limits[i + 1]).alias("bin_upper"))
            for i in range(bins)
        ]
    )
    full = per_key.select(*keys, "_total", "_found", F.inline(frame))
    got = full.withColumn("_b", F.try_element_at(F.col("_found"), F.col("bin")))
    rows = F.coalesce(F.col("_b._n"), F.lit(0).cast("long"))
    return got.select(
        *keys,
        "bin",
        "bin_lower",
        "bin_upper",
        rows.alias("rows"),
        F.col("_b._mp").alias("mean_predicted_probability"),
        F.col("_b._my").alias("observed_positive_rate"),
        (F.col("_b._my") - F.col("_b._mp")).alias("calibration_gap"),
        safe_ratio(rows, F.col("_total")).alias("bin_weight"),
    )


def threshold_counts(
    scored: DataFrame,
    keys: Sequence[str],
    thresholds: Sequence[float] = SWEEP_THRESHOLDS,
    y: str = "y_true",
    p: str = "y_prob",
) -> DataFrame:
    """Confusion counts per key and threshold from one scan.

    Each score is filed under the number of thresholds it reaches; the counts at a threshold
    are the sums over all higher files.
    """
    keys, grid = list(keys), sorted(thresholds)
    filed = scored.groupBy(*keys, count_reached(F.col(p), grid).alias("_k")).agg(
        F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg")
    )
    # At most len(grid) + 1 files per key: gather them and add up those above each threshold.
    per_key = filed.groupBy(*keys).agg(
        F.collect_list(F.struct("_k", "_pos", "_neg")).alias("_files"),
        F.sum("_pos").alias("_np"),
        F.sum("_neg").alias("_nn"),
    )
    steps = F.posexplode(F.array(*[F.lit(float(t)) for t in grid]))
    spread = per_key.select(*keys, "_files", "_np", "_nn", steps.alias("_i", "threshold"))

    def reached(part: str) -> Column:
        above = F.filter(F.col("_files"), lambda f: f["_k"] > F.col("_i"))
        return F.aggregate(above, F.lit(0).cast("long"), lambda total, f: total + f[part])

    long = spread.withColumns({"true_positive": reached("_pos"), "false_positive": reached("_neg")})
    return long.select(
        *keys,
        "threshold",
        (F.col("_np") + F.col("_nn")).alias("rows"),
        "true_positive",
        (F.col("_nn") - F.col("false_positive")).alias("true_negative"),
        "false_positive",
        (F.col("_np") - F.col("true_positive")).alias("false_negative"),
    )


def threshold_sweep(
    scored: DataFrame,
    keys: Sequence[str] = ("model",),
    thresholds: Sequence[float] = SWEEP_THRESHOLDS,
    edges: str = "open0",
) -> DataFrame:
    """Metrics per key and threshold. Those that need no threshold are computed once per key."""
    keys = list(keys)
    counts = with_confusion_ratios(threshold_counts(scored, keys, thresholds))
    fixed = evaluate(scored, keys, edges=edges).select(*keys, "pr_auc", "brier_score", "ece", "roc_auc")
    return counts.join(fixed, keys).select(
        *keys,
        "threshold",
        "rows",
        "positive_rate_true",
        "positive_rate_predicted",
        *QUALITY_METRICS,
    )


def best_by_f1(sweep: DataFrame, keys: Sequence[str] = ("model",), min_recall: float | None = None) -> DataFrame:
    """The row with the best F1 per key, the lowest threshold on ties."""
    rows = sweep if min_recall is None else sweep.where(F.col("recall") >= min_recall)
    best = F.max_by(F.struct(*[c for c in sweep.columns if c not in keys]), F.struct("f1", -F.col("threshold")))
    return rows.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def first_best_by_f1(sweep: DataFrame, keys: Sequence[str] = ("model",), min_recall: float = 0.0) -> DataFrame:
    """The same choice as a sort within each key of a sweep, which has few rows per key."""
    order = W.partitionBy(*keys).orderBy(F.col("f1").desc(), "threshold")
    ranked = sweep.where(F.col("recall") >= min_recall).withColumn("_r", F.row_number().over(order))
    return ranked.where("_r = 1").drop("_r")


def with_model_threshold(scored: DataFrame, tuned: DataFrame | None = None) -> DataFrame:
    """A ``threshold`` per model: the tuned one, else the default of that model, else 0.5."""
    default = F.lit(FALLBACK_THRESHOLD)
    for model, value in DEFAULT_THRESHOLDS.items():
        default = F.when(F.col("model") == model, value).otherwise(default)
    if tuned is None:
        return scored.withColumn("threshold", default)
    joined = attach(scored, tuned.select("model", F.col("threshold").alias("_tuned")), ["model"])
    return joined.withColumn("threshold", F.coalesce("_tuned", default)).drop("_tuned")


def prediction_audit(scored: DataFrame) -> DataFrame:
    """Row-level record of score, threshold, prediction and error."""
    return scored.select(
        "key",
        "created",
        "model",
        "y_true",
        F.col("y_prob").alias("y_probability"),
        "threshold",
        predicted(F.col("y_prob"), F.col("threshold")).alias("y_predicted"),
        absolute_error(F.col("y_true"), F.col("y_prob")).alias("absolute_probability_error"),
    )
