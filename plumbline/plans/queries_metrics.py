"""Registered queries: classification metrics, calibration, thresholds, subgroups."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.grids import MITIGATION_THRESHOLDS, SWEEP_THRESHOLDS, bin_edges
from plumbline.operators import gaps, metrics, mitigation
from plumbline.operators.metrics import METRIC_COLUMNS
from plumbline.plans.metric_sql import bin_sql, long_groups_sql, metrics_sql, pick, sweep_sql
from plumbline.plans.registry import query, rounded
from plumbline.plans.views import GROUPS, r, scored, sql

SUBGROUPS = ["project_key", "issuetype", "priority"]

OVERALL = metrics_sql("overall", "scored", ["model"], "0.5e0", "open0")
SUBGROUP = (
    long_groups_sql("spread", "scored", SUBGROUPS, "model, y_true, y_prob"),
    metrics_sql("grouped", "spread", ["model", "subgroup_feature", "subgroup_value"], "0.5e0", "open0", min_rows=30),
)


def overall(spark, sf_dir):
    return metrics.evaluate(scored(spark, sf_dir), ["model"], 0.5, "open0")


def subgroups(spark, sf_dir, features=SUBGROUPS, **options):
    settings = {"threshold": 0.5, "edges": "open0", **options}
    return metrics.subgroup_metrics(scored(spark, sf_dir), features, **settings)


@query(
    "M01_confusion_counts",
    sql(
        "scored",
        "select model, project_key, " + pick(["rows", "true_positive", "true_negative", "false_positive", "false_negative"])
        + " from m_c_named",
        metrics_sql("m", "scored", ["model", "project_key"]),
        "m_c_named as (select * from m)",
    ),
)
def _(spark, sf_dir):
    guess = (F.col("y_prob") >= 0.25).cast("int")
    return metrics.confusion_counts(scored(spark, sf_dir), ["model", "project_key"], guess)


@query(
    "M02_precision_recall_f1",
    sql(
        "scored",
        "select model, project_key, " + pick(["precision", "recall", "f1"]) + " from m",
        metrics_sql("m", "scored", ["model", "project_key"], "0.95e0"),
    ),
)
def _(spark, sf_dir):
    counts = metrics.confusion_counts(
        scored(spark, sf_dir), ["model", "project_key"], (F.col("y_prob") >= 0.95).cast("int")
    )
    return rounded(metrics.with_confusion_ratios(counts).select("model", "project_key", "precision", "recall", "f1"))


RATES = [
    "accuracy",
    "error_rate",
    "specificity",
    "false_positive_rate",
    "false_negative_rate",
    "negative_predictive_value",
    "balanced_accuracy",
]


@query(
    "M03_error_rates",
    sql(
        "scored",
        f"select model, created_year, created_month, {pick(RATES)} from m",
        metrics_sql("m", "scored", ["model", "created_year", "created_month"]),
    ),
)
def _(spark, sf_dir):
    keys = ["model", "created_year", "created_month"]
    return rounded(metrics.evaluate(scored(spark, sf_dir), keys, 0.25, curves=False).select(*keys, *RATES))


@query(
    "M04_positive_rates",
    sql(
        "scored",
        f"""select model, status, {r("avg(y_true)")} as positive_rate_true,
                   {r("avg(cast(y_prob >= 0.25e0 as int))")} as positive_rate_predicted from scored group by all""",
    ),
)
def _(spark, sf_dir):
    rows = metrics.evaluate(scored(spark, sf_dir), ["model", "status"], 0.25, curves=False)
    return rounded(rows.select("model", "status", "positive_rate_true", "positive_rate_predicted"))


@query(
    "M05_brier_score",
    sql(
        "scored",
        f"""select model, issuetype, count(*) as rows, {r("avg((y_prob - y_true) * (y_prob - y_true))")} as brier_score
            from scored group by all""",
    ),
)
def _(spark, sf_dir):
    return rounded(metrics.brier(scored(spark, sf_dir), ["model", "issuetype"]))


def _ece_sql(edges):
    return f"""select '{edges}' as edges, model, cast(sum(n) as bigint) as rows,
                      {r("sum(case when bin is not null then g else 0 end) / sum(n)")} as ece
               from (select model, {bin_sql(edges=edges)} as bin, count(*) as n, abs(sum(y_true) - sum(y_prob)) as g
                     from scored group by model, bin) group by model"""


@query(
    "M06_calibration_error",
    sql("scored", " union all ".join(_ece_sql(e) for e in ("open0", "closed0", "left"))),
)
def _(spark, sf_dir):
    df = scored(spark, sf_dir)
    parts = [
        metrics.expected_calibration_error(df, ["model"], edges=e).withColumn("edges", F.lit(e))
        for e in ("open0", "closed0", "left")
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


_BINS = 12
_LIMITS = ", ".join(
    f"({i + 1}, {low!r}e0, {high!r}e0)" for i, (low, high) in enumerate(zip(bin_edges(_BINS), bin_edges(_BINS)[1:]))
)
CALIBRATION = f"""
select model, bin, {r("bin_lower")} as bin_lower, {r("bin_upper")} as bin_upper, coalesce(n, 0) as rows,
       {r("mp")} as mean_predicted_probability, {r("my")} as observed_positive_rate, {r("my - mp")} as calibration_gap,
       {r("coalesce(n, 0) * 1e0 / total")} as bin_weight
from (select * from (select model, count(*) as total from s group by 1), (values {_LIMITS}) t(bin, bin_lower, bin_upper))
left join (select model, {bin_sql(bins=_BINS)} as bin, count(*) as n, avg(y_prob) as mp, avg(y_true) as my
           from s group by all) b using (model, bin)"""


@query(
    "M07_calibration_table",
    sql("scored", CALIBRATION, "s as (select model, y_true, y_prob * 0.75e0 as y_prob from scored)"),
)
def _(spark, sf_dir):
    narrowed = scored(spark, sf_dir).withColumn("y_prob", F.col("y_prob") * 0.75)
    return rounded(metrics.calibration_table(narrowed, ["model"], bins=_BINS))


@query(
    "M08_average_precision",
    sql(
        "scored",
        "select model, project_key, created_year, " + pick(["pr_auc"]) + " from m",
        metrics_sql("m", "scored", ["model", "project_key", "created_year"]),
    ),
)
def _(spark, sf_dir):
    keys = ["model", "project_key", "created_year"]
    return rounded(metrics.evaluate(scored(spark, sf_dir), keys).select(*keys, "pr_auc"))


# Cells of one project in one month are small, and many hold one class only.
_CELL = ["model", "project_key", "created_year", "created_month"]


@query(
    "M09_roc_auc",
    sql(
        "scored",
        "select model, 'all' as cell, " + pick(["roc_auc"]) + " from w union all "
        "select model, project_key || '-' || created_year || '-' || created_month, " + pick(["roc_auc"]) + " from m",
        metrics_sql("w", "scored", ["model"]),
        metrics_sql("m", "scored", _CELL),
    ),
)
def _(spark, sf_dir):
    df = scored(spark, sf_dir)
    whole = metrics.evaluate(df, ["model"]).select("model", F.lit("all").alias("cell"), "roc_auc")
    cells = metrics.evaluate(df, _CELL).select("model", F.concat_ws("-", *_CELL[1:]).alias("cell"), "roc_auc")
    return rounded(whole.union(cells))


SWEEP = (
    metrics_sql("fixed", "scored", ["model"], edges="open0"),
    sweep_sql("sweep", "scored", ["model"], SWEEP_THRESHOLDS, "fixed"),
)
SWEEP_COLUMNS = ["positive_rate_true", "positive_rate_predicted", *metrics.QUALITY_METRICS]
SWEEP_SELECT = f"select model, {r('threshold')} as threshold, rows, {pick(SWEEP_COLUMNS)} from"


@query("M10_threshold_sweep", sql("scored", f"{SWEEP_SELECT} sweep", *SWEEP))
def _(spark, sf_dir):
    return rounded(metrics.threshold_sweep(scored(spark, sf_dir)))


_BEST = "(select *, row_number() over (partition by model order by f1 desc, threshold) as rn from sweep{0}) where rn = 1"


@query("M11_best_f1_threshold", sql("scored", f"{SWEEP_SELECT} {_BEST.format('')}", *SWEEP))
def _(spark, sf_dir):
    return rounded(metrics.best_by_f1(metrics.threshold_sweep(scored(spark, sf_dir))))


@query("M12_best_f1_with_recall", sql("scored", f"{SWEEP_SELECT} {_BEST.format(' where recall >= 0.6e0')}", *SWEEP))
def _(spark, sf_dir):
    return rounded(metrics.best_by_f1(metrics.threshold_sweep(scored(spark, sf_dir)), min_recall=0.60))


@query(
    "M13_best_global_threshold",
    sql(
        "scored",
        f"""select model, {r('threshold')} as threshold, {pick(["precision", "recall", "f1"])}
            from {_BEST.format('')}""",
        sweep_sql("sweep", "scored", ["model"], MITIGATION_THRESHOLDS, None),
    ),
)
def _(spark, sf_dir):
    return rounded(mitigation.best_global_threshold(scored(spark, sf_dir), ["model"]))


GROUP_THRESHOLDS = (
    "base as (select *, coalesce(project_key, '__NULL__') as group_value from scored)",
    sweep_sql("sweep", "base", ["model", "group_value"], MITIGATION_THRESHOLDS, None),
    """limits as (select model, group_value, coalesce(max(case when recall >= 0.65e0 and sweep.rows >= 30 and tp + fn > 0
                         and fp + tn > 0 then threshold end), 0.25e0) as threshold from sweep group by 1, 2)""",
)


@query(
    "M14_group_recall_threshold",
    sql("scored", f"select model, group_value, {r('threshold')} as threshold from limits", *GROUP_THRESHOLDS),
)
def _(spark, sf_dir):
    return rounded(mitigation.group_thresholds(scored(spark, sf_dir), "project_key", keys=["model"]))


@query(
    "M15_subgroup_metrics",
    sql(
        "scored",
        f"select model, subgroup_feature, subgroup_value, {pick(METRIC_COLUMNS)} from g",
        long_groups_sql("spread", "scored", GROUPS, "model, y_true, y_prob"),
        metrics_sql(
            "g", "spread", ["model", "subgroup_feature", "subgroup_value"], "0.5e0", "open0", min_rows=30
        ),
    ),
)
def _(spark, sf_dir):
    return rounded(subgroups(spark, sf_dir, GROUPS))


@query(
    "M16_prediction_audit",
    sql(
        "scored",
        f"""select key, created, model, y_true, {r("y_prob")} as y_probability, threshold,
                   cast(y_prob >= threshold as int) as y_predicted, {r("abs(y_true - y_prob)")} as absolute_probability_error
            from (select *, case model when 'random_forest' then 0.25e0 else 0.5e0 end as threshold from scored)""",
    ),
)
def _(spark, sf_dir):
    return rounded(metrics.prediction_audit(metrics.with_model_threshold(scored(spark, sf_dir))))


@query("M17_model_comparison", sql("scored", f"select model, {pick(METRIC_COLUMNS)} from overall", OVERALL))
def _(spark, sf_dir):
    return rounded(overall(spark, sf_dir))


@query("M18_calibration_summary", sql("scored", f"select model, {pick(['brier_score', 'ece'])} from overall", OVERALL))
def _(spark, sf_dir):
    return rounded(metrics.evaluate(scored(spark, sf_dir), ["model"], 0.5, "open0", curves=False).select("model", "brier_score", "ece"))


# ---------------------------------------------------------------- gaps


def _renamed(df):
    return df.withColumnRenamed("positive_rate_true", "positive_rate")


def all_gaps(spark, sf_dir):
    return gaps.subgroup_gaps(_renamed(subgroups(spark, sf_dir)), _renamed(overall(spark, sf_dir)))


def _metric_name(m):
    return "positive_rate_true" if m == "positive_rate" else m


GAPS = "gaps as (select model, subgroup_feature, subgroup_value, g.rows as rows, " + ", ".join(
    f'g."{_metric_name(m)}" as {m}_subgroup, o."{_metric_name(m)}" as {m}_overall' for m in gaps.GAP_METRICS
) + " from grouped g join overall o using (model))"
GAP_SELECT = "select model, subgroup_feature, subgroup_value, rows, " + ", ".join(
    f"{r(f'{m}_subgroup')} as {m}_subgroup, {r(f'{m}_overall')} as {m}_overall, "
    f"{r(f'{m}_subgroup - {m}_overall')} as {m}_gap, {r(f'abs({m}_subgroup - {m}_overall)')} as {m}_abs_gap"
    for m in gaps.GAP_METRICS
) + " from gaps"
GAP_CTES = (OVERALL, *SUBGROUP, GAPS)


@query("J01_subgroup_join_overall", sql("scored", GAP_SELECT, *GAP_CTES))
def _(spark, sf_dir):
    return rounded(all_gaps(spark, sf_dir))


@query(
    "P29_delta_and_absolute_delta",
    sql(
        "scored",
        f"""select model, subgroup_feature, subgroup_value, {r("f1_subgroup - f1_overall")} as f1_gap,
                   {r("abs(f1_subgroup - f1_overall)")} as f1_abs_gap from gaps""",
        *GAP_CTES,
    ),
)
def _(spark, sf_dir):
    return rounded(all_gaps(spark, sf_dir).select("model", "subgroup_feature", "subgroup_value", "f1_gap", "f1_abs_gap"))


GAP_SUMMARY = "select model, subgroup_feature, count(*) as subgroups, " + ", ".join(
    f"{r(f'max(abs({m}_subgroup - {m}_overall))')} as max_abs_{m}_gap, "
    f"{r(f'avg(abs({m}_subgroup - {m}_overall))')} as mean_abs_{m}_gap"
    for m in gaps.GAP_METRICS
) + " from gaps group by all"


@query("A13_gap_summary", sql("scored", GAP_SUMMARY, *GAP_CTES))
def _(spark, sf_dir):
    return rounded(gaps.gap_summary(all_gaps(spark, sf_dir)))


@query(
    "A18_group_eligibility",
    sql(
        "scored",
        """select model, subgroup_feature, subgroup_value, count(*) as rows from spread
           group by all having count(*) >= 100""",
        SUBGROUP[0],
    ),
)
def _(spark, sf_dir):
    found = subgroups(spark, sf_dir, min_rows=100, curves=False)
    return found.select("model", "subgroup_feature", "subgroup_value", "rows")


@query(
    "J06_score_to_bin",
    sql("scored", f"select model, id, {bin_sql()} as bin from scored"),
)
def _(spark, sf_dir):
    from plumbline.functions.grids import calibration_bin

    return scored(spark, sf_dir).select("model", "id", calibration_bin(F.col("y_prob")).alias("bin"))
