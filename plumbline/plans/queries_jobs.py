"""Registered queries: feature pipelines, models and the composite jobs.

A job's reports are returned together in long form (report, item, measure, value). Jobs that
fit models run twice: with a formula in place of the model, which SQL can check, and with
real models, whose results have no SQL counterpart.
"""

from __future__ import annotations

from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plumbline.functions.grids import SWEEP_THRESHOLDS, MITIGATION_THRESHOLDS
from plumbline.functions.scalars import uniform
from plumbline.operators import features, gaps, kpi, metrics, models, perturb, prepare, risk
from plumbline.operators.metrics import METRIC_COLUMNS, QUALITY_METRICS
from plumbline.plans import jobs
from plumbline.plans.metric_sql import bin_sql, long_groups_sql, metrics_sql, sweep_sql
from plumbline.plans.queries_change import (
    BIAS,
    BIAS_ROWS,
    DEGRADED_CTES,
    PERIODS,
    RATES,
    TEMPORAL,
    WINDOWS,
    _means_sql,
    psi_sql,
    stratified_split_sql,
)
from plumbline.plans.queries_metrics import GAP_CTES, GAP_SELECT, OVERALL, SUBGROUP
from plumbline.plans.queries_tables import CATEGORIES, NOISY, PROXIES, _top_sql, noisy
from plumbline.plans.registry import query, rounded
from plumbline.plans.views import issues, labelled, prepared, r, scored, sql, u_sql
from plumbline.session import scratch_path, stage

TARGET = prepare.TARGET

# ---------------------------------------------------------------- long form of reports


def melted(report: str, df, ids, measures=None):
    """Numeric columns of a report as rows: report, item, measure, value."""
    measures = measures or kpi.numeric_columns(df, ids)
    item = F.concat_ws("|", *[F.col(c).cast("string") for c in ids]) if ids else F.lit("all")
    wide = df.select(item.alias("item"), *[F.col(m).cast("double").alias(m) for m in measures])
    return wide.unpivot(["item"], list(measures), "measure", "value").withColumn("report", F.lit(report))


def together(*parts):
    return rounded(jobs.union_all(list(parts)))


def melt_sql(report: str, source: str, ids, measures) -> str:
    item = " || '|' || ".join(f'cast("{c}" as varchar)' for c in ids) if ids else "'all'"
    return " union all ".join(
        f"""select '{report}' as report, {item} as item, '{m}' as measure, {r(f'"{m}"')} as value from {source}"""
        for m in measures
    )


def together_sql(view, parts, *ctes) -> str:
    return sql(view, " union all ".join(parts), *ctes)


# ---------------------------------------------------------------- a formula for a model

_WEIGHTS = {"1-URGENT": 0.1, "2-HIGH": 0.05}


def formula_scorer(salt: str = "job"):
    """Scores from label, hash, priority and text length; the training rows play no part."""

    def score(train, test, run, name="model"):
        weight = F.when(F.col("priority").isNull(), F.lit(0.0))
        for value, w in _WEIGHTS.items():
            weight = weight.when(F.col("priority") == value, F.lit(w))
        weight = weight.otherwise(F.lit(0.02))
        length = F.least(F.col("description_length").cast("double"), F.lit(1000.0)) / 1000.0
        raw = 0.45 * uniform(F.col("id"), salt) + 0.25 * F.col(TARGET) + weight + 0.2 * length
        kept = [c for c in ["id", "key", "created", "world_id", *jobs.FAIRNESS_GROUPS] if c in test.columns]
        p = F.floor(raw * 65536.0).cast("double") / 65536.0
        return test.select(F.lit(run).alias(name), *kept, F.col(TARGET).alias("y_true"), p.alias("y_prob"))

    return score


def formula_sql(salt: str = "job") -> str:
    cases = " ".join(f"when priority = '{v}' then {w}e0" for v, w in _WEIGHTS.items())
    weight = f"case when priority is null then 0e0 {cases} else 0.02e0 end"
    length = "least(cast(description_length as double), 1000e0) / 1000e0"
    raw = f"(0.45e0 * {u_sql('id', salt)} + 0.25e0 * late_resolution + {weight} + 0.2e0 * ({length}))"
    return f"floor({raw} * 65536e0) / 65536e0"


_LEARNED_FROM = ["project_key", "priority", "has_description"]


def learned_scorer(salt: str = "job"):
    """A closed-form model: the weighted, smoothed positive rate of the training rows with the same
    project, priority and description flag, beside noise, label and text length of the test row."""

    def score(train, test, run, name="model"):
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("__NULL__")).alias(f"_{c}") for c in _LEARNED_FROM]
        weight = F.col("weight") if "weight" in train.columns else F.lit(1.0)
        rate = (F.sum(weight * F.col(TARGET)) + 2.5) / (F.sum(weight) + 10.0)
        rates = train.groupBy(*keys).agg((F.round(rate * 4096.0) / 4096.0).alias("_rate"))
        joined = test.select("*", *keys).join(rates, [f"_{c}" for c in _LEARNED_FROM], "left")
        length = F.least(F.col("description_length").cast("double"), F.lit(1000.0)) / 1000.0
        learned = F.coalesce("_rate", F.lit(0.25))
        raw = 0.4 * uniform(F.col("id"), salt) + 0.1 * F.col(TARGET) + 0.4 * learned + 0.1 * length
        kept = [c for c in ["id", "key", "created", "world_id", *jobs.FAIRNESS_GROUPS] if c in test.columns]
        p = F.floor(raw * 65536.0).cast("double") / 65536.0
        return joined.select(F.lit(run).alias(name), *kept, F.col(TARGET).alias("y_true"), p.alias("y_prob"))

    return score


def learned_sql(name: str, tests: str, training: str, runs=(), weight: str = "1e0", where="split = 'test'", among="split = 'train'", more="1 as one") -> str:
    """Rates of the training rows per run, and the test rows with their scores."""
    keys = [f"coalesce(cast({c} as varchar), '__NULL__') as k{i}" for i, c in enumerate(_LEARNED_FROM)]
    same = [f"k{i} = coalesce(cast(x.{c} as varchar), '__NULL__')" for i, c in enumerate(_LEARNED_FROM)]
    same += [f"rates.{c} = x.{c}" for c in runs]
    length = "least(cast(x.description_length as double), 1000e0) / 1000e0"
    raw = f"0.4e0 * {u_sql('x.id', 'job')} + 0.1e0 * x.late_resolution + 0.4e0 * coalesce(rate, 0.25e0) + 0.1e0 * ({length})"
    return f"""{name}_rates as (select {", ".join([*runs, *keys])},
             round((sum({weight} * late_resolution) + 2.5e0) / (sum({weight}) + 10e0) * 4096e0) / 4096e0 as rate
             from {training} where {among} group by all),
        {name} as (select {more}, x.*, x.late_resolution as y_true, floor(({raw}) * 65536e0) / 65536e0 as y_prob
             from (select * from {tests} where {where}) x left join {name}_rates rates on {" and ".join(same)})"""


SPLIT = stratified_split_sql("s", "labelled")


def tested(name: str, source: str, run: str, where: str = "split = 'test'", salt: str = "job") -> str:
    return f"""{name} as (select {run}, *, late_resolution as y_true, {formula_sql(salt)} as y_prob
                         from {source} where {where})"""


# ---------------------------------------------------------------- features and models


def small_split(spark, sf_dir):
    return jobs.halves(jobs.split_labelled(prepared(spark, sf_dir)))


CAT, NUM = prepare.CATEGORICAL_FEATURES, prepare.NUMERIC_FEATURES


@query("F05_feature_pipeline")
def _(spark, sf_dir):
    train, test = small_split(spark, sf_dir)
    table = features.fit_features(train, CAT, NUM).transform(test)
    vector = vector_to_array("features")
    return table.select("id", F.size(vector).alias("width"), F.aggregate(vector, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("F03b_one_hot_unknown_values")
def _(spark, sf_dir):
    train, test = small_split(spark, sf_dir)
    fitted = features.fit_features(train.where("project_key <> 'NATION_1'"), ["project_key"], [])
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return fitted.transform(test).groupBy("project_key").agg(F.max(total).alias("hot"), F.count("*").alias("rows"))


def _compare(spark, sf_dir, scorers):
    train, test = small_split(spark, sf_dir)
    scored_ = jobs.score_all(train, [partial(s, train, test, n, "model") for n, s in scorers(train.count()).items()])
    return metrics.evaluate(scored_, ["model"])


def _zoo(names):
    def scorers(rows):
        zoo = models.model_zoo(rows)
        return {n: jobs.EstimatorScorer(zoo[n][0], CAT, NUM, zoo[n][1]) for n in names}

    return scorers


@query("F06_logistic_regression")
def _(spark, sf_dir):
    return _compare(spark, sf_dir, _zoo(["logistic_regression", "logistic_regression_balanced"]))


@query("F07_random_forest_balanced")
def _(spark, sf_dir):
    return _compare(spark, sf_dir, lambda rows: {"random_forest": jobs.ForestScorer()})


@query("F08_random_forest_least_leaf")
def _(spark, sf_dir):
    return _compare(spark, sf_dir, _zoo(["random_forest", "random_forest_balanced"]))


@query("F09_gradient_boosting")
def _(spark, sf_dir):
    return _compare(spark, sf_dir, _zoo(["hist_gradient_boosting"]))


@query("F10_neural_network")
def _(spark, sf_dir):
    return _compare(spark, sf_dir, _zoo(["mlp_classifier"]))


@query("F11_batch_scoring")
def _(spark, sf_dir):
    train, test = small_split(spark, sf_dir)
    return jobs.ForestScorer()(train, test, "random_forest").select("model", "id", "y_true", "y_prob")


@query("F12_model_comparison")
def _(spark, sf_dir):
    reports = jobs.fairness_audit(prepared(spark, sf_dir), jobs.zoo_scorers)
    return reports["bias_fairness_global_metrics"]


# ---------------------------------------------------------------- data jobs


@query(
    "E01_prepare_dataset",
    sql(
        "prepared",
        f"""select * exclude (description) replace ({r("time_to_resolution_days")} as time_to_resolution_days,
              {r("late_threshold_days")} as late_threshold_days), md5(description) as description_md5 from prepared""",
    ),
)
def _(spark, sf_dir):
    ready = jobs.prepare_dataset(issues(spark, sf_dir), scratch_path(spark, "prepared"))
    return rounded(ready.withColumn("description_md5", F.md5("description")).drop("description"))


_QUALITY = ["rows", "null_count", "null_rate", "distinct_count", "distinct_rate"]


@query(
    "E02_quality_report",
    together_sql(
        "prepared",
        [
            melt_sql("quality", "profile", ["column"], _QUALITY),
            melt_sql("categories", "tops", ["column", "value"], ["count", "rate"]),
            melt_sql("time", "months", ["created_year", "created_month"], ["issues_count"]),
        ],
        "profile as ("
        + " union all ".join(
            f"""select '{c}' as "column", count(*) as rows, count(*) - count({c}) as null_count,
                (count(*) - count({c})) * 1e0 / count(*) as null_rate, count(distinct {c}) as distinct_count,
                count(distinct {c}) * 1e0 / count(*) as distinct_rate from prepared"""
            for c in """id key created resolutiondate project_key project_name issuetype priority status summary description
                created_year created_month is_resolved resolution_valid time_to_resolution_days summary_length
                description_length has_description late_threshold_days late_resolution""".split()
        )
        + ")",
        f"tops as ({_top_sql(CATEGORIES, 'prepared', 50)})",
        "months as (select created_year, created_month, count(*) as issues_count from prepared group by all)",
    ),
)
def _(spark, sf_dir):
    reports = jobs.quality_report(prepared(spark, sf_dir))
    return together(
        melted("quality", reports["data_quality_summary"], ["column"], _QUALITY),
        melted("categories", reports["category_distributions"], ["column", "value"], ["count", "rate"]),
        melted("time", reports["time_distribution"], ["created_year", "created_month"], ["issues_count"]),
    )


# ---------------------------------------------------------------- jobs on a scored table

_BASE = ["rows", "positive_rate", *QUALITY_METRICS]
_RENAMED = "{0}_n as (select *, positive_rate_true as positive_rate from {0})"


@query(
    "E03_baseline_evaluation",
    together_sql(
        "labelled",
        [
            melt_sql("model_metrics", "overall_n", ["model"], _BASE),
            melt_sql("subgroup_metrics", "grouped_n", ["model", "subgroup_feature", "subgroup_value"], _BASE[:-1]),
            melt_sql("calibration_summary", "overall_n", ["model"], ["brier_score", "ece"]),
        ],
        SPLIT,
        tested("a", "s", "'logistic_regression' as model", salt="lr"),
        tested("b", "s", "'random_forest' as model", salt="rf"),
        "scored as (select * from a union all select * from b)",
        OVERALL,
        *SUBGROUP,
        _RENAMED.format("overall"),
        _RENAMED.format("grouped"),
    ),
)
def _(spark, sf_dir):
    scorers = {"logistic_regression": formula_scorer("lr"), "random_forest": formula_scorer("rf")}
    reports = jobs.baseline(prepared(spark, sf_dir), scorers)
    return together(
        melted("model_metrics", reports["model_metrics"], ["model"]),
        melted("subgroup_metrics", reports["subgroup_metrics"], ["model", "subgroup_feature", "subgroup_value"]),
        melted("calibration_summary", reports["calibration_summary"], ["model"]),
    )


def baseline_scorers(rows):
    return {
        "logistic_regression": jobs.EstimatorScorer(
            lambda f, w: models.logistic_regression(rows, weighted=True), CAT, NUM, balanced=True
        ),
        "random_forest": jobs.ForestScorer(),
    }


@query("E03b_baseline_models")
def _(spark, sf_dir):
    df = prepared(spark, sf_dir)
    reports = jobs.baseline(df, baseline_scorers(labelled(spark, sf_dir).count()))
    return together(
        melted("model_metrics", reports["model_metrics"], ["model"]),
        melted("subgroup_metrics", reports["subgroup_metrics"], ["model", "subgroup_feature", "subgroup_value"]),
    )


_SWEPT = ["rows", "positive_rate_true", "positive_rate_predicted", *QUALITY_METRICS]
_BEST = """(select *, row_number() over (partition by model order by f1 desc, threshold) as rn from sweep{0}) where rn = 1"""


@query(
    "E04_threshold_tuning",
    together_sql(
        "scored",
        [
            melt_sql("threshold_metrics", "sweep_t2", ["model", "percent"], _SWEPT),
            melt_sql("threshold_best_f1", "best_all", ["model"], ["threshold", *_SWEPT]),
            melt_sql("threshold_recall_60_minimum", "best_recall", ["model"], ["threshold", *_SWEPT]),
        ],
        metrics_sql("fixed", "scored", ["model"], edges="open0"),
        sweep_sql("sweep", "scored", ["model"], SWEEP_THRESHOLDS, "fixed"),
        "sweep_t2 as (select *, cast(round(threshold * 100) as int) as percent from sweep)",
        f"best_all as (select * from {_BEST.format('')})",
        f"best_recall as (select * from {_BEST.format(' where recall >= 0.6e0')})",
    ),
)
def _(spark, sf_dir):
    reports = jobs.threshold_tuning(scored(spark, sf_dir))
    sweep = reports["threshold_metrics"].withColumn("percent", F.round(F.col("threshold") * 100).cast("int"))
    return together(
        melted("threshold_metrics", sweep, ["model", "percent"], _SWEPT),
        melted("threshold_best_f1", reports["threshold_best_f1"], ["model"]),
        melted("threshold_recall_60_minimum", reports["threshold_recall_60_minimum"], ["model"]),
    )


ADVANCED_CTES = [
    """limited as (select *, case model when 'random_forest' then 0.25e0 when 'boosted' then 0.45e0 else 0.5e0 end
         as threshold from scored)""",
    metrics_sql("m", "limited", ["model", "threshold"], "threshold"),
    f"""bins as (select model, {bin_sql()} as bin, count(*) as rows, avg(y_prob) as mean_predicted_probability,
          avg(y_true) as observed_positive_rate, avg(y_true) - avg(y_prob) as calibration_gap from scored group by 1, 2)""",
    """audit as (select model, key, cast(y_prob >= threshold as int) as y_predicted,
         abs(y_true - y_prob) as absolute_probability_error from limited)""",
]


@query(
    "E05_advanced_metrics",
    together_sql(
        "scored",
        [
            melt_sql("advanced_model_metrics", "m", ["model"], METRIC_COLUMNS),
            melt_sql(
                "calibration_bins",
                "bins",
                ["model", "bin"],
                ["rows", "mean_predicted_probability", "observed_positive_rate", "calibration_gap"],
            ),
            melt_sql("prediction_audit", "audit", ["model", "key"], ["y_predicted", "absolute_probability_error"]),
        ],
        *ADVANCED_CTES,
    ),
)
def _(spark, sf_dir):
    tuned = spark.createDataFrame([("boosted", 0.45)], "model string, threshold double")
    reports = jobs.advanced_metrics(scored(spark, sf_dir), tuned)
    bins = reports["calibration_bins"].where("rows > 0")
    return together(
        melted("advanced_model_metrics", reports["advanced_model_metrics"], ["model"], METRIC_COLUMNS),
        melted(
            "calibration_bins",
            bins,
            ["model", "bin"],
            ["rows", "mean_predicted_probability", "observed_positive_rate", "calibration_gap"],
        ),
        melted(
            "prediction_audit", reports["prediction_audit"], ["model", "key"], ["y_predicted", "absolute_probability_error"]
        ),
    )


@query("E06_subgroup_gap_analysis", sql("scored", GAP_SELECT, *GAP_CTES))
def _(spark, sf_dir):
    reports = jobs.baseline_reports(scored(spark, sf_dir))
    found = jobs.subgroup_gap_analysis(reports["subgroup_metrics"], reports["model_metrics"])
    return rounded(found["subgroup_gap_metrics"])


# ---------------------------------------------------------------- experiments

_SIZES = ["train_rows", "test_rows", "train_positive_rate", "test_positive_rate"]
_DEGRADED = ["threshold", *_SIZES, "positive_rate_predicted", *QUALITY_METRICS, *[f"delta_{m}" for m in QUALITY_METRICS]]


def deltas_sql(columns, source, key, base, pattern="delta_{}"):
    return ", ".join(
        f"""m."{c}" - (select "{c}" from {source} where {key} = '{base}') as {pattern.format(c)}""" for c in columns
    )


DEGRADATION_CTES = [
    *DEGRADED_CTES,
    learned_sql("t", "degraded", "degraded", ["scenario"]),
    metrics_sql("m", "t", ["scenario"], edges="open0"),
    """sizes as (select scenario, count(*) filter (where split = 'train') as train_rows,
         count(*) filter (where split = 'test') as test_rows,
         avg(late_resolution) filter (where split = 'train') as train_positive_rate,
         avg(late_resolution) filter (where split = 'test') as test_positive_rate from degraded group by 1)""",
    """texts as (select * from (values ('baseline', 'Datos originales preparados, sin degradación artificial.'),
         ('priority_null_10', 'Se elimina priority en el 10% de train y test.'),
         ('priority_null_20', 'Se elimina priority en el 20% de train y test.'),
         ('priority_null_30', 'Se elimina priority en el 30% de train y test.'),
         ('description_loss_20', 'Se simula pérdida textual en el 20% de train y test poniendo description_length=0 y has_description=0.'),
         ('description_loss_40', 'Se simula pérdida textual en el 40% de train y test poniendo description_length=0 y has_description=0.'),
         ('priority_noise_20', 'Se cambia aleatoriamente priority en el 20% de train y test.'),
         ('priority_noise_40', 'Se cambia aleatoriamente priority en el 40% de train y test.'),
         ('positive_class_undersample_50', 'Se conserva solo el 50% de ejemplos positivos en entrenamiento; el test no se altera.')
         ) x(scenario, description))""",
    f"""report as (select *, 0.25e0 as threshold, {deltas_sql(QUALITY_METRICS, "m", "scenario", "baseline")}
         from m join sizes using (scenario) join texts using (scenario))""",
]


@query(
    "E07_degradation_experiment",
    together_sql(
        "labelled",
        [melt_sql("degradation_experiments", "report", ["scenario", "description"], _DEGRADED)],
        *DEGRADATION_CTES,
    ),
)
def _(spark, sf_dir):
    reports = jobs.degradation_experiment(prepared(spark, sf_dir), learned_scorer())
    return together(
        melted("degradation_experiments", reports["degradation_experiments"], ["scenario", "description"], _DEGRADED)
    )


@query("E07b_degradation_models")
def _(spark, sf_dir):
    reports = jobs.degradation_experiment(prepared(spark, sf_dir), jobs.ForestScorer())
    return rounded(reports["degradation_summary"])


_SHOWN = [*QUALITY_METRICS[:3], "balanced_accuracy", *QUALITY_METRICS[3:]]
_CLEANED = ["rows", "positive_rate_true", "positive_rate_predicted", *_SHOWN, *[f"delta_{m}_vs_original" for m in _SHOWN]]
_SNAPSHOT = ["rows", "columns", "total_nulls", "mean_null_rate", "target_null_rate", "duplicate_count"]
_PREPARED_COLUMNS = """id key created resolutiondate project_key project_name issuetype priority status summary description
    created_year created_month is_resolved resolution_valid time_to_resolution_days summary_length description_length
    has_description late_threshold_days late_resolution""".split()
_NULLS = " + ".join(f"count(*) - count({c})" for c in _PREPARED_COLUMNS)


def _snapshot_sql(name, source):
    n = len(_PREPARED_COLUMNS)
    return f"""select '{name}' as scenario, count(*) as rows, {n} as columns, {_NULLS} as total_nulls,
        ({_NULLS}) * 1e0 / (count(*) * {n}) as mean_null_rate, avg(cast(late_resolution is null as int)) as target_null_rate,
        count(*) - count(distinct key) as duplicate_count from {source}"""


_CAPS = ", ".join(f"least(greatest({c}, 0), (select quantile_cont({c}, 0.99) from noisy)) as {c}" for c in NUM)
_FILLS = ", ".join(f"coalesce({c}, '__MISSING__') as {c}" for c in CAT)


LEARNED_CLEANING_CTES = [
    NOISY,
    f"""clean as (select * exclude (rn) from (
          select *, row_number() over (partition by key order by created desc, id desc) as rn
          from (select * replace ({_FILLS}, {_CAPS}) from noisy)) where rn = 1)""",
    f"snapshots as ({_snapshot_sql('prepared_original', 'noisy')} union all {_snapshot_sql('cleaned_rules', 'clean')})",
    "l1 as (select * from noisy where late_resolution is not null)",
    "l2 as (select * from clean where late_resolution is not null)",
    stratified_split_sql("s1", "l1"),
    stratified_split_sql("s2", "l2"),
    learned_sql("t1", "s1", "s1", more="'prepared_original' as scenario"),
    learned_sql("t2", "s2", "s2", more="'cleaned_rules' as scenario"),
    "t as (select scenario, y_true, y_prob from t1 union all select scenario, y_true, y_prob from t2)",
    metrics_sql("m", "t", ["scenario"]),
    f"report as (select *, {deltas_sql(_SHOWN, 'm', 'scenario', 'prepared_original', 'delta_{}_vs_original')} from m)",
]


@query(
    "E08_cleaning_experiment",
    together_sql(
        "prepared",
        [
            melt_sql("data_cleaning_quality_comparison", "snapshots", ["scenario"], _SNAPSHOT),
            melt_sql("data_cleaning_metrics", "report", ["scenario"], _CLEANED),
        ],
        *LEARNED_CLEANING_CTES,
    ),
)
def _(spark, sf_dir):
    reports = jobs.cleaning_experiment(noisy(spark, sf_dir), learned_scorer())
    return together(
        melted("data_cleaning_quality_comparison", reports["data_cleaning_quality_comparison"], ["scenario"]),
        melted("data_cleaning_metrics", reports["data_cleaning_metrics"], ["scenario"], _CLEANED),
    )


@query("E08b_cleaning_models")
def _(spark, sf_dir):
    reports = jobs.cleaning_experiment(noisy(spark, sf_dir), jobs.ForestScorer())
    return rounded(reports["data_cleaning_metrics"])


_DRIFTED = [*jobs.EVALUATED, "train_rows", "test_rows", *[f"delta_vs_random_{m}" for m in QUALITY_METRICS]]
_SHIFT = [*NUM, TARGET]


DRIFT_CTES = [
    "dated_labelled as (select * from labelled where created is not null)",
    stratified_split_sql("s", "dated_labelled"),
    TEMPORAL,
    learned_sql("t1", "s", "s", more="'random_split' as split_type"),
    learned_sql("t2", "temporal", "temporal", more="'temporal_split' as split_type"),
    "t as (select split_type, y_true, y_prob from t1 union all select split_type, y_true, y_prob from t2)",
    metrics_sql("m", "t", ["split_type"], edges="open0"),
    """sizes as (select 'random_split' as split_type, count(*) filter (where split = 'train') as train_rows,
         count(*) filter (where split = 'test') as test_rows from s union all
         select 'temporal_split', count(*) filter (where split = 'train'), count(*) filter (where split = 'test') from temporal)""",
    f"""report as (select *, {deltas_sql(QUALITY_METRICS, "m", "split_type", "random_split", "delta_vs_random_{}")}
         from m join sizes using (split_type))""",
    psi_sql(_SHIFT),
    f'shift as (select * from ({_means_sql(_SHIFT)}) join psi using ("column"))',
    RATES,
    """cats as (select * from (select *, row_number() over (partition by "column" order by tr desc, value) as r1,
         row_number() over (partition by "column" order by te desc, value) as r2 from rates where "column" <> 'summary')
         where (r1 <= 20 and tr > 0) or (r2 <= 20 and te > 0))""",
    "spans as (select 'temporal_' || split as split, count(*) as rows, avg(late_resolution) as positive_rate from temporal group by 1)",
]


@query(
    "E09_temporal_drift",
    together_sql(
        "labelled",
        [
            melt_sql("temporal_drift_metrics", "report", ["split_type"], _DRIFTED),
            melt_sql("temporal_numeric_shift", "shift", ["column"], ["train_mean", "test_mean", "psi"]),
            melt_sql("temporal_categorical_shift", "cats", ["column", "value"], ["train_rate", "test_rate"]),
            melt_sql("temporal_period_summary", "spans", ["split"], ["rows", "positive_rate"]),
        ],
        *DRIFT_CTES,
    ),
)
def _(spark, sf_dir):
    reports = jobs.temporal_drift(prepared(spark, sf_dir), learned_scorer())
    return together(
        melted("temporal_drift_metrics", reports["temporal_drift_metrics"], ["split_type"], _DRIFTED),
        melted("temporal_numeric_shift", reports["temporal_numeric_shift"], ["column"], ["train_mean", "test_mean", "psi"]),
        melted(
            "temporal_categorical_shift",
            reports["temporal_categorical_shift"],
            ["column", "value"],
            ["train_rate", "test_rate"],
        ),
        melted("temporal_period_summary", reports["temporal_period_summary"], ["split"], ["rows", "positive_rate"]),
    )


@query("E09b_temporal_drift_models")
def _(spark, sf_dir):
    return rounded(jobs.temporal_drift(prepared(spark, sf_dir), jobs.ForestScorer())["temporal_drift_metrics"])


_RETRAINED = [
    *jobs.EVALUATED,
    *_SIZES,
    *[f"static_{m}" for m in QUALITY_METRICS],
    *[f"delta_vs_static_{m}" for m in QUALITY_METRICS],
]
_AVERAGES = [f"avg_{m}" for m in QUALITY_METRICS]
_AVERAGED = ["periods", *_AVERAGES, *[f"delta_{a}_vs_static" for a in _AVERAGES]]
_STATIC = "static_initial_train"


RETRAINING_CTES = [
    PERIODS,
    WINDOWS,
    "spans as (select time_bin, count(*) as rows, avg(late_resolution) as positive_rate from periods group by 1)",
    "asked as (select strategy, 'period_' || test_period as test_period, periods.* from periods join windows on period = windows.test_period)",
    """taught as (select strategy, 'period_' || test_period as test_period, periods.*
         from periods join windows on period between first_period and last_period)""",
    learned_sql("t", "asked", "taught", ["strategy", "test_period"], where="true", among="true"),
    metrics_sql("m", "t", ["strategy", "test_period"], edges="open0"),
    """trained as (select strategy, 'period_' || test_period as test_period, count(*) as train_rows,
         avg(late_resolution) as train_positive_rate
         from periods join windows on period between first_period and last_period group by all)""",
    """full_rows as (select m.*, train_rows, train_positive_rate, spans.rows as test_rows, spans.positive_rate as test_positive_rate
         from m join trained using (strategy, test_period) join spans on time_bin = test_period)""",
    "report as (select f.*, "
    + ", ".join(f'z."{m}" as static_{m}, f."{m}" - z."{m}" as delta_vs_static_{m}' for m in QUALITY_METRICS)
    + f" from full_rows f left join (select * from m where strategy = '{_STATIC}') z using (test_period))",
    "means as (select strategy, count(distinct test_period) as periods, "
    + ", ".join(f'avg("{m}") as avg_{m}' for m in QUALITY_METRICS)
    + " from m group by 1)",
    "summary as (select *, "
    + ", ".join(
        f"{a} - (select {a} from means where strategy = '{_STATIC}') as delta_{a}_vs_static" for a in _AVERAGES
    )
    + " from means)",
]


@query(
    "E10_retraining",
    together_sql(
        "labelled",
        [
            melt_sql("retraining_period_summary", "spans", ["time_bin"], ["rows", "positive_rate"]),
            melt_sql("retraining_metrics", "report", ["strategy", "test_period"], _RETRAINED),
            melt_sql("retraining_summary", "summary", ["strategy"], _AVERAGED),
        ],
        *RETRAINING_CTES,
    ),
)
def _(spark, sf_dir):
    reports = jobs.retraining(prepared(spark, sf_dir), learned_scorer())
    return together(
        melted("retraining_period_summary", reports["retraining_period_summary"], ["time_bin"], ["rows", "positive_rate"]),
        melted("retraining_metrics", reports["retraining_metrics"], ["strategy", "test_period"], _RETRAINED),
        melted("retraining_summary", reports["retraining_summary"], ["strategy"], _AVERAGED),
    )


@query("E10b_retraining_models")
def _(spark, sf_dir):
    return rounded(jobs.retraining(prepared(spark, sf_dir), jobs.ForestScorer())["retraining_summary"])


_SEEDS = list(jobs.SEEDS)
_SEED_TESTS = [
    part
    for s in _SEEDS
    for part in (stratified_split_sql(f"s{s}", "labelled", seed=s), learned_sql(f"t{s}", f"s{s}", f"s{s}", more=f"{s} as seed"))
]
_SPREAD_SQL = " union all ".join(
    f"""select '{m}' as metric, avg("{m}") as mean, stddev_samp("{m}") as std, min("{m}") as min, max("{m}") as max,
        max("{m}") - min("{m}") as range, stddev_samp("{m}") / nullif(avg("{m}"), 0) as coefficient_of_variation from m"""
    for m in QUALITY_METRICS
)


STABILITY_CTES = [
    *_SEED_TESTS,
    "t as (" + " union all ".join(f"select seed, y_true, y_prob from t{s}" for s in _SEEDS) + ")",
    metrics_sql("m", "t", ["seed"]),
    f"spread as ({_SPREAD_SQL})",
]


@query(
    "E11_seed_stability",
    together_sql(
        "labelled",
        [
            melt_sql("stability_seed_metrics", "m", ["seed"], jobs.EVALUATED),
            melt_sql(
                "stability_seed_summary", "spread", ["metric"], ["mean", "std", "min", "max", "range", "coefficient_of_variation"]
            ),
        ],
        *STABILITY_CTES,
    ),
)
def _(spark, sf_dir):
    reports = jobs.stability(prepared(spark, sf_dir), lambda seed: learned_scorer(), _SEEDS)
    return together(
        melted("stability_seed_metrics", reports["stability_seed_metrics"], ["seed"], jobs.EVALUATED),
        melted("stability_seed_summary", reports["stability_seed_summary"], ["metric"]),
    )


@query("E11b_seed_stability_models")
def _(spark, sf_dir):
    def forest(seed):
        return jobs.ForestScorer(seed=seed)

    return rounded(jobs.stability(prepared(spark, sf_dir), forest, _SEEDS)["stability_seed_summary"])


_WORLD_SUMMARY = [
    "worlds",
    "mean_probability",
    "std_probability",
    "min_probability",
    "max_probability",
    "probability_range",
    "baseline_probability",
]
_WORLD_KEY = "id || '-' || w || '-priority'"
_WORLD_TOTAL = ["sample_rows", "worlds", "mean_probability_std", "p95_probability_range", "max_probability_range"]


@query(
    "E12_possible_worlds",
    together_sql(
        "labelled",
        [
            melt_sql("possible_worlds_sensitivity_summary", "spread", ["id"], _WORLD_SUMMARY),
            melt_sql("possible_worlds_sensitivity_aggregate", "total", [], _WORLD_TOTAL),
        ],
        SPLIT,
        f"sample as (select * from s where split = 'test' order by {u_sql('id', 'world-sample')}, id limit 1000)",
        f"""donors as (select priority as v, row_number() over (order by {u_sql('id', 'worlds')}, id) - 1 as rank,
              count(*) over () as n from s where split = 'train' and priority is not null)""",
        f"""worlds as (select id, w, late_resolution, description_length, coalesce(priority, (select v from donors
              where rank = cast(floor({u_sql(_WORLD_KEY, 'world-draw')} * (select max(n) from donors)) as bigint))) as priority
              from sample, (select unnest(range(1, 21)) as w))""",
        tested("scored_worlds", "worlds", "1 as one", "true"),
        tested("scored_sample", "sample", "1 as one", "true"),
        """spread as (select w.id, count(distinct w) as worlds, avg(w.y_prob) as mean_probability,
             stddev_samp(w.y_prob) as std_probability, min(w.y_prob) as min_probability, max(w.y_prob) as max_probability,
             max(w.y_prob) - min(w.y_prob) as probability_range, any_value(b.y_prob) as baseline_probability
             from scored_worlds w join scored_sample b on b.id = w.id group by 1)""",
        """total as (select count(*) as sample_rows, 20 as worlds, avg(std_probability) as mean_probability_std,
             quantile_cont(probability_range, 0.95) as p95_probability_range,
             max(probability_range) as max_probability_range from spread)""",
    ),
)
def _(spark, sf_dir):
    reports = jobs.possible_worlds(prepared(spark, sf_dir), formula_scorer())
    return together(
        melted("possible_worlds_sensitivity_summary", reports["possible_worlds_sensitivity_summary"], ["id"], _WORLD_SUMMARY),
        melted("possible_worlds_sensitivity_aggregate", reports["possible_worlds_sensitivity_aggregate"], [], _WORLD_TOTAL),
    )


@query("E12b_possible_worlds_models")
def _(spark, sf_dir):
    reports = jobs.possible_worlds(prepared(spark, sf_dir), jobs.ForestScorer())
    return rounded(reports["possible_worlds_sensitivity_aggregate"])


_FAIR = ["rows", "tp", "tn", "fp", "fn", "precision", "recall", "f1", "specificity", "fpr", "fnr", "pr_auc", "roc_auc", "brier_score", "ece"]
_FAIR_NAMES = """select * exclude (true_positive, true_negative, false_positive, false_negative), true_positive as tp,
    true_negative as tn, false_positive as fp, false_negative as fn, false_positive_rate as fpr, false_negative_rate as fnr from"""
_FAIRNESS = " union all ".join(
    f"""select model, group_feature, '{m}' as metric, count(*) as groups_considered, min("{m}") as min_value,
        max("{m}") as max_value, max("{m}") - min("{m}") as absolute_gap, min("{m}") / nullif(max("{m}"), 0) as min_max_ratio,
        first(group_value order by round("{m}", 12) nulls last, group_value) as worst_group,
        first(group_value order by round("{m}", 12) desc nulls last, group_value) as best_group
        from grp where rows >= 30 group by model, group_feature having max("{m}") is not null"""
    for m in gaps.FAIRNESS_METRICS
)
_DISPARITY = ["groups_considered", "min_value", "max_value", "absolute_gap", "min_max_ratio"]


@query(
    "E13_fairness_audit",
    together_sql(
        "labelled",
        [
            melt_sql("global", "whole", ["model"], _FAIR),
            melt_sql("groups", "grp", ["model", "group_feature", "group_value"], _FAIR),
            melt_sql(
                "disparity", "spread_rows", ["model", "group_feature", "metric", "worst_group", "best_group"], _DISPARITY
            ),
        ],
        SPLIT,
        tested("a", "s", "'first' as model", salt="fair-a"),
        tested("b", "s", "'second' as model", salt="fair-b"),
        "both_models as (select * from a union all select * from b)",
        metrics_sql("m", "both_models", ["model"], edges="left"),
        f"whole as ({_FAIR_NAMES} m)",
        long_groups_sql("spread", "both_models", jobs.FAIRNESS_GROUPS, "model, y_true, y_prob"),
        metrics_sql("g", "spread", ["model", "subgroup_feature", "subgroup_value"], edges="left", min_rows=10),
        f"grp as (select *, subgroup_feature as group_feature, subgroup_value as group_value from ({_FAIR_NAMES} g))",
        f"spread_rows as ({_FAIRNESS})",
    ),
)
def _(spark, sf_dir):
    reports = jobs.fairness_audit(
        prepared(spark, sf_dir), {"first": formula_scorer("fair-a"), "second": formula_scorer("fair-b")}
    )
    return together(
        melted("global", reports["bias_fairness_global_metrics"], ["model"], _FAIR),
        melted("groups", reports["bias_fairness_group_metrics"], ["model", "group_feature", "group_value"], _FAIR),
        melted(
            "disparity",
            reports["bias_fairness_disparity_summary"],
            ["model", "group_feature", "metric", "worst_group", "best_group"],
            _DISPARITY,
        ),
    )


@query("E13b_fairness_models")
def _(spark, sf_dir):
    return rounded(jobs.fairness_audit(prepared(spark, sf_dir), jobs.zoo_scorers)["bias_fairness_disparity_summary"])


_BIAS_NAMES = "select *, false_positive_rate as fpr, false_negative_rate as fnr from"
_GAPS3 = ["absolute_gap", "min_value", "max_value"]


def _disparity_sql(run):
    return " union all ".join(
        f"""select {run}, '{m}' as metric, max("{m}") - min("{m}") as absolute_gap, min("{m}") as min_value,
            max("{m}") as max_value from grp group by {run} having max("{m}") is not null"""
        for m in gaps.DISPARITY_METRICS
    )


@query(
    "E14_bias_scenarios",
    together_sql(
        "labelled",
        [
            melt_sql("bias_scenario_metrics", "whole", ["scenario", "minority_group", "majority_group"], jobs.BIAS_METRICS),
            melt_sql("bias_scenario_group_metrics", "grp", ["scenario", "group_value"], jobs.BIAS_METRICS),
            melt_sql("bias_scenario_disparities", "spread_rows", ["scenario", "metric"], _GAPS3),
        ],
        SPLIT,
        BIAS,
        f"biased as (select b.*, s.project_key from ({BIAS_ROWS}) b join s on s.id = b.id)",
        "asked as (select s.*, scenario from s, (select unnest(["
        + ", ".join(f"'{x}'" for x in perturb.BIAS_SCENARIOS)
        + "]) as scenario))",
        learned_sql("t0", "asked", "biased", ["scenario"], among="true"),
        "t as (select *, coalesce(project_key, '__NULL__') as group_value from t0)",
        metrics_sql("m", "t", ["scenario"], edges="left", one_class_ap=None),
        f"""whole as (select *, (select p from pc order by n, p limit 1) as minority_group,
             (select p from pc order by n desc, p limit 1) as majority_group from ({_BIAS_NAMES} m))""",
        metrics_sql("g", "t", ["scenario", "group_value"], edges="left", one_class_ap=None, min_rows=20),
        f"grp as ({_BIAS_NAMES} g)",
        f"spread_rows as ({_disparity_sql('scenario')})",
    ),
)
def _(spark, sf_dir):
    reports = jobs.bias_experiment(prepared(spark, sf_dir), learned_scorer())
    return together(
        melted(
            "bias_scenario_metrics",
            reports["bias_scenario_metrics"],
            ["scenario", "minority_group", "majority_group"],
            jobs.BIAS_METRICS,
        ),
        melted(
            "bias_scenario_group_metrics", reports["bias_scenario_group_metrics"], ["scenario", "group_value"], jobs.BIAS_METRICS
        ),
        melted("bias_scenario_disparities", reports["bias_scenario_disparities"], ["scenario", "metric"]),
    )


@query("E14b_bias_scenario_models")
def _(spark, sf_dir):
    forest = jobs.ForestScorer(least_leaf=3, balanced=False)
    return rounded(jobs.bias_experiment(prepared(spark, sf_dir), forest)["bias_scenario_metrics"])


_STRATEGIES = [n for n, _ in jobs.MITIGATION_STRATEGIES]
_SEVEN = [m for m in jobs.BIAS_METRICS]


@query(
    "E15_bias_mitigation",
    together_sql(
        "labelled",
        [
            melt_sql("bias_mitigation_metrics", "whole", ["strategy"], _SEVEN),
            melt_sql("bias_mitigation_group_metrics", "grp", ["strategy", "group_value"], _SEVEN),
            melt_sql(
                "bias_mitigation_tradeoffs",
                "tradeoffs",
                ["strategy", "metric"],
                [*_GAPS3, "baseline_gap", "delta_gap_vs_baseline"],
            ),
        ],
        SPLIT,
        """counted as (select *, coalesce(project_key, '__NULL__') as g, count(*) over () as n,
             count(*) over (partition by late_resolution) as n_y, count(*) over (partition by coalesce(project_key, '__NULL__')) as n_g,
             count(*) over (partition by coalesce(project_key, '__NULL__'), late_resolution) as n_gy from s where split = 'train')""",
        """kinds as (select count(distinct g) as k_g, count(distinct (g, late_resolution)) as k_gy from counted)""",
        """weighted as (select strategy, counted.*, case strategy when 'class_weight_balanced' then n / (2e0 * n_y)
             when 'group_reweighting' then n * 1e0 / (k_g * n_g) when 'group_class_reweighting' then n * 1e0 / (k_gy * n_gy)
             else 1e0 end as weight from counted, kinds, """
        + f"(select unnest({_STRATEGIES}) as strategy))",
        f"asked as (select s.*, strategy from s, (select unnest({_STRATEGIES}) as strategy))",
        learned_sql("t0", "asked", "weighted", ["strategy"], "weight", among="true"),
        "every as (select *, coalesce(project_key, '__NULL__') as group_value from t0)",
        "base as (select * exclude (strategy) from every where strategy = 'baseline')",
        sweep_sql("sweep", "base", [], MITIGATION_THRESHOLDS, None),
        "best as (select threshold from sweep order by f1 desc, threshold limit 1)",
        """named as (select strategy, 0.25e0 as thr, * exclude (strategy) from every union all
             select 'global_threshold_best_f1', (select threshold from best), base.* from base)""",
        metrics_sql("m", "named", ["strategy"], "thr", "left", one_class_ap=None),
        metrics_sql("g", "named", ["strategy", "group_value"], "thr", "left", one_class_ap=None, min_rows=20),
        f"grp as ({_BIAS_NAMES} g)",
        sweep_sql("gsweep", "base", ["group_value"], MITIGATION_THRESHOLDS, None),
        """limits as (select group_value, coalesce(max(case when recall >= 0.65e0 and gsweep.rows >= 30 and tp + fn > 0
             and fp + tn > 0 then threshold end), 0.25e0) as thr from gsweep group by 1)""",
        "own as (select 'group_threshold_target_recall' as strategy, thr, base.* from base join limits using (group_value))",
        metrics_sql("o", "own", ["strategy"], "thr", "left", one_class_ap=None),
        f"whole as ({_BIAS_NAMES} m union all {_BIAS_NAMES} o)",
        f"disparities as ({_disparity_sql('strategy')})",
        """tradeoffs as (select *, absolute_gap - baseline_gap as delta_gap_vs_baseline from disparities
             left join (select metric, absolute_gap as baseline_gap from disparities where strategy = 'baseline') using (metric))""",
    ),
)
def _(spark, sf_dir):
    reports = jobs.bias_mitigation(prepared(spark, sf_dir), learned_scorer())
    return together(
        melted("bias_mitigation_metrics", reports["bias_mitigation_metrics"], ["strategy"], _SEVEN),
        melted("bias_mitigation_group_metrics", reports["bias_mitigation_group_metrics"], ["strategy", "group_value"], _SEVEN),
        melted("bias_mitigation_tradeoffs", reports["bias_mitigation_tradeoffs"], ["strategy", "metric"]),
    )


@query("E15b_bias_mitigation_models")
def _(spark, sf_dir):
    forest = jobs.ForestScorer(least_leaf=3, balanced=False, weighted=True)
    return rounded(jobs.bias_mitigation(prepared(spark, sf_dir), forest)["bias_mitigation_metrics"])


_RISK = ["rows", "mean", "median", "p75", "p90"]


def _risk_rows(source, having=""):
    return " union all ".join(
        f"""select group_feature, group_value, '{m}' as metric, count(*) as rows, avg({m}) as mean,
            quantile_cont({m}, 0.5) as median, quantile_cont({m}, 0.75) as p75, quantile_cont({m}, 0.9) as p90
            from {source} group by all {having}"""
        for m in risk.PROXIES
    )


@query(
    "E16_risk_proxies",
    together_sql(
        "prepared",
        [
            melt_sql("levels", "levels", ["risk_effort_proxy_level"], ["n"]),
            melt_sql("project_risk_proxy_summary", "whole", ["group_feature", "group_value", "metric"], _RISK),
            melt_sql("project_risk_proxy_by_group", "parts", ["group_feature", "group_value", "metric"], _RISK),
        ],
        PROXIES,
        """levels as (select case when risk_effort_proxy_raw >= (select quantile_cont(risk_effort_proxy_raw, 0.9) from proxies) then 'high'
             when risk_effort_proxy_raw >= (select quantile_cont(risk_effort_proxy_raw, 0.75) from proxies) then 'medium'
             else 'low' end as risk_effort_proxy_level, count(*) as n from proxies group by 1)""",
        "everything as (select *, '__GLOBAL__' as group_feature, '__GLOBAL__' as group_value from proxies)",
        "grouped as ("
        + " union all ".join(
            f"select *, '{g}' as group_feature, coalesce(cast({g} as varchar), '__NULL__') as group_value from proxies"
            for g in risk.RISK_GROUPS
        )
        + ")",
        f"whole as ({_risk_rows('everything')})",
        f"parts as ({_risk_rows('grouped', 'having count(*) >= 20')})",
    ),
)
def _(spark, sf_dir):
    reports = jobs.risk_report(prepared(spark, sf_dir))
    levels = reports["project_risk_proxy_dataset"].groupBy("risk_effort_proxy_level").agg(F.count("*").alias("n"))
    keys = ["group_feature", "group_value", "metric"]
    return together(
        melted("levels", levels, ["risk_effort_proxy_level"]),
        melted("project_risk_proxy_summary", reports["project_risk_proxy_summary"], keys, _RISK),
        melted("project_risk_proxy_by_group", reports["project_risk_proxy_by_group"], keys, _RISK),
    )
