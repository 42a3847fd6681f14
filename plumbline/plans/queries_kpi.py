"""Registered queries: the KPI mart, from the reports of nine analyses in the order they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grids import SWEEP_THRESHOLDS
from plumbline.operators import drift, gaps, kpi, metrics, perturb
from plumbline.operators.kpi import ReportTable
from plumbline.operators.metrics import METRIC_COLUMNS, QUALITY_METRICS
from plumbline.operators.prepare import SUBGROUP_FEATURES
from plumbline.plans import jobs
from plumbline.plans.metric_sql import metrics_sql, sweep_sql
from plumbline.plans.queries_jobs import (
    ADVANCED_CTES,
    DEGRADATION_CTES,
    DRIFT_CTES,
    LEARNED_CLEANING_CTES,
    RETRAINING_CTES,
    STABILITY_CTES,
    _AVERAGED,
    _CLEANED,
    _DRIFTED,
    learned_scorer,
    melt_sql,
    melted,
    together,
    together_sql,
)
from plumbline.plans.queries_metrics import GAP_CTES
from plumbline.plans.queries_tables import noisy
from plumbline.plans.registry import query, rounded
from plumbline.plans.views import MODELS, once, prepared, r, scored, sql
from plumbline.session import side_by_side

_MODELS = sorted(m[0] for m in MODELS)
_SWEPT = ["rows", "positive_rate_true", "positive_rate_predicted", *QUALITY_METRICS]
_DEGRADED = [*QUALITY_METRICS, "delta_f1", "delta_recall", "delta_ece"]
_SPREAD = ["mean", "std", "min", "max", "range", "coefficient_of_variation"]
_SCENARIOS = [s[0] for s in perturb.DEGRADATION_SCENARIOS]
_STRATEGIES = list(dict.fromkeys(w[0] for w in drift.training_windows(5)))
_GAP_COLUMNS = ["subgroups", *[f"{s}_abs_{m}_gap" for m in gaps.GAP_METRICS for s in ("max", "mean")]]


def written(column: str, values) -> Column:
    """The place at which each of some values is written."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)).alias("written")


def written_sql(column: str, values) -> str:
    return f"list_position([{', '.join(repr(v) for v in values)}], {column})"


# Source, identifying columns, KPIs, and the order of the rows as written, for Spark and for SQL.
REPORTS = [
    ("model_metrics", ["model"], ["rows", "positive_rate_true", *QUALITY_METRICS], ("model", _MODELS), ()),
    ("advanced_model_metrics", ["model", "threshold"], METRIC_COLUMNS, ("model", _MODELS), ()),
    ("threshold_metrics", ["model", "threshold"], _SWEPT, ("model", _MODELS), ("threshold",)),
    ("degradation_summary", ["scenario", "degradation_type", "degradation_rate"], _DEGRADED, ("scenario", _SCENARIOS), ()),
    ("temporal_drift_metrics", ["split_type"], ["threshold", *_DRIFTED], ("split_type", ["random_split", "temporal_split"]), ()),
    ("retraining_summary", ["strategy"], _AVERAGED, ("strategy", _STRATEGIES), ()),
    ("stability_seed_summary", ["metric"], _SPREAD, ("metric", QUALITY_METRICS), ()),
    ("subgroup_gap_summary", ["model", "subgroup_feature"], _GAP_COLUMNS, ("model", _MODELS), ("place",)),
    ("data_cleaning_metrics", ["scenario"], ["threshold", *_CLEANED], ("scenario", ["prepared_original", "cleaned_rules"]), ()),
]


def report_tables(spark, sf_dir) -> dict[str, DataFrame]:
    """The nine reports, each from the job that makes it; the jobs run side by side."""
    df, rows = scored(spark, sf_dir), prepared(spark, sf_dir)

    def from_scores() -> dict[str, DataFrame]:
        tuned = spark.createDataFrame([("boosted", 0.45)], "model string, threshold double")
        base = jobs.baseline_reports(df)
        found = jobs.subgroup_gap_analysis(base["subgroup_metrics"], base["model_metrics"])["subgroup_gap_summary"]
        place = F.array_position(F.array(*[F.lit(f) for f in SUBGROUP_FEATURES]), F.col("subgroup_feature"))
        return {
            "model_metrics": metrics.evaluate(df, ["model"], edges="open0"),
            "advanced_model_metrics": jobs.advanced_metrics(df, tuned)["advanced_model_metrics"],
            "threshold_metrics": metrics.threshold_sweep(df),
            "subgroup_gap_summary": found.withColumn("place", place),
        }

    found = side_by_side(
        spark,
        [
            from_scores,
            lambda: jobs.degradation_experiment(rows, learned_scorer()),
            lambda: jobs.temporal_drift(rows, learned_scorer()),
            lambda: jobs.retraining(rows, learned_scorer()),
            lambda: jobs.stability(rows, lambda seed: learned_scorer()),
            lambda: jobs.cleaning_experiment(noisy(spark, sf_dir), learned_scorer()),
        ],
    )
    made = {}
    for reports in found:
        made.update(reports)
    return made


def kpi_reports(spark, sf_dir) -> list[ReportTable]:
    """The reports as they are read when each analysis has run on its own: written tables."""
    made: dict[str, DataFrame] = {}

    def read(source: str, ids, columns, order, more) -> DataFrame:
        if not made:
            made.update(report_tables(spark, sf_dir))
        return made[source].select(*ids, *columns, *[c for c in more if c not in ids], written(*order))

    out = []
    for source, ids, columns, order, more in REPORTS:
        table = once(spark, sf_dir, f"kpi-{source}", lambda a=(source, ids, columns, order, more): read(*a))
        out.append(ReportTable(source, table, ids, ["written", *more]))
    return out


def _gap_sql() -> str:
    parts = ", ".join(
        f"max(abs({m}_subgroup - {m}_overall)) as max_abs_{m}_gap, avg(abs({m}_subgroup - {m}_overall)) as mean_abs_{m}_gap"
        for m in gaps.GAP_METRICS
    )
    place = written_sql("subgroup_feature", SUBGROUP_FEATURES)
    return f"select model, subgroup_feature, {place} as place, count(*) as subgroups, {parts} from gaps group by model, subgroup_feature"


def _nested(source: str, ctes, select: str) -> str:
    """A report as one CTE, with the CTEs it is made of inside."""
    return f"rep_{source} as (with {', '.join(ctes)} {select})"


_FIXED = metrics_sql("fixed", "scored", ["model"], edges="open0")
_KINDS = ", ".join(f"('{n}', '{k}', {rate}e0)" for n, k, rate in perturb.DEGRADATION_SCENARIOS)
_REPORT_CTES = [
    _nested("model_metrics", [_FIXED], "select * from fixed"),
    _nested("advanced_model_metrics", ADVANCED_CTES, "select * from m"),
    _nested("threshold_metrics", [_FIXED, sweep_sql("sweep", "scored", ["model"], SWEEP_THRESHOLDS, "fixed")], "select * from sweep"),
    _nested(
        "degradation_summary",
        DEGRADATION_CTES,
        f"select * from (select scenario, {', '.join(chr(34) + c + chr(34) for c in _DEGRADED)} from report) join (values {_KINDS}) k(scenario, degradation_type, degradation_rate) using (scenario)",
    ),
    _nested("temporal_drift_metrics", DRIFT_CTES, "select *, 0.25e0 as threshold from report"),
    _nested("retraining_summary", RETRAINING_CTES, "select * from summary"),
    _nested("stability_seed_summary", STABILITY_CTES, "select * from spread"),
    _nested("subgroup_gap_summary", GAP_CTES, _gap_sql()),
    _nested("data_cleaning_metrics", LEARNED_CLEANING_CTES, "select *, 0.25e0 as threshold from report"),
]
_IDS = list(dict.fromkeys(c for _, ids, *_ in REPORTS for c in ids))
_NUMBERS = {"threshold", "degradation_rate"}


def _part(t: int, source: str, ids, column: str, c: int, order, more) -> str:
    cells = [
        f'cast({chr(34) + i + chr(34) if i in ids else "null"} as {"double" if i in _NUMBERS else "varchar"}) as "{i}"' for i in _IDS
    ]
    place = f"[{', '.join(f'cast({x} as double)' for x in (written_sql(*order), *more))}]"
    return f"""select {', '.join(cells)}, '{column}' as kpi, cast("{column}" as double) as value, '{source}' as source_table,
        {t} as t, {c} as c, {place} as o from rep_{source}"""


_KPI_PARTS = [
    _part(t, source, ids, column, c, order, more)
    for t, (source, ids, columns, order, more) in enumerate(REPORTS)
    for c, column in enumerate(columns)
]

_LOWER = "('brier_score', 'ece', 'error_rate', 'false_positive_rate', 'false_negative_rate')"


def _status_sql(metric, value):
    return f"""case when {value} is null then 'missing'
        when {metric} in {_LOWER} then case when {value} <= 0.05e0 then 'green' when {value} <= 0.15e0 then 'amber' else 'red' end
        when {value} >= 0.75e0 then 'green' when {value} >= 0.5e0 then 'amber' else 'red' end"""


KPI_CTES = (
    *_REPORT_CTES,
    f"kpis as (select *, {_status_sql('kpi', 'value')} as status from ({' union all '.join(_KPI_PARTS)}))",
)
_SHOWN_IDS = ", ".join(r(i) + f" as {i}" if i in _NUMBERS else i for i in _IDS)
_LONG = f"{_SHOWN_IDS}, kpi, {r('value')} as value, source_table, status"


def long_kpis(spark, sf_dir) -> DataFrame:
    return kpi.kpi_long(kpi_reports(spark, sf_dir))


@query("U03_wide_to_long", sql("scored", f"select {_LONG} from kpis", *KPI_CTES))
def _(spark, sf_dir):
    return rounded(long_kpis(spark, sf_dir).drop("ordinal").select(*_IDS, "kpi", "value", "source_table", "status"))


_CATALOG = ", ".join("(" + ", ".join(f"'{cell}'" for cell in row) + ")" for row in kpi.KPI_CATALOG)


@query(
    "J12_kpis_join_catalogue",
    sql(
        "scored",
        f"""select {_LONG}, family, definition, interpretation
            from kpis left join (values {_CATALOG}) t(kpi, family, definition, interpretation) using (kpi)""",
        *KPI_CTES,
    ),
)
def _(spark, sf_dir):
    columns = [*_IDS, "kpi", "value", "source_table", "status", "family", "definition", "interpretation"]
    return rounded(kpi.with_catalog(long_kpis(spark, sf_dir).drop("ordinal")).select(*columns))


SNAPSHOT = f"""
select kpi as metric, {r("latest")} as latest_value, {r("lo")} as min_value, {r("hi")} as max_value, {r("mean")} as mean_value,
       {_status_sql("kpi", "latest")} as status
from (select kpi, last(value order by t, c, o) as latest, min(value) as lo, max(value) as hi, avg(value) as mean
      from kpis where value is not null group by kpi)"""


@query("A17_kpi_snapshot", sql("scored", SNAPSHOT, *KPI_CTES))
def _(spark, sf_dir):
    return rounded(kpi.kpi_snapshot(long_kpis(spark, sf_dir)))


_ITEM = ["model", "scenario", "split_type", "strategy", "metric", "subgroup_feature"]


@query(
    "E17_kpi_export",
    together_sql(
        "scored",
        [
            melt_sql("performance_kpis_long", "named", ["source_table", "kpi", "o", "status"], ["value"]),
            melt_sql("kpi_snapshot", "snapshot", ["metric"], ["latest_value", "min_value", "max_value", "mean_value"]),
        ],
        *KPI_CTES,
        f"""named as (select source_table, kpi, status, value,
              concat_ws('/', {', '.join(_ITEM)}) || coalesce('/' || threshold, '') as o from kpis)""",
        """snapshot as (select kpi as metric, last(value order by t, c, o) as latest_value, min(value) as min_value,
             max(value) as max_value, avg(value) as mean_value from kpis where value is not null group by 1)""",
    ),
)
def _(spark, sf_dir):
    reports = jobs.kpi_export(kpi_reports(spark, sf_dir))
    threshold = F.coalesce(F.concat(F.lit("/"), F.col("threshold").cast("string")), F.lit(""))
    long = reports["performance_kpis_long"].withColumn("o", F.concat(F.concat_ws("/", *_ITEM), threshold))
    return together(
        melted("performance_kpis_long", long, ["source_table", "kpi", "o", "status"], ["value"]),
        melted("kpi_snapshot", reports["kpi_snapshot"], ["metric"]),
    )
