"""Registered queries: profiles, aggregates, joins, windows, set operations, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.grids import SWEEP_THRESHOLDS
from plumbline.functions.scalars import null_group
from plumbline.operators import gaps, kpi, metrics, perturb, prepare, profile, risk
from plumbline.operators.kpi import ReportTable
from plumbline.plans.metric_sql import long_groups_sql, metrics_sql, pick, sweep_sql
from plumbline.plans.registry import query, rounded
from plumbline.plans.views import (
    GROUPS,
    MODELS,
    PREPARED_COLUMNS,
    issues,
    labelled,
    prepared,
    r,
    scored,
    short_prepared,
    sql,
    table,
    u_sql,
    with_descriptions,
)
from plumbline.session import stage

CATEGORIES = ["project_key", "issuetype", "priority", "status", "late_resolution"]

# ---------------------------------------------------------------- profiles

_TYPES = [
    ("id", "bigint"),
    ("key", "string"),
    ("created", "timestamp_ntz"),
    ("resolutiondate", "timestamp_ntz"),
    ("project_key", "string"),
    ("project_name", "string"),
    ("issuetype", "string"),
    ("priority", "string"),
    ("status", "string"),
    ("summary", "string"),
    ("description", "string"),
    ("created_year", "int"),
    ("created_month", "int"),
    ("is_resolved", "int"),
    ("resolution_valid", "int"),
    ("time_to_resolution_days", "double"),
    ("summary_length", "int"),
    ("description_length", "int"),
    ("has_description", "int"),
    ("late_threshold_days", "double"),
    ("late_resolution", "int"),
]
PROFILE = " union all ".join(
    f"""select '{c}' as "column", '{t}' as dtype, count(*) as rows, count(*) - count({c}) as null_count,
        {r(f"(count(*) - count({c})) * 1e0 / greatest(count(*), 1)")} as null_rate, count(distinct {c}) as distinct_count,
        {r(f"count(distinct {c}) * 1e0 / greatest(count(*), 1)")} as distinct_rate from prepared"""
    for c, t in _TYPES
)


@query("A01_column_profile", sql("prepared", PROFILE))
def _(spark, sf_dir):
    return rounded(profile.quality_summary(prepared(spark, sf_dir)))


def _top_sql(columns, source, top):
    parts = " union all ".join(
        f"select '{c}' as \"column\", coalesce(cast({c} as varchar), '__NULL__') as value from {source}" for c in columns
    )
    return f"""
      select "column", value, n as count, {r(f"n * 1e0 / (select count(*) from {source})")} as rate
      from (select *, row_number() over (partition by "column" order by n desc, value) as rn
            from (select "column", value, count(*) as n from ({parts}) group by all)) where rn <= {top}"""


@query("A02_category_distribution", sql("prepared", _top_sql(CATEGORIES, "prepared", 50)))
def _(spark, sf_dir):
    return rounded(profile.category_distribution(prepared(spark, sf_dir), CATEGORIES))


@query(
    "W04_top_values_per_column",
    sql("prepared", _top_sql(["summary", "project_key", "created_month"], "prepared", 20)),
)
def _(spark, sf_dir):
    return rounded(
        profile.category_distribution(prepared(spark, sf_dir), ["summary", "project_key", "created_month"], top=20)
    )


@query(
    "A03_time_distribution",
    sql("prepared", "select created_year, created_month, count(*) as issues_count from prepared group by all"),
)
def _(spark, sf_dir):
    return profile.time_distribution(prepared(spark, sf_dir))


_NULLS = " + ".join(f"count(*) - count({c})" for c, _ in _TYPES)


@query(
    "A04_quality_snapshot",
    sql(
        "prepared",
        f"""select 'prepared_original' as scenario, count(*) as rows, {len(_TYPES)} as columns,
                   cast({_NULLS} as bigint) as total_nulls,
                   {r(f"({_NULLS}) * 1e0 / (count(*) * {len(_TYPES)})")} as mean_null_rate,
                   {r("avg(cast(late_resolution is null as int))")} as target_null_rate,
                   count(*) - count(distinct key) as duplicate_count from prepared""",
    ),
)
def _(spark, sf_dir):
    return rounded(profile.quality_snapshot(prepared(spark, sf_dir), "prepared_original"))


# Copies: every fifth issue again a day later, every fiftieth without its key as well.
COPIED = """copied as (
  select id, key, created, project_key, priority from issues
  union all select id + 10000000, key, created + interval 1 day, project_key, priority from issues where id % 5 = 0
  union all select id + 20000000, null, created, project_key, priority from issues where id % 50 = 0
  union all select id, key, created, project_key, priority from issues where id % 20 = 0)"""


def copied(spark, sf_dir):
    base = issues(spark, sf_dir).select("id", "key", "created", "project_key", "priority")
    later = base.where("id % 5 = 0").withColumns(
        {"id": F.col("id") + 10_000_000, "created": F.col("created") + F.expr("interval 1 day")}
    )
    keyless = base.where("id % 50 = 0").withColumns({"id": F.col("id") + 20_000_000, "key": F.lit(None).cast("string")})
    return base.union(later).union(keyless).union(base.where("id % 20 = 0"))


@query(
    "A05_duplicate_count",
    sql(
        "issues",
        """select 'key' as scope, count(*) - (select count(*) from (select distinct key from copied)) as duplicate_count from copied
           union all
           select 'row', count(*) - (select count(*) from (select distinct * from copied)) from copied""",
        COPIED,
    ),
)
def _(spark, sf_dir):
    df = copied(spark, sf_dir)
    by_key = df.agg(F.lit("key").alias("scope"), profile.duplicate_count(df).alias("duplicate_count"))
    return by_key.union(df.agg(F.lit("row").alias("scope"), profile.duplicate_count(df, None).alias("duplicate_count")))


@query(
    "W01_keep_last_per_key",
    sql(
        "issues",
        """select id, key, created, project_key, priority from (
             select *, row_number() over (partition by key order by created desc nulls first, id desc) as rn from copied)
           where rn = 1""",
        COPIED,
    ),
)
def _(spark, sf_dir):
    return profile.keep_last(copied(spark, sf_dir))


@query("W01b_distinct_rows", sql("issues", "select distinct * from copied", COPIED))
def _(spark, sf_dir):
    return profile.keep_last(copied(spark, sf_dir), key=None)


ACTIONS_SQL = """
select step, detail, cast(rows_before as bigint) as rows_before, cast(rows_after as bigint) as rows_after,
       cast(rows_before - rows_after as bigint) as rows_removed, cast(affected_rows as bigint) as affected_rows
from (values
 ('normalize_categorical_missing_values', 'Normaliza strings vacíos y valores nulos categóricos como __MISSING__.', null, null, null),
 ('cap_numeric_outliers', 'Limita variables numéricas al percentil 99 para reducir el efecto de outliers extremos.', null, null, null),
 ('remove_duplicate_keys', 'Elimina duplicados por clave si existe la columna key.', (select count(*) from noisy),
  (select count(*) from (select distinct key from noisy)), null),
 ('preserve_unresolved_target_nulls', 'Mantiene filas sin target para análisis de calidad, aunque se excluyen del entrenamiento.',
  null, null, (select count(*) from last where late_resolution is null))) t(step, detail, rows_before, rows_after, affected_rows)"""
# The prepared table with some rows entered twice, the second time a day later.
NOISY = """noisy as (
  select * from prepared union all
  select * replace (created + interval 1 day as created, id + 10000000 as id) from prepared where id % 5 = 0)"""
LAST = "last as (select * from (select *, row_number() over (partition by key order by created desc, id desc) as rn from noisy) where rn = 1)"


def _short_noisy(spark, sf_dir):
    base = short_prepared(spark, sf_dir)
    again = base.where("id % 5 = 0").withColumns(
        {"id": F.col("id") + 10_000_000, "created": F.col("created") + F.expr("interval 1 day")}
    )
    return base.union(again)


def noisy(spark, sf_dir):
    return with_descriptions(_short_noisy(spark, sf_dir), spark, sf_dir).select(*PREPARED_COLUMNS)


def cleaned(spark, sf_dir):
    # No step looks at the descriptions: they are put to the rows that stay.
    clean = profile.clean(_short_noisy(spark, sf_dir), prepare.CATEGORICAL_FEATURES, prepare.NUMERIC_FEATURES)
    return with_descriptions(clean, spark, sf_dir).select(*PREPARED_COLUMNS)


@query("A06_cleaning_actions", sql("prepared", ACTIONS_SQL, NOISY, LAST))
def _(spark, sf_dir):
    return profile.cleaning_actions(noisy(spark, sf_dir), cleaned(spark, sf_dir))


# ---------------------------------------------------------------- risk proxies

PROXIES = """proxies as (
  select *, cast(late_resolution as double) as risk_time_proxy,
         coalesce(time_to_resolution_days, 0) + description_length as risk_effort_proxy_raw, 0e0 as risk_scope_proxy_raw
  from prepared)"""


def _risk_sql(source, scope, having):
    parts = " union all ".join(
        f"""select '{scope}' as scope, group_feature, group_value, '{m}' as metric, count(*) as rows, {r(f"avg({m})")} as mean,
            {r(f"quantile_cont({m}, 0.5)")} as median, {r(f"quantile_cont({m}, 0.75)")} as p75,
            {r(f"quantile_cont({m}, 0.9)")} as p90 from {source} group by all {having}"""
        for m in risk.PROXIES
    )
    return parts


@query(
    "A07_global_proxy_summary",
    sql(
        "prepared",
        _risk_sql("everything", "global", ""),
        PROXIES,
        "everything as (select *, '__GLOBAL__' as group_feature, '__GLOBAL__' as group_value from proxies)",
    ),
)
def _(spark, sf_dir):
    return rounded(risk.proxy_summary(risk.with_proxies(prepared(spark, sf_dir))))


RISK_GROUPED = "grouped as (" + " union all ".join(
    f"select *, '{g}' as group_feature, coalesce(cast({g} as varchar), '__NULL__') as group_value from proxies"
    for g in risk.RISK_GROUPS
) + ")"


@query(
    "A08_group_proxy_summary",
    sql("prepared", _risk_sql("grouped", "group", "having count(*) >= 20"), PROXIES, RISK_GROUPED),
)
def _(spark, sf_dir):
    return rounded(risk.proxy_summary(risk.with_proxies(prepared(spark, sf_dir)), risk.RISK_GROUPS))


# ---------------------------------------------------------------- seeds, worlds, disparities

# A scored row of its own for each model and record.
_ROWS = "(select * replace (model || ':' || id as id) from scored)"


def scored_rows(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("id", F.concat_ws(":", "model", "id"))


# Ten runs over the scored rows, each on its own hashed four fifths.
SEEDS = "seeds as (" + " union all ".join(
    f"select {s} as seed, * from {_ROWS} where {u_sql('id', f'seed{s}')} < 0.8e0" for s in range(42, 52)
) + ")"
SEED_METRICS = metrics_sql("runs", "seeds", ["seed"])


def seed_metrics(spark, sf_dir):
    base = scored_rows(spark, sf_dir)
    chosen = F.array(*[F.when(perturb.hit("id", f"seed{s}", 0.8), s) for s in range(42, 52)])
    runs = base.select("y_true", "y_prob", F.explode(F.array_compact(chosen)).alias("seed"))
    return metrics.evaluate(runs, ["seed"])


_SPREAD = " union all ".join(
    f"""select '{m}' as metric, {r(f'avg("{m}")')} as mean, {r(f'stddev_samp("{m}")')} as std, {r(f'min("{m}")')} as min,
        {r(f'max("{m}")')} as max, {r(f'max("{m}") - min("{m}")')} as range,
        {r(f'stddev_samp("{m}") / nullif(avg("{m}"), 0)')} as coefficient_of_variation from runs"""
    for m in metrics.QUALITY_METRICS
)


@query("A10_seed_spread", sql("scored", _SPREAD, SEEDS, SEED_METRICS))
def _(spark, sf_dir):
    return rounded(gaps.seed_spread(seed_metrics(spark, sf_dir)))


@query(
    "U04_transposed_aggregate",
    sql("scored", f"select metric, mean, std, min, max from ({_SPREAD})", SEEDS, SEED_METRICS),
)
def _(spark, sf_dir):
    return rounded(gaps.seed_spread(seed_metrics(spark, sf_dir)).select("metric", "mean", "std", "min", "max"))


# Eight worlds: the score of each record moves a little from world to world.
WORLDS = f"""worlds as (
  select id, w as world_id,
         floor((0.9e0 * y_prob + 0.1e0 * {u_sql("id || '-' || w", 'w')}) * 65536e0) / 65536e0 as predicted_probability
  from {_ROWS}, (select unnest(range(1, 9)) as w))"""
WORLD_SPREAD = """spread as (
  select id, count(distinct world_id) as worlds, avg(predicted_probability) as mean_probability,
         stddev_samp(predicted_probability) as std_probability, min(predicted_probability) as min_probability,
         max(predicted_probability) as max_probability,
         max(predicted_probability) - min(predicted_probability) as probability_range from worlds group by id)"""


_WORLDS = 8


def worlds(spark, sf_dir):
    from plumbline.functions.scalars import uniform

    base = scored_rows(spark, sf_dir)
    spread = base.select("id", "y_prob", F.explode(F.sequence(F.lit(1), F.lit(_WORLDS))).alias("world_id"))
    noise = uniform(F.concat_ws("-", F.col("id").cast("string"), F.col("world_id").cast("string")), "w")
    moved = F.floor((0.9 * F.col("y_prob") + 0.1 * noise) * 65536.0).cast("double") / 65536.0
    return spread.select("id", "world_id", moved.alias("predicted_probability"))


_SPREAD_COLUMNS = ["mean_probability", "std_probability", "min_probability", "max_probability", "probability_range"]


@query(
    "J11_rows_times_worlds",
    sql("scored", "select id, world_id, predicted_probability from worlds", WORLDS),
)
def _(spark, sf_dir):
    return worlds(spark, sf_dir)


@query("A11_world_spread_per_row", sql("scored", f"select id, worlds, {pick(_SPREAD_COLUMNS)} from spread", WORLDS, WORLD_SPREAD))
def _(spark, sf_dir):
    return rounded(perturb.world_spread(worlds(spark, sf_dir), most_worlds=_WORLDS))


@query(
    "J04_worlds_join_baseline",
    sql(
        "scored",
        f"""select spread.id as id, worlds, {pick(_SPREAD_COLUMNS)}, {r("y_prob")} as baseline_probability
            from spread left join {_ROWS} b using (id)""",
        WORLDS,
        WORLD_SPREAD,
    ),
)
def _(spark, sf_dir):
    baseline = scored_rows(spark, sf_dir)
    baseline = baseline.select("id", F.col("y_prob").alias("baseline_probability"))
    return rounded(perturb.world_spread(worlds(spark, sf_dir), baseline, most_worlds=_WORLDS))


@query(
    "A12_overall_sensitivity",
    sql(
        "scored",
        f"""select count(*) as sample_rows, 8 as worlds, {r("avg(std_probability)")} as mean_probability_std,
                   {r("quantile_cont(probability_range, 0.95)")} as p95_probability_range,
                   {r("max(probability_range)")} as max_probability_range from spread""",
        WORLDS,
        WORLD_SPREAD,
    ),
)
def _(spark, sf_dir):
    return rounded(perturb.world_sensitivity(perturb.world_spread(worlds(spark, sf_dir)), 8))


SHORT = {"false_positive_rate": "fpr", "false_negative_rate": "fnr"}


def short_names(df):
    """The names that group reports use for the two error rates."""
    return df.withColumnsRenamed(SHORT)


STRATEGIES = metrics_sql("g", "named", ["strategy", "group_value"], min_rows=20, one_class_ap=None, edges="left")
NAMED = """named as (select case model when 'boosted' then 'baseline' else model end as strategy, y_true, y_prob,
                            coalesce(project_key, '__NULL__') as group_value from scored)"""
SHORTENED = "short as (select *, false_positive_rate as fpr, false_negative_rate as fnr from g)"


def strategy_groups(spark, sf_dir):

    named = scored(spark, sf_dir).select(
        F.when(F.col("model") == "boosted", "baseline").otherwise(F.col("model")).alias("strategy"),
        null_group(F.col("project_key")).alias("group_value"),
        "y_true",
        "y_prob",
    )
    rows = metrics.evaluate(named, ["strategy", "group_value"], min_rows=20, one_class_ap=None, edges="left")
    return short_names(rows)


_DISPARITY = " union all ".join(
    f"""select strategy, '{m}' as metric, max("{m}") - min("{m}") as absolute_gap, min("{m}") as min_value,
        max("{m}") as max_value from short group by strategy having max("{m}") is not null"""
    for m in gaps.DISPARITY_METRICS
)
DISPARITIES = f"disparities as ({_DISPARITY})"
_D = ["absolute_gap", "min_value", "max_value"]


@query("A14_disparity", sql("scored", f"select strategy, metric, {pick(_D)} from disparities", NAMED, STRATEGIES, SHORTENED, DISPARITIES))
def _(spark, sf_dir):
    return rounded(gaps.disparity(strategy_groups(spark, sf_dir), "strategy"))


@query(
    "J03_disparities_join_baseline",
    sql(
        "scored",
        f"""select strategy, metric, {pick(_D)}, {r("baseline_gap")} as baseline_gap,
                   {r("absolute_gap - baseline_gap")} as delta_gap_vs_baseline
            from disparities left join (select metric, absolute_gap as baseline_gap from disparities
                                        where strategy = 'baseline') using (metric)""",
        NAMED,
        STRATEGIES,
        SHORTENED,
        DISPARITIES,
    ),
)
def _(spark, sf_dir):
    return rounded(gaps.disparity_tradeoffs(gaps.disparity(strategy_groups(spark, sf_dir), "strategy")))


FAIR_KEYS = ["model", "group_feature", "group_value"]
FAIR_LONG = long_groups_sql("spread_groups", "scored", GROUPS, "model, y_true, y_prob")
FAIR_NAMED = "fair_rows as (select model, subgroup_feature as group_feature, subgroup_value as group_value, y_true, y_prob from spread_groups)"
FAIR = metrics_sql("g", "fair_rows", FAIR_KEYS, min_rows=10, edges="left")
_FAIRNESS = " union all ".join(
    f"""select model, group_feature, '{m}' as metric, count(*) as groups_considered, {r(f'min("{m}")')} as min_value,
        {r(f'max("{m}")')} as max_value, {r(f'max("{m}") - min("{m}")')} as absolute_gap,
        {r(f'min("{m}") / nullif(max("{m}"), 0)')} as min_max_ratio,
        first(group_value order by round("{m}", 12) nulls last, group_value) as worst_group,
        first(group_value order by round("{m}", 12) desc nulls last, group_value) as best_group
        from short where rows >= 30 group by model, group_feature having max("{m}") is not null"""
    for m in gaps.FAIRNESS_METRICS
)


def fairness_groups(spark, sf_dir):
    found = metrics.subgroup_metrics(
        scored(spark, sf_dir), GROUPS, threshold=0.25, min_rows=10, edges="left"
    )
    return short_names(found).withColumnsRenamed({"subgroup_feature": "group_feature", "subgroup_value": "group_value"})


@query("A15_fairness_disparity", sql("scored", _FAIRNESS, FAIR_LONG, FAIR_NAMED, FAIR, SHORTENED))
def _(spark, sf_dir):
    return rounded(gaps.fairness_disparity(fairness_groups(spark, sf_dir)))


# ---------------------------------------------------------------- strategies over periods

# Each model stands for a strategy, each year for a test period.
RUNS = """named_runs as (
  select case model when 'boosted' then 'static_initial_train' else model end as strategy,
         'period_' || created_year as test_period, y_true, y_prob from scored)"""
RUN_METRICS = metrics_sql("runs", "named_runs", ["strategy", "test_period"], edges="open0")
Q = metrics.QUALITY_METRICS


def strategy_runs(spark, sf_dir):
    named = scored(spark, sf_dir).select(
        F.when(F.col("model") == "boosted", "static_initial_train").otherwise(F.col("model")).alias("strategy"),
        F.concat(F.lit("period_"), F.col("created_year")).alias("test_period"),
        "y_true",
        "y_prob",
    )
    return metrics.evaluate(named, ["strategy", "test_period"], edges="open0").select("strategy", "test_period", *Q)


_VERSUS = ", ".join(
    f'{r(f"""r."{m}" """)} as "{m}", {r(f"""s."{m}" """)} as static_{m}, {r(f"""r."{m}" - s."{m}" """)} as delta_vs_static_{m}'
    for m in Q
)


@query(
    "J02_strategy_join_static",
    sql(
        "scored",
        f"""select r.strategy, r.test_period, {_VERSUS} from runs r
            left join (select * from runs where strategy = 'static_initial_train') s using (test_period)""",
        RUNS,
        RUN_METRICS,
    ),
)
def _(spark, sf_dir):
    return rounded(gaps.versus_static(strategy_runs(spark, sf_dir)))


_MEANS = "means as (select strategy, count(distinct test_period) as periods, " + ", ".join(
    f'avg("{m}") as avg_{m}' for m in Q
) + " from runs group by strategy)"
_MEAN_DELTAS = ", ".join(
    f"{r(f'avg_{m}')} as avg_{m}, "
    f"""{r(f"avg_{m} - (select avg_{m} from means where strategy = 'static_initial_train')")} as delta_avg_{m}_vs_static"""
    for m in Q
)


@query("A16_strategy_summary", sql("scored", f"select strategy, periods, {_MEAN_DELTAS} from means", RUNS, RUN_METRICS, _MEANS))
def _(spark, sf_dir):
    return rounded(gaps.strategy_summary(strategy_runs(spark, sf_dir)))


@query(
    "J05_deltas_to_baseline_row",
    sql(
        "scored",
        "select model, "
        + ", ".join(
            f"""{r(f'"{m}"')} as "{m}", {r(f'''"{m}" - (select "{m}" from m where model = 'boosted')''')} as delta_{m}"""
            for m in Q
        )
        + " from m",
        metrics_sql("m", "scored", ["model"]),
    ),
)
def _(spark, sf_dir):
    table_ = metrics.evaluate(scored(spark, sf_dir), ["model"]).select("model", *Q)
    return rounded(gaps.deltas_to_run(table_, F.col("model") == "boosted"))


# ---------------------------------------------------------------- joins on rows


@query(
    "J08_rows_in_periods",
    sql("prepared", "select id, created_year from prepared where created_year in (1996, 1998)"),
)
def _(spark, sf_dir):
    wanted = spark.createDataFrame([(1996,), (1998,)], "created_year int")
    return prepared(spark, sf_dir).select("id", "created_year").join(F.broadcast(wanted), "created_year", "left_semi")


@query(
    "J09_rows_outside_a_sample",
    sql(
        "labelled",
        f"""select id, project_key from labelled where id not in (
              select id from (select id, row_number() over (order by {u_sql('id', 'drop')}, id) as rn from labelled
                              where project_key = 'NATION_3') where rn <= 150)""",
    ),
)
def _(spark, sf_dir):
    from plumbline.operators.selection import exact_fraction

    df = labelled(spark, sf_dir).select("id", "project_key")
    left_out = exact_fraction(df, F.col("project_key") == "NATION_3", lambda n: min(n, 150), salt="drop")
    return df.join(df.where(left_out).select("id"), "id", "left_anti")


@query(
    "A19_choose_group_column",
    sql(
        "labelled",
        """select 'project_key' as group_feature, (select p from c order by n, p limit 1) as minority_group,
                  (select p from c order by n desc, p limit 1) as majority_group""",
        "c as (select project_key as p, count(*) as n from labelled where project_key is not null group by 1)",
    ),
)
def _(spark, sf_dir):
    return perturb.choose_group(labelled(spark, sf_dir))


# ---------------------------------------------------------------- windows, sorts, sets

SWEEP = sweep_sql("sweep", "scored", ["model"], SWEEP_THRESHOLDS, None)


@query(
    "W02_first_row_per_group",
    sql(
        "scored",
        f"""select model, {r("threshold")} as threshold, {pick(["recall", "f1"])} from (
              select *, row_number() over (partition by model order by f1 desc, threshold) as rn from sweep where recall >= 0.6e0)
            where rn = 1""",
        SWEEP,
    ),
)
def _(spark, sf_dir):
    counts = metrics.with_confusion_ratios(metrics.threshold_counts(scored(spark, sf_dir), ["model"]))
    best = metrics.first_best_by_f1(counts, min_recall=0.6)
    return rounded(best.select("model", "threshold", "recall", "f1"))


@query(
    "W03_arg_max_row_per_group",
    """select o_custkey, max(o_totalprice) as o_totalprice, arg_max(o_orderkey, o_totalprice * 1e9 - o_orderkey) as o_orderkey
       from orders group by 1""",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct(F.col("o_totalprice"), -F.col("o_orderkey")))
    return orders.groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query(
    "W05_positional_rank",
    sql(
        "labelled",
        f"""select id, priority, row_number() over (partition by priority order by {u_sql('id', 'rank')}, id) - 1 as rank,
                   count(*) over (partition by priority) as n
            from (select id, coalesce(priority, '__NULL__') as priority from labelled)""",
    ),
)
def _(spark, sf_dir):
    from plumbline.operators.selection import with_dense_rank

    df = labelled(spark, sf_dir).select("id", null_group(F.col("priority")).alias("priority"))
    return with_dense_rank(df, ["priority"])


@query(
    "W06_last_value_in_table_order",
    """select event_type, arg_max(value, event_id) as latest_value, max(event_id) as event_id from events
       where value is not null group by 1""",
)
def _(spark, sf_dir):
    known = table(spark, sf_dir, "events").where("value is not null")
    return known.groupBy("event_type").agg(
        F.max_by("value", "event_id").alias("latest_value"), F.max("event_id").alias("event_id")
    )


@query(
    "O01_multi_key_sort",
    sql(
        "prepared",
        "select created_year, status, count(*) as rows from prepared group by all order by created_year, rows desc, status",
    ),
)
def _(spark, sf_dir):
    counts = prepared(spark, sf_dir).groupBy("created_year", "status").agg(F.count("*").alias("rows"))
    return counts.orderBy(F.col("created_year").asc(), F.col("rows").desc(), F.col("status").asc())


@query(
    "U01_union_by_name",
    """select 'customer' as source, c_custkey as id, c_name as name, c_acctbal as balance, null as size from customer
       union all select 'part', p_partkey, p_name, null, p_size from part""",
)
def _(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.lit("part").alias("source"), F.col("p_size").alias("size"), F.col("p_name").alias("name")
    )
    return customers.unionByName(parts, allowMissingColumns=True)


@query(
    "U02_key_union_and_difference",
    """select 'union' as op, k from (select o_custkey as k from orders union select c_custkey from customer)
       union all select 'difference', k from (select c_custkey as k from customer except select o_custkey from orders)""",
)
def _(spark, sf_dir):
    ordered = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    union = ordered.union(known).distinct().select(F.lit("union").alias("op"), "k")
    return union.union(known.exceptAll(ordered.distinct()).distinct().select(F.lit("difference").alias("op"), "k"))
