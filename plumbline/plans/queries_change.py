"""Registered queries: splits, time windows, drift, perturbations and feature steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.grids import evenly_spaced
from plumbline.functions.scalars import uniform
from plumbline.operators import drift, features, perturb, prepare, selection
from plumbline.plans.registry import query, rounded
from plumbline.plans.views import labelled, prepared, r, sql, u_sql

# ---------------------------------------------------------------- splits and periods


def stratified_split_sql(
    name: str, source: str, seed: int = 42, size: str = "0.2e0", label: str = "late_resolution"
) -> str:
    """CTEs ending in ``name``: the rows with ``split``. Class sizes by largest remainder."""
    return f"""
{name}_n as (select {label} as y, count(*) as n, (select count(*) from {source}) as total from {source} group by 1),
{name}_q as (select *, total - cast(ceil(total * {size}) as bigint) as train from {name}_n),
{name}_w as (select *, n * train // total as whole, n * train % total as rest from {name}_q),
{name}_k as (
  select y, n - whole - cast(row_number() over (order by rest desc, y) <= train - (select sum(whole) from {name}_w) as int) as k
  from {name}_w),
{name} as (
  select * exclude (rn, y, k), case when rn <= k then 'test' else 'train' end as split
  from (select *, row_number() over (partition by {label} order by {u_sql('id', f'split{seed}')}, id) as rn from {source})
  join {name}_k on y = {label})"""


TEMPORAL = """temporal as (
  select * exclude (rn), case when rn <= cast(floor((select count(*) from labelled) * 0.8e0) as bigint) then 'train' else 'test' end as split
  from (select *, row_number() over (order by created, id) as rn from labelled where created is not null))"""
PERIODS = """periods as (
  select * exclude (rn, n), cast(greatest(1, ceil(rn * 5e0 / (n - 1))) as int) as period,
         'period_' || cast(greatest(1, ceil(rn * 5e0 / (n - 1))) as int) as time_bin
  from (select *, row_number() over (order by created, id) - 1 as rn, count(*) over () as n from labelled where created is not null))"""


def dated_rows(spark, sf_dir):
    return prepare.labelled_rows(prepared(spark, sf_dir), ["created"])


def temporal(spark, sf_dir):
    df = dated_rows(spark, sf_dir)
    train = selection.temporal_train(df)
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def stratified(spark, sf_dir):
    return selection.stratified_split(labelled(spark, sf_dir), prepare.TARGET)


def periods(spark, sf_dir):
    return selection.with_time_bins(dated_rows(spark, sf_dir))


@query("D04_temporal_split", sql("labelled", "select id, split from temporal", TEMPORAL))
def _(spark, sf_dir):
    return temporal(spark, sf_dir).select("id", "split")


@query("D05_equal_count_time_bins", sql("labelled", "select id, period, time_bin from periods", PERIODS))
def _(spark, sf_dir):
    return periods(spark, sf_dir).select("id", "period", "time_bin")


@query(
    "D06_stratified_split",
    sql("labelled", "select id, late_resolution, split from s", stratified_split_sql("s", "labelled")),
)
def _(spark, sf_dir):
    return stratified(spark, sf_dir).select("id", "late_resolution", "split")


WINDOWS = "windows as (select * from (values " + ", ".join(
    f"('{s}', {t}, {a}, {b})" for s, t, a, b in drift.training_windows()
) + ") t(strategy, test_period, first_period, last_period))"


@query(
    "D07_training_windows",
    sql(
        "labelled",
        f"""select strategy, test_period, count(*) as rows, min(created) as start, max(created) as end,
                   {r("avg(late_resolution)")} as positive_rate
            from periods join windows on period between first_period and last_period group by all""",
        PERIODS,
        WINDOWS,
    ),
)
def _(spark, sf_dir):
    runs = drift.training_rows(periods(spark, sf_dir), drift.training_windows())
    return rounded(
        runs.groupBy("strategy", "test_period").agg(
            F.count("*").alias("rows"),
            F.min("created").alias("start"),
            F.max("created").alias("end"),
            F.avg(prepare.TARGET).alias("positive_rate"),
        )
    )


@query(
    "D08_split_date_ranges",
    sql(
        "labelled",
        """select 'temporal' as split_type, split, count(*) as rows, min(created) as start, max(created) as end from temporal group by split
           union all select 'random', split, count(*), min(created), max(created) from s group by split""",
        TEMPORAL,
        stratified_split_sql("s", "labelled"),
    ),
)
def _(spark, sf_dir):
    a = drift.date_ranges(temporal(spark, sf_dir)).withColumn("split_type", F.lit("temporal"))
    return a.unionByName(drift.date_ranges(stratified(spark, sf_dir)).withColumn("split_type", F.lit("random")))


@query(
    "A09_period_summary",
    sql(
        "labelled",
        f"""select time_bin, count(*) as rows, min(created) as start, max(created) as end,
                   {r("avg(late_resolution)")} as positive_rate from periods group by 1""",
        PERIODS,
    ),
)
def _(spark, sf_dir):
    return rounded(drift.period_summary(periods(spark, sf_dir), "time_bin"))


# ---------------------------------------------------------------- drift

SHIFTED = [*prepare.NUMERIC_FEATURES, prepare.TARGET]
_PROBS = "[" + ", ".join(f"{p!r}e0" for p in evenly_spaced(0.0, 1.0, 11)) + "]"


def psi_sql(columns) -> str:
    parts = []
    for c in columns:
        parts.append(f"""
select '{c}' as "column", case when len(edges) >= 3 and en > 0 and an > 0 then psi end as psi from (
  select max(edges) as edges, sum(e) as en, sum(a) as an,
         coalesce(sum((ap - ep) * ln(ap / ep)) filter (where bin > 0), 0) as psi
  from (select *, greatest(e / greatest(sum(e) filter (where bin > 0) over (), 1), 1e-6) as ep,
                  greatest(a / greatest(sum(a) filter (where bin > 0) over (), 1), 1e-6) as ap
        from (select edges, case when x between edges[1] and edges[-1]
                                 then least((select count(*) from (select unnest(edges) as e) where e <= x), len(edges) - 1) else 0 end as bin,
                     count(*) filter (where split = 'train') * 1e0 as e, count(*) filter (where split = 'test') * 1e0 as a
              from (select cast({c} as double) as x, split, (
                      select list_sort(list_distinct(quantile_cont(cast({c} as double), {_PROBS})))
                      from temporal where split = 'train') as edges
                    from temporal where {c} is not null) group by all)))""")
    return "psi as (" + " union all ".join(parts) + ")"


@query(
    "D01_stability_index",
    sql("labelled", f'select "column", {r("psi")} as psi from psi', TEMPORAL, psi_sql(SHIFTED)),
)
def _(spark, sf_dir):
    return rounded(drift.stability_index(temporal(spark, sf_dir), SHIFTED))


def _means_sql(columns, extra=""):
    return " union all ".join(
        f"""select '{c}' as "column", avg({c}) filter (where split = 'train') as train_mean,
            avg({c}) filter (where split = 'test') as test_mean from temporal"""
        for c in columns
    )


@query(
    "A20_mean_by_split",
    sql(
        "labelled",
        f"""select "column", {r("train_mean")} as train_mean, {r("test_mean")} as test_mean,
                   {r("test_mean - train_mean")} as delta_mean from ({_means_sql(SHIFTED)})""",
        TEMPORAL,
    ),
)
def _(spark, sf_dir):
    return rounded(drift.mean_shift(temporal(spark, sf_dir), SHIFTED))


@query(
    "D03_numeric_shift",
    sql(
        "labelled",
        f"""select "column", {r("train_mean")} as train_mean, {r("test_mean")} as test_mean,
                   {r("test_mean - train_mean")} as delta_mean, {r("psi")} as psi
            from ({_means_sql(SHIFTED)}) join psi using ("column")""",
        TEMPORAL,
        psi_sql(SHIFTED),
    ),
)
def _(spark, sf_dir):
    return rounded(drift.numeric_shift(temporal(spark, sf_dir), SHIFTED))


SHIFT_COLUMNS = [*prepare.CATEGORICAL_FEATURES, "summary"]
RATES = f"""
counts as (
  select "column", value, count(*) filter (where split = 'train') as tr, count(*) filter (where split = 'test') as te
  from ({" union all ".join(f"select '{c}' as \"column\", coalesce({c}, '__NULL__') as value, split from temporal" for c in SHIFT_COLUMNS)})
  group by all),
rates as (
  select *, tr * 1e0 / (select count(*) from temporal where split = 'train') as train_rate,
         te * 1e0 / (select count(*) from temporal where split = 'test') as test_rate from counts)"""


@query(
    "D02_category_shift",
    sql(
        "labelled",
        f"""select "column", value, {r("train_rate")} as train_rate, {r("test_rate")} as test_rate,
                   {r("test_rate - train_rate")} as delta_rate, {r("abs(test_rate - train_rate)")} as abs_delta_rate
            from (select *, row_number() over (partition by "column" order by tr desc, value) as r1,
                         row_number() over (partition by "column" order by te desc, value) as r2 from rates)
            where (r1 <= 20 and tr > 0) or (r2 <= 20 and te > 0)""",
        TEMPORAL,
        RATES,
    ),
)
def _(spark, sf_dir):
    return rounded(drift.category_shift(temporal(spark, sf_dir), SHIFT_COLUMNS))


@query(
    "J07_rates_full_outer",
    sql(
        "labelled",
        f"""select 'summary' as "column", coalesce(a.value, b.value) as value, {r("coalesce(a.rate, 0)")} as train_rate,
                   {r("coalesce(b.rate, 0)")} as test_rate
            from (select value, train_rate as rate from rates where "column" = 'summary' and tr > 0) a
            full join (select value, test_rate as rate from rates where "column" = 'summary' and te > 0) b using (value)""",
        TEMPORAL,
        RATES,
    ),
)
def _(spark, sf_dir):
    df = temporal(spark, sf_dir)
    sides = []
    for side in ("train", "test"):
        part = df.where(F.col("split") == side)
        total = part.agg(F.count("*").cast("double").alias("n")).scalar()
        counts = part.groupBy(F.lit("summary").alias("column"), F.col("summary").alias("value")).agg(F.count("*").alias("n"))
        sides.append(counts.select("column", "value", (F.col("n") / total).alias("rate")))
    return rounded(drift.outer_rates(*sides))


# ---------------------------------------------------------------- perturbations

FEATURES = ["priority", "description_length", "has_description", "late_resolution"]


@query(
    "X01_random_nulls",
    sql("labelled", f"select id, case when {u_sql('id', 'null')} >= 0.3e0 then priority end as priority from labelled"),
)
def _(spark, sf_dir):
    return perturb.random_nulls(labelled(spark, sf_dir), "priority", 0.3).select("id", "priority")


@query(
    "X02_text_loss",
    sql(
        "labelled",
        f"""select id, case when {u_sql('id', 'text')} < 0.4e0 then 0 else description_length end as description_length,
                   case when {u_sql('id', 'text')} < 0.4e0 then 0 else has_description end as has_description from labelled""",
    ),
)
def _(spark, sf_dir):
    return perturb.text_loss(labelled(spark, sf_dir), 0.4).select("id", "description_length", "has_description")


def values_sql(salt: str) -> str:
    return f"""vals as (
      select priority as new, row_number() over (order by {u_sql('priority', salt)}, priority) - 1 as rank, count(*) over () as n
      from (select distinct priority from labelled where priority is not null))"""


@query(
    "X03_category_noise",
    sql(
        "labelled",
        f"""select id, case when {u_sql('id', 'hit')} < 0.4e0 then new else priority end as priority
            from labelled join vals on rank = cast(floor({u_sql('id', 'noise-draw')} * n) as bigint)""",
        values_sql("noise"),
    ),
)
def _(spark, sf_dir):
    return perturb.category_noise(labelled(spark, sf_dir), "priority", perturb.hit("id", "hit", 0.4)).select("id", "priority")


@query(
    "X04_positive_undersampling",
    sql(
        "labelled",
        f"""select id, late_resolution, split from s
            where not (split = 'train' and late_resolution = 1 and {u_sql('id', 'keep')} >= 0.5e0)""",
        stratified_split_sql("s", "labelled"),
    ),
)
def _(spark, sf_dir):
    df = perturb.undersample_positives(stratified(spark, sf_dir), 0.5, where=F.col("split") == "train")
    return df.select("id", "late_resolution", "split")


# The bias scenarios act on the training rows; the rarest and the most frequent project.
BIAS = f"""
train as (select * from s where split = 'train'),
pc as (select project_key as p, count(*) as n from labelled where project_key is not null group by 1),
mm as (select (select p from pc order by n, p limit 1) as mi, (select p from pc order by n desc, p limit 1) as ma),
marked as (
  select *, project_key = mi as minority,
         row_number() over (partition by project_key order by {u_sql('id', 'keep-minority')}, id) as rk,
         count(*) over (partition by project_key) as nk,
         row_number() over (partition by project_key, late_resolution order by {u_sql('id', 'flip-minority')}, id) as rf,
         row_number() over (partition by project_key, late_resolution order by {u_sql('id', 'flip-majority')}, id) as rj,
         count(*) over (partition by project_key, late_resolution) as nf
  from train, mm),
touched as (
  select *, coalesce(minority, false) as rare, coalesce(minority and rk <= least(nk, greatest(1, cast(floor(nk * 0.35e0) as int))), false) as kept,
         coalesce(minority and late_resolution = 1 and rf <= cast(floor(nf * 0.3e0) as int), false) as to0,
         coalesce(project_key = ma and late_resolution = 0 and rj <= cast(floor(nf * 0.15e0) as int), false) as to1 from marked)"""
BIAS_CTES = (stratified_split_sql("s", "labelled"), BIAS)


def bias_setting(spark, sf_dir):
    train = stratified(spark, sf_dir).where("split = 'train'")
    return train, perturb.chosen_group(labelled(spark, sf_dir))


def _one_scenario(spark, sf_dir, scenario, columns):
    train, group = bias_setting(spark, sf_dir)
    return perturb.bias_scenarios(train, *group, scenarios=[scenario]).select("id", *columns)


@query(
    "X05_underrepresent_minority",
    sql("labelled", "select id, project_key from touched where not rare or kept", *BIAS_CTES),
)
def _(spark, sf_dir):
    return _one_scenario(spark, sf_dir, "sample_bias_underrepresent_minority", ["project_key"])


@query(
    "X06_selective_measurement_loss",
    sql(
        "labelled",
        """select id, case when rare then 0 else description_length end as description_length,
                  case when rare then 0 else has_description end as has_description from touched""",
        *BIAS_CTES,
    ),
)
def _(spark, sf_dir):
    return _one_scenario(spark, sf_dir, "measurement_bias_description_loss", ["description_length", "has_description"])


@query(
    "X07_selective_missingness",
    sql("labelled", "select id, case when not rare then priority end as priority from touched", *BIAS_CTES),
)
def _(spark, sf_dir):
    return _one_scenario(spark, sf_dir, "measurement_bias_priority_missing", ["priority"])


@query(
    "X08_minority_label_flip",
    sql("labelled", "select id, case when to0 then 0 else late_resolution end as late_resolution from touched", *BIAS_CTES),
)
def _(spark, sf_dir):
    return _one_scenario(spark, sf_dir, "historical_label_bias_minority", ["late_resolution"])


@query(
    "X09_majority_label_flip",
    sql("labelled", "select id, case when to1 then 1 else late_resolution end as late_resolution from touched", *BIAS_CTES),
)
def _(spark, sf_dir):
    return _one_scenario(spark, sf_dir, "historical_label_bias_majority", ["late_resolution"])


BIAS_ROWS = """
  select id, scenario, split,
         case when scenario = 'historical_label_bias_minority' and to0 then 0
              when scenario = 'historical_label_bias_majority' and to1 then 1 else late_resolution end as late_resolution,
         case when scenario = 'measurement_bias_description_loss' and rare then 0 else description_length end as description_length,
         case when scenario = 'measurement_bias_description_loss' and rare then 0 else has_description end as has_description,
         case when not (scenario = 'measurement_bias_priority_missing' and rare) then priority end as priority
  from touched, (select unnest([{0}]) as scenario)
  where not (scenario = 'sample_bias_underrepresent_minority' and rare and not kept)""".format(
    ", ".join(f"'{s}'" for s in perturb.BIAS_SCENARIOS)
)


@query("X12b_bias_scenario_catalogue", sql("labelled", BIAS_ROWS, *BIAS_CTES))
def _(spark, sf_dir):
    train, group = bias_setting(spark, sf_dir)
    return perturb.bias_scenarios(train, *group).select("id", "scenario", "split", *FEATURES)


DEGRADED_ROWS = f"""degraded as (
  select s.* replace (
           case when kind = 'priority_null' and struck then null
                when kind = 'priority_noise' and struck then new else priority end as priority,
           case when kind = 'description_loss' and struck then 0 else description_length end as description_length,
           case when kind = 'description_loss' and struck then 0 else has_description end as has_description),
         scenario, kind as degradation_type, rate as degradation_rate
  from (select s.*, scenario, kind, rate, {u_sql("id || '-' || scenario", 'degrade')} < rate as struck,
               cast(floor({u_sql("id || '-' || scenario", 'degrade-draw')} * (select max(n) from vals)) as bigint) as draw
        from s, (values {", ".join(f"('{n}', '{t}', {v}e0)" for n, t, v in perturb.DEGRADATION_SCENARIOS)}) c(scenario, kind, rate)) s
  join vals on rank = draw
  where not (kind = 'positive_undersample_train' and split = 'train' and late_resolution = 1 and not struck))"""
# DuckDB reads "s.* replace" over the inner columns, so the helper columns are left out by name.
DEGRADED_ROWS = DEGRADED_ROWS.replace("s.* replace (\n", "s.* exclude (scenario, kind, rate, struck, draw) replace (\n")
DEGRADED_CTES = (stratified_split_sql("s", "labelled"), values_sql("degrade"), DEGRADED_ROWS)


def degraded(spark, sf_dir):
    return perturb.degradation_scenarios(stratified(spark, sf_dir))


@query(
    "X12_scenario_catalogue",
    sql(
        "labelled",
        f"""select id, scenario, degradation_type, {r("degradation_rate")} as degradation_rate, split, {", ".join(FEATURES)}
            from degraded""",
        *DEGRADED_CTES,
    ),
)
def _(spark, sf_dir):
    df = degraded(spark, sf_dir)
    return rounded(df.select("id", "scenario", "degradation_type", "degradation_rate", "split", *FEATURES))


# Records with more gaps than the prepared ones: no priority and no length for many of them.
GAPPED = f"""gapped as (
  select id, split, project_key, issuetype, case when {u_sql('id', 'g1')} >= 0.3e0 then priority end as priority,
         case when {u_sql('id', 'g2')} >= 0.3e0 then summary_length end as summary_length, created_year from s)"""
_DRAWN = ["priority", "summary_length"]
_DONORS = " union all ".join(
    f"""select '{c}' as c, cast({c} as varchar) as v, row_number() over (order by {u_sql('id', 'worlds')}, id) - 1 as rank,
        count(*) over () as n from gapped where split = 'train' and {c} is not null"""
    for c in _DRAWN
)
SAMPLE = f"sample as (select * from gapped where split = 'test' order by {u_sql('id', 'world-sample')}, id limit 1000)"


def _drawn_sql(c):
    key = f"id || '-' || w || '-{c}'"
    return f"""coalesce(cast({c} as varchar), (select v from donors where c = '{c}'
        and rank = cast(floor({u_sql(key, 'world-draw')} * (select max(n) from donors where c = '{c}')) as bigint)))"""


WORLD_CTES = (
    stratified_split_sql("s", "labelled"),
    GAPPED,
    SAMPLE,
    f"donors as ({_DONORS})",
    f"""drawn as (select id, w as world_id, project_key, issuetype, {_drawn_sql('priority')} as priority,
                  cast({_drawn_sql('summary_length')} as int) as summary_length, created_year
           from sample, (select unnest(range(1, 21)) as w))""",
)


def gapped(spark, sf_dir):
    return stratified(spark, sf_dir).select(
        "id",
        "split",
        "project_key",
        "issuetype",
        F.when(uniform(F.col("id"), "g1") >= 0.3, F.col("priority")).alias("priority"),
        F.when(uniform(F.col("id"), "g2") >= 0.3, F.col("summary_length")).alias("summary_length"),
        "created_year",
    )


def possible_worlds(spark, sf_dir):
    df = gapped(spark, sf_dir)
    rows = perturb.world_sample(df.where("split = 'test'")).drop("split")
    return perturb.possible_worlds(
        rows, df.where("split = 'train'"), prepare.CATEGORICAL_FEATURES, ["summary_length", "created_year"]
    )


@query(
    "X10_possible_worlds",
    sql(
        "labelled",
        "select id, world_id, project_key, issuetype, priority, summary_length, created_year from drawn",
        *WORLD_CTES,
    ),
)
def _(spark, sf_dir):
    return possible_worlds(spark, sf_dir).select(
        "id", "world_id", "project_key", "issuetype", "priority", "summary_length", "created_year"
    )


@query(
    "X11_fixed_size_sample",
    sql(
        "labelled",
        "select id, priority, summary_length from sample",
        stratified_split_sql("s", "labelled"),
        GAPPED,
        SAMPLE,
    ),
)
def _(spark, sf_dir):
    return perturb.world_sample(gapped(spark, sf_dir).where("split = 'test'")).select("id", "priority", "summary_length")


# ---------------------------------------------------------------- feature steps


@query(
    "F01_most_frequent_imputation",
    sql(
        "prepared",
        """select id, coalesce(priority, (select priority from prepared where priority is not null
             group by 1 order by count(*) desc, priority limit 1)) as priority,
             coalesce(project_key, (select project_key from prepared where project_key is not null
             group by 1 order by count(*) desc, project_key limit 1)) as project_key from prepared""",
    ),
)
def _(spark, sf_dir):
    df = prepared(spark, sf_dir)
    values = {x.column: x.value for x in features.most_frequent(df, ["priority", "project_key"]).collect()}
    return features.fill_categories(df, values).select("id", "priority", "project_key")


@query(
    "F02_median_imputation",
    sql(
        "prepared",
        f"""select id, {r("coalesce(time_to_resolution_days, (select quantile_cont(time_to_resolution_days, 0.5) from prepared))")}
                   as time_to_resolution_days from prepared""",
    ),
)
def _(spark, sf_dir):
    df = prepared(spark, sf_dir)
    values = {x.column: x.value for x in features.medians(df, ["time_to_resolution_days"]).collect()}
    return rounded(features.fill_numbers(df, values).select("id", "time_to_resolution_days"))


_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "F03_one_hot_columns",
    sql(
        "prepared",
        "select id, " + ", ".join(f"""cast(coalesce(priority = '{v}', false) as int) as "priority={v}" """ for v in _LEVELS) + " from prepared",
    ),
)
def _(spark, sf_dir):
    encoded = features.one_hot_columns(prepared(spark, sf_dir), "priority", _LEVELS)
    return encoded.select("id", *[f"priority={v}" for v in _LEVELS])


_SCALED = ["summary_length", "description_length", "created_year", "is_constant"]


@query(
    "F04_standardise",
    sql(
        "prepared",
        "select id, "
        + ", ".join(
            r(f"({c} - (select avg({c}) from c)) / (select case when stddev_pop({c}) = 0 then 1 else stddev_pop({c}) end from c)")
            + f" as {c}"
            for c in _SCALED
        )
        + " from c",
        "c as (select *, 7 as is_constant from prepared)",
    ),
)
def _(spark, sf_dir):
    df = prepared(spark, sf_dir).withColumn("is_constant", F.lit(7))
    return rounded(features.standardize(df, _SCALED).select("id", *_SCALED))
