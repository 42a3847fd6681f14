"""Registered queries: sources, sinks, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.grids import DEFAULT_THRESHOLDS
from plumbline.functions.scalars import (
    absolute_error,
    finite,
    missing_as_category,
    nested_or_default,
    normalize_text,
    null_group,
    parse_utc,
    predicted,
    present,
    safe_ratio,
    status_of,
    to_number,
)
from plumbline.operators import features, mitigation, prepare, profile, risk, selection
from plumbline.plans.registry import query, rounded
from plumbline.plans.views import (
    issues,
    labelled,
    normalize_sql,
    prepared,
    r,
    raw_issues,
    scored,
    sql,
    table,
    u_sql,
)
from plumbline.session import scratch_path
from plumbline.sources.readers import file_inventory, fingerprint, read_csv, read_if_exists, read_nested
from plumbline.sources.sinks import write_report

# ---------------------------------------------------------------- sources and sinks


def nested_documents(spark, sf_dir):
    """Raw issues as nested documents; some have no fields at all, some no project."""
    number, raw = F.col("id"), raw_issues(spark, sf_dir)
    project = F.when(number % 13 != 0, F.struct(F.col("project_key").alias("key"), F.col("project_name").alias("name")))

    def stamp(c):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'")

    fields = F.struct(
        stamp("created").alias("created"),
        stamp("resolutiondate").alias("resolutiondate"),
        project.alias("project"),
        F.struct(F.col("issuetype").alias("name")).alias("issuetype"),
        F.struct(F.col("priority").alias("name")).alias("priority"),
        F.struct(F.col("status").alias("name")).alias("status"),
        "summary",
        "description",
    )
    return raw.select(
        number.cast("string").alias("_id"), F.col("key"), F.when(number % 211 != 0, fields).alias("fields")
    )


def flattened(df):
    """The flat columns, the description as length and digest of the whole text."""
    return df.withColumn("description_md5", F.md5("description")).withColumn(
        "description", F.length("description")
    )


def _flat(expression):
    return f"case when id % 211 <> 0 then {expression} end"


_STAMP = "strftime({0}, '%Y-%m-%dT%H:%M:%S.') || '000+0000'"
_DESCRIPTION = _flat(normalize_sql("description"))
FLATTENED = f"""
select cast(id as varchar) as _id, key,
       {_flat(_STAMP.format("created"))} as created, {_flat(_STAMP.format("resolutiondate"))} as resolutiondate,
       {_flat("case when id % 13 <> 0 then project_key end")} as project_key,
       {_flat("case when id % 13 <> 0 then project_name end")} as project_name,
       {_flat("issuetype")} as issuetype, {_flat(normalize_sql("priority"))} as priority, {_flat("status")} as status,
       {_flat("summary")} as summary, length({_DESCRIPTION}) as description, md5({_DESCRIPTION}) as description_md5
from raw_issues"""


@query("S01_nested_document_scan", sql("raw_issues", FLATTENED))
def _(spark, sf_dir):
    path = scratch_path(spark, "documents-json")
    nested_documents(spark, sf_dir).write.json(path, compression="gzip")
    return flattened(prepare.flatten_documents(read_nested(spark, path)))


ISSUE_CSV = """id bigint, key string, created timestamp_ntz, resolutiondate timestamp_ntz, project_key string,
    project_name string, issuetype string, priority string, status string, summary string, description string"""


@query(
    "S02_csv_scan",
    sql(
        "raw_issues",
        """select * exclude (description, priority), nullif(priority, '') as priority,
                  length(description) as description, md5(description) as description_md5 from raw_issues""",
    ),
)
def _(spark, sf_dir):
    path = write_report(raw_issues(spark, sf_dir), scratch_path(spark, "issues-csv"), "csv", compression="gzip")
    return flattened(read_csv(spark, path, ISSUE_CSV))


@query(
    "S03_optional_table_scan",
    """select 'orders' as source_table, count(*) as rows from orders union all
       select 'labels', count(*) from labels""",
)
def _(spark, sf_dir):
    found = {n: read_if_exists(spark, f"{sf_dir}/{n}.parquet") for n in ["orders", "no_such_report", "labels"]}
    counts = [
        df.agg(F.lit(n).alias("source_table"), F.count("*").alias("rows")) for n, df in found.items() if df is not None
    ]
    return counts[0].unionByName(counts[1])


@query(
    "S04_present_feature_columns",
    sql(
        "prepared",
        """select id, project_key, issuetype, priority, summary_length, description_length, has_description,
                  created_year, created_month from prepared""",
    ),
)
def _(spark, sf_dir):
    df = prepared(spark, sf_dir)
    wanted = [*prepare.CATEGORICAL_FEATURES, "component", *prepare.NUMERIC_FEATURES, "watch_count"]
    return df.select("id", *present(df, wanted))


@query(
    "S05_row_cap_sample",
    sql("labelled", f"select id, project_key, late_resolution from labelled order by {u_sql('id', 'sample')}, id limit 2000"),
)
def _(spark, sf_dir):
    return selection.sample_rows(labelled(spark, sf_dir), 2000).select("id", "project_key", "late_resolution")


@query(
    "S06_partitioned_report_sink",
    sql(
        "prepared",
        f"""select project_key, created_year, count(*) as rows, {r("avg(time_to_resolution_days)")} as mean_days
            from prepared group by all""",
    ),
)
def _(spark, sf_dir):
    report = prepared(spark, sf_dir).groupBy("project_key", "created_year").agg(
        F.count("*").alias("rows"), F.avg("time_to_resolution_days").alias("mean_days")
    )
    path = write_report(rounded(report), scratch_path(spark, "report"), partition_by=["created_year"])
    return spark.read.schema(report.schema).parquet(path)


@query("S07_file_inventory")
def _(spark, sf_dir):
    return file_inventory(spark, sf_dir, "*.parquet")


@query(
    "S08_content_fingerprint",
    """select o_orderstatus, count(*) as rows,
              cast(sum(cast(('0x' || substr(md5(concat_ws(chr(31), o_orderkey, coalesce(cast(o_custkey as varchar), '\\N'),
                  o_orderpriority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'))), 1, 8)) as bigint)) as varchar) as fingerprint
       from orders group by 1""",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return fingerprint(orders, ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"], ["o_orderstatus"])


# ---------------------------------------------------------------- projections and scalars


@query("P01_flatten_nested", sql("raw_issues", FLATTENED))
def _(spark, sf_dir):
    return flattened(prepare.flatten_documents(nested_documents(spark, sf_dir)))


@query(
    "P02_nested_lookup_with_default",
    sql(
        "raw_issues",
        f"""select cast(id as varchar) as _id,
                   coalesce({_flat("case when id % 13 <> 0 then project_key end")}, 'unknown') as project_key,
                   coalesce({_flat("priority")}, 'unknown') as priority from raw_issues""",
    ),
)
def _(spark, sf_dir):
    return nested_documents(spark, sf_dir).select(
        "_id",
        nested_or_default(F.col("fields.project.key"), "unknown").alias("project_key"),
        nested_or_default(F.col("fields.priority.name"), "unknown").alias("priority"),
    )


@query(
    "P03_null_like_normalisation",
    sql("raw_issues", f"select id, priority as raw, {normalize_sql('priority')} as priority from raw_issues"),
)
def _(spark, sf_dir):
    return raw_issues(spark, sf_dir).select(
        "id", F.col("priority").alias("raw"), normalize_text(F.col("priority")).alias("priority")
    )


@query(
    "P04_tolerant_timestamp_parse",
    """select event_id, case when event_id % 5 = 4 then null
                             when event_id % 5 = 3 then strftime(ts, '%Y-%m-%d 00:00:00')
                             else strftime(ts, '%Y-%m-%d %H:%M:%S') end as parsed from events""",
)
def _(spark, sf_dir):
    number, ts = F.col("event_id"), F.col("ts")
    text = (
        F.when(number % 5 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'"))
        .when(number % 5 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss'+00:00'"))
        .when(number % 5 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(number % 5 == 3, F.date_format(ts, "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("garbage "), F.col("event_type")))
    )
    parsed = F.date_format(parse_utc(text), "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("parsed"))


def dated(spark, sf_dir):
    return prepare.with_date_features(issues(spark, sf_dir))


def with_texts(spark, sf_dir):
    return prepare.with_text_features(issues(spark, sf_dir))


@query("P05_calendar_parts", sql("dated", "select id, created_year, created_month from dated"))
def _(spark, sf_dir):
    return dated(spark, sf_dir).select("id", "created_year", "created_month")


@query("P06_is_resolved", sql("dated", "select id, is_resolved from dated"))
def _(spark, sf_dir):
    return dated(spark, sf_dir).select("id", "is_resolved")


@query("P07_resolution_valid", sql("dated", "select id, resolution_valid from dated"))
def _(spark, sf_dir):
    return dated(spark, sf_dir).select("id", "resolution_valid")


@query(
    "P08_duration_days",
    sql("dated", f"select id, {r('time_to_resolution_days')} as time_to_resolution_days from dated"),
)
def _(spark, sf_dir):
    return rounded(dated(spark, sf_dir).select("id", "time_to_resolution_days"))


@query("P09_text_lengths", sql("dated", "select id, summary_length, description_length from dated"))
def _(spark, sf_dir):
    return with_texts(spark, sf_dir).select("id", "summary_length", "description_length")


@query("P10_has_description", sql("dated", "select id, has_description from dated"))
def _(spark, sf_dir):
    return with_texts(spark, sf_dir).select("id", "has_description")


@query(
    "P11_absent_columns_as_null",
    sql("issues", "select id, key, null as reporter, 0 as description_length from issues"),
)
def _(spark, sf_dir):
    bare = prepare.with_missing_columns(issues(spark, sf_dir).drop("description"), ["reporter"])
    return prepare.with_text_features(bare).select("id", "key", "reporter", "description_length")


@query(
    "P12_percentile_threshold",
    sql("dated", f"select {r('quantile_cont(time_to_resolution_days, 0.75)')} as threshold from dated"),
)
def _(spark, sf_dir):
    return rounded(spark.range(1).select(prepare.label_threshold(dated(spark, sf_dir)).alias("threshold")))


@query(
    "P13_fixed_threshold",
    sql(
        "dated",
        """select id, cast(30 as double) as late_threshold_days,
                  cast(time_to_resolution_days > 30 as int) as late_resolution from dated""",
    ),
)
def _(spark, sf_dir):
    df = dated(spark, sf_dir)
    limit = prepare.label_threshold(df, method="fixed_days", days=30)
    return prepare.with_label(df, limit).select("id", "late_threshold_days", "late_resolution")


@query(
    "P14_label",
    sql(
        "prepared",
        f"select id, {r('late_threshold_days')} as late_threshold_days, late_resolution from prepared",
    ),
)
def _(spark, sf_dir):
    df = dated(spark, sf_dir)
    return rounded(
        prepare.with_label(df, prepare.label_threshold(df)).select("id", "late_threshold_days", "late_resolution")
    )


@query(
    "P15_labelled_rows",
    sql("prepared", "select id, late_resolution from prepared where late_resolution is not null and created is not null"),
)
def _(spark, sf_dir):
    return prepare.labelled_rows(prepared(spark, sf_dir), ["created"]).select("id", "late_resolution")


@query(
    "P16_null_as_group",
    sql(
        "prepared",
        """select id, coalesce(priority, '__NULL__') as priority,
                  coalesce(cast(late_resolution as varchar), '__NULL__') as late_resolution from prepared""",
    ),
)
def _(spark, sf_dir):
    return prepared(spark, sf_dir).select(
        "id",
        null_group(F.col("priority")).alias("priority"),
        null_group(F.col("late_resolution")).alias("late_resolution"),
    )


@query(
    "P17_missing_category_fill",
    sql(
        "raw_issues",
        f"""select id, project_key, issuetype, coalesce({normalize_sql("priority")}, '__MISSING__') as priority,
                   coalesce({normalize_sql("summary")}, '__MISSING__') as summary from raw_issues""",
    ),
)
def _(spark, sf_dir):
    df = profile.normalize_categories(raw_issues(spark, sf_dir), prepare.CATEGORICAL_FEATURES)
    return df.select("id", *prepare.CATEGORICAL_FEATURES, missing_as_category(F.col("summary")).alias("summary"))


@query(
    "P18_numeric_coercion",
    f"select event_id, {r('try_cast(case when event_id % 3 = 0 then event_type else cast(event_id as varchar) end as double)')} as number from events",
)
def _(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return rounded(table(spark, sf_dir, "events").select("event_id", to_number(text).alias("number")))


_CAPPED = ["summary_length", "description_length", "has_description", "created_year", "created_month"]
CAPPED_SQL = ", ".join(
    f"{r(f'least(greatest({c}, 0), (select quantile_cont({c}, 0.99) from prepared))')} as {c}" for c in _CAPPED
)


@query("P19_winsorise", sql("prepared", f"select id, {CAPPED_SQL} from prepared"))
def _(spark, sf_dir):
    return rounded(profile.cap_outliers(prepared(spark, sf_dir), _CAPPED).select("id", *_CAPPED))


@query(
    "P20_first_existing_alias",
    sql(
        "prepared",
        f"select id, {r('coalesce(time_to_resolution_days, 0)')} as days, 0e0 as comments, "
        f"{r('summary_length')} as size from prepared",
    ),
)
def _(spark, sf_dir):
    from plumbline.functions.scalars import first_present

    df = prepared(spark, sf_dir)
    return rounded(
        df.select(
            "id",
            first_present(df, ["time_to_resolution_days"]).alias("days"),
            first_present(df, ["comments_count", "comment_count"]).alias("comments"),
            first_present(df, ["title_length", "summary_length"]).alias("size"),
        )
    )


EFFORT = "coalesce(time_to_resolution_days, 0) + description_length"


@query(
    "P21_additive_proxies",
    sql(
        "prepared",
        f"""select id, {r("late_resolution")} as risk_time_proxy, {r(EFFORT)} as risk_effort_proxy_raw,
                   0e0 as risk_scope_proxy_raw from prepared""",
    ),
)
def _(spark, sf_dir):
    return rounded(risk.with_proxies(prepared(spark, sf_dir)).select("id", *risk.PROXIES))


@query(
    "P22_three_level_bucketing",
    sql(
        "prepared",
        """select id, case when effort >= (select quantile_cont(effort, 0.9) from e) then 'high'
                           when effort >= (select quantile_cont(effort, 0.75) from e) then 'medium' else 'low' end
                      as risk_effort_proxy_level, 'high' as risk_scope_proxy_level from e""",
        f"e as (select id, {EFFORT} as effort from prepared)",
    ),
)
def _(spark, sf_dir):
    levelled = risk.with_levels(risk.with_proxies(prepared(spark, sf_dir)))
    return levelled.select("id", "risk_effort_proxy_level", "risk_scope_proxy_level")


@query("P23_thresholded_prediction", sql("scored", "select model, id, cast(y_prob >= 0.25e0 as int) as y_pred from scored"))
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("model", "id", predicted(F.col("y_prob"), 0.25).alias("y_pred"))


@query(
    "P24_group_threshold_prediction",
    sql(
        "scored",
        """select model, id, threshold, cast(y_prob >= threshold as int) as y_pred from (
             select *, case project_key when 'NATION_1' then 0.4e0 when 'NATION_2' then 0.1e0 else 0.25e0 end as threshold
             from scored)""",
    ),
)
def _(spark, sf_dir):
    limits = spark.createDataFrame([("NATION_1", 0.4), ("NATION_2", 0.1)], "group_value string, threshold double")
    return mitigation.with_group_threshold(scored(spark, sf_dir), "project_key", limits).select(
        "model", "id", "threshold", "y_pred"
    )


@query("P25_absolute_error", sql("scored", f"select model, id, {r('abs(y_true - y_prob)')} as error from scored"))
def _(spark, sf_dir):
    return rounded(
        scored(spark, sf_dir).select("model", "id", absolute_error(F.col("y_true"), F.col("y_prob")).alias("error"))
    )


@query(
    "P26_traffic_light_status",
    sql(
        "scored",
        """select model, id, kpi, case when value is null then 'missing'
                  when kpi in ('ece', 'brier_score') then
                    case when value <= 0.05e0 then 'green' when value <= 0.15e0 then 'amber' else 'red' end
                  when value >= 0.75e0 then 'green' when value >= 0.5e0 then 'amber' else 'red' end as status
           from (select model, id, case id % 3 when 0 then 'ece' when 1 then 'f1' else 'recall' end as kpi,
                        case when id % 11 <> 0 then y_prob end as value from scored)""",
    ),
)
def _(spark, sf_dir):
    number = F.col("id")
    kpi = F.when(number % 3 == 0, "ece").when(number % 3 == 1, "f1").otherwise("recall")
    value = F.when(number % 11 != 0, F.col("y_prob"))
    return scored(spark, sf_dir).select("model", "id", kpi.alias("kpi"), status_of(kpi, value).alias("status"))


@query(
    "P27_infinite_to_null",
    sql(
        "scored",
        f"select model, id, {r('case when y_true <> 0 then y_prob / y_true end')} as ratio from scored",
    ),
)
def _(spark, sf_dir):
    ratio = F.when(F.col("y_true") == 0, F.lit(float("inf"))).otherwise(safe_ratio(F.col("y_prob"), F.col("y_true")))
    return rounded(scored(spark, sf_dir).select("model", "id", finite(ratio).alias("ratio")))


@query("P28_safe_ratio", f"select l_orderkey, l_linenumber, l_partkey, {r('l_tax / nullif(l_discount, 0)')} as ratio from lineitem")
def _(spark, sf_dir):
    ratio = safe_ratio(F.col("l_tax"), F.col("l_discount"))
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ratio.alias("ratio")))


@query(
    "P30_feature_selection",
    sql(
        "prepared",
        """select * from (values ('id', 'numeric', null), ('key', 'text', (select count(distinct key) from prepared)),
             ('created', 'text', (select count(distinct created) from prepared)), ('resolutiondate', 'dropped', null),
             ('project_key', 'text', (select count(distinct project_key) from prepared)),
             ('project_name', 'text', (select count(distinct project_name) from prepared)),
             ('issuetype', 'text', (select count(distinct issuetype) from prepared)),
             ('priority', 'text', (select count(distinct priority) from prepared)),
             ('status', 'text', (select count(distinct status) from prepared)),
             ('summary', 'dropped', null), ('description', 'dropped', null), ('created_year', 'numeric', null),
             ('created_month', 'numeric', null), ('is_resolved', 'numeric', null), ('resolution_valid', 'numeric', null),
             ('time_to_resolution_days', 'dropped', null), ('summary_length', 'numeric', null),
             ('description_length', 'numeric', null), ('has_description', 'numeric', null),
             ('late_threshold_days', 'numeric', null), ('late_resolution', 'dropped', null)) t(c, k, d)""",
    ).replace(
        "select * from (values",
        """select c as "column", case when k <> 'text' then k when d <= 50 then 'categorical' else 'dropped' end as role,
                  d as distinct_count from (values""",
    ),
)
def _(spark, sf_dir):
    return features.feature_profile(prepared(spark, sf_dir)).drop("position")


@query(
    "P31_group_weights",
    sql(
        "labelled",
        f"""select id, {r("(select count(*) from labelled) * 1e0 / (k * c)")} as weight
            from labelled join g on g.p = coalesce(priority, '__NULL__'), (select count(*) as k from g)""",
        "g as (select coalesce(priority, '__NULL__') as p, count(*) as c from labelled group by 1)",
    ),
)
def _(spark, sf_dir):
    return rounded(mitigation.group_weights(labelled(spark, sf_dir), "priority").select("id", "weight"))


@query(
    "P32_group_class_weights",
    sql(
        "labelled",
        f"""select id, {r("(select count(*) from labelled) * 1e0 / (k * c)")} as weight
            from labelled join g on g.p = coalesce(priority, '__NULL__') and g.y = late_resolution,
                 (select count(*) as k from g)""",
        "g as (select coalesce(priority, '__NULL__') as p, late_resolution as y, count(*) as c from labelled group by 1, 2)",
    ),
)
def _(spark, sf_dir):
    return rounded(mitigation.group_class_weights(labelled(spark, sf_dir), "priority").select("id", "weight"))


@query(
    "P33_class_weights",
    sql(
        "labelled",
        f"""select id, {r("(select count(*) from labelled) / (2e0 * (select count(*) from labelled l where l.late_resolution = labelled.late_resolution))")}
                   as weight from labelled""",
    ),
)
def _(spark, sf_dir):
    return rounded(mitigation.class_weights(labelled(spark, sf_dir)).select("id", "weight"))


@query(
    "J10_model_threshold_defaults",
    sql(
        "scored",
        f"""select model, id, case model when 'logistic_regression' then {DEFAULT_THRESHOLDS["logistic_regression"]}e0
                   when 'random_forest' then {DEFAULT_THRESHOLDS["random_forest"]}e0 else 0.35e0 end as threshold from scored""",
    ),
)
def _(spark, sf_dir):
    from plumbline.operators.metrics import with_model_threshold

    tuned = spark.createDataFrame([("boosted", 0.35)], "model string, threshold double")
    return with_model_threshold(scored(spark, sf_dir), tuned).select("model", "id", "threshold")
