"""Additive risk proxies, their levels and their distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import first_present, null_group, to_number
from plumbline.operators.prepare import TARGET
from plumbline.operators.quantiles import approx_quantiles, column_quantiles, quantiles

# The columns that each part of a proxy may come from, in order of preference.
EFFORT_PARTS = [
    ["time_to_resolution_days"],
    ["comments_count", "comment_count", "num_comments"],
    ["description_length"],
    ["changelog_count", "history_count", "num_status_changes"],
]
SCOPE_PARTS = [
    ["issuelinks_count", "issue_links_count", "num_links"],
    ["subtasks_count", "subtask_count", "num_subtasks"],
    ["components_count", "component_count", "num_components"],
    ["versions_count", "fix_versions_count", "affected_versions_count"],
    ["labels_count", "label_count", "num_labels"],
]
PROXIES = ["risk_time_proxy", "risk_effort_proxy_raw", "risk_scope_proxy_raw"]
LEVELLED = ["risk_effort_proxy_raw", "risk_scope_proxy_raw"]
RISK_GROUPS = ["project_key", "issuetype", "priority", "status", "created_year"]
GLOBAL = "__GLOBAL__"
LEAST_ROWS = 20


def with_proxies(df: DataFrame) -> DataFrame:
    time = to_number(F.col(TARGET)) if TARGET in df.columns else F.lit(None).cast("double")

    def total(parts):
        return sum((first_present(df, names) for names in parts), start=F.lit(0.0))

    return df.withColumns(
        {
            "risk_time_proxy": time,
            "risk_effort_proxy_raw": total(EFFORT_PARTS),
            "risk_scope_proxy_raw": total(SCOPE_PARTS),
        }
    )


def with_levels(df: DataFrame, columns: Sequence[str] = tuple(LEVELLED), strict: bool = False, approx: bool = False) -> DataFrame:
    """Level of each proxy: high from the 90th percentile on, medium from the 75th, else low.

    A proxy that is 0 everywhere is thus high everywhere; ``strict`` asks for values above
    the percentile instead.
    """
    limits = column_quantiles(df, columns, [0.75, 0.90], approx)
    by_column = limits.agg(F.map_from_entries(F.collect_list(F.struct("column", "quantiles"))).alias("m")).scalar()
    with_limits = df.withColumn("_limits", by_column)
    levels = {}
    for c in columns:
        q = F.try_element_at(F.col("_limits"), F.lit(c))
        high, medium = (F.col(c) > q[1], F.col(c) > q[0]) if strict else (F.col(c) >= q[1], F.col(c) >= q[0])
        levels[c.replace("_raw", "_level")] = F.when(high, "high").when(medium, "medium").otherwise("low")
    return with_limits.withColumns(levels).drop("_limits")


def proxy_summary(
    df: DataFrame, groups: Sequence[str] = (), min_rows: int = LEAST_ROWS, approx: bool = False
) -> DataFrame:
    """Mean, median, p75 and p90 of each proxy: for the whole table, or per value of each group column."""
    proxies = [p for p in PROXIES if p in df.columns]
    named = [g for g in groups if g in df.columns]
    if named:
        cells = [F.struct(F.lit(g).alias("f"), null_group(F.col(g)).alias("v")) for g in named]
        scope = "group"
    else:
        cells, scope = [F.struct(F.lit(GLOBAL).alias("f"), F.lit(GLOBAL).alias("v"))], "global"
    keyed = df.select(*proxies, F.inline(F.array(*cells)).alias("group_feature", "group_value"))
    keys = ["group_feature", "group_value", "metric"]
    long = keyed.unpivot(keys[:2], proxies, "metric", "value")
    stats = long.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg("value").alias("mean"))
    probs = [0.5, 0.75, 0.9]
    if approx:
        spread = approx_quantiles(long, keys, F.col("value"), probs)
    else:
        spread = quantiles(long, keys, F.col("value"), probs, few_keys=not named)
    if named:
        stats = stats.where(F.col("rows") >= min_rows)
    q = F.col("quantiles")
    return stats.join(spread, keys, "left").select(
        F.lit(scope).alias("scope"),
        *keys,
        "rows",
        "mean",
        q[0].alias("median"),
        q[1].alias("p75"),
        q[2].alias("p90"),
    )
