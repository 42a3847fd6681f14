"""Registered queries over the ways that only large tables take, forced here on tables of any size.

No group fits one window (``plumbline.windowRows`` is 0), no slice is small enough to be sorted, and
the order is that of one day's rows by text ids.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import selection
from plumbline.plans import queries_change, queries_metrics, queries_scalar, queries_tables  # noqa: F401
from plumbline.plans.queries_change import PERIODS, TEMPORAL, dated_rows, stratified_split_sql
from plumbline.plans.registry import QUERIES, SQL, query
from plumbline.plans.views import labelled, sql


def in_slices(run):
    def forced(spark, sf_dir):
        spark.conf.set("plumbline.windowRows", "0")
        try:
            return run(spark, sf_dir)
        finally:
            spark.conf.unset("plumbline.windowRows")

    return forced


for _name in (
    "M08_average_precision",
    "M09_roc_auc",
    "M15_subgroup_metrics",
    "P12_percentile_threshold",
    "A08_group_proxy_summary",
    "D01_stability_index",
):
    _id, _, _rest = _name.partition("_")
    query(f"{_id}b_{_rest}_in_slices", SQL[_name])(in_slices(QUERIES[_name]))


def one_day(spark, sf_dir):
    named = F.concat(F.lit("ISSUE-"), F.col("id").cast("string"))
    return dated_rows(spark, sf_dir).withColumn("id", named).withColumn("created", F.lit("2020-01-01").cast("timestamp"))


_ONE_DAY = """one_day as (select * replace ('ISSUE-' || id as id, timestamp '2020-01-01' as created) from labelled
  where created is not null)"""


@query(
    "D04b_temporal_split_of_ties",
    sql("labelled", "select id, split from temporal", _ONE_DAY, TEMPORAL.replace("from labelled", "from one_day")),
)
def _(spark, sf_dir):
    df = one_day(spark, sf_dir)
    train = selection.temporal_train(df, sort_at_most=0)
    return df.select("id", F.when(train, "train").otherwise("test").alias("split"))


@query(
    "D05b_time_bins_of_ties",
    sql("labelled", "select id, period, time_bin from periods", _ONE_DAY, PERIODS.replace("from labelled", "from one_day")),
)
def _(spark, sf_dir):
    return selection.with_time_bins(one_day(spark, sf_dir), sort_at_most=0).select("id", "period", "time_bin")


_CELLS = """cells as (
  select * from (select *, project_key || '/' || issuetype || '/' || cast(created_year as varchar) as cell from labelled)
  where cell is not null)"""


@query(
    "D06b_stratified_split_of_many_classes",
    sql("labelled", "select id, cell, split from s", _CELLS, stratified_split_sql("s", "cells", label="cell")),
)
def _(spark, sf_dir):
    cell = F.concat("project_key", F.lit("/"), "issuetype", F.lit("/"), F.col("created_year").cast("string"))
    cells = labelled(spark, sf_dir).withColumn("cell", cell).where("cell is not null")
    return selection.stratified_split(cells, "cell").select("id", "cell", "split")
