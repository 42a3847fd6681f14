import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions import grids
from plumbline.functions.scalars import finite, normalize_text, parse_utc, safe_ratio, status_of, to_number, uniform
from plumbline.operators import prepare


def column(spark, values, kind, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_words_for_missing(spark):
    values = [" Bug ", "", "  ", "NaN", "None", " n/a\t", "NULL", "na", "nab", None]
    assert column(spark, values, "string", normalize_text) == ["Bug"] + [None] * 7 + ["nab", None]


def test_timestamps_in_several_forms(spark):
    values = ["2021-01-02T03:04:05.123+0000", "2021-01-02 03:04:05+00:00", "2021-01-02T05:04:05+02:00", "2021-01-02", "garbage", None]
    got = column(spark, values, "string", lambda c: F.date_format(parse_utc(c), "yyyy-MM-dd HH:mm:ss.SSS"))
    assert got == ["2021-01-02 03:04:05.123"] + ["2021-01-02 03:04:05.000"] * 2 + ["2021-01-02 00:00:00.000", None, None]


def test_numbers(spark):
    assert column(spark, ["1.5", "x", "NaN", "-2", None], "string", to_number) == [1.5, None, None, -2.0, None]
    assert column(spark, [0.0, 4.0, None], "double", lambda c: safe_ratio(F.lit(2), c)) == [None, 0.5, None]
    assert column(spark, [1.0, float("inf"), float("-inf"), None], "double", finite) == [1.0, None, None, None]


def test_status_limits(spark):
    for metric, expected in [
        ("ece", ["green", "green", "amber", "amber", "red", "missing"]),
        ("f1", ["red", "red", "red", "red", "red", "missing"]),
    ]:
        values = [0.0, 0.05, 0.06, 0.15, 0.2, None]
        assert column(spark, values, "double", lambda c: status_of(F.lit(metric), c)) == expected
    assert column(spark, [0.75, 0.5, 0.49], "double", lambda c: status_of(F.lit("rows"), c)) == ["green", "amber", "red"]


def test_uniform_is_even_and_repeatable(spark):
    df = spark.range(20_000).select(uniform(F.col("id"), "a").alias("u"))
    stats = df.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(stats[0] - 0.5) < 0.01 and stats[1] >= 0 and stats[2] < 1
    again = spark.range(20_000).repartition(13).select(uniform(F.col("id"), "a").alias("u"))
    assert df.exceptAll(again).count() == 0


def test_grids():
    assert grids.SWEEP_THRESHOLDS[0] == 0.1 and grids.SWEEP_THRESHOLDS[-1] == 0.9 and len(grids.SWEEP_THRESHOLDS) == 17
    assert len(grids.MITIGATION_THRESHOLDS) == 18 and grids.MITIGATION_THRESHOLDS[-1] == 0.9
    assert grids.bin_edges(10)[3] == 0.30000000000000004 and grids.bin_edges(10)[10] == 1.0


@pytest.mark.parametrize(
    "edges,expected",
    [
        ("open0", [None, 1, 1, 3, 4, 10]),
        ("closed0", [1, 1, 1, 3, 4, 10]),
        ("left", [1, 1, 2, 3, 4, 10]),
    ],
)
def test_bin_edges_by_rule(spark, edges, expected):
    values = [0.0, 0.05, 0.1, 0.3, 0.30000000000000009, 1.0]
    assert column(spark, values, "double", lambda c: grids.calibration_bin(c, 10, edges)) == expected


def test_prepare_edge_rows(spark):
    t = dt.datetime
    rows = [
        (1, t(2020, 1, 1), t(2020, 1, 11), "a", "text"),
        (2, t(2020, 1, 2), t(2020, 1, 1), "b", None),
        (3, t(2020, 1, 3), None, None, ""),
        (4, None, t(2020, 1, 1), "d", "x"),
        (5, t(2020, 1, 5), t(2020, 1, 5), "e", "y"),
        (6, t(2020, 1, 5), t(2020, 1, 7), "e", "héé😀"),
    ]
    df = spark.createDataFrame(rows, "id long, created timestamp, resolutiondate timestamp, summary string, description string")
    got = {r.id: r for r in prepare.prepare(df).collect()}
    assert [got[i].resolution_valid for i in range(1, 7)] == [1, 0, 0, 0, 1, 1]
    assert [got[i].is_resolved for i in range(1, 7)] == [1, 1, 0, 1, 1, 1]
    assert [got[i].time_to_resolution_days for i in range(1, 7)] == [10.0, None, None, None, 0.0, 2.0]
    assert got[1].late_threshold_days == 6.0
    assert [got[i].late_resolution for i in range(1, 7)] == [1, None, None, None, 0, 0]
    assert [got[i].description_length for i in range(1, 7)] == [4, 0, 0, 1, 1, 4]
    assert [got[i].has_description for i in (1, 2, 3)] == [1, 0, 0]


def test_label_needs_valid_durations(spark):
    df = spark.createDataFrame([(None,)], "time_to_resolution_days double")
    for options in ({}, {"method": "fixed_days"}):
        with pytest.raises(Exception, match="no valid durations"):
            prepare.with_label(df, prepare.label_threshold(df, **options)).collect()
    with pytest.raises(ValueError):
        prepare.label_threshold(df, method="other")
