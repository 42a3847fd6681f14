"""The KPI mart over the reports of all nine analyses."""

from test_oracle import SMALL

from plumbline.operators import kpi
from plumbline.plans.queries_kpi import REPORTS, kpi_reports


def test_nine_reports_in_written_order(spark):
    reports = kpi_reports(spark, SMALL)
    assert [r.source for r in reports] == [r[0] for r in REPORTS] and len(reports) == 9
    long = kpi.kpi_long(reports).cache()
    assert {r.source_table for r in long.select("source_table").distinct().collect()} == {r[0] for r in REPORTS}
    # The cleaning report is written last, and its cleaned rows last in it.
    last = reports[-1].table.where("scenario = 'cleaned_rules'").first()
    latest = {r.metric: r.latest_value for r in kpi.kpi_snapshot(long).collect()}
    assert latest["f1"] == last.f1 and latest["ece"] == last.ece
    drift = reports[4].table.where("split_type = 'temporal_split'").first()
    assert latest["delta_vs_random_f1"] == drift.delta_vs_random_f1
    # Entries of the catalogue that only experiments fill.
    named = kpi.with_catalog(long.drop("ordinal")).where("family = 'Robustez'")
    assert {r.kpi for r in named.select("kpi").distinct().collect()} == {"delta_f1", "delta_ece"}


def test_missing_reports_are_skipped(spark):
    reports = kpi_reports(spark, SMALL)
    gone = ("data_cleaning_metrics", "temporal_drift_metrics")
    left = [kpi.ReportTable(r.source, None if r.source in gone else r.table, r.ids, r.order) for r in reports]
    long = kpi.kpi_long(left)
    assert long.where(long.source_table.isin(*gone)).count() == 0
    # Of the reports that are left, the degradation summary is the last one with a column f1.
    last = reports[3].table.where("scenario = 'positive_class_undersample_50'").first()
    assert {r.metric: r.latest_value for r in kpi.kpi_snapshot(long).collect()}["f1"] == last.f1
