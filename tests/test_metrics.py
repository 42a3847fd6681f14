import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import gaps, metrics, mitigation


def brute(pairs, threshold):
    """Metrics of (label, score) pairs straight from their definitions."""
    pos, n = sum(y for y, _ in pairs), len(pairs)
    neg = n - pos
    ap, before = 0.0, 0.0
    for s in sorted({p for _, p in pairs}, reverse=True):
        tp = sum(y for y, p in pairs if p >= s)
        count = sum(1 for _, p in pairs if p >= s)
        recall = tp / pos if pos else 0.0
        ap += (recall - before) * tp / count
        before = recall
    wins = sum((a > b) + 0.5 * (a == b) for y, a in pairs if y for z, b in pairs if not z)
    return {
        "rows": n,
        "true_positive": sum(1 for y, p in pairs if y and p >= threshold),
        "false_positive": sum(1 for y, p in pairs if not y and p >= threshold),
        "pr_auc": ap,
        "roc_auc": wins / (pos * neg) if pos and neg else None,
        "brier_score": sum((p - y) ** 2 for y, p in pairs) / n,
    }


def scored(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        g = "hot" if i % 3 else rnd.choice(["a", "b"])
        y = int(rnd.random() < 0.4)
        rows.append((g, y, rnd.choice([round(rnd.random(), 2), 0.3, 0.999999999, 0.999999998])))
    rows += [("ones", 1, 0.2), ("ones", 1, 0.7), ("zeros", 0, 0.0), ("zeros", 0, 1.0), ("tied", 0, 0.5), ("tied", 1, 0.5)]
    return rows, spark.createDataFrame(rows, "g string, y_true int, y_prob double")


@pytest.mark.parametrize("window_rows", [10_000, 100, 0])
def test_metrics_match_brute_force(spark, window_rows):
    rows, df = scored(spark)
    got = {r.g: r.asDict() for r in metrics.evaluate(df, ["g"], 0.3, window_rows=window_rows).collect()}
    assert set(got) == {r[0] for r in rows}
    for g, row in got.items():
        for name, value in brute([(y, p) for k, y, p in rows if k == g], 0.3).items():
            assert row[name] == (pytest.approx(value, abs=1e-12) if value is not None else None), (g, name)
    whole = metrics.evaluate(df, [], 0.3, window_rows=window_rows).first().asDict()
    for name, value in brute([(y, p) for _, y, p in rows], 0.3).items():
        assert whole[name] == pytest.approx(value, abs=1e-12), name


def test_partitioning_does_not_matter(spark):
    _, df = scored(spark)
    one, many = [metrics.evaluate(df.repartition(n), ["g"]).orderBy("g").collect() for n in (1, 16)]
    for a, b in zip(one, many):
        assert list(a[1:]) == pytest.approx(list(b[1:]), abs=1e-12, nan_ok=True)


def test_one_class_and_undefined(spark):
    _, df = scored(spark)
    got = {r.g: r for r in metrics.evaluate(df, ["g"], 1.5).collect()}
    assert got["ones"].precision == 0 and got["ones"].recall == 0 and got["ones"].f1 == 0
    assert got["ones"].false_positive_rate is None and got["ones"].roc_auc is None
    assert got["zeros"].pr_auc == 0 and got["zeros"].balanced_accuracy == 1.0
    strict = {r.g: r for r in metrics.evaluate(df, ["g"], one_class_ap=None).collect()}
    assert strict["ones"].pr_auc is None and strict["tied"].pr_auc == 0.5


def test_known_confusion_counts(spark):
    counts = spark.createDataFrame(
        [(312, 927, 479, 157)], "true_positive long, true_negative long, false_positive long, false_negative long"
    )
    row = metrics.with_confusion_ratios(counts).first()
    assert row.precision == pytest.approx(0.3944374209860936)
    assert row.recall == pytest.approx(0.6652452025586354)
    assert row.f1 == pytest.approx(0.49523809523809526)
    assert row.negative_predictive_value == pytest.approx(0.8551660516605166)
    assert row.balanced_accuracy == pytest.approx(0.6622812072537132)


def test_calibration_table_keeps_empty_bins(spark):
    df = spark.createDataFrame([("m", 0, 0.0), ("m", 1, 0.1), ("m", 1, 1.0)], "model string, y_true int, y_prob double")
    rows = metrics.calibration_table(df, ["model"]).orderBy("bin").collect()
    assert [r.rows for r in rows] == [2] + [0] * 8 + [1]
    assert rows[0].observed_positive_rate == 0.5 and rows[1].calibration_gap is None
    assert sum(r.bin_weight for r in rows) == pytest.approx(1.0)


def test_calibration_error_conventions(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.1), (1, 0.95)], "y_true int, y_prob double")
    got = {e: metrics.expected_calibration_error(df, [], edges=e).first().ece for e in ("open0", "closed0", "left")}
    assert got["open0"] == pytest.approx((0.1 + 0.05) / 3)
    assert got["closed0"] == pytest.approx((0.9 + 0.05) / 3)
    assert got["left"] == pytest.approx((1 + 0.1 + 0.05) / 3)


def test_sweep_equals_separate_scans(spark):
    _, df = scored(spark)
    sweep = {r.threshold: r for r in metrics.threshold_counts(df, []).collect()}
    for t in metrics.SWEEP_THRESHOLDS:
        one = metrics.confusion_counts(df, [], (F.col("y_prob") >= t).cast("int")).first()
        assert (sweep[t].true_positive, sweep[t].false_positive) == (one.true_positive, one.false_positive)


def test_best_f1_takes_lowest_threshold_on_ties(spark):
    rows = [("m", 0.1, 0.9, 0.5), ("m", 0.2, 0.7, 0.6), ("m", 0.3, 0.65, 0.6), ("m", 0.4, 0.2, 0.7)]
    df = spark.createDataFrame(rows, "model string, threshold double, recall double, f1 double")
    assert metrics.best_by_f1(df).first().threshold == 0.4
    assert metrics.best_by_f1(df, min_recall=0.6).first().threshold == 0.2
    assert metrics.first_best_by_f1(df, min_recall=0.6).first().threshold == 0.2


def test_group_threshold_is_the_highest_with_the_recall(spark):
    rows = [("a", int(i % 2), 0.5 if i % 2 else 0.1) for i in range(40)] + [("small", 1, 0.9), ("b", 0, 0.4)]
    rows += [("b", 0, 0.2)] * 40
    df = spark.createDataFrame(rows, "g string, y_true int, y_prob double")
    got = {r.group_value: r.threshold for r in mitigation.group_thresholds(df, "g").collect()}
    assert got["a"] == pytest.approx(0.5) and got["small"] == 0.25 and got["b"] == 0.25


def test_weights_sum_to_rows(spark):
    df = spark.range(300).select(
        "id",
        F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").alias("g"),
        (F.col("id") % 4 == 0).cast("int").alias("late_resolution"),
    )
    for weighted in (
        mitigation.group_weights(df, "g"),
        mitigation.group_class_weights(df, "g"),
        mitigation.class_weights(df),
    ):
        assert weighted.count() == 300
        assert weighted.agg(F.sum("weight")).first()[0] == pytest.approx(300)
    per_group = mitigation.group_weights(df, "g").groupBy("g").agg(F.sum("weight").alias("w")).collect()
    assert [r.w for r in per_group] == pytest.approx([100.0] * 3)


def test_fairness_extremes_and_ties(spark):
    rows = [("m", "f", "b", 40, 0.2), ("m", "f", "a", 40, 0.2), ("m", "f", "c", 40, 0.8), ("m", "f", "d", 40, 0.8), ("m", "f", "e", 5, 0.0), ("m", "f", "n", 40, None)]
    df = spark.createDataFrame(rows, "model string, group_feature string, group_value string, rows long, ece double")
    row = gaps.fairness_disparity(df, ["ece"]).first()
    assert (row.worst_group, row.best_group, row.groups_considered) == ("a", "c", 5)
    assert row.min_max_ratio == pytest.approx(0.25)
    flipped = gaps.fairness_disparity(df, ["ece"], lower_is_better=["ece"]).first()
    assert (flipped.worst_group, flipped.best_group) == ("c", "a")


def test_seed_spread_of_known_values(spark):
    df = spark.createDataFrame([(0.5,), (0.7,)], "f1 double")
    row = gaps.seed_spread(df, ["f1"]).first()
    assert row["range"] == pytest.approx(0.2) and row["std"] == pytest.approx(0.1414213562373095)
    zero = gaps.seed_spread(spark.createDataFrame([(1.0,), (-1.0,)], "f1 double"), ["f1"]).first()
    assert zero.coefficient_of_variation is None


def test_latest_kpi_is_the_one_written_last(spark):
    """Not the one whose name sorts last."""
    from plumbline.operators import kpi

    rows = [("prepared_original", 0, 0.5209), ("cleaned_rules", 1, 0.5356)]
    table = spark.createDataFrame(rows, "scenario string, written int, f1 double")
    long = kpi.kpi_long([kpi.ReportTable("data_cleaning_metrics", table, ["scenario"], ["written"])])
    assert [(r.metric, r.latest_value) for r in kpi.kpi_snapshot(long).collect()] == [("f1", 0.5356)]
    with pytest.raises(ValueError):
        kpi.kpi_long([kpi.ReportTable("data_cleaning_metrics", table, ["scenario"])])


def grouped_rows(n=900):
    rnd = random.Random(11)
    for i in range(n):
        yield (
            "m1" if i % 2 else "m2",
            rnd.choice(["a", "a", "a", "b", None]),
            rnd.randrange(4),
            rnd.choice([0, 1, 1]),
            rnd.choice([0.25, 0.5, 0.75, None]) if i % 9 else rnd.random(),
        )


GROUPED = "model string, g string, h int, y_true int, y_prob double"


@pytest.mark.parametrize("window_rows", [None, 0, 100])
def test_subgroups_equal_one_column_at_a_time(spark, window_rows):
    df = spark.createDataFrame([r for r in grouped_rows() if r[4] is not None], GROUPED)
    got = metrics.subgroup_metrics(df, ["g", "h", "absent"], min_rows=0, window_rows=window_rows)
    rows = {(r.model, r.subgroup_feature, r.subgroup_value): r for r in got.collect()}
    seen = 0
    for feature in ("g", "h"):
        value = F.coalesce(F.col(feature).cast("string"), F.lit("__NULL__")).alias("v")
        alone = metrics.evaluate(df.select("model", value, "y_true", "y_prob"), ["model", "v"], 0.5)
        for r in alone.collect():
            same = rows[(r.model, feature, r.v)]
            seen += 1
            for name in metrics.METRIC_COLUMNS:
                assert same[name] == pytest.approx(r[name], rel=1e-9, abs=1e-12), (feature, r.v, name)
    assert seen == len(rows)


def test_cells_are_spread_and_not_rows(spark):
    """The counts of a coarse table are few before they are spread; sums and nulls are kept."""
    df = spark.createDataFrame([r for r in grouped_rows(3000) if r[4] in (0.25, 0.5, 0.75)], GROUPED)
    counts = metrics.subgroup_counts(df, ["g", "h"], ["model"])
    for feature in ("g", "h"):
        part = counts.where(F.col("subgroup_feature") == feature).agg(F.sum("_pos"), F.sum("_neg")).first()
        assert tuple(part) == tuple(df.agg(F.sum("y_true"), F.sum(1 - F.col("y_true"))).first())
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate") :]
    assert "Aggregate" in below and plan.count("Aggregate") == 2
    cells = df.select("model", "g", "h", "y_prob").distinct().count()
    assert cells <= 2 * 3 * 4 * 3 < df.count() / 7
    assert metrics.subgroup_counts(df.limit(0), ["g", "h"], ["model"]).count() == 0
