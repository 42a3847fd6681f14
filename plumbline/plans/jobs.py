"""The composite analyses. Each takes tables and returns its reports as DataFrames.

Jobs that need a classifier take a *scorer*: a callable ``scorer(train, test, run, name)``
that returns the test rows with ``y_true``, ``y_prob`` and the run's name in column ``name``.
``ForestScorer`` and ``zoo_scorers`` fit models; a formula will do for checks. Fits of one job run side by side. Scored
rows are written once, so that no report fits or applies a model a second time, and so is a
report from which others are derived.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grids import TUNED_THRESHOLD
from plumbline.functions.scalars import null_group
from plumbline.operators import drift, gaps, kpi, metrics, mitigation, models, perturb, prepare, profile, risk, selection
from plumbline.operators.metrics import QUALITY_METRICS
from plumbline.operators.prepare import CATEGORICAL_FEATURES, NUMERIC_FEATURES, SUBGROUP_FEATURES, TARGET
from plumbline.session import side_by_side, stage

Reports = dict[str, DataFrame]
Scorer = Callable[[DataFrame, DataFrame, str, str], DataFrame]

# Default grouping columns, smallest groups, seeds.
FAIRNESS_GROUPS = ["project_key", "issuetype", "priority", "status", "has_description", "created_year", "created_month"]
FAIRNESS_ROWS, BIAS_ROWS, SUBGROUP_ROWS = 10, 20, 30
SEEDS = list(range(42, 52))
FREE_TEXT = ["summary", "description"]
LONG_TEXT = ["description"]
# Names of reported metrics.
EVALUATED = ["rows", "positive_rate_true", "positive_rate_predicted", *QUALITY_METRICS]
SHORT = {"false_positive_rate": "fpr", "false_negative_rate": "fnr"}
FAIRNESS_SHORT = {
    **SHORT,
    "true_positive": "tp",
    "true_negative": "tn",
    "false_positive": "fp",
    "false_negative": "fn",
}
BIAS_METRICS = [
    "rows",
    "positive_rate_true",
    "positive_rate_predicted",
    "precision",
    "recall",
    "f1",
    "fpr",
    "fnr",
    "pr_auc",
    "roc_auc",
    "brier_score",
    "ece",
]


@dataclass
class ForestScorer:
    """Fits features and a forest on the training rows and scores the test rows."""

    categorical: Sequence[str] = tuple(CATEGORICAL_FEATURES)
    numeric: Sequence[str] = tuple(NUMERIC_FEATURES)
    trees: int = models.FOREST_TREES
    least_leaf: int = 1
    max_depth: int = models.DEEPEST
    balanced: bool = True
    weighted: bool = False
    seed: int = 42
    keep: Sequence[str] = field(default_factory=lambda: ["id", "key", "created", *FAIRNESS_GROUPS, "world_id"])

    def __call__(self, train: DataFrame, test: DataFrame, run: str, name: str = "model") -> DataFrame:
        forest = models.random_forest(
            self.trees, self.seed, self.least_leaf, self.balanced or self.weighted, self.max_depth
        )
        return models.fit_and_score(
            train, test, self.categorical, self.numeric, forest, self.keep, run, name, balanced=self.balanced
        )


@dataclass
class EstimatorScorer:
    """The same for any estimator factory."""

    factory: Callable
    categorical: Sequence[str]
    numeric: Sequence[str]
    balanced: bool = False
    keep: Sequence[str] = field(default_factory=lambda: ["id", "key", "created", *FAIRNESS_GROUPS])

    def __call__(self, train: DataFrame, test: DataFrame, run: str, name: str = "model") -> DataFrame:
        return models.fit_and_score(
            train, test, self.categorical, self.numeric, self.factory, self.keep, run, name, balanced=self.balanced
        )


def zoo_scorers(df: DataFrame, train_rows: int, **sizes) -> dict[str, Scorer]:
    """One scorer per model of the comparison, on the automatically selected features."""
    from plumbline.operators.features import select_features

    numeric, categorical = select_features(df)
    zoo = models.model_zoo(train_rows, **sizes)
    return {n: EstimatorScorer(f, categorical, numeric, balanced) for n, (f, balanced) in zoo.items()}


def score_all(df: DataFrame, runs: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """The scored rows of several fits, which run side by side, written once."""
    return stage(union_all(side_by_side(df.sparkSession, runs)), "scored")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def narrow(df: DataFrame) -> DataFrame:
    """Without free text, of which the models only use the length."""
    return df.drop(*FREE_TEXT)


def with_texts(df: DataFrame, source: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows with the texts of ``source`` in columns that hold their digests. Each text is moved once per task."""
    found = df
    for c in columns:
        texts = source.select(F.md5(c).alias("_digest"), F.col(c).alias("_text")).where(F.col("_text").isNotNull())
        found = found.withColumnRenamed(c, "_digest").join(texts.dropDuplicates(["_digest"]), "_digest", "left")
        found = found.withColumnRenamed("_text", c).drop("_digest")
    return found.select(*df.columns)


def split_labelled(df: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """The labelled rows with their side of a stratified split, written by side.

    A fit reads its training rows many times; written, they are one pruned partition.
    """
    rows = narrow(prepare.labelled_rows(df))
    return stage(selection.stratified_split(rows, TARGET, test_size, seed=seed), "split", partition_by=["split"])


def halves(split: DataFrame, column: str = "split") -> tuple[DataFrame, DataFrame]:
    side = F.col(column)
    return split.where(side == "train").drop(column), split.where(side == "test").drop(column)


# ---------------------------------------------------------------- data reports


def prepare_dataset(flat: DataFrame, path: str | None = None, **label_options) -> DataFrame:
    """Flat issue records to the prepared table, written to ``path`` if given."""
    ready = prepare.prepare(flat, **label_options)
    if path is None:
        return ready
    ready.write.mode("overwrite").parquet(path)
    return flat.sparkSession.read.schema(ready.schema).parquet(path)


def quality_report(df: DataFrame, approx: bool = False) -> Reports:
    return {
        "data_quality_summary": profile.quality_summary(df, approx),
        "category_distributions": profile.category_distribution(
            df, ["project_key", "issuetype", "priority", "status", TARGET]
        ),
        "time_distribution": profile.time_distribution(df),
    }


def risk_report(df: DataFrame, approx: bool = False) -> Reports:
    proxies = risk.with_proxies(df)
    return {
        "project_risk_proxy_dataset": risk.with_levels(proxies, approx=approx),
        "project_risk_proxy_summary": risk.proxy_summary(proxies, approx=approx),
        "project_risk_proxy_by_group": risk.proxy_summary(proxies, risk.RISK_GROUPS, approx=approx),
    }


def kpi_export(reports: Sequence[kpi.ReportTable]) -> Reports:
    """Long KPI table, snapshot and catalogue from whatever reports exist."""
    long = kpi.kpi_long(reports)
    return {
        "performance_kpis_long": long.drop("ordinal"),
        "kpi_snapshot": kpi.kpi_snapshot(long),
        "kpi_catalog": kpi.kpi_catalog(long.sparkSession),
    }


# ---------------------------------------------------------------- reports on one scored table


def baseline(df: DataFrame, scorers: Mapping[str, Scorer], threshold: float = 0.5) -> Reports:
    """Fit each model, then global metrics, subgroup metrics and calibration."""
    train, test = halves(split_labelled(df))
    scored = score_all(df, [partial(s, train, test, name, "model") for name, s in scorers.items()])
    return {"scored": scored, **baseline_reports(scored, threshold)}


def baseline_reports(scored: DataFrame, threshold: float = 0.5) -> Reports:
    columns = ["rows", "positive_rate", *QUALITY_METRICS]
    overall = metrics.evaluate(scored, ["model"], threshold, "open0")
    groups = metrics.subgroup_metrics(
        scored, SUBGROUP_FEATURES, threshold=threshold, min_rows=SUBGROUP_ROWS, edges="open0"
    )
    overall = overall.withColumnRenamed("positive_rate_true", "positive_rate").select("model", *columns)
    overall = stage(overall, "model_metrics")
    groups = groups.withColumnRenamed("positive_rate_true", "positive_rate")
    return {
        "model_metrics": overall,
        "subgroup_metrics": groups.select("model", "subgroup_feature", "subgroup_value", *columns[:-1]),
        "calibration_summary": overall.select("model", "brier_score", "ece"),
    }


def threshold_tuning(scored: DataFrame, min_recall: float = 0.60) -> Reports:
    sweep = stage(metrics.threshold_sweep(scored), "threshold_metrics")
    return {
        "threshold_metrics": sweep,
        "threshold_best_f1": metrics.best_by_f1(sweep),
        "threshold_recall_60_minimum": metrics.best_by_f1(sweep, min_recall=min_recall),
    }


def advanced_metrics(scored: DataFrame, tuned: DataFrame | None = None, bins: int = 10) -> Reports:
    with_threshold = metrics.with_model_threshold(scored, tuned)
    return {
        "advanced_model_metrics": metrics.evaluate(with_threshold, ["model", "threshold"], F.col("threshold")),
        "calibration_bins": metrics.calibration_table(scored, ["model"], bins),
        "prediction_audit": metrics.prediction_audit(with_threshold),
    }


def subgroup_gap_analysis(subgroups: DataFrame, overall: DataFrame, min_rows: int = SUBGROUP_ROWS) -> Reports:
    found = stage(gaps.subgroup_gaps(subgroups, overall, min_rows=min_rows), "subgroup_gap_metrics")
    return {"subgroup_gap_metrics": found, "subgroup_gap_summary": gaps.gap_summary(found)}


# ---------------------------------------------------------------- experiments


def degradation_experiment(
    df: DataFrame,
    scorer: Scorer,
    scenarios: Sequence[tuple] = tuple(perturb.DEGRADATION_SCENARIOS),
    texts: Mapping[str, str] = perturb.SCENARIO_TEXTS,
) -> Reports:
    """Train and evaluate on each damaged copy, against the undamaged one.

    Scenarios of one's own come with a text for each name.
    """
    split = split_labelled(df)

    def run(scenario: tuple) -> DataFrame:
        train, test = halves(perturb.degradation_scenarios(split, [scenario]).drop("scenario"))
        return scorer(train, test, scenario[0], "scenario")

    scored = score_all(df, [partial(run, s) for s in scenarios])
    found = metrics.evaluate(scored, ["scenario"], TUNED_THRESHOLD, "open0")
    damaged = perturb.degradation_scenarios(split, scenarios)
    side, label = F.col("split"), F.col(TARGET)
    sizes = damaged.groupBy("scenario", "degradation_type", "degradation_rate").agg(
        F.count_if(side == "train").alias("train_rows"),
        F.count_if(side == "test").alias("test_rows"),
        F.avg(F.when(side == "train", label)).alias("train_positive_rate"),
        F.avg(F.when(side == "test", label)).alias("test_positive_rate"),
    )
    report = sizes.join(found.select("scenario", "positive_rate_predicted", *QUALITY_METRICS), "scenario")
    report = report.withColumn("threshold", F.lit(TUNED_THRESHOLD)).withColumn(
        "description", perturb.scenario_text(F.col("scenario"), texts)
    )
    report = gaps.deltas_to_run(stage(report, "degradation"), F.col("scenario") == "baseline")
    summary = ["scenario", "degradation_type", "degradation_rate", *QUALITY_METRICS, "delta_f1", "delta_recall", "delta_ece"]
    return {"degradation_experiments": report, "degradation_summary": report.select(*summary)}


def cleaning_experiment(df: DataFrame, scorer: Scorer) -> Reports:
    """Data quality and model quality before and after cleaning.

    The cleaning steps move rows with digests in place of their descriptions, which no step looks into.
    """
    columns = df.columns
    long = [c for c in LONG_TEXT if dict(df.dtypes).get(c) == "string"]
    before = stage(df.withColumns({c: F.md5(c) for c in long}), "original") if long else df
    after = stage(profile.clean(before, CATEGORICAL_FEATURES, NUMERIC_FEATURES), "cleaned")
    names = {"prepared_original": before, "cleaned_rules": after}
    snapshots = [profile.quality_snapshot(t.select(*columns), n) for n, t in names.items()]
    scored = score_all(df, [partial(lambda n, t: scorer(*halves(split_labelled(t)), n, "scenario"), n, t) for n, t in names.items()])
    shown = [*QUALITY_METRICS[:3], "balanced_accuracy", *QUALITY_METRICS[3:]]
    found = metrics.evaluate(scored, ["scenario"], TUNED_THRESHOLD, "closed0")
    found = stage(found.select("scenario", "rows", "positive_rate_true", "positive_rate_predicted", *shown), "cleaning")
    compared = gaps.deltas_to_run(found, F.col("scenario") == "prepared_original", shown, "delta_{}_vs_original")
    return {
        "cleaned": with_texts(after, df, long),
        "data_cleaning_quality_comparison": union_all(snapshots),
        "data_cleaning_actions": profile.cleaning_actions(before, after),
        "data_cleaning_metrics": compared.withColumn("threshold", F.lit(TUNED_THRESHOLD)),
    }


def temporal_drift(df: DataFrame, scorer: Scorer, test_fraction: float = 0.2) -> Reports:
    """A random and a temporal split of the same rows, and what shifts over the temporal one."""
    rows = narrow(prepare.labelled_rows(df, ["created"]))
    in_test = selection.stratified_test(rows, TARGET, test_fraction)
    in_train = selection.temporal_train(rows, test_fraction)
    both = rows.withColumns(
        {
            "random_split": F.when(in_test, "test").otherwise("train"),
            "temporal_split": F.when(in_train, "train").otherwise("test"),
        }
    )
    both = stage(both, "splits")
    random, temporal = [
        both.withColumn("split", F.col(name)).drop("random_split", "temporal_split")
        for name in ("random_split", "temporal_split")
    ]
    splits = {"random_split": random, "temporal_split": temporal}
    scored = score_all(df, [partial(scorer, *halves(split), name, "split_type") for name, split in splits.items()])
    ranges = union_all(
        [_ranges(split).withColumn("split_type", F.lit(name)) for name, split in splits.items()]
    )
    found = metrics.evaluate(scored, ["split_type"], TUNED_THRESHOLD, "open0").select("split_type", *EVALUATED)
    report = gaps.deltas_to_run(
        stage(found.join(ranges, "split_type"), "drift"), F.col("split_type") == "random_split", pattern="delta_vs_random_{}"
    )
    periods = drift.period_summary(
        temporal.withColumn("split", F.concat(F.lit("temporal_"), F.col("split"))), "split"
    )
    return {
        "temporal_drift_metrics": report.withColumn("threshold", F.lit(TUNED_THRESHOLD)),
        "temporal_numeric_shift": drift.numeric_shift(temporal, [*NUMERIC_FEATURES, TARGET]),
        "temporal_categorical_shift": drift.category_shift(temporal, CATEGORICAL_FEATURES),
        "temporal_period_summary": periods,
    }


def _ranges(split: DataFrame) -> DataFrame:
    cells = []
    for side in ("train", "test"):
        mine = F.col("split") == side
        cells += [
            F.count_if(mine).alias(f"{side}_rows"),
            F.min(F.when(mine, F.col("created"))).alias(f"{side}_start"),
            F.max(F.when(mine, F.col("created"))).alias(f"{side}_end"),
        ]
    return split.agg(*cells)


def retraining(df: DataFrame, scorer: Scorer, periods: int = 5) -> Reports:
    """Static, cumulative and sliding training windows, each tested on the later periods."""
    rows = narrow(prepare.labelled_rows(df, ["created"]))
    windows = drift.training_windows(periods)
    binned = stage(selection.with_time_bins(rows, periods), "periods", partition_by=["period"])

    def run(strategy: str, test: int, first: int, last: int) -> DataFrame:
        train = binned.where(F.col("period").between(first, last))
        part = scorer(train, binned.where(F.col("period") == test), strategy, "strategy")
        return part.withColumn("test_period", F.lit(f"period_{test}"))

    scored = score_all(df, [partial(run, *w) for w in windows])
    found = metrics.evaluate(scored, ["strategy", "test_period"], TUNED_THRESHOLD, "open0")
    trained = drift.training_rows(binned, windows).groupBy("strategy", "test_period").agg(
        F.count("*").alias("train_rows"),
        F.min("created").alias("train_start"),
        F.max("created").alias("train_end"),
        F.avg(TARGET).alias("train_positive_rate"),
    )
    trained = trained.withColumn("test_period", F.concat(F.lit("period_"), F.col("test_period")))
    summary = drift.period_summary(binned, "time_bin")
    tested = summary.select(
        F.col("time_bin").alias("test_period"),
        F.col("rows").alias("test_rows"),
        F.col("start").alias("test_start"),
        F.col("end").alias("test_end"),
        F.col("positive_rate").alias("test_positive_rate"),
    )
    report = found.select("strategy", "test_period", *EVALUATED)
    report = stage(report.join(trained, ["strategy", "test_period"]).join(tested, "test_period"), "retraining")
    compared = gaps.versus_static(report).withColumn("threshold", F.lit(TUNED_THRESHOLD))
    return {
        "retraining_period_summary": summary,
        "retraining_metrics": compared,
        "retraining_summary": gaps.strategy_summary(report),
    }


def stability(df: DataFrame, scorer_for: Callable[[int], Scorer], seeds: Sequence[int] = tuple(SEEDS)) -> Reports:
    """The same model on differently seeded splits."""
    rows = narrow(prepare.labelled_rows(df))
    tests = selection.stratified_tests(rows, TARGET, seeds)
    sides = {f"_split{seed}": test for seed, test in zip(seeds, tests)}
    split = stage(rows.withColumns({n: F.when(t, "test").otherwise("train") for n, t in sides.items()}), "splits")

    def run(seed: int) -> DataFrame:
        train, test = halves(split, f"_split{seed}")
        return scorer_for(seed)(train.drop(*sides), test.drop(*sides), str(seed), "seed")

    scored = score_all(df, [partial(run, seed) for seed in seeds]).withColumn("seed", F.col("seed").cast("int"))
    found = metrics.evaluate(scored, ["seed"], TUNED_THRESHOLD, "closed0").select("seed", *EVALUATED)
    found = stage(found, "stability")
    return {
        "stability_seed_metrics": found.withColumn("threshold", F.lit(TUNED_THRESHOLD)),
        "stability_seed_summary": gaps.seed_spread(found),
    }


def possible_worlds(df: DataFrame, scorer: Scorer, worlds: int = 20, sample_size: int = 1000) -> Reports:
    """How much predictions move when missing values are filled in differently."""
    train, test = halves(split_labelled(df))
    sample = stage(perturb.world_sample(test, sample_size), "sample")
    copies = perturb.possible_worlds(sample, train, CATEGORICAL_FEATURES, NUMERIC_FEATURES, worlds)
    asked = sample.withColumn("world_id", F.lit(0)).unionByName(copies)
    scored = stage(scorer(train, asked, "forest", "model").select("id", "world_id", "y_prob"), "worlds")
    baseline_rows = scored.where("world_id = 0").select("id", F.col("y_prob").alias("baseline_probability"))
    predictions = scored.where("world_id > 0").withColumnRenamed("y_prob", "predicted_probability")
    spread = stage(perturb.world_spread(predictions, baseline_rows, most_worlds=worlds), "sensitivity")
    return {
        "possible_worlds_predictions": predictions,
        "possible_worlds_sensitivity_summary": spread,
        "possible_worlds_sensitivity_aggregate": perturb.world_sensitivity(spread, worlds),
    }


def fairness_audit(
    df: DataFrame,
    scorers: Mapping[str, Scorer] | Callable[[DataFrame, int], Mapping[str, Scorer]],
    groups: Sequence[str] = tuple(FAIRNESS_GROUPS),
    threshold: float = TUNED_THRESHOLD,
    sample: int = 0,
) -> Reports:
    """Several models on one split: global and group metrics, and disparities between groups."""
    named = [g for g in groups if g in df.columns]
    if not named:
        raise ValueError("the table has none of the grouping columns")
    rows = prepare.labelled_rows(df)
    train, test = halves(split_labelled(selection.sample_rows(rows, sample) if sample else rows))
    if callable(scorers):
        scorers = scorers(train, train.count())
    scored = score_all(df, [partial(s, train, test, name, "model") for name, s in scorers.items()])
    whole = metrics.evaluate(scored, ["model"], threshold, "left").withColumnsRenamed(FAIRNESS_SHORT)
    parts = metrics.subgroup_metrics(scored, named, threshold=threshold, min_rows=FAIRNESS_ROWS, edges="left")
    parts = parts.withColumnsRenamed(
        {**FAIRNESS_SHORT, "subgroup_feature": "group_feature", "subgroup_value": "group_value"}
    )
    parts = stage(parts.withColumn("threshold", F.lit(threshold)), "group_metrics")
    return {
        "bias_fairness_global_metrics": whole.withColumn("threshold", F.lit(threshold)),
        "bias_fairness_group_metrics": parts,
        "bias_fairness_disparity_summary": gaps.fairness_disparity(parts),
    }


def _group_metrics(scored: DataFrame, run: str, group: str, threshold: float) -> DataFrame:
    named = scored.select(run, null_group(F.col(group)).alias("group_value"), "y_true", "y_prob")
    found = metrics.evaluate(named, [run, "group_value"], threshold, "left", min_rows=BIAS_ROWS, one_class_ap=None)
    return found.withColumnsRenamed(SHORT).select(run, "group_value", *BIAS_METRICS)


def _run_metrics(scored: DataFrame, run: str, threshold: float) -> DataFrame:
    found = metrics.evaluate(scored, [run], threshold, "left", one_class_ap=None)
    return found.withColumnsRenamed(SHORT).select(run, *BIAS_METRICS)


def bias_experiment(
    df: DataFrame, scorer: Scorer, threshold: float = TUNED_THRESHOLD, group: tuple[str, str, str] | None = None
) -> Reports:
    """Models trained on biased copies of the training rows, tested on untouched rows."""
    rows = prepare.labelled_rows(df)
    feature, minority, majority = group or perturb.chosen_group(rows)
    train, test = halves(split_labelled(rows))

    def run(name: str) -> DataFrame:
        biased = perturb.bias_scenarios(train, feature, minority, majority, [name]).drop("scenario")
        return scorer(biased, test, name, "scenario")

    scored = score_all(df, [partial(run, name) for name in perturb.BIAS_SCENARIOS])
    whole = _run_metrics(scored, "scenario", threshold).withColumns(
        {"group_feature": F.lit(feature), "minority_group": F.lit(minority), "majority_group": F.lit(majority)}
    )
    parts_by_group = stage(_group_metrics(scored, "scenario", feature, threshold), "group_metrics")
    return {
        "bias_scenario_metrics": whole,
        "bias_scenario_group_metrics": parts_by_group.withColumn("group_feature", F.lit(feature)),
        "bias_scenario_disparities": gaps.disparity(parts_by_group, "scenario"),
    }


# Strategy and the row weights it trains with.
MITIGATION_STRATEGIES = [
    ("baseline", "none"),
    ("class_weight_balanced", "class"),
    ("group_reweighting", "group"),
    ("group_class_reweighting", "group_class"),
]


def weighted_rows(train: DataFrame, group: str, mode: str) -> DataFrame:
    if mode == "none":
        return train.withColumn("weight", F.lit(1.0))
    if mode == "class":
        return mitigation.class_weights(train)
    if mode == "group":
        return mitigation.group_weights(train, group)
    if mode == "group_class":
        return mitigation.group_class_weights(train, group)
    raise ValueError(f"unknown weights: {mode}")


def bias_mitigation(
    df: DataFrame, scorer: Scorer, threshold: float = TUNED_THRESHOLD, group: str | None = None
) -> Reports:
    """Four weightings, the best global threshold and per-group thresholds, side by side.

    The scorer must use the ``weight`` column of the training rows.
    """
    rows = prepare.labelled_rows(df)
    group = group or perturb.chosen_group(rows)[0]
    train, test = halves(split_labelled(rows))
    scored = score_all(
        df, [partial(lambda n, m: scorer(weighted_rows(train, group, m), test, n, "strategy"), n, m) for n, m in MITIGATION_STRATEGIES]
    )
    base = scored.where("strategy = 'baseline'")
    tuned = base.withColumn("strategy", F.lit("global_threshold_best_f1"))
    best = mitigation.best_global_threshold(base).first()["threshold"]

    def labelled(table: DataFrame, limit) -> DataFrame:
        return table.withColumn("threshold", F.lit(str(limit)))

    whole = union_all(
        [
            labelled(_run_metrics(scored, "strategy", threshold), threshold),
            labelled(_run_metrics(tuned, "strategy", best), best),
        ]
    )
    whole = stage(whole, "run_metrics")
    limits = mitigation.group_thresholds(base, group)
    guessed = mitigation.confusion_of_predictions(
        mitigation.with_group_threshold(base, group, limits), ["strategy"]
    ).withColumnsRenamed(SHORT)
    own = ["rows", "positive_rate_true", "positive_rate_predicted", "precision", "recall", "f1", "fpr", "fnr"]
    ranked = whole.where("strategy = 'baseline'").select("strategy", "pr_auc", "roc_auc", "brier_score", "ece")
    per_group = guessed.select("strategy", *own).join(ranked, "strategy")
    per_group = labelled(per_group.withColumn("strategy", F.lit("group_threshold_target_recall")), "per_group")
    by_group = union_all(
        [_group_metrics(scored, "strategy", group, threshold), _group_metrics(tuned, "strategy", group, best)]
    )
    by_group = stage(by_group, "group_metrics")
    spread = stage(gaps.disparity(by_group, "strategy"), "disparities")
    return {
        "bias_mitigation_metrics": whole.unionByName(per_group).withColumn("group_feature", F.lit(group)),
        "bias_mitigation_group_metrics": by_group,
        "bias_mitigation_disparities": spread,
        "bias_mitigation_tradeoffs": gaps.disparity_tradeoffs(spread),
    }
