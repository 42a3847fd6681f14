"""What the registered model queries ask of their models, with a formula in place of the fits."""

import pytest
from test_oracle import SMALL

from plumbline.operators import forest, models, perturb
from plumbline.plans import jobs
from plumbline.plans.catalog import QUERIES
from plumbline.plans.queries_jobs import formula_scorer

FORESTS = {"F07": 200, "F08": 300, "F11": 200, "F12": 300, "E03b": 200, "E13b": 300}
BOOSTED, NETWORKS = ["F09", "F12"], ["F10", "F12"]


@pytest.fixture
def asked(spark, monkeypatch):
    """Runs the query of an id; its rows, and run and estimator of each fit it asks for."""

    def ask(short):
        fits = []

        def fit_and_score(train, test, categorical, numeric, estimator, keep, run, name="model", **options):
            fits.append((run, estimator(None, 9) if callable(estimator) else estimator))
            return formula_scorer()(train, test, run, name)

        monkeypatch.setattr(models, "fit_and_score", fit_and_score)
        return QUERIES[next(n for n in QUERIES if n.startswith(f"{short}_"))](spark, SMALL).collect(), fits

    return ask


@pytest.mark.parametrize("short", ["F07", "F08", "F09", "F10", "F11", "F12", "E03b", *[f"E{i:02}b" for i in range(7, 16)]])
def test_models_have_their_default_sizes(asked, short):
    rows, fits = asked(short)
    assert rows and fits
    kinds = {type(e).__name__: e for _, e in fits}
    for _, e in fits:
        if type(e).__name__ == "Forest":
            assert (e.trees, e.max_depth, e.fit_rows) == (FORESTS.get(short, 200), 30, forest.FIT_ROWS)
    if short in BOOSTED:
        assert kinds["GBTClassifier"].getMaxIter() == 100
    if short in NETWORKS:
        assert kinds["MultilayerPerceptronClassifier"].getMaxIter() == 300


def test_experiments_run_whole(asked):
    rows, fits = asked("E07b")
    assert {r.scenario for r in rows} == {run for run, _ in fits} == {s[0] for s in perturb.DEGRADATION_SCENARIOS}
    _, fits = asked("E11b")
    assert sorted(e.seed for _, e in fits) == list(jobs.SEEDS) and len(fits) == 10
    assert [r.worlds for r in asked("E12b")[0]] == [20]
    rows, fits = asked("E13b")
    assert len(fits) == 7
    assert {r.model for r in rows} == {run for run, _ in fits} == set(models.model_zoo(1))
    rows, _ = asked("E08b")
    before, after = sorted((r.rows for r in rows), reverse=True)
    assert before > after
