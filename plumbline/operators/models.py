"""Classifiers and batch scoring: regressions and boosted trees from MLlib, its network fitted by `network`, forests of `forest`."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.features import FeatureModel, fit_features
from plumbline.operators.forest import Forest, ForestModel
from plumbline.operators.mitigation import class_weights
from plumbline.operators.network import MultilayerPerceptronClassifier
from plumbline.operators.prepare import TARGET
from plumbline.session import stage

# Sizes of the compared models.
FOREST_TREES, LARGE_FOREST_TREES, LEAST_LEAF = 200, 300, 3
HIDDEN_LAYERS, NETWORK_STEPS = (64, 32), 300
DEEPEST = 30
# Rows per partition of an encoded training table: its fits are many short jobs.
ENCODED_ROWS = 50_000


def logistic_regression(rows: int, weighted: bool = False, strength: float = 1.0, max_iter: int = 1000) -> Estimator:
    """L2-regularised regression with inverse strength ``strength`` for that many rows."""
    model = LogisticRegression(
        labelCol=TARGET,
        maxIter=max_iter,
        regParam=1.0 / (strength * max(rows, 1)),
        standardization=False,
    )
    return model.setWeightCol("weight") if weighted else model


def random_forest(
    trees: int = FOREST_TREES, seed: int = 42, least_leaf: int = 1, weighted: bool = False, max_depth: int = DEEPEST
) -> Forest:
    return Forest(trees, seed, least_leaf, max_depth, weighted)


def extra_trees(
    trees: int = LARGE_FOREST_TREES, seed: int = 42, least_leaf: int = LEAST_LEAF, weighted: bool = False, max_depth: int = DEEPEST
) -> Forest:
    """Extremely randomised trees: random thresholds, all rows in every tree."""
    return Forest(trees, seed, least_leaf, max_depth, weighted, random_thresholds=True)


def boosted_trees(seed: int = 42, steps: int = 100) -> Estimator:
    return GBTClassifier(labelCol=TARGET, seed=seed, maxIter=steps)


def neural_network(inputs: int, seed: int = 42, steps: int = NETWORK_STEPS) -> Estimator:
    return MultilayerPerceptronClassifier(
        labelCol=TARGET, layers=[inputs, *HIDDEN_LAYERS, 2], seed=seed, maxIter=steps
    )


def score(model, table: DataFrame, keep: Sequence[str], run: str, name: str = "model") -> DataFrame:
    """A scored table: the kept columns, the run name, label and probability of class 1."""
    kept = [c for c in keep if c in table.columns]
    if isinstance(model, ForestModel):
        scored, probability = model.transform(table.select(*kept, TARGET, "features")), F.col("y_prob")
    else:
        scored, probability = model.transform(table), vector_to_array(F.col("probability"))[1]
    return scored.select(F.lit(run).alias(name), *kept, F.col(TARGET).cast("int").alias("y_true"), probability.alias("y_prob"))


def fit_and_score(
    train: DataFrame,
    test: DataFrame,
    categorical: Sequence[str],
    numeric: Sequence[str],
    estimator: Callable[[FeatureModel, int], Estimator | Forest] | Estimator | Forest,
    keep: Sequence[str],
    run: str,
    name: str = "model",
    balanced: bool = False,
    features: FeatureModel | None = None,
) -> DataFrame:
    """Fit features and model on ``train`` and score ``test``. A ``weight`` column is used if the
    estimator asks for it; ``balanced`` derives it from the classes."""
    fitted = features or fit_features(train, categorical, numeric)
    weighted = class_weights(train) if balanced else train
    table = fitted.transform(weighted)
    if not isinstance(estimator, (Estimator, Forest)):
        width = table.schema["features"].metadata["ml_attr"]["num_attrs"]
        estimator = estimator(fitted, width)
    if isinstance(estimator, Estimator):
        # Written once in few files, as each round of the fit is a job over it.
        encoded = table.select("features", TARGET, *[c for c in ["weight"] if c in table.columns])
        table = stage(encoded.coalesce(1 + train.count() // ENCODED_ROWS), "encoded")
    return score(estimator.fit(table), fitted.transform(test), keep, run, name)


def model_zoo(rows: int, trees: int = LARGE_FOREST_TREES, max_depth: int = DEEPEST, steps: int = NETWORK_STEPS) -> dict:
    """Name to (estimator factory, balanced). The factories get the number of features."""
    return {
        "logistic_regression": (lambda f, w: logistic_regression(rows), False),
        "logistic_regression_balanced": (lambda f, w: logistic_regression(rows, weighted=True), True),
        "random_forest": (lambda f, w: random_forest(trees, 42, LEAST_LEAF, max_depth=max_depth), False),
        "random_forest_balanced": (
            lambda f, w: random_forest(trees, 42, LEAST_LEAF, weighted=True, max_depth=max_depth),
            True,
        ),
        "extra_trees": (lambda f, w: extra_trees(trees, max_depth=max_depth), False),
        "hist_gradient_boosting": (lambda f, w: boosted_trees(steps=max(1, steps // 3)), False),
        "mlp_classifier": (lambda f, w: neural_network(w, steps=steps), False),
    }
