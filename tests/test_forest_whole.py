"""Forests take all labelled rows, and levels and nodes beyond what a task takes at a time are cut without a change."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from test_forest import brute, impurity

from plumbline.operators import forest


def made(n, seed=5):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, 5)), 2).astype(np.float32)
    x[:, 3] = draw.integers(0, 2, n)
    x[:, 4] = draw.integers(-3, 3, n)
    y = (x[:, 0] + x[:, 3] + draw.normal(size=n) > 0.7).astype(float)
    return x, y


def test_a_fit_takes_all_rows(spark):
    """More rows than the 100,000 that fits took before; the roots of trees without draws have them all."""
    n = 120_000
    rows = spark.range(0, n, 1, 4).select(
        "id", (F.xxhash64("id") % 7 > 2).cast("int").alias("late_resolution"),
        array_to_vector(F.array((F.col("id") % 13).cast("double"), F.rand(1))).alias("features"),
    )
    model = forest.Forest(2, 1, 500, 4, bootstrap=False).fit(rows)
    assert forest.Forest().fit_rows is None
    assert [r.rows for r in model.nodes.where("node = 0").collect()] == [n, n]
    drawn = forest.Forest(2, 1, 500, 4).fit(rows).nodes
    assert [r.rows for r in drawn.where("node = 0").collect()] == [n, n]


@pytest.mark.parametrize("weighted", [False, True])
def test_cut_levels_and_nodes_give_best_splits(monkeypatch, weighted):
    """Nodes of more rows than are taken at a time, ranks of more values than are counted at a time."""
    x, y = made(700)
    w = 1.0 + np.arange(700) % 3 if weighted else np.ones(700)
    codes, values = forest._ranked(x)
    spec = forest.Forest(1, 1, 4, 5, weighted, tried=5, bootstrap=False)
    whole = forest.grow(x, codes, values, y, w, spec, 0)
    monkeypatch.setattr(forest, "LEVEL_ROWS", 60)
    monkeypatch.setattr(forest, "BINS_AT_ONCE", 17)
    cut = forest.grow(x, codes, values, y, w, spec, 0)
    monkeypatch.setattr(forest, "LEVEL_ROWS", 300)
    monkeypatch.setattr(forest, "COUNTED_ROWS", 0)
    counted = forest.grow(x, codes, values, y, w, spec, 0)
    assert len(whole[0]) > 20
    for columns in (cut, counted):
        nodes = {int(r[1]): r for r in zip(*columns)}
        stack, seen = [(0, np.arange(700), 0)], 0
        while stack:
            number, rows, depth = stack.pop()
            _, _, feature, threshold, left_node, right_node, probability, count = nodes[number]
            seen += 1
            assert count == len(rows) and probability == pytest.approx((w[rows] * y[rows]).sum() / w[rows].sum())
            _, best = brute(x[rows], y[rows], w[rows], 4, 5 - depth)
            if feature < 0:
                assert best is None
                continue
            left = x[rows, int(feature)] <= threshold
            assert sum(impurity(y[rows[s]], w[rows[s]]) for s in (left, ~left)) == pytest.approx(best)
            stack += [(int(left_node), rows[left], depth + 1), (int(right_node), rows[~left], depth + 1)]
        assert seen == len(nodes)


@pytest.mark.parametrize("random_thresholds", [False, True])
def test_cut_levels_of_drawn_rows_add_up(monkeypatch, random_thresholds):
    x, y = made(900)
    codes, values = forest._ranked(x)
    spec = forest.Forest(1, 1, 2, 30, False, random_thresholds)
    monkeypatch.setattr(forest, "LEVEL_ROWS", 50)
    _, node, feature, threshold, left, right, probability, count = forest.grow(x, codes, values, y, np.ones(900), spec, 0)
    inner = np.flatnonzero(feature >= 0)
    assert count[0] == 900 and np.array_equal(node, np.arange(len(node))) and len(inner) > 50
    assert np.array_equal(count[left[inner]] + count[right[inner]], count[inner]) and count.min() >= 2
    sums = probability * count
    assert np.allclose(sums[left[inner]] + sums[right[inner]], sums[inner])
    if random_thresholds:
        place = np.zeros(900, dtype=int)
        for _ in range(31):
            at = feature[place]
            below = x[np.arange(900), at] <= threshold[place]
            place = np.where(at < 0, place, np.where(below, left[place], right[place]))
        assert np.array_equal(np.bincount(place, minlength=len(node))[feature < 0], count[feature < 0])


def test_written_rows_are_the_same_in_one_part_and_in_many(spark, monkeypatch):
    x, y = made(500)
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x array<double>, late_resolution int")
    df = df.withColumn("features", array_to_vector("x")).drop("x")
    spec = forest.Forest(3, 7)
    whole = spec.fit(df).nodes.orderBy("tree", "node").collect()
    monkeypatch.setattr(forest, "PART_ROWS", 90)
    assert spec.fit(df).nodes.orderBy("tree", "node").collect() == whole
    assert forest.Forest(3, 7).fit(df.where("id < 0")).nodes.count() == 0
