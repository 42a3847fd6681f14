"""Forests against a plain search over all splits, and real fits of every kind of model on a small table."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from plumbline.operators import forest, models
from plumbline.plans import jobs
from plumbline.session import side_by_side, stage

N, WIDTH = 400, 6


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(8)
    x = np.round(draw.normal(size=(N, WIDTH)), 1).astype(np.float32)
    x[:, 4] = draw.integers(0, 2, N)
    x[:, 5] = 1.0
    y = (x[:, 0] + x[:, 4] + 0.5 * draw.normal(size=N) > 0.5).astype(int)
    rows = [(i, [float(v) for v in x[i]], int(y[i]), 1.0 + (i % 3)) for i in range(N)]
    rows += [(N, rows[0][1], 1 - rows[0][2], 2.0)]
    df = spark.createDataFrame(rows, "id long, x array<double>, late_resolution int, weight double").repartition(4)
    return df.withColumn("features", array_to_vector("x")).drop("x").cache()


def held(table):
    rows = table.collect()
    x = np.array([r.features.toArray() for r in rows], dtype=np.float32)
    return rows, x, np.array([r.late_resolution for r in rows], dtype=float), np.array([r.weight for r in rows])


def impurity(y, w):
    share = (w * y).sum() / w.sum()
    return w.sum() * 2 * share * (1 - share)


def brute(x, y, w, least_leaf, depth):
    """Gini impurity (times weight) that the best split at every node leaves, down to a depth; leaves of the greedy tree."""
    if depth == 0 or len(set(y)) < 2 or len(y) < 2 * least_leaf:
        return [sorted(range(len(y)))], None
    best = None
    for j in range(x.shape[1]):
        values = np.unique(x[:, j].astype(np.float64))
        for a, b in zip(values, values[1:]):
            left = x[:, j] <= (a + b) / 2
            if least_leaf <= left.sum() <= len(y) - least_leaf:
                rest = impurity(y[left], w[left]) + impurity(y[~left], w[~left])
                if best is None or rest < best:
                    best = rest
    return None, best


@pytest.mark.parametrize("least_leaf, weighted", [(1, False), (3, True), (25, True)])
def test_every_split_is_the_best_one(table, least_leaf, weighted):
    spec = forest.Forest(1, 1, least_leaf, 6, weighted, tried=WIDTH, bootstrap=False)
    nodes = {r.node: r for r in spec.fit(table).nodes.collect()}
    _, x, y, w = held(table)
    w = w if weighted else np.ones(len(y))
    stack, seen = [(0, np.arange(len(y)), 0)], 0
    while stack:
        number, rows, depth = stack.pop()
        node, seen = nodes[number], seen + 1
        assert node.rows == len(rows)
        assert node.probability == pytest.approx((w[rows] * y[rows]).sum() / w[rows].sum())
        _, best = brute(x[rows], y[rows], w[rows], least_leaf, 6 - depth)
        if node.feature < 0:
            assert best is None and node.threshold is None and node.left_node == node.right_node == -1
            continue
        left = x[rows, node.feature] <= node.threshold
        rest = sum(impurity(y[rows[s]], w[rows[s]]) for s in (left, ~left))
        assert rest == pytest.approx(best) and min(left.sum(), (~left).sum()) >= least_leaf
        stack += [(node.left_node, rows[left], depth + 1), (node.right_node, rows[~left], depth + 1)]
    assert seen == len(nodes)


@pytest.mark.parametrize("random_thresholds", [False, True])
def test_tables_of_nodes(spark, table, random_thresholds):
    """Counts add up, trees differ, and following the table by joins gives what scoring gives."""
    spec = forest.Forest(8, 3, 2, 6, True, random_thresholds)
    model = spec.fit(table)
    nodes = model.nodes.cache()
    inner = nodes.where("feature >= 0")
    children = nodes.select("tree", F.col("node").alias("child"), F.col("rows").alias("child_rows"))
    both = inner.join(children, ["tree"]).where("child in (left_node, right_node)").groupBy("tree", "node", "rows")
    assert both.agg(F.sum("child_rows").alias("n")).where("n <> rows").count() == 0
    assert nodes.where("probability < 0 or probability > 1 or rows < 2").count() == 0
    assert nodes.where("node = 0").select("rows").distinct().collect() == [(N + 1,)]
    assert nodes.groupBy("tree").agg(F.count("*").alias("n"), F.count_if(F.col("feature") < 0).alias("k")).where("n <> 2 * k - 1").count() == 0
    assert nodes.where("node = 0").select("feature", "threshold").distinct().count() > 2
    if random_thresholds:
        limits = [r.threshold for r in inner.where("feature = 0").collect()]
        assert len(set(limits)) == len(limits)
    # Level by level, as joins on the table of nodes.
    value = F.element_at(F.col("x"), F.col("feature") + 1).cast("float")
    at = table.select("id", vector_to_array("features").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("tree"))
    at, leaves = at.withColumn("node", F.lit(0)), []
    for _ in range(spec.max_depth + 1):
        joined = stage(at.join(nodes, ["tree", "node"]), "followed")
        leaves.append(joined.where("feature < 0").select("id", "tree", "probability"))
        at = joined.where("feature >= 0")
        at = at.select("id", "tree", "x", F.when(value <= F.col("threshold"), F.col("left_node")).otherwise(F.col("right_node")).alias("node"))
    done = jobs.union_all(leaves)
    followed = {r.id: r.p for r in done.groupBy("id").agg(F.avg("probability").alias("p")).collect()}
    scored = {r.id: r.y_prob for r in model.transform(table).collect()}
    assert scored == pytest.approx(followed) and len(scored) == N + 1


def test_same_trees_whatever_the_partitions(table):
    spec = forest.Forest(5, 42)
    first, second = (spec.fit(t).nodes.orderBy("tree", "node").collect() for t in (table, table.repartition(7)))
    assert first == second
    assert forest.Forest(5, 43).fit(table).nodes.orderBy("tree", "node").collect() != first


def test_bound_on_rows_and_single_class(table):
    small = forest.Forest(3, 1, fit_rows=50).fit(table)
    assert {r.rows for r in small.nodes.where("node = 0").collect()} == {50}
    assert small.transform(table).count() == N + 1
    one = forest.Forest(3, 1).fit(table.where("late_resolution = 1"))
    assert {r.y_prob for r in one.transform(table).collect()} == {1.0}


def test_every_model_of_the_comparison_learns(spark, table):
    """Real fits: each of the seven models beats a guess on the rows it has seen."""
    df = table.withColumn("x0", F.round(F.rand(3) + F.col("late_resolution"), 2)).withColumn("kind", F.concat(F.lit("k"), F.col("id") % 3))
    df = df.drop("features", "weight")
    calls = []
    for name, (factory, balanced) in models.model_zoo(N, trees=20, steps=30).items():
        scorer = jobs.EstimatorScorer(factory, ["kind"], ["x0"], balanced)
        calls.append(lambda s=scorer, n=name: s(df, df, n).collect())
    results = side_by_side(spark, calls)
    assert len(results) == 7
    for rows in results:
        assert len(rows) == N + 1 and all(0 <= r.y_prob <= 1 for r in rows)
        right = sum((r.y_prob > 0.5) == r.y_true for r in rows)
        assert right > 0.8 * N, rows[0].model


def test_side_by_side_keeps_order_and_errors(spark):
    calls = [lambda i=i: spark.range(i).count() for i in range(6)]
    assert side_by_side(spark, calls) == list(range(6))
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [*calls, lambda: 1 // 0])


def test_a_forest_stays_out_of_the_driver(spark, table, monkeypatch):
    """No broadcast and no collected nodes: scoring gives what the nodes say, a file of trees at a time."""
    spec = forest.Forest(2 * forest.TREES_AT_ONCE + 3, 5, 2, 6)
    model = spec.fit(table)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", None)
    monkeypatch.setattr(type(table), "toArrow", None)
    got = {r.id: r.y_prob for r in model.transform(table).collect()}
    assert len(model._files) == 3 and model.transform(table.where("id < 0")).count() == 0
    rows, x, _, _ = held(table)
    trees = {}
    for n in model.nodes.collect():
        trees.setdefault(n.tree, {})[n.node] = n
    for row, values in zip(rows[:50], x):
        leaves = []
        for _, nodes in sorted(trees.items()):
            n = nodes[0]
            while n.feature >= 0:
                n = nodes[n.left_node if float(values[n.feature]) <= n.threshold else n.right_node]
            leaves.append(n.probability)
        assert got[row.id] == np.mean(leaves)


def test_sorting_numbers_keeps_equal_keys_in_order():
    draw = np.random.default_rng(3)
    keys = draw.integers(0, 50, 2000)
    for limit in (50, 1 << 61):  # the second has no room for places beside the keys
        got, order = forest._in_order(keys, limit)
        assert np.array_equal(order, np.argsort(keys, kind="stable")) and np.array_equal(got, keys[order])


def test_packed_trees_are_read_without_copies_and_lead_to_the_same_leaves(tmp_path):
    draw = np.random.default_rng(4)
    x = np.round(draw.random((900, 5)), 3).astype(np.float32)
    y = (x[:, 0] + draw.random(900) > 1).astype(float)
    codes, values = forest._ranked(x)
    assert codes.dtype == np.uint16
    columns = [np.concatenate(c) for c in zip(*(forest.grow(x, codes, values, y, np.ones(900), forest.Forest(), t) for t in range(3)))]
    names = [f.split()[0] for f in forest.NODES.split(", ")]
    group = pa.table({n: pa.array(c, k, from_pandas=True) for n, c, k in zip(names, columns, forest._KINDS)})
    packed = forest._pack(str(tmp_path))((pa.scalar(0),), group)
    nodes = forest._read_trees(packed.column("path")[0].as_py())
    assert all(column.flags.c_contiguous and not column.flags.owndata for column in nodes.values())
    # Values at the thresholds, and the single-precision numbers beside them.
    limits = np.array([v for v in columns[3] if v == v], dtype=np.float32)
    asked = np.concatenate([x, *(np.tile(v[:, None], 5) for v in (limits, np.nextafter(limits, np.float32(2)), np.nextafter(limits, np.float32(-2))))])
    got = forest._reached(nodes, asked)
    trees = [{n: i for i, n in enumerate(columns[1]) if columns[0][i] == t} for t in range(3)]
    own = [{n: [c[i] for c in columns] for n, i in at.items()} for at in trees]
    for row, found in zip(asked[::7], got[::7]):
        for tree, probability in zip(own, found):
            node = tree[0]
            while node[2] >= 0:
                node = tree[node[4] if float(row[int(node[2])]) <= node[3] else node[5]]
            assert probability == node[6]
