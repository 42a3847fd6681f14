import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import quantiles as q
from plumbline.operators import selection as sel
from plumbline.operators.lookup import attach, large_groups


def numbers(kind, n=3000):
    rnd = random.Random(7)
    draws = {
        "even": lambda: rnd.uniform(-50, 50),
        "hot": lambda: 5.0 if rnd.random() < 0.6 else rnd.gauss(0, 100),
        "tail": lambda: rnd.lognormvariate(0, 6),
        "near": lambda: 1e9 + rnd.random() * 1e-3,
        "whole": lambda: float(rnd.randrange(20)),
        "zeros": lambda: 0.0,
    }
    return [draws[kind]() for _ in range(n)]


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("kind", ["even", "hot", "tail", "near", "whole", "zeros"])
@pytest.mark.parametrize("window_rows", [10_000, 0])
def test_quantiles_match_numpy(spark, kind, window_rows):
    values = numbers(kind)
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    got = q.quantiles(df, [], F.col("v"), PROBS, window_rows=window_rows).first()
    assert got.n == len(values)
    assert got.quantiles == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("few_keys", [True, False])
def test_keyed_quantiles_of_one_hot_key(spark, few_keys):
    values = {"a": numbers("tail", 4000), "b": numbers("even", 50), "c": [3.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = q.quantiles(df, ["k"], F.col("v"), PROBS, few_keys=few_keys, window_rows=0).collect()
    assert {r.k for r in got} == set(values)
    for r in got:
        assert r.quantiles == pytest.approx(list(np.quantile(values[r.k], PROBS)), rel=1e-12)


@pytest.mark.parametrize("sort_at_most", [0, 5, 10_000])
def test_cut_points_by_narrowing(spark, sort_at_most):
    rnd = random.Random(1)
    rows = [(rnd.choice([5, 5, 5, rnd.randrange(10**12)]), rnd.random() if i % 3 else 0.25, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a long, b double, i long")
    order = [F.col("a"), F.col("b"), F.col("i")]
    expected = sorted(rows)
    positions = [0, 700, 1999]
    cuts = sel.cut_points(df, order, positions, sort_at_most)
    assert [c.values for c in cuts] == [expected[p] for p in positions]
    assert df.where(cuts[1].up_to(order)).count() == 701
    assert sel.cut_points(df, order, [2000], sort_at_most) == [None]


def test_exact_k_and_sample(spark):
    df = spark.range(1000)
    assert df.where(sel.first_k(df, sel.hashed_order("id", "x"), 123)).count() == 123
    assert sel.sample_rows(df, 50).count() == 50 and sel.sample_rows(df, 5000).count() == 1000
    a = {r.id for r in sel.sample_rows(df, 50).collect()}
    assert a == {r.id for r in sel.sample_rows(df.repartition(17), 50).collect()}
    third = sel.exact_fraction(df, F.col("id") % 4 == 0, lambda n: n // 3)
    assert df.where(third).count() == 83


def test_split_sizes():
    assert sel.split_sizes({0: 7028, 1: 2343}, 0.2) == {0: 1406, 1: 469}
    assert sum(sel.split_sizes({0: 5, 1: 3, 2: 3}, 0.2).values()) == 3


def test_stratified_split_keeps_shares(spark):
    df = spark.range(997).withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    split = sel.with_split(df, sel.stratified_test(df, "y"))
    got = {(r.y, r.split): r["count"] for r in split.groupBy("y", "split").count().collect()}
    assert got[(0, "test")] + got[(1, "test")] == 200 and got[(1, "test")] == 40


def test_time_bins_have_the_known_sizes(spark):
    df = spark.range(9354).select("id", F.timestamp_micros(F.col("id") % 100 * 1_000_000).alias("created"))
    binned = sel.with_time_bins(df)
    sizes = [r["count"] for r in binned.groupBy("period").count().orderBy("period").collect()]
    assert sizes == [1871, 1871, 1870, 1871, 1871]
    order = binned.groupBy("period").agg(F.min("created").alias("a"), F.max("created").alias("b")).orderBy("period").collect()
    assert all(x.b <= y.a for x, y in zip(order, order[1:]))


def test_dense_ranks_are_a_permutation(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).cast("string").alias("k"))
    ranks = sel.with_dense_rank(df, ["k"], buckets=16).collect()
    for k in ("0", "1"):
        assert sorted(r["rank"] for r in ranks if r.k == k) == list(range(250))


def test_attach_both_ways(spark):
    facts = spark.range(100).select("id", (F.col("id") % 7).alias("k"))
    lookup = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    small, large = attach(facts, lookup, ["k"]), attach(facts, lookup, ["k"], broadcast_rows=2)
    assert small.exceptAll(large).count() == 0 and small.count() == 100


def test_large_groups(spark):
    df = spark.range(100).select(F.when(F.col("id") < 60, "a").otherwise("b").alias("k"))
    assert large_groups(df, ["k"], 100) is None and large_groups(df, ["k"], 60) is None
    assert [r.k for r in large_groups(df, ["k"], 50).collect()] == ["a"]
    assert [r.k for r in large_groups(df, ["k"], 50, broadcast_rows=0).collect()] == ["a"]


@pytest.mark.parametrize("sort_at_most", [0, 200_000])
def test_text_ids_and_far_apart_numbers(spark, sort_at_most):
    """Every position is found, whatever the number of ties, for text and for both ends of BIGINT."""
    texts = [f"issue-{i * 7919 % 997}" for i in range(150)] + ["é", "", "z", "😀", "A" * 300]
    df = spark.createDataFrame([(1, t) for t in texts], "day long, id string")
    order = [F.col("day"), F.col("id")]
    wanted = [0, 70, len(texts)]
    cuts = sel.cut_points(df, order, wanted, sort_at_most)
    ranked = sorted(texts, key=str.encode)
    assert [c and c.values[1] for c in cuts] == [ranked[i] if i < len(ranked) else None for i in wanted]

    numbers = [-(2**63), -(2**63) + 1, -5, 0, 1, 2**62, 2**63 - 2, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "id long")
    cuts = sel.cut_points(df, [F.col("id")], [0, 3, 7], sort_at_most)
    assert [c.values[0] for c in cuts] == [numbers[i] for i in (0, 3, 7)]


def jobs_of(spark, call):
    """The result of a call, and how many jobs it ran (a shuffle under adaptive execution counts as one)."""
    group = f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        return call(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_positions_classes_and_seeds(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("y"), F.timestamp_seconds(F.col("id") % 50).alias("created"))
    df = spark.createDataFrame(df.collect(), df.schema)
    assert jobs_of(spark, lambda: sel.with_time_bins(df, 5))[1] <= 4
    assert jobs_of(spark, lambda: sel.with_time_bins(df, 40))[1] <= 4
    assert jobs_of(spark, lambda: sel.stratified_test(df, "y"))[1] <= 4
    tests, jobs = jobs_of(spark, lambda: sel.stratified_tests(df, "y", range(10)))
    assert jobs <= 8
    assert [df.where(t).count() for t in tests] == [600] * 10
    assert len({tuple(sorted(r.id for r in df.where(t).collect())) for t in tests[:3]}) == 3


@pytest.mark.parametrize("sort_at_most", [0, 7, 200_000])
def test_keyed_cuts_by_brute_force(spark, sort_at_most):
    rnd = random.Random(5)
    rows = [(rnd.choice("aaab"), rnd.choice([0.5, rnd.random(), -1e300, 1e300]), f"t{i * 13 % 400:03}") for i in range(400)]
    rows += [("c", 1.0, "only"), (None, 0.0, "none")]
    df = spark.createDataFrame(rows, "k string, v double, t string")
    wanted = {("a",): [0, 5, 150, 150, 10**6], ("b",): [0, 60], ("c",): [0, 1], ("absent",): [0]}
    seen = {}
    got = sel.keyed_cuts(df, ["k"], ["v", "t"], lambda n: seen.update(n) or wanted, sort_at_most)
    assert seen == {(k,): sum(r[0] == k for r in rows) for k in "abc"}
    for (key,), places in wanted.items():
        ranked = sorted(r[1:] for r in rows if r[0] == key)
        assert [c and c.values for c in got[(key,)]] == [ranked[p] if p < len(ranked) else None for p in places]


def test_keyed_cuts_of_empty_tables_and_too_many_keys(spark):
    empty = spark.createDataFrame([], "k string, id long")
    assert sel.keyed_cuts(empty, ["k"], ["id"], lambda n: {}) == {}
    assert sel.cut_points(empty, [F.col("id")], [0, 1]) == [None, None]
    assert sel.stratified_split(empty, "k").count() == 0
    many = spark.range(50).select("id", F.col("id").cast("string").alias("k"))
    with pytest.raises(sel.TooManyKeys):
        sel.stratified_test(many, "k")


def stratified_by_hand(rows, seed, draws, test_size=0.2):
    classes = {}
    for key, label in rows:
        if label is not None:
            classes.setdefault(label, []).append((draws[key], key))
    sizes = sel.split_sizes({c: len(m) for c, m in classes.items()}, test_size)
    return {key for c, members in classes.items() for _, key in sorted(members)[: sizes[c]]}


@pytest.mark.parametrize("kind, bucket_rows", [("few", 40), ("many", 40), ("single", 40), ("many", 50_000)])
def test_stratified_split_of_any_number_of_classes(spark, kind, bucket_rows):
    """A hot class, many small ones, classes of one row and rows without a label."""
    rnd = random.Random(3)
    label = {"few": lambda i: rnd.choice(["x", "y", None]), "single": lambda i: f"c{i}"}.get(
        kind, lambda i: "hot" if rnd.random() < 0.4 else rnd.choice([None, *(f"c{n}" for n in range(120))])
    )
    rows = [(i, label(i)) for i in range(300 if kind == "single" else 1200)]
    df = spark.createDataFrame(rows, "id long, k string").withColumn("n", F.lit(1)).withColumn("rank", F.lit("kept"))
    draws = {r.id: r.u for r in df.select("id", sel.uniform(F.col("id"), "split42").alias("u")).collect()}
    split = sel.stratified_split(df, "k", literal_classes=1, bucket_rows=bucket_rows)
    assert split.columns == [*df.columns, "split"]
    got = split.collect()
    assert len(got) == len(rows)
    assert {r.id for r in got if r.split == "test"} == stratified_by_hand(rows, 42, draws)


def test_the_two_ways_of_splitting_agree(spark):
    df = spark.range(4000).select("id", (F.col("id") * F.col("id") % 17).alias("k"))
    by_predicate = sel.with_split(df, sel.stratified_test(df, "k"))
    by_table = sel.stratified_split(df, "k", literal_classes=0)
    assert by_predicate.exceptAll(by_table).count() == 0 and by_table.count() == 4000
