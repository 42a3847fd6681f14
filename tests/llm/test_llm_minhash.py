import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import EDGES, documents, empty

from plumbline.llm import minhash as M


def brute(rows, similarity=0.8):
    """Number of the class of every row, by comparing all pairs that share a shingle."""
    sets = []
    for _, text, *_ in rows:
        w = M.words_of((text or "").encode())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for e in s or [None]:
            holders[e].append(i)
    both = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    for (a, b), n in both.items():
        if not sets[a] or n / (len(sets[a]) + len(sets[b]) - n) >= similarity:
            join(a, b)
    return [find(i) for i in range(len(rows))]


def check(spark, rows, **options):
    got = M.find_classes(documents(spark, rows), **options).collect()
    classes = defaultdict(list)
    for row, c in zip(rows, brute(rows)):
        classes[c].append(row[0])
    rank = lambda i: (i is None, i or 0)
    want = Counter((i, min(ids, key=rank), len(ids)) for ids in classes.values() for i in ids)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert sum(r.kept for r in got) == len(classes)
    assert all(r.doc_id == r.class_id for r in got if r.kept)
    return classes


def test_edges(spark):
    check(spark, EDGES)


def copies(draw, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(edits):
            w[draw.randrange(len(w))] = f"edit{draw.random()}"
        out.append(" ".join(w))
    return out


def test_near_copies_around_the_threshold(spark):
    draw = random.Random(2)
    rows = []
    for g in range(25):
        words = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        rows += [(len(rows) + k, t, "en", "a") for k, t in enumerate(copies(draw, words, 6, g % 9))]
    classes = check(spark, rows)
    assert 25 < len(classes) < len(rows)


def test_passages_repeated_in_one_side_only(spark):
    """The sets are alike, but not the counts: many links are below 0.65 by weight."""
    draw = random.Random(11)
    rows = []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(204)]
        once = [f"g{g}x{i}" for i in range(20 if g % 2 else 0)]
        passage = words[40:84]
        rows.append((len(rows), " ".join(words + once), "en", "a"))
        rows.append((len(rows), " ".join(words[:84] + passage * draw.choice([19, 60]) + words[84:]), "en", "a"))
    classes = check(spark, rows)
    assert len(classes) == 60


def test_least_agreement():
    least = M.least_agreement(0.8)
    assert 0.6 < least < 0.65 and M.least_agreement(0.5) < 0.4 and M.least_agreement(1.0) == 1.0
    draw = np.random.default_rng(1)
    assert (draw.binomial(M.SLOTS, 0.8, 1_000_000) < least * M.SLOTS).sum() < 8


@pytest.mark.parametrize("block", [1024, 16])
def test_large_bucket_with_links_through_others(spark, block):
    """All share most bands, but many pairs are below 0.8 and joined through others only."""
    draw = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, t, "en", "a") for i, t in enumerate(copies(draw, words, 120, 6) + copies(draw, words, 60, 9))]
    check(spark, rows, block=block)


def test_estimate():
    draw = np.random.default_rng(0)
    for share in (0.5, 0.8):
        agree = []
        for _ in range(30):
            u = draw.integers(0, 2**63, 1200).astype(np.uint64)
            k = int(800 * share / (1 + share))
            a, b = u[:400], np.concatenate([u[:k], u[400 : 800 - k]])
            table = M.signatures(np.concatenate([a, b]), np.ones(800), np.repeat([0, 1], 400), 2)
            agree.append((table[0] == table[1]).mean())
        assert abs(np.mean(agree) - M.jaccard(np.sort(a), np.sort(b))) < 0.03


def test_weights_and_small_sets():
    one = M.signatures(np.array([7], dtype=np.uint64), np.array([2.5]), np.array([0]), 1)
    assert (one == 7).all()
    # The signature of a set does not hang on what else is in the batch, nor on a common factor.
    e, w = np.arange(1, 40, dtype=np.uint64) * np.uint64(2**40 + 1), np.linspace(1, 5, 39)
    alone = M.signatures(e, w, np.zeros(39, dtype=int), 1)[0]
    twice = M.signatures(np.concatenate([e, e[:3]]), np.concatenate([w * 8, w[:3]]), np.array([0] * 39 + [1] * 3), 2)
    assert (twice[0] == alone).all()
    # Probability Jaccard of weights (1, 3) and (1, 1): the first element 1 / (1 + 3), the second 3 / (3 + 3)... on average.
    agree = []
    for s in range(80):
        pair = np.array([s * 977 + 1, s * 3571 + 2], dtype=np.uint64)
        t = M.signatures(np.tile(pair, 2), np.array([1.0, 3.0, 1.0, 1.0]), np.array([0, 0, 1, 1]), 2)
        agree.append((t[0] == t[1]).mean())
    assert abs(np.mean(agree) - (1 / (1 + 3) + 1 / (1 + 1))) < 0.04


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (200, 3)]
    got = {r.node: r.root for r in M.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got.get(i, i) for i in [*range(1, 41), 200]} == {1}
    assert {got.get(i, i) for i in range(100, 160)} == {100}
    assert M.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    docs = documents(spark)
    left = M.keep_one(docs, M.find_classes(docs))
    assert left.columns == docs.columns
    assert left.count() == len(set(brute(EDGES)))
    assert {r.doc_id for r in left.collect()} == {r.class_id for r in M.find_classes(docs).collect()}


def test_empty_table(spark):
    docs = empty(spark)
    assert M.keep_one(docs, M.find_classes(docs)).count() == 0
