"""Periodic runs against a search over all periods."""

import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from llm_cases import EDGES, documents, empty

from plumbline.llm import periods, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least_words=24, least_periods=3):
    """All runs by start, then period: for each period the longest stretches, without those of a smaller period."""
    found, n, w = [], len(words), number(words)
    for q in range(1, n // least_periods + 1):
        # Longest stretches of words that equal the word q further on.
        same = np.concatenate([[0], w[:-q] == w[q:], [0]])
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for i, j in zip(starts.tolist(), (ends + q).tolist()):
            if j - i >= max(least_words, least_periods * q):
                if not any(p < q and (w[i : j - p] == w[i + p : j]).all() for _, _, p in found):
                    found.append((i, j - i, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def number(words):
    ids = {}
    return np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)


def collapsed(words, runs):
    gone = {x for start, size, q in runs for x in range(start + q, start + size)}
    return " ".join(w for x, w in enumerate(words) if x not in gone)


CASES = [
    [],
    ["a"],
    ["a"] * 23,
    ["a"] * 24,
    ["a"] * 5000,
    ["a", "b"] * 12,
    "x y a b c a b c a b c a b c a b c a b c a b c a b c a z".split(),
    (["a"] * 6 + ["b"]) * 5 + ["a"] * 3,
    [f"w{i}" for i in range(100)] * 3,
    [f"w{i}" for i in range(100)] * 3 + ["w0"],
    [f"w{i}" for i in range(100)] * 2 + [f"w{i}" for i in range(99)],
    (["a"] * 30 + ["b"]) * 4,
    ["a"] * 30 + ["b"] * 30 + ["a"] * 30,
]


@pytest.mark.parametrize("words", CASES, ids=range(len(CASES)))
def test_cases(words):
    runs = periods.find_runs(number(words))
    assert sorted(zip(*map(list, runs)), key=lambda r: (r[0], r[2])) == brute(words)


def drawn(draw):
    """A text over few words, with repeated blocks within repeated blocks."""
    words = draw.choices("abc"[: draw.randint(1, 3)], k=draw.randint(0, 40))
    for _ in range(draw.randint(0, 3)):
        a = draw.randint(0, len(words))
        block = words[a : a + draw.randint(1, 12)] or ["a"]
        words[a:a] = block * draw.randint(2, 6)
        if draw.random() < 0.5 and words:
            words[draw.randrange(len(words))] = "z"
    return words


@pytest.mark.parametrize("least_words, least_periods", [(24, 3), (1, 3), (6, 4)])
def test_random_texts(least_words, least_periods):
    draw = random.Random(least_words)
    for _ in range(400):
        words = drawn(draw)
        runs = periods.find_runs(number(words), least_words, least_periods)
        got = sorted(zip(*map(list, runs)), key=lambda r: (r[0], r[2]))
        assert got == brute(words, least_words, least_periods), words


def test_fewer_periods_are_refused():
    with pytest.raises(ValueError):
        periods.find_runs(number(["a"] * 30), least_periods=2)


def test_documents(spark):
    draw = random.Random(9)
    rows = EDGES + [(1000 + i, " ".join(w), "en", "a") for i, w in enumerate([*CASES, *[drawn(draw) for _ in range(50)]])]
    rows += [(5000, "\t a\x0bb\x0ca\r\nb " * 20 + "\x1c\x85 c", "en", "a")]
    got = periods.detect_runs(documents(spark, rows)).collect()
    want = []
    for doc, text, *_ in rows:
        words = WORD.findall(text or "")
        # Long texts without a repeated word are spared the search.
        runs = [] if len(set(words)) > 3000 else brute(words)
        want.append((doc, len(words), runs, collapsed(words, runs)))
    assert sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got], key=str) == sorted(want, key=str)


def test_very_long_texts(spark):
    """A million words in one run, and as many without any."""
    rows = [(1, "a b c " * 400_000, "en", "a"), (2, " ".join(map(str, range(400_000))), "en", "a")]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periods.detect_runs(documents(spark, rows)).collect()}
    assert got == {1: [(0, 1_200_000, 3)], 2: []}


def test_empty_table(spark):
    assert periods.detect_runs(empty(spark)).count() == 0


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = []
    for doc, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        digests = sha256(lines.encode()).hexdigest(), sha256(collapsed(words, runs).encode()).hexdigest()
        want.append((doc, len(runs), *shown, *digests))
    got = queries.QUERIES["op12_periods"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(w[1] > 0 for w in want) > 5
