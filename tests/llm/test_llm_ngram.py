import math
import zlib
from collections import Counter, defaultdict

import pytest
from llm_cases import EDGES, documents, empty

from plumbline.llm import ngram_lm as L


def tokens(text):
    return (text or "").encode().lower().split() + ["END"]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def expected(rows):
    train = [tokens(t) for i, t, *_ in rows if not held(i)]
    unigrams = Counter(w for t in train for w in t)
    total, types = sum(unigrams.values()), len(unigrams)
    pairs = Counter((a, b) for t in train for a, b in zip(["BEGIN", *t], t))
    after, before, kinds = Counter(b for _, b in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, _), n in pairs.items():
        before[a] += n
        kinds[a][min(n, 3) - 1] += 1
    of = lambda c: [sum(v == n for v in c.values()) for n in range(1, 5)]
    d, e = (0.0, *L.discounts(of(pairs))), (0.0, *L.discounts(of(after)))
    uniform = sum(e[min(v, 3)] for v in after.values()) / max(len(pairs), 1)

    def level(w):
        return (after[w] - e[min(after[w], 3)]) / len(pairs) + uniform / (types + 1)

    def chance(a, w):
        if not before[a]:
            return level(w)
        n = pairs[a, w]
        back = sum(d[k + 1] * kinds[a][k] for k in range(3)) / before[a]
        return (n - d[min(n, 3)]) / before[a] + back * level(w)

    out = []
    for i, text, *_ in rows:
        t = tokens(text)
        base = sum(math.log10((unigrams[w] + 1) / (total + types + 1)) for w in t)
        score = sum(math.log10(chance(a, w)) for a, w in zip(["BEGIN", *t], t))
        out.append((i, held(i), len(t), sum(unigrams[w] > 0 for w in t), total, base, score))
    return sorted(out, key=str), chance, unigrams


@pytest.mark.parametrize("parts", [1, 7])
def test_like_brute_force(spark, parts):
    hot = [(100 + i, "the the cat sat on the mat the the the " * (i % 5) + f"word{i} new{i % 9}", "en", "a") for i in range(120)]
    rows = EDGES + hot
    got = sorted([tuple(r) for r in L.score_documents(documents(spark, rows), parts=parts).collect()], key=str)
    want, _, _ = expected(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert any(w[1] for w in want)


def test_probabilities_sum_to_one():
    rows = [(i, "a b a c b b d " * (i % 3 + 1) + f"w{i}", "en", "a") for i in range(50)]
    _, chance, unigrams = expected(rows)
    for history in ("BEGIN", b"a", b"never"):
        # All known words, and the one share that stands for what is unknown.
        assert sum(chance(history, w) for w in [*unigrams, "unknown"]) == pytest.approx(1.0, abs=1e-9)


def test_packing():
    import numpy as np

    values = np.array([3, 3, 2**63, 2**64 - 1], dtype=np.uint64)
    assert (L.unpack(L.pack(values, True), True) == values).all() and (L.unpack(L.pack(values)) == values).all()
    assert len(L.unpack(L.pack(values[:0], True), True)) == 0


def test_no_training_text(spark):
    rows = [(i, "a b", "en", "a") for i in range(100) if held(i)][:3]
    got = L.score_documents(documents(spark, rows)).collect()
    assert [tuple(r)[1:] for r in got] == [(True, 3, 0, 0, 0.0, 0.0)] * 3


def test_empty_table(spark):
    assert L.score_documents(empty(spark)).count() == 0


def test_parts_follow_the_text_and_ids_do_not_overflow(spark, monkeypatch):
    rows = [(i, f"word{i} and word{i % 7} again", "en", "a") for i in range(200)]
    docs = documents(spark, rows)
    want = sorted(tuple(r) for r in L.score_documents(docs, parts=3).collect())
    train = L._tokens(docs, "doc_id", "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert L.parts_for(train) == partitions and L.parts_for(train.limit(0)) == partitions
    monkeypatch.setattr(L, "PART_BYTES", 100)
    size = sum(len(r[1]) for r in rows)
    assert L.parts_for(train) == -(-size // 100) > partitions
    got = sorted(tuple(r) for r in L.score_documents(docs).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    monkeypatch.setattr(L, "MOST_WORDS", 50)
    with pytest.raises(OverflowError):
        L.score_documents(docs)
