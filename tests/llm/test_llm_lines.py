import random
from collections import defaultdict
from hashlib import sha256

import pyarrow as pa
import pytest
from llm_cases import EDGES, documents, empty

from plumbline.llm import common, lines

WS = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    split = [(i, (t or "").split("\n")) for i, t, *_ in rows]
    for i, ls in split:
        for line in ls:
            key = line.strip(WS).translate(LOWER)
            if len(key) >= min_chars:
                holders[key].add(i)
    rank = lambda i: (i is not None, i or 0)
    out = []
    for i, ls in split:
        kept = []
        for line in ls:
            docs = holders.get(line.strip(WS).translate(LOWER), ())
            if len(docs) < min_docs or i == max(docs, key=rank):
                kept.append(line)
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def check(spark, rows, **options):
    docs = documents(spark, rows)
    bitmaps = lines.keep_bitmaps(docs, **options)
    want = expected(rows, **options)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.digests(docs, bitmaps).collect()]
    assert sorted(got, key=str) == sorted([(*w[:3], sha256(w[3].encode()).hexdigest()) for w in want], key=str)
    left = lines.remove_lines(docs, bitmaps)
    assert left.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=str) == sorted([(w[0], w[3]) for w in want], key=str)
    return want


def test_edges(spark):
    assert sum(w[2] for w in check(spark, EDGES)) > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_lines_over_many_partitions(spark, seed):
    """A line in nearly every document fills several partitions of the sorted hashes."""
    draw = random.Random(seed)
    pool = [f"line number {i} " + "é" * 30 for i in range(60)]
    weights = [400] + [1] * 59
    rows = []
    for i in range(300):
        picked = draw.choices(pool, weights, k=draw.randint(0, 25)) + ["short"] * draw.randint(0, 2)
        draw.shuffle(picked)
        rows.append((i if i % 50 else None, "\n".join(p.upper() if draw.random() < 0.1 else f" {p}\t" for p in picked), "en", "a"))
    assert sum(w[2] for w in check(spark, rows)) > 1000


def test_exactly_at_the_limits(spark):
    rows = [(i, "x" * (39 + i % 2), "en", "a") for i in range(10)]
    assert sum(w[2] for w in check(spark, rows)) == 4
    assert sum(w[2] for w in check(spark, rows[:8])) == 0


def test_empty_table(spark):
    docs = empty(spark)
    assert lines.digests(docs, lines.keep_bitmaps(docs)).count() == 0


def test_lines_are_taken_in_slices_and_memory_is_returned(monkeypatch):
    """A batch of long texts is no single array of results, and each pass returns what was freed, also at its end."""
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    texts = [(f"{i} " + "x" * 60 + "\n").encode() * 20_000 for i in range(4)]
    batch = pa.record_batch({"doc_id": pa.array(range(4), pa.int64()), "text_key": pa.array(range(4), pa.int64()), "text": pa.array(texts, pa.binary())})
    out = list(lines._hashed(40)(iter([batch])))
    assert len(out) == 4 and [len(b) for b in out] == [20_000] * 4 and len(calls) == 2
    packed = pa.record_batch({"text": pa.array(texts, pa.binary()), "keep": pa.array([None] * 4, pa.binary())})
    out = list(lines._applied(with_text=True)(iter([packed])))
    assert [b.column("result")[0].as_py() for b in out] == texts and len(calls) == 4
