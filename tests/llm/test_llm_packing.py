"""Packing against the tokenizers library on whole texts and against best fit, piece by piece."""

import random
import weakref
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import EDGES, LONG, documents, empty
from tokenizers import Tokenizer

from plumbline.llm import packing, queries

TEXTS = [
    "a" * 5000,
    "word " * 3000,
    "two  spaces\n\nand lines \n here ",
    "a<|endoftext|>b <|endoftext|> c",
    "x\x1cy \x85z   \t tab's",
    "1 22 333 !!! ?! it's we'll THEY'RE",
]
ROWS = EDGES + [(100 + i, t, "en", "a") for i, t in enumerate(TEXTS)] + [(200 + i, "same length text", "en", "a") for i in range(300)]


@pytest.fixture(scope="module")
def vocabulary():
    return queries.tokenizer_json("byte_bpe_50k.json")


def whole(vocabulary, rows):
    tokenizer = Tokenizer.from_str(vocabulary)
    return [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID]) for d, t, *_ in rows]


def check(rows, wanted, capacity):
    """Every document is cut as it should be, and sequences have no gaps; their number."""
    want = Counter()
    for doc, ids in wanted:
        n = -(-len(ids) // capacity)
        cuts = [0, *[len(ids) - capacity * (n - i) for i in range(1, n)], len(ids)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def best_fit(lengths, capacity):
    """Sequences of best fit, longest first, one piece at a time."""
    rooms, n = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(rooms, length)
        if at == len(rooms):
            room, n = capacity, n + 1
        else:
            room = rooms.pop(at)
        insort(rooms, room - length)
    return n


@pytest.mark.parametrize("capacity", [1024, 64, 7, 1])
def test_pieces_and_sequences(spark, vocabulary, capacity):
    rows = [r for r in ROWS if capacity > 10 or r[1] != LONG]
    got = packing.pack_documents(documents(spark, rows), vocabulary, capacity).collect()
    n = check(got, whole(vocabulary, rows), capacity)
    assert n == best_fit([r.length for r in got], capacity)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)


def test_plan_is_best_fit():
    draw = random.Random(3)
    for _ in range(300):
        capacity = draw.choice([1, 5, 16, 100])
        histogram = {draw.randint(1, capacity): draw.randint(1, 30) for _ in range(draw.randint(0, 20))}
        rows = packing.plan(histogram, capacity)
        ranks, used = defaultdict(int), defaultdict(list)
        for length, first, past, sequence, each, offset in sorted(rows):
            assert first == ranks[length]
            ranks[length] = past
            for r in range(past - first):
                used[sequence + r // each].append((offset + r % each * length, length))
        assert ranks == histogram
        for spans in used.values():
            ends = [a + n for a, n in sorted(spans)]
            assert [a for a, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= capacity
        assert len(used) == best_fit([x for x, n in histogram.items() for _ in range(n)], capacity)


def test_plan_grows_with_the_capacity_only():
    draw = random.Random(5)
    few = {n: draw.randint(1, 1000) for n in range(1, 1025)}
    many = {n: c * 1_000_003 for n, c in few.items()}
    assert len(packing.plan(many, 1024)) < 40_000


def test_empty_table(spark, vocabulary):
    assert packing.pack_documents(empty(spark), vocabulary).count() == 0


def test_a_worker_that_waits_keeps_no_vocabulary(monkeypatch, vocabulary):
    made, held = [], []

    class Watched(packing.ByteLevelWords):
        def __init__(self, *args, **options):
            super().__init__(*args, **options)
            made.append(weakref.ref(self))

    monkeypatch.setattr(packing, "ByteLevelWords", Watched)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(packing, "give_back", lambda: held.append(made[0]()), raising=False)
    batch = pa.record_batch({"doc_id": pa.array([1, 2]), "text": pa.array(["one text", "and one more"])})
    run = packing._pieces(vocabulary, 1024, packing.END_ID, False)(iter([batch]))
    assert sum(b.num_rows for b in run) == 2
    assert held == [None]


def test_ranks_are_not_written(spark, vocabulary, monkeypatch):
    names, stage = [], packing.stage
    monkeypatch.setattr(packing, "stage", lambda df, name: names.append(name) or stage(df, name))
    got = packing.pack_documents(documents(spark, ROWS), vocabulary).collect()
    check(got, whole(vocabulary, ROWS), 1024)
    assert names == ["packing-pieces", "packing-counts"]


def test_query(spark, vocabulary):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = queries.QUERIES["op11_packing"](spark, "/root/testdata/sf0.001").collect()
    n = check(got, whole(vocabulary, rows), 1024)
    assert n <= 1.01 * sum(r.length for r in got) / 1024 + 1
