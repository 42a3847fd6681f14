import random
import re
from hashlib import sha256

import pytest
from llm_cases import documents, empty, texts

from plumbline.llm import exact


def expected(rows):
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t) for _, t in rows]
    out = []
    for (doc_id, _), b in zip(rows, bare):
        group = [(-len(t), i is not None, i or 0) for (i, t), x in zip(rows, bare) if x == b]
        best = min(group)
        out.append((doc_id, best[2] if best[1] else None, len(group), sha256(b.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 2])
def test_groups(spark, bits):
    rows = texts()
    got = exact.deduplicate(documents(spark), id_bits=bits).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == expected(rows)
    # One row of each group stays, also of rows that are repeated as a whole.
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})
    assert all(r.keep_id == r.doc_id for r in got if r.kept)


def test_short_identifiers_clash(spark):
    made = exact.recipes(documents(spark), id_bits=2)
    assert exact.clashing_identifiers(made).count() > 0


def test_shared_passages_share_chunks(spark):
    draw = random.Random(1)
    passage = " ".join("".join(draw.choices("etaoinshrdlucmfwypvbgk", k=6)) for _ in range(600))
    rows = [(1, "before " * 50 + passage, "en", "a"), (2, "other " * 70 + passage + " behind" * 30, "en", "a")]
    chunks = [{c.id for c in r.chunks} for r in exact.recipes(documents(spark, rows)).collect()]
    assert len(chunks[0] & chunks[1]) >= 3


def test_empty_table(spark):
    assert exact.deduplicate(empty(spark)).count() == 0
