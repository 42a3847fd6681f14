import random
import re

import pytest
from llm_cases import EDGES, LONG, SAME, documents, empty

from plumbline.llm import decontaminate as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [
    (1, SAME),
    (2, "walks HOME"),
    (3, None),
    (4, " .,- "),
    (5, " ".join(LONG.split()[5000:5040])),
    (10, "the the the the the the the the the the the"),
    (None, "an item without an id İstanbul"),
    (2, "naïve"),
    (7, "naïve"),
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expected(rows, items, n=10):
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n + 1, 1) if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    found |= grams[tuple(w[i : i + k])]
        out.append((doc_id, len(w), len(hit), len(found), ",".join(sorted(found))))
    return sorted(out, key=str)


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as anchor", "2 as gram")


def rows_of(found):
    digest = D.digest(found).drop("items_sha256", "contaminated")
    joined = found.select("doc_id", "n_words", D.covered(found["windows"]).alias("n_hit"), "items").collect()
    assert digest.count() == len(joined)
    return sorted([(r.doc_id, r.n_words, r.n_hit, len(r.items), ",".join(r["items"])) for r in joined], key=str)


EXTRA = [
    (20, f"!{SAME} {SAME}", "en", "a"),
    (21, "The the THE " * 7, "en", "a"),
    (22, "so he walks home. Walks-home", "en", "a"),
    (23, " ".join(SAME.split()[:9]), "en", "a"),
    (24, "an Item without an id İstanbul?", "en", "a"),
]


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_like_brute_force(spark, limit):
    rows = EDGES + EXTRA
    found = D.find_overlaps(documents(spark, rows), benchmark(spark), broadcast_bytes=limit)
    want = expected(rows, ITEMS)
    assert rows_of(found) == want and sum(w[2] for w in want) > 100


def test_random_words(spark):
    draw = random.Random(5)
    text = lambda k: "".join(draw.choice(["a", "b", "A", "cc"]) + draw.choice([" ", ", ", "\n"]) for _ in range(k))
    items = [(i, text(draw.randint(0, 14))) for i in range(40)]
    rows = [(i, text(draw.randint(0, 120)), "en", "a") for i in range(60)]
    assert rows_of(D.find_overlaps(documents(spark, rows), benchmark(spark, items), n=4)) == expected(rows, items, 4)


def test_removal(spark):
    rows = EDGES + EXTRA
    docs, want = documents(spark, rows), expected(rows, ITEMS)
    found = D.find_overlaps(docs, benchmark(spark))
    left = D.remove_documents(docs, found)
    assert left.columns == docs.columns
    assert sorted([r.doc_id for r in left.collect()], key=str) == sorted([w[0] for w in want if not w[2]], key=str)
    cut = D.remove_spans(docs, found)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[22] == "so he " and texts[23] == rows[-2][1] and texts[1] is None
    # Only words inside windows go.
    by_id = {w[0]: w for w in want}
    assert all(len(words(texts[i])) == by_id[i][1] - by_id[i][2] for i in (4, 5, 9, 20, 21))


def test_empty_tables(spark):
    assert D.find_overlaps(empty(spark), benchmark(spark)).count() == 0
    found = D.find_overlaps(documents(spark), benchmark(spark, [])).collect()
    assert len(found) == len(EDGES) and not any(r.windows for r in found)


def test_long_document_without_broadcast(spark):
    """A text of 200,000 words, many of them anchors, by shuffles: its words travel alone, not with the text."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota extraordinarily"
    filler = [f"w{i % 997}" if i % 5 else "extraordinarily" for i in range(200_000)]
    rows = [(1, " ".join(filler[:150_000]) + f" {item.upper()} " + " ".join(filler[150_000:]), "en", "a"), (2, None, "en", "a"), (3, item, None, None)]
    docs, items = documents(spark, rows), benchmark(spark, [(7, item)])
    found = D.find_overlaps(docs, items, broadcast_bytes=-1)
    got = {r.doc_id: (r.n_words, [tuple(w) for w in r.windows], r["items"]) for r in found.collect()}
    assert got == {1: (200_010, [(150_000, 10)], ["7"]), 2: (0, [], []), 3: (10, [(0, 10)], ["7"])}
    assert sorted(map(str, found.collect())) == sorted(map(str, D.find_overlaps(docs, items).collect()))
