"""The registered queries against their SQL, and the pipeline stage by stage against brute force."""

import pytest
from oracle_check import compare, connect

import corpus_pipeline
from plumbline.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    outcome = compare(spark, connect(SMALL), name, QUERIES[name], SQL.get(name), SMALL)
    assert outcome.startswith("ok" if name in SQL else "rows only") and "EMPTY" not in outcome, outcome


def test_names():
    assert set(SQL) <= set(QUERIES)
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 14))


def test_pipeline(spark):
    import test_llm_decontaminate as decontamination
    import test_llm_lines as lines
    import test_llm_minhash as near

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    for number, (name, step) in enumerate(corpus_pipeline.STAGES):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = corpus_pipeline.stage(step(spark, docs, SMALL), name)
        if number < 4:
            assert out.columns == columns
        ids = sorted(r.doc_id for r in out.collect())
        if name == "language_id":
            assert len(ids) >= 0.99 * len(rows)
        elif name == "line_dedup":
            assert {r.doc_id: r.text for r in out.collect()} == {w[0]: w[3] for w in lines.expected(rows)}
        elif name == "near_dedup":
            assert ids == sorted({rows[i][0] for i in near_first(near.brute(rows), rows)})
        elif name == "decontaminate":
            assert ids == sorted(w[0] for w in decontamination.expected(rows, items) if not w[2])
        else:
            assert ids == sorted(r[0] for r in rows)
        docs = out
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()


def near_first(classes, rows):
    """Row with the smallest id of each class."""
    best = {}
    for i, c in enumerate(classes):
        if c not in best or rows[i][0] < rows[best[c]][0]:
            best[c] = i
    return best.values()
