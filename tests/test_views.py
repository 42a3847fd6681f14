"""Descriptions stay out of what the analyses write and move, and come back where they are read."""

from collections import Counter

from pyspark.sql import functions as F
from test_oracle import SMALL

from plumbline.plans import jobs, queries_tables, views
from plumbline.plans.queries_jobs import learned_scorer


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_text_is_read_where_none_is_used(spark):
    ready = views.prepared(spark, SMALL)
    assert "description" in ready.columns and "text#" in plan(ready)
    scores = views.with_scores(views.labelled(spark, SMALL)).select("model", "id", "y_true", "y_prob")
    for df in (jobs.narrow(ready), scores, jobs.narrow(queries_tables.noisy(spark, SMALL)), queries_tables.cleaned(spark, SMALL).groupBy().count()):
        assert "text#" not in plan(df)


def test_descriptions_come_back(spark, tmp_path):
    """Identifiers of documents that repeat or are null, with equal, other and no texts."""
    for name in ("orders", "lineitem", "customer", "nation"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = [(1, "a"), (1, "a"), (1, "b"), (2, None), (2, "c"), (None, "d"), (3, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found, wanted = views.prepared(spark, str(tmp_path)), views.issues(spark, str(tmp_path))
    shown = [*wanted.columns, F.coalesce(F.length("description"), F.lit(0)).alias("description_length")]
    assert Counter(found.select(*wanted.columns, "description_length").collect()) == Counter(wanted.select(*shown).collect())
    assert {r.description for r in found.collect()} == {None, "", "a", "b", "c"}


def test_cleaning_moves_no_descriptions(spark, tmp_path):
    df = queries_tables.noisy(spark, SMALL)
    done = jobs.cleaning_experiment(df, learned_scorer())["cleaned"]
    assert done.columns == df.columns
    texts = df.groupBy("key").agg(F.first("description").alias("text"))
    assert done.join(texts, "key").where(~F.col("description").eqNullSafe(F.col("text"))).count() == 0
    assert done.where("length(description) > 100").count() > 0
    assert "text#" not in plan(done.select("id", "late_resolution"))
