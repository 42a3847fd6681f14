"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text, without white space, is cut where a few letters in a row give a boundary, so that equal
passages are cut alike wherever they stand. A chunk's identifier is a 64-bit hash; it is verified
over the whole corpus by SHA-256, and identifiers that stand for more than one chunk are found
out. Texts are then compared by their ordered identifier lists, which are some fiftieth of the
text; the texts themselves are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES
from plumbline.session import stage

# At least 64 characters up to a boundary, at most 1,000: one place in some 200 is a boundary in
# Latin letters and digits; in other scripts it is a sign behind a letter.
CHUNK = r"(?s).{64}.{0,933}?(?:[aeio05][mcgpbd17][lfuyvk29]|[^\x00-\x7F]\p{P})|.{1,1000}"


def recipes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", id_bits: int = 64) -> DataFrame:
    """One row per document: id, length, digest, chunk identifiers in order and their proofs.

    ``id_bits`` shortens the identifiers, which makes them collide; tests use it.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    bare = F.regexp_replace(text, f"{SPACES}+", "")
    short = (lambda h: h) if id_bits == 64 else (lambda h: F.pmod(h, F.lit(1 << id_bits)))
    return docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col(id_column).alias("doc_id"),
        F.length(text).alias("n_chars"),
        bare.alias("_bare"),
    ).select(
        "row_no",
        "doc_id",
        "n_chars",
        F.sha2("_bare", 256).alias("text_sha256"),
        F.transform(
            F.regexp_extract_all("_bare", F.lit(CHUNK), F.lit(0)),
            lambda c: F.struct(short(F.xxhash64(c)).alias("id"), F.unhex(F.sha2(c, 256)).alias("proof")),
        ).alias("chunks"),
    )


def clashing_identifiers(made: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk."""
    chunks = made.select(F.explode("chunks").alias("c")).select("c.id", "c.proof").distinct()
    return chunks.groupBy("id").count().where(F.col("count") > 1).select("id")


def deduplicate(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", id_bits: int = 64
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256`` and ``n_chunks``.

    Texts are equal if they are the same without ASCII white space; NULL counts as empty, and all
    empty texts are one group. The row with most characters stays, then the smallest id (NULL ids
    sort first). Of rows that are repeated as a whole one stays. Other columns are ignored, an
    empty table gives no rows.

    Groups are counted with partial aggregation; only groups of two rows or more are joined back,
    as a written table, so that a hot group is split by the skew handling of the join.
    """
    made = stage(recipes(docs, id_column, text_column, id_bits), "recipes")
    clashes = stage(clashing_identifiers(made), "clashes")
    ids = F.transform("chunks", lambda c: c["id"])
    named = made.select("row_no", "doc_id", "n_chars", "text_sha256", ids.alias("recipe"))
    if clashes.isEmpty():
        named = named.withColumn("proof", F.lit(""))
    else:
        # A list with an ambiguous identifier counts as equal only with the digest of the whole.
        doubtful = named.select("row_no", F.explode(F.array_distinct("recipe")).alias("id"))
        doubtful = doubtful.join(clashes, "id", "left_semi").select("row_no").distinct().withColumn("_d", F.lit(True))
        named = named.join(doubtful, "row_no", "left")
        named = named.withColumn("proof", F.when(F.col("_d"), F.col("text_sha256")).otherwise("")).drop("_d")
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), "doc_id", "row_no"))
    groups = named.groupBy("recipe", "proof").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = stage(groups.where("group_size > 1"), "copies")
    joined = named.join(groups, ["recipe", "proof"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row_no") == F.col("row_no"), F.lit(True)).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )
