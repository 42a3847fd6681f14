"""Benchmark decontamination by n-grams, in DataFrame functions only.

The n-grams of all benchmark items are few against the corpus. Their hash set is broadcast (its
size is measured). A training text is cut into
words once. A word that some n-gram has as its anchor, its longest word, is looked up first; only
there the window of words is put together and looked up among the n-grams, which compares the
whole n-gram.

Beyond the bound, words are shuffled to the anchors with the number of their row and their place
only; the places go back to their rows, where the windows are put together, and these are
shuffled to the n-grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_BYTES, ascii_lower, is_small
from plumbline.session import stage

# What stands between words before letters are lower-cased, and what a word consists of.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WITHIN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Stands behind the last word of every document and is no word.
END = "\x00"


def benchmark_grams(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``gram, anchor, offset, k, items``: every n-gram with its anchor and the items that hold it."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    words = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
        F.filter(F.split(text, BETWEEN), lambda w: w != "").alias("w"),
    ).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    windows = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, n))).alias("w"))
    longest = F.array_max(F.transform("w", lambda w, i: F.struct(F.length(w).alias("l"), (-i).alias("i"), w.alias("w"))))
    grams = windows.groupBy("w").agg(F.collect_set("item_id").alias("items")).withColumn("a", longest)
    return grams.select(
        F.array_join("w", " ").alias("gram"),
        F.lower("a.w").alias("anchor"),
        (-F.col("a.i")).alias("offset"),
        F.size("w").alias("k"),
        "items",
    )


def _by_shuffles(words: DataFrame, lead: Column, full: Column, anchors: DataFrame, known: DataFrame) -> DataFrame:
    """``find_overlaps`` for more n-grams than may be broadcast; row numbers come from a written table."""
    words = stage(words, "document-words")
    each = words.select("row_no", F.posexplode("w").alias("pos", "word")).select("row_no", "pos", F.lower("word").alias("anchor"))
    placed = each.join(anchors, "anchor").select("row_no", "pos", F.inline("places"))
    starts = placed.where("pos >= offset").select("row_no", (F.col("pos") - F.col("offset")).alias("s"), "k").distinct()
    per_row = starts.groupBy("row_no").agg(F.collect_list(F.struct("s", "k")).alias("places"))
    candidates = words.join(per_row, "row_no").select("row_no", "w", lead.alias("lead"), F.inline("places"))
    windows = candidates.where(F.col("s") + F.col("k") <= F.size("w")).select(
        "row_no",
        "k",
        (F.col("s") - F.col("lead")).alias("start"),
        ascii_lower(F.array_join(F.slice("w", F.col("s") + 1, F.col("k")), " ")).alias("gram"),
    )
    hits = windows.join(known, ["gram", "k"]).groupBy("row_no").agg(
        F.array_sort(F.collect_set(F.struct("start", "k"))).alias("windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    rows = words.select("row_no", "doc_id", "text_key", full.alias("n_words"))
    return rows.join(hits, "row_no", "left").select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("windows", F.array().cast("array<struct<start:int,k:int>>")).alias("windows"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per document row: ``doc_id, text_key, n_words, windows, items``.

    ``windows`` are (start, k) word ranges, zero-based, in order, that equal an n-gram of the
    benchmark; ``items`` the item ids with such an n-gram, sorted as text. Words are lower-cased in
    A-Z. An item of fewer than ``n`` words, but not none, is one n-gram. NULL and empty texts have
    no words; an empty benchmark gives no windows; rows that are repeated, also ids, are rows of
    their own (``text_key`` is a hash of the text); other columns are ignored. A NULL item id
    counts as the id ``null``.
    """
    grams = stage(benchmark_grams(benchmark, n), "grams")
    spark = docs.sparkSession
    anchors = grams.groupBy("anchor").agg(F.collect_set(F.struct("offset", "k")).alias("places"))
    anchors = stage(anchors, "anchors")
    known = grams.select("gram", "k", "items")
    small = is_small(anchors, F.octet_length("anchor") + 100, broadcast_bytes)
    small = small and is_small(known, F.octet_length("gram") + 40 * F.size("items") + 40, broadcast_bytes)

    text = F.coalesce(F.col(text_column), F.lit(""))
    words = docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col(id_column).alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        F.split(text, BETWEEN).alias("w"),
    )
    # Only the first and the last piece can be empty; positions count from the first word.
    lead = (F.element_at("w", 1) == "").cast("int")
    full = (F.size("w") - lead - ((F.element_at("w", -1) == "") & (F.size("w") > 1)).cast("int")).cast("long")
    if not small:
        return _by_shuffles(words, lead, full, anchors, known)

    last = spark.range(1).select(
        F.lit(END).alias("anchor"), F.array(F.struct(F.lit(0).alias("offset"), F.lit(0).alias("k"))).alias("places")
    )
    empty = spark.range(1).select(F.lit("").alias("gram"), F.lit(0).alias("k"), F.array().cast("array<string>").alias("items"))
    anchors, known = F.broadcast(anchors.unionByName(last)), F.broadcast(known.unionByName(empty))
    each = words.select("row_no", "doc_id", "text_key", "w", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "word"))
    at_anchor = each.join(anchors, F.lower("word") == F.col("anchor"))
    placed = at_anchor.select("row_no", "doc_id", "text_key", "w", "pos", F.inline("places"))
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("k") <= F.size("w"))
    window = ascii_lower(F.array_join(F.slice("w", start + 1, F.col("k")), " "))
    windows = placed.where(inside).select(
        "row_no",
        "doc_id",
        "text_key",
        "k",
        (start - lead).alias("start"),
        F.when(F.col("k") == 0, full).alias("n_words"),
        window.alias("gram"),
    )
    hits = windows.join(known, ["gram", "k"])
    return hits.groupBy("row_no", "doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("k") > 0, F.struct("start", "k")))).alias("windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ).drop("row_no")


def covered(windows: Column) -> Column:
    """Number of words inside any of the ranges, which are in order of their start."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc, w):
        end = F.greatest(acc["end"], w["start"] + w["k"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], w["start"])).alias("n"))

    return F.aggregate(windows, start, add, lambda acc: acc["n"])


def merged(windows: Column) -> Column:
    """The ranges, in order of their start, put together where they overlap: (start, end)."""
    kind = "array<struct<start:int,end:int>>"

    def add(acc, w):
        end = w["start"] + w["k"]
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"))
        fresh = F.concat(acc, F.array(F.struct(w["start"].alias("start"), end.alias("end"))))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))
        return F.when((F.size(acc) > 0) & (last["end"] >= w["start"]), joined).otherwise(fresh)

    return F.aggregate(windows, F.array().cast(kind), add)


def digest(found: DataFrame) -> DataFrame:
    n_hit = covered(F.col("windows"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("windows") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without a window of the benchmark, with all their columns.

    The contaminated rows are written and joined by id and text; Spark broadcasts them only if the
    written table is below its own threshold.
    """
    bad = stage(found.where(F.size("windows") > 0).select("doc_id", "text_key").distinct(), "contaminated")
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key"))
    key = F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))
    same = F.col(id_column).eqNullSafe(F.col("_bad_id")) & (key == F.col("_bad_key"))
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All documents, without the words inside windows and what follows each of them."""
    bad = stage(found.where(F.size("windows") > 0).select("doc_id", "text_key", "windows").distinct(), "contaminated")
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key"), F.col("windows").alias("_windows"))
    key = F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"))
    same = F.col(f"_row.`{id_column}`").eqNullSafe(F.col("_bad_id")) & (F.col("_key") == F.col("_bad_key"))
    text, hit = F.col(f"_row.`{text_column}`"), F.col("_windows").isNotNull()
    # Columns of their own, so that the lambdas below do not cut the text up for every word.
    cut = marked.join(bad, same, "left").select(
        "_row",
        F.when(hit, F.filter(F.split(text, BETWEEN), lambda w: w != "")).alias("_words"),
        F.when(hit, F.split(text, WITHIN)).alias("_gaps"),
        F.when(hit, merged(F.col("_windows"))).alias("_ranges"),
    )
    inside = lambda i: F.exists("_ranges", lambda x: (i >= x["start"]) & (i < x["end"]))
    rest = F.transform(
        "_words", lambda w, i: F.when(inside(i), F.lit("")).otherwise(F.concat(w, F.element_at("_gaps", i + 2)))
    )
    clean = F.concat(F.element_at("_gaps", 1), F.array_join(rest, ""))
    new = F.when(F.col("_ranges").isNull(), text).otherwise(clean).alias(text_column)
    return cut.select(*[new if c == text_column else F.col(f"_row.`{c}`") for c in docs.columns])
