"""Secret scan: fixed patterns, and two character Markov models, in DataFrame functions only.

The models give the probability of a token's characters, each given the one before, among random
strings and among ordinary identifiers. They are counted from labelled samples of the corpus: the
values that the fixed patterns found are the random strings, long tokens made of letters and
separators only are the ordinary ones. A token, or what the patterns have left of it, whose log-likelihood ratio
per character is above a margin is reported as ``random``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import stage

# The patterns of the contract. Each letter of a key word may have either case.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
# Runs that are too short are passed over by the quantifier; a run is found from its start anyway.
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")
# The kind of tokens that are left to the models.
TOKENS = len(KINDS)

LEAST_TOKEN = 16
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
# Letters with single separators between them; without a repeated group, which would be matched by recursion.
ORDINARY, DOUBLED = r"^[A-Za-z][A-Za-z_/-]*[A-Za-z]$", r"[_/-][_/-]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
STATES = len(ALPHABET) + 1

# Labelled tokens that each model is fitted on, at most: those with the smallest hash.
SAMPLE_TOKENS = 20_000
MARGIN = 0.8
# Weight of the single characters' shares against the counts of pairs.
LEAN = 10.0


def _matches(text: Column, pattern: str) -> Column:
    """All matches, each with the number of code points since the match before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(F.split(text, pattern), F.lit(1), F.size(found)), F.length)
    return F.arrays_zip(gaps.alias("gap"), found.alias("value"))


def find_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """``row_no, doc_id`` of all rows, and ``row_no, kind, start, end, value`` of the spans of the patterns (kinds 0 to 2)
    and of other long tokens (kind 3). The value of an assignment is its second group."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    patterns = (ASSIGN, ACCESS, HEX, TOKEN)
    found = docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col(id_column).alias("doc_id"),
        *[F.when(text.rlike(p), _matches(text, p)).alias(f"m{k}") for k, p in enumerate(patterns)],
    )
    found = stage(found, "matches")
    spans = None
    for k in range(len(patterns)):
        rows = found.select("row_no", F.lit(k).alias("kind"), F.posexplode(f"m{k}").alias("pos", "m"))
        spans = rows if spans is None else spans.unionByName(rows)
    # Where a match ends: all gaps and matches up to it, added up along the text.
    along = Window.partitionBy("row_no", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.length("m.value")
    end = F.sum(F.col("m.gap") + length).over(along).cast("int")
    spans = spans.select("row_no", "kind", length.alias("n"), F.col("m.value").alias("value"), end.alias("end"))
    assign = F.col("kind") == 0
    spans = spans.select(
        "row_no",
        "kind",
        (F.col("end") - F.col("n")).alias("start"),
        "end",
        F.when(assign, F.regexp_extract("value", ASSIGN, 2)).otherwise(F.col("value")).alias("value"),
    )
    least = F.when(assign, 12).when(F.col("kind") == 1, 18).otherwise(LEAST_TOKEN)
    return found.select("row_no", "doc_id"), stage(spans.where(F.length("value") >= least), "spans")


def uncovered(spans: DataFrame) -> DataFrame:
    """``row_no, start, end, value`` of the parts of long tokens that no pattern covers.

    Starts and ends of spans are passed in the order of their places; between two neighbouring
    places there is a token or not, and a pattern span or not.
    """
    token = F.col("kind") == TOKENS
    bound = F.struct("start", "value")
    places = spans.select(
        "row_no",
        F.inline(
            F.array(
                F.struct(F.col("start").alias("at"), token.cast("int").alias("token"), (~token).cast("int").alias("base"), F.when(token, bound).alias("held")),
                F.struct(F.col("end").alias("at"), (-token.cast("int")).alias("token"), (-(~token).cast("int")).alias("base"), F.lit(None).cast("struct<start:int,value:string>").alias("held")),
            )
        ),
    )
    places = places.groupBy("row_no", "at").agg(F.sum("token").alias("token"), F.sum("base").alias("base"), F.max("held").alias("held"))
    along = Window.partitionBy("row_no").orderBy("at")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = places.select(
        "row_no",
        F.col("at").alias("start"),
        F.lead("at").over(along).alias("end"),
        F.sum("token").over(so_far).alias("token"),
        F.sum("base").over(so_far).alias("base"),
        F.last("held", ignorenulls=True).over(so_far).alias("held"),
    )
    parts = places.where((F.col("token") > 0) & (F.col("base") == 0) & (F.col("end") - F.col("start") >= LEAST_TOKEN))
    # Tokens are ASCII: taken as bytes, a part costs its own length.
    part = F.substring(F.col("held.value").cast("binary"), F.col("start") - F.col("held.start") + 1, F.col("end") - F.col("start"))
    return parts.select("row_no", "start", "end", part.cast("string").alias("value"))


def _states(token: Column) -> Column:
    """The numbers of the states of a token's characters; 0 for one outside the alphabet."""
    return F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)))


def train(spans: DataFrame, sample_tokens: int = SAMPLE_TOKENS) -> list[float]:
    """Log-likelihood ratios (random against ordinary) of all pairs of states, row by row.

    The counts come back as one row per label and pair, a few thousand at most. With no samples
    at all both models are even and no token is reported.
    """
    v = F.col("value")
    tokens = spans.where((F.col("kind") == TOKENS) & v.rlike(ORDINARY) & ~v.rlike(DOUBLED)).select(v.alias("v"))
    secrets = spans.where(F.col("kind") < TOKENS).select(v.alias("v"))
    labelled = [
        rows.distinct().orderBy(F.xxhash64("v"), "v").limit(sample_tokens).select(F.lit(label).alias("label"), "v")
        for label, rows in (("random", secrets), ("ordinary", tokens))
    ]
    states = labelled[0].unionByName(labelled[1]).select("label", _states(F.col("v")).alias("s"))
    n = F.size("s") - 1
    pairs = F.zip_with(F.slice("s", F.lit(1), n), F.slice("s", F.lit(2), n), lambda a, b: a * STATES + b)
    pairs = states.where(n > 0).select("label", F.explode(pairs).alias("pair"))
    counts = {"random": {}, "ordinary": {}}
    for r in pairs.groupBy("label", "pair").count().collect():
        counts[r["label"]][r["pair"]] = r["count"]
    if not counts["random"] or not counts["ordinary"]:
        return [0.0] * (STATES * STATES)
    logs = {}
    for label, seen in counts.items():
        total = sum(seen.values())
        ends = [sum(seen.get(a * STATES + b, 0) for a in range(STATES)) for b in range(STATES)]
        single = [(n + 0.5) / (total + 0.5 * STATES) for n in ends]
        starts = [sum(seen.get(a * STATES + b, 0) for b in range(STATES)) for a in range(STATES)]
        # Pairs that are rare in the samples lean on how frequent the second character is.
        logs[label] = [
            math.log((seen.get(a * STATES + b, 0) + LEAN * single[b]) / (starts[a] + LEAN))
            for a in range(STATES)
            for b in range(STATES)
        ]
    return [r - o for r, o in zip(logs["random"], logs["ordinary"])]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per pair of characters, in one pass over them."""
    table = F.split(F.lit(",".join(repr(x) for x in model)), ",").cast("array<double>")
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def add(acc: Column, state: Column) -> Column:
        more = F.when(acc["last"] < 0, 0.0).otherwise(F.element_at(table, F.greatest(acc["last"], F.lit(0)) * STATES + state + 1))
        return F.struct(state.alias("last"), (acc["sum"] + more).alias("sum"))

    return F.aggregate(_states(token), zero, add, lambda acc: acc["sum"]) / (F.length(token) - 1)


def scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    sample_tokens: int = SAMPLE_TOKENS,
    margin: float = MARGIN,
) -> DataFrame:
    """One row per document row: ``doc_id, base, spans``, spans as (start, kind, end, value).

    ``base`` are the pattern spans (kinds 0 to 2 of ``KINDS``); ``spans`` has them too, with the
    parts of tokens that only the models found (kind 3, ``random``). Where a pattern span lies in a token, what is
    left of the token on both sides is judged by itself. Start and end count code points of the
    whole text. NULL counts as empty, an empty text has no spans, other columns are ignored,
    repeated rows are rows of their own. Time is linear in a text's length and its spans, but for sorting them.
    """
    rows, spans = find_spans(docs, id_column, text_column)
    model = train(spans, sample_tokens)
    odd = uncovered(spans).where(ratio(F.col("value"), model) > margin).withColumn("kind", F.lit(TOKENS))
    both = spans.where(F.col("kind") < TOKENS).unionByName(odd)
    span = F.struct("start", "kind", "end", "value")
    listed = both.groupBy("row_no").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") < TOKENS, span))).alias("base"),
        F.sort_array(F.collect_list(span)).alias("spans"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    found = rows.join(listed, "row_no", "left")
    return found.select("doc_id", *[F.coalesce(F.col(c), none).alias(c) for c in ("base", "spans")])


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "random")])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{name}") for i, name in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )

