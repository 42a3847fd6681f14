"""Language identification by Bayesian fusion of text, declared language, address and host.

log P(language | all) is, up to a constant, the sum of
- the text's log-likelihood under a byte-trigram model of the language, tempered because
  neighbouring trigrams are not independent;
- log P(declared language | language) and log P(address suffix | language), where there are any;
- the log of the host's prior: declared languages counted per host by grouped aggregation, smoothed
  towards the host's domain, and that towards the whole corpus. A host without a domain is smoothed
  towards the corpus at once.

A further class, ``und``, stands for text that is in none of the languages.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import give_back, in_slices, slices, small_side, travels
from plumbline.session import stage

LANGUAGES = ("de", "en", "es", "fr")

# Address suffixes that tell a language.
SUFFIX_LANGUAGE = {
    "at": "de", "au": "en", "ar": "es", "cl": "es", "co": "es", "de": "de", "es": "es", "fr": "fr",
    "ie": "en", "mx": "es", "nz": "en", "uk": "en", "us": "en",
}

# Distinct labelled texts per language that the text models are fitted on, about.
SAMPLE_ROWS = 2_000
BUCKETS = 1 << 16
# Bytes of text that are scored at a time; the arrays for them take some thirty times as much.
SCORED_BYTES = 256 << 10
TEMPER = 0.2
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.8
HOST_WEIGHT = 5.0
# Log-probability of a trigram in text of no known language, and prior of that class.
FOREIGN, FOREIGN_PRIOR = -10.0, 0.01
MIN_PROBABILITY = 0.5

travels(__name__)

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigram_buckets(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Bucket of the trigram at each byte, whether it has a letter, where each text's trigrams begin and
    end, and whether the text has a letter at all."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    folded = np.concatenate([_FOLD[data], np.full(2, 32, dtype=np.uint32)])
    code = (folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]
    buckets = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    letters = np.concatenate([[0], np.cumsum(folded[:-2] != 32)])
    return buckets, code != 0x202020, starts, np.maximum(ends - 2, starts), letters[ends] > letters[starts]


def _count(languages: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in in_slices(batches):
            labels, weights = batch.column("label").to_pylist(), batch.column("weight").to_pylist()
            buckets, real, starts, ends, _ = trigram_buckets(batch.column("text"))
            for label, weight, a, b in zip(labels, weights, starts, ends):
                counts[languages.index(label)] += weight * np.bincount(buckets[a:b][real[a:b]], minlength=BUCKETS)
        for language, row in zip(languages, counts):
            seen = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(seen), pa.string()), pa.array(seen), pa.array(row[seen])], names=["label", "bucket", "n"]
            )

    return run


def base_language(tag: Column) -> Column:
    """``fr`` of ``fr-CA``; NULL for no tag."""
    short = F.lower(F.regexp_extract(F.coalesce(tag.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when(short != "", short)


def fit_texts(labelled: DataFrame, languages: Sequence[str] = LANGUAGES, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Log-probabilities, languages x buckets, from a sample of (``label``, ``text``) rows.

    The sample are the distinct texts with the smallest hash, about ``sample_rows`` of each language:
    each doubling of a text's copies counts as one more text, so thousands of copies weigh as much as
    a dozen texts. The counts come back as ``BUCKETS`` rows per language at most.
    """
    text = F.coalesce("text", F.lit(""))
    labelled = labelled.where(F.col("label").isin(*languages)).select("label", text.alias("text"), F.xxhash64(text).alias("key"))
    sizes = {r.label: r.n for r in labelled.groupBy("label").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()}
    share = F.lit(0)
    for language, n in sizes.items():
        share = F.when(F.col("label") == language, F.lit(int(min(1.0, sample_rows / n) * (1 << 32)))).otherwise(share)
    drawn = labelled.where(F.pmod("key", F.lit(1 << 32)) < share)
    drawn = drawn.groupBy("label", "key").agg(
        F.min("text").cast("binary").alias("text"), F.length(F.bin(F.count("*"))).alias("weight")
    )
    counted = drawn.mapInArrow(_count(languages), "label string, bucket long, n long")
    counts = np.full((len(languages), BUCKETS), 0.5)
    for r in counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[languages.index(r.label), r.bucket] += r.n
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def host_priors(rows: DataFrame, languages: Sequence[str] = LANGUAGES, weight: float = HOST_WEIGHT) -> DataFrame:
    """``host, prior``: one array per host and domain, from (``host``, ``domain``, ``declared``) rows."""
    counts = [F.count(F.when(F.col("declared") == x, 1)).alias(f"n{i}") for i, x in enumerate(languages)]
    names = [f"n{i}" for i in range(len(languages))]
    by_host = stage(rows.where(F.col("host").isNotNull()).groupBy("host", "domain").agg(*counts), "hosts")
    # The host counts are far fewer than rows, and are added up further.
    by_domain = by_host.groupBy("domain").agg(*[F.sum(n).alias(f"d{n}") for n in names])
    whole = by_host.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    total = sum(whole)
    overall = [(n + 1) / (total + len(languages)) for n in whole]

    def smoothed(counted: list[Column], towards: list[Column]) -> list[Column]:
        n = sum(counted, F.lit(0))
        return [(c + F.lit(weight) * t) / (n + F.lit(weight)) for c, t in zip(counted, towards)]

    corpus = [F.lit(p) for p in overall]
    domain = smoothed([F.col(f"d{n}") for n in names], corpus)
    parent = [F.when(F.col("domain").isNull(), c).otherwise(d) for c, d in zip(corpus, domain)]
    host = smoothed([F.col(n) for n in names], parent)
    return by_host.join(by_domain, "domain", "left").select("host", F.array(*host).alias("prior"))


def _identified(
    docs: DataFrame,
    text: Column,
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    domain: Column | None = None,
    languages: Sequence[str] = LANGUAGES,
    sample_rows: int = SAMPLE_ROWS,
    min_probability: float = MIN_PROBABILITY,
) -> DataFrame:
    """``_row``, a struct of the row, and ``_language``; see ``identify``."""
    languages = list(languages)
    nothing = F.lit(None).cast("string")
    declared = base_language(declared if declared is not None else nothing)
    host = host if host is not None else nothing
    suffix = F.lower(suffix) if suffix is not None else nothing
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        text.alias("text"),
        declared.alias("declared"),
        suffix.alias("suffix"),
        host.alias("host"),
        F.nullif(domain if domain is not None else nothing, F.lit("")).alias("domain"),
    )
    model = fit_texts(rows.select(F.col("declared").alias("label"), "text"), languages, sample_rows)
    priors = stage(host_priors(rows.select("host", "domain", "declared"), languages), "host-priors")
    # Per host, not per (host, domain): a host has one domain, or its first.
    priors = priors.groupBy("host").agg(F.min("prior").alias("prior")).withColumnRenamed("host", "_host")
    priors = small_side(stage(priors, "host-prior"), F.octet_length("_host") + 8 * len(languages) + 32)
    spread = F.map_from_entries(
        F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in SUFFIX_LANGUAGE.items()])
    )
    joined = rows.join(priors, F.col("host") == F.col("_host"), "left")
    told = F.element_at(spread, F.col("suffix"))

    def evidence(tag: Column, right: float) -> list[Column]:
        wrong = (1 - right) / max(len(languages) - 1, 1)
        known = tag.isin(*languages)
        return [F.when(known, F.when(tag == x, F.log(F.lit(right))).otherwise(F.log(F.lit(wrong)))).otherwise(0.0) for x in languages]

    flat = F.log(F.lit(1.0 / len(languages)))
    by_source = zip(evidence(F.col("declared"), DECLARED_RIGHT), evidence(told, SUFFIX_RIGHT))
    fused = [F.coalesce(F.log(F.col("prior")[i]), flat) + a + F.coalesce(b, F.lit(0.0)) for i, (a, b) in enumerate(by_source)]
    kind = T.StructType([T.StructField("language", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def scored(texts: pa.Array, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best class and its probability of each text."""
        buckets, real, starts, ends, letters = trigram_buckets(texts)

        def per_text(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
            return sums[ends] - sums[starts]

        scores = np.empty((len(texts), len(languages) + 1))
        for i, row in enumerate(model):
            scores[:, i] = TEMPER * per_text(np.where(real, row[buckets], 0)) + logs[i]
        scores[:, -1] = TEMPER * FOREIGN * per_text(real) + np.log(FOREIGN_PRIOR)
        scores[~letters, :-1] = -np.inf
        chances = np.exp(scores - scores.max(axis=1, keepdims=True))
        chances /= chances.sum(axis=1, keepdims=True)
        return chances.argmax(axis=1), chances.max(axis=1)

    def posterior(texts: pa.Array, *logs: pa.Array) -> pa.Array:
        prior = np.stack([x.to_numpy(zero_copy_only=False) for x in logs])
        give_back()
        parts = [scored(texts.slice(a, b - a), prior[:, a:b]) for a, b in slices(texts, SCORED_BYTES)]
        best = np.concatenate([np.zeros(0, dtype=np.int64), *[p[0] for p in parts]])
        top = np.concatenate([np.zeros(0), *[p[1] for p in parts]])
        names = [*languages, "und"]
        fields = [
            pa.array([names[b] for b in best], pa.string()),
            pa.array(top),
            pa.array((best < len(languages)) & (top >= min_probability)),
        ]
        return pa.StructArray.from_arrays(fields, names=["language", "probability", "accepted"])

    fuse = F.arrow_udf(posterior, kind)
    return joined.select("_row", fuse(F.coalesce("text", F.lit("")).cast("binary"), *fused).alias("_language"))


def identify(docs: DataFrame, text: Column, *evidence: Column | None, **options) -> DataFrame:
    """The rows with a column ``_language``: struct of ``language``, ``probability`` and ``accepted``.

    ``evidence`` are the columns ``declared, suffix, host, domain``, as far as there are any.
    ``declared`` is the language tag in the markup or metadata; it also labels the rows for the text
    models, so at least some rows need one. Missing or unknown tags, suffixes and hosts are no
    evidence. NULL and empty texts and texts without a letter are ``und`` with probability 1. A row
    is accepted if its language is one of ``languages`` with ``min_probability`` or more. Ties go
    to the language that comes first. Repeated rows get the same result; an empty table gives none.
    A column ``_language`` of ``docs`` is replaced. Options are ``languages``, ``sample_rows`` and
    ``min_probability``.
    """
    found = _identified(docs, text, *evidence, **options)
    return found.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c != "_language"], "_language")


def _document_evidence(docs: DataFrame) -> tuple[Column, ...]:
    source = F.col("source").cast("string")
    suffix = F.element_at(F.split(source, r"\."), -1)
    return F.col("text"), F.col("lang"), suffix, source, F.regexp_extract(source, r"([^.]+\.[^.]+)$", 1)


def document_languages(docs: DataFrame) -> DataFrame:
    """``documents`` with ``_language``: ``lang`` is what is declared, ``source`` the host, its last two names the domain."""
    return identify(docs, *_document_evidence(docs))


def keep_accepted(docs: DataFrame, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """The documents in one of the known languages, with all their columns as they are."""
    found = _identified(docs, *_document_evidence(docs), min_probability=min_probability)
    return found.where("_language.accepted").select("_row.*")


def page_languages(pages: DataFrame) -> DataFrame:
    """``pages`` with ``_language``: declared in the html element, suffix, host and domain from the url."""
    html = F.coalesce(F.col("html"), F.lit(""))
    tag = F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[A-Za-z0-9#]+;", " ")
    return identify(pages, plain, tag, F.element_at(F.split(host, r"\."), -1), host, domain)
