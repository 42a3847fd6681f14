"""Alignment of two tokenizers by divide and conquer at shared cuts, and counts of linked ids.

Both tokenizers cut the same bytes. Where tokens of both end is a shared cut. An interval of tokens is
divided at a shared cut near its middle: the end of the token of the first tokenizer there is
looked up among the ends of the second one by bisection, then those of its neighbours, outwards.
Both halves go on in the same way, and an interval without a shared cut inside is a group. An end that
was looked up is not looked up again, so the work is linear in the tokens (times the bisection). All
intervals of a slice of the documents are divided side by side.

Two tokens whose bytes overlap are linked. A pair of ids counts the documents that hold it linked. The
counts of the frequent pairs go to all tasks, as many as fit a bound; what is linked by rarer pairs
is joined with their counts by a shuffle, in which no pair can be frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import in_slices, travels
from plumbline.llm.words import ByteLevelWords, PieceWords, spread
from plumbline.session import stage

# Pairs of ids whose counts are sent to all tasks, at most: 17 bytes each.
MOST_SENT = 1_500_000

# A pair of ids is one number: the first id times this, and the second id.
PAIR = 1 << 32

ALIGNED = (
    "row_no long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, "
    "pairs array<long>, times array<int>"
)
COUNTED = ALIGNED.replace("pairs array<long>, times array<int>", "n_best long, count_sum long")
REST = "row_no long, pair long, times int"

travels(__name__)


def shared_groups(ends_a: np.ndarray, ends_b: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray) -> np.ndarray:
    """Groups of tokens between neighbouring shared cuts: rows of (first a, past a, first b, past b), in order.

    ``ends_a`` and ``ends_b`` are the byte offsets at which tokens end, over all documents in a row; ``docs_a`` and
    ``docs_b`` are the numbers of the tokens with which documents begin, and the number of all tokens.
    """
    a0, a1, b0, b1 = docs_a[:-1], docs_a[1:], docs_b[:-1], docs_b[1:]
    filled = a1 > a0
    a0, a1, b0, b1 = a0[filled], a1[filled], b0[filled], b1[filled]
    # Tokens a0 < c < a1 may begin a half; those from low to before high have not been looked up.
    low, high, probes = a0 + 1, a1, np.zeros(len(a0), dtype=np.int64)
    groups = []
    while len(a0):
        size = high - low
        whole = (size - probes <= 0) | (b1 - b0 == 1)
        if whole.any():
            groups.append(np.stack([a0, a1, b0, b1], axis=1)[whole])
            open_ = ~whole
            a0, a1, b0, b1, low, high, probes, size = (x[open_] for x in (a0, a1, b0, b1, low, high, probes, size))
        if not len(a0):
            break
        # From the middle outwards: +0, -1, +1, -2, +2, ... covers the window [low, high).
        away = (probes + 1) // 2
        at = (low + high) // 2 + np.where(probes % 2 == 1, -away, away)
        end = ends_a[at - 1]
        hit_b = np.searchsorted(ends_b, end)
        hit = ends_b[hit_b] == end
        probes = probes + 1
        if hit.any():
            # What was looked up lies around the middle: left of the cut or right of it.
            h = np.flatnonzero(hit)
            middle, odd = (low[h] + high[h]) // 2, (probes[h] - 1) % 2 == 1
            cut, cut_b = at[h], hit_b[h] + 1
            # A cut at middle - k comes after looks at [middle - k + 1, middle + k), one at middle + k after [middle - k, middle + k).
            left_high = np.where(odd, cut, 2 * middle - cut)
            right_low = np.where(odd, 2 * middle - cut, cut + 1)
            miss = ~hit
            a0, a1, b0, b1 = (
                np.concatenate([x[miss], y, z])
                for x, y, z in ((a0, a0[h], cut), (a1, cut, a1[h]), (b0, b0[h], cut_b), (b1, cut_b, b1[h]))
            )
            low, high, probes = (
                np.concatenate([low[miss], low[h], right_low]),
                np.concatenate([high[miss], left_high, high[h]]),
                np.concatenate([probes[miss], np.zeros(2 * len(h), dtype=np.int64)]),
            )
    if not groups:
        return np.zeros((0, 4), dtype=np.int64)
    found = np.concatenate(groups)
    return found[np.argsort(found[:, 0])]


def overlaps(groups: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens a and b whose bytes overlap. They overlap within their group only."""
    a0, a1, b0, b1 = groups.T
    single = (a1 - a0 == 1) & (b1 - b0 == 1)
    rest = groups[~single]
    in_a, in_b = spread(rest[:, 0], rest[:, 1] - rest[:, 0]), spread(rest[:, 2], rest[:, 3] - rest[:, 2])
    # Each stretch between two ends of either kind belongs to one token of each kind.
    ends = np.union1d(ends_a[in_a], ends_b[in_b])
    return (
        np.concatenate([a0[single], np.searchsorted(ends_a, ends)]),
        np.concatenate([b0[single], np.searchsorted(ends_b, ends)]),
    )


class Table:
    """Bytes of the tokens by id."""

    def __init__(self, token_bytes: list[bytes]) -> None:
        self.bytes = pa.array(token_bytes, pa.binary())
        self.sizes = np.array([len(t) for t in token_bytes], dtype=np.int64)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return _data(self.bytes.take(pa.array(ids)))


def _data(texts: pa.Array) -> np.ndarray:
    """The bytes of all texts in a row."""
    if not len(texts):
        return np.zeros(0, np.uint8)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if ends[0] == ends[-1]:
        return np.zeros(0, np.uint8)
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the ranges between bounds, which may be empty."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


class Aligner:
    """Both tokenizers of a task."""

    def __init__(self, tokenizer_json: str, piece_model: bytes) -> None:
        self.a = ByteLevelWords(tokenizer_json, leading=True, plain_specials=True)
        self.b = PieceWords(piece_model)
        self.table_a, self.table_b = Table(self.a.token_bytes), Table(self.b.token_bytes)
        self.n_a, self.n_b = len(self.a.token_bytes), len(self.b.token_bytes)
        # Ids as text with what may follow them.
        shown = [f"{i}{sep}" for sep in (",", "|") for i in range(self.n_a)]
        shown += [f"{i}{sep}" for sep in (",", ";", "") for i in range(self.n_b)]
        self.shown = pa.array(shown)

    def encode(self, texts: pa.Array):
        """Ids of both tokenizers and bounds of the documents; documents whose bytes differ have no ids."""
        data = pc.binary_join_element_wise("", texts, " ")
        wanted = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
        usable = wanted > 1
        made = []
        for words, table in ((self.a, self.table_a), (self.b, self.table_b)):
            ids, counts = words.encode(texts)
            made.append((ids, counts, table))
            usable &= _sums(table.sizes[ids], _bounds(counts)) == wanted
        for ids, counts, table in made:
            # Documents of the right size: their bytes lie side by side.
            own = np.repeat(usable, counts)
            differs = table.joined(ids[own]) != _data(data.filter(pa.array(usable)))
            bad = _sums(differs, _bounds(wanted[usable])) > 0
            usable[np.flatnonzero(usable)[bad]] = False
        out = []
        for ids, counts, _ in made:
            out += [ids[np.repeat(usable, counts)].astype(np.int64), _bounds(np.where(usable, counts, 0))]
        return out

    def show(self, groups, ids_a, ids_b, docs_a, docs_b) -> pa.Array:
        """The groups of each document as text: ``a1,a2|b1;a3|b2,b3``."""
        a0, a1, b0, b1 = groups.T
        out = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        group_a, group_b = np.repeat(np.arange(len(groups)), a1 - a0), np.repeat(np.arange(len(groups)), b1 - b0)
        out[np.arange(len(ids_a)) + b0[group_a]] = ids_a
        out[a1 - 1 + b0] += self.n_a
        out[np.arange(len(ids_b)) + a1[group_b]] = ids_b + 2 * self.n_a
        out[a1 + b1 - 1] += self.n_b
        last = (docs_a + docs_b)[1:][np.diff(docs_a + docs_b) > 0] - 1
        out[last] += self.n_b
        bounds = pa.array(docs_a + docs_b, pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(bounds, self.shown.take(pa.array(out))), "")


def _align(tokenizer_json: str, piece_model: bytes, full: bool):
    names = [f.split()[0] for f in ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizer_json, piece_model)
        for batch in in_slices(batches):
            ids_a, docs_a, ids_b, docs_b = aligner.encode(batch.column("text"))
            ends_a, ends_b = np.cumsum(aligner.table_a.sizes[ids_a]), np.cumsum(aligner.table_b.sizes[ids_b])
            groups = shared_groups(ends_a, ends_b, docs_a, docs_b)
            a, b = overlaps(groups, ends_a, ends_b)
            doc = np.repeat(np.arange(len(batch)), np.diff(docs_a))
            n_groups = np.bincount(doc[groups[:, 0]], minlength=len(batch))
            n_links = np.bincount(doc[a], minlength=len(batch))
            # Pairs of each document: documents are sorted apart by sorting numbers of (document, a, b).
            pair = (doc[a] * aligner.n_a + ids_a[a]) * aligner.n_b + ids_b[b]
            distinct, times = np.unique(pair, return_counts=True)
            of, second = distinct // aligner.n_b, distinct % aligner.n_b
            of, first = of // aligner.n_a, of % aligner.n_a
            bounds = pa.array(_bounds(np.bincount(of, minlength=len(batch))), pa.int32())
            shown = aligner.show(groups, ids_a, ids_b, docs_a, docs_b)
            digests = [sha256(s.as_buffer()).hexdigest() if n else "" for s, n in zip(shown.cast(pa.binary()), np.diff(docs_a))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_no"),
                    batch.column("doc_id"),
                    *[pa.array(x, pa.int64()) for x in (np.diff(docs_a), np.diff(docs_b), n_groups, n_links)],
                    shown if full else pa.nulls(len(batch), pa.string()),
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(bounds, pa.array(first * PAIR + second)),
                    pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32())),
                ],
                names=names,
            )

    return run


def align(
    docs: DataFrame,
    tokenizer_json: str,
    piece_model: bytes,
    full: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document row, written once: its numbers of tokens, groups and links, the groups as text
    (NULL unless ``full``) and their digest, and the distinct pairs of linked ids with how often each occurs."""
    text = F.coalesce(F.col(text_column), F.lit("")).alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_column).cast("long").alias("doc_id"), text)
    return stage(rows.mapInArrow(_align(tokenizer_json, piece_model, full), ALIGNED), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: the documents that hold a pair linked, and whether no other pair of its first id has more."""
    counted = stage(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    first = F.shiftright("pair", 32).alias("first")
    most = counted.groupBy(first).agg(F.max("n").alias("most"))
    joined = counted.withColumn("first", first).join(most, "first")
    return stage(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-table")


def frequent(counts: DataFrame, most_sent: int) -> tuple[int, bool]:
    """The least count from which on pairs are sent to all tasks (a power of two), and whether these are all pairs."""
    bits = (F.length(F.bin("n")) - 1).alias("bits")
    held = {r.bits: r["count"] for r in counts.groupBy(bits).count().collect()}
    least, total = 64, 0
    for b in sorted(held, reverse=True):
        if total + held[b] > most_sent:
            return least, False
        least, total = b, total + held[b]
    return least, True


def _columns(batch: pa.RecordBatch):
    pairs = batch.column("pairs")
    bounds = pairs.offsets.to_numpy().astype(np.int64)
    pairs, times = pairs.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
    return pairs, times, bounds - bounds[0]


def _count(sent):
    """Sums over the links of each document, of the pairs that were sent."""
    names = [f.split()[0] for f in COUNTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        for batch in batches:
            pairs, times, bounds = _columns(batch)
            sums = [np.zeros(len(batch), np.int64)] * 2
            if len(keys):
                at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                times = np.where(keys[at] == pairs, times, 0)
                sums = [_sums(times * best[at], bounds), _sums(times * n[at], bounds)]
            columns = [*[batch.column(c) for c in names[:-2]], *[pa.array(s, pa.int64()) for s in sums]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _rest(sent):
    """Links of the pairs that were not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = sent.value[0]
        for batch in batches:
            pairs, times, bounds = _columns(batch)
            rows = np.repeat(batch.column("row_no").to_numpy(), np.diff(bounds))
            if len(keys):
                other = keys[np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)] != pairs
                rows, pairs, times = rows[other], pairs[other], times[other]
            columns = [pa.array(rows), pa.array(pairs), pa.array(times, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in REST.split(", ")])

    return run


def link_counts(aligned: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """``aligned`` without its pairs, with ``n_best`` and ``count_sum`` over the links of each document.

    ``n_best`` counts links whose pair is held linked by as many documents as any other pair of its first id;
    ``count_sum`` adds up the documents over the links.
    """
    counts = pair_counts(aligned)
    least, all_sent = frequent(counts, most_sent)
    limit = F.lit(1 << least if least < 63 else (1 << 63) - 1)
    table = counts.where(F.col("n") >= limit).toArrow()
    keys = table.column("pair").to_numpy()
    order = np.argsort(keys)
    arrays = tuple(table.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
    sent = aligned.sparkSession.sparkContext.broadcast(arrays)
    found = aligned.mapInArrow(_count(sent), COUNTED)
    if all_sent:
        return found.drop("row_no")
    rare = aligned.select("row_no", "pairs", "times").mapInArrow(_rest(sent), REST)
    rare = rare.join(counts.where(F.col("n") < limit), "pair")
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
    sums = rare.groupBy("row_no").agg(best.alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_count"))
    more = lambda held, extra: (F.col(held) + F.coalesce(F.col(extra), F.lit(0))).alias(held)
    both = found.join(sums, "row_no", "left")
    kept = [c for c in found.columns if c not in ("row_no", "n_best", "count_sum")]
    return both.select(*kept, more("n_best", "more_best"), more("count_sum", "more_count"))


def align_tokenizers(
    docs: DataFrame,
    tokenizer_json: str,
    piece_model: bytes,
    full: bool = True,
    most_sent: int = MOST_SENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, groups_sha256``.

    The first tokenizer is the content of a byte-level file of the tokenizers library and encodes a space
    and the text; the second one is a SentencePiece model, which adds the space itself. Special tokens'
    strings are plain text. Texts that are NULL or empty, or whose tokens do not spell their bytes, have no
    tokens: zeros, and an empty text for groups and digest. Repeated rows and ids are documents of their
    own; other columns are ignored; an empty table gives no rows.
    """
    found = link_counts(align(docs, tokenizer_json, piece_model, full), most_sent)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"]
    return found.select(*columns) if full else found.select(*[c for c in columns if c != "groups"])
