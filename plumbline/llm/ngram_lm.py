"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped for scoring.

Three passes over the texts: count words, count bigrams, score. What is counted moves as packed
blobs of sorted numbers, one per task and part. Each part's reducer writes sorted arrays into the
shared folder: word hashes (a word's id is its place among them), bigram keys, counts, masses.
Scoring tasks map these files into memory and look words and bigrams up by binary search, so the
model is in no task's heap and on no driver; only the list of files is.

Parts are ranges of the hash. A word that is a large share of its part's tokens has its bigrams
dealt out over all parts instead; every bigram still has one part, so all counts stay additive.

The shared folder (``spark.checkpoint.dir``) must be mounted as a path on all workers.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import in_slices, travels
from plumbline.session import scratch_path, stage

# Hashes of the end and the start of a text; words have no space in them.
END, BEGIN = xxhash.xxh3_64_intdigest(b" </s>"), xxhash.xxh3_64_intdigest(b" <s>")

# Distinct words, and tokens, that a task gathers before it sends them on.
FLUSH_WORDS, FLUSH_TOKENS = 500_000, 4_000_000

# Bytes of training text per part, at most on average: what a reducing task holds does not grow with the input.
PART_BYTES = 128 << 20

U = np.uint64

# An id takes half of a bigram's key, and the greatest one stands for unknown words.
MOST_WORDS = (1 << 32) - 1

travels(__name__)


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def local_path(address: str) -> str:
    """The mounted path of an address; memory maps need one."""
    parsed = urlparse(address)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"the shared folder must be mounted as a path, to be mapped into memory: {address}")
    return unquote(parsed.path)


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Non-negative whole numbers, byte plane by byte plane, compressed; ascending ones as differences."""
    values = values.astype(U)
    if ascending and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view(U).reshape(-1)
    return np.cumsum(values, dtype=U) if ascending else values


def smallest(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of equal values in a row."""
    edges = np.flatnonzero(np.diff(sorted_values)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(sorted_values)]):
        if b > a:
            yield int(sorted_values[a]), a, b


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sums of their values."""
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, *[np.bincount(inverse, weights=v, minlength=len(unique)).astype(U) for v in values]


class Words:
    """Numbers the words of a task as they come, and hashes each distinct one once."""

    def __init__(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.hashes: list[int] = [END, BEGIN]

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all tokens (every text ends in code 0), and the number of tokens of each text."""
        codes, pieces, sizes = self.codes, [], []
        for text in batch.column("text"):
            # On bytes, lower() and split() know A-Z and the six ASCII spaces only.
            words = text.as_py().lower().split()
            for word in words:
                if word not in codes:
                    codes[word] = len(self.hashes)
                    self.hashes.append(xxhash.xxh3_64_intdigest(word))
            pieces.extend(map(codes.__getitem__, words))
            pieces.append(0)
            sizes.append(len(words) + 1)
        return np.array(pieces, dtype=np.int64), np.array(sizes, dtype=np.int64)


def _tokens(docs: DataFrame, id_column: str, text_column: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))


def parts_for(train: DataFrame) -> int:
    """Parts for the texts of a training table."""
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


# ---- words


def _count_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), np.zeros(0, dtype=np.int64)

        def flush() -> pa.RecordBatch:
            hashes = np.array(words.hashes, dtype=U)
            c = np.zeros(len(hashes), dtype=np.int64)
            c[: len(counts)] = counts
            order = np.argsort(hashes)
            hashes, c = hashes[order], c[order]
            rows = [(p, pack(hashes[a:b], True), pack(c[a:b])) for p, a, b in runs(part_of(hashes, parts))]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))],
                names=["part", "keys", "counts"],
            )

        for batch in in_slices(batches):
            codes, _ = words.read(batch)
            seen = np.bincount(codes, minlength=len(words.hashes))
            seen[: len(counts)] += counts
            counts = seen
            if len(words.hashes) > FLUSH_WORDS:
                yield flush()
                words, counts = Words(), np.zeros(0, dtype=np.int64)
        yield flush()

    return run


def _save(folder: str, **arrays: np.ndarray) -> str:
    """Write arrays under a name of their own for each attempt; returns the prefix of the files."""
    os.makedirs(folder, exist_ok=True)
    prefix = f"{folder}/{uuid.uuid4().hex}"
    for name, values in arrays.items():
        np.save(f"{prefix}-{name}.npy", values)
    return prefix


def _write_words(folder: str):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        blobs = list(zip(rows.column("keys").to_pylist(), rows.column("counts").to_pylist()))
        hashes, counts = summed(np.concatenate([unpack(k, True) for k, _ in blobs]), np.concatenate([unpack(c) for _, c in blobs]))
        large = np.flatnonzero(counts > counts.sum() // U(4))
        return pa.table(
            {
                "part": pa.array([key[0].as_py()], pa.int32()),
                "path": [_save(folder, hashes=hashes, counts=smallest(counts))],
                "size": pa.array([len(hashes)], pa.int64()),
                "types": pa.array([int(np.count_nonzero(counts))], pa.int64()),
                "tokens": pa.array([int(counts.sum())], pa.int64()),
                "large": pa.array([[{"at": int(i), "n": int(counts[i])} for i in large]], LARGE),
            }
        )

    return run


LARGE = pa.list_(pa.field("element", pa.struct([("at", pa.int64()), ("n", pa.int64())])))
WORD_FILES = "part int, path string, size long, types long, tokens long, large array<struct<at:long,n:long>>"


@dataclass
class Vocabulary:
    """Where the sorted hashes of each part lie, and the id of each part's first word."""

    parts: int
    paths: dict[int, str]
    first: dict[int, int]
    tokens: int
    types: int
    large: np.ndarray

    @property
    def edges(self) -> np.ndarray:
        """First ids of all parts, and the id behind the last one."""
        return np.array([self.first[p] for p in range(self.parts + 1)], dtype=U)


def vocabulary(train: DataFrame, folder: str, parts: int) -> Vocabulary:
    counted = train.mapInArrow(_count_words(parts), "part int, keys binary, counts binary")
    written = stage(counted.groupBy("part").applyInArrow(_write_words(folder), WORD_FILES), "word-files")
    # One row per part.
    files = {r.part: r for r in written.collect()}
    first, at, large = {}, 0, []
    tokens = sum(r.tokens for r in files.values())
    for p in range(parts):
        first[p] = at
        if p in files:
            # Four words per part at most; only those that weigh on the whole matter.
            large += [at + x["at"] for x in files[p].large if x["n"] * 2 * parts > tokens]
            at += files[p].size
    first[parts] = at
    if at > MOST_WORDS:
        raise OverflowError(f"{at} distinct words, but ids are for {MOST_WORDS}")
    types = sum(r.types for r in files.values())
    return Vocabulary(parts, {p: r.path for p, r in files.items()}, first, tokens, types, np.array(sorted(large), dtype=U))


class Mapped:
    """Arrays in files of the shared folder, mapped into memory as they are needed."""

    def __init__(self) -> None:
        self.open: dict[str, np.ndarray] = {}

    def get(self, prefix: str, name: str) -> np.ndarray:
        path = f"{prefix}-{name}.npy"
        if path not in self.open:
            self.open[path] = np.load(path, mmap_mode="r")
        return self.open[path]


UNKNOWN = U(0xFFFFFFFF)


def word_ids(hashes: np.ndarray, vocab: Vocabulary, mapped: Mapped) -> np.ndarray:
    """Ids of hashes, ``UNKNOWN`` where the training texts have no such word."""
    ids = np.full(len(hashes), UNKNOWN, dtype=U)
    part = part_of(hashes, vocab.parts)
    order = np.argsort(part, kind="stable")
    for p, a, b in runs(part[order]):
        if p in vocab.paths:
            known, places = mapped.get(vocab.paths[p], "hashes"), order[a:b]
            wanted = hashes[places]
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            ids[places] = np.where(known[at] == wanted, at.astype(U) + U(vocab.first[p]), UNKNOWN)
    return ids


# ---- bigrams


def bigram_part(keys: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The part of a bigram: that of its first word, or one by hash if this word is a large share of all."""
    firsts = keys >> U(32)
    parts = np.searchsorted(vocab.edges, firsts, side="right") - 1
    heavy = np.isin(firsts, vocab.large)
    mixed = keys * U(0x9E3779B97F4A7C15)
    return np.where(heavy, part_of(mixed ^ (mixed >> U(29)), vocab.parts), parts)


def _pairs(ids: np.ndarray, sizes: np.ndarray, begin: np.uint64) -> np.ndarray:
    """Keys of all bigrams: the id of the word before in the upper half, of the word itself in the lower."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(sizes) - sizes] = begin
    return (before << U(32)) | ids


def _count_bigrams(vocab: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped, words, ids = Mapped(), Words(), np.zeros(0, dtype=U)
        waiting: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
            part = bigram_part(keys, vocab)
            order = np.argsort(part, kind="stable")
            keys, counts, part = keys[order], counts[order], part[order]
            rows = [(p, pack(keys[a:b], True), pack(counts[a:b])) for p, a, b in runs(part)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))],
                names=["part", "keys", "counts"],
            )

        for batch in in_slices(batches):
            codes, sizes = words.read(batch)
            if len(words.hashes) > len(ids):
                ids = np.concatenate([ids, word_ids(np.array(words.hashes[len(ids) :], dtype=U), vocab, mapped)])
            waiting.append(_pairs(ids[codes], sizes, ids[1]))
            size += len(codes)
            if size > FLUSH_TOKENS or len(ids) > FLUSH_WORDS:
                yield flush()
                words, ids, waiting, size = Words(), np.zeros(0, dtype=U), [], 0
        if waiting:
            yield flush()

    return run


FILES, STATS = 0, 1


def _write_bigrams(folder: str, vocab: Vocabulary):
    edges = vocab.edges

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        blobs = list(zip(rows.column("keys").to_pylist(), rows.column("counts").to_pylist()))
        keys, counts = summed(np.concatenate([unpack(k, True) for k, _ in blobs]), np.concatenate([unpack(c) for _, c in blobs]))
        path = _save(folder, keys=keys, counts=smallest(counts))
        of_counts = [int(np.count_nonzero(counts == n)) for n in range(1, 5)]
        out = [(FILES, key[0].as_py(), path, len(keys), of_counts, None, None)]
        before = summed(keys >> U(32), counts, counts == 1, counts == 2, counts > 2)
        after = summed(keys & UNKNOWN, np.ones(len(keys)))
        for kind, ids, values in (("before", before[0], before[1:]), ("after", after[0], after[1:])):
            for p, a, b in runs(np.searchsorted(edges, ids, side="right") - 1):
                out.append((STATS, p, kind, b - a, None, pack(ids[a:b] - edges[p], True), [pack(v[a:b]) for v in values]))
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]
        names = ["kind", "part", "path", "size", "of_counts", "ids", "values"]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, types))})

    return run


BIGRAM_FILES = "kind int, part int, path string, size long, of_counts array<long>, ids binary, values array<binary>"


def discounts(of_counts: list[int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the numbers of things counted 1 to 4 times."""
    n1, n2, n3, n4 = of_counts
    if not (n1 and n2 and n3):
        # Too little text for an estimate.
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3)))


def discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def _write_stats(folder: str, vocab: Vocabulary, d: tuple[float, float, float]):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        size = vocab.first[part + 1] - vocab.first[part]
        sums = np.zeros((5, size), dtype=U)
        for kind, ids, values in zip(*[rows.column(c).to_pylist() for c in ("path", "ids", "values")]):
            at = unpack(ids, True).astype(np.int64)
            for row, v in zip((0, 1, 2, 3) if kind == "before" else (4,), values):
                sums[row, at] += unpack(v)
        total, n1, n2, n3, after = sums
        back = (d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(total, 1)
        path = _save(folder, total=smallest(total), back=back, after=smallest(after))
        of_counts = [int(np.count_nonzero(after == n)) for n in range(1, 5)] + [int(np.count_nonzero(after > 2))]
        return pa.table({"part": pa.array([part], pa.int32()), "path": [path], "of_counts": pa.array([of_counts], pa.list_(pa.int64()))})

    return run


@dataclass
class Model:
    vocab: Vocabulary
    bigrams: dict[int, str]
    stats: dict[int, str]
    d: tuple[float, float, float]
    d_after: tuple[float, float, float]
    distinct: int
    # Share of the uniform distribution in the unigram level.
    uniform: float


def fit(train: DataFrame, folder: str, parts: int) -> Model | None:
    """Count the model of the texts (a binary column ``text``); None if there are none."""
    vocab = vocabulary(train, folder, parts)
    if not vocab.tokens:
        return None
    counted = train.mapInArrow(_count_bigrams(vocab), "part int, keys binary, counts binary")
    written = stage(counted.groupBy("part").applyInArrow(_write_bigrams(folder, vocab), BIGRAM_FILES), "bigram-files")
    files = written.where(F.col("kind") == FILES).select("part", "path", "size", "of_counts").collect()
    d = discounts([sum(r.of_counts[i] for r in files) for i in range(4)])
    stats = written.where(F.col("kind") == STATS).groupBy("part")
    stats = stage(stats.applyInArrow(_write_stats(folder, vocab, d), "part int, path string, of_counts array<long>"), "stat-files").collect()
    n1, n2, n3, n4, more = (sum(r.of_counts[i] for r in stats) for i in range(5))
    d_after, distinct = discounts([n1, n2, n3, n4]), sum(r.size for r in files)
    uniform = (d_after[0] * n1 + d_after[1] * n2 + d_after[2] * more) / distinct
    return Model(vocab, {r.part: r.path for r in files}, {r.part: r.path for r in stats}, d, d_after, distinct, uniform)


# ---- scoring


def by_id(ids: np.ndarray, vocab: Vocabulary, paths: dict[int, str], names: Iterable[str], mapped: Mapped) -> list[np.ndarray]:
    """Values of the named arrays for ids; 0 for unknown words."""
    out = [np.zeros(len(ids)) for _ in names]
    edges = vocab.edges
    known = np.flatnonzero(ids != UNKNOWN)
    part = np.searchsorted(edges, ids[known], side="right") - 1
    order = np.argsort(part, kind="stable")
    for p, a, b in runs(part[order]):
        places = known[order[a:b]]
        at = (ids[places] - edges[p]).astype(np.int64)
        for values, name in zip(out, names):
            if p in paths:
                values[places] = mapped.get(paths[p], name)[at]
    return out


def bigram_counts(keys: np.ndarray, model: Model, mapped: Mapped) -> np.ndarray:
    counts = np.zeros(len(keys))
    part = bigram_part(keys, model.vocab)
    order = np.argsort(part, kind="stable")
    for p, a, b in runs(part[order]):
        if p in model.bigrams:
            known, places = mapped.get(model.bigrams[p], "keys"), order[a:b]
            at = np.minimum(np.searchsorted(known, keys[places]), len(known) - 1)
            counts[places] = np.where(known[at] == keys[places], mapped.get(model.bigrams[p], "counts")[at], 0)
    return counts


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped, words = Mapped(), Words()
        ids = counts = total = back = level = np.zeros(0)

        for batch in in_slices(batches):
            if len(words.hashes) > FLUSH_WORDS:
                words, ids = Words(), np.zeros(0)
            codes, sizes = words.read(batch)
            starts = np.cumsum(sizes) - sizes
            if model is None:
                known, base, score = np.zeros(len(codes)), np.zeros(len(codes)), np.zeros(len(codes))
            else:
                vocab = model.vocab
                if len(ids) < len(words.hashes):
                    fresh = word_ids(np.array(words.hashes[len(ids) :], dtype=U), vocab, mapped)
                    (c,) = by_id(fresh, vocab, vocab.paths, ["counts"], mapped)
                    t, g, after = by_id(fresh, vocab, model.stats, ["total", "back", "after"], mapped)
                    lower = (after - discount(after, model.d_after)) / model.distinct + model.uniform / (vocab.types + 1)
                    if len(ids):
                        ids, counts, total = np.concatenate([ids, fresh]), np.concatenate([counts, c]), np.concatenate([total, t])
                        back, level = np.concatenate([back, g]), np.concatenate([level, lower])
                    else:
                        ids, counts, total, back, level = fresh, c, t, g, lower
                keys = _pairs(ids[codes], sizes, ids[1])
                unique, inverse = np.unique(keys, return_inverse=True)
                seen = bigram_counts(unique, model, mapped)[inverse]
                before = np.empty_like(codes)
                before[1:] = codes[:-1]
                before[starts] = 1
                followed = total[before] > 0
                upper = np.where(followed, (seen - discount(seen, model.d)) / np.maximum(total[before], 1), 0.0)
                score = np.log10(upper + np.where(followed, back[before], 1.0) * level[codes])
                known = counts[codes] > 0
                base = np.log10((counts[codes] + 1) / (vocab.tokens + vocab.types + 1))
            totals = [np.add.reduceat(v, starts) if len(starts) else np.zeros(0) for v in (known.astype(np.int64), base, score)]
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(sizes),
                    pa.array(totals[0].astype(np.int64)),
                    pa.array(np.full(n, model.vocab.tokens if model else 0, dtype=np.int64)),
                    pa.array(totals[1].astype(np.float64)),
                    pa.array(totals[2].astype(np.float64)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", parts: int | None = None) -> DataFrame:
    """Scores of all texts under a model of the texts that are not held out.

    Tokens are the words between ASCII white space, A-Z in lower case, and one end per text. A text
    is held out if the CRC-32 of its id as text leaves 2 when divided by 7 (a NULL id counts as
    empty text). ``base_score`` is the add-one unigram score; ``score`` the log10 probability under
    the model, from which perplexity is ``10 ** (-score / n_tokens)``. NULL and empty texts have one
    token, the end. Repeated rows are counted and scored as often as they occur. With no training
    text at all both scores are 0. Other columns are ignored; an empty table gives no rows.

    ``parts`` is the number of files per array: by default ``spark.sql.shuffle.partitions``, or as many
    as leave ``PART_BYTES`` of training text to each if that is more. The memory of a reducing task is
    that of the distinct bigrams of one part. More than ``MOST_WORDS`` distinct words are an error.
    """
    spark = docs.sparkSession
    folder = local_path(scratch_path(spark, "bigram-model"))
    out = held_out(F.col(id_column))
    train = _tokens(docs.where(~out), id_column, text_column)
    parts = parts or parts_for(train)
    model = fit(train, folder, parts)
    rows = _tokens(docs, id_column, text_column, F.col(id_column).cast("long").alias("doc_id"), out.alias("held_out"))
    return rows.mapInArrow(_score(model), SCORES)
