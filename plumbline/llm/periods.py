"""Periodic runs of words, by a dictionary of basic factors.

For each power of two ``L``, the factors of ``L`` words of a document get names; equal factors have equal
names. The names for ``2L`` are made from pairs of names for ``L``, and factors that occur once drop out,
as do all longer ones that hold them. Successive occurrences of a factor within its own length are steps of an
arithmetic progression and propose their distance as a period; distances of up to ``L / 2`` have been
proposed by shorter factors, so only those above it are taken. In a run with smallest period
``q`` and at least three of them, and ``L`` the least power of two from ``q`` on, every factor
that ends at least ``q`` before the run's end recurs after exactly ``q`` words. So proposals at
neighbouring places with one distance extend each other to the whole run, and each run is found
once: two runs have different periods or stand apart, and a run's period belongs to one ``L``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import in_slices, travels

# A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3

RUN = "struct<start:long,length:long,period:long>"
RESULT = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"

travels(__name__)


def find_runs(names: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS):
    """Start, length and period of all runs of a row of words, given by numbers, in no order.

    Documents may follow each other if no number occurs in two of them. ``least_periods`` must be 3 or more.
    """
    if least_periods < 3:
        raise ValueError("runs of fewer than three periods are not found by this method")
    found = [np.zeros((0, 3), dtype=np.int64)]
    total, length = len(names), 1
    places, keys = np.arange(total), names.astype(np.int64)
    while len(places):
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        same = keys[1:] == keys[:-1]
        step = places[1:] - places[:-1]
        proposing = same & (step <= length) & (2 * step > length)
        at, period = places[:-1][proposing], step[proposing]
        if len(at):
            order = np.argsort(at)
            at, period = at[order], period[order]
            breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(period) != 0))
            first, last = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(at) - 1]])
            size = at[last] + period[last] + length - at[first]
            kept = size >= np.maximum(least_words, least_periods * period[first])
            found.append(np.stack([at[first], size, period[first]], axis=1)[kept])
        # Factors of twice the length, where both halves occur more than once.
        repeated = np.zeros(len(places), dtype=bool)
        repeated[1:] |= same
        repeated[:-1] |= same
        name = np.concatenate([[0], np.cumsum(~same)])
        dense = np.full(total, -1, dtype=np.int64)
        dense[places[repeated]] = name[repeated]
        places = np.flatnonzero(dense[: max(total - length, 0)] >= 0)
        second = dense[places + length]
        places, second = places[second >= 0], second[second >= 0]
        keys = dense[places] * (len(name) + 1) + second
        length *= 2
    return np.concatenate(found).T


def _scan(least_words: int, least_periods: int, collapse: bool):
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            split = pc.ascii_split_whitespace(batch.column("text"))
            words, doc = split.flatten(), pc.list_parent_indices(split).to_numpy().astype(np.int64)
            filled = pc.not_equal(words, "")
            words, doc = words.filter(filled), doc[filled.to_numpy(zero_copy_only=False)]
            n = np.bincount(doc, minlength=len(batch)).astype(np.int64)
            begin = np.cumsum(n) - n
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int64)
            start, size, period = find_runs(doc * (len(coded.dictionary) + 1) + codes, least_words, least_periods)
            order = np.lexsort((period, start))
            start, size, period = start[order], size[order], period[order]
            of = doc[start] if len(start) else np.zeros(0, np.int64)
            edges = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(batch)))])
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start - begin[of], size, period)], fields=list(item))
            listed = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), runs)
            if collapse:
                # What a run holds after its first period goes.
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + size, -1)
                kept = np.cumsum(change[:-1]) == 0
                left = np.bincount(doc[kept], minlength=len(batch))
                ends = pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32())
                rest = words if kept.all() else words.filter(pa.array(kept))
                texts = pc.binary_join(pa.ListArray.from_arrays(ends, rest), " ")
            else:
                texts = pa.nulls(len(batch), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), listed, texts], names=names)

    return run


def detect_runs(
    docs: DataFrame,
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
    collapse: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document row: ``doc_id, n_words, runs, collapsed``.

    Words are what ASCII white space separates, numbered from 0. A run is a longest stretch of words in which
    words ``period`` apart are the same, for its smallest such period, with at least ``least_words`` words and
    ``least_periods`` periods; ``runs`` has them by start, then period. ``collapsed`` is the text, joined by single
    spaces, without the words that a run holds after its first period (NULL unless ``collapse``). NULL counts
    as empty; an empty text has no words, no runs and an empty collapsed text; repeated rows are rows of
    their own; other columns are ignored; an empty table gives no rows. A text is held by one task,
    with about 30 times its size.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).alias("text")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text)
    return rows.mapInArrow(_scan(least_words, least_periods, collapse), RESULT)


def best_run(runs: Column) -> Column:
    """The run of the greatest length in periods; the first, then the one of the least period, on ties."""

    def better(a: Column, b: Column) -> Column:
        mine, other = b["length"] * a["period"], a["length"] * b["period"]
        return F.when(a.isNull() | (mine > other), b).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)
