"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

A document is its token ids and an end id. Documents longer than a sequence are cut into whole
sequences and one shorter piece at the front. How many pieces there are of each length is a table
of at most ``capacity`` rows; best fit, longest first, runs over these counts and places many equal
pieces at a time. The plan says, for a range of ranks among the pieces of one length, in which
sequences they stand and where. Pieces get their rank within their length from the part of the table they are
in, and take the planned slot by a join on length and rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import give_back, in_slices, is_small, travels
from plumbline.llm.words import ByteLevelWords, spread
from plumbline.session import stage

CAPACITY = 1_024
END_ID = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, place long"
PLAN = "length long, first_rank long, past_rank long, first_sequence long, per_sequence long, first_offset long"

travels(__name__)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Best fit over counts of lengths, longest first; rows of ``PLAN``.

    Sequences of equal content are held as groups (first number, how many) by the room that is
    left. A piece goes where the least room remains; as long as it fits, that is the sequence
    that took the piece before it, so a group takes as many pieces per sequence as fit. Groups are split at
    most once per length, so their number hangs on ``capacity`` and not on the documents.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    rows, sequences = [], 0

    def add(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        placed, n = 0, histogram[length]
        while placed < n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fresh = -(-(n - placed) // (capacity // length))
                add(capacity, sequences, fresh)
                sequences += fresh
                continue
            left = rooms[at]
            first, count = room[left].pop()
            if not room[left]:
                del room[left]
                rooms.pop(at)
            each = left // length
            full = min(count, (n - placed) // each)
            rest = 0 if full == count else (n - placed) - full * each
            if full:
                rows.append((length, placed, placed + full * each, first, each, capacity - left))
                add(left - each * length, first, full)
            if rest:
                rows.append((length, placed + full * each, n, first + full, rest, capacity - left))
                add(left - rest * length, first + full, 1)
            used = full + (1 if rest else 0)
            add(left, first + used, count - used)
            placed += full * each + rest
    return rows


def _pieces(tokenizer_json: str, capacity: int, end_id: int, full: bool):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    names = [f.split()[0] for f in PIECES.split(", ")]

    def packed(words: ByteLevelWords, batch: pa.RecordBatch, part: int, seen: np.ndarray) -> pa.RecordBatch:
        ids, sizes = words.encode(batch.column("text"))
        totals = sizes + 1
        ends = np.cumsum(totals)
        flat = np.full(int(totals.sum()), end_id, dtype="<u4")
        flat[spread(ends - totals, sizes)] = ids
        # Pieces of each document; all but the first are whole sequences.
        n = -(-totals // capacity)
        doc = np.repeat(np.arange(len(n)), n)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        first = (totals - (n - 1) * capacity)[doc]
        start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
        length = np.where(piece == 0, first, capacity)
        begin = (ends - totals)[doc] + start
        data = memoryview(flat).cast("B")
        cut = [data[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist())]
        # Running numbers of the pieces of each length in this task.
        order = np.argsort(length, kind="stable")
        counts = np.bincount(length, minlength=capacity + 1)
        place = np.empty(len(length), dtype=np.int64)
        place[order] = spread(seen[counts > 0], counts[counts > 0])
        seen += counts
        columns = [
            batch.column("doc_id").take(pa.array(doc)),
            piece,
            start,
            length,
            [zlib.crc32(c) for c in cut],
            [bytes(c) for c in cut] if full else pa.nulls(len(cut), pa.binary()),
            np.full(len(cut), part),
            place,
        ]
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ByteLevelWords(tokenizer_json, leading=False, plain_specials=False)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        batch = None
        for batch in in_slices(batches):
            yield packed(words, batch, part, seen)
        # Nor does a worker that waits keep the vocabulary and the words of its last task.
        del words, batch
        give_back()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_json: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    full: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, with
    ``full``, ``ids`` (little-endian unsigned 32-bit numbers).

    ``tokenizer_json`` is the content of a byte-level tokenizer's file. ``start`` counts the ids of the document
    before the piece, ``offset`` those of the sequence. NULL counts as empty; an empty text is one piece with the
    end id alone; repeated rows and ids are packed each for itself; other columns are ignored; an empty
    table gives no rows.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).alias("text")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text)
    pieces = stage(rows.mapInArrow(_pieces(tokenizer_json, capacity, end_id, full), PIECES), "packing-pieces")

    # Rank within a length: the pieces of earlier parts, and the place in the own part.
    held = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    # As many rows as there are counts.
    before = F.broadcast(before) if is_small(held, F.lit(64)) else before
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))

    # The plan's size is bounded by the capacity.
    slots = docs.sparkSession.createDataFrame(plan(histogram, capacity), PLAN)
    ours = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("past_rank"))
    slots = slots.withColumnRenamed("length", "planned")
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("planned")) & ours)
    nth = F.col("rank") - F.col("first_rank")
    found = placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.expr("(rank - first_rank) div per_sequence")).alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("per_sequence") * F.col("length")).alias("offset"),
        "ids",
    )
    return found if full else found.drop("ids")
