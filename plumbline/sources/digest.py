"""SHA-256 of files of any size, hashed slice after slice.

The hash is a chain over a file's bytes in order, but its state between two bytes is small. So a task reads one slice
of a file, and the state goes on to the task of the next one; files are hashed side by side. Spark's line reader cuts
the files: their bytes are its lines with the line break put back, and the sizes show whether the last line had one.
"""

from __future__ import annotations

import _hashlib
import ctypes
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import stage

# Blocks of the line reader that begin within so many bytes make a slice. With Spark's default blocks of 128 MB or
# less, a task reads 128 MB of a file at most.
SLICE_BYTES = 64 << 20
# Bytes of a written row, and of a row on its way to Python.
CHUNK_BYTES, PIECE_BYTES = 1 << 20, 16 << 10
# The line reader leaves out a byte order mark at the start of a file.
MARK = b"\xef\xbb\xbf"

CHUNKS = "number int, slice int, block long, place long, data binary, size int"
STATES = "number int, block long, place long, data binary, left long, sha256 string"

# Workers get these functions by value, so that executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Sha256:
    """OpenSSL's SHA-256, whose state can be taken out and put back; ``hashlib`` hides it."""

    STATE_BYTES = 112  # SHA256_CTX: words of the state, of the length and of the begun block

    def __init__(self, state: bytes | None = None):
        self._library = ctypes.CDLL(getattr(_hashlib, "__file__", None))
        self._state = ctypes.create_string_buffer(state or b"", self.STATE_BYTES)
        if state is None:
            self._library.SHA256_Init(self._state)

    def update(self, data: bytes) -> None:
        self._library.SHA256_Update(self._state, ctypes.c_char_p(data), ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self._state.raw

    def hexdigest(self) -> str:
        """Of the bytes so far; the state stays."""
        out = ctypes.create_string_buffer(32)
        self._library.SHA256_Final(out, ctypes.create_string_buffer(self._state.raw, self.STATE_BYTES))
        return out.raw.hex()


def resumable() -> bool:
    """Whether Python's OpenSSL has these functions, and they give the right hash."""
    try:
        first = Sha256()
        first.update(b"a" * 100)
        then = Sha256(first.state())
        then.update(b"b" * 100)
    except (OSError, AttributeError):
        return False
    return then.hexdigest() == hashlib.sha256(b"a" * 100 + b"b" * 100).hexdigest()


def digests(listed: DataFrame, lines: DataFrame) -> DataFrame:
    """The files of ``listed`` (number from 1, file, size_bytes) with their SHA-256.

    ``lines`` are the files read by the line reader: file, block (where its block of the file begins), value.
    """
    spark = listed.sparkSession
    broken = F.concat(F.col("value").cast("binary"), F.lit(b"\n"))
    cut = f"substring(data, i * {PIECE_BYTES} + 1, {PIECE_BYTES})"
    cut = f"transform(sequence(0, (length(data) - 1) div {PIECE_BYTES}), i -> {cut})"
    pieces = F.expr(f"if(length(data) <= {PIECE_BYTES}, array(data), {cut})")
    rows = lines.join(F.broadcast(listed.select("file", "number")), "file").select("number", "block", broken.alias("data"))
    rows = rows.select("number", "block", F.explode(pieces).alias("data"))
    chunks = stage(rows.mapInArrow(_chunks, CHUNKS), "file_chunks", partition_by=["slice"])
    sizes = stage(chunks.groupBy("number", "slice").agg(F.sum("size").alias("size")), "file_sizes")
    states = _first_states(spark, listed, sizes)
    n_files = listed.count()
    for number in [r.slice for r in sizes.select("slice").distinct().orderBy("slice").collect()]:
        part = chunks.filter(F.col("slice") == number).select("number", "block", "place", "data")
        moved = states.drop("sha256").unionByName(part, allowMissingColumns=True).repartitionById(n_files, F.col("number") - 1)
        states = stage(moved.sortWithinPartitions("number", "block", "place").mapInArrow(_hashed, STATES), "file_states")
    return listed.join(F.broadcast(states.select("number", "sha256")), "number")


def _first_states(spark: SparkSession, listed: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row without a state for each file, with a mark after it where the file begins with one.

    The lines have one byte more than the file if its last line has no break, and three less if there is a mark.
    """
    totals = sizes.groupBy("number").agg(F.sum("size").alias("total"))
    apart = stage(
        listed.join(F.broadcast(totals), "number", "left").select(
            "number", "file", "size_bytes", (F.col("size_bytes") - F.coalesce("total", F.lit(0))).alias("less")
        ),
        "file_totals",
    )
    other = apart.filter(~F.col("less").isin(-1, 0, 2, 3)).first()
    if other is not None:
        raise OSError(f"{other.file}: {other.size_bytes} bytes are listed, {other.size_bytes - other.less} were read")
    marks = apart.filter("less >= 2").select("number", F.lit(1).alias("place"), F.lit(MARK).alias("data"))
    nothing = F.lit(None).cast("binary")
    first = apart.select("number", F.lit(0).alias("place"), nothing.alias("data"), F.col("size_bytes").alias("left"))
    return first.unionByName(marks, allowMissingColumns=True).select(
        "number",
        F.lit(-1).cast("long").alias("block"),
        F.col("place").cast("long").alias("place"),
        "data",
        "left",
        F.lit(None).cast("string").alias("sha256"),
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of pieces that follow each other in a block, as chunks with their place."""
    place = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers, blocks = batch.column("number").to_numpy(), batch.column("block").to_numpy()
        data = batch.column("data").cast(pa.large_binary())
        content = data.buffers()[2]
        ends = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8)
        cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(blocks) != 0)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(data)], strict=True):
            for at in range(int(ends[begin]), int(ends[end]), CHUNK_BYTES):
                part = content[at : min(at + CHUNK_BYTES, int(ends[end]))].to_pybytes()
                block = int(blocks[begin])
                yield pa.RecordBatch.from_pydict(
                    {
                        "number": pa.array([numbers[begin]], pa.int32()),
                        "slice": pa.array([block // SLICE_BYTES], pa.int32()),
                        "block": pa.array([block], pa.int64()),
                        "place": pa.array([place], pa.int64()),
                        "data": pa.array([part], pa.binary()),
                        "size": pa.array([len(part)], pa.int32()),
                    }
                )
                place += 1


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States after the chunks that follow them, and the hash where no byte is left."""
    number = sha = left = None
    for batch in batches:
        columns = [batch.column(c) for c in ("number", "data", "left")]
        for i in range(batch.num_rows):
            file, data, begun = (c[i].as_py() for c in columns)
            if begun is not None:
                if sha is not None:
                    yield _state(number, sha, left)
                number, sha, left = file, Sha256(data), begun
                continue
            sha.update(data[:left])
            left -= min(left, len(data))
    if sha is not None:
        yield _state(number, sha, left)


def _state(number: int, sha: Sha256, left: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "number": pa.array([number], pa.int32()),
            "block": pa.array([-1], pa.int64()),
            "place": pa.array([0], pa.int64()),
            "data": pa.array([sha.state()], pa.binary()),
            "left": pa.array([left], pa.int64()),
            "sha256": pa.array([None if left else sha.hexdigest()], pa.string()),
        }
    )
