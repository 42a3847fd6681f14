"""Line deduplication by sorted hash streams.

Only hashes move: a row per long line with the hash of its key, the document and the position.
They are partitioned by range of (hash, document) and sorted within, largest document first. A
line that is in a third of all documents then simply fills several neighbouring partitions. One
pass over a sorted partition sees the first occurrence of a key, the one that stays, before all
others. Only the first and the last key of a partition may go on in another one; their few
summaries, two rows per partition, are put together afterwards. What comes back to the documents
is a compressed bitmap of the lines to keep.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import give_back, in_slices, travels
from plumbline.session import stage

MIN_CHARS = 40
MIN_DOCS = 5

travels(__name__)


def _hashed(min_chars: int):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            digests, rows, positions = [], [], []
            for row, text in enumerate(batch.column("text")):
                # On bytes, lower() and strip() know A-Z and the six ASCII spaces only.
                for pos, line in enumerate(text.as_py().lower().split(b"\n")):
                    key = line.strip()
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        digests.append(blake2b(key, digest_size=16).digest())
                        rows.append(row)
                        positions.append(pos)
            hashes = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(hashes[:, 0])),
                    pa.array(np.ascontiguousarray(hashes[:, 1])),
                    batch.column("doc_id").take(taken),
                    batch.column("text_key").take(taken),
                    pa.array(positions, pa.int32()),
                ],
                schema=schema,
            )

    return run


DROP, SUMMARY, OPEN = 0, 1, 2


def _streamed(min_docs: int):
    """Sorted rows in; lines to drop, summaries of the outer keys and their undecided lines out."""
    names = ["kind", "h1", "h2", "doc_id", "text_key", "pos", "n_docs"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    schema = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first_run, runs, docs, top, last, waiting = None, True, 0, 0, None, None, []
        out: list[tuple] = []
        give_back()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("h1", "h2", "doc_id", "text_key", "pos")]
            for h1, h2, doc, text_key, pos in zip(*columns):
                if (h1, h2) != key:
                    if key and first_run:
                        out.append((SUMMARY, *key, top, None, None, docs))
                    key, first_run, runs = (h1, h2), runs == 0, runs + 1
                    docs, top, waiting = 0, doc, []
                if docs == 0 or doc != last:
                    docs, last = docs + 1, doc
                if first_run:
                    out.append((OPEN, h1, h2, doc, text_key, pos, None))
                elif docs >= min_docs:
                    out.extend((DROP, *w) for w in waiting)
                    waiting = []
                    out.append((DROP, h1, h2, doc, text_key, pos, None))
                elif docs > 1:
                    waiting.append((h1, h2, doc, text_key, pos, None))
            yield flush()
        if key:
            out.append((SUMMARY, *key, top, None, None, docs))
            out.extend((OPEN, *w) for w in waiting)
            yield flush()

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for positions in batch.column("positions"):
            gone = np.array(positions.as_py(), dtype=np.int64)
            bits = np.ones(int(gone.max()) // 8 * 8 + 8, dtype=np.uint8)
            bits[gone] = 0
            made.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(made, pa.binary())], names=["doc_id", "text_key", "keep"]
        )


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))


def keep_bitmaps(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, text_key, keep`` for every document that loses lines.

    ``keep`` is a zlib-compressed bitmap, one bit per line, most significant first; lines beyond
    its end stay. A line's key is the line without ASCII white space at both ends, A-Z in lower
    case. Keys of ``min_chars`` code points or more that are in ``min_docs`` documents or more
    stay only in the document with the largest id, there as often as they occur. NULL ids are one
    document, smaller than all others. NULL and empty texts are one empty line. Rows with the same
    id count as one document; ``text_key``, a hash of the text, tells them apart.
    """
    lines = "h1 long, h2 long, doc_id long, text_key long, pos int"
    hashed = stage(_keyed(docs, id_column, text_column).mapInArrow(_hashed(min_chars), lines), "lines")
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last()]
    ordered = hashed.repartitionByRange(*order).sortWithinPartitions(*order, "text_key", "pos")
    streamed = ordered.mapInArrow(_streamed(min_docs), f"kind int, {lines}, n_docs long")
    streamed = stage(streamed, "line-stream")
    outer = streamed.where(F.col("kind") == SUMMARY).groupBy("h1", "h2")
    # Two rows for each partition at most, whatever the number of lines.
    outer = outer.agg(F.sum("n_docs").alias("total"), F.max("doc_id").alias("keeper")).where(F.col("total") >= min_docs)
    undecided = streamed.where(F.col("kind") == OPEN).select("h1", "h2", "doc_id", "text_key", "pos")
    later = undecided.join(F.broadcast(outer), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    dropped = streamed.where(F.col("kind") == DROP).select("doc_id", "text_key", "pos")
    dropped = dropped.unionByName(later.select("doc_id", "text_key", "pos"))
    grouped = dropped.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("positions"))
    return grouped.mapInArrow(_bitmaps, "doc_id long, text_key long, keep binary")


def _applied(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            n_lines, n_dropped, results = [], [], []
            for text, keep in zip(batch.column("text"), batch.column("keep")):
                lines = text.as_py().split(b"\n")
                n_lines.append(len(lines))
                if keep.is_valid:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), dtype=np.uint8)).tolist()
                    kept = [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]
                else:
                    kept = lines
                n_dropped.append(len(lines) - len(kept))
                joined = b"\n".join(kept)
                results.append(joined if with_text else sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in batch.schema.names if c not in ("text", "keep")],
                    pa.array(n_lines, pa.int64()),
                    pa.array(n_dropped, pa.int64()),
                    pa.array(results, pa.binary() if with_text else pa.string()),
                ],
                names=[*[c for c in batch.schema.names if c not in ("text", "keep")], "n_lines", "n_dropped", "result"],
            )

    return run


def _joined(docs: DataFrame, bitmaps: DataFrame, id_column: str, text_column: str, rest: list[str]) -> DataFrame:
    """``rest`` (a struct), ``text`` and ``keep`` of every row."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"),
        F.col(id_column).alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        text.cast("binary").alias("text"),
    )
    found = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "keep")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    # The bitmaps, the smaller side, make the hash table; the texts need no sort.
    return packed.join(found.hint("shuffle_hash"), same, "left").select("rest", "text", "keep")


def _out(rows: DataFrame, kind: T.DataType) -> T.StructType:
    counts = [T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped")]
    return T.StructType([rows.schema["rest"], *counts, T.StructField("result", kind)])


def digests(docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document row, without returning texts."""
    rows = _joined(docs, bitmaps, id_column, text_column, [id_column])
    out = rows.mapInArrow(_applied(with_text=False), _out(rows, T.StringType()))
    return out.select(
        F.col(f"rest.`{id_column}`").alias("doc_id"), "n_lines", "n_dropped", F.col("result").alias("kept_sha256")
    )


def remove_lines(docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with all their columns, texts without the dropped lines; a NULL text becomes empty."""
    rows = _joined(docs, bitmaps, id_column, text_column, [c for c in docs.columns if c != text_column])
    out = rows.mapInArrow(_applied(with_text=True), _out(rows, T.BinaryType()))
    text = F.col("result").cast("string").alias(text_column)
    return out.select(*[text if c == text_column else F.col(f"rest.`{c}`") for c in docs.columns])
