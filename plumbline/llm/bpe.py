"""Byte-pair encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the bytes cuts texts into chunks, so that a passage gives the same chunks
wherever it stands. Chunk hashes are counted over the corpus first. A chunk that occurs once is
encoded where its document is read, together with its neighbours; a chunk that occurs in several
places is sent to one task, encoded there once, and its ids go back to all its documents.

Chunks end anywhere, also inside a word. Where two pieces of a document meet, the parts of the
word that the cut runs through are encoded together; if this disagrees with the pieces, the
ids at the join are replaced. Over pieces without white space the word stays open, and is encoded once, when its
end is found. Words between ASCII white space are encoded independently by the tokenizer, so this
gives exactly the ids of the whole text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SLICE_BYTES, in_slices, travels
from plumbline.llm.words import Memory, spread
from plumbline.session import stage

MIN_CHUNK, MAX_CHUNK = 256, 8_192
# The hash must begin with so many zero bits at a cut: chunks of about 1.3 kB.
CUT_BITS = 10

# Words that are given to the tokenizer as one text, with a special token between them, and texts per call.
JOINED_WORDS, JOINED_TEXTS = 100, 20

# Words that a task remembers in each of two generations.
MEMORY_WORDS = 100_000

# Bits of the filter of shared chunk hashes: 16 per hash, 4 MB at most. A fuller filter only
# sends more chunks on the way of shared ones.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 25

_GEAR = np.frombuffer(b"".join(sha256(bytes([b])).digest()[:4] for b in range(256)), dtype="<u4").astype(np.uint32)

travels(__name__)


class Encoder:
    """The tokenizer of a task; ids are little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        settings = json.loads(tokenizer_json)
        # Special tokens cut a text before anything else is done to it, so they keep words apart.
        added = settings["added_tokens"]
        self.specials = [t["content"] for t in added]
        self.between = next(((t["content"], t["id"]) for t in added if t["special"] and not t["lstrip"] and not t["rstrip"]), None)
        # Without a decoder the text is the tokens, joined by spaces.
        self.shown = None
        if settings["decoder"] is None:
            n = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self.shown = pa.array([self.tokenizer.id_to_token(i) for i in range(n)])
        self.memory = Memory(MEMORY_WORDS)

    def fresh(self, words: list[str]) -> list[bytes]:
        """Ids of words that are not remembered."""
        alone = [self.between is None or any(t in w for t in self.specials) for w in words]
        together = [w for w, a in zip(words, alone) if not a]
        found = iter(self._together(together))
        single = iter(self.tokenizer.encode_batch_fast([w for w, a in zip(words, alone) if a], add_special_tokens=False))
        return [np.array(next(single).ids, dtype="<u4").tobytes() if a else next(found) for a in alone]

    def _together(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        text, mark = self.between
        lists = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        out = []
        groups = [lists[i : i + JOINED_TEXTS] for i in range(0, len(lists), JOINED_TEXTS)]
        encoded = (self.tokenizer.encode_batch_fast([text.join(x) for x in g], add_special_tokens=False) for g in groups)
        for held, e in zip(lists, chain.from_iterable(encoded)):
            ids = np.array(e.ids, dtype="<u4")
            cuts = np.flatnonzero(ids == mark).tolist()
            if len(cuts) != len(held) - 1:
                raise AssertionError("words must stay apart")
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip([0, *[c + 1 for c in cuts]], [*cuts, len(ids)])]
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts; each distinct word between white space is looked up once."""
        if not texts:
            return []
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        found = self.memory(coded.dictionary.to_pylist(), self.fresh)
        store = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        counts = sizes[codes]
        data = store[spread(starts[codes], counts)].tobytes()
        ends = (4 * np.concatenate([[0], np.cumsum(counts)])[bounds - bounds[0]]).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def decode(self, ids: list[bytes]) -> list[str]:
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        if self.shown is not None:
            bounds = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids], dtype=np.int64)])
            tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), self.shown.take(pa.array(flat)))
            return pc.binary_join(tokens, " ").to_pylist()
        lists = [np.frombuffer(i, dtype="<u4").tolist() for i in ids]
        return self.tokenizer.decode_batch(lists, skip_special_tokens=False)


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """Where the chunks of each text end. A cut hangs on the 32 bytes before it and on the last cut alone."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    rolling = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        # Each round doubles the number of bytes that the hash covers.
        rolling[width:] += rolling[:-width] << np.uint32(width)
    starting = (data & 0xC0) != 0x80
    candidates = np.flatnonzero(rolling >> np.uint32(32 - CUT_BITS) == 0) + 1
    found, base, at = [], 0, 0
    candidates = candidates.tolist()
    for text in texts:
        end, last, ends = base + len(text), base, []

        def close(cut: int) -> None:
            nonlocal last
            while cut < end and not starting[cut]:
                cut += 1
            ends.append(cut - base)
            last = cut

        while at < len(candidates) and candidates[at] < end:
            cut, at = candidates[at], at + 1
            while cut - last > MAX_CHUNK:
                close(last + MAX_CHUNK)
            if cut - last >= MIN_CHUNK:
                close(cut)
        while end - last > MAX_CHUNK:
            close(last + MAX_CHUNK)
        if last < end:
            ends.append(end - base)
        found.append(ends)
        while at < len(candidates) and candidates[at] <= end:
            at += 1
        base = end
    return found


def _pieces(texts: list[bytes], ends: list[list[int]]) -> Iterator[tuple[list[bytes], list[int]]]:
    for text, cuts in zip(texts, ends):
        chunks = [text[a:b] for a, b in zip([0, *cuts], cuts)]
        yield chunks, [xxhash.xxh3_64_intdigest(c) for c in chunks]


def signed(hashes: list[int]) -> list[int]:
    return np.array(hashes, dtype=np.uint64).view(np.int64).tolist()


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        texts = batch.column("text").to_pylist()
        hashes = [h for _, row in _pieces(texts, chunk_ends(texts)) for h in row]
        values, counts = np.unique(np.array(hashes, dtype=np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["chunk", "n"])


def shared_filter(shared: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter (two bits per hash) of the shared chunks; its size is bounded."""
    bits = 1 << 16
    while bits < FILTER_BITS * n and bits < MOST_FILTER_BITS:
        bits *= 2
    places = F.explode(F.array(F.pmod(F.col("chunk"), F.lit(bits)), F.pmod(F.shiftright("chunk", 32), F.lit(bits)))).alias("p")
    words = shared.select(places).groupBy(F.shiftright("p", 6).alias("w"))
    table = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[table.column("w").to_numpy()] = table.column("v").to_numpy()
    return out.view(np.uint64)


def may_be_shared(hashes: list[int], shared: np.ndarray) -> np.ndarray:
    h = np.array(hashes, dtype=np.uint64).view(np.int64)
    held = np.ones(len(h), dtype=bool)
    for p in (h % (len(shared) * 64), (h >> 32) % (len(shared) * 64)):
        held &= (shared[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
    return held


DONE, OWN, SHARED = 0, 1, 2
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string, decoded string"
PIECES = (
    "row_no long, doc_id long, seq int, kind int, chunk long, salt int, "
    f"text binary, ids binary, head binary, tail binary, {RESULT}"
)
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
_PIECE_NAMES, _PIECE_TYPES = zip(*[(n, _KINDS[k]) for n, k in (f.split() for f in PIECES.split(", "))])
_BLANK = (None,) * 4


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def edges(text: bytes) -> tuple[bytes, bytes | None]:
    """What stands before the first and behind the last white space; (text, None) if there is none."""
    words = text.split()
    if len(words) == 1 and len(words[0]) == len(text):
        return text, None
    head = b"" if not words or text[:1].isspace() else words[0]
    tail = b"" if not words or text[-1:].isspace() else words[-1]
    return head, tail


def results(encoder: Encoder, ids: list[bytes], full: bool) -> Iterator[tuple]:
    """``ids`` and the columns of ``RESULT``; ids and decoded text only if they are wanted."""
    for i, decoded in zip(ids, encoder.decode(ids)):
        digests = sha256(i).hexdigest(), sha256(decoded.encode()).hexdigest()
        yield (i if full else None), (len(i) // 4, *digests, decoded if full else None)


def _cut(tokenizer_json: str, shared: np.ndarray, hot: dict[int, int], full: bool):
    """Documents in; results of those without shared chunks, else own pieces with ids and shared chunks with text out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_json)
        for batch in in_slices(batches):
            # Texts to encode go to the tokenizer together; rows name them by number.
            texts, rows, wanted, single = batch.column("text").to_pylist(), [], [], []
            numbers, doc_ids = batch.column("row_no").to_pylist(), batch.column("doc_id").to_pylist()
            for text, row_no, doc_id, (chunks, hashes) in zip(texts, numbers, doc_ids, _pieces(texts, chunk_ends(texts))):
                held = may_be_shared(hashes, shared) if hashes else np.zeros(0, dtype=bool)
                if not held.any():
                    single.append((row_no, doc_id, len(wanted)))
                    wanted.append(text)
                    continue
                own: list[bytes] = []
                seq = 0

                def close() -> None:
                    nonlocal seq
                    if own:
                        piece = b"".join(own)
                        rows.append((row_no, doc_id, seq, OWN, None, None, None, len(wanted), *edges(piece), *_BLANK))
                        wanted.append(piece)
                        seq += 1
                        own.clear()

                for chunk, key, is_held in zip(chunks, signed(hashes), held):
                    if is_held:
                        close()
                        rows.append((row_no, doc_id, seq, SHARED, key, row_no % hot.get(key, 1), chunk, None, None, None, *_BLANK))
                        seq += 1
                    else:
                        own.append(chunk)
                close()
            encoded = encoder.encode(wanted)
            rows = [r if r[3] == SHARED else (*r[:7], encoded[r[7]], *r[8:]) for r in rows]
            for (row_no, doc_id, _), (ids, result) in zip(single, results(encoder, [encoded[x[2]] for x in single], full)):
                rows.append((row_no, doc_id, 0, DONE, None, None, None, ids, None, None, *result))
            yield _batch(rows, _PIECE_NAMES, _PIECE_TYPES)

    return run


def _encode_shared(tokenizer_json: str):
    """Rows sorted by chunk: equal chunks follow each other and are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last, known = Encoder(tokenizer_json), None, ()
        for batch in in_slices(batches):
            rows = list(zip(*[batch.column(c).to_pylist() for c in _PIECE_NAMES]))
            # The text itself is compared, not its hash.
            before = [last, *[r[6] for r in rows]]
            fresh = [i for i, r in enumerate(rows) if r[6] != before[i]]
            encoded = dict(zip(fresh, encoder.encode([rows[i][6] for i in fresh])))
            for i, row in enumerate(rows):
                if i in encoded:
                    last = row[6]
                    known = (encoded[i], *edges(last))
                rows[i] = (*row[:6], None, *known, *_BLANK)
            yield _batch(rows, _PIECE_NAMES, _PIECE_TYPES)

    return run


class Joiner:
    """Puts the ids of pieces together and repairs the joins.

    ``ids`` ends with the ids of ``tail``, the word that may go on. Pieces without white space belong to it
    and wait in ``open``, as texts; they are encoded with it when its end is known.
    """

    def __init__(self, encoder: Encoder) -> None:
        self.encoder, self.ids, self.tail = encoder, bytearray(), b""
        self.open: list[bytes] = []

    def add(self, ids: bytes, head: bytes, tail: bytes | None) -> None:
        if tail is None:
            self.open.append(head)
            return
        self.ids += ids[self._close(ids, head) :]
        self.tail = tail

    def _close(self, ids: bytes, head: bytes) -> int:
        """Ends the open word with ``head``; how much of ``ids`` it has taken."""
        if not self.open and not (self.tail and head):
            return 0
        before, after, joined = self.encoder.encode([self.tail, head, b"".join([self.tail, *self.open, head])])
        self.open.clear()
        if not (self.ids.endswith(before) and ids.startswith(after)):
            raise AssertionError("pieces must begin and end with the ids of their outer words")
        if joined == before + after:
            return 0
        del self.ids[len(self.ids) - len(before) :]
        self.ids += joined
        return len(after)

    def finish(self) -> bytes:
        self._close(b"", b"")
        return bytes(self.ids)


def _assemble(tokenizer_json: str, full: bool):
    types = [pa.int64(), pa.binary(), pa.int64(), *[pa.string()] * 3]
    names = ["doc_id", "ids", *[f.split()[0] for f in RESULT.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = Encoder(tokenizer_json), None

        def out(done: list[tuple]) -> pa.RecordBatch:
            made = results(encoder, [d[1] for d in done], full)
            return _batch([(doc_id, ids, *result) for (doc_id, _), (ids, result) in zip(done, made)], names, types)

        for batch in in_slices(batches, column="ids"):
            done, size = [], 0
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("row_no", "doc_id", "ids", "head", "tail")]))
            # The words at most joins, in one call.
            joins = [(x[4], y[3]) for x, y in zip(rows, rows[1:]) if x[0] == y[0] and x[4] and y[3]]
            for begin in range(0, len(joins), 1000):
                encoder.encode([w for a, b in joins[begin : begin + 1000] for w in (a, b, a + b)])
            for row_no, doc_id, ids, head, tail in rows:
                if held and held[0] != row_no:
                    done.append((held[1], held[2].finish()))
                    held, size = None, size + len(done[-1][1])
                    if size >= SLICE_BYTES:
                        yield out(done)
                        done, size = [], 0
                held = held or (row_no, doc_id, Joiner(encoder))
                held[2].add(ids, head, tail)
            if done:
                yield out(done)
        if held:
            yield out([(held[1], held[2].finish())])

    return run


def encode_documents(
    docs: DataFrame,
    tokenizer_json: str,
    full: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Ids of every text, and the text that they decode to.

    ``tokenizer_json`` is the content of the tokenizer's file; truncation, padding and added
    special tokens are off. The columns are ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with
    ``full``, ``ids`` (little-endian unsigned 32-bit numbers) and ``decoded``. NULL counts as empty, an empty text has no ids; repeated rows and ids
    give a row each; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_column).cast("long").alias("doc_id"), text)
    counted = rows.select("text").mapInArrow(_count_chunks, "chunk long, n long")
    shared = stage(counted.groupBy("chunk").agg(F.sum("n").alias("n")).where("n > 1"), "shared-chunks")
    whole = shared.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    # Chunks with more than a part of a task's fair share of places are dealt out to several tasks;
    # there are at most four times as many of them as partitions.
    share = max(whole.total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), 100)
    hot = {r.chunk: -(-r.n // share) for r in shared.where(F.col("n") > share).collect()}
    held = shared_filter(shared, whole.n)

    cut = stage(rows.mapInArrow(_cut(tokenizer_json, held, hot, full), PIECES), "pieces")
    chunks = cut.where(F.col("kind") == SHARED).repartition("chunk", "salt").sortWithinPartitions("chunk")
    encoded = chunks.mapInArrow(_encode_shared(tokenizer_json), PIECES)
    columns = ["row_no", "doc_id", "seq", "ids", "head", "tail"]
    pieces = cut.where(F.col("kind") == OWN).select(*columns).unionByName(encoded.select(*columns))
    ordered = pieces.repartition("row_no").sortWithinPartitions("row_no", "seq")
    joined = ordered.mapInArrow(_assemble(tokenizer_json, full), f"doc_id long, ids binary, {RESULT}")
    done = cut.where(F.col("kind") == DONE).select(*joined.columns).unionByName(joined)
    digests = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return done.select(*digests, "ids", "decoded") if full else done.select(*digests)
