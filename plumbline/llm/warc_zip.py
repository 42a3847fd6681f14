"""Web archives packed into ZIP files: writer, and a reader by byte ranges.

An archive holds one or more ``archive/*.warc.gz`` (a gzip member per WARC record) and
``indexes/*`` (CDXJ or CDX lines, plain or in gzip blocks), all stored, not deflated. A reader
finds them through the central directory, with ZIP64 where needed, and reads byte ranges; nothing
is extracted. An index only says where a member may be cut into ranges, so records that it does
not list are read as well. This writer packs one member and a sorted CDXJ index.

Files are opened through ``pyarrow.fs`` by their address, so archives may lie in any store that
it knows. The archives go below ``spark.checkpoint.dir``, which executors share.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import travels
from plumbline.session import scratch_path, stage

ARCHIVE, INDEXES = "archive/", "indexes/"
DATA, INDEX = f"{ARCHIVE}data.warc.gz", f"{INDEXES}index.cdx"
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
BLOCK = 1 << 20
OUT_BYTES = 16 << 20
RANGES_PER_TASK = 4
MOST_TASKS = 50_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

travels(__name__)


# ---- writing


class _Stream:
    """What zipfile needs of a file it cannot seek in."""

    def __init__(self, raw) -> None:
        self.raw = raw

    def write(self, data) -> int:
        self.raw.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        self.raw.flush()


def warc_record(page_id, url, payload: bytes, owner, revisit: bool) -> bytes:
    name = lambda p: f"<urn:page:{'null' if p is None else p}>"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}"]
    headers += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        headers.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        headers += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(owner)}"]
    else:
        block += payload
    headers += [f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sort_key(url: str | None) -> str:
    """The address with its host turned round, by which an index is sorted."""
    if url is None:
        return "-"
    try:
        parts = urlsplit(url)
        host = parts.hostname
    except ValueError:
        host = None
    if not host:
        return url.lower()
    port = parts.netloc.rpartition("@")[2].partition(":")[2] if host.count(":") == 0 else ""
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return (",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + tail).lower()


def _index_line(record: bytes, at: int, size: int) -> str:
    fields = _fields(record[: record.index(b"\r\n\r\n")])
    url = fields.get("warc-target-uri")
    shown = {"url": url} if url is not None else {}
    shown |= {"digest": fields["warc-payload-digest"], "length": str(size), "offset": str(at), "filename": DATA[len(ARCHIVE) :]}
    stamp = "".join(c for c in fields["warc-date"] if c.isdigit())
    return f"{sort_key(url)} {stamp} {json.dumps(shown)}\n"


def write_archive(address: str, records: Iterable[bytes], archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Write records until the archive is large enough; the number of records written."""
    store, path = pafs.FileSystem.from_uri(address)
    places, at = [], 0
    with store.open_output_stream(path, compression=None) as raw, zipfile.ZipFile(_Stream(raw), "w", zipfile.ZIP_STORED) as packed:
        with packed.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
            for record in records:
                squeezer = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = squeezer.compress(record) + squeezer.flush()
                member.write(data)
                places.append(_index_line(record, at, len(data)))
                at += len(data)
                if at >= archive_bytes:
                    break
        with packed.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
            member.write("".join(sorted(places)).encode())
    return len(places)


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                names = ("page_id", "url", "payload", "owner", "revisit")
                for row in zip(*[batch.column(n) for n in names]):
                    yield warc_record(*[v.as_py() for v in row])

        store, path = pafs.FileSystem.from_uri(folder)
        source = records()
        for first in source:
            store.create_dir(path, recursive=True)
            # A name of its own for each attempt: only files in the written list are ever read.
            address = f"{folder}/{uuid.uuid4().hex}.wacz"
            # A chain, unlike a generator, leaves the source open when the archive is full.
            count = write_archive(address, chain([first], source), archive_bytes)
            yield pa.RecordBatch.from_arrays([pa.array([address]), pa.array([count], pa.int64())], names=["address", "records"])

    return run


def _sha(payload: Column) -> Column:
    return F.sha2(payload, 256)


def write_pages(pages: DataFrame, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page into archives and return ``address, records`` of each archive.

    Of the pages with equal html of at least ``min_revisit_bytes`` bytes, the one with the largest
    ``page_id`` is stored, the others only refer to it (rows that share this id are all stored).
    NULL html counts as empty, a NULL url gives no target address, a NULL id is smaller than all
    others. Other columns are ignored; an empty table gives no archives.

    Only groups of two or more are joined back, as a written table that Spark broadcasts if it is
    below its threshold; otherwise the join splits a hot group.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), _sha(payload).alias("key"))
    large = rows.where(F.octet_length("payload") >= min_revisit_bytes)
    owners = large.groupBy("key").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    owners = stage(owners.select(F.col("key").alias("_key"), "owner"), "owners").withColumn("known", F.lit(True))
    joined = rows.join(owners, F.col("key") == F.col("_key"), "left")
    revisit = F.col("known").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    cells = joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "payload", F.col("owner").cast("long").alias("owner"), revisit.alias("revisit"))
    folder = scratch_path(pages.sparkSession, "archives")
    return stage(cells.mapInArrow(_writer(folder, archive_bytes), "address string, records long"), "archive-list")


# ---- reading


def read_range(source, at: int, size: int) -> bytes:
    source.seek(at)
    data = source.read(size)
    if len(data) != size:
        raise ValueError("the archive is cut short")
    return data


def central_directory(source) -> dict[str, tuple[int, int, int]]:
    """Members by name: (compression method, offset of the data, stored size)."""
    total = source.size()
    tail_size = min(total, 22 + 65535)
    tail = read_range(source, total - tail_size, tail_size)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) - end < 22 or struct.unpack_from("<H", tail, end + 20)[0] != len(tail) - end - 22):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, size, offset = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = read_range(source, total - tail_size + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = read_range(source, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, size, offset = struct.unpack_from("<QQQ", record, 32)
    directory, at, members = read_range(source, offset, size), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, place = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while place + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, place)
            if kind == 1:
                # Only the fields that do not fit are there, in this order.
                values = iter(struct.unpack_from(f"<{length // 8}Q", extra, place + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            place += 4 + length
        local = read_range(source, header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        members[name] = (method, header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        at += 46 + n_name + n_extra + n_comment
    return members


def _open(address: str):
    store, path = pafs.FileSystem.from_uri(address)
    return store.open_input_file(path)


def _blocks(source, at: int, size: int) -> Iterator[bytes]:
    for block in range(at, at + size, BLOCK):
        yield read_range(source, block, min(BLOCK, at + size - block))


def _unpacked(blocks: Iterable[bytes]) -> Iterator[tuple[bytes, bool]]:
    """What gzip members hold, piece by piece, and whether a member ends there."""
    unpacker, open_member = zlib.decompressobj(31), False
    for block in blocks:
        while block:
            data, open_member = unpacker.decompress(block), True
            block = b""
            if unpacker.eof:
                block, unpacker, open_member = unpacker.unused_data, zlib.decompressobj(31), False
            yield data, not open_member
    if open_member:
        raise ValueError("a gzip member is cut short")


def _lines(blocks: Iterable[bytes]) -> Iterator[bytes]:
    rest = b""
    for block in blocks:
        *lines, rest = (rest + block).split(b"\n")
        yield from lines
    yield rest


def index_entries(lines: Iterable[bytes]) -> Iterator[tuple[str, int]]:
    """File name and offset of each line of a CDXJ or CDX index."""
    order = None
    for line in lines:
        text = line.decode().rstrip("\r")
        if not text.strip() or text.startswith("!"):
            continue
        if text.lstrip().startswith("CDX "):
            order = text.split()[1:]
            continue
        if order is not None:
            cells = dict(zip(order, text.split()))
            name, offset = cells.get("g"), cells.get("V")
        else:
            try:
                cells = json.loads(text[text.index("{") :])
            except ValueError:
                raise ValueError(f"no index line: {text[:200]}") from None
            name, offset = cells.get("filename"), cells.get("offset")
        if name is None or offset is None:
            raise ValueError(f"an index line without file or offset: {text[:200]}")
        yield name, int(offset)


def _stored(members: dict[str, tuple[int, int, int]], name: str) -> tuple[int, int]:
    method, start, size = members[name]
    if method != 0:
        raise ValueError(f"{name} is not stored")
    return start, size


def archive_ranges(source, range_bytes: int = RANGE_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of whole records, each of about ``range_bytes``, over all WARC members.

    Of each stretch of ``range_bytes`` only the first offset in the indexes is held, in any order of
    their lines. A member that no index names is one range. Archives without a WARC member,
    members that are deflated or no ``.warc.gz``, and indexes that cannot be read are errors.
    """
    members = central_directory(source)
    wanted = [n for n in members if n.startswith(ARCHIVE) and not n.endswith("/")]
    if not wanted:
        raise ValueError("the archive has no WARC member")
    if other := [n for n in wanted if not n.endswith(".warc.gz")]:
        raise ValueError(f"{other[0]} is no .warc.gz")
    places = {n: _stored(members, n) for n in wanted}
    firsts: dict[str, dict[int, int]] = {n: {} for n in wanted}
    for name in members:
        kind = name.removesuffix(".gz")
        if not name.startswith(INDEXES) or not kind.endswith((".cdx", ".cdxj")):
            continue  # a summary of an index, say
        blocks: Iterable[bytes] = _blocks(source, *_stored(members, name))
        if kind != name:
            blocks = (data for data, _ in _unpacked(blocks))
        for file, offset in index_entries(_lines(blocks)):
            member = file if file in firsts else ARCHIVE + file
            if member not in firsts or not 0 <= offset < places[member][1]:
                raise ValueError(f"{name} names a place outside the archive: {file} {offset}")
            slot = offset // range_bytes
            firsts[member][slot] = min(offset, firsts[member].get(slot, offset))
    for member, (start, size) in places.items():
        cuts = sorted({0, *firsts[member].values()})
        yield from ((start + a, b - a) for a, b in zip(cuts, [*cuts[1:], size]) if b > a)


def gzip_members(source, at: int, size: int) -> Iterator[bytes]:
    """What the gzip members of a range hold: a record each, as a rule."""
    parts: list[bytes] = []
    for data, ended in _unpacked(_blocks(source, at, size)):
        parts.append(data)
        if ended:
            yield b"".join(parts)
            parts.clear()


def _fields(lines: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first of equal names counts."""
    found: dict[str, str] = {}
    for line in lines.decode(errors="replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found.setdefault(name.strip().lower(), value.strip())
    return found


def split_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        fields = _fields(data[at:head])
        end = head + 4 + int(fields["content-length"])
        if end > len(data):
            raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        yield fields, data[head + 4 : end]
        at = end
        while data.startswith(b"\r\n", at):
            at += 2


PAGE = "<urn:page:"


def _page(name: str | None) -> int | None:
    value = name[len(PAGE) : -1] if name and name.startswith(PAGE) else "null"
    return None if value == "null" else int(value)


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _fits(stated: str, data: bytes) -> bool:
    """Whether a labelled digest is that of the data; digests of unknown kinds cannot be told."""
    label, _, value = stated.partition(":")
    label = label.lower().replace("-", "")
    if label not in ("md5", "sha1", "sha256", "sha512"):
        return True
    digest = hashlib.new(label, data, usedforsecurity=False).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == _base32(digest).rstrip("=")


def _shown_digest(stated: str | None) -> str | None:
    """A stated SHA-1 in base32 without its label; other digests as they are."""
    if stated is None or not stated.lower().startswith("sha1:"):
        return stated
    value = stated[5:]
    return _base32(bytes.fromhex(value)) if len(value) == 40 else value.upper()


def unchunked(body: bytes) -> bytes | None:
    """The body without its transfer encoding in chunks; None if it has none."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].partition(b";")[0], 16) if end > at else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            return None
        if size == 0:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _row(fields: dict[str, str], block: bytes) -> tuple:
    name, kind = fields.get("warc-record-id"), fields["warc-type"]
    stated, owner = fields.get("warc-payload-digest"), fields.get("warc-refers-to")
    if "warc-block-digest" in fields and not _fits(fields["warc-block-digest"], block):
        raise ValueError(f"block of {name} is damaged")
    payload, http = block, {}
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(head)
    if kind == "revisit":
        length = http.get("content-length", "")
        stored, size, digest = None, int(length) if length.isdigit() else None, _shown_digest(stated)
    else:
        digest = _base32(hashlib.sha1(payload).digest())
        if stated is not None and stated != f"sha1:{digest}" and not _fits(stated, payload):
            # Some writers leave the transfer encoding in what they digest, others do not.
            plain = unchunked(payload) if "chunked" in http.get("transfer-encoding", "").lower() else None
            if plain is None or not _fits(stated, plain):
                raise ValueError(f"payload of {name} is damaged")
            payload, digest = plain, _base32(hashlib.sha1(plain).digest())
        stored, size = payload, len(payload)
    return _page(name), fields.get("warc-target-uri"), kind, _page(owner), stored, size, digest, name, owner


def parse_records(data: bytes) -> Iterator[tuple]:
    """The columns of ``RECORD`` for each record, checked against its digests."""
    return (_row(*record) for record in split_records(data))


def parse_record(record: bytes) -> tuple:
    """The only record, as ``parse_records`` gives it."""
    (row,) = parse_records(record)
    return row


RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, "
    "payload_digest string, record_id string, refers_to_record string"
)


def _ranges(range_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column("address").to_pylist():
                with _open(address) as source:
                    found = list(archive_ranges(source, range_bytes))
                starts, sizes = [r[0] for r in found], [r[1] for r in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([address] * len(found), pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                    names=["address", "start", "size"],
                )

    return run


def _records(with_payload: bool):
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*[(n, kinds[k]) for n, k in (f.split() for f in RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))
            rows.clear()
            return batch

        for batch in batches:
            for address, start, size in zip(*[batch.column(c).to_pylist() for c in ("address", "start", "size")]):
                with _open(address) as source:
                    for row in (r for data in gzip_members(source, start, size) for r in parse_records(data)):
                        rows.append(row if with_payload else (*row[:4], None, *row[5:]))
                        held += 500 + (len(row[4] or b"") if with_payload else 0)
                        if held > OUT_BYTES:
                            yield flush()
                            held = 0
        yield flush()

    return run


def read_archives(archives: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the archives whose ``address`` is given, a task per few byte ranges.

    Archives of other writers are read as well: records of every type give a row, ``record_id`` and
    ``refers_to_record`` are their names, and ``page_id`` and ``refers_to`` are NULL where these name no page of
    ``write_pages``. The payload is what follows the HTTP headers, else the whole block; revisits
    have none, and a size only if their headers state one. Without ``with_payload`` payloads are read and checked
    but not returned. A damaged record, index or directory is an error, and so is an archive without
    WARC records; a member without an index is read as one range.
    """
    ranges = archives.select("address").mapInArrow(_ranges(range_bytes), "address string, start long, size long")
    # A few bytes stand for some megabytes each: they are dealt out by number, as Spark would take
    # so few bytes for a single task's work.
    ranges = stage(ranges, "ranges")
    tasks = max(1, min(-(-ranges.count() // RANGES_PER_TASK), MOST_TASKS))
    spread = ranges.repartition(tasks, "address", "start")
    return spread.mapInArrow(_records(with_payload), RECORD)
