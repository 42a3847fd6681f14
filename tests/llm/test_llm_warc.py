import base64
import hashlib
import zipfile

import pyarrow.fs as pafs
import pytest

from plumbline.llm import warc_zip as Z

ROWS = [
    (1, "http://a.example/", "<p>é😀</p>"),
    (2, "http://b.example/x y\r\nz", "<p>é😀</p>"),
    (3, None, None),
    (4, "", ""),
    (5, "http://c.example/", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"),
    (6, "http://d.example/", "long " * 400_000),
    (7, "http://d.example/", "long " * 400_000),
    (7, "http://d.example/again", "long " * 400_000),
    (None, "http://e.example/", "<p>é😀</p>"),
    (None, "http://f.example/", "only without id"),
    (-3, "http://g.example/", "x"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as payload", "3 as owner").repartition(3)


def expected(rows, least=0):
    rank = lambda i: (i is not None, i or 0)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "")]
        owner = max(same, key=rank)
        revisit = len(data) >= least and page_id != owner
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page_id, len(data), digest, "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5, 100])
def test_round_trip(spark, least):
    archives = Z.write_pages(pages(spark), min_revisit_bytes=least, archive_bytes=1000)
    records = Z.read_archives(archives, range_bytes=500).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records]
    assert sorted(got, key=str) == expected(ROWS, least)
    html = {(r[2] or "").encode() for r in ROWS}
    assert {bytes(r.payload) for r in records if r.record_type == "response"} == html
    assert all(r.payload is None for r in records if r.record_type == "revisit")
    assert {r.url for r in records} >= {"http://a.example/", "http://b.example/x%20y%0D%0Az", None}


def test_empty_table(spark):
    assert Z.read_archives(Z.write_pages(pages(spark, []))).count() == 0


@pytest.fixture
def records():
    return [Z.warc_record(i, "http://x/", f"payload {i}".encode() * 50, None, False) for i in range(40)]


def read_all(address, range_bytes=200):
    store, path = pafs.FileSystem.from_uri(address)
    with store.open_input_file(path) as source:
        ranges = list(Z.archive_ranges(source, range_bytes))
        return ranges, [r for at, n in ranges for r in Z.gzip_members(source, at, n)]


def test_zip_is_a_zip(tmp_path, records):
    address = f"file://{tmp_path}/a.wacz"
    assert Z.write_archive(address, records) == 40
    with zipfile.ZipFile(tmp_path / "a.wacz") as packed:
        assert packed.testzip() is None and packed.namelist() == [Z.DATA, Z.INDEX]
    ranges, got = read_all(address)
    assert got == records and len(ranges) > 5


def test_zip64(tmp_path, records, monkeypatch):
    """With low limits the library writes ZIP64 fields everywhere."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    address = f"file://{tmp_path}/b.wacz"
    Z.write_archive(address, records)
    data = (tmp_path / "b.wacz").read_bytes()
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    assert read_all(address)[1] == records


def test_other_writers(tmp_path, records):
    """A comment, members in between, and no index."""
    import gzip

    with zipfile.ZipFile(tmp_path / "c.zip", "w") as packed:
        packed.writestr("readme.txt", "PK\x05\x06" * 30, zipfile.ZIP_DEFLATED)
        packed.writestr(Z.DATA, b"".join(gzip.compress(r) for r in records))
        packed.comment = b"a comment PK\x05\x06 with a false signature"
    ranges, got = read_all(f"file://{tmp_path}/c.zip")
    assert len(ranges) == 1 and got == records


def test_damage_is_an_error(tmp_path, records):
    address = f"file://{tmp_path}/d.wacz"
    Z.write_archive(address, records)
    whole = (tmp_path / "d.wacz").read_bytes()
    (tmp_path / "d.wacz").write_bytes(whole[:-30])
    with pytest.raises(ValueError):
        read_all(address)
    with pytest.raises(ValueError):
        Z.parse_record(records[0].replace(b"payload 0", b"payload 1", 1))
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as packed:
        packed.writestr(Z.DATA, b"x" * 100, zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError):
        read_all(f"file://{tmp_path}/e.zip")


UUID = "<urn:uuid:{:08d}-0000-0000-0000-000000000000>"


def foreign(number, kind, block, content_type="application/http; msgtype=response", **fields):
    head = [f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {UUID.format(number)}\r\nWARC-Date: 2020-01-02T03:04:05Z"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items()] + [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http(body, extra=""):
    return f"HTTP/1.1 200 OK\r\nX-Name: \xe9{extra}\r\n\r\n".encode("latin-1") + body


def crawl():
    body, chunked = b"<p>one</p>", b"5\r\nhello\r\n7;x=y\r\n, world\r\n0\r\n\r\n"
    plain = hashlib.sha1(b"hello, world").hexdigest()
    block = http(b"no payload digest")
    return [
        foreign(1, "warcinfo", b"software: x\r\n", "application/warc-fields"),
        foreign(2, "request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http; msgtype=request", WARC_Target_URI="http://a/"),
        foreign(3, "response", http(body), WARC_Target_URI="http://a/", WARC_Payload_Digest=f"sha256:{hashlib.sha256(body).hexdigest()}"),
        foreign(4, "response", http(chunked, "\r\nTransfer-Encoding: chunked"), WARC_Target_URI="http://b/", WARC_Payload_Digest=f"sha1:{plain}"),
        foreign(5, "revisit", b"", WARC_Refers_To=UUID.format(4), WARC_Payload_Digest=f"sha1:{plain}", WARC_Target_URI="http://b/"),
        foreign(6, "resource", b"{}", "application/json", WARC_Target_URI="urn:x"),
        foreign(7, "response", block, WARC_Block_Digest="sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), WARC_Target_URI="http://c/"),
    ]


def pack(path, members, index=None, **more):
    """An archive of members (name: records); the index lists only responses, sorted by address."""
    import gzip
    import json

    lines, data = [], {}
    for name, records in members.items():
        at, parts = 0, []
        for record in records:
            parts.append(gzip.compress(record))
            if b"WARC-Type: response" in record:
                url = record.split(b"WARC-Target-URI: ")[1].split(b"\r\n")[0].decode()
                shown = {"url": url, "length": len(parts[-1]), "offset": at, "filename": name}
                lines.append((url, f"{Z.sort_key(url)} 20200102030405 {json.dumps(shown)}", f"{url} {len(parts[-1])} {at} {name}"))
            at += len(parts[-1])
        data[name] = b"".join(parts)
    cdxj = "".join(f"{x[1]}\n" for x in sorted(lines, reverse=True)).encode()
    cdx = (" CDX N S V g\n" + "".join(f"{x[2]}\n" for x in sorted(lines))).encode()
    indexes = {
        "cdxj": {"index.cdxj": b"!meta {}\n" + cdxj}, "cdx": {"index.cdx": cdx}, None: {},
        "gzip": {"index.cdx.gz": gzip.compress(cdxj[:100]) + gzip.compress(cdxj[100:]), "index.idx": b"a summary"},
    }
    with zipfile.ZipFile(path, "w") as packed:
        packed.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        packed.mkdir("archive")
        for name, content in data.items():
            packed.writestr(f"archive/{name}", content)
        for name, content in {**indexes[index], **more}.items():
            packed.writestr(f"indexes/{name}", content)


@pytest.mark.parametrize("index", ["cdxj", "cdx", "gzip", None])
def test_archives_of_others(spark, tmp_path, index):
    """Several members of other names, indexes that list some of the records, and all record types."""
    own = [Z.warc_record(i, "http://x/", f"payload {i}".encode() * 50, None, False) for i in range(20)]
    pack(tmp_path / "x.wacz", {"rec-0001.warc.gz": crawl(), "rec-0002.warc.gz": own}, index)
    archives = spark.createDataFrame([(f"file://{tmp_path}/x.wacz", "x")], "address string, start string")
    got = {r.record_id: r for r in Z.read_archives(archives, range_bytes=300).collect()}
    assert len(got) == 27 and [r.page_id for r in got.values() if r.page_id is not None] and len({r.page_id for r in got.values()}) == 21
    types = [got[UUID.format(i)].record_type for i in range(1, 8)]
    assert types == ["warcinfo", "request", "response", "response", "revisit", "resource", "response"]
    payloads = [got[UUID.format(i)].payload for i in range(1, 8)]
    assert [p and bytes(p) for p in payloads] == [
        b"software: x\r\n", b"", b"<p>one</p>", b"hello, world", None, b"{}", b"no payload digest"
    ]
    four, five = got[UUID.format(4)], got[UUID.format(5)]
    assert five.refers_to_record == UUID.format(4) and five.payload_digest == four.payload_digest and five.payload_bytes is None
    store, path = pafs.FileSystem.from_uri(f"file://{tmp_path}/x.wacz")
    with store.open_input_file(path) as source:
        ranges = list(Z.archive_ranges(source, 300))
    assert len(ranges) == 2 if index is None else len(ranges) > 5


def test_unreadable_archives_are_errors(tmp_path):
    def fails(name, what):
        with pytest.raises(ValueError, match=what):
            read_all(f"file://{tmp_path}/{name}")

    with zipfile.ZipFile(tmp_path / "none.zip", "w") as packed:
        packed.writestr("other.txt", "x")
    fails("none.zip", "no WARC member")
    pack(tmp_path / "plain.zip", {"data.warc": crawl()})
    fails("plain.zip", "no .warc.gz")
    pack(tmp_path / "line.zip", {"a.warc.gz": crawl()}, **{"index.cdxj": b"0 100\n"})
    fails("line.zip", "no index line")
    pack(tmp_path / "file.zip", {"a.warc.gz": crawl()}, **{"index.cdxj": b'a 1 {"offset": 0, "filename": "b.warc.gz"}\n'})
    fails("file.zip", "outside")
    pack(tmp_path / "offset.zip", {"a.warc.gz": crawl()}, **{"index.cdxj": b'a 1 {"offset": 7, "filename": "a.warc.gz"}\n'})
    with pytest.raises(Exception):
        read_all(f"file://{tmp_path}/offset.zip", 5)


def test_records():
    """Several records in one gzip member; damage in blocks and payloads; a record that is cut short."""
    rows = list(Z.parse_records(b"".join(crawl())))
    assert [r[7] for r in rows] == [UUID.format(i) for i in range(1, 8)]
    three, seven = crawl()[2], crawl()[6]
    for broken in (three.replace(b"one", b"two"), seven.replace(b"digest\r\n\r\n", b"digesT\r\n\r\n"), three[:-10], b"x" + three, three + b"rest"):
        with pytest.raises(ValueError):
            list(Z.parse_records(broken))


def test_sort_key():
    assert Z.sort_key("http://user@www.Example.com:8080/A?b=C") == "com,example,www:8080)/a?b=c"
    assert Z.sort_key("https://a.b") == "b,a)/" and Z.sort_key(None) == "-" and Z.sort_key("urn:X") == "urn:x"
    assert Z.sort_key("http://[bad/") == "http://[bad/"
