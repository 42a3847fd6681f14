"""The files that the scans of issues write and read."""

import glob
import hashlib
import random

import pytest
from test_oracle import SMALL

from plumbline.plans import queries_scalar
from plumbline.plans.catalog import QUERIES
from plumbline.sources import digest, readers
from plumbline.sources.sinks import write_report


@pytest.mark.parametrize("name", ["S01_nested_document_scan", "S02_csv_scan"])
def test_texts_are_written_packed(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(queries_scalar, "scratch_path", lambda s, n: f"{tmp_path}/{n}")
    rows = QUERIES[name](spark, SMALL).count()
    files = glob.glob(f"{tmp_path}/*/part-*")
    assert rows == 1500 and files and all(f.endswith(".gz") for f in files)


def test_reports_keep_the_codec_of_the_session(spark, tmp_path):
    write_report(spark.range(3), f"{tmp_path}/plain", "csv")
    assert glob.glob(f"{tmp_path}/plain/part-*.csv")


MARK = b"\xef\xbb\xbf"
NOISE = random.Random(7).randbytes(700_000)
FILES = {
    "noise.bin": NOISE,
    "noise and break.bin": NOISE + b"\n",
    "deep/er/mark%20é.csv": MARK + NOISE,
    "mark_break.csv": MARK + NOISE[:400_001] + b"\n",
    "one_line.bin": NOISE.replace(b"\n", b"\r"),
    "breaks.bin": b"\n" * 500_000,
    "begins_with_break.txt": b"\n" + MARK + b"\r\n" * 200_000 + b"\r",
    "just_above.bin": NOISE[:100_001],
    "at_the_limit.bin": NOISE[:100_000],
    "same_as_noise.bin": NOISE,
    "small.txt": MARK + b"a\n",
}


@pytest.fixture
def small_blocks(spark, monkeypatch):
    """Files above 100,000 bytes are cut, none of them may be held whole, and slices take several blocks."""
    conf = {
        "spark.sql.files.maxPartitionBytes": "30000",
        "spark.sql.files.openCostInBytes": "1",
        "spark.sql.sources.binaryFile.maxLength": "100000",
    }
    before = {k: spark.conf.get(k) for k in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    monkeypatch.setattr(readers, "WHOLE_FILE_BYTES", 100_000)
    monkeypatch.setattr(digest, "SLICE_BYTES", 200_000)
    monkeypatch.setattr(digest, "CHUNK_BYTES", 10_000)
    monkeypatch.setattr(digest, "PIECE_BYTES", 777)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def _written(folder, files):
    for name, content in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def test_large_files_are_hashed_in_slices(spark, tmp_path, small_blocks):
    _written(tmp_path, FILES)
    rows = readers.file_inventory(spark, str(tmp_path)).collect()
    found = {r.path: (r.size_bytes, r.sha256) for r in rows}
    assert len(rows) == len(FILES)
    assert found == {f"file:{tmp_path}/{n}": (len(c), hashlib.sha256(c).hexdigest()) for n, c in FILES.items()}
    assert all(r.modified_utc.endswith("Z") for r in rows)


def test_names_and_pattern_of_sliced_files(spark, tmp_path, small_blocks):
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000000")
    _written(tmp_path, {"a.gz": NOISE, "a.bin": NOISE, "b.bin": b"b"})
    rows = readers.file_inventory(spark, str(tmp_path), "a*").collect()
    assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in rows} == dict.fromkeys(["a.gz", "a.bin"], hashlib.sha256(NOISE).hexdigest())


def test_a_file_read_in_part_is_an_error(spark, tmp_path, small_blocks):
    _written(tmp_path, {"a.bin": NOISE})
    listed = spark.createDataFrame([(1, f"file://{tmp_path}/a.bin", 900_000)], "number int, file string, size_bytes long")
    lines = spark.createDataFrame([(f"file://{tmp_path}/a.bin", 0, "abc")], "file string, block long, value string")
    with pytest.raises(OSError, match="900000 bytes are listed, 4 were read"):
        digest.digests(listed, lines)


def test_without_resumable_hash_files_are_hashed_whole(spark, tmp_path, small_blocks, monkeypatch):
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000000")
    monkeypatch.setattr(digest, "resumable", lambda: False)
    _written(tmp_path, {"a.bin": NOISE})
    assert readers.file_inventory(spark, str(tmp_path)).first().sha256 == hashlib.sha256(NOISE).hexdigest()


def test_state_of_a_hash_goes_on():
    assert digest.resumable()
    for cut in (0, 1, 63, 64, 65, 1000):
        first = digest.Sha256()
        first.update(NOISE[:cut])
        then = digest.Sha256(first.state())
        then.update(NOISE[cut:2000])
        assert then.hexdigest() == then.hexdigest() == hashlib.sha256(NOISE[:2000]).hexdigest()
