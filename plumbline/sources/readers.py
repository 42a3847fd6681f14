"""Scans: nested JSON documents, CSV, optional tables, file inventory, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import stage
from plumbline.sources import digest

FIELD_SEPARATOR = "\x1f"
NULL_FIELD = "\\N"

# A file above this size is hashed slice by slice, a smaller one by one task that holds it.
WHOLE_FILE_BYTES = 128 << 20
# Names of files that the line reader would decompress; they are hashed whole.
COMPRESSED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst)$"

NESTED_SCHEMA = """
    _id string, key string,
    fields struct<
        created: string, resolutiondate: string,
        project: struct<key: string, name: string>,
        issuetype: struct<name: string>,
        priority: struct<name: string>,
        status: struct<name: string>,
        summary: string, description: string>
"""


def read_nested(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Documents with nested fields; a limit of 0 reads all of them."""
    documents = spark.read.schema(NESTED_SCHEMA).json(path)
    return documents.limit(limit) if limit > 0 else documents


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with header and quoted, possibly multi-line text; empty text is NULL.

    The schema is never inferred.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where nothing lies at the path."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def table_if_exists(spark: SparkSession, name: str) -> DataFrame | None:
    """A catalogue table or view, or None where the catalogue has none of that name."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size, time of change and SHA-256 of every file below a folder.

    A task reads a file of up to ``WHOLE_FILE_BYTES``, or a slice of a larger one. Where no state of the hash can be
    kept (see ``digest``), and for names that ``COMPRESSED`` lists, it reads the file whole, up to 2 GiB.
    """

    def load(source: str, **options: str) -> DataFrame:
        reader = spark.read.format(source).options(pathGlobFilter=pattern, recursiveFileLookup=True, **options)
        return reader.load(path)

    size, name = F.col("_metadata.file_size"), F.col("_metadata.file_name")
    sliced = (size > WHOLE_FILE_BYTES) & ~name.rlike(COMPRESSED)
    listing = [
        F.col("path"),
        F.col("length").alias("size_bytes"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("modified_utc"),
    ]
    hashed = [*listing, F.sha2("content", 256).alias("sha256")]
    files = load("binaryFile")
    file = F.col("_metadata.file_path").alias("file")
    large = files.filter(sliced).select(file, *listing)
    if large.isEmpty() or not digest.resumable():
        return files.select(*hashed)
    numbered = stage(large.withColumn("number", F.row_number().over(Window.orderBy("file"))), "large_files")
    lines = load("text", lineSep="\n").filter(sliced)
    lines = lines.select(file, F.col("_metadata.file_block_start").alias("block"), "value")
    digests = digest.digests(numbered, lines).select("path", "size_bytes", "modified_utc", "sha256")
    return files.filter(~sliced).select(*hashed).unionByName(digests)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Row count and an order-free hash of the content, for the table or per group.

    Equal content gives equal numbers in whatever order and partitioning the rows come.
    """
    columns = list(columns or df.columns)
    fields = [F.coalesce(F.col(c).cast("string"), F.lit(NULL_FIELD)) for c in columns]
    text = F.concat_ws(FIELD_SEPARATOR, *fields)
    row_hash = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.sum(row_hash).cast("decimal(38,0)").cast("string").alias("fingerprint"),
    )
