"""What landed parquet files say about themselves, read by tasks from their footers.

The listing comes from Spark's file source, without any content; a task then opens the footers of
a group of files, and nothing else of them. So a history of many thousand files costs the driver no loop.
Files are opened with pyarrow's file systems (local, HDFS, S3, GCS); a file that cannot be read as
parquet is an error that names it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Footers that a task opens.
FILES_A_TASK = 64
FOUND = "path string, file_month string, bytes bigint, modified timestamp, rows bigint, schema array<struct<name:string,type:string>>"
ROWS = pa.schema([
    ("path", pa.string()), ("file_month", pa.string()), ("bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("rows", pa.int64()),
    ("schema", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))),
])
UNSIGNED = {pa.uint8(): "smallint", pa.uint16(): "int", pa.uint32(): "bigint", pa.uint64(): "decimal(20,0)"}


def listed(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """(path, bytes, modified) of the parquet files under the paths."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return reader.load(list(paths)).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def footers(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """A row per file under ``path/file_month=YYYY-MM/``: path, month, bytes, modified, rows, columns in file order.

    With months, only their folders are listed; a month that has not landed is an error. No file: no row.
    """
    base = path.rstrip("/")
    files = listed(spark, [base] if months is None else [f"{base}/file_month={m}" for m in months])
    tasks = max(1, -(-files.count() // FILES_A_TASK))
    return files.repartition(tasks).mapInArrow(_opened, FOUND)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            rows, schema = read_footer(row["path"])
            month = row["path"].partition("file_month=")[2].partition("/")[0] or None
            out.append({**row, "file_month": month, "rows": rows, "schema": [{"name": n, "type": t} for n, t in schema]})
        yield pa.RecordBatch.from_pylist(out, ROWS)


def read_footer(path: str) -> tuple[int, list[tuple[str, str]]]:
    """Rows, and names and Spark types of the columns, of one file."""
    if path.startswith("file:"):
        system, inner = pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    else:
        system, inner = pyarrow.fs.FileSystem.from_uri(path)
    try:
        with system.open_input_file(inner) as file:
            meta = pq.ParquetFile(file)
            old = {meta.schema.column(i).path for i in range(len(meta.schema)) if meta.schema.column(i).physical_type == "INT96"}
            return meta.metadata.num_rows, [(f.name, "timestamp" if f.name in old else spark_type(f.type)) for f in meta.schema_arrow]
    except pa.ArrowInvalid as error:
        raise ValueError(f"{path} is no parquet file: {error}") from error


def spark_type(kind: pa.DataType) -> str:
    """The type under which Spark reads an Arrow type; its own name where Spark has none."""
    from pyspark.errors import PySparkTypeError
    from pyspark.sql.pandas.types import from_arrow_type

    if pa.types.is_dictionary(kind):
        kind = kind.value_type
    if pa.types.is_timestamp(kind):
        return "timestamp_ntz" if kind.tz is None else "timestamp"
    if kind in UNSIGNED:
        return UNSIGNED[kind]
    try:
        return from_arrow_type(kind).simpleString()
    except PySparkTypeError:
        return str(kind)


def by_month(found: DataFrame) -> DataFrame:
    """(month, files, bytes, rows, last_modified) of the files found."""
    return found.groupBy(F.col("file_month").alias("month")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.max("modified").alias("last_modified"),
    )


def month_schemas(found: DataFrame) -> DataFrame:
    """(month, schema, others): the columns most rows of a month have, and the different ones of its other files."""
    each = found.groupBy(F.col("file_month").alias("month"), "schema").agg(F.sum("rows").alias("rows"))
    months = each.groupBy("month").agg(F.max_by("schema", F.struct("rows", F.col("schema").cast("string"))).alias("schema"), F.collect_set("schema").alias("all"))
    return months.select("month", "schema", F.array_sort(F.filter("all", lambda s: s != F.col("schema"))).alias("others"))
