"""Sources and sinks: the driver's tables, Parquet files with their place, delimited text, fixed-width binary rows, raw
files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import le_decode, le_encode

#: Little-endian fields of a binary row in their order, as (name, type, bytes).
KEY_ROW = [(f"field{k}", "u32", 4) for k in range(8)]
RUN_ROW = [("key", "bytes", 16), ("value", "bytes", 4080)]
LINE_ROW = [
    ("l_orderkey", "u32", 4),
    ("l_partkey", "u32", 4),
    ("l_suppkey", "u32", 4),
    ("l_linenumber", "u32", 4),
    ("l_quantity", "u64", 8),
    ("l_extendedprice", "u64", 8),
    ("l_shipdate", "i32", 4),
    ("l_commitdate", "i32", 4),
    ("l_receiptdate", "i32", 4),
    ("l_discount", "text", 5),
    ("l_tax", "text", 5),
    ("l_returnflag", "text", 1),
    ("l_linestatus", "text", 1),
    ("l_shipinstruct", "text", 18),
    ("l_shipmode", "text", 10),
    ("l_comment", "text", 44),
]
#: The fields of a delimited line in their order.
LINE_FIELDS = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parquet_in_order(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of several Parquet files or folders with scan_file (the path's place in the list), scan_part (the file's
    name) and scan_row (the row's place in it): the order of these three is that of the scan. A path that comes twice
    is read twice."""
    own = lambda k, p: spark.read.parquet(p).select("*", F.lit(k).alias("scan_file"), F.col("_metadata.file_name").alias("scan_part"), F.col("_metadata.row_index").alias("scan_row"))
    return reduce(DataFrame.unionByName, (own(k, p) for k, p in enumerate(paths)))


def extents(df: DataFrame) -> DataFrame:
    """(file_path, block_start, block_length, rows): the pieces of files that a scan of df reads, as tasks get them."""
    at = [F.col(f"_metadata.{x}") for x in ("file_path", "file_block_start", "file_block_length")]
    return df.groupBy(at[0].alias("file_path"), at[1].alias("block_start"), at[2].alias("block_length")).agg(F.count("*").alias("rows"))


def delimited(spark: SparkSession, path: str, schema: str = LINE_FIELDS, sep: str = "|") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep)


def fixed_width(spark: SparkSession, path: str, row: list[tuple[str, str, int]]) -> DataFrame:
    """Rows of fixed-width binary files, split at the record length, so that a file of any size is read by many tasks.
    A file that ends within a row stops the scan. Types: u32, u64 (below 2^63), i32, bytes, and text, whose trailing
    zero bytes are no part of it."""
    jvm, width = spark.sparkContext._jvm, sum(n for _, _, n in row)
    context = spark.sparkContext._jsc.sc()
    records = context.binaryRecords(path, width, spark.sparkContext._jsc.hadoopConfiguration())
    rows = DataFrame(spark._jsparkSession.createDataset(records, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    columns, at = [], 1
    for name, kind, n in row:
        columns.append(_field(F.substring("value", at, n), kind, n).alias(name))
        at += n
    return rows.select(*columns)


def _field(data: Column, kind: str, n: int) -> Column:
    if kind == "bytes":
        return data
    if kind == "text":
        return F.rtrim(F.decode(data, "UTF-8"), F.lit("\0"))
    return le_decode(data, n, signed=kind == "i32")


def write_fixed_width(df: DataFrame, folder: str, row: list[tuple[str, str, int]]) -> int:
    """Writes the rows of df as fixed-width binary files, one a task, whole or not at all; how many files. folder: a URI
    that all executors reach. Text is cut or filled with zero bytes to its width; null is zero bytes."""

    def packed(name: str, kind: str, n: int) -> Column:
        if kind in ("text", "bytes"):
            return F.rpad(F.coalesce(F.col(name).cast("binary"), F.lit(b"")), F.lit(n), F.lit(b"\0"))
        return le_encode(F.coalesce(F.col(name).cast("long"), F.lit(0)), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inner = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(inner, recursive=True)
        held, out = f"{inner}/_attempt-{uuid.uuid4().hex}", None
        for batch in batches:
            out = out or files.open_output_stream(held)
            out.write(b"".join(batch.column(0).to_pylist()))
        if out is not None:
            out.close()
            files.move(held, f"{inner}/part-{TaskContext.get().partitionId():05d}.bin")
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["files"])

    return df.select(F.concat(*(packed(*x) for x in row)).alias("row")).mapInArrow(run, "files long").count()


def raw(spark: SparkSession, path: str, offset: int = 0, length: int | None = None) -> DataFrame:
    """(path, modificationTime, length, content): a range of the bytes of each file, or all."""
    df = spark.read.format("binaryFile").load(path)
    if offset or length is not None:
        df = df.withColumn("content", F.substring("content", offset + 1, length if length is not None else 2**31 - 1))
    return df


def write(df: DataFrame, path: str, form: str = "parquet", **options) -> DataFrame:
    """Writes df and returns it as it is read back: the work before it isn't done again."""
    df.write.format(form).options(**options).save(path)
    return df.sparkSession.read.schema(df.schema).format(form).options(**options).load(path)
