"""What the operators share: the cluster's shared folder, materialised tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one step of a Python worker holds as separate words.
STEP_CHARS = 4_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset and Spark runs on this machine
    alone (tests), a temporary folder is taken and set for the session; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, not yet made."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read from there: the lineage ends here, and a lost
    executor costs one task of the reader, not the work before it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_rows(df: DataFrame) -> DataFrame:
    """df, in whose session Python gets 4,000 rows at a time and not Spark's 10,000, which for texts of some thousand
    characters fill a worker's memory. Another setting than Spark's own is left as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, "4000")
    return df


def within_memory(df: DataFrame) -> DataFrame:
    """df, in whose session Python gets 1,000 rows at a time, also where an operator has set 4,000: where several operators
    follow each other, each has less beside a heap that those before it have filled."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) in ("10000", "4000"):
        df.sparkSession.conf.set(name, "1000")
    return df


#: Rows that may be broadcast as marks or heavy keys: some MB at most.
MARKS = 100_000
HEAVY = 1000


def join_unique(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None, within: bool = False) -> DataFrame:
    """rows joined by key to table, which has each key once. counted: a stored table with the keys of rows (none: rows
    is one itself), from which the heavy keys are found. within: table has no other keys than rows has, so that with
    up to MARKS rows it is broadcast whole.

    A key may hold a third of the rows. Keys with more than a thousandth of them are fewer than a thousand, however
    many rows there are: what table has for these is broadcast and no row of theirs moves. All others are joined by
    a shuffle, of which no key is more than a thousandth."""
    counted = rows if counted is None else counted
    total = counted.count()
    if within and total <= MARKS:
        return rows.join(F.broadcast(table), key, how)
    heavy = stored(counted.groupBy(key).count().where((F.col("count") * HEAVY > total) & F.col(key).isNotNull()).select(key), "heavy-keys")
    marked = rows.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(table.join(F.broadcast(heavy), key, "left_semi")), key, how)
    return marked.unionByName(rows.join(F.broadcast(heavy), key, "left_anti").join(table, key, how))


def fetch_texts(digested: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, one row a digest: (content_digest, stand_in, ...), with the text of that digest in place of stand_in, the
    doc_id whose text is taken. digested: (doc_id, text, content_digest).

    Up to MARKS wanted digests (counted, some MB) are broadcast, and no other text than theirs moves. Beyond that the
    texts are dealt by digest and doc_id and met there; rows equal in both are one, without a further shuffle."""
    wanted = stored(wanted, "wanted")
    own = F.coalesce(F.col("doc_id"), F.lit(0)).alias("stand_in")
    wanted = wanted.withColumn("stand_in", F.coalesce("stand_in", F.lit(0)))
    if wanted.count() <= MARKS:
        wanted = F.broadcast(wanted)
    met = digested.select("content_digest", own, "text").join(wanted, ["content_digest", "stand_in"])
    return met.dropDuplicates(["content_digest", "stand_in"]).drop("stand_in")


def tasks_for(rows: DataFrame, text: str = "text", each: int = 64 << 20) -> int:
    """Into how many tasks the texts of rows should be dealt: by their bytes, and as many as the session has shuffle
    partitions at least."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // each))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(column: str, n: int):
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def steps(texts: Iterable[str | None], most: int = STEP_CHARS) -> Iterator[list[str]]:
    """The texts (null: empty) in lists of about `most` characters; a longer text is a list by itself."""
    part: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, after which the worker gives the memory that it has freed back to the system: Spark keeps its workers from
    stage to stage, beside the heap."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
