"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer_digest, content_digest, n_tokens) in a shared folder. A run digests
every text, finds on the digests alone which of them the cache lacks for this tokenizer and which row shall stand
for each, fetches the texts of those rows only, encodes them, appends the new counts to the cache, and joins all
rows to it by digest. Content is normalised as the tokenizer itself may not tell apart: null is the empty text;
nothing else is folded, so a count is exact.

Where few digests are new (see fetch_texts) only their texts move; where many are, the texts are dealt by digest
and key, so that a digest which a third of the rows share is in no one's hands. The join back moves digests, and
its heavy ones not at all.

Defined cases: null text counts as empty (0 tokens, 0 bytes); repeated rows stay repeated; an empty table
gives an empty result; further columns of the input are ignored; a null key is kept as null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import library_chunks, vocabulary
from .common import column, fetch_texts, join_unique, new_folder, released, steps, stored, text_rows

CACHE = "tokenizer_digest string, content_digest string, n_tokens long"


def tokenizer_digest(name: str) -> str:
    """SHA-256 of the vocabulary file: another file or version is another tokenizer."""
    with open(vocabulary(name), "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def _library_counts(name: str, texts: list[str]) -> list[int]:
    if name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        return [len(x) for x in pieces.encode(texts, num_threads=1)]
    return [len(x) // 4 for x in library_chunks(vocabulary(name)).encode(texts)]


def _count(name: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[int] = []
            for part in steps(x.as_py() for x in column(batch, "text")):
                counts += _library_counts(name, part)
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts), pa.string()), column(batch, "content_digest"), pa.array(counts, pa.int64())], ["tokenizer_digest", "content_digest", "n_tokens"])

    return run


def count_tokens(documents: DataFrame, cache: str | None = None, tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; cache: the folder of counts to use and extend (none:
    a new one). The new counts are written before this returns; a run that dies leaves the cache as it was or
    with whole counts more."""
    spark = documents.sparkSession
    cache = cache or new_folder(spark, "token-counts")
    version = tokenizer_digest(tokenizer)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    text = F.coalesce(F.col("text"), F.lit(""))
    digested = text_rows(documents).select("doc_id", text.alias("text")).withColumn("content_digest", F.sha2("text", 256))
    rows = stored(digested.select("doc_id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    known = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer_digest") == version)
    misses = rows.join(known.select("content_digest"), "content_digest", "left_anti").groupBy("content_digest").agg(F.min("doc_id").alias("stand_in"))
    fetch_texts(digested, misses).mapInArrow(released(_count(tokenizer, version)), CACHE).write.mode("append").parquet(cache)
    # two runs at a time may both have added a digest; their counts are the same
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    return join_unique(rows, counts, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
