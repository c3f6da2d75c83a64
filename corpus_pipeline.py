"""Corpus pipeline over the documents table: five stages, each putting one operator's decisions into effect.

Every stage takes all that the one before kept and returns the columns of documents; the last returns the packed
pieces. Between stages the rows are written and read again, so that a lost executor costs one stage's tasks at most.

Every stage: an empty table stays empty; a text of any length counts whole; null keys and repeated rows are rows like
any other, but where a stage says otherwise; columns of any name beside doc_id, text and lang come through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataforge.llm.common import documents, stored, within_memory
from strataforge.llm.language_id import in_known_language
from strataforge.llm.packing import pack
from strataforge.llm.quality_rules import good_documents
from strataforge.llm.secret_scan import redacted
from strataforge.llm.simhash import one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known; learned from the stage's own labelled rows. Rows without text or letters go, as do
    all if no row is labelled."""
    return in_known_language(within_memory(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep. Null and empty texts have no words and go."""
    return good_documents(within_memory(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the least doc_id (a null is less than any); of rows with one doc_id
    the one whose text has the least digest, of equal rows any one. Texts without words are one group."""
    return one_of_each(within_memory(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the secrets in their texts replaced by a mark, and n_chars set anew there. Null texts stay null."""
    return redacted(within_memory(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its sequence and its place there. A null or empty text is one piece, the end;
    repeated rows are packed each; further columns end here."""
    return pack(within_memory(docs), step=1_000_000)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Trained models, fingerprints and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
