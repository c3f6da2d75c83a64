"""The queries opN_<name> over the whole documents table, each by its operator, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality_rules, secret_scan
from .bpe_codec import encode_and_decode
from .common import documents, new_folder
from .edit_fingerprints import fingerprints_of_edits
from .language_id import identify
from .lm_mixing import score_documents
from .packing import pack
from .quality_rules import quality
from .secret_scan import find_secrets
from .simhash import near_duplicates
from .token_counts import count_tokens
from .token_shards import read_shards, write_shards


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(documents(spark, sf_dir), new_folder(spark, "token-shards"))
    return read_shards(spark, manifest, with_ids=False).drop("ids")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op5_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(documents(spark, sf_dir), full=False)


def op7_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_of_edits(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_shards, op2_language_id, op3_secret_scan, op4_quality_rules, op5_lm_mixing, op6_bpe_codec, op7_edit_fingerprints, op8_token_counts, op9_best_fit_packing, op10_simhash)}
ORACLE_SQL: dict[str, str] = {"op3_secret_scan": secret_scan.ORACLE_SQL, "op4_quality_rules": quality_rules.ORACLE_SQL}
