"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased letter by letter, everything else is a blank; its n-grams of one to three characters are
hashed to 2^16 buckets. Training counts buckets by language over a sample of the labelled training documents, in
expectation `sample` whole documents of each language, chosen by a hash of the key; the counts of the sample's
few tasks meet in the driver, and the matrix of log-probabilities (buckets x languages) is broadcast. Scoring
gathers each n-gram's row of the matrix and adds them by document, batch by batch, in numpy: one narrow pass.

The score is the posterior of the predicted language, with the log-likelihood divided by the number of n-gram
orders, since overlapping n-grams repeat each other's evidence.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import column, fold, released, steps, text_rows

ORDERS = 3
BUCKETS = 1 << 16
#: How many labels are learned at most, those of the most rows: the table that is broadcast has 256 KB for each.
MOST_LANGUAGES = 500


@functools.cache
def letters() -> np.ndarray:
    """For each code point up to 0xFFFF its lower-case letter, or the blank."""
    table = np.full(1 << 16, 32, np.uint32)
    for code in range(1 << 16):
        if (x := chr(code)).isalpha():
            low = x.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def normal(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    high = codes > 0xFFFF
    found = letters()[np.where(high, 32, codes)]
    if high.any():  # rare: letters beyond the table stand for themselves
        found = np.where(high & np.array([chr(x).isalpha() for x in codes.tolist()]), codes, found)
    return found


def grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the buckets of the n-grams beginning at each position; BUCKETS where there is none: at a
    border (code 0) or between two blanks."""
    wide = np.concatenate([codes.astype(np.uint32), np.zeros(ORDERS, np.uint32)])
    n = len(codes)
    blank, border = wide == 32, wide == 0
    mixed, bad = np.zeros(n, np.uint32), np.zeros(n, bool)
    for order in range(ORDERS):
        own = wide[order : order + n]
        mixed = (mixed ^ own) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        bad |= border[order : order + n]
        if order:
            bad |= blank[order : order + n] & blank[order - 1 : order - 1 + n]
        hashed = mixed * np.uint32(0x85EBCA6B) >> np.uint32(16)
        yield np.where(bad | (blank[:n] if not order else False), BUCKETS, hashed).astype(np.int64)


#: A longer text is counted and scored in parts, each with the characters that its last n-grams reach into.
PART = 2_000_000


def pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """The letters of the text's parts, and how many n-grams of each order begin in each."""
    for begin in range(0, max(len(text), 1), PART):
        own = normal(text[begin : begin + PART + ORDERS - 1])
        yield own, min(PART, len(own))


@dataclass
class Model:
    languages: list[str]
    #: log-probabilities of BUCKETS + 1 rows, the last all 0
    table: np.ndarray
    prior: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text under each language, over the whole text."""
        if any(len(x) > PART for x in texts):
            return np.concatenate([self._long(x) if len(x) > PART else self.scores([x]) for x in texts])
        codes = [normal(x) for x in texts]
        begins = np.cumsum([0, *(len(x) + 1 for x in codes)])[:-1]
        joined = np.concatenate([y for x in codes for y in (x, np.zeros(1, np.uint32))])
        total = np.zeros((len(texts), len(self.languages)))
        for buckets in grams(joined):
            for k in range(len(self.languages)):
                total[:, k] += np.add.reduceat(self.table[k][buckets], begins, dtype=np.float64)
        return total

    def _long(self, text: str) -> np.ndarray:
        total = np.zeros((1, len(self.languages)))
        for codes, n in pieces(text):
            for buckets in grams(codes):
                total[0] += [own[buckets[:n]].sum(dtype=np.float64) for own in self.table]
        return total

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        total = self.scores(texts) / ORDERS + self.prior
        best = total.argmax(axis=1)
        with np.errstate(over="ignore"):
            sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        known = [any(map(str.isalpha, x)) for x in texts]
        return [self.languages[k] if ok else "und" for k, ok in zip(best, known)], [float(s) if ok else 0.0 for s, ok in zip(sure, known)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(column(batch, "text"), column(batch, "lang")):
            counts = found.setdefault(lang.as_py(), np.zeros(BUCKETS + 1, np.int64))
            for codes, n in pieces(text.as_py()):
                for buckets in grams(codes):
                    counts += np.bincount(buckets[:n], minlength=BUCKETS + 1)
    yield pa.RecordBatch.from_arrays([pa.array([*found], pa.string()), pa.array([x[:-1].tobytes() for x in found.values()], pa.binary())], ["lang", "counts"])


def train(documents: DataFrame, training: Column, sample: int = 3000, smooth: float = 0.1, most: int = MOST_LANGUAGES) -> Model:
    """From text and lang of the rows for which `training` is true and lang and text aren't null. Of more than `most`
    labels, as a dirty column may have, those with the most rows are learned (ties: by name); the rest teach nothing."""
    labelled = documents.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS + 1), np.float32), np.zeros(0))
    rates = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, sample / sizes[lang]))))
    chosen = labelled.where(F.pmod(F.xxhash64(F.col("doc_id"), F.length("text")), F.lit(1 << 20)) < F.coalesce(rates[F.col("lang")], F.lit(0.0)) * (1 << 20))
    # some thousand documents a language: a few tasks count them, each sends a row a language
    rows = chosen.select("text", "lang").repartition(6).mapInArrow(released(_count), "lang string, counts binary").collect()
    counts = np.full((len(languages), BUCKETS), smooth)
    for r in rows:
        counts[languages.index(r["lang"])] += np.frombuffer(r["counts"], np.int64)
    table = np.zeros((len(languages), BUCKETS + 1), np.float32)
    table[:, :-1] = np.log(counts / counts.sum(axis=1, keepdims=True))
    prior = np.log([sizes[x] / sum(sizes.values()) for x in languages])
    return Model(languages, table, prior)


def _predict(shared, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for part in steps((x.as_py() for x in column(batch, "text")), 1_000_000):
                lang, score = model.predict(part)
                langs += lang
                scores += score
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *names])

    return run


def predicted(documents: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """documents with the prediction and its score appended; columns of these names are replaced."""
    rows = text_rows(documents).drop(*names)
    schema = StructType([*rows.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return rows.mapInArrow(released(_predict(documents.sparkSession.sparkContext.broadcast(model), names)), schema)


def training_fold() -> Column:
    return fold("doc_id", 3) != 1


def identify(documents: DataFrame, sample: int = 3000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from those not held out.

    Null text, or text without a letter, is `und` with score 0, as is all if no row is labelled; a null lang teaches
    nothing; null keys and repeated rows stay; an empty table gives no rows; further columns are ignored."""
    model = train(documents, training_fold(), sample)
    return predicted(documents.select("doc_id", "text"), model).select("doc_id", (~training_fold()).alias("held_out"), "lang_pred", "score")


def in_known_language(documents: DataFrame, sample: int = 3000, least: float = 0.5) -> DataFrame:
    """The rows with a predicted language and a score of `least` or more, with their own columns.

    Rows whose text is null, empty or without a letter have no language and go, as do all if no row is labelled; null
    keys and repeated rows are judged like any other; a text of any length counts whole; an empty table stays empty.
    The row travels as one struct, so that columns of any name, also those of a prediction, come through unchanged."""
    held = documents.select("text", F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    found = predicted(held, train(documents, training_fold(), sample))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
