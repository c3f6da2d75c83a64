"""Quality rules: a table of thresholds compiled into one chain of Spark projections; no user functions.

Each rule is a measure of a text and the range it must lie in. The measures are built-in functions over the
text's words, lines and word windows; nothing is shuffled. Windows are told apart by the 64-bit XXH64 of their
words; a text in which all differ, as most short ones, is done after that test, and only others sort theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are or an at from which not "
    "der die und das den von zu mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat "
    "le la les de des et en un une du que est pour qui dans par sur pas au il se ne ce plus "
    "el los las y a que por con una su para es al lo como más o pero sus le ha me si sin sobre"
).split()


@dataclass(frozen=True)
class Threshold:
    """A text passes if low <= measure <= high; measure: SQL over the measured columns."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: What a text has to meet beside the base rules. The bounds are wide: they are to catch what is no prose.
THRESHOLDS = (
    Threshold("words", "n_words", low=50),
    Threshold("word_length", "word_chars / n_words", low=2.0, high=20.0),
    Threshold("symbols", "n_symbols / n_words", high=0.1),
    Threshold("stop_words", "n_stop_words / n_words", low=0.05),
    Threshold("duplicate_lines", "n_dup_lines / n_lines", high=0.5),
    Threshold("repeated_words", "n_repeat_words / n_words", high=0.5),
)


def measured(documents: DataFrame, *kept: str) -> DataFrame:
    """kept and the measures n_words, word_chars, n_symbols, n_stop_words, n_lines, n_dup_lines, n_repeat_words."""
    zero = F.lit(0).cast("long")
    rows = documents.select(*(F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(kept)), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = [f"__{k}" for k in range(len(kept))]
    cut = rows.select(
        *own,
        F.array_remove(F.split("text", BLANK, -1), "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    words = F.col("words")
    hashed = cut.select(
        *own,
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).alias("windows"),
    )
    counts = ["n_symbols", "n_words", "word_chars", "n_stop_words", "n_lines", "n_dup_lines"]
    ordered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = hashed.select(*own, *counts, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered).alias("windows"))
    windows = F.col("windows")
    same = lambda x, k: F.coalesce(F.get(windows, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(windows, k + 1)["h"] == x["h"], F.lit(False))
    repeated = sorted_.select(*own, *counts, F.sort_array(F.transform(F.filter("windows", same), lambda x: x["i"])).alias("places"))
    places = F.col("places")
    # a window covers three words, or as many as lie before the next repeated window
    covered = F.aggregate(F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))), zero, lambda n, x: n + x)
    # one row is packed and unpacked, since no filter is moved below that: a condition moved down through the
    # projections would have each measure's arrays made anew wherever it names them
    found = F.struct(*(F.col(f"__{k}").alias(c) for k, c in enumerate(kept)), *counts, F.coalesce(covered, zero).alias("n_repeat_words"))
    return repeated.select(F.inline(F.array(found)))


def passes(thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """The rules as one condition; a measure without a value (no words, no lines) doesn't fail its rule."""
    met = F.lit(True)
    for t in thresholds:
        value = F.expr(f"try_divide({t.measure.replace(' / ', ', ')})") if " / " in t.measure else F.expr(t.measure)
        for bound, good in ((t.low, value >= t.low if t.low is not None else None), (t.high, value <= t.high if t.high is not None else None)):
            if bound is not None:
                met &= F.coalesce(good, F.lit(True))
    return met


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def quality(documents: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_stop_words, n_lines) of
    every row.

    Null text has no words and fails; null keys and repeated rows stay; an empty table gives no rows; a text of any
    length counts whole; further columns, of whatever name, are ignored."""
    failed = F.expr(BASE_FAILED)
    return measured(documents, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & passes(thresholds)).alias("kept"), "n_stop_words", "n_lines")


def good_documents(documents: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The rows of documents that the rules keep, with their columns; no shuffle."""
    held = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), "text")
    return measured(held, "row").where(~F.expr(BASE_FAILED) & passes(thresholds)).select("row.*")


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_KEPT = " AND ".join(f"coalesce({t.measure.replace(' / ', '::DOUBLE / nullif(') + (', 0)' if ' / ' in t.measure else '')} {sign} {bound}, true)" for t in THRESHOLDS for sign, bound in ((">=", t.low), ("<=", t.high)) if bound is not None)
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
p AS (SELECT r, generate_subscripts(words, 1) AS i, unnest(words) AS a FROM w),
g AS (SELECT r, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
v AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM f, (VALUES (0), (1), (2)) AS x(k) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
      len(list_filter(words, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words, len(lines)::BIGINT AS n_lines
      FROM w LEFT JOIN v USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,
       NOT ({BASE_FAILED}) AND {_KEPT} AS kept, n_stop_words, n_lines FROM m
"""
