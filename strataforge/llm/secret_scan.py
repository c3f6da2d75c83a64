"""Secret scanning with an incremental ledger of blobs; Spark SQL functions only.

Every version of every document is addressed by its content (SHA-256), so equal texts are one blob however many
paths and versions hold it. The ledger is a Parquet table in a shared folder with one row for each scan of a
blob: its digest, the versions of the rules that were run, and the spans they found, each with its rule's version.
A scan finds on digests alone which pairs of blob and rule version the ledger lacks, fetches the text of one row
for each such blob, runs only those rules, appends, and joins the findings back to all rows by digest. A changed
rule has a new version: it is run alone, and spans of the versions before it stay in the ledger but aren't told.

Positions: splitting a text by a pattern gives the gaps between its leftmost non-overlapping matches; running
sums of the lengths of gaps and matches are the places, in code points. Only texts with a match are split.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MARKS, fetch_texts, join_unique, new_folder, stored


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose group `group` (0: all) has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


#: The kinds and patterns, in their order. The base ones are given; the rest are well-known formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
#: What redaction takes out beyond the reported kinds: a private key whole, to its end line, or if that is missing (the
#: text ends or another block begins before it) through its headers and base64 lines.
KEY_BLOCK = Rule(
    "keyblock",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----(?:BEGIN|END) )[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:\s*+(?:Proc-Type|DEK-Info):[^\r\n]*+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)*+(?:[ \t]*+(?:\r?\n|\\n)[A-Za-z0-9+/]++={0,2}[ \t]*+(?=[\r\n\\]|\Z))?+)",
)
REDACTED = (*RULES, KEY_BLOCK)
#: A rule's text must hold this for a match to be long enough; a quick test before the full pattern.
QUICK = {"hex": r"[0-9a-f]{16}", "forge": r"gh[pousr]_[A-Za-z0-9]{36}"}
LITERAL = {"access": "AKIA", "pem": "-----BEGIN ", "keyblock": "-----BEGIN ", "webtoken": "eyJ"}
SPAN = "array<struct<start:int,end:int,kind:string,version:string>>"
LEDGER = f"content_digest string, rules array<string>, spans {SPAN}"


def rule_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind, version>> of the rule's matches in text."""
    pattern = F.lit(rule.pattern)
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    judged = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    matches = F.arrays_zip(gaps.alias("gap"), found.alias("found"), judged.alias("judged"))

    def take(state: Column, x: Column) -> Column:
        start = state["position"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["found"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version")))
        kept = F.when(F.length(x["judged"]) >= rule.least, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("position"), kept.alias("spans"))

    none = F.struct(F.lit(0).alias("position"), F.array().cast(SPAN).alias("spans"))
    spans = F.aggregate(matches, none, take, lambda state: state["spans"])
    likely = text.contains(LITERAL[rule.kind]) if rule.kind in LITERAL else text.rlike(QUICK.get(rule.kind, rule.pattern))
    return F.when(likely, spans).otherwise(F.array().cast(SPAN))


def scan(documents: DataFrame, digests: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger in that folder lacks, and adds it; (content_digest, spans) of every blob with findings of
    these versions of these rules, spans (start, at, end, kind) in order of start and of the rules (at). digests: the
    stored (doc_id, content_digest) of the documents. A run that dies before its write is whole leaves the ledger as
    it was."""
    spark = documents.sparkSession
    versions = F.array(*(F.lit(r.version) for r in rules))
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    seen = spark.read.schema(LEDGER).parquet(ledger).groupBy("content_digest").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
    blobs = digests.groupBy("content_digest").agg(F.min("doc_id").alias("stand_in")).join(seen, "content_digest", "left")
    due = blobs.select("content_digest", "stand_in", F.array_except(versions, F.coalesce("done", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
    texts = fetch_texts(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content_digest", F.sha2("text", 256)), due)
    found = F.concat(*(F.when(F.array_contains("rules", r.version), rule_spans(F.col("text"), r)).otherwise(F.array().cast(SPAN)) for r in rules))
    texts.select("content_digest", "rules", found.alias("spans")).write.mode("append").parquet(ledger)
    order = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.version, k)))
    own = F.filter("spans", lambda s: s["version"].isin([r.version for r in rules]))
    told = F.transform(own, lambda s: F.struct(s["start"].alias("start"), order[s["version"]].alias("at"), s["end"].alias("end"), s["kind"].alias("kind")))
    # a blob is scanned again when rules change, and by two runs at a time: its rows add up
    held = spark.read.schema(LEDGER).parquet(ledger).where(F.size("spans") > 0).select("content_digest", told.alias("spans"))
    return held.where(F.size("spans") > 0).groupBy("content_digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def digested(documents: DataFrame) -> DataFrame:
    """(doc_id, content_digest) of every row, stored."""
    return stored(documents.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("content_digest")), "digests")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(documents: DataFrame, ledger: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row; ledger: the folder of earlier scans (none:
    a new one).

    Null text is empty and has no finding; null keys and repeated rows stay; an empty table gives no rows; further
    columns are ignored; equal starts go in the order of the kinds."""
    rows = digested(documents)
    found = scan(documents, rows, ledger or new_folder(documents.sparkSession, "blob-ledger"))
    base = [r.kind for r in RULES if r.base]
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in base]
    told = found.select("content_digest", *counts, _told(F.filter("spans", lambda s: s["kind"].isin(base))).alias("base"), _told(F.col("spans")).alias("spans"))
    return join_unique(rows, told, "content_digest", "left").select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in base), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redacted(documents: DataFrame, ledger: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """documents with each span (overlapping ones as one; of a private key also the body) replaced by the mark in text,
    and n_chars, where there is such a column, set anew where the text changed.

    All rows stay, repeated ones and those with null keys or texts too; texts without findings, and other columns of
    whatever name, come through unchanged (the row travels as one struct); a text of any length counts whole; an empty
    table stays empty. Findings are broadcast if they have MARKS spans at most, counted; or else rows meet them by
    digest."""
    digests = digested(documents)
    found = stored(scan(documents, digests, ledger or new_folder(documents.sparkSession, "blob-ledger"), REDACTED), "findings")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_digest"))
    if (found.agg(F.sum(F.size("spans"))).first()[0] or 0) <= MARKS:
        rows = rows.join(F.broadcast(found), "content_digest", "left")
    else:
        rows = join_unique(rows, found, "content_digest", "left", digests)
    text = F.col("row.text")

    def take(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["position"]
        more = F.concat(state["out"], F.substring(text, state["position"] + 1, s["start"] - state["position"]), F.lit(mark))
        return F.struct(F.greatest(state["position"], s["end"]).alias("position"), F.when(fresh, more).otherwise(state["out"]).alias("out"))

    masked = F.aggregate("spans", F.struct(F.lit(0).alias("position"), F.lit("").alias("out")), take, lambda x: F.concat(x["out"], F.substring(text, x["position"] + 1, F.length(text))))
    # n_chars is taken from the finished text, one projection later
    done = rows.select("row", "spans", F.when(F.col("spans").isNull(), text).otherwise(masked).alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.char_length("text").cast(documents.schema["n_chars"].dataType)).alias("n_chars")
    return done.select(*(changed.get(c, F.col(f"row.`{c}`")) for c in documents.columns))


def _sql_spans(rule: Rule, order: int) -> str:
    # the SQL engine's (?i) folds further letters than A-Z: both cases are written out
    pattern = rule.pattern
    if "(?i:" in pattern:
        head, _, rest = pattern.partition("(?i:")
        words, _, tail = rest.partition(")")
        pattern = head + "(?:" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words) + ")" + tail
    quoted = pattern.replace("'", "''")
    return f"""
      SELECT r, {order} AS place, '{rule.kind}' AS kind, s, s + length(found) AS e, {str(rule.base).lower()} AS base FROM (
        SELECT r, found, judged, (sum(length(gap)) OVER (PARTITION BY r ORDER BY k) + coalesce(sum(length(found)) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s FROM (
          SELECT r, generate_subscripts(found, 1) AS k, unnest(found) AS found, unnest(judged) AS judged, unnest(gaps[:len(found)]) AS gap FROM (
            SELECT r, regexp_extract_all(t, '{quoted}') AS found, regexp_extract_all(t, '{quoted}', {rule.group}) AS judged, string_split_regex(t, '{quoted}') AS gaps FROM d WHERE regexp_matches(t, '{quoted}'))))
      WHERE length(judged) >= {rule.least}"""


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans_ AS ({" UNION ALL ".join(_sql_spans(rule, k) for k, rule in enumerate(RULES))}),
a AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
      coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (WHERE base), '') AS base,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans FROM spans_ GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""
