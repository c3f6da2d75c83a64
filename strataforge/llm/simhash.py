"""SimHash near-duplicate groups through Golay-code fuzzy hashing.

A text's 64-bit fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two fingerprints
are linked if they differ in three bits or fewer; the groups are the connected components of all links.

Candidates. The fingerprint is cut into four 16-bit segments. Of three differing bits at most, one segment has
none, and of any two further segments one has at most one. So eight tables (segment i equal, segment j within
one bit, two choices of j for each i) reach every link. "Within one bit" is a key equality by the perfect binary
Golay code (23, 12): a segment, padded to 23 bits, decodes to the one codeword within distance three; a segment
at distance three also takes the codewords to which its one-bit neighbours decode. Two segments one bit apart
then share a codeword index. A fingerprint has about 40 keys of 28 bits and a table number.

Size. Equal fingerprints are one node, however many documents share them. Keys are sorted on the executors and
read in runs; a run is verified by exclusive or and bit count against one member at a time, and what comes out
is a star of each local component: never the pairs. A key with more than `run_limit` nodes is cut into blocks
and every two blocks meet in a task of their own, so no task holds more than two blocks and no link is lost.
The stars are joined to components by rounds of star contraction, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MARKS, column, join_unique, released, stored, text_rows

#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the Golay code.
GOLAY = 0b101011100011
#: (table, equal segment, fuzzy segment)
TABLES = [(2 * i + k - 1, i, (i + k) % 4) for i in range(4) for k in (1, 2)]


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """Unsigned; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(words_each)))) if len(words) >= words_each else [b" ".join(words)]
    hash_ = xxhash.xxh64_intdigest
    hashes = np.array([hash_(x, 42) for x in shingles], "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def golay_remainder(words: np.ndarray) -> np.ndarray:
    """The syndrome: the 23-bit word as a polynomial, modulo the generator."""
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GOLAY << (bit - 11)), words)
    return words


def fuzzy_keys() -> np.ndarray:
    """For each 16-bit segment its codeword indices, -1 beyond the last: an array of 65,536 rows."""
    bits = 1 << np.arange(23)
    errors = np.unique(np.concatenate([[0], *((a | b | c) for a in bits for b in bits for c in [bits])]))
    error_of = np.zeros(2048, np.int64)
    error_of[golay_remainder(errors)] = errors
    values = np.arange(1 << 16)
    decode = lambda x: (x ^ error_of[golay_remainder(x)]) >> 11
    far = np.bitwise_count(error_of[golay_remainder(values)].astype(np.uint64)) == 3
    keys = np.stack([decode(values)] + [np.where(far, decode(values ^ (1 << b)), -1) for b in range(16)], axis=1)
    keys = -np.sort(-keys, axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    keys = -np.sort(-keys, axis=1)
    return keys[:, : int((keys >= 0).sum(axis=1).max())].astype(np.int32)


_fuzzy: list[np.ndarray] = []


def candidate_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in prints, key) for every key of every fingerprint."""
    if not _fuzzy:
        _fuzzy.append(fuzzy_keys())
    segments = [(prints.view(np.uint64) >> np.uint64(16 * k)).astype(np.int64) & 0xFFFF for k in range(4)]
    rows, keys = [], []
    for table, same, near in TABLES:
        codes = _fuzzy[0][segments[near]]
        at, which = np.nonzero(codes >= 0)
        rows.append(at)
        keys.append((table << 16 | segments[same][at]) << 12 | codes[at, which])
    return np.concatenate(rows), np.concatenate(keys)


def local_stars(prints: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """The components of these distinct fingerprints, of two members at least, each with its least member. Each
    member is held once against all that no component has yet."""
    waiting = np.sort(prints)
    while len(waiting) > 1:
        root, waiting = waiting[0], waiting[1:]
        reached, k = [root], 0
        while k < len(reached) and len(waiting):
            # of signed numbers numpy counts the bits of the absolute value
            near = np.bitwise_count((waiting ^ reached[k]).view(np.uint64)) <= bits
            if near.any():
                reached += waiting[near].tolist()
                waiting = waiting[~near]
            k += 1
        if len(reached) > 1:
            yield np.array(reached[1:], np.int64), int(root)


def _fingerprints(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), words_each) for x in column(batch, "text")], np.uint64).view(np.int64)
            kept = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(column(batch, x) for x in kept), pa.array(prints)], [*kept, "fp"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = column(batch, "fp").to_numpy()
        at, keys = candidate_keys(prints)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(prints[at])], ["key", "fp"])


def _links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of (key, block); what the last batch leaves of its last run waits for the next."""
        held: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        for batch in batches:
            rows = np.stack([column(batch, x).to_numpy() for x in ("key", "block", "fp")], axis=1)
            if not len(rows):
                continue
            waiting = held[-1]
            if len(waiting) and (waiting[-1, :2] == rows[-1, :2]).all():
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows])
            starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            held = [rows[starts[-1] :]]
            yield _stars(rows[: starts[-1]], starts, bits)
        rows = np.concatenate(held)
        yield _stars(rows, np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])[: len(rows)], bits)

    return run


def _stars(rows: np.ndarray, starts: np.ndarray, bits: int) -> pa.RecordBatch:
    ends = np.r_[starts[1:], len(rows)]
    members, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(starts, ends):
        if b - a == 2:
            u, v = rows[a, 2], rows[a + 1, 2]
            if (int(u) ^ int(v)) & 0xFFFFFFFFFFFFFFFF and ((int(u) ^ int(v)) & 0xFFFFFFFFFFFFFFFF).bit_count() <= bits:
                members.append(np.array([max(u, v)]))
                roots.append(np.array([min(u, v)]))
        elif b - a > 2:
            for own, root in local_stars(rows[a:b, 2], bits):
                members.append(own)
                roots.append(np.full(len(own), root))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(members)), pa.array(np.concatenate(roots))], ["u", "v"])


def links(nodes: DataFrame, bits: int = 3, run_limit: int = 20_000, keys=_keys) -> DataFrame:
    """(u, v), u > v: stars whose components are those of all links among the distinct numbers fp that share a key; keys
    makes (key, fp) of nodes, in Arrow batches.

    Keys with more than run_limit rows are found in two steps, since almost all have few: rows are counted by hashed
    buckets of keys, some hundred rows a bucket on average, and by key only in the buckets beyond the limit."""
    keys = nodes.mapInArrow(released(keys), "key long, fp long")
    bucket = F.pmod(F.xxhash64("key"), F.lit(max(1, nodes.count() * 40 * 64 // run_limit))).alias("bucket")
    full = stored(keys.groupBy(bucket).count().where(F.col("count") > run_limit).select("bucket"), "full-buckets")
    if full.isEmpty():
        heavy = nodes.sparkSession.createDataFrame([], "key long, blocks long")
    else:
        counts = keys.withColumn("bucket", bucket).join(full, "bucket", "left_semi").groupBy("key").count()
        heavy = stored(counts.where(F.col("count") > run_limit).select("key", F.ceil(F.col("count") / run_limit).cast("long").alias("blocks")), "heavy-keys")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    # a member of block x goes to the meetings (x, y) for every block y
    meeting = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1), lambda y: F.least(own, y) * F.col("blocks") + F.greatest(own, y))))
    dealt = keys.join(heavy, "key", "left").select("key", meeting.alias("block"), "fp").repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(released(_links(bits)), "u long, v long").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of every node on an edge: root is the least node of its component. Rounds of star contraction:
    a node's larger neighbours, then its smaller ones, are hung on the least it knows, until nothing changes, which
    takes a number of rounds that grows with the logarithm of the nodes. The hub of a star may hold a third of all
    edges; its row is then broadcast, and the edges stay where they are."""
    now = stored(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "stars")
    state = None
    while True:
        sides = now.union(now.select("v", "u"))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(join_unique(sides, least, "u", within=True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_unique(large, least, "u", within=True).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        now = stored(small, "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen


def group_documents(documents: DataFrame, words_each: int = 3, bits: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, fp, root) of every row: the fingerprint as a signed number, and the least fingerprint of its group.

    Null and empty texts have the fingerprint 0 and are linked like any other; null keys and repeated rows stay;
    an empty table gives no rows; columns not in keep are ignored; a text of any length counts whole."""
    fields = {x.name: x.dataType.simpleString() for x in documents.schema.fields}
    prints = stored(text_rows(documents).select(*keep, "text").mapInArrow(released(_fingerprints(words_each)), ", ".join(f"`{x}` {fields[x]}" for x in keep) + ", fp long"), "fingerprints")
    nodes = stored(prints.select("fp").distinct(), "nodes")
    roots = components(links(nodes, bits))
    return join_unique(prints, roots.withColumnRenamed("node", "fp"), "fp", "left", within=True).select(*keep, "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, words_each: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the least doc_id of the group, null only if
    all are null."""
    grouped = stored(group_documents(documents, words_each, bits), "groups")
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return join_unique(grouped, least, "root", within=True).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, words_each: int = 3, bits: int = 3) -> DataFrame:
    """documents with one row of each near-duplicate group: that of the least doc_id (of equal ones, that of the
    least digest of the text; of rows equal in both, any one). A null doc_id is less than any other.

    Null and empty texts are one group; an empty table stays empty; columns of any name come through unchanged. Which
    rows go is found on keys alone. Up to MARKS of them (counted) are broadcast and no text moves; if there are
    more, the texts are dealt by key once."""
    digest = F.coalesce(F.xxhash64("text"), F.lit(0))
    grouped = stored(group_documents(documents.select("doc_id", "text", digest.alias("digest")), words_each, bits, ("doc_id", "digest")).select(*_whole_key(), "root"), "groups")
    stay = grouped.groupBy("root").agg(F.min(F.struct("known", "own", "digest")).alias("stay"))
    key = F.struct("known", "own", "digest")
    rows = stored(join_unique(grouped, stay, "root", within=True).groupBy("known", "own", "digest").agg(F.count("*").alias("times"), F.bool_or(key == F.col("stay")).alias("stays")), "stays")
    held = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), "doc_id", digest.alias("digest")).select("row", *_whole_key())
    moved = rows.where("not stays or times > 1")
    if moved.count() <= MARKS:
        marked = held.join(F.broadcast(moved), ["known", "own", "digest"], "left")
        single = marked.where("times is null").select("row.*")
        if rows.where("stays and times > 1").isEmpty():
            return single
        several = marked.where("stays").dropDuplicates(["known", "own", "digest"]).select("row.*")
        return single.unionByName(several)
    return held.join(rows.where("stays"), ["known", "own", "digest"], "left_semi").dropDuplicates(["known", "own", "digest"]).select("row.*")


def _whole_key() -> list:
    """The key of a row without nulls: equal keys are equal rows of (doc_id, digest), and nulls come first."""
    return [F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("own"), F.col("digest")]
