"""Document fingerprints by a randomised edit embedding.

A shared random walk reads a text and writes its embedding: at step j it writes the character it stands on and
moves on or stays, by a random bit of (j, character). Two texts at a small edit distance walk apart at an edit
and meet again soon, so their embeddings differ in few places: edit distance becomes Hamming distance. The bits
are periodic in j, so the stay of a character depends on its class and j modulo the period and is one table
look-up; many texts walk side by side in numpy, the few longest one by one.

A fingerprint samples the embedding at fixed places, spread over twice the least power of two not below the
text's length; for comparing with shorter texts also over half of that, and at some places over each lower power.
Likeness is the share of equal samples among the places that both embeddings reach, times the ratio of the lengths.

Near texts are found by bands and verified. Lengths are cut into rungs, four an octave. A text has two sketches of
56 bits, each a bit of one symbol of its embedding: over its own rung, which covers it whole, and over the rung
below. Two sketches of one rung are linked if at most 9 bits differ. Candidates are those that share a band, four of
the sampled symbols; sketches of a band are verified by Hamming distance as the links of simhash are, in runs, a hot
band in blocks, and only stars of each local component come out. The classes are the components of all links.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, join_unique, released, steps, stored, text_rows
from .simhash import components, links

PERIOD = 1024
#: Samples over the text's own scale, and as many over half of it.
SAMPLES = 96
#: Every so many of them are taken over each scale below half.
THIN = 12
STEP = 2_000_000
#: Characters of a longer text that are walked at a time.
LONG = 1_000_000
#: Bits of a sketch, how many may differ, symbols a band; the bands share no symbol.
SKETCH, APART, BANDS, BAND_SYMBOLS = 56, 9, 8, 4
#: More ranges of doc_id than this are not dealt: the cuts are held by the driver.
MOST_PARTS = 20_000


@functools.cache
def stays() -> np.ndarray:
    """stay[class * PERIOD + j % PERIOD]: the steps that the walk stands on a character reached at step j."""
    bits = np.random.RandomState(20011).randint(0, 2, (256, PERIOD)).astype(bool)
    bits[:, PERIOD - 1] = True
    nearest = np.where(np.tile(bits, 2), np.arange(2 * PERIOD), 4 * PERIOD)
    return (np.minimum.accumulate(nearest[:, ::-1], axis=1)[:, ::-1][:, :PERIOD] - np.arange(PERIOD) + 1).astype(np.int64).ravel()


@functools.cache
def places() -> np.ndarray:
    """Where the samples lie, as shares of the scale."""
    return np.sort(np.random.RandomState(20021).uniform(0, 1, SAMPLES))


def walk(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The step at which each character is reached, for texts of these sizes laid end to end."""
    classes = (codes.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.int64) * PERIOD
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    falling, table = sizes[order], stays()
    #: how many texts are longer than t, up to where so few are left that they walk one by one
    few = 24
    common = int(falling[few - 1]) if len(falling) >= few else 0
    reached = np.zeros(len(codes), np.int64)
    steps = np.zeros(len(sizes), np.int64)
    if common:
        alive = np.searchsorted(-falling, -np.arange(common), side="left")  # texts with size > t
        firsts = np.cumsum(alive) - alive
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes))
        within = np.arange(len(codes)) - np.repeat(begins, sizes)
        inside = within < common
        spot = firsts[np.minimum(within, common - 1)] + np.repeat(rank, sizes)
        dealt = np.empty(int(alive.sum()), np.int64)
        dealt[spot[inside]] = classes[inside]
        at = np.empty(len(dealt), np.int64)
        for t, (first, n) in enumerate(zip(firsts.tolist(), alive.tolist())):
            own = steps[:n]
            at[first : first + n] = own
            own += table[dealt[first : first + n] + (own & PERIOD - 1)]
        reached[inside] = at[spot[inside]]
    listed: list[int] = []
    for k in range(min(few, len(sizes))):
        if falling[k] > common:
            listed = listed or table.tolist()
            begin = int(begins[order[k]])
            j, seen = int(steps[k]), []
            for c in classes[begin + common : begin + int(falling[k])].tolist():
                seen.append(j)
                j += listed[c + (j & PERIOD - 1)]
            reached[begin + common : begin + int(falling[k])] = seen
    return reached


def scale_of(n: int) -> int:
    return 1 << max(n - 1, 0).bit_length()


def rung_of(n: int) -> int:
    """0 for the empty text; else the least rung whose size is not below n."""
    if not n:
        return 0
    at = 2 + math.floor(4 * math.log2(n))
    while at > 1 and rung_size(at - 1) >= n:
        at -= 1
    return at


def rung_size(rung: int) -> int:
    return math.ceil(2 ** ((rung - 1) / 4)) if rung else 0


@functools.cache
def sketch_places() -> tuple[np.ndarray, np.ndarray]:
    """Where the bits of a sketch lie, as shares of twice the rung's size, and which of them are each band's symbols."""
    random = np.random.RandomState(20023)
    return np.sort(random.uniform(0, 1, SKETCH)), random.permutation(SKETCH)[: BANDS * BAND_SYMBOLS].reshape(BANDS, BAND_SYMBOLS)


def _symbols(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """1 to 255 for a character and the one after it (0: none)."""
    mixed = (codes.astype(np.uint32) * np.uint32(0x9E3779B1) + after.astype(np.uint32) * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
    return (1 + (mixed >> np.uint32(16)) % np.uint32(255)).astype(np.uint8)


def symbols_of(texts: list[str], wanted: list[np.ndarray]) -> list[np.ndarray]:
    """For each text what its embedding has at the wanted steps; 0 beyond its end. The walk leaves its last character
    after two steps or so, as any other. Texts over LONG characters are walked part by part."""
    found: list[np.ndarray] = [np.zeros(len(w), np.uint8) for w in wanted]
    short = [k for k, x in enumerate(texts) if 0 < len(x) <= LONG]
    codes = np.frombuffer("".join(texts[k] for k in short).encode("utf-32-le", "replace"), "<u4")
    sizes = np.fromiter((len(texts[k]) for k in short), np.int64, len(short))
    reached, after = walk(codes, sizes), np.append(codes[1:], 0).astype(np.uint32)
    for k, begin, n in zip(short, (np.cumsum(sizes) - sizes).tolist(), sizes.tolist()):
        own = reached[begin : begin + n]
        there = wanted[k] < own[-1] + 2
        at = np.searchsorted(own, wanted[k][there], side="right") - 1
        found[k][there] = _symbols(codes[begin + at], np.where(at < n - 1, after[begin + at], 0))
    for k, x in enumerate(texts):
        if len(x) > LONG:
            found[k] = _long_symbols(x, wanted[k])
    return found


def _long_symbols(text: str, wanted: np.ndarray) -> np.ndarray:
    table, j, found = stays().tolist(), 0, np.zeros(len(wanted), np.uint8)
    for begin in range(0, len(text), LONG):
        codes = np.frombuffer(text[begin : begin + LONG + 1].encode("utf-32-le", "replace"), "<u4")
        classes = (codes[:LONG].astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.int64) * PERIOD
        seen = []
        for c in classes.tolist():
            seen.append(j)
            j += table[c + (j & PERIOD - 1)]
        own = np.array(seen, np.int64)
        end = j if begin + LONG < len(text) else own[-1] + 2
        there = (wanted >= own[0]) & (wanted < end)
        at = np.searchsorted(own, wanted[there], side="right") - 1
        found[there] = _symbols(codes[at], np.append(codes, 0)[at + 1])
    return found


@functools.cache
def sample_steps(scale: int) -> np.ndarray:
    """The steps that a fingerprint of this scale samples."""
    thin = [places()[::THIN] * 2 * s for s in (scale >> k for k in range(2, scale.bit_length()))]
    return np.concatenate([places() * 2 * scale, places() * scale, *thin]).astype(np.int64)


def sampled(texts: list[str]) -> list[tuple[int, bytes]]:
    """(length, samples) of each text; 0 stands where the embedding has ended."""
    return [(len(x), own.tobytes()) for x, own in zip(texts, symbols_of(texts, [sample_steps(scale_of(len(x))) for x in texts]))]


@functools.cache
def sketch_steps(rung: int) -> np.ndarray:
    """The steps that the sketches of a text of this rung are taken from: own and below."""
    return np.concatenate([(sketch_places()[0] * 2 * rung_size(r)).astype(np.int64) for r in (rung, rung_below(rung))])


def rung_below(rung: int) -> int:
    """The lowest two rungs have none below."""
    return max(rung - 1, min(rung, 1))


def sketches(texts: list[str]) -> list[tuple[int, int, bytes]]:
    """(own, below, symbols) of each text: two sketches with their rungs in the top byte, as signed numbers, and the
    symbols of their bands, one byte each."""
    picks, at, found = sketch_places()[1].ravel(), (np.arange(SKETCH) % 8).astype(np.uint8), []
    rungs = [rung_of(len(x)) for x in texts]
    for rung, both in zip(rungs, symbols_of(texts, [sketch_steps(r) for r in rungs])):
        bits = np.packbits(both.reshape(2, SKETCH) >> at & 1, axis=1, bitorder="little")
        own, below = (int.from_bytes(x.tobytes() + bytes([r]), "little", signed=True) for x, r in zip(bits, (rung, rung_below(rung))))
        found.append((own, below, both.reshape(2, SKETCH)[:, picks].tobytes()))
    return found


def told(n: int, samples: bytes) -> str:
    return f"{n:x}-{samples.hex()}"


def likeness(a: tuple[int, bytes], b: tuple[int, bytes]) -> float:
    """0 to 1; 1 for equal texts. Over the scale of the shorter text, which both sampled; with a text of more than twice
    its scale on fewer places."""
    if a[0] < b[0]:
        a, b = b, a
    if not a[0]:
        return 1.0
    if not b[0]:
        return 0.0
    x, y = np.frombuffer(a[1], np.uint8), np.frombuffer(b[1], np.uint8)[:SAMPLES]
    above = scale_of(a[0]).bit_length() - scale_of(b[0]).bit_length()
    if above < 2:
        x = x[above * SAMPLES : (above + 1) * SAMPLES]
    else:
        y = y[::THIN]
        begin = 2 * SAMPLES + (above - 2) * len(y)
        x = x[begin : begin + len(y)]
    both = (x > 0) & (y > 0)
    return float((x[both] == y[both]).mean() * b[0] / a[0]) if both.any() else 0.0


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel over one text, row by row over the other."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    masks: dict[str, int] = {}
    for k, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << k
    full, top = (1 << len(b)) - 1, 1 << len(b) - 1
    up, down, score = full, 0, len(b)
    for x in a:
        match = masks.get(x, 0)
        zero = (((match & up) + up) ^ up) | match | down
        plus, minus = down | ~(zero | up) & full, up & zero
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | ~(zero | plus) & full, plus & zero
    return score


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (part, guest, doc_id, tie, kind): each text that is no guest with the one after it. A row of
    kind 0 has the class of the texts of kind 1 that follow it and are equal in doc_id and tie."""
    waiting: list[tuple] = []
    held, class_id = 0, None

    def done(rows: list[tuple]) -> pa.RecordBatch:
        texts, edits, nexts, ids, classes = [], [], [], [], []
        for (own, part, _, text, of), (_, other, _, follow, _) in zip(rows, rows[1:]):
            if part == other:
                k = len(text) // 4
                ids.append(own)
                texts.append(text)
                nexts.append(follow)
                edits.append(text[: len(text) - k] + follow[:k])
                classes.append(of)
        distinct = [*dict.fromkeys([*texts, *nexts, *edits])]
        found: dict[str, tuple[int, bytes]] = {}
        for part in steps(distinct, STEP):  # a step's arrays stay small
            found.update(zip(part, sampled(part)))
        prints, changed, after = ([found[x] for x in y] for y in (texts, edits, nexts))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([*map(len, texts)], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edits], pa.string()), pa.array([told(*x) for x in prints], pa.string()), pa.array([told(*x) for x in changed], pa.string()), pa.array([*map(likeness, prints, changed)], pa.float64()), pa.array([*map(likeness, prints, after)], pa.float64()), pa.array(classes, pa.int64())],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"],
        )

    for batch in batches:
        for row in zip(*(column(batch, x) for x in ("doc_id", "part", "guest", "kind", "class_id", "text"))):
            own, part, guest, kind, of, text = (x.as_py() for x in row)
            if not kind:
                class_id = of
                continue
            if guest and waiting and waiting[-1][2] and waiting[-1][1] == part:
                continue  # equal rows at a part's head come several times
            waiting.append((own, part, guest, text, class_id))
            held += len(text)
            if held > STEP:
                yield done(waiting)
                waiting, held = waiting[-1:], 0
    yield done(waiting)


def part_of(rows: DataFrame, n: int) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """A function that adds `part` to a table with (doc_id, tie): about n ranges in the order of (doc_id, tie), nulls
    first. The cuts are taken from a sample of the stored rows, some 20 a range; wherever they fall, the parts follow
    each other exactly, and a doc_id that fills several ranges is cut by tie.

    The part of a row is the number of cuts not above it. As a double, which may round, doc_id tells all cuts but
    those that round alike; those are compared one by one."""
    total = rows.count()
    if n < 2 or not total:
        return lambda df: df.withColumn("part", F.lit(0).cast("long")), 1
    keys = rows.select("doc_id", "tie").where("doc_id is not null").sample(min(1.0, 20 * n / total), 1)
    own = sorted((r["doc_id"], r["tie"]) for r in keys.collect())
    cuts = sorted({own[k * len(own) // n] for k in range(1, n)}) if own else []
    # null keys: as many ranges of tie below all others as they fill
    nulls = rows.where("doc_id is null").count()
    low = max(1, min(n, nulls * n // total))
    groups = [(x, [*of]) for x, of in itertools.groupby(cuts, lambda c: float(c[0]))]
    splits = [-float("inf"), *(x for x, _ in groups), float("inf")] if groups else [-float("inf"), 0.0, float("inf")]
    before = [0, *itertools.accumulate(len(of) for _, of in groups)]

    def add(df: DataFrame) -> DataFrame:
        at = F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))
        cut = Bucketizer(splits=splits, inputCol="__at", outputCol="__bucket", handleInvalid="keep").transform(df.withColumn("__at", at))
        if not groups:
            part = F.lit(0)
        else:
            bucket = F.col("__bucket").cast("int")
            lists = F.array(*(F.array(*(F.struct(F.lit(i).cast("long").alias("doc_id"), F.lit(t).cast("long").alias("tie")) for i, t in of)) for _, of in groups))
            alike = F.col("__at") == F.get(F.array(*(F.lit(x) for x, _ in groups)), bucket - 1)
            passed = F.size(F.filter(F.get(lists, bucket - 1), lambda c: c <= F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("tie").alias("tie"))))
            counts = F.array(*(F.lit(x) for x in before))
            part = F.when(F.coalesce(alike, F.lit(False)), F.get(counts, bucket - 1) + passed).otherwise(F.get(counts, bucket))
        share = (F.col("tie").cast("double") + 2.0**63) / 2.0**64
        below = F.least(F.floor(share * low), F.lit(low - 1)) - low
        return cut.withColumn("part", F.when(F.col("doc_id").isNull(), below).otherwise(part).cast("long")).drop("__at", "__bucket")

    return add, len(cuts) + 1 + low


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, sizes = [], []
        for part in steps((x.as_py() for x in column(batch, "text")), STEP):
            found += sketches(part)
            sizes += map(len, part)
        own, below, symbols = zip(*found) if found else ([],) * 3
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "tie"), pa.array(sizes, pa.int64()), pa.array(own, pa.int64()), pa.array(below, pa.int64()), pa.array(symbols, pa.binary())], ["doc_id", "tie", "n_chars", "own", "below", "symbols"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp): for each band of each sketch a hash of rung, band and symbols."""
    rows, size = 2 * BANDS, BAND_SYMBOLS
    for batch in batches:
        if not batch.num_rows:
            continue
        symbols = np.frombuffer(b"".join(column(batch, "symbols").to_pylist()), np.uint8).reshape(-1, rows, size).astype(np.uint64)
        prints = np.stack([column(batch, x).to_numpy() for x in ("own", "below")], axis=1)
        rung = (prints.view(np.uint64) >> np.uint64(SKETCH)).repeat(BANDS, axis=1)
        key = rung * np.uint64(BANDS) + np.tile(np.arange(BANDS, dtype=np.uint64), 2)
        for k in range(size):
            key = (key ^ symbols[:, :, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(prints.repeat(BANDS, axis=1).ravel())], ["key", "fp"])


def near_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, tie, n_chars, class_id) of every row; tie: the XXH64 of its text; class_id: the least doc_id of its class,
    null only if all are null.

    Texts link if their sketches at one rung differ in APART bits or fewer and share a band; a class is what links
    join. Null text is empty, and empty texts are a class; equal texts have equal sketches and are one class."""
    rows = text_rows(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    found = stored(rows.mapInArrow(released(_sketched), "doc_id long, tie long, n_chars long, own long, below long, symbols binary"), "sketches")
    nodes = stored(found.select("own", "below", "symbols").distinct(), "nodes")
    edges = links(nodes, APART, keys=_bands).union(found.where("own <> below").select(F.greatest("own", "below").alias("u"), F.least("own", "below").alias("v")).distinct())
    roots = components(edges).withColumnRenamed("node", "own")
    grouped = stored(join_unique(found.select("doc_id", "tie", "n_chars", "own"), roots, "own", "left").select("doc_id", "tie", "n_chars", F.coalesce("root", "own").alias("root")), "classes")
    return join_unique(grouped, grouped.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root", within=True).drop("root")


def fingerprints_of_edits(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id) of every row,
    edited with the row after it in the order of doc_id (after the last: the first); class_id as near_classes gives it.

    The texts are dealt once, by ranges of doc_id; each range's first row also goes to the range before it, and each
    row's class to the row. What comes to the driver is a row a range and the sample for their cuts. Null text is
    empty; null keys come first; rows with one key go in the order of their texts' digests, equal rows in any; an
    empty table gives no rows; one row is its own next; further columns are ignored; a text of any length counts
    whole."""
    spark = documents.sparkSession
    classes = stored(near_classes(documents), "near-classes")
    size = classes.agg(F.coalesce(F.sum("n_chars"), F.lit(0))).first()[0]
    n = min(parts or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // (32 << 20))), MOST_PARTS)
    add, n = part_of(classes, n)
    of = add(classes.groupBy("doc_id", "tie").agg(F.first("class_id").alias("class_id")))
    heads = sorted((r["part"], r["head"]["doc_id"], r["head"]["tie"]) for r in add(classes).groupBy("part").agg(F.min(F.struct("doc_id", "tie")).alias("head")).collect())
    table = [(part, own, tie, heads[k - 1][0]) for k, (part, own, tie) in enumerate(heads)]
    lists = F.broadcast(spark.createDataFrame(table, "part long, head_id long, head_tie long, before long"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    own, guest = F.struct(F.col("part"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("part"), F.lit(1).alias("guest"))
    texts = add(text_rows(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")))
    dealt = texts.join(lists, "part").select("doc_id", "text", "tie", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))).alias("to")).select("doc_id", "tie", "to.part", "to.guest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("class_id"), "text")
    both = dealt.unionByName(of.select("doc_id", "tie", "part", F.lit(0).alias("guest"), F.lit(0).alias("kind"), "class_id", F.lit(None).cast("string").alias("text")))
    ordered = both.repartition(n, "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "tie", "kind")
    return ordered.mapInArrow(released(_edited), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long")
