"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Best fit decreasing over all pieces depends only on how many pieces there are of each length, at most
`capacity` numbers however large the corpus is. So the executors encode, cut and count; the driver packs the
counts with a segment tree over remaining capacities (the tightest open sequence that fits is found in
logarithmic time); and every piece then finds its place from its rank among the pieces of its length. Runs of
equal sequences are kept as intervals, so the driver's plan has some thousand entries, not one per document.
The result is the packing that one machine would make piece by piece, up to swaps of equally long pieces.

A piece's rank is (pieces of its length in earlier blocks) + (rank in its block); a block is what one task
encoded. No group of equally long pieces is ever in one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import library_chunks, vocabulary
from .common import STEP_CHARS, column, released, steps, stored, text_rows

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, rank long, ids binary"


class CapacityTree:
    """Segment tree over the remaining capacities 0..capacity: how many open sequences have each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.total = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        at = remaining + self.leaves
        while at:
            self.total[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity >= need that an open sequence has."""
        at = need + self.leaves
        if not self.total[at]:
            while at > 1 and (at & 1 or not self.total[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.total[2 * at] else 2 * at + 1
        return at - self.leaves


def plan_packing(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """For each length the moves (first rank, first sequence, offset), by rank, and the number of sequences. The
    pieces of a length with ranks from a move's first to the next move's go to consecutive sequences at that
    offset. Which of equally long pieces comes first makes no difference to best fit decreasing, so all
    sequences with the same room are filled at once."""
    tree = CapacityTree(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}  # remaining -> [(first sequence, how many)]
    moves: dict[int, list[tuple[int, int, int]]] = {}
    made = 0

    def give(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for length in sorted((x for x in counts if x > 0), reverse=True):
        left, rank = counts[length], 0
        own = moves.setdefault(length, [])
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = made, -(-left // each)
                made += n
            else:
                first, n = open_[room].pop()
                tree.add(room, -n)
                each = room // length
            # a sequence is the tightest fit until it has no room for this length, so it takes `each` in a row
            whole = min(n, left // each)
            for k in range(each if whole else 0):
                own.append((rank, first, capacity - room + k * length))
                rank += whole
            left -= whole * each
            give(room - each * length, first, whole)
            if whole < n and left:
                some = min(each - 1, left)
                for k in range(some):
                    own.append((rank, first + whole, capacity - room + k * length))
                    rank += 1
                left -= some
                give(room - some * length, first + whole, 1)
                whole += 1
            give(room, first + whole, n - whole)
    return moves, made


def _pieces(name: str, end: int, capacity: int, with_ids: bool, step: int = STEP_CHARS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, close = library_chunks(vocabulary(name)), end.to_bytes(4, "little")
        block, ranks = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            doc_ids, k = column(batch, "doc_id"), 0
            source, out = [], ([], [], [], [], [], [])
            for part in steps((x.as_py() for x in column(batch, "text")), step):
                for ids in encoder.encode(part):
                    ids += close
                    n, at, piece = len(ids) // 4, 0, 0
                    to = n % capacity or capacity
                    while at < n:
                        own = ids[4 * at : 4 * to]
                        source.append(k)
                        for values, x in zip(out, (piece, at, to - at, zlib.crc32(own), ranks[to - at], own if with_ids else None)):
                            values.append(x)
                        ranks[to - at] += 1
                        at, to, piece = to, to + capacity, piece + 1
                    k += 1
            piece, start, length, crc, rank, ids = out
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([block] * len(source), pa.int64()), pa.array(rank, pa.int64()), pa.array(ids, pa.binary())],
                [x.split()[0] for x in PIECES.split(", ")],
            )

    return run


def _places(moves: dict[int, list[tuple[int, int, int]]]):
    table = {length: np.array(own, np.int64).reshape(-1, 3) for length, own in moves.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (column(batch, x).to_numpy() for x in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                own = table[int(length[rows[0]])]
                at = np.searchsorted(own[:, 0], rank[rows], side="right") - 1
                sequence[rows] = own[at, 1] + rank[rows] - own[at, 0]
                offset[rows] = own[at, 2]
            kept = [x for x in batch.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(column(batch, x) for x in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return run


def pack(documents: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end: int = 0, with_ids: bool = False, step: int = STEP_CHARS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece of every document.

    A document is its ids and `end`; one of more than `capacity` ids is cut into pieces of `capacity`, of which
    the first may be shorter. Null text is empty (one piece: `end`); a null key stays null; repeated rows are
    packed each; an empty table gives no rows; further columns are ignored. step: characters that a worker encodes
    at a time; fewer take less memory and more time, and give the same rows."""
    pieces = stored(text_rows(documents).select("doc_id", "text").mapInArrow(released(_pieces(tokenizer, end, capacity, with_ids, step)), PIECES), "pieces")
    blocks = pieces.groupBy("block", "length").agg(F.count("*").alias("n"))
    # at most `capacity` rows come to the driver, whatever the corpus
    moves, _ = plan_packing({int(r["length"]): int(r["n"]) for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    ranked = pieces.join(starts, ["block", "length"]).select(*kept, (F.col("rank") + F.col("before")).alias("rank"))
    types = dict(x.split() for x in PIECES.split(", "))
    schema = ", ".join(f"{x} {types[x]}" for x in kept) + ", sequence_id long, offset long"
    return ranked.mapInArrow(released(_places(moves)), schema)
