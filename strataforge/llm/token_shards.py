"""Token-id output as sorted-string-table shards.

A shard holds documents in ascending order of their identifiers; shards follow each other in that order. A file:

    blocks      zstd-compressed; raw: entries of
                varint shared key bytes | varint further key bytes | varint value bytes | key rest | value
                (keys prefix-compressed within a block; a block's first key is whole)
    index       for each block: varint key length | first key | varint offset | varint bytes
    filter      Bloom filter: varint probes | bits
    footer      fixed size, at the end: offsets and lengths of index and filter, entries, ids, first position,
                crc32 of index and filter, bytes an id, magic

A key is the identifier as 8 bytes, big-endian with the sign bit flipped, so byte order is number order; a null
identifier is the empty key and comes first. A value is the document's first position in the shard (varint) and
its ids, little-endian. A lookup reads the footer, the filter, the index and one block.

Writing: the texts are dealt out by range of the identifier, sorted on each executor, encoded and written block
by block, so a task holds a block, an Arrow batch and the keys' digests. A task writes beside the final name
and renames, so that a repeated or lost attempt leaves no half file. Ranges also cut by a digest of the text:
one identifier on very many rows does not end in one task.
"""

from __future__ import annotations

import array
import io
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import library_chunks, vocabulary
from .common import column, released, steps, tasks_for, text_rows

MAGIC = b"TOKSST01"
FOOTER = struct.Struct("<QQQQQQIH6x8s")
MANIFEST = "shard int, path string, documents long, ids long, bytes long, first_key binary, last_key binary"


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def key_of(identifier: int | None) -> bytes:
    return b"" if identifier is None else (identifier + (1 << 63)).to_bytes(8, "big")


def identifier_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


class Bloom:
    def __init__(self, bits: np.ndarray, probes: int):
        self.bits, self.probes = bits, probes

    @staticmethod
    def of(hashes: np.ndarray, bits_a_key: int = 10) -> Bloom:
        bits = np.zeros(max(64, len(hashes) * bits_a_key) // 8 + 1, np.uint8)
        made = Bloom(bits, 7)
        for at in made._spots(hashes):
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return made

    def _spots(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        size, step = np.uint64(8 * len(self.bits)), (hashes >> np.uint64(32)) | np.uint64(1)
        for k in range(self.probes):
            yield ((hashes + np.uint64(k) * step) % size).astype(np.int64)

    def may_have(self, key: bytes) -> bool:
        hashes = np.array([xxhash.xxh64_intdigest(key)], np.uint64)
        return all(self.bits[at[0] >> 3] >> (at[0] & 7) & 1 for at in self._spots(hashes))


class ShardWriter:
    """add() in ascending order of keys, then close(); file: a binary output stream."""

    def __init__(self, file, width: int = 2, block: int = 256 << 10):
        self.file, self.width, self.block_bytes = file, width, block
        self.raw, self.size, self.key, self.block_key = [], 0, b"", b""
        self.index, self.hashes = bytearray(), array.array("Q")
        self.at = self.entries = self.ids = 0
        self.first: bytes | None = None
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian numbers of `width` bytes."""
        assert self.first is None or key >= self.key, "keys must ascend"
        if self.first is None:
            self.first = key
        shared = 0
        if self.raw:
            while shared < min(len(key), len(self.key)) and key[shared] == self.key[shared]:
                shared += 1
        else:
            self.block_key = key
        if not self.entries or key != self.key:
            self.hashes.append(xxhash.xxh64_intdigest(key))
        value = varint(self.ids) + ids
        self.raw += (varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:], value)
        self.size += len(value) + len(key) + 6
        self.key = key
        self.entries += 1
        self.ids += len(ids) // self.width
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.raw:
            data = self.packer.compress(b"".join(self.raw))
            self.file.write(data)
            self.index += varint(len(self.block_key)) + self.block_key + varint(self.at) + varint(len(data))
            self.at += len(data)
            self.raw, self.size = [], 0

    def close(self) -> int:
        """Writes the rest; the file's size."""
        self._flush()
        bloom = Bloom.of(np.frombuffer(self.hashes, np.uint64))
        tail = bytes(self.index), varint(bloom.probes) + bloom.bits.tobytes()
        self.file.write(b"".join(tail))
        self.file.write(FOOTER.pack(self.at, len(tail[0]), self.at + len(tail[0]), len(tail[1]), self.entries, self.ids, zlib.crc32(b"".join(tail)), self.width, MAGIC))
        return self.at + len(tail[0]) + len(tail[1]) + FOOTER.size


class Shard:
    """Reads a shard from a seekable binary file."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, io.SEEK_END)
        footer = self._read(size - FOOTER.size, FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.entries, self.ids, crc, self.width, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        tail = self._read(index_at, index_len + bloom_len)
        if zlib.crc32(tail) != crc or bloom_at != index_at + index_len:
            raise ValueError("the shard's index or filter is damaged")
        self.keys: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        at = 0
        while at < index_len:
            n, at = read_varint(tail, at)
            self.keys.append(tail[at : at + n])
            offset, at = read_varint(tail, at + n)
            length, at = read_varint(tail, at)
            self.places.append((offset, length))
        probes, at = read_varint(tail, index_len)
        self.bloom = Bloom(np.frombuffer(tail[at:], np.uint8), probes)
        self.unpacker = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, int, bytes]]:
        data, at, key = self.unpacker.decompress(self._read(*self.places[k])), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            start, ids_at = read_varint(data, at)
            at += size
            yield key, start, data[ids_at:at]

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def get(self, identifier: int | None) -> list[tuple[int, np.ndarray]]:
        """(start in the shard, ids) of each document of this identifier; none: an empty list."""
        key = key_of(identifier)
        if not self.bloom.may_have(key):
            return []
        k = bisect_right(self.keys, key) - 1
        while k > 0 and self.keys[k] == key:  # an identifier on several rows may go over several blocks
            k -= 1
        found = []
        for k in range(max(k, 0), len(self.places)):
            if self.keys[k] > key:
                break
            found += [(start, np.frombuffer(ids, f"<u{self.width}")) for own, start, ids in self.block(k) if own == key]
        return found


def open_shard(path: str) -> Shard:
    files, inner = pyarrow.fs.FileSystem.from_uri(path)
    return Shard(files.open_input_file(inner))


def narrowed(ids: bytes, width: int) -> bytes:
    """32-bit ids as numbers of `width` bytes; an id that doesn't fit is an error, never cut."""
    numbers = np.frombuffer(ids, "<u4")
    if int(numbers.max(initial=0)) >> 8 * width:
        raise ValueError(f"an id doesn't fit into {width} bytes")
    return numbers.astype(f"<u{width}").tobytes()


def width_for(name: str, end: int) -> int:
    """Bytes an id: 2 if all ids of the vocabulary and the end fit, or else 4."""
    from tokenizers import Tokenizer

    return 2 if max(end, *Tokenizer.from_file(vocabulary(name)).get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4


def _write(folder: str, name: str, end: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inner = pyarrow.fs.FileSystem.from_uri(folder)
        encoder, close = library_chunks(vocabulary(name)), end.to_bytes(4, "little")
        shard, writer, out = TaskContext.get().partitionId(), None, None
        held = f"{inner}/_attempt-{uuid.uuid4().hex}"
        for batch in batches:
            keys = iter(column(batch, "doc_id").to_pylist())
            for part in steps(x.as_py() for x in column(batch, "text")):
                if writer is None:
                    files.create_dir(inner, recursive=True)
                    out = files.open_output_stream(held)
                    writer = ShardWriter(out, width)
                for ids in encoder.encode(part):
                    ids += close
                    writer.add(key_of(next(keys)), ids if width == 4 else narrowed(ids, width))
        if writer is not None:
            size = writer.close()
            out.close()
            path = f"shard-{shard:06d}.sst"
            files.move(held, f"{inner}/{path}")
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/{path}", "documents": writer.entries, "ids": writer.ids, "bytes": size, "first_key": writer.first, "last_key": writer.key}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())]))

    return run


def write_shards(documents: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end: int = 1, shards: int | None = None, width: int | None = None) -> list:
    """Encodes (doc_id, text) and writes the shards to `folder`, a URI that all executors reach; the manifest,
    one row a shard (of some 64 MB of text), in order. width: bytes an id, 2 or 4 (none: as the vocabulary needs); an
    id that doesn't fit stops the job.

    Null text is empty (its ids are `end`); null keys come first; rows with the same key are all kept, in order of
    their texts' digests; an empty table gives no shard; further columns are ignored."""
    shards, width = shards or tasks_for(documents), width or width_for(tokenizer, end)
    if end >> 8 * width:
        raise ValueError(f"the end doesn't fit into {width} bytes")
    rows = text_rows(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    dealt = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    return sorted(dealt.mapInArrow(released(_write(folder, tokenizer, end, width)), MANIFEST).collect(), key=lambda r: r["shard"])


def _read(paths: list[str], bases: list[int], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in column(batch, "id").to_pylist():
                rows: list[tuple] = []
                held = 0
                shard = open_shard(paths[k])
                for key, start, ids in shard:
                    if shard.width != 4:
                        ids = np.frombuffer(ids, f"<u{shard.width}").astype("<u4").tobytes()
                    rows.append((identifier_of(key), bases[k] + start, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                    held += len(ids) if with_ids else 64
                    if held > 16 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, n, crc, ids = zip(*rows) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (doc_id, start, n, crc)), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def read_shards(spark: SparkSession, manifest: list, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the shards, one task a shard; start counts
    the ids of all documents before it. with_ids=False leaves ids null and saves moving them."""
    paths = [r["path"] for r in manifest]
    bases = [0, *accumulate(r["ids"] for r in manifest)][: len(paths)]
    return spark.range(0, len(paths), 1, max(1, len(paths))).mapInArrow(released(_read(paths, bases, with_ids)), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def lookup(manifest: list, identifier: int | None) -> list[np.ndarray]:
    """The ids of each document of this identifier: the manifest names the shards, each is searched by its index."""
    key = key_of(identifier)
    return [ids for r in manifest if bytes(r["first_key"]) <= key <= bytes(r["last_key"]) for _, ids in open_shard(r["path"]).get(identifier)]
