"""Byte codecs of columns: little-endian integers, varints and a byte hash by built-in functions; LZ4 blocks and hybrid
runs of integers by Arrow-batched functions. Null gives null."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bytes_of(data: str | Column) -> Column:
    """array<long> of the bytes, 0 to 255."""
    b = _column(data).cast("binary")
    pairs = F.regexp_extract_all(F.hex(b), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("long"))


def _turned(digits: Column, width: int) -> Column:
    """Hexadecimal digits with the bytes in reverse order."""
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))))


def le_encode(value: str | Column, width: int = 8) -> Column:
    """The low `width` bytes of an integer, little-endian."""
    digits = F.right(F.lpad(F.hex(_column(value).cast("long")), 16, "0"), F.lit(2 * width))
    return F.unhex(_turned(digits, width))


def le_decode(data: str | Column, width: int = 8, signed: bool = True) -> Column:
    """The integer in the first `width` bytes; unsigned ones have at most 7 bytes or fit a signed number."""
    number = F.conv(_turned(F.hex(F.substring(_column(data), 1, width)), width), 16, -10).cast("long")
    if not signed or width == 8:
        return number
    return F.when(number >= 1 << (8 * width - 1), number - (1 << 8 * width)).otherwise(number)


def varint_size(value: str | Column) -> Column:
    """Bytes of the varint of an integer; a negative one has ten."""
    return F.ceil(F.length(F.bin(_column(value).cast("long"))) / 7).cast("int")


def varint_encode(value: str | Column) -> Column:
    """Seven bits a byte, the lowest first; the top bit says that more follow."""
    v = _column(value).cast("long")
    n = varint_size(v)

    def digits(i: Column) -> Column:
        low = F.call_function("shiftrightunsigned", v, (i * 7).cast("int")).bitwiseAND(F.lit(127))
        return F.lpad(F.hex(low + F.when(i < n - 1, 128).otherwise(0)), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), digits), ""))


def varint_decode(data: str | Column) -> Column:
    shifted = F.transform(bytes_of(data), lambda b, i: F.call_function("shiftleft", b.bitwiseAND(F.lit(127)), (i * 7).cast("int")))
    return F.aggregate(shifted, F.lit(0).cast("long"), lambda total, x: total.bitwiseOR(x))


def byte_hash(data: str | Column, base: int = 31) -> Column:
    """h = h * base + byte over all bytes, in 32 bits, unsigned."""
    return F.aggregate(bytes_of(data), F.lit(0).cast("long"), lambda h, b: F.pmod(h * base + b, F.lit(1 << 32)))


@F.pandas_udf(BinaryType())
def lz4_compress(data: pd.Series) -> pd.Series:
    """A block: its raw size as 4 bytes, little-endian, and the LZ4 block."""
    return data.map(lambda x: None if x is None else struct.pack("<I", len(x)) + pa.compress(bytes(x), codec="lz4_raw", asbytes=True))


@F.pandas_udf(BinaryType())
def lz4_decompress(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else pa.decompress(bytes(x[4:]), struct.unpack_from("<I", x)[0], codec="lz4_raw", asbytes=True) if len(x) > 4 and struct.unpack_from("<I", x)[0] else b"")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def hybrid_bytes(values: np.ndarray, width: int) -> bytes:
    """Runs of eight or more equal values as (2 * length, value); what is between them bit-packed by eights, the lowest
    bit first, as (2 * eights + 1, bits). The last eight is filled up with zeros."""
    if len(values) and (int(values.min()) < 0 or int(values.max()) >> width):
        raise ValueError(f"a value has more than {width} bits")
    out, each = [], (width + 7) // 8

    def packed(part: np.ndarray) -> None:
        filled = np.concatenate([part, np.zeros(-len(part) % 8, part.dtype)])
        bits = (filled[:, None] >> np.arange(width)) & 1
        out.append(_varint(len(filled) // 8 << 1 | 1) + np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())

    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])[: len(values)]
    lengths, held = np.diff(np.r_[starts, len(values)]), 0
    for start, length in zip(starts.tolist(), lengths.tolist()):
        open_ = -(start - held) % 8  # what the packed eights before this run still lack
        if length - open_ >= 8:
            if start + open_ > held:
                packed(values[held : start + open_])
            out.append(_varint(length - open_ << 1) + int(values[start]).to_bytes(each, "little"))
            held = start + length
    if held < len(values):
        packed(values[held:])
    return b"".join(out)


def hybrid_values(data: bytes, width: int, n: int) -> np.ndarray:
    """The first n values of hybrid_bytes()."""
    out, at, each, found = [], 0, (width + 7) // 8, 0
    while found < n:
        header = shift = 0
        while True:
            byte = data[at]
            at += 1
            header |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        if header & 1:
            size = (header >> 1) * width
            bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little").reshape(-1, width)
            out.append((bits.astype(np.int64) << np.arange(width)).sum(axis=1))
            at += size
        else:
            out.append(np.full(header >> 1, int.from_bytes(data[at : at + each], "little"), np.int64))
            at += each
        found += len(out[-1])
    return np.concatenate(out)[:n] if out else np.zeros(0, np.int64)


def hybrid_encode(values: str | Column, width: int) -> Column:
    """binary: the count of values as 4 bytes, little-endian, and their hybrid runs, `width` bits a value."""

    @F.pandas_udf(BinaryType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else struct.pack("<I", len(v)) + hybrid_bytes(np.asarray(v, np.int64), width))

    return run(_column(values))


def hybrid_decode(data: str | Column, width: int) -> Column:
    @F.pandas_udf(ArrayType(LongType()))
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else hybrid_values(bytes(b[4:]), width, struct.unpack_from("<I", b)[0]))

    return run(_column(data))
