"""Checksums of binary or text columns: IEEE CRC-32 built in, CRC-32C by an Arrow-batched function."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Values are cut into blocks of this many bytes, which are stepped through side by side.
BLOCK = 512


@functools.cache
def crc32c_table() -> np.ndarray:
    """Table of the Castagnoli polynomial, reflected."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    return table


@functools.cache
def block_ahead() -> np.ndarray:
    """[byte place, byte value]: what a state with that byte becomes after a block of zeros. States add by exclusive or."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(BLOCK):
        state = crc32c_table()[state & np.uint32(255)] ^ state >> np.uint32(8)
    return state


def crc32c_all(values: list[bytes]) -> np.ndarray:
    """CRC-32C of each value. The first block of a value takes what is over whole blocks; blocks are stepped through
    together, byte by byte, and joined value by value by the effect of a block of zeros."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    first, blocks = sizes % BLOCK, sizes // BLOCK
    data = np.frombuffer(b"".join(values) + b"\0", np.uint8)
    begins = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(values)), blocks)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = np.concatenate([begins, (begins + first)[of] + nth * BLOCK])
    length = np.concatenate([first, np.full(len(of), BLOCK)])
    state = np.concatenate([np.full(len(values), 0xFFFFFFFF), np.zeros(len(of))]).astype(np.uint32)
    order = np.argsort(-length, kind="stable")
    alive = np.searchsorted(-length[order], -np.arange(BLOCK), side="left")
    table, at, state = crc32c_table(), at[order], state[order]
    for step, n in enumerate(alive.tolist()):
        if not n:
            break
        own = state[:n]
        state[:n] = table[(own ^ data[at[:n] + step]) & np.uint32(255)] ^ own >> np.uint32(8)
    found = np.empty_like(state)
    found[order] = state
    crc, rest, ahead = found[: len(values)], found[len(values) :], block_ahead()
    for step in range(int(blocks.max(initial=0))):
        rows = np.flatnonzero(nth == step)
        own = crc[of[rows]]
        crc[of[rows]] = rest[rows] ^ ahead[0, own & 255] ^ ahead[1, own >> 8 & 255] ^ ahead[2, own >> 16 & 255] ^ ahead[3, own >> 24]
    return crc ^ np.uint32(0xFFFFFFFF)


def crc32c_of(data: bytes) -> int:
    return int(crc32c_all([data])[0])


@F.pandas_udf(LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C of each value; null for null."""
    known = data.notna()
    found = pd.Series([None] * len(data), index=data.index, dtype="Int64")
    found[known] = crc32c_all([bytes(x) for x in data[known]]).astype(np.int64)
    return found


def crc32(column: str | Column) -> Column:
    return F.crc32(F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary"))
