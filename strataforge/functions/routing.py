"""Routing of integer partition keys through the levels of a radix-partitioned table.

With spread factor S and last level L, a row at level l goes to the child given by one base-S digit of its key,
and a partition's number at a level is the number of its digits so far.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def child_of(key: str | Column, level: int, spread: int, last_level: int) -> Column:
    """Digit of the key that picks the child of a partition at `level`."""
    step = spread ** (last_level - level - 1)
    return F.pmod(_div(key, step), F.lit(spread)).cast("int")


def partition_of(key: str | Column, level: int, spread: int, last_level: int) -> Column:
    """Number of the key's partition at `level`."""
    return F.pmod(_div(key, spread ** (last_level - level)), F.lit(spread ** (level + 1))).cast("int")


def _div(key: str | Column, by: int) -> Column:
    column = F.col(key) if isinstance(key, str) else key
    return F.call_function("div", column.cast("long"), F.lit(by).cast("long"))


def partitions_between(low: int, high: int, level: int, spread: int, last_level: int) -> list[int] | None:
    """The partitions that keys low..high can be in; None if that is all of them. Keys past the last leaf wrap."""
    block, count = spread ** (last_level - level), spread ** (level + 1)
    first, last = low // block, high // block
    if last - first + 1 >= count:
        return None
    return sorted({k % count for k in range(first, last + 1)})
